"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Vectors are lifted to unit length (one more component makes inner product an angle), centred and rotated by iterative
quantisations fitted on a bounded sample (`sample` vectors); signs give 64 bits a rotation, and `turns` rotations from
different beginnings a code. Rows are dealt into slices. A slice's codes are cut into substrings, each with a table
from value to rows. Of two codes at most R bits apart, some substring differs by at most its share of R (pigeonhole),
so probing the values within that share in every table retrieves every code within R; those found are verified by
all their bits, and only what lies within R is reranked by double-precision inner products of the original vectors.
Where a query's radius is so wide that the tables would hand out more rows than the slice has, its codes are verified
as they stand: that retrieves the same.

Every query has a radius of its own, within which the sample's distances let `reach` * k rows be expected. A query
that gets fewer than k grows its radius until it has them.

Queries (a stated set) meet all rows in blocks: a block is a file in the shared folder, a slice is built once, and its
task reads one block after the other. Rows are shuffled once, dealt by hash, so common vectors spread; a slice sends
at most k rows a query to the merge.

Vectors that are null, all zero, or hold null or non-finite components take no part, nor do those without an id or of
another than the most common length. Rows that repeat id and vector count once; rows of one id and different vectors
are different rows, and a query leaves out its own only. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import local_path, save, shared_path, thrifty
from .warc import open_shared

SUBSTRING = 16


class Codes:
    """The learned code: lift, centre, rotate, take signs; a word of 64 bits a rotation."""

    def __init__(self, sample: np.ndarray, scale: float, turns: int = 4, iterations: int = 20):
        self.scale, self.turns = scale, turns
        lifted = self.lift(sample)
        self.mean = lifted.mean(axis=0)
        centred = lifted - self.mean
        self.width = min(64, lifted.shape[1])
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        axes = axes[: self.width].T
        if axes.shape[1] < self.width:  # fewer samples than bits
            axes = np.eye(lifted.shape[1])[:, : self.width]
        low = centred @ axes
        found = []
        for turn in range(turns):
            rotation = np.linalg.qr(np.random.default_rng(7 + turn).normal(size=(self.width, self.width)))[0]
            for _ in range(iterations):
                signs = np.where(low @ rotation >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ low)
                rotation = (u @ v).T
            found.append(axes @ rotation)
        self.projection = np.concatenate(found, axis=1)

    @property
    def bits(self) -> int:
        return self.width * self.turns

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(lifted), self.turns, 64), np.uint8)
        bits[:, :, : self.width] = ((lifted - self.mean) @ self.projection >= 0).reshape(len(lifted), self.turns, self.width)
        return np.packbits(bits, axis=2, bitorder="little").view("<u8").reshape(len(lifted), self.turns)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._codes(self.lift(x))

    def queries(self, x: np.ndarray) -> np.ndarray:
        """A query has unit length and nothing in the added component."""
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return self._codes(np.concatenate([x, np.zeros((len(x), 1))], axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every code of a and every code of b."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)


def radii(q_codes: np.ndarray, sample: np.ndarray, wanted: float, bits: int) -> np.ndarray:
    """For each query, the distance within which a share `wanted` of all rows is expected: from its distances to the
    sample's codes, by their order or, where too few of them lie that near, by the tail of a normal distribution."""
    if not len(sample):
        return np.full(len(q_codes), bits, np.int64)
    out = np.zeros(len(q_codes), np.int64)
    for a in range(0, len(q_codes), 64):
        d = distances(q_codes[a : a + 64], sample)
        nth = int(np.ceil(wanted * len(sample)))
        if wanted >= 1 or nth >= len(sample):
            own = np.full(len(d), bits)
        elif nth >= 4:
            own = np.partition(d, nth, axis=1)[:, nth]
        else:
            own = np.ceil(d.mean(axis=1) + d.std(axis=1) * NormalDist().inv_cdf(wanted))
        out[a : a + 64] = np.clip(own, 0, bits)
    return out


class MultiIndex:
    """One table a substring of SUBSTRING bits, over the codes of a slice."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        #: the substrings as (word, low bit); all-zero ones (codes of fewer bits) have a table like any other
        self.parts = [(w, low) for w in range(codes.shape[1]) for low in range(0, 64, SUBSTRING)]
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None
        self._masks: dict[int, np.ndarray] = {}

    @staticmethod
    def _value(codes: np.ndarray, part: tuple[int, int]) -> np.ndarray:
        return ((codes[..., part[0]] >> np.uint64(part[1])) & np.uint64((1 << SUBSTRING) - 1)).astype(np.int64)

    def masks(self, reach: int) -> np.ndarray:
        """The values of at most `reach` bits."""
        if reach not in self._masks:
            every = np.arange(1 << SUBSTRING, dtype=np.int64)
            self._masks[reach] = every[np.bitwise_count(every) <= reach] if reach >= 0 else every[:0]
        return self._masks[reach]

    def reaches(self, radius: int) -> list[int]:
        """How far to probe in each table: if every substring differed by more, the sum would exceed the radius."""
        share, more = divmod(radius, len(self.parts))
        return [share if j <= more else share - 1 for j in range(len(self.parts))]

    def retrieved(self, code: np.ndarray, radius: int) -> np.ndarray | None:
        """Rows that the probes of one query hand out; None if they would be more than there are."""
        reaches = self.reaches(radius)
        probes = sum(len(self.masks(r)) for r in reaches)
        if probes + probes * len(self.codes) / (1 << SUBSTRING) >= len(self.codes):
            return None
        if self.tables is None:
            self.tables = []
            for part in self.parts:
                value = self._value(self.codes, part)
                order = np.argsort(value, kind="stable")
                self.tables.append((order, np.searchsorted(value[order], np.arange((1 << SUBSTRING) + 1))))
        found = []
        for part, (order, first), reach in zip(self.parts, self.tables, reaches):
            at = int(self._value(code, part)) ^ self.masks(reach)
            begin, count = first[at], first[at + 1] - first[at]
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            found.append(order[np.repeat(begin, count) + inner])
        return np.unique(np.concatenate(found))

    def search(self, queries: np.ndarray, radius: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) for all codes within each query's radius, each once, in order of the query."""
        out_q, out_r = [], []
        for a in range(0, len(queries), step):
            probed = [self.retrieved(q, int(r)) for q, r in zip(queries[a : a + step], radius[a : a + step])]
            whole = [i for i, rows in enumerate(probed) if rows is None]
            near = dict(zip(whole, distances(queries[a : a + step][whole], self.codes) <= radius[a : a + step][whole][:, None]))
            for i, rows in enumerate(probed):
                if rows is None:
                    rows = np.flatnonzero(near[i])
                else:
                    rows = rows[np.bitwise_count(self.codes[rows] ^ queries[a + i]).sum(axis=1) <= radius[a + i]]
                out_q.append(np.full(len(rows), a + i))
                out_r.append(rows)
        return np.concatenate(out_q or [np.zeros(0, np.int64)]), np.concatenate(out_r or [np.zeros(0, np.int64)])


def best_of(index: MultiIndex, ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_codes: np.ndarray, radius: np.ndarray, k: int, step: int = 256):
    """(query position, row position, score) of the k nearest within the radius in a slice for each query."""
    out = []
    for a in range(0, len(q), step):
        who, row = index.search(q_codes[a : a + step], radius[a : a + step])
        who = who + a
        same = np.flatnonzero(q_ids[who] == ids[row])
        own = same[(q[who[same]] == rows[row[same]]).all(axis=1)]
        who, row = np.delete(who, own), np.delete(row, own)
        score = np.concatenate([(q[who[i : i + 65536]] * rows[row[i : i + 65536]]).sum(axis=1) for i in range(0, len(who), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        out.append((who[rank < k], row[rank < k], score[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _gathered(batches) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes of the vectors, vectors) by part, in one order and each (id, vector) once."""
    held: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, ids, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        for p in np.unique(parts).tolist():
            held.setdefault(p, []).append((ids[parts == p], own[parts == p], x[parts == p]))
    out = {}
    for p in list(held):
        ids, own, x = (np.concatenate(c) for c in zip(*held.pop(p)))
        order = np.lexsort((*x.T[::-1], own, ids))
        ids, own, x = ids[order], own[order], x[order]
        once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)])
        out[p] = ids[once], own[once], x[once]
    return out


def _dealt(rows: DataFrame, tag: str, n: int) -> DataFrame:
    """(part, vec_id, own: a hash of the vector, embedding), by part; rows that repeat each other are of one part."""
    part = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(tag)), F.lit(n)).cast("int")
    return rows.select(part.alias("part"), "vec_id", F.xxhash64("embedding").alias("own"), "embedding").repartitionByRange(n, "part")


def _write_block(uri: str, *arrays: np.ndarray) -> None:
    """Whole or not at all; a task that runs twice puts the same bytes."""
    local = local_path(uri)
    with open_shared(f"{uri}.{uuid.uuid4().hex}" if local else uri, write=True) as file:
        for a in arrays:
            file.write(np.ascontiguousarray(a).tobytes())
    if local:
        os.replace(file.name, local)


def _read_block(uri: str, n: int, d: int, turns: int):
    with open_shared(uri) as file:
        raw = file.read()
    at, out = 0, []
    for kind, width in (("<i8", 1), ("<i8", 1), ("<f8", d), ("<u8", turns), ("<i8", 1)):
        out.append(np.frombuffer(raw, kind, n * width, at).reshape(n, width))
        at += 8 * n * width
    return out[0][:, 0], out[1][:, 0], out[2], out[3], out[4][:, 0]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, slice_rows: int = 8192, block_rows: int = 1024, sample: int = 4096, reach: int = 48, turns: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that is_query (a condition on vec_id) chooses."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~bad).where(F.exists("embedding", lambda v: v != 0)).withColumn("square", F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    by_size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square"), F.count(F.when(is_query, 1)).alias("queries")).orderBy(F.desc("n"), "d").first()
    if by_size is None or not by_size["queries"]:
        return spark.createDataFrame([], schema)
    d, total, scale, asked = by_size["d"], by_size["n"], float(np.sqrt(by_size["square"])) * (1 + 1e-12), by_size["queries"]
    rows = rows.where(F.size("embedding") == d)
    # the rows of least hash: a sample of a fixed size, the same on every run
    drawn = rows.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).toPandas()
    fitted = np.array(drawn["embedding"].tolist(), np.float64).reshape(-1, d)
    codes = Codes(fitted, scale, turns)
    learned = spark.sparkContext.broadcast((codes, codes.rows(fitted)))
    slices, blocks = -(-total // slice_rows), max(1, -(-asked // block_rows))
    folder = shared_path(spark, "queries")

    def blocks_of(queries: DataFrame, wider: int) -> list[tuple[str, int]]:
        """Write the blocks of queries; (uri, rows) of each."""

        @thrifty
        def run(batches):
            import pyarrow as pa

            codes, near = learned.value
            for p, (ids, own, x) in _gathered(batches).items():
                q_codes = codes.queries(x)
                radius = np.minimum(radii(q_codes, near, reach * k * 2.0**wider / total, codes.bits), codes.bits)
                uri = f"{folder}/block-{wider}-{p}"
                _write_block(uri, ids.astype("<i8"), own.astype("<i8"), x.astype("<f8"), q_codes.astype("<u8"), radius.astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(ids)], pa.int64())], ["uri", "n"])

        made = _dealt(queries, "block", blocks).mapInArrow(run, "uri string, n bigint").collect()  # a row a block
        return sorted((r["uri"], r["n"]) for r in made)

    def found_in(made: list[tuple[str, int]]) -> DataFrame:
        """The k nearest within the radius, of each query in each slice."""

        @thrifty
        def run(batches):
            import pyarrow as pa

            codes, _ = learned.value
            for ids, _, x in _gathered(batches).values():
                index = MultiIndex(codes.rows(x))
                for uri, n in made:
                    q_ids, own, q, q_codes, radius = _read_block(uri, n, d, codes.turns)
                    who, row, score = best_of(index, ids, x, q_ids, q, q_codes, radius, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(own[who]), pa.array(ids[row]), pa.array(score)], ["query_id", "own", "vec_id", "score"])

        return _dealt(rows, "slice", slices).mapInArrow(run, "query_id bigint, own bigint, vec_id bigint, score double")

    queries = rows.where(is_query).select("vec_id", "embedding").distinct()
    # a query is known by its id and a hash of its vector, as ids may repeat
    order = W.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    keep = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    result = save(keep(found_in(blocks_of(queries, 0))), "nearest")
    need = k if total > 2 * k else min(k, rows.select("vec_id", "embedding").distinct().count() - 1)
    for wider in range(4, 68, 4):
        # queries that have too few: their radius grows until it holds all bits
        full = result.groupBy("query_id", "own").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= need)
        named = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("own"), "embedding")
        short = named.join(full, ["query_id", "own"], "left_anti")
        if need < 1 or short.isEmpty():
            break
        again = save(keep(found_in(blocks_of(short.select(F.col("query_id").alias("vec_id"), "embedding"), wider))), "nearest")
        others = result.join(short.select("query_id", "own"), ["query_id", "own"], "left_anti").select(result.columns)
        result = save(others.unionByName(again), "nearest")
    return result.select("query_id", "rank", "vec_id", "score")
