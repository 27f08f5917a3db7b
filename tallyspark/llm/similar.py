"""Near duplicates by shingle similarity: candidates from wide SimHash fingerprints, decided by exact Jaccard.

A text stands for its set of distinct word shingles, and is named by a hash of that set; texts of one set are copies
and count once. Two texts are linked if the exact Jaccard similarity of their sets is `similarity` or more.

Candidates come from the deletion-variant join. At a similarity of 0.8 about 15 % of the bits differ, far more than a
64-bit fingerprint can be searched for. So a text gets 960 bits, on which distinct shingles vote: the first 128 check
candidates; of the others 814 are cut into 37 segments of 22 bits, each indexed with one bit a wildcard. Two texts
become candidates if some segment differs by at most one bit, which at a similarity of 0.8 fails for one pair in two
hundred (at 0.85 for hardly any; near copies mostly meet through several others too). The votes of very few shingles
are too coarse for that; sets of up to `few` that similar ones can differ from in one shingle only are found by the
names of their subsets that lack one. Candidates within `loose` bits of 128, far more than similar texts differ in,
form groups, and inside a group every link is verified by the sets.

A group of loosely similar texts is verified in tiles of at most about 2 * `tile` shingles, so none lands in one task.
Only texts that have a candidate send their sets. A null or empty text has no shingle and is similar to its like.
Repeated rows are separate rows of one group; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, save, slices, thrifty, utf8
from .components import components
from .simhash import halves, majority, packed_join, shingle_hashes

CHECK, SEGMENTS, WIDTH = 2, 37, 22
WORDS = CHECK + -(-SEGMENTS * WIDTH // 64)


def differing_share(similarity: float) -> float:
    """The share of fingerprint bits in which texts of this (Jaccard) similarity and of like length differ, on average."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    return [np.unique(np.array(shingle_hashes(t, shingle), "<u8")) for t in texts]


def name_of(own: np.ndarray) -> int:
    """The hash that names a set of shingles, signed."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), 42)], np.uint64).view(np.int64)[0])


def wide_words(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WORDS words a set: the majority of mixed hashes of its shingles; zeros for an empty set."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    at = np.array([i for i, own in enumerate(sets) if len(own)], np.int64)
    if len(at):
        h, sizes = np.concatenate([sets[i] for i in at]), np.array([len(sets[i]) for i in at])
        for w in range(0, WORDS, 5):  # as many words at once as keep the arrays small
            each = np.arange(w, min(w + 5, WORDS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out[at, w : w + 5] = majority(mix(h[:, None] + each), sizes)
    return out


def wide_fingerprints(docs: DataFrame, shingle: int, few: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row: a hash of id and text, fp: the name of its set, n: its shingles, wide: all words as bytes, less: the
    names of the set without each of its shingles, for sets of 2 to `few`) for every row."""

    @thrifty
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 2):
            texts = utf8(batch.column(2))
            fp, n, wide, less = [], [], [], []
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], shingle)
                fp += map(name_of, sets)
                n += map(len, sets)
                wide += [w.tobytes() for w in wide_words(sets)]
                less += [[name_of(np.delete(own, i)) for i in range(len(own))] if 1 < len(own) <= few else None for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(wide, pa.binary()), pa.array(less, pa.list_(pa.int64()))], ["doc_id", "row", "fp", "n", "wide", "less"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, row bigint, fp bigint, n bigint, wide binary, less array<bigint>")


def _segment(words: np.ndarray, j: int) -> np.ndarray:
    """Segment j of the bits after the words that check candidates."""
    low = j * WIDTH
    word, at = CHECK + low // 64, low % 64
    out = words[:, word] >> np.uint64(at)
    if at + WIDTH > 64:
        out = out | (words[:, word + 1] << np.uint64(64 - at))
    return out & np.uint64((1 << WIDTH) - 1)


def _checked(columns) -> tuple[np.ndarray, np.ndarray]:
    """(name and words that check candidates, all words) of a batch of fp and wide."""
    words = np.frombuffer(b"".join(columns[1].to_pylist()), "<u8").reshape(-1, WORDS)
    fp = columns[0].to_numpy(zero_copy_only=False).view(np.uint64)
    return np.column_stack([fp, words[:, :CHECK]]), words


def _sign(columns):
    fp, words = _checked(columns)
    return fp, (_segment(words, v // 2) for v in range(2 * SEGMENTS))


def similar_to(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have this exact Jaccard similarity to `own`, or more; none is empty."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= similarity * (sizes + len(own) - both) - 1e-9


def group_links(wide: np.ndarray, sets: list[np.ndarray], similarity: float, block: int = 512) -> list[tuple[int, int]]:
    """(row, row): stars over the rows, by breadth-first search over exact similarities."""
    # far more bits than similar sets differ in (those of a few shingles differ in more than the share): saves comparing
    share = differing_share(similarity) + 0.04
    most = 64 * WORDS * share + 5 * math.sqrt(64 * WORDS * share)
    left, out = np.arange(len(wide)), []
    while len(left) > 1:
        pivot, front, left = int(left[0]), [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(wide[left] ^ wide[at]).sum(axis=1) <= most
            maybe = np.flatnonzero(near)
            for a in range(0, len(maybe), block):
                own = maybe[a : a + block]
                near[own] = similar_to(sets[at], [sets[i] for i in left[own]], similarity)
            got = left[near].tolist()
            out += [(pivot, i) for i in got]
            front += got
            left = left[~near]
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, loose: int = 40, tile: int = 1 << 21, few: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, group_id: the least doc_id of the texts linked by similarities of `similarity` or more)."""
    prints = save(wide_fingerprints(docs, shingle, few, id_col, text_col), "wide")
    # what depends on the set alone is the same in all rows of a name
    first = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("wide").alias("wide"), F.min("less").alias("less")), "distinct")
    some = first.where("n > 0")
    links = packed_join(some.select("fp", "wide"), 2, halves(list(range(WIDTH))) * SEGMENTS, _sign, None, loose, 1 + CHECK)
    subsets = some.where((F.col("n") - 1) / F.col("n") >= similarity).select(F.col("fp").alias("a"), F.explode("less").alias("b"))
    links = links.union(subsets.join(some.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
    met = save(components(links), "met")

    members = some.select("fp", "row", "n", "wide").join(met.withColumnRenamed("node", "fp"), "fp")
    sizes = members.groupBy("root").agg(F.sum("n").alias("all"))
    dealt = members.join(sizes, "root").select("row", "fp", "wide", "root", F.ceil(F.col("all") / tile).cast("int").alias("parts"))
    # the texts of members are cut again: rows that repeat id and text once
    texts = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(dealt, "row").dropDuplicates(["row"]).select("root", "parts", "fp", "wide", "text")

    @thrifty
    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches, 4):
            sets = shingle_sets(utf8(batch.column(4)), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([x.tobytes() for x in sets], pa.binary())], ["root", "parts", "fp", "wide", "own"])

    tiles = texts.mapInArrow(cut, "root bigint, parts int, fp bigint, wide binary, own binary").withColumn("at", F.pmod(F.hash("fp"), F.col("parts")))
    tiles = tiles.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("root", F.least("at", "other").alias("ti"), F.greatest("at", "other").alias("tj"), "fp", "wide", "own")

    @thrifty
    def verify(batches):
        import pyarrow as pa

        key, fps, wides, sets = None, [], [], []

        def settle():
            rows = group_links(np.frombuffer(b"".join(wides), "<u8").reshape(-1, WORDS), sets, similarity) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([fps[i] for i, _ in rows], pa.int64()), pa.array([fps[j] for _, j in rows], pa.int64())], ["a", "b"])

        for whole in batches:
            for batch in slices([whole], 5):
                for root, ti, tj, fp, wide, own in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if (root, ti, tj) != key:
                        yield settle()
                        key, fps, wides, sets = (root, ti, tj), [], [], []
                    fps.append(fp)
                    wides.append(wide)
                    sets.append(np.frombuffer(own, "<u8"))
        yield settle()

    sure = components(tiles.repartition("root", "ti", "tj").sortWithinPartitions("root", "ti", "tj").mapInArrow(verify, "a bigint, b bigint"))
    rooted = first.select("fp", "first").join(sure.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("group_id"))
    of_print = rooted.select("fp", "root").join(least, "root").select("fp", "group_id")
    return prints.select("doc_id", "fp").join(of_print, "fp", "left").select("doc_id", "fp", "group_id")
