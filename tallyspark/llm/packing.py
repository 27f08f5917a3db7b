"""Packing token sequences by cutting-stock column generation.

Documents are tokenised once, cut at every `capacity` tokens, and each piece becomes a row without its ids. Whole
pieces fill a sequence; the rest form a histogram over `classes` length classes (lengths rounded up to a quantum),
which is all the driver sees. A linear program over patterns (how many pieces of each class share a sequence)
is solved by column generation: its duals price classes, an unbounded knapsack by dynamic programming finds the
best new pattern, until none improves. Pattern counts are rounded down; the few pieces left over, bounded by the
number of classes, are packed best-fit. Pieces are ranked within their class (counts by salt, then a window inside
class and salt) and the ranks read off their pattern, so no task holds a class and nothing is collected.

A null or empty text has no ids but the final one. Repeated rows are packed each on their own. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import row_key, save, slices, thrifty

# ---- tokens -----------------------------------------------------------------------------------------------------


class Memo(dict):
    """Values by key, made where they are missing; forgets what two rounds of `limit` new keys have not asked for."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """Ids of whole texts by a word-end BPE vocabulary, the same as tokenizers' encode, remembered by piece.

    The vocabulary's pre-tokeniser lowers letters, cuts a text into pieces by a pattern, drops white space and never
    looks across it. Where a text has only letters, digits and signs of Latin-1 that its pattern can be stated for, the
    pieces are cut by that pattern here and each goes to the model once; words with any other character go through the
    whole tokenizer.
    """

    LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    # ---- fixed values: the pre-tokeniser's pattern over those letters, digits and signs; "<" may begin a special token ----
    PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\\[-`{-~]+")
    OTHER = re.compile(f"[^{LETTERS}!-;=-~ \\t-\\r]")

    def __init__(self, path: str, remember: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = [b for b in range(256) if b not in kept]
        #: the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        self.alphabet = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(shifted)}
        #: each id as little-endian 32-bit number
        self.coded = [bytes(x) for x in np.arange(self.tokenizer.get_vocab_size(), dtype="<u4").view(np.uint8).reshape(-1, 4)]
        self.pieces, self.words = Memo(self._piece, remember), Memo(self._word, remember // 8)

    def _piece(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.coded[t.id] for t in self.model.tokenize(raw)])

    def _word(self, word: str) -> bytes:
        return b"".join([self.coded[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.PIECE.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.OTHER.search(text):
            return self._plain(text)
        out, plain = [], []
        for word in re.split("[ \t-\r]+", text):
            if self.OTHER.search(word):
                out += (self._plain(" ".join(plain)), self.words[word])
                plain.clear()
            else:
                plain.append(word)
        return b"".join([*out, self._plain(" ".join(plain))])

    def forget(self) -> None:
        for memo in (self.pieces, self.words):
            memo.clear()
            memo.old = {}


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker process; tasks clear what it remembers when they end."""
    return WordEncoder(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: _k1, _k2, doc_id, start, length, ids_crc32, doc_tokens."""
    kind = dict(docs.dtypes)[id_col]
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["_k1", "_k2", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    @thrifty
    def run(batches):
        import zlib

        import pyarrow as pa

        encoder = encoder_of(tokenizer_path)
        final = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 3):
            rows, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(3).cast(pa.string()).to_pylist()):
                ids = encoder.encode(text or "") + final
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    rows.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names)
        encoder.forget()

    return keyed.mapInArrow(run, f"_k1 bigint, _k2 int, doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


# ---- the cutting-stock program ----------------------------------------------------------------------------------


def _knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes that fits, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    sizes, values = size[order], value[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            got = best[c - sizes[:fit]] + values[:fit]
            j = int(np.argmax(got))
            if got[j] > best[c] + 1e-12:
                best[c], last[c] = got[j], order[j]
    pattern, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(size[last[c]])
    return float(best[capacity]), pattern


def solve_patterns(size: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is cut, meeting each class's demand exactly.

    The restricted program min sum x, A x = demand, x >= 0 is kept as a basis with its inverse; a priced column
    enters and the ratio test chooses which leaves (revised simplex; the first basis is one class a pattern).
    """
    m = len(size)
    if not m:
        return []
    # each class alone, as often as it fits and is asked for
    alone = np.minimum(capacity // size, demand)
    columns = np.diag(alone).astype(float)
    inverse = np.diag(1.0 / alone)
    x = demand / alone
    for step in range(max_columns):
        duals = inverse.sum(axis=0)
        worth, pattern = _knapsack(np.maximum(duals, 0), size, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        able = direction > 1e-9
        ratio = np.where(able, x / np.where(able, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        t = ratio[leave]
        x = np.maximum(x - t * direction, 0)
        x[leave] = t
        columns[:, leave] = pattern
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        if step % 200 == 199:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ demand, 0)
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = np.rint(columns[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(np.floor(x[j] + 1e-9)), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    # what rounding left: fill a sequence with the largest that fits, as far as each pattern goes
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for i in np.argsort(-size, kind="stable"):
            n = min(int(left[i]), int(room // size[i]))
            pattern[i] = n
            room -= n * int(size[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


# ---- assignment -------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, classes: int = 256, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset, keyed by _k1, _k2 (row_key of id and text)."""
    quantum = -(-capacity // classes)
    pieces = save(tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    spark = docs.sparkSession
    ranked = pieces.withColumn("class", F.ceil(F.col("length") / quantum).cast("int")).withColumn("salt", F.pmod(F.hash("_k1", "_k2", "start"), F.lit(salts)))
    # at most classes * salts rows
    counts = ranked.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["class", "salt"])
    counts["base"] = counts.groupby("class")["n"].cumsum() - counts["n"]
    histogram = counts.groupby("class")["n"].sum()
    size, demand = histogram.index.to_numpy(np.int64), histogram.to_numpy(np.int64)
    slots, first = [], 0
    served = {int(c): 0 for c in size}
    for pattern, times in solve_patterns(size, demand, -(-capacity // quantum)):
        order = 0
        for c, a in zip(size.tolist(), pattern.tolist()):
            if a:
                slots.append((c, served[c], served[c] + a * times, a, first, order))
                served[c] += a * times
                order += a
        first += times
    bases = spark.createDataFrame([(int(r["class"]), int(r["salt"]), int(r["base"])) for r in counts.to_dict("records")], "class int, salt int, base bigint")
    # a class's slots in rank order: bounded by classes squared, whatever the number of documents
    table = spark.createDataFrame(slots, "class int, from_rank bigint, to_rank bigint, each int, first bigint, slot int")
    table = table.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "each", "first", "slot"))).alias("slots"))

    within = W.partitionBy("class", "salt").orderBy("_k1", "_k2", "start", "doc_id")
    ranked = ranked.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(bases), ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = ["_k1", "_k2", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found = ranked.join(F.broadcast(table), "class").select(*names, "rank", F.expr("filter(slots, x -> rank >= x.from_rank and rank < x.to_rank)[0]").alias("x"))
    placed = found.select(*names, F.expr("x.first + (rank - x.from_rank) div x.each").alias("sequence_id"), F.expr("x.slot + (rank - x.from_rank) % x.each").alias("slot"))
    before = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def padding(lengths: np.ndarray, capacity: int) -> int:
    """Tokens of padding for sequences of these lengths: up to the capacity, but none at a power of two."""
    return int(sum(0 if n & (n - 1) == 0 else capacity - n for n in map(int, lengths)))


