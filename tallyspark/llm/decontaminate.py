"""Benchmark decontamination: a prefix-filtered set join of document shingles with benchmark windows.

Every window of an item is a set of word shingles. Shingles are ordered by rarity in the corpus; a document
that holds the window holds its rarest shingle, so that one (the necessary prefix for containment 1) is joined.
Length and positional bounds drop candidates whose window would begin before or end after the words around the
shingle, and the words themselves are then compared.

The text is read once. A Bloom filter sized by the number of shingles, within a proven bound, decides
which shingles of a document leave the scan; all later steps are equality joins and combinable aggregates.

Nulls and empty texts have no words: such documents are clean, such items have no window. Repeated document rows
are judged alike, each with its own result row. A null item_id counts as the empty string. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Words, chunks, row_key, save, slices, thrifty, utf8

#: log2 of the Bloom filter's bits, at least and at most (16 MB), and its hashes a key.
BLOOM_LEAST, BLOOM_MOST, BLOOM_HASHES = 20, 27, 4


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Bloom bit positions of some hashes, one row a hash function."""
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([((h + step * np.uint64(i)) & np.uint64((1 << bits) - 1)) for i in range(BLOOM_HASHES)])


def _hits(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter lets pass."""
    at, mask = np.arange(len(h)), np.uint64(64 * len(bloom) - 1)
    for i in range(BLOOM_HASHES):
        step = (h >> np.uint64(33)) | np.uint64(1)
        p = (h + step * np.uint64(i)) & mask
        ok = (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
        keep = np.flatnonzero(ok)
        at, h = at[keep], h[keep]
    return at


def item_windows(items: DataFrame, window: int, shingle: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per window of an item: item_id, words (space-joined), n words, k (shingle size), hashes (its shingles in order)."""

    @thrifty
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            out = {c: [] for c in ("item_id", "words", "n", "k", "hashes")}
            for i, text in zip(ids, texts):
                words = Words([text], "alnum", lower=True)
                m = min(window, len(words))
                if not m:
                    continue
                k = min(shingle, m)
                grams = words.grams(k).view(np.int64).tolist()
                low = words.buf.tobytes()
                tokens = [low[s:e].decode("utf-8", "replace") for s, e in zip(words.starts.tolist(), words.ends.tolist())]
                for at in range(len(tokens) - m + 1):
                    out["item_id"].append(i or "")
                    out["words"].append(" ".join(tokens[at : at + m]))
                    out["n"].append(m)
                    out["k"].append(k)
                    out["hashes"].append(grams[at : at + m - k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.string()), pa.array(out["words"], pa.string()), pa.array(out["n"], pa.int32()), pa.array(out["k"], pa.int32()), pa.array(out["hashes"], pa.list_(pa.int64()))], list(out))

    return items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id string, words string, n int, k int, hashes array<bigint>")


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """The filter of column h, of 16 bits a hash up to 2**BLOOM_MOST: or-ed in Spark by 64-bit word, so at most
    2**(BLOOM_MOST - 6) rows come to the driver. With more hashes than fit, more shingles pass; results stay exact."""
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, (16 * hashes.count()).bit_length()))

    @thrifty
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = _positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = hashes.select("h").mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bloom = np.zeros(1 << (bits - 6), np.uint64)
    bloom[words["word"].to_numpy()] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bloom


def document_hits(docs: DataFrame, bloom, sizes: list[int], window: int) -> DataFrame:
    """A row per document: its keys, n_words, and the shingles the filter lets pass, each with the words around it."""

    @thrifty
    def run(batches):
        import pyarrow as pa

        bits = bloom.value
        for batch in slices(batches, 3):
            texts = utf8(batch.column(3))
            n_words, hits = [], []
            for a, b in chunks(texts):
                words = Words(texts[a:b], "alnum", lower=True)
                found: list[list] = [[] for _ in range(b - a)]
                low = words.buf.tobytes()
                starts, ends, bounds = words.starts, words.ends, words.bounds
                for k in sizes:
                    at = _hits(bits, grams := words.grams(k))
                    doc = np.searchsorted(bounds, at, side="right") - 1
                    ok = at + k <= bounds[doc + 1]
                    for p, d, h in zip(at[ok].tolist(), doc[ok].tolist(), grams[at[ok]].view(np.int64).tolist()):
                        begin, end = max(p - (window - k), int(bounds[d])), min(p + window, int(bounds[d + 1]))
                        around = b" ".join(low[s:e] for s, e in zip(starts[begin:end].tolist(), ends[begin:end].tolist()))
                        found[d].append({"h": h, "k": k, "pos": p - int(bounds[d]), "before": p - begin, "around": around.decode("utf-8", "replace")})
                n_words += np.diff(bounds).tolist()
                hits += found
            kind = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32()), ("pos", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n_words, pa.int64()), pa.array(hits, kind)], ["_k1", "_k2", "doc_id", "n_words", "hits"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"_k1 bigint, _k2 int, doc_id {kind}, n_words bigint, hits array<struct<h:bigint,k:int,pos:int,before:int,around:string>>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Find the words of documents that lie in an occurrence of an item's window (all its words, if it has fewer).

    Returns (verdicts, matches). verdicts, a row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated. matches, a row per occurrence: _k1, _k2 (row_key of id and text), start, n, words.
    """
    windows = save(item_windows(items, window, shingle, item_col, item_text_col), "windows")
    spark = docs.sparkSession
    shingles = windows.select("k", F.explode("hashes").alias("h")).distinct()
    bloom = spark.sparkContext.broadcast(bloom_filter(shingles))
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most `shingle` of them
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(*row_key("doc_id", "text"), "doc_id", "text")
    seen = save(document_hits(keyed, bloom, sizes, window), "hits")

    hits = seen.select("_k1", "_k2", F.explode("hits").alias("x")).select("_k1", "_k2", "x.*")
    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # the rarest shingle of every window; one the corpus never has makes the window absent
    each = windows.select("words", "n", "k", "hashes").distinct().select("words", "n", "k", F.posexplode("hashes").alias("offset", "h"))
    prefix = each.join(rarity, "h", "left").groupBy("words", "n", "k").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h"), F.col("offset"))).alias("p"))
    prefix = prefix.where("p.df > 0").select("words", "n", "k", "p.h", "p.offset")

    candidates = hits.join(prefix, ["h", "k"])
    bounded = candidates.where("pos >= offset and before >= offset")  # positional bound
    around = F.split("around", " ")
    bounded = bounded.where(F.size(around) >= F.expr("before - offset + n"))  # length bound
    matches = bounded.where(F.array_join(F.slice(around, F.expr("before - offset + 1"), F.col("n")), " ") == F.col("words"))
    matches = save(matches.select("_k1", "_k2", F.expr("pos - offset").alias("start"), "n", "words").distinct(), "matches")

    order = W.partitionBy("_k1", "_k2").orderBy("start", "n")
    reach = F.max(F.expr("start + n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    covered = matches.select("_k1", "_k2", "start", "n").distinct().withColumn("reach", F.coalesce(reach, F.lit(0)))
    covered = covered.groupBy("_k1", "_k2").agg(F.sum(F.expr("greatest(0, start + n - greatest(start, reach))")).cast("long").alias("n_hit"))
    owners = windows.select("words", "item_id").distinct()
    named = matches.select("_k1", "_k2", "words").distinct().join(owners, "words").select("_k1", "_k2", "item_id").distinct()
    named = named.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    out = seen.select("_k1", "_k2", "doc_id", "n_words").join(covered, ["_k1", "_k2"], "left").join(named, ["_k1", "_k2"], "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    verdicts = out.select("_k1", "_k2", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    return verdicts, matches
