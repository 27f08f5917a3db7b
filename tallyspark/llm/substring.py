"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: the least hash among the word k-grams of a window of `length` words. The anchor is a
function of the window's words, so equal windows meet under one anchor, wherever they stand. An anchor's
occurrence is shipped once, with the stretch of windows that it anchors, extended left and right around it as
window hashes (an anchor of 64 bits and a window hash of 47 name a window's words). Where occurrences of an anchor
meet, each window found more than once, anywhere, is repeated; runs of repeated windows are the maximal repeats,
and the words that they cover are removed. Pairs of occurrences are never made.

Rows are packed: every `chunk` windows a task sends one binary row a bucket. Skew: a chunk resolves the windows it holds
twice and ships one of each; a bucket again keeps one of each distinct window; and an anchor with more than
`hot` stretches in a bucket that outgrows `limit` bytes is dealt anew by single window, which spreads evenly.

Windows are judged on the input, the same document included; all occurrences go. Null and empty texts have no
words. Repeated rows repeat each other. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, Words, buckets, mix, row_key, save, slices, thrifty, utf8, windowed_min

HEAD = np.dtype([("anchor", "<u8"), ("k1", "<i8"), ("k2", "<i4"), ("start", "<u4"), ("n", "<u4")])
MASK = np.uint64((1 << 48) - 2)  # of a window hash; the lowest bit says that it is known to repeat
ROUTED = "bucket int, payload binary, k1 bigint, k2 int, s int, e int"


def _runs(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs that begin at 0 and after each break."""
    first = np.concatenate([[0], np.flatnonzero(breaks) + 1]) if n else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate([first, [n]]))


def _pack(head: np.ndarray, windows: np.ndarray) -> bytes:
    return np.uint32(len(head)).tobytes() + head.tobytes() + np.ascontiguousarray(windows.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, HEAD, n, 4)
    raw = np.frombuffer(data, np.uint8, -1, 4 + n * HEAD.itemsize).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return head, wide.view("<u8").ravel()


class Windows:
    """Windows in order of their place, with what names each and where it stands."""

    def __init__(self, anchor, window, k1, k2, pos):
        self.anchor, self.window, self.k1, self.k2, self.pos = anchor, window, k1, k2, pos

    @classmethod
    def of(cls, head: np.ndarray, windows: np.ndarray) -> Windows:
        n = head["n"].astype(np.int64)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return cls(np.repeat(head["anchor"], n), windows, np.repeat(head["k1"], n), np.repeat(head["k2"], n), np.repeat(head["start"].astype(np.int64), n) + inner)

    def take(self, at) -> Windows:
        return Windows(self.anchor[at], self.window[at], self.k1[at], self.k2[at], self.pos[at])

    @staticmethod
    def join(parts: list[Windows]) -> Windows:
        return Windows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("anchor", "window", "k1", "k2", "pos")))

    def breaks(self, anchored: bool) -> np.ndarray:
        out = (self.k1[1:] != self.k1[:-1]) | (self.k2[1:] != self.k2[:-1]) | (self.pos[1:] != self.pos[:-1] + 1)
        return out | (self.anchor[1:] != self.anchor[:-1]) if anchored else out

    def resolve(self) -> tuple[np.ndarray, np.ndarray]:
        """(those known to repeat, those to keep: the first of each distinct window). Kept ones get the mark."""
        key = mix(self.anchor) ^ ((self.window & MASK) * ODD)
        order = np.argsort(key, kind="stable")
        k, a, w = key[order], self.anchor[order], self.window[order] & MASK
        first = np.ones(len(order), bool)
        first[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(first) - 1
        known = np.bincount(group) > 1
        known |= np.bincount(group, weights=(self.window[order] & np.uint64(1))) > 0
        repeated, keep = np.zeros(len(order), bool), np.zeros(len(order), bool)
        repeated[order], keep[order] = known[group], first
        self.window = (self.window & MASK) | repeated.astype(np.uint64)
        return repeated, keep

    def intervals(self, length: int) -> tuple[np.ndarray, ...]:
        """(k1, k2, first word, word after the last) of the runs of these windows."""
        first, n = _runs(self.breaks(False), len(self.pos))
        return self.k1[first], self.k2[first], self.pos[first], self.pos[first] + n + length - 1

    def packed(self, n_buckets: int, by_window: bool) -> list[tuple[int, bytes]]:
        if not len(self.pos):
            return []
        anchor = mix(self.anchor ^ (self.window & MASK)) if by_window else self.anchor
        moved = Windows(anchor, self.window, self.k1, self.k2, self.pos)
        first, n = _runs(moved.breaks(True), len(self.pos))
        head = np.zeros(len(first), HEAD)
        head["anchor"], head["k1"], head["k2"], head["start"], head["n"] = anchor[first], self.k1[first], self.k2[first], self.pos[first], n
        to = (mix(head["anchor"]) >> np.uint64(20)) % np.uint64(n_buckets)
        order = np.argsort(to, kind="stable")
        at = np.repeat(first[order], n[order]) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n[order]) - n[order], n[order])
        windows, to, head = self.window[at], to[order], head[order]
        cut = np.searchsorted(to, np.arange(n_buckets + 1, dtype=np.uint64))
        ends = np.concatenate([[0], np.cumsum(head["n"].astype(np.int64))])
        return [(b, _pack(head[s:e], windows[ends[s] : ends[e]])) for b, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if e > s]


def _batch(packed: list[tuple[int, bytes]], intervals: tuple[np.ndarray, ...] | None, n_buckets: int):
    import pyarrow as pa

    k1, k2, s, e = intervals if intervals is not None else (np.zeros(0, np.int64),) * 4
    n, m = len(packed), len(k1)
    null = lambda kind, x: pa.concat_arrays([pa.nulls(n, kind), pa.array(x).cast(kind)])
    bucket = np.concatenate([[b for b, _ in packed], (mix(k1.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)]) if n or m else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int32)), pa.array([p for _, p in packed] + [None] * m, pa.binary()), null(pa.int64(), k1), null(pa.int32(), k2), null(pa.int32(), s), null(pa.int32(), e)],
        ["bucket", "payload", "k1", "k2", "s", "e"],
    )


def seeds(keyed: DataFrame, length: int, gram: int, n_buckets: int, chunk: int) -> DataFrame:
    """Packed stretches of windows by anchor, and the intervals that a chunk has settled itself."""

    @thrifty
    def run(batches):
        held: list[Windows] = []

        def settled():
            here = Windows.join(held)
            repeated, keep = here.resolve()
            held.clear()
            return _batch(here.take(keep).packed(n_buckets, False), here.take(repeated).intervals(length), n_buckets)

        for batch in slices(batches, 2):
            k1, k2 = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            words = Words(utf8(batch.column(2)))
            window = words.grams(length)
            anchor = windowed_min(words.grams(gram), length - gram + 1)
            doc = words.docs()[: len(window)]
            at = np.flatnonzero(np.arange(len(window)) + length <= words.bounds[doc + 1])
            doc = doc[at]
            if len(at):
                held.append(Windows(anchor[at], window[at] & MASK, k1[doc], k2[doc], at - words.bounds[doc]))
            if sum(len(x.pos) for x in held) >= chunk:
                yield settled()
        if held:
            yield settled()

    return keyed.mapInArrow(run, ROUTED)


def extend(routed: DataFrame, length: int, n_buckets: int, limit: int, hot: int, last: bool) -> DataFrame:
    """Settle the buckets: intervals of the repeated windows, and what is dealt anew (none if `last`)."""

    @thrifty
    def run(batches):
        held: dict[int, list[Windows]] = {}
        size: dict[int, int] = {}
        ceiling: dict[int, int] = {}
        away: set[int] = set()

        def settle(b: int, final: bool):
            here = Windows.join(held[b])
            known = (here.window & np.uint64(1)).astype(bool)
            repeated, keep = here.resolve()
            new = repeated & ~known
            out = [_batch([], here.take(new).intervals(length), n_buckets)] if new.any() else []
            here = here.take(keep)
            if not final and not last and len(here.pos) * 40 > limit // 2:
                names, counts = np.unique(here.anchor, return_counts=True)
                away.update(names[counts > hot].tolist())
                go = np.isin(here.anchor, np.array(list(away), np.uint64))
                out.append(_batch(here.take(go).packed(n_buckets, True), None, n_buckets))
                here = here.take(~go)
            held[b], size[b] = [here], len(here.pos) * 40
            return out

        for batch in batches:
            rows = batch.filter(batch.column(1).is_valid())
            done = batch.filter(batch.column(1).is_null())
            if done.num_rows:
                yield done
            for b, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                here = Windows.of(*_unpack(data))
                if away:
                    go = np.isin(here.anchor, np.array(list(away), np.uint64))
                    if go.any():
                        yield _batch(here.take(go).packed(n_buckets, True), None, n_buckets)
                        here = here.take(~go)
                held.setdefault(b, []).append(here)
                size[b] = size.get(b, 0) + len(here.pos) * 40
                if size[b] > ceiling.get(b, limit):
                    yield from settle(b, False)
                    ceiling[b] = max(limit, 2 * size[b])
        for b in list(held):
            yield from settle(b, True)
            del held[b]

    return routed.repartition(n_buckets, "bucket").mapInArrow(run, ROUTED)


def repeats(docs: DataFrame, length: int, gram: int = 6, chunk: int = 300_000, limit: int = 32 << 20, hot: int = 20_000) -> DataFrame:
    """(_k1, _k2, spans: array of (s, e), word intervals that lie in repeated windows) for docs with _k1, _k2, text."""
    n = 4 * buckets(docs.sparkSession)  # a bucket is expanded whole when it is settled
    settled = save(extend(seeds(docs.select("_k1", "_k2", "text"), length, gram, n, chunk), length, n, limit, hot, False), "repeats")
    # anchors too frequent for one bucket: by single window
    again = extend(settled.where("payload is not null"), length, n, limit, hot, True)
    found = settled.where("payload is null").unionByName(again)
    return found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.struct("s", "e").alias("x")).groupBy("_k1", "_k2").agg(F.collect_list("x").alias("spans"))


def deduplicate_substrings(docs: DataFrame, length: int = 50, gram: int = 6, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """All columns of docs, with n_words, n_removed and kept: the text without its repeated windows of `length` words.

    A column of docs that has the name of one of these gives way; any other name passes through.
    """
    names = docs.columns
    # columns are known by their place, so that no name meets one used here
    held = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    own_id, own_text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    keyed = held.select("*", *row_key(own_id, own_text))
    spans = repeats(keyed.select("_k1", "_k2", F.col(own_text).alias("text")), length, gram, **sizes)
    joined = keyed.join(spans.hint("shuffle_hash"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
    at = joined.columns.index(own_text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "spans"]

    @thrifty
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, at):
            texts, spans = utf8(batch.column(at)), batch.column(batch.schema.get_field_index("spans")).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, own in zip(texts, spans):
                words = text.split()
                n_words.append(len(words))
                if own:
                    out = np.zeros(len(words) + 1, np.int32)
                    np.add.at(out, [x["s"] for x in own], 1)
                    np.add.at(out, [x["e"] for x in own], -1)
                    stays = np.cumsum(out[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            rest = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != "spans"]
            names = [f for f in batch.schema.names if f != "spans"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(run, ", ".join([*fields, "n_words bigint", "n_removed bigint", "kept string"]))
    made = ["n_words", "n_removed", "kept"]
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in made), *made)
