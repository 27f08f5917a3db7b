"""Perplexity by an interpolated modified Kneser-Ney model of any order from two (three unless told), counted in Spark.

The model is a set of tables of sorted hashes, one set a bucket, in the folder that the cluster shares. For every length
k from two to the order:
  gram{k}  hash of k tokens -> count (the longest, and those at a text's start), else kinds of token before them
  ctx{k}   hash of the first k-1 of them -> sum of those counts, and how many of them are one, two, more
  far{k}   the same, for contexts that end in a very frequent word
and uni: hash of a word -> count, and kinds of previous word. From k = 3 on, contexts whose sum is one are left out: they
are those that gram{k-1} has and ctx{k} has not. Workers map the files into memory and look up a slice of text at a time.

Counting is packed: a task merges the longest grams of its rows before it sends them, one binary row a bucket, dealt by
the word before the last. All shorter grams with their contexts end in that same word, so the task that has a bucket
settles every length. Words that a sample shows to be very frequent are dealt with the word after them instead; their
contexts are summed in a second such step, as are counts by word (the contexts that are such a word alone, at most
`hot`, by the driver). The sample also lends short names to its words for the way; it changes no count. Everything is
counted over all rows; nothing is pruned.

Tokens are white-space-separated words with A-Z in lower case, then one end token; a null text is empty and so has
just the end. Histories begin with one begin token; grams that begin with it keep their counts, as nothing precedes them.
Words not seen in training get the share that the model leaves to the uniform distribution. Without training rows every
token has probability 1 (V = 0). Other columns pass through.
"""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, Words, buckets, local_path, mix, save, shared_path, slices, thrifty, utf8
from .warc import open_shared

END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876000000)
#: Tokens two or more back are known by the upper 40 bits of their hash.
OLDER = np.uint64(0xFFFFFFFFFF000000)
PACKED = "kind string, bucket int, payload binary, numbers array<bigint>"
#: Bytes of tables that a worker keeps where the shared folder cannot be mapped.
KEPT_BYTES = 256 << 20


def tokens(texts: list[bytes], order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(items, bounds): a row for each of the order-1 previous tokens, the nearest last, then one for the tokens, ends included."""
    words = Words(texts, lower=True)
    bounds = np.concatenate([[0], np.cumsum(np.diff(words.bounds) + 1)])
    items = np.full((order, int(bounds[-1])), BEGIN, np.uint64)
    inside = np.ones(items.shape[1], bool)
    inside[bounds[1:] - 1] = False
    items[-1][inside], items[-1][~inside] = words.hash, END
    since = np.arange(items.shape[1]) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(1, order):
        at = np.flatnonzero(since >= back)
        items[-1 - back][at] = items[-1][at - back] & OLDER if back > 1 else items[-1][at - back]
    return items, bounds


def hashed(items: np.ndarray) -> np.ndarray:
    """One hash of each column of tokens."""
    key = items[-1]
    for item in items[-2::-1]:
        key = mix(item * ODD + key)
    return key


def proper(items: np.ndarray) -> np.ndarray:
    """Columns that are grams: only their first token may be the begin token."""
    return items[1] != BEGIN if len(items) > 2 else np.ones(items.shape[1], bool)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct keys in order, where one of each stands, the place of every key among them)."""
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(first) - 1
    return key[first], order[first], back


def merged(key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys in order, where one of each stands, and sums by key."""
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    return key[at], order[at], [np.add.reduceat(s[order], at) if len(at) else s for s in sums]


def _named(token: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into names, 65535 for others; the others)."""
    at = np.minimum(np.searchsorted(names, token), len(names) - 1)
    other = names[at] != token
    return np.where(other, 0xFFFF, at).astype("<u2"), token[other]


def _pack(items: np.ndarray, count: np.ndarray, names: np.ndarray) -> bytes:
    """Grams in order of the word before the last, which is sent once; counts as bytes, larger ones apart."""
    before = items[-2]
    first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    large = np.flatnonzero(count >= 255)
    code, other = _named(items[-1], names)
    parts = [before[first], np.diff(np.append(first, len(before))).astype("<u4"), code, other, np.minimum(count, 255).astype("u1"), large.astype("<u4"), count[large].astype("<u8")]
    for older in items[:-2]:
        code, other = _named(older, names & OLDER)
        parts += [code, (other >> np.uint64(32)).astype("<u4"), (other >> np.uint64(24)).astype("u1")]
    head = np.array([len(p) for p in parts], "<u4")
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


def _unpack(data: bytes, order: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = ["<u8", "<u4", "<u2", "<u8", "u1", "<u4", "<u8"] + ["<u2", "<u4", "u1"] * (order - 2)
    at, out = 4 * len(kinds), []
    for kind, length in zip(kinds, np.frombuffer(data, "<u4", len(kinds)).tolist()):
        out.append(np.frombuffer(data, kind, length, at))
        at += np.dtype(kind).itemsize * length

    def spelt(code, other, names):
        token = names[np.minimum(code, len(names) - 1)]
        token[code == 0xFFFF] = other
        return token

    count = out[4].astype(np.int64)
    count[out[5]] = out[6]
    older = [spelt(out[i], out[i + 1].astype(np.uint64) << np.uint64(32) | out[i + 2].astype(np.uint64) << np.uint64(24), names & OLDER) for i in range(7, len(out), 3)]
    return np.stack([*older, np.repeat(out[0], out[1]), spelt(out[2], out[3], names)]), count


def _rows(kind, bucket, payload, numbers):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), pa.array(numbers, pa.list_(pa.int64()))], ["kind", "bucket", "payload", "numbers"])


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _route(before: np.ndarray, pair: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(np.where(np.isin(before, hot), pair, before), n) if len(hot) else bucket_of(before, n)


def _dealt(to: np.ndarray, n: int):
    """(order, first) so that order[first[b]:first[b + 1]] are bucket b's rows, in their order."""
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(n + 1, dtype=to.dtype))


def _partials(kind: str, key: np.ndarray, sums: list[np.ndarray], n: int):
    """Sums by key that the second step adds up, a row a bucket; of keys whose sums are one, only the first two may be."""
    to = bucket_of(key, n)
    one = np.logical_and.reduce([s == (i < 2) for i, s in enumerate(sums)])
    some, data = [], []
    order, first = _dealt(to * np.uint64(2) + one, 2 * n)
    for b in range(n):
        several, single = order[first[2 * b] : first[2 * b + 1]], order[first[2 * b + 1] : first[2 * b + 2]]
        if len(several) + len(single):
            some.append(b)
            data.append(b"".join(x.astype("<u8").tobytes() for x in (np.array([len(several)]), key[several], *(s[several] for s in sums), key[single])))
    return _rows([kind] * len(some), some, data, [None] * len(some))


def _partial(data: bytes, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(data, "<u8")
    n = int(raw[0])
    several, single = raw[1 : 1 + n * (width + 1)].reshape(width + 1, n), raw[1 + n * (width + 1) :]
    return [np.concatenate([several[0], single]), *(np.concatenate([s.astype(np.int64), np.full(len(single), int(i < 2))]) for i, s in enumerate(several[1:]))]


class Table:
    """Sorted keys and the small numbers that belong to each.

    The first bits of a key say where to look (8 to 16 keys share them), the next 24 (if wide 48) are kept: of keys that it does not have
    a table of any size mistakes one in a million (if wide one in 10**13). Numbers are a byte that names one of the 255
    commonest, others stand apart.
    """

    @staticmethod
    def write(uri: str, key: np.ndarray, *columns: np.ndarray, wide: bool = False) -> None:
        """A task that runs twice puts the same bytes."""
        order = np.argsort(key)
        key, values = key[order], np.stack(columns)[:, order].astype(np.int64)
        m, n = values.shape
        bits = 16 // m
        small = (values < 1 << bits).all(axis=0)
        joined = sum(values[i] << bits * i for i in range(m)) & 0xFFFF
        often = np.bincount(joined[small], minlength=1 << 16)
        top = np.argsort(-often, kind="stable")[:255]
        top = top[often[top] > 0]
        codes = np.full(1 << 16, 255, np.uint8)
        codes[top] = np.arange(len(top))
        code = np.where(small, codes[joined], 255).astype(np.uint8)
        apart = np.flatnonzero(code == 255)
        book = np.stack([top >> bits * i & (1 << bits) - 1 for i in range(m)])
        lead = max(0, n.bit_length() - 4)
        place, rest = Table.split(key, lead, wide)
        start = np.searchsorted(place, np.arange((1 << lead) + 1, dtype=np.uint64))
        kinds = ("<u4", "<u2", 16) if wide else ("<u2", "u1", 8)
        parts = [np.array([m, n, len(top), len(apart), wide, lead], "<u8"), book.astype("<u8"), values[:, apart].astype("<u8"), apart.astype("<u4"), start.astype("<u4")]
        parts += [(rest >> np.uint64(kinds[2])).astype(kinds[0]), rest.astype(kinds[1]), code]
        local = local_path(uri)
        with open_shared(f"{uri}.{uuid.uuid4().hex}" if local else uri, write=True) as file:
            for a in parts:
                file.write(np.ascontiguousarray(a).tobytes())
        if local:
            os.replace(file.name, local)

    @staticmethod
    def split(key: np.ndarray, lead: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        return key >> np.uint64(63 - lead) >> np.uint64(1), key << np.uint64(lead) >> np.uint64(16 if wide else 40)

    def __init__(self, uri: str):
        """Mapped where the folder is mounted, else read."""
        local = local_path(uri)
        if local:
            raw = np.asarray(np.memmap(local, np.uint8, "r"))
        else:
            with open_shared(uri) as file:
                raw = np.frombuffer(file.read(), np.uint8)
        m, n, named, apart, wide, self.lead = raw[:48].view("<u8").tolist()
        at, out = 48, []
        for kind, length in (("<u8", m * named), ("<u8", m * apart), ("<u4", apart), ("<u4", (1 << self.lead) + 1), ("<u4" if wide else "<u2", n), ("<u2" if wide else "u1", n), ("u1", n)):
            width = np.dtype(kind).itemsize
            out.append(raw[at : at + length * width].view(kind))
            at += length * width
        self.book, self.values = out[0].reshape(m, named).astype(np.int64), out[1].reshape(m, apart)
        self.apart, self.start, self.high, self.low, self.code = out[2:]
        self.wide, self.bytes, self.mapped = bool(wide), len(raw), bool(local)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys it has, the numbers of those)."""
        place, rest = Table.split(key, self.lead, self.wide)
        shift = np.uint64(16 if self.wide else 8)
        at, end = self.start[place].astype(np.int64), self.start[place + np.uint64(1)].astype(np.int64)
        hit = np.zeros(len(key), bool)
        look = np.flatnonzero(at < end)
        while len(look):  # halve every key's range
            mid = at[look] + end[look] >> 1
            has = self.high[mid].astype(np.uint64) << shift | self.low[mid]
            less = has < rest[look]
            hit[look] |= has == rest[look]
            at[look] = np.where(less, mid + 1, at[look])
            end[look] = np.where(less, end[look], mid)
            look = look[at[look] < end[look]]
        at = at[hit]
        code = self.code[at]
        values = np.zeros((len(self.book), len(at)), np.int64)
        plain = code < 255
        values[:, plain] = self.book[:, code[plain]]
        values[:, ~plain] = self.values[:, np.searchsorted(self.apart, at[~plain])]
        return hit, values


def frequent(train: DataFrame, n_buckets: int, text_col: str, hot: int = 256, sample_rows: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Of a bounded sample's tokens: hashes of previous words that hold more than a bucket's share; of up to 65,535 that occur twice.

    This only chooses how words are dealt and spelt on the way, not what is counted.
    """
    rows = train.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    last = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    drawn = rows.where(F.col("h") <= F.lit(last)).limit(sample_rows).select(F.substring("t", 1, 20000).alias("t"))
    items = tokens([(r["t"] or "").encode() for r in drawn.toLocalIterator()])[0]
    word, count = np.unique(items[0], return_counts=True)
    often = np.argsort(-count, kind="stable")
    spread = [i for i in often[:hot] if count[i] * n_buckets > items.shape[1]]
    named = often[:0xFFFF]
    return np.sort(word[spread]), np.sort(np.append(word[named[count[named] > 1]][:0xFFFE], END))


def _held(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    items = np.concatenate([p[0] for p in parts], axis=1)
    _, at, (count,) = merged(hashed(items), np.concatenate([p[1] for p in parts]))
    return items[:, at], count


def count_grams(train: DataFrame, n: int, hot: np.ndarray, names: np.ndarray, folder: str, text_col: str, order: int, hold: int = 1_500_000) -> DataFrame:
    """Write gram and ctx tables; rows: counts of the tables ('made'), hot words' sums ('hot'), packed sums ('uni', 'far3' ...)."""
    shared = train.sparkSession.sparkContext.broadcast(names)

    @thrifty
    def send(batches):
        def out(held):
            items, count = _held([(x, np.ones(x.shape[1], np.int64)) for x in held])
            by_word = np.argsort(items[-2])
            items, count = items[:, by_word], count[by_word]
            rows, first = _dealt(_route(items[-2], hashed(items[-2:]), hot, n), n)
            some = [i for i in range(n) if first[i + 1] > first[i]]
            cut = [rows[first[i] : first[i + 1]] for i in some]
            return _rows(["gram"] * len(some), some, [_pack(items[:, at], count[at], shared.value) for at in cut], [None] * len(some))

        held, size = [], 0
        for batch in slices(batches, 0):
            held.append(tokens(utf8(batch.column(0)), order)[0])
            size += held[-1].shape[1]
            if size > hold:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def settled(b, items, raw):
        count, kinds = raw, []
        for k in range(order, 1, -1):
            at = np.flatnonzero(proper(items))
            own = count[at]
            Table.write(f"{folder}/gram{k}-{b}", hashed(items)[at], own)
            kinds += [len(at), *(int((own == i).sum()) for i in (1, 2, 3, 4))]
            key, one, sums = merged(hashed(items[:-1])[at], own, *((own == i).astype(np.int64) for i in (1, 2)), (own > 2).astype(np.int64))
            spread = np.isin(items[-2][at][one], hot)
            kept = ~spread & (sums[0] > (k > 2))
            Table.write(f"{folder}/ctx{k}-{b}", key[kept], *(s[kept] for s in sums))
            key, sums = key[spread], [s[spread] for s in sums]
            if k > 2:
                yield _partials(f"far{k}", key, sums, n)
                _, at, (raw, count) = merged(hashed(items[1:]), raw, np.ones(len(raw), np.int64))
                items = items[1:, at]
                count = np.where(items[0] == BEGIN, raw, count)
            else:
                yield _rows(["hot"] * len(key), [b] * len(key), [None] * len(key), [[int(x) for x in row] for row in zip(key.view(np.int64), *sums)])
        word, _, sums = merged(items[-1], raw, np.ones(len(raw), np.int64))
        yield _partials("uni", word, sums, n)
        yield _rows(["made"], [b], [None], [kinds])

    @thrifty
    def settle(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = held.setdefault(b, [])
                own.append(_unpack(data, order, shared.value))
                if sum(len(p[1]) for p in own[1:]) > len(own[0][1]) + (1 << 18):  # merge as they come, what is merged at most doubling
                    own[:] = [_held(own)]
        for b in list(held):
            yield from settled(b, *_held(held.pop(b)))

    return train.select(text_col).mapInArrow(send, PACKED).repartition(n, "bucket").mapInArrow(settle, PACKED)


def add_up(counted: DataFrame, n: int, folder: str) -> DataFrame:
    """Write uni and far tables; a row a table, of uni with kinds, tokens, continuations, and kinds with a continuation count of 1 to 4.
    The rows 'made' and 'hot' pass through."""

    def together(parts):
        key, _, sums = merged(*(np.concatenate(x) for x in zip(*parts)))
        return key, *sums

    @thrifty
    def settle(batches):
        import pyarrow as pa

        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            yield batch.filter(pa.array([k in ("made", "hot") for k in kinds], pa.bool_()))
            for kind, b, data in zip(kinds, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if data is None:
                    continue
                own = held.setdefault((kind, b), [])
                own.append(_partial(data, 2 if kind == "uni" else 4))
                if sum(len(p[0]) for p in own[1:]) > len(own[0][0]) + (1 << 18):
                    own[:] = [together(own)]
        for kind, b in list(held):
            key, *sums = together(held.pop((kind, b)))
            numbers = [len(key), int(sums[0].sum()), int(sums[1].sum()), *(int((sums[1] == i).sum()) for i in (1, 2, 3, 4))]
            kept = sums[0] > (kind != "uni")
            Table.write(f"{folder}/{kind}-{b}", key[kept], *(s[kept] for s in sums), wide=kind == "uni")
            yield _rows([kind], [b], [None], [numbers])

    return counted.repartition(n, "bucket").mapInArrow(settle, PACKED)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Chen and Goodman's D1, D2, D3+ (index 0 for a count of 0), each kept between 0 and its count."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(raw, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


class Model:
    """What the driver knows of a model; its tables stay in the folder."""

    def __init__(self, folder: str, n: int, order: int, hot: np.ndarray, hot_sums: np.ndarray, grams: list[int], words: list[int], made: dict[str, set[int]]):
        #: the buckets of which there are files, by kind
        self.made = made
        self.folder, self.n, self.order, self.hot, self.hot_sums = folder, n, order, hot, hot_sums
        self.kinds, self.tokens, self.continuations = words[0], words[1], words[2]
        #: by length; what is counted of the longest comes first
        self.discounts = {k: discounts(*grams[5 * (order - k) + 1 : 5 * (order - k) + 5]) for k in range(2, order + 1)} | {1: discounts(*words[3:7])}
        n1, n2 = words[3], words[4]
        left = self.discounts[1][1:] @ [n1, n2, words[0] - n1 - n2]
        #: the share of the uniform distribution over all kinds and the unknown word
        self.floor = left / self.continuations / (self.kinds + 1) if self.continuations else 1.0
        self._files: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_files": {}}

    def table(self, kind: str, b: int) -> Table | None:
        if (kind, b) not in self._files:
            # no file was made where no key fell into the bucket; a failed read of one that was fails the task
            found = Table(f"{self.folder}/{kind}-{b}") if b in self.made.get(kind, ()) else None
            if found and not found.mapped:  # held in memory: bounded, the oldest go
                size = found.bytes + sum(t.bytes for t in self._files.values() if t)
                for key in list(self._files):
                    if size <= KEPT_BYTES:
                        break
                    gone = self._files.pop(key)
                    size -= gone.bytes if gone else 0
            self._files[kind, b] = found
        return self._files[kind, b]

    def look_up(self, kind: str, width: int, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The numbers of some distinct keys in order; zeros where the table has none."""
        out = np.zeros((width, len(key)), np.int64)
        order, cut = _dealt(bucket.astype(np.uint16) if self.n < 1 << 16 else bucket, self.n)
        for b in range(self.n):
            at = order[cut[b] : cut[b + 1]]
            table = self.table(kind, b) if len(at) else None
            if table:
                hit, values = table.find(key[at])
                at = at[hit]
                for row, column in zip(out, values):
                    row[at] = column
        return out

    def contexts(self, items: np.ndarray) -> np.ndarray:
        """The sum, ones, twos and more of contexts, a column each."""
        k = len(items) + 1
        key, first, back = distinct(hashed(items))
        last = items[-1][first]
        spread = np.isin(last, self.hot)
        out = np.zeros((4, len(key)), np.int64)
        out[:, ~spread] = self.look_up(f"ctx{k}", 4, key[~spread], bucket_of(last[~spread], self.n))
        if k > 2:
            out[:, spread] = self.look_up(f"far{k}", 4, key[spread], bucket_of(key[spread], self.n))
        elif spread.any():
            out[:, spread] = self.hot_sums[np.searchsorted(self.hot, last[spread])].T
        return out[:, back]

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """For each text: n_tokens, n_known, base_score, score."""
        items, bounds = tokens(texts, self.order)
        if not self.tokens:
            zero = np.zeros(len(texts))
            return {"n_tokens": np.diff(bounds), "n_known": zero.astype(np.int64), "base_score": zero, "score": zero}
        words, _, word_at = distinct(items[-1])
        count, types = self.look_up("uni", 2, words, bucket_of(words, self.n))
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))
        p = (np.where(types > 0, (types - self.discounts[1][np.minimum(types, 3)]) / self.continuations, 0) + self.floor)[word_at]
        seen = None
        for k in range(2, self.order + 1):
            at = np.flatnonzero(proper(items[-k:]))
            if k > 2:  # a context that is no known gram was never followed
                at = at[seen[at - 1]]
            grams = items[-k:, at]
            key, first, back = distinct(hashed(grams))
            pair = grams[-2:, first]
            (c,) = self.look_up(f"gram{k}", 1, key, _route(pair[0], hashed(pair), self.hot, self.n))[:, back]
            total, *kinds = self.contexts(grams[:-1])
            if k > 2:  # and one without sums was followed once
                once = total == 0
                total[once] = kinds[0][once] = 1
            seen = np.zeros(items.shape[1], bool)
            seen[at] = c > 0
            d, lower = self.discounts[k], p[at]
            p[at] = np.where(total > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + (d[1:] @ kinds) * lower) / np.maximum(total, 1), lower)
        add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  no text is without a token
        return {"n_tokens": np.diff(bounds), "n_known": add((count > 0)[word_at].astype(np.int64)), "base_score": add(base[word_at]), "score": add(np.log10(p))}


def fit(train: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """Count a model over all rows of train."""
    if order < 2:
        raise ValueError("the order must be two or more")
    spark = train.sparkSession
    n = buckets(spark)
    folder = shared_path(spark, "ngrams")
    hot, names = frequent(train, n, text_col)
    counted = save(add_up(count_grams(train, n, hot, names, folder, text_col, order), n, folder), "counts")
    # a row a table, and one a hot word
    of_grams, of_sums = counted.where("kind = 'made'").select("bucket", "numbers").collect(), counted.where("kind not in ('made', 'hot')").select("kind", "bucket", "numbers").collect()
    grams = np.array([r["numbers"] for r in of_grams] or [[0] * 5 * (order - 1)]).sum(axis=0)
    words = np.array([r["numbers"] for r in of_sums if r["kind"] == "uni"] or [[0] * 7]).sum(axis=0)
    made = {f"{kind}{k}": {r["bucket"] for r in of_grams} for kind in ("gram", "ctx") for k in range(2, order + 1)}
    for r in of_sums:
        made.setdefault(r["kind"], set()).add(r["bucket"])
    sums = np.zeros((len(hot), 4), np.int64)
    parts = counted.where("kind = 'hot'").select(F.col("numbers")[0].alias("v"), *(F.col("numbers")[i].alias(f"x{i}") for i in range(1, 5)))
    for r in parts.groupBy("v").agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(1, 5))).collect():
        sums[np.searchsorted(hot, np.array([r["v"]]).view(np.uint64)[0])] = r[1:5]
    return Model(folder, n, order, hot, sums, grams.tolist(), words.tolist(), made)


def perplexity(score: float, n: int) -> float:
    return math.pow(10, -score / n) if n else 1.0


def score_texts(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities). A kept
    column of such a name gives way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"n_tokens", "n_known", "train_tokens", "base_score", "score", "_text"}]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @thrifty
    def run(batches):
        import pyarrow as pa

        model = held.value
        for batch in slices(batches, len(keep), 7 << 18):
            if not batch.num_rows:
                continue
            got = model.score(utf8(batch.column(len(keep))))
            out = [*(batch.column(i) for i in range(len(keep))), pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array(np.full(batch.num_rows, model.tokens), pa.int64()), pa.array(got["base_score"]), pa.array(got["score"])]
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_tokens bigint", "n_known bigint", "train_tokens bigint", "base_score double", "score double"])
    return rows.mapInArrow(run, schema)
