"""SimHash near-duplicates: deletion-variant signatures of fingerprint segments, equality join, verification.

A fingerprint is cut into `blocks` blocks, and every blocks - k + 1 of them make a segment; of two fingerprints at
most k bits apart some segment then differs by at most one bit. (With k = 4 and five blocks: ten segments of two
blocks, 26 bits; fewer blocks make shorter segments, on which unlike fingerprints meet by chance more often.)
Each segment yields one signature per bit, with that bit a wildcard; fingerprints that agree on a segment up to one
bit share a signature. Rows with one signature meet, and are verified by their differing bits.

No pairs are made: those that meet are searched breadth-first among the ones not reached yet, and each reached one
is linked to the least fingerprint of its connected part, so n that meet yield fewer than n links and lose no
connection; a bucket joins the links of all its variants into one such forest before it sends them. Exact copies
share a fingerprint and count once from the start. Fingerprints travel packed, a binary row a bucket, to the buckets
of either half of each segment: the half without the wildcard is the same in all fingerprints that share a signature.

A null or empty text, or one with no words, has fingerprint zero, linked like any other. Repeated rows are
separate rows of one component; a null id never is the least. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buckets, chunks, mix, save, slices, thrifty, utf8
from .components import components, forest


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 with seed 42 of each of a text's lower-cased word shingles, in their order; one of all words if they are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = text.translate(LOWER.tobytes()).split()
    flat = b" ".join(tokens)
    if len(tokens) <= shingle:
        return [digest(flat, 42)] if tokens else []
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    return [digest(flat[s:e], 42) for s, e in zip(begins.tolist(), ends[shingle - 1 :].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits that more than half of each run of hashes (rows of words) have set; runs follow each other, none is empty.

    Votes are counted for 64 bits at once: a plane holds one binary digit of every bit's count, and full adders turn
    three words of a plane into one, with a carry to the next plane, until each run has one word a plane.
    """
    runs, digits = np.arange(len(sizes)), []
    rows, counts = hashes, sizes
    while len(rows):
        carried = []
        while (counts > 1).any():
            # runs are filled up with zeros to groups of three
            groups = -(-counts // 3)
            full = np.zeros((3 * int(groups.sum()), rows.shape[1]), np.uint64)
            full[np.arange(len(rows)) + np.repeat(3 * (np.cumsum(groups) - groups) - np.cumsum(counts) + counts, counts)] = rows
            a, b, c = full[0::3], full[1::3], full[2::3]
            odd = a ^ b
            many = np.repeat(counts > 1, groups)
            carried.append((np.repeat(runs, groups)[many], ((a & b) | (c & odd))[many]))
            rows, counts = odd ^ c, groups
        plane = np.zeros((len(sizes), hashes.shape[1]), np.uint64)
        plane[counts == 1] = rows
        digits.append(plane)
        if not carried:
            break
        who = np.concatenate([x[0] for x in carried])
        order = np.argsort(who, kind="stable")
        rows, counts = np.concatenate([x[1] for x in carried])[order], np.bincount(who, minlength=len(sizes))
    # count > size // 2, from the highest digit down
    half = (sizes // 2).astype(np.uint64)
    more, same = np.zeros((len(sizes), hashes.shape[1]), np.uint64), np.full((len(sizes), hashes.shape[1]), np.uint64(2**64 - 1))
    for i in range(max(len(digits), int(half.max()).bit_length() if len(half) else 0) - 1, -1, -1):
        bit = np.where((half >> np.uint64(i)) & np.uint64(1), np.uint64(2**64 - 1), np.uint64(0))[:, None]
        digit = digits[i] if i < len(digits) else np.zeros_like(more)
        more |= same & digit & ~bit
        same &= ~(digit ^ bit)
    return more


def fingerprint_texts(texts: list[bytes], shingle: int) -> np.ndarray:
    """SimHash of each text's lower-cased word shingles (repeats count): 64 bits."""
    out = np.zeros(len(texts), np.uint64)
    hashes, sizes, at = [], [], []

    def flush():
        if hashes:
            out[at] = majority(np.array(hashes, "<u8")[:, None], np.array(sizes))[:, 0]
        hashes.clear(), sizes.clear(), at.clear()

    for i, text in enumerate(texts):
        own = shingle_hashes(text, shingle)
        if not own:
            continue
        hashes += own
        sizes.append(len(own))
        at.append(i)
        if len(hashes) > 200_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed 64-bit integer) for every row."""

    @thrifty
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            texts = utf8(batch.column(1))
            fp = np.concatenate([fingerprint_texts(texts[a:b], shingle) for a, b in chunks(texts)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


def segments(k: int, blocks: int) -> list[list[tuple[int, int]]]:
    """The segments, each a few blocks as (low bit, width): k differing bits leave one with at most one of them."""
    pick = blocks - k + 1
    if pick < 1:
        raise ValueError("k differing bits need at least k blocks")
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [[(cut[i], cut[i + 1] - cut[i]) for i in chosen] for chosen in combinations(range(blocks), pick)]


def variants(k: int, blocks: int) -> list[int]:
    """The masks of all signatures: a segment's bits, less one wildcard."""
    out = []
    for segment in segments(k, blocks):
        bits = [low + i for low, width in segment for i in range(width)]
        whole = sum(1 << b for b in bits)
        out += [whole & ~(1 << b) for b in bits]
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; rows of several words are a name, which is not compared, and the words to compare."""
    return np.bitwise_count(a ^ b) if a.ndim == 1 else np.bitwise_count(a[:, 1:] ^ b[..., 1:]).sum(axis=1)


def names(fp: np.ndarray) -> np.ndarray:
    return fp if fp.ndim == 1 else fp[:, 0]


def bucket_links(fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of one bucket that some other can reach by steps of at most k bits, and the least of each such part."""
    left, node, root = fp[np.unique(names(fp), return_index=True)[1]], [], []
    while len(left) > 1:
        pivot, left = left[0], left[1:]
        front = [pivot]
        while front and len(left):
            near = apart(left, front.pop()) <= k
            if near.any():
                got = left[near]
                left = left[~near]
                front += list(got)
                node.append(names(got))
                root.append(np.full(len(got), pivot if fp.ndim == 1 else pivot[0], np.uint64))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return cat(node), cat(root)


def meet(sig: np.ndarray, fp: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links among the fingerprints that share a signature: the equality join, each bucket then verified."""
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    edge = np.flatnonzero(sig[1:] != sig[:-1]) + 1
    begins, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
    size = ends - begins
    two = begins[size == 2]  # nearly all buckets that are not single
    a, b = fp[order[two]], fp[order[two + 1]]
    near = apart(a, b) <= k
    a, b = names(a[near]), names(b[near])
    nodes, roots = [np.maximum(a, b)], [np.minimum(a, b)]
    for s, e in zip(begins[size > 2].tolist(), ends[size > 2].tolist()):
        a, b = bucket_links(fp[order[s:e]], k)
        nodes.append(a)
        roots.append(b)
    return nodes, roots


def halves(bits: list[int]) -> list[tuple[int, list[int]]]:
    """A segment's bits as (mask of one half, single-bit masks of the other), both ways round.

    The signatures whose wildcard lies in one half all hold the other half whole, so it decides where they meet, and a
    fingerprint travels twice a segment, not once a wildcard.
    """
    cut = len(bits) // 2
    return [(sum(1 << b for b in whole), [1 << b for b in other]) for whole, other in ((bits[:cut], bits[cut:]), (bits[cut:], bits[:cut]))]


def packed_join(rows: DataFrame, columns: int, keys: list[tuple[int, list[int]]], sign, rejoin, near: int, words: int = 1) -> DataFrame:
    """Equality join of signatures: links (a, b) of fingerprints that share one and are at most `near` bits apart.

    sign(columns of a batch) gives the fingerprints and, for each of the keys (see halves), their segments. rejoin(fp, v)
    gives key v's segments from the fingerprints alone; where that is None, segments (then at most 24 bits) travel too.
    With words > 1 a fingerprint is a row of so many: its name and the words whose bits are compared.
    """
    n, n_keys = buckets(rows.sparkSession), len(keys)

    @thrifty
    def send(batches):
        import pyarrow as pa

        for batch in batches:
            fp, signed = sign([batch.column(i) for i in range(columns)])
            parts: list[list[bytes]] = [[] for _ in range(n)]
            marks: list[list[bytes]] = [[] for _ in range(n)]
            counts = np.zeros((n, n_keys), "<u4")
            for v, segment in enumerate(signed):
                to = (mix((segment & np.uint64(keys[v][0])) + np.uint64((v + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(16)) % np.uint64(n)
                order = np.argsort(to, kind="stable")
                counts[:, v] = np.bincount(to.astype(np.int64), minlength=n)
                at, fps = 0, fp[order]
                low = None if rejoin else np.ascontiguousarray(segment[order].view(np.uint8).reshape(-1, 8)[:, :3])
                for b, c in enumerate(counts[:, v].tolist()):
                    if c:
                        parts[b].append(fps[at : at + c].tobytes())
                        if low is not None:
                            marks[b].append(low[at : at + c].tobytes())
                        at += c
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([counts[b].tobytes() + b"".join(parts[b]) + b"".join(marks[b]) for b in range(n)], pa.binary())], ["bucket", "payload"])

    @thrifty
    def settle(batches):
        import pyarrow as pa

        held: dict[int, list[list[tuple]]] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(data, "<u4", n_keys).astype(np.int64)
                ends = np.cumsum(counts)
                fp = np.frombuffer(data, "<u8", words * int(ends[-1]), 4 * n_keys)
                fp = fp if words == 1 else fp.reshape(-1, words)
                low = None if rejoin else np.frombuffer(data, np.uint8, 3 * len(fp), 4 * n_keys + 8 * fp.size).reshape(-1, 3)
                own = held.setdefault(b, [[] for _ in range(n_keys)])
                for v in np.flatnonzero(counts).tolist():
                    s, e = ends[v] - counts[v], ends[v]
                    own[v].append((fp[s:e], None if low is None else low[s:e]))
        for own in held.values():
            nodes, roots = [], []
            for v, parts in enumerate(own):
                if parts:
                    fp = np.concatenate([x[0] for x in parts])
                    if rejoin:
                        segment = rejoin(fp, v)
                    else:
                        wide = np.zeros((len(fp), 4), np.uint8)
                        wide[:, :3] = np.concatenate([x[1] for x in parts])
                        segment = wide.view("<u4").ravel()
                    for bit in keys[v][1]:
                        a, b = meet(segment & ~segment.dtype.type(bit), fp, near)
                        nodes += a
                        roots += b
                    # one forest for all that has met so far
                    node, root = forest(np.concatenate(nodes), np.concatenate(roots))
                    nodes, roots = [node], [root]
            if nodes and len(nodes[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)) for x in (nodes, roots)], ["a", "b"])

    sent = rows.repartition(n, rows.columns[0]).mapInArrow(send, "bucket int, payload binary")
    return sent.repartition(n, "bucket").mapInArrow(settle, "a bigint, b bigint").where("a <> b").distinct()


def links(fps: DataFrame, k: int = 4, blocks: int = 5) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of distinct fingerprints at most k bits apart."""
    bits = [[low + i for low, width in segment for i in range(width)] for segment in segments(k, blocks)]
    keys = [key for own in bits for key in halves(own)]
    masks = [sum(1 << b for b in own) for own in bits]

    def rejoin(fp, v):
        return fp & np.uint64(masks[v // 2])

    def sign(columns):
        fp = columns[0].to_numpy(zero_copy_only=False).view(np.uint64)
        return fp, (rejoin(fp, v) for v in range(len(keys)))

    return packed_join(fps.select("fp"), 1, keys, sign, rejoin, k)


def near_duplicates(docs: DataFrame, shingle: int = 5, k: int = 4, blocks: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the least doc_id reachable by fingerprints at most k bits apart)."""
    prints = save(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(first, k, blocks))
    # least doc_id of each component, then of each fingerprint
    rooted = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
