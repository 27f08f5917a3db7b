"""Helpers shared by the corpus operators: shared-folder tables, row keys, vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised code (one longer document is handled alone).
CHUNK_BYTES = 1 << 19
#: Powers kept between calls (16 bytes each); longer texts compute theirs anew.
KEPT_POWERS = 1 << 21

_made: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
        _kept.append((spark, found))
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, removed by release() or, if it is to be kept that long, at exit."""
    path = f"{shared_dir(spark)}/tallyspark/{uuid.uuid4().hex}-{tag}"
    (_kept if keep else _made).append((spark, path))
    return path


def local_path(uri: str) -> str | None:
    """The path of a file: URI; None for any other scheme."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, computes once, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def made_in(own: list):
    """Shared tables made in this context are noted in a list of the caller's, who may release() it."""
    global _made
    before, _made = _made, own
    try:
        yield own
    finally:
        _made = before


def release(made: list) -> None:
    """Delete the shared tables of a list; results that are not yet written must not depend on them."""
    while made:
        spark, path = made.pop()
        try:
            sc = spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            local = local_path(path)
            if local:
                shutil.rmtree(local, ignore_errors=True)


atexit.register(lambda made=_made: (release(made), release(_kept)))


def thrifty(run):
    """A function of batches whose worker process gives freed memory back when a task ends: it may serve others for long."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # no glibc
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def buckets(spark: SparkSession) -> int:
    """How many buckets to deal packed rows into; follows the cluster's spark.sql.shuffle.partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def row_key(*cols: str) -> list[Column]:
    """Two hashes that name a row by its values: the same on every recomputation, never null."""
    return [F.xxhash64(*cols).alias("_k1"), F.hash(*reversed(cols)).alias("_k2")]


ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
GRAM = np.uint64(0xAF251AF3B0F025B5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, min(n + n // 8, KEPT_POWERS), n)
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inv, np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= KEPT_POWERS:
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def separators(pattern: str) -> np.ndarray:
    """For each byte, whether it separates words. 'space': ASCII white space; 'alnum': all ASCII but digits and letters."""
    sep = np.zeros(256, bool)
    if pattern == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:0x80] = True
        sep[0x30:0x3A] = sep[0x41:0x5B] = sep[0x61:0x7B] = False
    return sep


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of some texts: byte spans, document bounds and one 64-bit hash a word."""

    def __init__(self, texts: list[bytes], pattern: str = "space", lower: bool = False, hashed: bool = True):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.buf = LOWER[raw] if lower else raw
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~separators(pattern)[raw]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        #: words of document i: bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, at)
        if hashed:
            sums = prefix_sums(self.buf.astype(np.uint64) + np.uint64(1), BASE)
            self.hash = mix((sums[self.ends] - sums[self.starts]) * powers(BASE, len(sums))[1][self.starts] + (self.ends - self.starts).astype(np.uint64) * ODD)

    def grams(self, k: int) -> np.ndarray:
        """The hash of words i to i+k-1 for every i; grams may reach into the next document (see valid)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = prefix_sums(self.hash, GRAM)
        return mix((sums[k:] - sums[:n]) * powers(GRAM, n)[1])

    def docs(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.starts)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about limit bytes, as (from, to)."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches, column: int, limit: int = CHUNK_BYTES):
    """The batches in slices of about `limit` bytes of a string column, so that few bytes are held decoded at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if pa.types.is_null(batch.column(column).type):
            yield batch
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def windowed_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values."""
    n, span = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    out = values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
