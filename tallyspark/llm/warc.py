"""WARC archives as dictionary-compressed Zstandard: writing, deduplicating and reading back.

An archive begins with a skippable frame that holds the Zstandard dictionary, built from a bounded sample of the
archive's own records; then every record is a frame of its own, compressed with that dictionary.

Records with equal payloads of at least `least` bytes: the one with the smallest id is a response, the others are
revisits that refer to it (rows that repeat that smallest id are responses too). The smallest id of each digest
comes from a group-by that combines before the shuffle; a hot digest is split by the adaptive join.
A task streams its rows: it holds the sample (`sample_bytes`) and one record. Archives go to the folder that the
cluster shares, under names of their own, and only those in the returned manifest count, so a task that runs twice
does no harm.

A null payload is empty; a null url is left out; a null id is written as "null" and read as null, and is never the
smallest unless all are null. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, shared_path, thrifty

MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
READ = 256 << 10


def open_shared(uri: str, write: bool = False):
    """A file in the shared folder, on a mounted or a remote file system."""
    local = local_path(uri)
    if local is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        return system.open_output_stream(path) if write else system.open_input_stream(path)
    if write:
        import os

        os.makedirs(os.path.dirname(local), exist_ok=True)
    return open(local, "wb" if write else "rb")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    named = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", named(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", named(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int):
    """A trained dictionary; of too few records to train on, one of their bytes as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Streams records into archives of at most about `roll` bytes."""

    def __init__(self, folder: str, sample_bytes: int, dict_size: int, level: int, roll: int):
        self.folder, self.sample_bytes, self.dict_size, self.level, self.roll = folder, sample_bytes, dict_size, level, roll
        self.made: list[tuple[str, int, int]] = []
        self._fresh()

    def _fresh(self):
        self.held, self.held_size, self.file, self.count, self.size = [], 0, None, 0, 0

    def add(self, data: bytes):
        self.count += 1
        if self.file is None:
            self.held.append(data)
            self.held_size += len(data)
            if self.held_size >= self.sample_bytes:
                self._begin()
        else:
            self._put(data)
            if self.size >= self.roll:
                self.close()

    def _begin(self):
        import zstandard

        trained = dictionary([x[: 64 << 10] for x in self.held], self.dict_size)
        raw = trained.as_bytes()
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.file = open_shared(self.path, write=True)
        self.file.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.size = 8 + len(raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained)
        for data in self.held:
            self._put(data)
        self.held = []

    def _put(self, data: bytes):
        frame = self.compressor.compress(data)
        self.file.write(frame)
        self.size += len(frame)

    def close(self):
        if self.count:
            if self.file is None:
                self._begin()
            self.file.close()
            self.made.append((self.path, self.count, self.size))
        self._fresh()


def write_archives(pages: DataFrame, folder: str, least: int = 0, sample_bytes: int = 1 << 20, dict_size: int = 64 << 10, level: int = 3, roll: int = 512 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows; returns the manifest (path, records, bytes), lazily."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    twice = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    met = rows.join(twice.withColumn("met", F.lit(True)).hint("shuffle_hash"), "sha", "left").select("page_id", "url", "payload", "first", F.expr("met is not null and not (page_id <=> first)").alias("revisit"))

    @thrifty
    def run(batches):
        import pyarrow as pa

        out = Writer(folder, sample_bytes, dict_size, level, roll)
        for batch in batches:
            payloads = batch.column(2)
            for i, (page, url, first, revisit) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                out.add(record(page, url, payloads[i].as_buffer().to_pybytes() if payloads[i].is_valid else b"", first, revisit))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in out.made], pa.string()), pa.array([m[1] for m in out.made], pa.int64()), pa.array([m[2] for m in out.made], pa.int64())], ["path", "records", "bytes"])

    return met.mapInArrow(run, "path string, records bigint, bytes bigint")


def frames(uri: str):
    """The records of an archive, one at a time."""
    import zstandard

    with open_shared(uri) as file:
        magic, n = struct.unpack("<II", file.read(8))
        if magic != MAGIC:
            raise ValueError(f"{uri}: no dictionary frame")
        raw = file.read(n)
        plain = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=plain))
        data = file.read(READ)
        while data:
            frame, parts = decompressor.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data or file.read(READ)
                    break
                data = file.read(READ)
                if not data:
                    raise ValueError(f"{uri}: the last record is cut short")
            yield b"".join(parts)


def parse(data: bytes) -> dict:
    """The headers of a record, with its HTTP block's header size, payload and stated payload size."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["stated"] = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    return fields


def read_archives(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload: null for revisits) of every record."""

    @thrifty
    def run(batches):
        import pyarrow as pa

        cast = (lambda x: None if x == "null" else int(x)) if id_type in ("bigint", "int") else (lambda x: None if x == "null" else x)
        kind = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
        kinds = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        named = lambda x: cast(x[len("<urn:x-page:") : -1])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for data in frames(uri):
                    r = parse(data)
                    revisit = r["WARC-Type"] == "revisit"
                    stated = r["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(r["payload"]) != stated:
                        raise ValueError(f"{uri}: a payload differs from its digest")
                    rows.append((named(r["WARC-Record-ID"]), r["stated"], stated, r["WARC-Type"], named(r["WARC-Refers-To"]) if revisit else None, r.get("WARC-Target-URI"), None if revisit else r["payload"].decode()))
                    size += len(data)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.mapInArrow(run, f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}, url string, payload string")


def archive_folder(spark) -> str:
    return shared_path(spark, "warc")


__all__ = ["write_archives", "read_archives", "archive_folder", "frames", "parse", "record", "Writer"]
