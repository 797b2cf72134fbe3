"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some consecutive records, and a footer: a skippable
frame with the seek table (compressed and decompressed size of every frame) of the published seekable format, so
any Zstandard reader can read the whole file and a seeking reader needs the footer alone. The index maps each
record to its bundle, frame, and place and length in the decompressed frame.

Of the pages with equal payloads of at least `MIN_REVISIT` bytes the one with the smallest key is a response; the
others are revisit records that refer to it and have no payload.

Null payloads are empty. Rows with a null key are responses of their own and are not referred to. Rows that repeat
the smallest key are all responses. Extra columns are ignored; an empty table makes no bundle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from . import files
from .exprs import shared_folder, stored

MIN_REVISIT = 100
#: Decompressed bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
LEVEL = 3

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
EPOCH = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fields of this library: which row a record is, and the size of the full payload.
KEY, SIZE = "X-Record-Key", "X-Payload-Bytes"


def urn(key) -> str:
    return f"<urn:record:{key}>"


def record(key, url: str | None, payload: bytes, size: int, digest: str, refers: object | None) -> bytes:
    """One WARC record: a revisit if refers is given, else a response."""
    block = HTTP + (b"" if refers is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {EPOCH}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"{KEY}: {'' if key is None else key}", f"{SIZE}: {size}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block[len(HTTP):]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """A bundle opened for reading; frames are decompressed when asked for."""

    def __init__(self, folder: str, name: str):
        self.file = files.opened(folder, name)
        size = self.file.size() if callable(self.file.size) else self.file.size
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{name} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        sizes = struct.unpack(f"<{2 * n}I", self.file.read(8 * n))
        self.frames, at = [], 0
        for c, d in zip(sizes[::2], sizes[1::2]):
            self.frames.append((at, c, d))
            at += c

    def frame(self, i: int) -> bytes:
        import zstandard

        at, c, d = self.frames[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(c), max_output_size=d)


class _Writer:
    """Bundles of one task; finished(name) rows come out of add and close."""

    def __init__(self, folder: str, part: int):
        import zstandard

        self.folder, self.part, self.zstd = folder, part, zstandard.ZstdCompressor(level=LEVEL)
        self.sink, self.name, self.frames, self.size, self.held, self.at = None, None, [], 0, [], 0

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        """(bundle, frame, offset, length) of the record."""
        if self.sink is None:
            self.name = files.fresh("bundle", self.part, "warc.zst")
            self.sink, self.frames, self.size = files.create(self.folder, self.name), [], 0
        where = self.name, len(self.frames), self.at, len(data)
        self.held.append(data)
        self.at += len(data)
        if self.at >= FRAME_BYTES:
            self.flush()
            if self.size >= BUNDLE_BYTES:
                self.close()
        return where

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.at))
            self.size += len(packed)
            self.held, self.at = [], 0

    def close(self) -> None:
        if self.sink is not None:
            self.flush()
            self.sink.write(seek_table(self.frames))
            self.sink.close()
            self.sink = None


@dataclass
class Bundles:
    """What `write` made: the folder and the index (key, bundle, frame, offset, length)."""

    folder: str
    index: DataFrame
    key_type: str


def with_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """key, url columns of pages with body, size, digest and refers (null for responses)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    slim = pages.select(F.col(key).alias("_k"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_size"))
    first = slim.where((F.col("_size") >= MIN_REVISIT) & F.col("_k").isNotNull()).groupBy("_digest").agg(F.min("_k").alias("_first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").select("_digest", "_first")
    out = pages.select("*", body.alias("_body")).withColumn("_own", F.sha2("_body", 256))
    out = out.join(first, F.col("_own") == F.col("_digest"), "left")
    return out.withColumn("_refers", F.when(F.col(key) != F.col("_first"), F.col("_first")))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> Bundles:
    """A record for every row of pages, in bundles below folder."""
    kind = pages.schema[key].dataType.simpleString()
    rows = with_revisits(pages.select(*dict.fromkeys([key, url, payload])), key, payload).select(F.col(key).alias("key"), F.col(url).alias("url"), F.col("_body").alias("body"),
                                                     F.col("_own").alias("digest"), F.col("_refers").alias("refers"))

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        w = _Writer(folder, TaskContext.get().partitionId())
        for b in batches:
            where = []
            for i in range(b.num_rows):
                k, u, body, digest, refers = (b.column(j)[i].as_py() for j in range(5))
                where.append(w.add(record(k, u, body, len(body), digest, refers)))
            cols = list(zip(*where)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                             names=["key", "bundle", "frame", "offset", "length"])
        w.close()

    index = stored(rows.mapInArrow(part, f"key {kind}, bundle string, frame long, offset long, length long"), "warc-index")
    return Bundles(folder, index, kind)


def read(made: Bundles) -> DataFrame:
    """Every record, read from the bundles by the index: key, payload, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has no payload; bytes and digest are those of the full payload, recomputed for responses.
    """
    folder, kind = made.folder, made.key_type
    frames = made.index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))  # a frame's records are bounded
    spark = frames.sparkSession
    frames = frames.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # few rows, much to read
    number = kind in ("bigint", "int", "smallint", "tinyint")

    def part(batches: Iterator) -> Iterator:
        import hashlib
        from functools import lru_cache

        import pyarrow as pa

        opened = lru_cache(maxsize=16)(lambda name: Bundle(folder, name))
        value = (lambda x: int(x)) if number else (lambda x: x)
        for b in batches:
            for row in range(b.num_rows):
                name, frame, records = (b.column(j)[row].as_py() for j in range(3))
                data, out = opened(name).frame(frame), []
                for r in records:
                    fields, payload = parse(data[r["offset"]:r["offset"] + r["length"]])
                    response = fields["WARC-Type"] == "response"
                    size, digest = int(fields[SIZE]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if response:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    refers = fields.get("WARC-Refers-To", "")[len("<urn:record:"):-1]
                    out.append((value(k) if (k := fields[KEY]) else None, payload if response else None, size, digest,
                                fields["WARC-Type"], value(refers) if refers else None))
                cols = list(zip(*out))
                keys = pa.int64() if number else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], keys), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
                                                  pa.array(cols[4], pa.string()), pa.array(cols[5], keys)],
                                                 names=["key", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    kind = "long" if number else "string"
    return frames.mapInArrow(part, f"key {kind}, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def fetch(made: Bundles, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: fields and payload. Only its frame is decompressed."""
    return parse(Bundle(made.folder, bundle).frame(frame)[offset:offset + length])


def written(pages: DataFrame, **options) -> Bundles:
    """`write` to a fresh shared folder."""
    return write(pages, shared_folder(pages.sparkSession, "warc"), **options)
