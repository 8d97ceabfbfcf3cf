"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide, without row filters, so the samples are the payload's
bytes. Each task streams the images of its rows into one tar file in the shared folder, leaving out digests that the file
has already; payloads aren't shuffled. The index table has digest, shard, offset and length, with one address for each
digest: where several shards hold it, the first one. Metadata columns come from range reads of the first 33 bytes of an image; features come from full range reads. Rows
meet the index by digest in a join that keeps a digest with many rows in place.

Files are named at random, so a repeated or speculative task never overwrites another's shard; the written index refers
to the files of the attempts that were committed. The shared folder is reached through pyarrow's filesystems.

Defined results: a null or empty text is 64 zero bytes (n_bytes 0); repeated rows and equal texts give equal values and one
address; texts of any length are one payload; an empty table gives an empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, skew_join, written

UNIT = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
MEDIA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: Column) -> Column:
    """A text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64."""
    raw = F.coalesce(text.cast("binary"), F.unhex(F.lit("")))
    n = F.octet_length(raw)
    fill = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), fill)))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    body = np.zeros((len(rows), UNIT + 1), np.uint8)
    body[:, 1:] = rows
    size = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", size) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def image_header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from an image's first 33 bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", first[16:25])


def decode_image(image: bytes) -> bytes:
    width, height, _ = image_header(image)
    data, at = [], 8
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters aren't used in this store")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, sign changes around the mean, and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    high = x > x.mean()
    bins = np.bincount(x >> 4, minlength=16)
    return f"n={len(x)};mean={x.mean():.6f};std={x.std():.6f};turns={int((high[1:] != high[:-1]).sum())};hist={','.join(map(str, bins))}"


def store(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The index (digest, shard, offset, length) of the distinct values of a binary column, after writing their shards."""
    root = new_path(payloads.sparkSession, "media")

    def shard(batches):
        place, seen, out, at = None, set(), None, 0
        for b in batches:
            if out is None:
                system, folder = fs.FileSystem.from_uri(root)
                system.create_dir(folder, recursive=True)
                place = f"{uuid.uuid4().hex}.tar"
                out = system.open_output_stream(f"{folder}/{place}")
            rows = []
            for x in b.column(0):
                raw = x.as_py()
                digest = hashlib.sha256(raw).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                image = encode_image(raw)
                info = tarfile.TarInfo(f"{digest.hex()}.png")
                info.size = len(image)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                rows.append((digest, at + len(head), len(image)))
                at += out.write(head + image + bytes(-len(image) % 512))
            kinds = (pa.binary(), pa.int64(), pa.int64())
            digests, offsets, lengths = (pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([digests, pa.array([place] * len(rows), pa.string()), offsets, lengths], ["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    index = written(payloads.select(F.col(column)).mapInArrow(shard, "digest binary, shard string, offset long, length long"), "media-index")
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("x")).select("digest", "x.*")
    return first.withColumn("shard", F.concat(F.lit(root + "/"), "shard"))


def _ranges(index: DataFrame, read, schema: str, length: int | None = None) -> DataFrame:
    """Rows of index with the columns that read() makes of each image's bytes, or of its first ``length`` ones."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = index.columns

    def run(batches):
        name, source = None, None
        for b in batches:
            values = []
            for shard, offset, size in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    system, path = fs.FileSystem.from_uri(shard)
                    name, source = shard, system.open_input_file(path)
                source.seek(offset)
                values.append(read(source.read(length or size)))
            more = [pa.array([v[i] for v in values], pa.string() if s.endswith("string") else pa.int64()) for i, s in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*columns, *names])

    full = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema), schema])
    return index.mapInArrow(run, full)


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and bits, from header-only range reads."""
    return _ranges(index, image_header, "width long, height long, bits long", HEADER)


def contents(index: DataFrame) -> DataFrame:
    """The index with what full range reads give: sizes, digests and features of the stored bytes."""

    def read(image: bytes):
        payload = decode_image(image)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)

    return _ranges(index, read, MEDIA)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows with digest, shard, offset and length, metadata columns and features."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = store(docs.select(padded(F.col("text")).alias("payload"))).repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    filled = written(contents(metadata(index)), "media-columns")
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.unhex(F.sha2(padded(F.col("text")), 256)).alias("digest"))
    return skew_join(written(rows, "media-rows"), filled, ["digest"], "inner")


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", *(x.split()[0] for x in MEDIA.split(", ")), "width", "height", "bits", "shard", "offset", "length")
