"""Operator 9: media columns. Payloads lie in content-addressed tar shards; rows carry digest, offset and length.

A payload of 8-bit samples is stored losslessly as a grey PNG of 576 columns. Digests of all payloads are gathered first, and
of equal ones one row's is stored: a payload lies in one shard, once, and every row that carries it points there. Every
task writes tar shards of its own under a unique name in the shared folder, so a retried task leaves an orphan and never a
torn shard; where members lie is written to a table once, and what is asked of it later writes no shard again.
Metadata columns come from range reads of the header alone; features from reading the whole member back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import shared_dir, small, store

COLUMNS = 576
#: A shard is closed at so many bytes, or when so many rows wait for it.
SHARD_BYTES, SHARD_ROWS = 64 << 20, 100_000
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of a PNG up to the end of its IHDR chunk.
HEADER = 33


def encode_png(payload: bytes, columns: int = COLUMNS) -> bytes:
    """A grey 8-bit PNG; the payload's length must be a positive multiple of columns."""
    rows = len(payload) // columns
    lines = np.zeros((rows, columns + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, columns)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Columns, rows and bits of the first 33 bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    columns, rows, _ = png_header(data)
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, columns + 1)
    return lines[:, 1:].tobytes()


def pad(data: bytes, unit: int = COLUMNS) -> bytes:
    return data + b"\xff" * (-len(data) % unit or (0 if data else unit))


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit average hash over 64 equal runs."""
    samples = np.frombuffer(payload, np.uint8)
    total = int(samples.sum(dtype=np.int64))
    square = int(np.square(samples, dtype=np.int64).sum())
    n = len(samples)
    edges = np.arange(65) * n // 64
    sums = np.add.reduceat(samples, edges[:-1], dtype=np.int64)
    bits = (sums * n >= total * np.diff(edges)).astype(np.uint8)
    return f"mean={total / n:.4f};var={(square - total * total / n) / n:.4f};ahash={np.packbits(bits).tobytes().hex()}"


def _store(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def write_media(rows: DataFrame, folder: str, payload: str = "payload", key: str = "doc_id", size: str = "n_bytes", carry: str | None = None) -> DataFrame:
    """key, size, shard (a URI), digest (SHA-256 of the stored form), offset, length, columns, rows, bits, and the binary column to carry.

    The result is lazy: each action writes shards of its own, so store it before it is used more than once.

    payload: bytes, a positive multiple of 576 long (others raise); size: its length before padding. Rows keep their number, repeated ones share
    a member of their shard. columns, rows and bits are read from the stored header alone.
    """

    def write(batches):
        out, tar, sink, seen, path = [], None, None, {}, None

        def close():
            nonlocal tar, sink, seen, out
            sink.write(b"\0" * 1024)
            sink.close()
            system, at = _store(path)
            with system.open_input_file(at) as f:
                heads = {d: png_header(f.read_at(HEADER, o)) for d, (o, _) in seen.items()}
            done = [(k, n, path, d, *seen[d], *heads[d], more) for k, n, d, more in out]
            tar, sink, seen, out = None, None, {}, []
            names = ["key", "size", "shard", "digest", "offset", "length", "columns", "rows", "bits", "carried"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), KINDS)], names)

        for batch in batches:
            for k, n, data, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if sink is None:
                    path, at = f"{folder}/{uuid.uuid4().hex}.tar", 0
                    system, inner = _store(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = system.open_output_stream(inner)
                stored = encode_png(data.as_py())
                digest = hashlib.sha256(stored).hexdigest()
                if digest not in seen:
                    info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                    info.size = len(stored)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    sink.write(head + stored + b"\0" * (-len(stored) % 512))
                    seen[digest] = (at + len(head), len(stored))
                    at += len(head) + len(stored) + -len(stored) % 512
                out.append((k, n, digest, more))
                if at >= SHARD_BYTES or len(out) >= SHARD_ROWS:
                    yield close()
        if out:
            yield close()

    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    found = rows.select(F.col(key).cast("bigint").alias("key"), F.col(size).cast("bigint").alias("size"), F.col(payload).alias("payload"), (F.col(carry) if carry else F.lit(None).cast("binary")).alias("carried"))
    schema = "key bigint, size bigint, shard string, digest string, offset bigint, length bigint, columns int, rows int, bits int, carried binary"
    out = found.mapInArrow(write, schema).withColumnsRenamed({"key": key, "size": size})
    return out.withColumnRenamed("carried", carry) if carry else out.drop("carried")


def read_media(rows: DataFrame) -> DataFrame:
    """Adds what the stored bytes say: media_sha256, payload_bytes, payload_sha256, tail_crc32, feature.

    The stored digest is checked against the bytes. Rows of one shard keep its file open; equal members are read once
    a run of rows.
    """
    names = rows.columns

    def read(batches):
        for batch in batches:
            table = batch.to_pydict()
            files, known, out = {}, {}, []
            for shard, digest, offset, length in zip(table["shard"], table["digest"], table["offset"], table["length"]):
                if (shard, digest) not in known:
                    if shard not in files:
                        system, at = _store(shard)
                        files[shard] = system.open_input_file(at)
                    data = files[shard].read_at(length, offset)
                    if hashlib.sha256(data).hexdigest() != digest:
                        raise ValueError(f"{shard} at {offset}: the bytes do not match digest {digest}")
                    payload = decode_png(data)
                    known[shard, digest] = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), features(payload))
                out.append(known[shard, digest])
            for f in files.values():
                f.close()
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            more = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *NEW])

    NEW = ["media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(read, f"{fields}, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string")


def text_payload(text):
    """UTF-8 bytes of a text (null: none), with bytes 255 up to a positive multiple of 576; a native column."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    more = F.when(size == 0, F.lit(COLUMNS)).otherwise((F.lit(COLUMNS) - size % COLUMNS) % COLUMNS)
    return F.concat(data, F.substring(F.lit(b"\xff" * COLUMNS), F.lit(1), more))


def stored_payloads(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): doc_id, n_bytes, payload of every row, payload its SHA-256; and of each payload where it lies and what
    its header says (see write_media). Both are tables of their own, no longer than the rows.

    The smallest doc_id of a payload stands for it. Rows that repeat both doc_id and text may be stored once a task; they all
    point to one member.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("n_bytes")
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size, text_payload(F.col("text")).alias("body")).withColumn("payload", F.unhex(F.sha2("body", 256)))
    rows = store(body.drop("body"), "payloads")
    shared = rows.groupBy("payload").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload", "first")
    shared = store(shared, "shared").toDF("shared", "first")
    # payloads of one row alone are not in that table; the others are written where the row is the one that stands for them
    chosen = body.join(small(shared), F.col("payload") == F.col("shared"), "left").where("shared IS NULL OR doc_id <=> first")
    members = write_media(chosen.select("doc_id", "n_bytes", "body", "payload"), folder, "body", carry="payload")
    members = store(members, "members").drop("doc_id", "n_bytes")
    return rows, members.groupBy("payload").agg(F.min(F.struct(*[c for c in members.columns if c != "payload"])).alias("m")).select("payload", "m.*")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and where the stored form
    lies: shard, offset; columns, rows and bits are its header's. One row per row of docs (doc_id, text; other columns are ignored).

    A null text counts as empty, which is one payload of 576 bytes 255; a null doc_id stays null; texts of any length are
    stored whole. Equal texts point to one member and have equal values, whatever their ids, so there are no ties.
    An empty table gives an empty table. Shards stay in the shared folder: they are what the rows point to.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    rows, members = stored_payloads(docs, folder)
    read = store(read_media(store(members, "places")), "media")
    bad = read.where("hex(payload) <> upper(payload_sha256)").limit(1).count()
    if bad:
        raise ValueError("a stored payload is not the one that was to be stored")
    out = rows.join(small(read), "payload")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "columns", "rows", "bits", "shard", "offset"]
    return out.select(*names)


def tar_members(data: bytes) -> dict[str, bytes]:
    """Names and contents of a shard, by the standard library."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
