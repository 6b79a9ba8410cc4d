"""WARC archives: writing with revisits, and a normaliser of archives that are one gzip stream.

An archive is a row (archive, content), so that it can live in any storage Spark writes; `read_files` gets the same rows
from files. The normaliser inflates each archive's stream once, piece by piece, rewrites every record as a gzip member
of its own, and gives an index of (offset, length) of the members, which is written beside the archives. Members are
then read one at a time by seeking.

Null payloads count as empty. Of records with equal payloads of at least `min_bytes`, that with the largest page_id is
the response and the others revisit it; rows that share this page_id are all responses. A null page_id is smaller than
any other. Payloads are taken whole. Empty tables make no archives and give no rows; further columns aren't read. An
archive whose stream or last record is cut short, even at a record's end, is an error. Archives come as rows of up to
2 GB (`read_files`); Spark's binary reader takes no larger file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "array<struct<offset:bigint,length:bigint,record_id:string,type:string>>"
#: Payload bytes after which a task starts another archive, and the piece size of inflation.
ROLL, PIECE = 8 << 20, 1 << 18


def typed(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, z, sha1, type, refers_to): which rows carry their payload (compressed, z) and which refer to another's."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # copies meet within tasks before the shuffle, and only digests that repeat go on
    keeper = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return common.packed(rows, ["page_id", "url", "sha1"], "payload").join(keeper, "sha1", "left").select(
        "page_id", "url", "z", "sha1", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("keeper")).alias("refers_to")
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, sha1: str, kind: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archived(rows: DataFrame, level: int = 3, roll: int = ROLL) -> DataFrame:
    """(archive, content) out of typed rows: archives of about `roll` payload bytes, each one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, k = f"part-{TaskContext.get().partitionId():06d}", 0
        z, out, size = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0

        def done():
            content = b"".join([*out, z.flush()])
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{k:05d}.warc.gz"]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, url, packed, sha1, kind, to = (c[i].as_py() for c in cols)
                payload = common.unpacked_one(packed)
                out.append(z.compress(record(page, url, payload, sha1, kind, to)))
                size += len(payload)
                if size >= roll:
                    yield done()
                    z, out, size, k = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0, k + 1
        if out:
            yield done()

    return rows.select("page_id", "url", "z", "sha1", "type", "refers_to").mapInArrow(run, "archive string, content binary")


def inflated(content: bytes, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of one or more gzip members, in pieces of bounded size; an error if the last one is cut short."""
    at, rest, z, fresh = 0, b"", zlib.decompressobj(31), True
    while rest or at < len(content):
        if not rest:
            rest, at = content[at : at + piece], at + piece
        if fresh and not rest.strip(b"\0"):  # padding behind the last member
            rest = b""
            continue
        yield z.decompress(rest, piece)
        fresh = z.eof
        if z.eof:
            rest, z = z.unused_data, zlib.decompressobj(31)
        else:
            rest = z.unconsumed_tail
    while not fresh and z.unconsumed_tail:
        yield z.decompress(z.unconsumed_tail, piece)
    if not fresh and not z.eof:
        if tail := z.flush():
            yield tail
        if not z.eof:
            raise ValueError("the archive's gzip stream ends early")


def parsed_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of each record in a stream of pieces; holds one record and a piece at most."""
    buf, need, head, body = bytearray(), 0, None, 0
    for piece in pieces:
        buf += piece
        while True:
            if head is None:
                while buf[:2] == b"\r\n":
                    del buf[:2]
                if (body := buf.find(b"\r\n\r\n")) < 0:
                    break
                head = parsed_head(bytes(buf[:body]))
                need = body + 4 + int(head["content-length"]) + 4
            if len(buf) < need:
                break
            yield head, bytes(buf[:need])
            del buf[:need]
            head = None
    if head is not None or buf.strip():
        raise ValueError("the archive ends within a record")


def normalised(archives: DataFrame, level: int = 3) -> DataFrame:
    """(archive, content, entries): every record a gzip member of its own, and where each one is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, index, at = [], [], 0
                for head, whole in records(inflated(content.as_py())):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(whole) + z.flush()
                    index.append({"offset": at, "length": len(member), "record_id": head.get("warc-record-id", ""), "type": head.get("warc-type", "")})
                    at += len(member)
                    out.append(member)
                kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary()), pa.array([index], kind)], ["archive", "content", "entries"])

    return archives.select("archive", "content").mapInArrow(run, f"archive string, content binary, entries {INDEX}")


def sidecar(archives: DataFrame) -> DataFrame:
    """The offset index of normalised archives: a row for each member."""
    return archives.select("archive", F.inline("entries"))


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_members(archives: DataFrame) -> DataFrame:
    """One row per record, each inflated from its own member; a response's payload is checked against its digest."""

    def number(s: str | None) -> int | None:
        return int(s) if s else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, entries in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, rows = content.as_py(), []
                for e in entries:
                    whole = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31)
                    cut = whole.index(b"\r\n\r\n")
                    head = parsed_head(whole[:cut])
                    block = whole[cut + 4 : cut + 4 + int(head["content-length"])]
                    cut = block.index(b"\r\n\r\n")
                    http, payload = parsed_head(block[:cut]), block[cut + 4 :]
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = int(http["content-length"])
                    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{head['warc-record-id']}: the payload does not match its digest")
                    rows.append((number(head["x-page-id"]), size, digest, head["warc-type"], number(head.get("x-refers-to-page-id"))))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], [f.split()[0] for f in RESULT.split(", ")])

    return archives.select("archive", "content", "entries").mapInArrow(run, RESULT)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the WARC files under a path or glob."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def round_trip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes the pages as archives of one stream each, normalises them with their index, and reads them back."""
    whole = common.written(archived(typed(pages, min_bytes)), "warc")
    members = common.written(normalised(whole), "warc-members")
    common.written(sidecar(members), "warc-index")
    return read_members(members)
