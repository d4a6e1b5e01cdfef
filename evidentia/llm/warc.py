"""A content-addressed archive of web pages that gives back exact WARC records.

Payload bytes are stored once, under their SHA-256, checked again whenever they are read.
Record headers (WARC and HTTP, byte for byte) are stored apart, one row a record.
A record is reconstructed by joining its header with its payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import Scratch

#: Date of records whose source has none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LIGHT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("address", pa.binary()), ("sha1", pa.string()), ("payload_bytes", pa.int64())])


@dataclass(frozen=True)
class Archive:
    objects: DataFrame  # address, payload
    records: DataFrame  # page_id, header, address, record_type, refers_to


def _bytes(x: str | None) -> bytes:
    return (x or "").encode()


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from B.slices(batch, batch.schema.get_field_index(column))


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches, "html"):
        raw = [_bytes(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array([base64.b32encode(hashlib.sha1(r).digest()).decode() for r in raw], pa.string()), pa.array([len(r) for r in raw], pa.int64())], schema=_LIGHT)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches, "html"):
        raw = [_bytes(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["page_id", "address", "payload"])


def header(page_id: int | None, url: str | None, sha1: str, n: int, refers_to: int | None, revisit: bool) -> str:
    """WARC header, blank line and the HTTP header that opens the block."""
    urn = lambda i: f"<urn:x-page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + http


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of the WARC header, and the payload behind the HTTP header. Raises if the block's length is not that of the header."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if len(block) != int(fields["Content-Length"]):
        raise ValueError(f"{fields['WARC-Record-ID']}: block of {len(block)} bytes, {fields['Content-Length']} stated")
    return fields, block.partition(b"\r\n\r\n")[2]


def _number(urn: str | None) -> int | None:
    n = (urn or "none")[len("<urn:x-page:") : -1]
    return None if n in ("none", "") else int(n)


def write_archive(pages: DataFrame, scratch: Scratch, *, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Writes the archive of `pages`. Of rows with equal payloads of at least `least` bytes that with the largest id is the response, the others revisit it.

    Null payloads are empty ones.  Rows with a null id rank below all others. Repeated rows of a response are
    responses too, their payload is stored once.  A null url leaves out the field.  Other columns are ignored.

    At scale: the first pass sends digests only; payloads aren't shuffled unless the rows that revisit are too many to broadcast.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("html"))
    light = scratch.table("light", rows.mapInArrow(_light, "page_id bigint, url string, address binary, sha1 string, payload_bytes bigint"))
    top = scratch.table("top", light.where(F.col("payload_bytes") >= least).groupBy("address").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1"))
    named = light.join(top, "address", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    known = scratch.table("known", named.select("page_id", "url", "address", "sha1", "payload_bytes", revisit.alias("revisit"), F.when(revisit, F.col("top")).alias("refers_to")))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            text = [header(i, u, s, n, t, r) for i, u, s, n, t, r in zip(cols["page_id"], cols["url"], cols["sha1"], cols["payload_bytes"], cols["refers_to"], cols["revisit"], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(text, pa.string()), b.column("address"), pa.array(["revisit" if r else "response" for r in cols["revisit"]], pa.string()), b.column("refers_to")], names=["page_id", "header", "address", "record_type", "refers_to"])

    records = scratch.table("records", known.mapInArrow(heads, "page_id bigint, header string, address binary, record_type string, refers_to bigint"))
    # written, so that Spark knows its size: where few rows revisit, it is sent to the payloads and they stay where they are
    again = scratch.table("again", known.where("revisit").select("page_id", "address").distinct())
    stored = rows.select("page_id", "html").mapInArrow(_payloads, "page_id bigint, address binary, payload binary")
    stored = stored.join(again, [stored["page_id"].eqNullSafe(again["page_id"]), stored["address"] == again["address"]], "left_anti")
    twice = scratch.table("twice", known.where("not revisit").groupBy("address").count().where("count > 1").select("address"))
    if not twice.isEmpty():  # repeated rows, or payloads under `least`: only these meet
        stored = stored.join(twice, "address", "left_anti").select("address", "payload").unionByName(stored.join(twice, "address", "left_semi").select("address", "payload").dropDuplicates(["address"]))
    return Archive(scratch.table("objects", stored.select("address", "payload")), records)


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches, "payload"):
        out = []
        for i, head, kind, address, payload in zip(*(b.column(c).to_pylist() for c in ("page_id", "header", "record_type", "address", "payload")), strict=True):
            if kind == "response" and (payload is None or hashlib.sha256(payload).digest() != address):
                raise ValueError(f"page {i}: its payload is missing or isn't what its address says")
            out.append((i, head.encode() + (payload if kind == "response" else b"")))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["page_id", "record"])


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches, "record"):
        out = []
        for record in b.column(b.schema.get_field_index("record")).to_pylist():
            fields, payload = parse(record)
            stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = fields["WARC-Type"]
            if kind == "response" and (got := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != stated:
                raise ValueError(f"{fields['WARC-Record-ID']}: payload digest {got}, {stated} stated")
            out.append((_number(fields["WARC-Record-ID"]), len(payload) if kind == "response" else None, stated, kind, _number(fields.get("WARC-Refers-To"))))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _joined(archive: Archive) -> DataFrame:
    plain = archive.records.where("record_type = 'response'").join(archive.objects, "address", "left")
    empty = archive.records.where("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    return plain.unionByName(empty).select("page_id", "header", "record_type", "address", "payload")


def reconstruct(archive: Archive) -> DataFrame:
    """(page_id, record): each original record, header and block as bytes without the two line ends behind it. Payloads whose digest is not their address fail."""
    return _joined(archive).mapInArrow(_put, "page_id bigint, record binary")


def read_records(records: DataFrame) -> DataFrame:
    """What records (page_id, record) say of themselves, digests taken anew of the payloads they carry: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit carries no payload; its digest is the header's and its bytes are null.
    """
    return records.mapInArrow(_look, _READ)


def read_archive(archive: Archive) -> DataFrame:
    """read_records of the reconstructed records, in one pass of one worker."""
    return _joined(archive).mapInArrow(lambda batches: _look(_put(batches)), _READ)


def resolve_revisits(read: DataFrame, scratch: Scratch) -> DataFrame:
    """Gives revisits the payload length of the response they refer to."""
    read = scratch.table("read", read)
    size = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("n")).dropDuplicates(["refers_to", "payload_digest"])
    return read.join(size, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def export_files(archive: Archive, path: str, per_file: int = 20_000) -> None:
    """Writes the records as .warc text parts: each record ends in two line ends, as the format asks."""
    text = reconstruct(archive).select(F.decode("record", "UTF-8").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record) of the parts under path, cut by the lengths that the records state."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                at, out = 0, []
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at)
                    n = int(re.search(rb"\r\nContent-Length: (\d+)", content[at:end])[1])
                    out.append(content[at : end + 4 + n])
                    at = end + 4 + n + 4
                ids = [_number(parse(r)[0]["WARC-Record-ID"]) for r in out]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["page_id", "record"])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(split, "page_id bigint, record binary")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archive = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    return resolve_revisits(read_archive(archive), scratch)


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p),
b AS (SELECT page_id, n, top, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda c:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(s, 1 + 5 * CAST(g AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * c AS INTEGER)) & 31 AS INTEGER), 1)), '')), '') AS digest FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""
