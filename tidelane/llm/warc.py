"""Content-addressed WARC archive: payloads once by SHA-256, exact record headers beside them, records rebuilt by joins.

An archive is two tables. `payloads` holds each distinct payload once: digest, payload, n (records with it). `records`
holds for each record its exact header bytes (WARC and HTTP), digest and type. A record is header + payload + two line ends; a
revisit has no payload of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, arrow_limits, attach_group, free_shuffles

#: Payloads of at least so many bytes are stored as a revisit when they come again.
REVISIT_BYTES = 100
#: Records that one copy of a payload serves when records are rebuilt; a payload with more records is dealt out in more copies.
RECORDS_A_COPY = 1000
#: The capture time is not in the tables, so it is a parameter of the archive.
DATE = "1970-01-01T00:00:00Z"

_LINE = "\r\n"


@dataclass
class Archive:
    payloads: DataFrame
    records: DataFrame


def _record_id(page_id) -> F.Column:
    """A version 8 UUID that spells out the id: its 64 bits around the version and variant, then zeros; a null id ends in 1."""
    h = F.lpad(F.hex(F.coalesce(page_id, F.lit(0).cast("long"))), 16, "0")
    end = F.when(page_id.isNull(), "000000000001").otherwise("000000000000")
    return F.lower(F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 13, 3), F.lit("-8"), F.substring(h, 16, 1), F.lit("00-"), end, F.lit(">")))


def page_of(record_id: str) -> int | None:
    """The id that a record id spells out; raises CorruptRecord if it isn't one of write()'s."""
    found = re.fullmatch("<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8([0-9a-f]{3})-8([0-9a-f])00-00000000000([01])>", record_id)
    if not found:
        raise CorruptRecord("a record id of another kind")
    number = int("".join(found.groups()[:4]), 16)
    return None if found[5] == "1" else number - (1 << 64) if number >> 63 else number


def _headers(date: str) -> F.Column:
    """The exact bytes before the payload, for a row with page_id, url, digest, n_bytes, record_type, refers_to."""
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(_LINE * 2))
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    warc = F.concat(
        F.lit(f"WARC/1.1{_LINE}WARC-Type: "), F.col("record_type"),
        F.lit(f"{_LINE}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{_LINE}WARC-Date: {date}{_LINE}WARC-Target-URI: "), uri,
        F.when(revisit, F.concat(F.lit(f"{_LINE}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_LINE}WARC-Refers-To: "), _record_id(F.col("refers_to")))).otherwise(""),
        F.lit(f"{_LINE}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{_LINE}Content-Type: application/http; msgtype=response{_LINE}Content-Length: "), block.cast("string"), F.lit(_LINE * 2),
    )
    return F.encode(F.concat(warc, http), "UTF-8")


def write(pages: DataFrame, stage: Stage, date: str = DATE, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """The archive of pages, one record a row; null payloads are empty, null URLs too.

    Of records with equal payloads of at least REVISIT_BYTES, the one with the least id is the response, the others
    revisit it. Ids should be unique: rows that repeat that least id are responses too. A null id never is the one that
    others revisit unless all ids are null; then all are responses. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # one copy of each payload; copies in a task are combined before the exchange, and a second hash tests the digest
    once = source.groupBy("digest").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("payload")).alias("_a"), F.max(F.xxhash64("payload")).alias("_b"))
    once = once.select("digest", F.when(F.col("_a") == F.col("_b"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("payload"), "n")
    payloads = stage.write(once, "payloads")
    free_shuffles(pages.sparkSession)
    rows = stage.write(source.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes")), "rows", scan=True)
    rows = attach_group(rows, ["digest"], {"_min": F.min("page_id"), "_n": F.count(F.lit(1))}, {"first_id": F.min("_min"), "n": F.sum("_n")}, ["page_id"])
    revisit = (F.col("n_bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    records = stage.write(rows.select("page_id", "digest", "n", "record_type", "refers_to", _headers(date).alias("header")), "records", few=True)
    free_shuffles(pages.sparkSession)
    return Archive(payloads, records)


def open_archive(spark: SparkSession, path: str) -> Archive:
    """An archive that save() wrote."""
    return Archive(spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/records"))


def save(archive: Archive, path: str) -> None:
    archive.payloads.write.parquet(f"{path}/payloads")
    archive.records.write.parquet(f"{path}/records")


def rebuild(archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, record (the whole record's bytes), content (the full payload, also of a revisit)."""
    copies = F.ceil(F.col("n") / RECORDS_A_COPY).cast("int")
    records = archive.records.withColumn("_copy", F.pmod(F.xxhash64("page_id", "header"), copies).cast("int"))
    payloads = archive.payloads.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n")
    own = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.join(payloads, ["digest", "_copy"]).select("page_id", "record_type", "refers_to", F.concat("header", own, F.lit((_LINE * 2).encode())).alias("record"), F.col("payload").alias("content"))


class CorruptRecord(ValueError):
    """A record's bytes contradict its headers."""


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The WARC headers (lower-case names) and the payload of one record's bytes; raises CorruptRecord."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise CorruptRecord("no WARC/1.1 header")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise CorruptRecord("the block has another length than its header says")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    if not found:
        raise CorruptRecord("no HTTP header")
    length = re.search(rb"(?i)^content-length: (\d+)$", http.replace(b"\r\n", b"\n"), re.M)
    if fields["warc-type"] == "response" and (not length or int(length[1]) != len(payload) or "sha256:" + hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"]):
        raise CorruptRecord("the payload fails its digest or length")
    return fields, payload


def _read(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for record, content in zip(batch.column("record"), batch.column("content"), strict=True):
            fields, payload = parse(record.as_py())
            if fields["warc-type"] == "revisit":
                payload = content.as_py()
                if "sha256:" + hashlib.sha256(payload).hexdigest() != fields["warc-payload-digest"]:
                    raise CorruptRecord("the payload that a revisit refers to fails its digest")
            refers_to = page_of(fields["warc-refers-to"]) if fields["warc-type"] == "revisit" else None
            rows.append((page_of(fields["warc-record-id"]), len(payload), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], refers_to, len(record.as_py())))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_bytes"])


def read(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes, all taken from the rebuilt and tested records' bytes."""
    arrow_limits(archive.records.sparkSession)
    return rebuild(archive).select("record", "content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_bytes long")
