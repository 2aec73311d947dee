"""WARC archives: write, read, and resolve revisits by payload digest.

1. Rows become response records in archives; a record is one value of Spark's text sink, whose separator is the two
   line ends that close a record, so archives are written and committed by Spark to any file system.  Payloads are text,
   so an archive is UTF-8 throughout; each file is one gzip stream.
2. Archives are read in bounded pieces, record by record, by Content-Length.
3. Only headers are shuffled by digest.  Of equal payloads the first record stays the response; the others become
   revisit records that name it.  Decisions are joined back by record id and new archives are written, with fresh headers.
4. On reading, revisit records are joined to their responses.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import scratch_path

MIN_BYTES = 100
RECORDS_PER_FILE = 20_000
#: Level of gzip: half the time of the default for a few hundredths more bytes.
LEVEL = "THREE"

#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIELDS = "record_id string, type string, page_id long, target string, digest string, refers_to string, payload string"


def _clean(value: Column) -> Column:
    return F.regexp_replace(value, "[\\r\\n]+", " ")


def record(kind: Column, record_id: Column, page_id: Column, target: Column, digest: Column, refers_to: Column, payload: Column) -> Column:
    """One record without the two line ends that close it.  A null field gives no header."""

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))

    revisit = kind == "revisit"
    return F.concat(
        F.concat_ws(
            "\r\n", F.lit(VERSION), header("WARC-Type", kind), header("WARC-Record-ID", F.concat(F.lit("<urn:x-record:"), record_id, F.lit(">"))),
            header("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            header("WARC-Target-URI", _clean(target)), header("X-Page-ID", page_id),
            header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
            header("WARC-Refers-To", F.concat(F.lit("<urn:x-record:"), refers_to, F.lit(">"))),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.lit("Content-Type: text/html; charset=utf-8"),
            header("Content-Length", F.octet_length(payload))),
        F.lit(END), payload)


def write(records: DataFrame, path: str) -> None:
    """Write a table of one column, whole records, as archives."""
    records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", LEVEL).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parsed(content: bytes):
    """(headers, payload) of each record of a gzip archive, inflating a megabyte at a time."""
    inflate, data, at, fed = zlib.decompressobj(31), bytearray(), 0, 0
    view = memoryview(content)

    def more() -> bool:
        nonlocal inflate, fed
        if fed >= len(view) and not inflate.unconsumed_tail:
            return False
        source = inflate.unconsumed_tail or view[fed : fed + (1 << 18)]
        if not inflate.unconsumed_tail:
            fed += len(source)
        data.extend(inflate.decompress(source, 1 << 20))
        if inflate.eof:
            fed -= len(inflate.unused_data)
            inflate = zlib.decompressobj(31)
        return True

    while True:
        while (stop := data.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        if stop < 0:
            if data[at:].strip():
                raise ValueError("an archive ends inside a record")
            return
        lines = bytes(data[at:stop]).decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin, size = stop + 4, int(headers["Content-Length"])
        while len(data) < begin + size and more():
            pass
        if len(data) < begin + size:
            raise ValueError("an archive ends inside a payload")
        yield headers, bytes(data[begin : begin + size])
        at = begin + size + 4
        if at > 1 << 20:
            del data[:at]
            at = 0


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_id, type, page_id, target, digest, refers_to (record ids) and payload of every record.

    The digest of a payload that is there is computed anew, and must agree with its header.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for h, payload in _parsed(content.as_py()):
                    own = h.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != own:
                        raise ValueError(f"payload digest of {h['WARC-Record-ID']} does not agree")
                    page, refers = h.get("X-Page-ID"), h.get("WARC-Refers-To")
                    rows.append((h["WARC-Record-ID"][14:-1], h["WARC-Type"], int(page) if page is not None else None, h.get("WARC-Target-URI"),
                                 own, refers[14:-1] if refers else None, payload.decode() if payloads else None, len(payload)))
                    held += len(payload)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, f"{_FIELDS}, payload_bytes long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["record_id", "type", "page_id", "target", "digest", "refers_to", "payload", "payload_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_pages(pages: DataFrame, path: str) -> None:
    """Every row of (page_id, url, html) as a response record; a null html is an empty payload, a null url no header."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    archive = F.lit(uuid.uuid4().hex[:12])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"), F.concat_ws("-", archive, F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")).alias("record_id"))
    write(rows.select(record(F.lit("response"), F.col("record_id"), F.col("page_id"), F.col("url"), F.col("digest"),
                             F.lit(None).cast("string"), F.col("payload")).alias("value")), path)


def resolve(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Archives of ``source`` written anew to ``target``, where equal payloads of ``min_bytes`` and more stand once.

    The response is the record with the smallest (page_id, record id), null page_ids last; page_ids may repeat.  Revisit
    records of the source keep what they refer to if that stays, else they refer to the new response of its digest.
    """
    headers = read(spark, source, payloads=False)
    responses = headers.where((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    firsts = responses.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    decisions = responses.join(firsts.select("digest", F.col("first.record_id").alias("original")), "digest").where(
        "record_id <> original").select("record_id", "original")
    old = headers.where("type = 'revisit'").join(
        firsts.select("digest", F.col("first.record_id").alias("original")), "digest").select("record_id", "original")
    whole = read(spark, source).join(decisions.union(old), "record_id", "left")
    moved = F.col("original").isNotNull()
    write(whole.select(record(
        F.when(moved, "revisit").otherwise(F.col("type")), F.col("record_id"), F.col("page_id"), F.col("target"), F.col("digest"),
        F.coalesce("original", "refers_to"), F.when(moved, "").otherwise(F.col("payload"))).alias("value")), target)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (page_id of the response), one row per record."""
    records = read(spark, path, payloads=False)
    revisits = records.where("type = 'revisit'").select("page_id", "digest", "refers_to")
    originals = records.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("original_bytes"))
    joined = revisits.join(originals, "refers_to", "left").select(
        "page_id", F.col("original_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), F.col("original_page").alias("refers_to"))
    return records.where("type = 'response'").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to")).union(joined)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` as archives, resolve their revisits into new archives, read those back.

    Needs page_id, url and html; other columns are ignored.  Null html is an empty payload, and payloads under ``min_bytes`` are
    never revisits.  Rows with equal page_id are records of their own, and a null page_id sorts last.  No rows: no rows.
    """
    spark = pages.sparkSession
    raw, fresh = scratch_path(spark, "archive"), scratch_path(spark, "resolved")
    write_pages(pages, raw)
    resolve(spark, raw, fresh, min_bytes)
    return resolved(spark, fresh)
