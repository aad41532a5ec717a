r"""Content-addressed WARC archive.

A record is an exact header block and a payload. The archive keeps each payload once, under the SHA-256
of its bytes, in ``payloads``; the header blocks go to ``headers``. Records are rebuilt by a join on the
digest, which is computed anew from the stored bytes, so a damaged payload never joins. ``export`` writes the
rebuilt records as gzipped WARC/1.1 files, bytes as they are; ``read`` parses such files by their content
lengths and checks each payload against the digest in its header.

Scale: payloads are grouped by digest with partial aggregation, so each map task sends a payload once
however many copies it has; all other shuffles are narrow but for the one that rebuilds records, where
each payload is sent once. Tables and files go to the shared folder; a file holds at most ``FILE_RECORDS`` records
and is parsed as a stream, in batches of about BATCH_BYTES.

Defined results: a null html is an empty payload; rows that repeat the smallest page_id of a payload are
all responses; null page_ids count as larger than others and refer as usual; line breaks in URIs are percent-encoded;
WARC-Date is the time of archiving; an empty table gives an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, trim, write_shared

MIN_REVISIT, FILE_RECORDS, BATCH_BYTES = 100, 5000, 8 << 20
CRLF = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(record_id: Column) -> Column:
    """A record id as a URI; any id can stand in it."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(record_id.cast("string")), F.lit("")), F.lit(">"))


def _id(text: Column, kind: str) -> Column:
    return F.url_decode(F.nullif(text, F.lit(""))).cast(kind)


def store(records: DataFrame, path: str, *, min_revisit: int = MIN_REVISIT) -> None:
    """Archive records (record_id, uri, payload binary) below path: payloads by digest, then exact headers."""
    spark = records.sparkSession
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    digested = records.select("record_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    (digested.groupBy("digest").agg(F.min("record_id").alias("first_id"), F.max("n").alias("n"), F.any_value("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads"))
    first = spark.read.parquet(f"{path}/payloads").select("digest", "first_id")
    again = (F.col("n") >= min_revisit) & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    uri = F.replace(F.replace(F.coalesce("uri", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _name(F.col("record_id")), F.lit(f"{CRLF}WARC-Date: "), now,
        F.lit(f"{CRLF}WARC-Target-URI: "), uri, F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: {_REVISIT}{CRLF}WARC-Refers-To: "), _name(F.col("first_id")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("n")).cast("string"), F.lit(CRLF + CRLF),
    )
    digested.drop("payload").join(first, "digest").select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def parsed(headers: DataFrame, kind: str = "long") -> DataFrame:
    """Fields of exact header blocks, before the other columns; record ids are cast to kind, the digest is the header's."""
    text = F.col("header").cast("string")
    field = lambda key: F.regexp_extract(text, rf"\r\n{key}: ([^\r]*)", 1)
    return headers.select(
        field("WARC-Type").alias("record_type"), _id(F.regexp_extract(text, r"\r\nWARC-Record-ID: <urn:page:([^>]*)>", 1), kind).alias("record_id"),
        field("WARC-Target-URI").alias("uri"), F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)", 1).alias("digest"),
        _id(F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:([^>]*)>", 1), kind).alias("refers_to"), *[c for c in headers.columns if c != "digest"],
    )


def load(spark: SparkSession, path: str, *, rebuild: bool = False) -> DataFrame:
    """The archive's records: header fields, payload (null in revisits, the original's with rebuild) and the exact record as bytes.

    A record without stored bytes of the digest in its header fails the read."""
    payloads = spark.read.parquet(f"{path}/payloads")
    fields = parsed(spark.read.parquet(f"{path}/headers"), payloads.schema["first_id"].dataType.simpleString())
    kept = payloads.select(F.sha2("payload", 256).alias("digest"), F.col("payload").alias("stored"))
    stored = F.coalesce("stored", F.raise_error(F.concat(F.lit("no payload with digest "), F.col("digest"))).cast("binary"))
    whole = fields.join(kept, "digest", "left").withColumn("stored", stored)
    own = F.when((F.col("record_type") == "response") | F.col("stored").isNull(), F.col("stored"))  # looks at every record's bytes
    end = F.lit((CRLF + CRLF).encode())
    return whole.select(*fields.columns, (F.col("stored") if rebuild else own).alias("payload"), F.concat("header", F.coalesce(own, F.lit(b"")), end).alias("record"))


def export(spark: SparkSession, path: str, target: str, *, file_records: int = FILE_RECORDS) -> None:
    """Rebuild the records as gzipped WARC/1.1 files below target; revisits are header blocks that refer to their original.

    The line writer copies a string's bytes as they are, so payloads of any bytes come out unchanged."""
    lines = load(spark, path).select(F.concat("header", F.coalesce("payload", F.lit(b""))).cast("string").alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(target)


def records_of(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block and payload of each record of a WARC file, gzipped or not."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while line := stream.readline():
        head, length = [line], None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        while line != b"\r\n":
            line = stream.readline()
            if not line:
                raise ValueError("a header block without an end")
            head.append(line)
            if line[:15].lower() == b"content-length:":
                length = int(line[15:])
        payload = stream.read(length or 0)
        if length is None or len(payload) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record that is not as long as its Content-Length")
        yield b"".join(head), payload


def read(spark: SparkSession, target: str, kind: str = "long", *, payloads: bool = True) -> DataFrame:
    """Records of WARC files: header fields, n (bytes of the payload) and payload, both null for revisits.

    A payload with another digest than its header says fails the read. Without payloads only their sizes are given."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                heads, sizes, found, held = [], [], [], 0
                for head, payload in records_of(content.as_py()):
                    revisit = b"\r\nWARC-Type: revisit\r\n" in head
                    if not revisit and b"\r\nWARC-Payload-Digest: sha256:" + hashlib.sha256(payload).hexdigest().encode() + b"\r\n" not in head:
                        raise ValueError("a payload with another digest than its header says")
                    heads.append(head)
                    sizes.append(None if revisit else len(payload))
                    found.append(payload if payloads and not revisit else None)
                    held += len(head) + len(found[-1] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["header", "n", "payload"])
                        heads, sizes, found, held = [], [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["header", "n", "payload"])
        trim()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select("content")
    return parsed(files.mapInArrow(run, "header binary, n long, payload binary"), kind)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) written as WARC files and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests are those of the bytes in the files; a revisit has those of the response it refers to, without
    which the read fails."""
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")), f"{base}/store")
    export(spark, f"{base}/store", f"{base}/files")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = write_shared(read(spark, f"{base}/files", kind, payloads=False).select("record_id", "record_type", "digest", "refers_to", "n"), "warc-records")
    # each digest with responses once, and one row for each of its revisits
    originals = rows.where("record_type = 'response'").groupBy("digest").agg(F.max("n").alias("of"))
    size = F.coalesce("n", "of", F.raise_error(F.concat(F.lit("no response with digest "), F.col("digest"))).cast("long"))
    out = rows.where("record_type = 'response'").withColumn("of", F.col("n")).select(*rows.columns, "of").union(rows.where("record_type = 'revisit'").join(originals, "digest", "left").select(*rows.columns, "of"))
    return out.select(F.col("record_id").alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS dg FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY dg) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, dg AS payload_digest,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM q
"""
