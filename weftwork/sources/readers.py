"""File sources as DataFrames of raw records.

Each reader takes (spark, path) and gives rows of the raw schema, one error record for a file that cannot
be read. Files are read by Spark's own sources, so a path may be a glob or a folder of any size and lie
in any store that Spark knows. record_id orders records by input, file and row.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW

ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")
EXTENSIONS = {".csv": "csv", ".json": "json", ".pdf": "resume_pdf", ".docx": "resume_pdf", ".txt": "resume_txt"}

_FILE = "row_ord long, source_file string, fields array<struct<key:string,value:string>>, raw_json string, raw_text string, parse_errors array<string>"
_ARROW = pa.schema([("row_ord", pa.int64()), ("source_file", pa.string()), ("fields", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), ("raw_json", pa.string()), ("raw_text", pa.string()), ("parse_errors", pa.list_(pa.string()))])

#: Sources for which an empty file is an error rather than no records.
EMPTY = {"resume_txt": "TXT file is empty", "resume_pdf": "PDF file is empty"}

#: Readers for large, splittable files, and the source whose records they give.
SPLIT = {"csv_large": "csv", "json_lines": "json"}

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register(source: str) -> Callable[[Reader], Reader]:
    """Make a reader the one for a source; a later one takes its place."""

    def put(reader: Reader) -> Reader:
        _READERS[source] = reader
        return reader

    return put


def registered() -> list[str]:
    return list(_READERS)


def row(ord_: int, path: str, fields=(), raw_json=None, raw_text=None, errors=()) -> dict:
    return {"row_ord": ord_, "source_file": path, "fields": [{"key": k, "value": v} for k, v in fields], "raw_json": raw_json, "raw_text": raw_text, "parse_errors": list(errors)}


#: Bits of record_id for the row in its partition, and for the partition in its input; the input takes what is left.
ROW_BITS, PARTITION_BITS = 30, 20


def _raw(df: DataFrame, source: str, input_ord: int = 0) -> DataFrame:
    """Records of one input, numbered; an input's files and their rows keep their order.

    A number has bits of its own for input, partition and row, so inputs keep their order at any number of partitions;
    a partition of 2**30 rows, or an input of 2**20 partitions, fails instead of running into the next one's numbers."""
    id_ = F.monotonically_increasing_id()  # partition << 33 | row
    part, at = F.shiftright(id_, 33), id_.bitwiseAND((1 << 33) - 1)
    fits = (part < (1 << PARTITION_BITS)) & (at < (1 << ROW_BITS))
    if input_ord >= 1 << (63 - ROW_BITS - PARTITION_BITS):
        raise ValueError(f"more than {1 << (63 - ROW_BITS - PARTITION_BITS)} inputs")
    number = F.when(fits, F.lit(input_ord << (ROW_BITS + PARTITION_BITS)).cast("long") + F.shiftleft(part, ROW_BITS) + at).otherwise(F.raise_error(F.lit("a partition or an input has too many rows to be numbered")).cast("long"))
    return df.select(number.alias("record_id"), F.lit(input_ord).alias("input_ord"), "row_ord", F.lit(source).alias("source"), "source_file", "fields", "raw_json", "raw_text", "parse_errors")


def _error_rows(spark: SparkSession, path: str, reason: str) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("row_ord"), F.lit(path).alias("source_file"), F.array().cast("array<struct<key:string,value:string>>").alias("fields"), F.lit(None).cast("string").alias("raw_json"), F.lit(None).cast("string").alias("raw_text"), F.array(F.lit(reason)).alias("parse_errors"))


def error_records(spark: SparkSession, source: str, path: str, reason: str, input_ord: int = 0) -> DataFrame:
    return _raw(_error_rows(spark, path, reason), source, input_ord)


def read(spark: SparkSession, source: str, path: str, input_ord: int = 0) -> DataFrame:
    """Raw records of one input; never raises for bad inputs."""
    reader = _READERS.get(source)
    if reader is None:
        return error_records(spark, source, path, f"No parser registered for source '{source}'. Available: {registered()}", input_ord)
    files = _files(spark, path)
    if not files:
        return error_records(spark, source, path, f"File not found: {path}", input_ord)
    parts = [] if all(size == 0 for _, size in files) else [reader(spark, path)]
    if source in EMPTY:  # Spark's sources pass over files of no bytes
        parts += [_error_rows(spark, name, EMPTY[source]) for name, size in files if size == 0]
    if not parts:
        return spark.createDataFrame([], RAW)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return _raw(rows, SPLIT.get(source, source), input_ord)  # numbered as one table


def read_all(spark: SparkSession, inputs: list[tuple[str, str]]) -> DataFrame:
    """All inputs, in their order."""
    out = None
    for k, (source, path) in enumerate(inputs):
        own = read(spark, source, path, k)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], RAW)


def route(paths: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """(source, path) by file extension, and the paths of no known one."""
    known, other = [], []
    for p in paths:
        source = EXTENSIONS.get("." + p.rsplit(".", 1)[-1].lower() if "." in p else "")
        known.append((source, p)) if source else other.append(p)
    return known, other


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of what a path or glob names itself; folders count as -1 bytes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    except Exception:
        return []
    return [(f.getPath().toString().removeprefix("file:"), f.getLen() if f.isFile() else -1) for f in found or []]


def _by_file(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """Rows that parse(path, content) makes of each whole file; files are spread over tasks."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows = list(parse(name.as_py().removeprefix("file:"), content.as_py()))
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 5000], _ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _FILE)


def decoded(content: bytes) -> str | None:
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


@register("csv")
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A record for each row with a value; keys and values stripped. The header may differ from file to file."""

    def parse(name: str, content: bytes) -> Iterator[dict]:
        if not content:
            return
        errors, text = [], None
        for encoding in ENCODINGS:
            try:
                text = content.decode(encoding)
                break
            except UnicodeDecodeError:
                errors.append(f"Encoding '{encoding}' failed for {name.rsplit('/', 1)[-1]}")
        try:
            rows = list(csv.reader(io.StringIO(text, newline="")))
        except csv.Error as e:
            yield row(0, name, errors=["; ".join([*errors, f"CSV parse error: {e}"])])
            return
        rows = [r for r in rows if r]
        header = [h.strip() for h in rows[0]] if rows else []
        for k, cells in enumerate(rows[1:]):
            # a repeated column keeps its first place and its last value
            values = dict(zip(header, [c.strip() for c in cells] + [None] * (len(header) - len(cells))))
            values.pop("", None)
            if any(values.values()):
                yield row(k, name, values.items(), errors=errors if k == 0 else ())

    return _by_file(spark, path, parse)


@register("csv_large")
def read_large_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same for large UTF-8 files of one header without line breaks in values, split over tasks by Spark's own reader."""
    df = spark.read.csv(path, header=True, multiLine=False, mode="PERMISSIVE", escape='"')
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("source_file", F.input_file_name())
    fields = F.array(*[F.struct(F.lit(n.strip()).alias("key"), F.trim(f"c{i}").alias("value")) for i, n in enumerate(names)])
    return plain.select(F.monotonically_increasing_id().alias("row_ord"), "source_file", fields.alias("fields"), F.lit(None).cast("string").alias("raw_json"), F.lit(None).cast("string").alias("raw_text"), F.array().cast("array<string>").alias("parse_errors")).where(F.exists("fields", lambda f: F.length(f["value"]) > 0))


@register("json")
def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The root object, or each object of a root array; the object stays JSON text, in its own order of keys."""

    def parse(name: str, content: bytes) -> Iterator[dict]:
        if not content:
            return
        try:
            if content.startswith(b"\xef\xbb\xbf"):
                raise json.JSONDecodeError("Unexpected UTF-8 BOM (decode using utf-8-sig)", "", 0)
            root = json.loads(content.decode("utf-8"))
        except json.JSONDecodeError as e:
            yield row(0, name, errors=[f"JSON decode error at line {e.lineno}: {e.msg}"])
            return
        except UnicodeDecodeError as e:
            yield row(0, name, errors=[f"Encoding error: {e}"])
            return
        if not isinstance(root, (dict, list)):
            yield row(0, name, errors=[f"Unexpected JSON root type: {type(root).__name__}"])
            return
        for k, item in enumerate([root] if isinstance(root, dict) else root):
            if isinstance(item, dict):
                clean = {a: b.strip() if isinstance(b, str) else b for a, b in item.items()}
                yield row(k, name, raw_json=json.dumps(clean, ensure_ascii=False))

    return _by_file(spark, path, parse)


@register("json_lines")
def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """An object on each line, for files too large to hold whole; other lines are error records."""
    df = spark.read.text(path).withColumn("source_file", F.input_file_name())
    bad = F.get_json_object("value", "$").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    return df.where(F.length(F.trim("value")) > 0).select(F.monotonically_increasing_id().alias("row_ord"), "source_file", F.array().cast("array<struct<key:string,value:string>>").alias("fields"), F.when(~bad, F.col("value")).alias("raw_json"), F.lit(None).cast("string").alias("raw_text"), F.when(bad, F.array(F.lit("JSON decode error"))).otherwise(F.array().cast("array<string>")).alias("parse_errors"))


@register("resume_txt")
def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """A record for each file, its text stripped."""

    def parse(name: str, content: bytes) -> Iterator[dict]:
        yield row(0, name, raw_text=decoded(content).replace("\r\n", "\n").replace("\r", "\n").strip())

    return _by_file(spark, path, parse)


@register("resume_pdf")
def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """A record for each file, if a PDF library is there; else error records. fields holds the targets of its links."""

    def links_of(content: bytes) -> list[tuple[str, str]]:
        """Targets of link annotations, if the library that shows them is there."""
        try:
            import fitz

            with fitz.open(stream=content, filetype="pdf") as pdf:
                found = [x["uri"].strip() for page in pdf for x in page.get_links() if x.get("uri")]
        except Exception:
            return []
        return [("link", u) for u in dict.fromkeys(found) if u and not u.lower().startswith("mailto:")]

    def text_of(content: bytes) -> str:
        problems = []
        try:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(content)) as pdf:
                if text := "\n".join(p.extract_text() or "" for p in pdf.pages).strip():
                    return text
        except Exception as e:
            problems.append(f"pdfplumber: {e}")
        try:
            from pypdf import PdfReader

            pdf = PdfReader(io.BytesIO(content))
            if pdf.is_encrypted:
                raise ValueError("encrypted")
            return "\n".join(p.extract_text() or "" for p in pdf.pages).strip()
        except Exception as e:
            problems.append(f"pypdf: {e}")
        raise ValueError("; ".join(problems))

    def parse(name: str, content: bytes) -> Iterator[dict]:
        try:
            yield row(0, name, links_of(content), raw_text=text_of(content))
        except ValueError as e:
            yield row(0, name, errors=[f"PDF extraction failed: {e}"])

    return _by_file(spark, path, parse)
