"""Shared pieces of the text operators: checkpoints, bounded Arrow slices, and byte-level word scans.

The word classes used here are decided by single UTF-8 bytes (every multi-byte character is a word
character), so a whole Arrow slice is scanned at once with numpy instead of one regex call per text.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy scan covers; work arrays take about 40 times as much.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


#: Bytes of an Arrow batch, where the session names no bound: 10,000 rows of long texts would be far more.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session whose executors run in this
    process gets one of our own where it is unset: on a cluster no other machine would see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), f'checkpoints-{os.getpid()}')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables of write_shared that no later step reads."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give freed memory back: Python workers live on, and other stages' tasks share their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about limit bytes of text, or one longer text alone."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at, done = end, int(size[end - 1])
    trim()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offset of each text in them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_class(is_word, fold: bool) -> np.ndarray:
    """256 values: 0 for separators, else 1 + the byte, letters A-Z as a-z if fold."""
    lower = [b + 32 if fold and 65 <= b <= 90 else b for b in range(256)]
    return np.array([1 + lower[b] if is_word(lower[b]) else 0 for b in range(256)], np.uint16)


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z become a-z.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80, True)
#: Words [^\x20\x09-\x0D]+ with and without lower-casing.
SPACED_FOLD = byte_class(lambda b: not (b == 0x20 or 9 <= b <= 13), True)
SPACED = byte_class(lambda b: not (b == 0x20 or 9 <= b <= 13), False)
#: Lines between \n.
LINES = byte_class(lambda b: b != 10, False)

_powers: dict[str, np.ndarray] = {}


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INV, _U)
        base[0] = 1
        have = _powers[kind] = np.multiply.accumulate(base)
        if n > 4 * SLICE_BYTES:  # a single very long text; not worth keeping
            _powers.pop(kind)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Scan:
    """Words of many texts: start and end (bytes), doc (index of the text), hash; first[i]:first[i+1] are those of text i."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray, hashed: bool = True):
        self.data, self.off = data, off
        n, self.n_docs = len(data), len(off) - 1
        value = kind[data]
        mask = value > 0
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        full = off[1:] > off[:-1]
        before[off[:-1][full]] = False
        after[off[1:][full] - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        if hashed:
            total = np.zeros(n + 1, _U)
            np.cumsum(value.astype(_U) * _pow("up", n), out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * _pow("down", n + 1)[self.start] + (self.end - self.start).astype(_U))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k-word window, and the index of its first word."""
        h, n = self.hash, len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return gram_hash([h[at + i] for i in range(k)]), at


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(words[0]), _U(len(words) * 0xD6E8FEB86659FD93 % (1 << 64)), _U)
    for w in words:
        total = mix(total * _U(_BASE) + w)
    return total


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags over each [off[i], off[i+1])."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def sample(docs: DataFrame, some: DataFrame, features, extra: str) -> DataFrame:
    """One row for each (doc_id, quality) of some (bounded, so it is broadcast): of the texts of a doc_id, that of the smallest hash.

    features(part) gives for each text, or row of part, its columns, named in extra; rows are in order of the hash of doc_id."""
    names = [x.split(" ")[0] for x in extra.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), part.column("h"), *features(part.column("text"))], names=["doc_id", "quality", "h", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")
    found = rows.mapInArrow(run, f"doc_id {kind}, quality int, h long, {extra}")
    return found.groupBy("doc_id", "quality").agg(F.min_by(F.struct(*names), "h").alias("x")).select("doc_id", "quality", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id", "quality")


def labelled(labels: DataFrame, max_train: int) -> DataFrame:
    """At most max_train different (doc_id, quality) rows, those of the smallest hashes of doc_id."""
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    return own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
