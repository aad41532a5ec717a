r"""Benchmark decontamination by winnowing.

Benchmark items become k-gram fingerprints: the smallest k-gram hash of each run of w consecutive
ones, k + w - 1 = the window length. A document is winnowed in the same way, so a shared span of a
whole window always has a fingerprint in common. Each fingerprint hit is extended to the windows that
cover it, and those are compared word by word with the items' windows, so hashes never decide.

Scale: documents are read once and never shuffled. The benchmark goes to the executors in blocks of at
most ``block_bytes``; a larger benchmark takes more passes, with the hits so far kept in the rows and a
checkpoint in between, so no broadcast grows beyond the bound.

Defined results: null or empty texts have no words, hits or items; items without words never occur;
repeated rows are rows of their own; an item_id that occurs in several rows counts once; null item_ids
are left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Scan, checkpoint, flat, slices, table

GRAM, WINDOW, BLOCK_BYTES = 5, 8, 16 << 20


def winnow(h: np.ndarray, at: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Indices (into at) of the rightmost smallest hash in each run of w consecutive hashes of one text."""
    n = len(h) - w + 1
    if w == 1 or n <= 0:
        return np.arange(len(h)) if w == 1 else np.zeros(0, np.int64)
    best = np.arange(n)
    for i in range(1, w):
        best = np.where(h[i : i + n] <= h[best], np.arange(i, i + n), best)
    return np.unique(best[doc[at[:n]] == doc[at[w - 1 :]]])


class Items:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, rows: list[tuple], window: int, gram: int):
        rows = [(i, t) for i, t in rows if i is not None and t]
        scan = Scan(*flat(pa.array([t for _, t in rows], pa.string())), ALNUM)
        self.windows: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.ids = sorted({str(i) for i, _ in rows})
        place = {x: k for k, x in enumerate(self.ids)}
        low = ALNUM[scan.data].astype(np.int64) - 1
        text = low.astype(np.uint8).tobytes()
        words = [text[s:e] for s, e in zip(scan.start.tolist(), scan.end.tolist())]
        for d, (i, _) in enumerate(rows):
            a, b = int(scan.first[d]), int(scan.first[d + 1])
            length = min(window, b - a)
            for p in range(a, b - length + 1) if length else ():
                self.windows[length][b" ".join(words[p : p + length])].add(place[str(i)])
        self.prints: dict[int, np.ndarray] = {}
        for length in self.windows:
            k = min(gram, length)
            short = np.isin(scan.doc, np.flatnonzero(scan.count == length) if length < window else np.flatnonzero(scan.count >= window))
            h, at = scan.grams(k)
            keep = short[at]
            h, at = h[keep], at[keep]
            self.prints[length] = np.unique(h[winnow(h, at, scan.doc, length - k + 1)])
        self.windows = {n: dict(x) for n, x in self.windows.items()}
        self.gram = gram

    def hits(self, scan: Scan, covered: np.ndarray, found: dict[int, set[int]]) -> None:
        """Mark the words inside occurrences, and add the items of each text."""
        if not len(scan.start):
            return
        low = None
        grams: dict[int, tuple] = {}
        for length, prints in self.prints.items():
            k = min(self.gram, length)
            h, at = grams.get(k) or grams.setdefault(k, scan.grams(k))
            chosen = winnow(h, at, scan.doc, length - k + 1)
            chosen = chosen[np.isin(h[chosen], prints)]
            if not len(chosen):
                continue
            # extend: every window of this length that covers the fingerprint, inside the text
            first = (at[chosen][:, None] - np.arange(length - k + 1)[None, :]).ravel()
            doc = np.repeat(scan.doc[at[chosen]], length - k + 1)
            ok = (first >= scan.first[doc]) & (first + length <= scan.first[doc + 1])
            if low is None:
                low = np.maximum(ALNUM[scan.data].astype(np.int64) - 1, 0).astype(np.uint8)
            known = self.windows[length]
            for p in np.unique(first[ok]).tolist():
                key = b" ".join(low[s:e].tobytes() for s, e in zip(scan.start[p : p + length].tolist(), scan.end[p : p + length].tolist()))
                if (items := known.get(key)) is not None:
                    covered[p : p + length] = True
                    found[int(scan.doc[p])] |= items


def _marked(docs: DataFrame, text: str, benchmark: DataFrame, window: int, gram: int, block_bytes: int) -> DataFrame:
    """docs, whose columns are not named so, with n_words, hits and items added."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (block_bytes // 2)))
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))]
    kept = docs.columns
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast(added[1].dataType), "items": F.array().cast(added[2].dataType)})
    schema = T.StructType([*docs.schema.fields, *added])
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # at most about block_bytes
        sent = spark.sparkContext.broadcast(Items([tuple(r) for r in rows], window, gram))

        def run(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, text):
                    scan = Scan(*flat(part.column(text)), ALNUM)
                    covered, found = np.zeros(len(scan.start), bool), defaultdict(set)
                    hits, names = part.column("hits").to_pylist(), part.column("items").to_pylist()
                    sent.value.hits(scan, covered, found)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                    spans = defaultdict(list)
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        while a < b:  # a run may go on from one text to the next
                            d = int(scan.doc[a])
                            end = min(b, int(scan.first[d + 1]))
                            spans[d].append([a - int(scan.first[d]), end - int(scan.first[d])])
                            a = end
                    for d, new in spans.items():
                        hits[d] = merged(hits[d] + new)
                        names[d] = sorted({*names[d], *(sent.value.ids[i] for i in found[d])})
                    cols = [part.column(c) for c in kept] + [pa.array(scan.count, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_words", "hits", "items"])

        out = out.mapInArrow(run, schema)
        if block < blocks - 1:
            out = checkpoint(out)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (text, ...) with n_words, hits (list of [first, last) word spans) and items (list of item_ids as strings) added, in place of columns of these names."""
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    inner = [f"c{i}" for i in range(len(kept))]
    plain = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)])
    return _marked(plain, inner[kept.index("text")], benchmark, window, gram, block_bytes).toDF(*kept, "n_words", "hits", "items")


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(text: str, hits: list[list[int]]) -> str:
    """text without its hit spans of words, and without what stands between the words of a span."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for a, b in hits:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents (two items or more); single items' passages are cut out of the others.

    All other columns stay as they are, whatever their names; n_chars, if there as a whole number, follows the text."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names can't clash with ours
    at = docs.columns.index("text")
    size = next((i for i, f in enumerate(docs.schema.fields) if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)), None)
    plain = docs.toDF(*inner)
    found = _marked(plain, inner[at], benchmark, window, gram, block_bytes).where(F.size("items") < 2)

    def run(batches):
        for batch in batches:
            cols, hits = [batch.column(c) for c in inner], batch.column("hits").to_pylist()
            if any(hits):
                texts = [without(t.as_py(), h) if h else t.as_py() for t, h in zip(cols[at], hits)]
                cols[at] = pa.array(texts, pa.string())
                if size is not None:
                    cols[size] = pa.array([len(t) if h else n for t, h, n in zip(texts, hits, cols[size].to_pylist())], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=inner)

    return found.mapInArrow(run, plain.schema).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document the digest columns of the contract; contaminated from two items on."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id", "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda t, s: t + s[1] - s[0]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _SQL_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: For one row per document (doc_id distinct), as SQL names documents by doc_id.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS n,
         array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
