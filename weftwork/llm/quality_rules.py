r"""Quality rules: statistics of whole documents, and gradient-boosted trees over them.

The base statistics are counts over the words [^\x20\x09-\x0D]+ and the \n-split lines of a text; equal lines and
word windows of one text are told by 64-bit hashes.
Trees are grown on the driver from a bounded sample of labelled documents (``max_train`` rows, the ones
with the smallest hash of doc_id; of rows that share one, that of the smallest text hash), with splits that keep the score from rising in the features named in
FALLING. They are flattened into numpy node arrays and score a whole slice of documents at once.

Scale: one narrow pass over the documents, no shuffle. The sample's ids (at most ``max_train``) are
broadcast, the statistics of these rows collected, and the node arrays broadcast.

Defined results: a null or empty text has no words, so it fails the base rule; repeated rows are rows of
their own; without labels of both kinds every text gets the score 1; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LINES, SPACED, Scan, flat, labelled, mix, sample, slices, sums, table

MAX_TRAIN, TREES, DEPTH, RATE, BINS, KEEP_FROM = 4000, 60, 3, 0.15, 48, 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "bars", "line_words")
FALLING = ("symbols", "dup_lines", "repeats", "bangs", "bars")

_CLASSES = np.zeros(256, np.int64)
for _k, _set in enumerate((range(65, 91), range(48, 58), b"!", b"|", b"#*$%&<>"), 1):
    _CLASSES[list(_set)] = _k
_CONTINUED = np.array([(b & 0xC0) == 0x80 for b in range(256)])
N_CLASSES = 6


def class_counts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bytes of each class (other, A-Z, 0-9, !, |, other symbols) between consecutive edges."""
    n = len(edges) - 1
    where = np.repeat(np.arange(n) * N_CLASSES, np.diff(edges))
    return np.bincount(where + _CLASSES[data[edges[0] : edges[-1]]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def repeated_words(words: Scan, k: int = 5) -> np.ndarray:
    """Which words lie in a k-word window that occurs twice or more in its text."""
    g, at = words.grams(k)
    edge = np.zeros(len(words.start) + 1, np.int64)
    if len(g):
        key = mix(g ^ mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + k, -1)
    return np.cumsum(edge[:-1]) > 0


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Base statistics and features of each text."""
    data, off = flat(column)
    words = Scan(data, off, SPACED)
    lines = Scan(data, off, LINES)
    n = words.count
    in_word = (SPACED[data] > 0) & ~_CONTINUED[data]
    chars = sums(in_word, off)
    classes = class_counts(data, off)
    symbols = classes[:, 4] + classes[:, 5]
    holds = np.zeros(len(lines.start), bool)
    holds[np.searchsorted(lines.start, words.start, side="right") - 1] = True
    key = mix(lines.hash ^ mix(lines.doc.astype(np.uint64) + np.uint64(1)))[holds]
    doc = lines.doc[holds]
    full_lines = np.bincount(doc, minlength=len(n))
    _, once = np.unique(key, return_index=True)
    dup = full_lines - np.bincount(doc[once], minlength=len(n))
    repeat = sums(repeated_words(words), words.first)
    some, some_chars, some_lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(full_lines, 1)
    features = np.column_stack([
        np.log1p(n), chars / some, symbols / some_chars, dup / some_lines, repeat / some, classes[:, 1] / some_chars,
        classes[:, 2] / some_chars, classes[:, 3] / some, classes[:, 4] / some, n / some_lines,
    ])
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "features": features}


class Trees:
    """Boosted trees as flat node arrays."""

    def __init__(self, feature, threshold, left, right, value, roots, start: float, depth: int):
        self.feature, self.threshold, self.left, self.right, self.value = (np.asarray(x) for x in (feature, threshold, left, right, value))
        self.roots, self.start, self.depth = np.asarray(roots), start, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), 1.0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):  # leaves point at themselves
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def boost(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on binned features; the score never rises with a falling feature."""
    if not len(y) or y.min() == y.max():
        return Trees([], [], [], [], [], [], 0.0, 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v * rate)
        return k

    def grow(rows, g, h, level, low, high) -> int:
        best = lambda a, b: np.clip(-a / (b + ridge), low, high)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        top = (1e-6, None)
        if level < depth and len(rows) >= 10:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                hg = np.cumsum(np.bincount(binned[j][rows], g[rows], len(c) + 1))[:-1]
                hh = np.cumsum(np.bincount(binned[j][rows], h[rows], len(c) + 1))[:-1]
                vl, vr = best(hg, hh), best(total_g - hg, total_h - hh)
                gain = hg**2 / (hh + ridge) + (total_g - hg) ** 2 / (total_h - hh + ridge) - total_g**2 / (total_h + ridge)
                gain[(hh < 0.5) | (total_h - hh < 0.5)] = -1
                if j in falling:
                    gain[vl < vr] = -1
                k = int(np.argmax(gain))
                if gain[k] > top[0]:
                    top = (gain[k], j, k, float(vl[k]), float(vr[k]))
        if top[1] is None:
            v = float(best(total_g, total_h))
            margin[rows] += v * rate
            return leaf(v)
        _, j, k, vl, vr = top
        node = leaf(0.0)
        mid = (vl + vr) / 2
        a, b = ((mid, high), (low, mid)) if j in falling else ((low, high), (low, high))
        goes = binned[j][rows] <= k
        feature[node], threshold[node] = j, float(cuts[j][k])
        left[node] = grow(rows[goes], g, h, level + 1, *a)
        right[node] = grow(rows[~goes], g, h, level + 1, *b)
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
    return Trees(feature, threshold, left, right, value, roots, start, depth)


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from at most max_train labelled rows of docs (doc_id, text)."""
    def features(texts):
        return (pa.array(list(statistics(texts)["features"]), pa.list_(pa.float64())),)

    rows = sample(docs, labelled(labels, max_train), features, "x array<double>").select("quality", "x").collect()  # at most max_train rows
    x = np.array([r["x"] for r in rows]) if rows else np.zeros((0, len(FEATURES)))
    return boost(x, np.array([r["quality"] for r in rows], float), tuple(FEATURES.index(f) for f in FALLING))


def apply(docs: DataFrame, trees: Trees, *, keep_from: float = KEEP_FROM) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = statistics(part.column("text"))
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                score = sent.value.score(s["features"])
                cols = [part.column("doc_id"), *(pa.array(s[c], pa.int64()) for c in counts), pa.array(failed), pa.array(~failed & (score >= keep_from)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *counts, "base_failed", "kept", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, table(spark, sf_dir, "labels")))
