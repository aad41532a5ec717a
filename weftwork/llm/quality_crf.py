r"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every non-empty line is labelled good or bad. Its features are shares of character classes, word
lengths and repeats, of itself and of its two neighbours; one 2 x 2 table scores neighbouring labels.
Forward-backward gives each line's probability of being good, the length-weighted mean of these is the
document's value, and a logistic curve fitted on the training documents turns it into a probability.

Forward-backward runs over all lines of a slice at once: the messages are products of 2 x 2 matrices, and
a prefix scan doubles its reach in each step; at the first line of a text the transition is uniform, so
nothing passes from one text to the next.

Labels are learnt from at most ``max_train`` labelled rows outside the held-out fold (the smallest hashes
of doc_id), of which those are taken, in this order, whose lines fit into ``max_lines``; texts are taken whole or not
at all. Of rows that share a doc_id, the one with the smallest hash of its text counts. A line starts with its
document's label, and lines of bad documents that the first fit takes for good ones are relabelled before the second.
The likelihood is convex; BFGS steps from a Fisher preconditioner stop when it no longer rises. Labels, lang, source
and doc_id are never inputs.

Scale: one narrow pass over whole texts, no shuffle; sample ids (bounded) and weights are broadcast. The
fit takes at most max_lines lines to the driver, 35 four-byte values each (42 MB); messages are kept for a block of texts.

Defined results: texts without a non-empty line get the share of good documents in the sample (1 without
a sample); repeated rows are rows of their own; null doc_ids are not held out; extra columns stay as they are, but
score() replaces columns named score and predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LINES, SPACED, Scan, drop_shared, flat, labelled, sample, slices, sums, table, write_shared
from .quality_rules import class_counts, repeated_words

MAX_TRAIN, MAX_LINES, FOLDS, THRESHOLD, BLOCK_LINES = 4000, 300_000, 5, 0.3, 1 << 18
N_OWN = 11


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each non-empty line: its features with its neighbours', its text, its length in bytes."""
    data, off = flat(column)
    lines, words = Scan(data, off, LINES, hashed=False), Scan(data, off, SPACED)
    n = len(lines.start)
    if not n:
        return np.zeros((0, 3 * N_OWN + 2)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.append(lines.start, len(data))  # a line's span takes the line break after it
    classes = class_counts(data, edges)
    size = lines.end - lines.start
    first = np.searchsorted(words.start, edges)
    count = np.diff(first)
    some = np.maximum(count, 1)
    again = np.zeros(len(words.start), bool)
    if len(again) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = repeated_words(words)
    capped = np.zeros(len(words.start), bool)
    head = data[words.start]
    capped[:] = (head >= 65) & (head <= 90)
    per = size.astype(float)
    own = np.column_stack([
        np.log1p(size) / 6, np.log1p(count) / 4, np.minimum(per / some, 30) / 10, classes[:, 1] / per * 4, classes[:, 2] / per * 10,
        np.minimum(classes[:, 3] / some, 2) * 4, np.minimum(classes[:, 4] / some, 1) * 4, np.minimum(classes[:, 5] / some, 2) * 4,
        sums(again, first) / some * 4, sums(repeats, first) / some * 4, sums(capped, first) / some,
    ])
    start, stop = np.ones(n, bool), np.ones(n, bool)
    start[1:] = lines.doc[1:] != lines.doc[:-1]
    stop[:-1] = start[1:]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[start], after[stop] = 0, 0
    return np.column_stack([own, before, after, start, stop]), lines.doc, size


def _scan(m: np.ndarray, steps: int) -> np.ndarray:
    """Normalised products m[i-k] ... m[i] back to the start of a chain of at most 2**steps matrices."""
    for k in range(steps):
        d = 1 << k
        if d >= len(m):
            break
        m[d:] = m[:-d] @ m[d:]
        m /= m.sum((1, 2), keepdims=True)
    return m


def forward_backward(u: np.ndarray, a: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u: log-odds of good for each line alone; a: log transition table. Marginals of good, and pair marginals (zero at first lines)."""
    n = len(u)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    start = np.ones(n, bool)
    start[1:] = doc[1:] != doc[:-1]
    edge = np.append(np.flatnonzero(start), n)
    if n > BLOCK_LINES and len(edge) > 2:  # texts do not touch each other
        cut = min(max(int(np.searchsorted(edge, n // 2)), 1), len(edge) - 2)
        parts = [forward_backward(u[s], a, doc[s]) for s in (slice(0, edge[cut]), slice(edge[cut], n))]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    steps = int(np.diff(edge).max() - 1).bit_length() + 1
    p = 1 / (1 + np.exp(-np.clip(u, -30, 30)))
    psi = np.maximum(np.column_stack([1 - p, p]), 1e-12)
    trans = np.broadcast_to(np.exp(a - a.max()), (n, 2, 2)).copy()
    trans[start] = 1.0
    alpha = _scan(trans * psi[:, None, :], steps).sum(1)
    alpha /= alpha.sum(1, keepdims=True)
    nxt = np.ones((n, 2, 2))
    nxt[:-1] = trans[1:] * psi[1:, None, :]
    # backward: the products nxt[i] nxt[i+1] ... read from the other end, transposed
    beta = _scan(np.ascontiguousarray(nxt[::-1].transpose(0, 2, 1)), steps)[::-1].transpose(0, 2, 1).sum(2)
    beta /= beta.sum(1, keepdims=True)
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    pair[1:] = alpha[:-1, :, None] * trans[1:] * (psi * beta)[1:, None, :]
    pair[start] = 0
    total = pair.sum((1, 2), keepdims=True)
    pair = np.divide(pair, total, out=np.zeros_like(pair), where=total > 0)
    return both[:, 1], pair


class Model:
    def __init__(self, w, a, curve, empty):
        self.w, self.a, self.curve, self.empty = w, a, curve, empty

    def lines(self, x, doc):
        return forward_backward(x @ self.w[1:] + self.w[0], self.a, doc)[0]

    def documents(self, x, doc, size, n_docs: int) -> np.ndarray:
        if self.curve is None:  # labels of one kind only
            return np.full(n_docs, self.empty)
        good = self.lines(x, doc)
        total = np.bincount(doc, size, n_docs)
        mean = np.bincount(doc, size * good, n_docs) / np.maximum(total, 1)
        return np.where(total > 0, curve(mean, self.curve), self.empty)


def curve(mean: np.ndarray, c: tuple[float, float]) -> np.ndarray:
    z = np.log((mean + 0.01) / (1.01 - mean))
    return 1 / (1 + np.exp(-np.clip(c[0] + c[1] * z, -30, 30)))


def log_likelihood(good: np.ndarray, pair: np.ndarray, y: np.ndarray, inside: np.ndarray) -> float:
    """Of labels y, from the marginals: a chain's probability is that of its first label times those of each next one given the last."""
    own = np.where(y == 1, good, 1 - good)
    step = np.flatnonzero(inside)
    total = np.log(np.maximum(own[~inside], 1e-300)).sum()
    return total + np.log(np.maximum(pair[step, y[step - 1], y[step]], 1e-300)).sum() - np.log(np.maximum(own[step - 1], 1e-300)).sum()


def _fit_lines(x, y, doc, rounds: int = 60, ridge: float = 1e-3, enough: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the line labels with a ridge: BFGS, the step halved until the loss falls."""
    xb = np.column_stack([np.ones(len(x), x.dtype), x])
    inside = np.zeros(len(y), bool)
    inside[1:] = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)

    def loss(theta):
        good, pair = forward_backward((xb @ theta[:-4].astype(xb.dtype)).astype(float), theta[-4:].reshape(2, 2), doc)
        value = -log_likelihood(good, pair, y, inside) / len(y) + ridge / 2 * theta @ theta
        return value, np.concatenate([xb.T @ (good - y).astype(xb.dtype), (pair.sum(0) - seen).ravel()]) / len(y) + ridge * theta, good

    theta = np.zeros(xb.shape[1] + 4)
    value, grad, good = loss(theta)
    # of lines that don't depend on each other, and of pairs alike: where the steps' metric starts from
    fisher = xb.T @ (xb * (good * (1 - good)).astype(xb.dtype)[:, None]) / len(y)
    inverse = np.eye(len(theta))
    inverse[:-4, :-4] = np.linalg.inv(fisher + (ridge + 1e-3) * np.eye(len(fisher)))
    for _ in range(rounds):
        way = -inverse @ grad
        slope = way @ grad
        size = 1.0
        while size > 1e-6:
            new = theta + size * way
            new_value, new_grad, _ = loss(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, d = new - theta, new_grad - grad
        theta, grad, fell, value = new, new_grad, value - new_value, new_value
        if fell < enough * max(abs(value), 1e-3):
            break
        if (sd := s @ d) > 1e-12:
            hd = inverse @ d
            inverse += ((sd + d @ hd) / sd**2) * np.outer(s, s) - (np.outer(hd, s) + np.outer(s, hd)) / sd
    return theta[:-4], theta[-4:].reshape(2, 2)


def _fit_curve(mean: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one value, by Newton steps with a weak prior."""
    z = np.log((mean + 0.01) / (1.01 - mean))
    x, c = np.column_stack([np.ones(len(z)), z]), np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        c = c - np.clip(np.linalg.solve(h, x.T @ (p - y) + 0.1 * (c - [0, 1])), -2, 2)
    return float(c[0]), float(c[1])


def train(x: np.ndarray, label: np.ndarray, doc: np.ndarray, size: np.ndarray, doc_label: np.ndarray) -> Model:
    """label: of each line; doc_label: of each document."""
    share = float(doc_label.mean()) if len(doc_label) else 1.0
    if not len(x) or doc_label.min() == doc_label.max():
        return Model(np.zeros(3 * N_OWN + 3), np.zeros((2, 2)), None, share)
    w, a = _fit_lines(x, label, doc)
    good = forward_backward(x @ w[1:] + w[0], np.zeros((2, 2)), doc)[0]
    worst = np.ones(len(doc_label))
    np.minimum.at(worst, doc, good)
    again = np.where((label == 0) & (good > 0.9) & (worst[doc] < 0.5), 1, label)
    w, a = _fit_lines(x, again, doc)
    model = Model(w, a, (0.0, 1.0), share)
    total = np.bincount(doc, size, len(doc_label))
    mean = np.bincount(doc, size * model.lines(x, doc), len(doc_label)) / np.maximum(total, 1)
    model.curve = _fit_curve(mean[total > 0], doc_label[total > 0])
    return model


def fold(key) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> Model:
    """From at most max_train labelled rows and max_lines lines; a text counts with all its lines or not at all."""

    def features(texts):
        x, doc, size = line_features(texts)
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        parts = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        x, size = x.astype("<f4"), size.astype("<i8")
        return pa.array([b - a for a, b in parts], pa.int64()), pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([size[a:b].tobytes() for a, b in parts], pa.binary())

    some = labelled(labels.where(fold(F.col("doc_id")) != 0), max_train)
    kept = write_shared(sample(docs, some, features, "lines long, x binary, size binary"), "quality-sample")
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    chosen, total = [], 0
    for r in kept.where("lines > 0").select("doc_id", "quality", "lines").orderBy(*order).collect():  # at most max_train rows
        if total + r["lines"] <= max_lines:
            total += r["lines"]
            chosen.append((r["doc_id"], r["quality"]))
    if not chosen:
        drop_shared(kept)
        return train(np.zeros((0, 3 * N_OWN + 2), np.float32), np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    wanted = docs.sparkSession.createDataFrame(chosen, kept.select("doc_id", "quality").schema)
    rows = kept.join(F.broadcast(wanted), ["doc_id", "quality"], "left_semi").orderBy(*order).select("quality", "x", "size").collect()
    drop_shared(kept)
    size = [np.frombuffer(r["size"], "<i8") for r in rows]
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(len(n), -1) for r, n in zip(rows, size)])
    doc = np.repeat(np.arange(len(rows)), [len(n) for n in size])
    label = np.array([r["quality"] for r in rows])
    return train(x, label[doc], doc, np.concatenate(size), label)


def _scored(docs: DataFrame, text: str, model: Model, threshold: float) -> DataFrame:
    """docs, none of whose columns is named score or predicted, with both added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                x, doc, size = line_features(part.column(text))
                s = sent.value.documents(x, doc, size, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted added, in place of columns of these names."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    inner = [f"c{i}" for i in range(len(kept))]
    plain = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)])
    return _scored(plain, inner[kept.index("text")], model, threshold).toDF(*kept, "score", "predicted")


def good_ones(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model takes for good ones, with the columns they have."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names can't clash with ours
    found = _scored(docs.toDF(*inner), inner[docs.columns.index("text")], model, threshold).where("predicted = 1")
    return found.select(*inner).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
