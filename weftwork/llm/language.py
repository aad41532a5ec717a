r"""Language identification by string kernels.

The kernel of two texts is the normalised number of n-grams (1 to 3 bytes of the lower-cased text, white
space and digits as one blank) present in both: a blended-spectrum presence kernel, over 2**16 hashed
n-grams. Nystroem landmarks taken evenly from the languages give each text a short vector, and one-versus-rest
kernel ridge regression gives each language a margin. Texts are scored in batches: a presence matrix
times the landmarks' presence matrix, then times the folded map from kernel values to margins.

Learning takes about ``per_lang`` rows of each language outside the held-out fold, chosen by a hash of doc_id, fewer
where all languages would have more than ``max_train`` rows; of more than ``max_langs`` languages the commonest are
learnt. Only text and non-null lang of those rows are used.

Scale: two passes over narrow columns for the sample, one pass over whole texts, no shuffle but tiny
counts; the broadcast model is fixed in size (landmarks x 2**16 bits).

Defined results: lang_pred is 'und' with score 0 if the text is null or has no letter, or if nothing was
learnt; ties go to the language first in order; repeated rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, slices, table

PER_LANG, MAX_TRAIN, MAX_LANGS, LANDMARKS, RIDGE, BITS, BATCH, FOLDS, HELD = 400, 8000, 256, 96, 1e-2, 16, 64, 4, 2
SPACE = 1 << BITS

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = _FOLD[123:128] = 32


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; ASCII other than letters becomes a blank. Latin-1 capitals after byte C3 are lowered too."""
    out = _FOLD[data]
    if len(data) > 1:
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[second] += 0x20
    return out


def grams(text: np.ndarray) -> np.ndarray:
    """Hashed n-grams of one folded text, blanks around it; with repeats."""
    t = np.full(len(text) + 2, 32, np.uint32)
    t[1:-1] = text
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != 32) | (t[:-1] != 32)  # runs of blanks as one
    t = t[keep]
    two = (t[:-1] << np.uint32(8)) | t[1:]
    three = (two[:-1] << np.uint32(8)) | t[2:]
    code = np.concatenate([t, two | np.uint32(1 << 24), three | np.uint32(2 << 24)])
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def letters(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model:
    """langs; marks: landmark presence (SPACE x landmarks, float32); sizes of the landmarks' sets; map: kernel values to margins."""

    def __init__(self, langs: list[str], sets: list[np.ndarray], labels: list[int], landmarks: int, ridge: float):
        self.langs = langs
        by: dict[int, list[int]] = {}
        for i, y in enumerate(labels):
            by.setdefault(y, []).append(i)
        turns = [q[k] for k in range(max(map(len, by.values()), default=0)) for q in by.values() if k < len(q)]
        chosen = turns[:landmarks]
        self.marks = np.zeros((SPACE, len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            self.marks[sets[i], j] = 1
        self.sizes = np.sqrt(self.marks.sum(0))
        k = np.vstack([self.kernel(self.presence(sets[i : i + BATCH])) for i in range(0, len(sets), BATCH)])
        w, v = np.linalg.eigh(k[chosen].astype(float))
        good = w > 1e-6
        half = v[:, good] / np.sqrt(w[good])
        phi = np.column_stack([k @ half, np.ones(len(k))])
        target = np.where(np.array(labels)[:, None] == np.arange(len(langs)), 1.0, -1.0)
        # each language weighs the same
        weight = (1 / np.bincount(labels, minlength=len(langs)))[labels] * len(labels) / len(langs)
        beta = np.linalg.solve((phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ target)
        self.map, self.bias = (half @ beta[:-1]).astype(np.float32), beta[-1]

    @staticmethod
    def presence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), SPACE), np.float32)
        for i, s in enumerate(sets):
            out[i, s] = 1
        return out

    def kernel(self, p: np.ndarray) -> np.ndarray:
        return (p @ self.marks) / (np.sqrt(np.maximum(p.sum(1), 1))[:, None] * self.sizes[None, :])

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(self.presence(sets)) @ self.map + self.bias

    def __getstate__(self):
        return self.__dict__ | {"marks": (np.packbits(self.marks.astype(bool)), self.marks.shape)}

    def __setstate__(self, state):
        bits, shape = state["marks"]
        state["marks"] = np.unpackbits(bits)[: shape[0] * shape[1]].reshape(shape).astype(np.float32)
        self.__dict__.update(state)


def fold(key) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, *, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE, max_train: int = MAX_TRAIN, max_langs: int = MAX_LANGS) -> Model | None:
    own = docs.where((fold(F.col("doc_id")) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not counts:
        return None
    per_lang = min(per_lang, max(1, max_train // len(counts)))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_lang / n))])

    def sets(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column("text"))
                data = folded(data)
                bits = []
                for i in range(part.num_rows):
                    p = np.zeros(SPACE, bool)
                    p[grams(data[off[i] : off[i + 1]])] = True
                    bits.append(np.packbits(p).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # about max_train rows at most, 8 KB each
    rows = own.where(share < most[F.col("lang")]).select("doc_id", "lang", "text").mapInArrow(sets, f"doc_id {kind}, lang string, bits binary").toPandas().sort_values("doc_id", kind="stable")
    if not len(rows):
        return None
    langs = sorted(set(rows["lang"]))
    found = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) for b in rows["bits"]]
    return Model(langs, found, [langs.index(x) for x in rows["lang"]], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = flat(part.column("text"))
                low = folded(data)
                latin = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
                known = latin[off[1:]] > latin[off[:-1]]
                for i in np.flatnonzero(~known & (off[1:] > off[:-1])).tolist():
                    known[i] = letters(part.column("text")[i].as_py())
                names, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                rows = np.flatnonzero(known).tolist() if sent.value is not None else []
                for k in range(0, len(rows), BATCH):
                    some = rows[k : k + BATCH]
                    m = sent.value.margins([grams(low[off[i] : off[i + 1]]) for i in some])
                    best = m.argmax(1)
                    for i, b, v in zip(some, best.tolist(), m.max(1).tolist()):
                        names[i], score[i] = sent.value.langs[b], min(1.0, max(0.0, (v + 1) / 2))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.select("doc_id", "lang", "text")))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
