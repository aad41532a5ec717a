r"""Packing of tokenised documents by non-negative least squares over fill patterns.

Documents become full windows and one tail each. The tails' length histogram (at most window - 1 counts)
is all that the driver sees: it enumerates shallow combinations of lengths that fill a window exactly,
solves how often to repeat each by non-negative least squares against the histogram, rounds down, and
packs the residual counts greedily, cutting a tail only to close a gap. The plan is a list of runs: so
many equal sequences made of such and such slices of tails, numbered within their length class.

Scale: texts are tokenised once and the ids written to the shared folder; rows are then numbered within
(length class, bucket) groups of bounded size - hot classes get many buckets - and the ids cross one
exchange. The driver's work and the broadcast plan depend on the window, not on the rows.

Defined results: a null text counts as empty, so it is the end id alone; repeated rows are documents of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, trim, write_shared

WINDOW, END, CACHE_WORDS, BUCKET_ROWS, NNLS_ROUNDS, STARTS = 2048, 1, 500_000, 50_000, 400, 96

# Pre-tokens of the tokenizer's own split over Latin text; anything else goes to the tokenizer whole.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRE = re.compile(rf"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTER}{_NUMBER}]+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]")


class Encoder:
    """ids of whole texts as little-endian unsigned bytes; pre-tokens are encoded once and kept."""

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        self.model, self.known, self.kind = Tokenizer.from_file(path), {}, f"<u{width}"
        self.special = tuple(t.content for t in self.model.get_added_tokens_decoder().values())

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """ids of pre-tokens, many at once: the tokenizer tells which pre-token each id is from."""
        out = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            x = self.model.encode(" ".join(some), add_special_tokens=False)
            own = np.array(x.word_ids)
            if not len(own) or own[-1] != len(some) - 1:
                out += [self.whole(w) for w in some]
                continue
            ids, cut = np.array(x.ids, self.kind).tobytes(), np.searchsorted(own, np.arange(len(some) + 1)) * int(self.kind[-1])
            out += [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _OTHER.search(text) or "<|" in text and any(s in text for s in self.special):
            return self.whole(text)
        words = _PRE.findall(unicodedata.normalize("NFC", text).lower())
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(known.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list({w for w in words if w not in self.known})
        self.known.update(zip(new, self.words(new)))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """One for each Python worker."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def tokenise(docs: DataFrame, path: str, end: int = END, width: int = 4, ids_bytes: int = 8 << 20) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned of width bytes), the end id last."""

    def run(batches):
        encode, tail = encoder(path, width), np.array([end], f"<u{width}").tobytes()
        for batch in batches:
            ids, keys, size = [], [], 0
            key = batch.column(0).to_pylist()
            for k, x in enumerate(batch.column(1)):
                ids.append(encode(x.as_py()) + tail)
                keys.append(key[k])
                size += len(ids[-1])
                if size > ids_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                    ids, keys, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def patterns(counts: np.ndarray, window: int, starts: int = STARTS) -> list[tuple[int, ...]]:
    """Combinations of two or three lengths, and of one length repeated, that fill the window exactly.

    Triples have two of the starts commonest lengths; what no pattern takes is packed greedily, so the bound drops no rows."""
    have = np.flatnonzero(counts)
    there = set(have.tolist())
    out = {(a, window - a) for a in there if window - a in there and a >= window - a}
    out |= {(a,) * (window // a) for a in there if window % a == 0 and window // a <= 8}
    top = have[np.argsort(-counts[have], kind="stable")][:starts]
    for i, a in enumerate(top.tolist()):
        for b in top[i:].tolist():
            if (c := window - a - b) > 0 and c in there:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out)


def nnls(combos: list[tuple[int, ...]], counts: np.ndarray, rounds: int = NNLS_ROUNDS) -> np.ndarray:
    """x >= 0 near the least squares of A x = counts, A[l, p] = times that l stands in pattern p: accelerated projected gradient."""
    if not combos:
        return np.zeros(0)
    row = np.array([n for c in combos for n in c])
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    n, m = len(counts), len(combos)
    target = counts.astype(float)
    # each length's row is scaled by 1 / sqrt(degree), so that a step of 1 / max(column length) is safe
    degree = np.maximum(np.bincount(row, minlength=n), 1)
    scale = 1 / degree
    x = y = np.zeros(m)
    step, t = 1 / max(len(c) for c in combos) ** 2, 1.0
    for _ in range(rounds):
        rest = np.bincount(row, y[col], n) - target
        new = np.maximum(0, y - step * np.bincount(col, (rest * scale)[row], m))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


class Plan:
    """Runs: (first sequence, repeats, slices), a slice being (length class, first rank, start in the tail, length, offset)."""

    def __init__(self, counts: np.ndarray, window: int):
        self.window, self.runs, self.sequences = window, [], 0
        left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
        combos = patterns(counts, window)
        x = np.floor(nnls(combos, counts) + 1e-6).astype(np.int64)
        for p in np.argsort(-x, kind="stable").tolist():
            need = np.bincount(combos[p], minlength=len(counts))
            own = np.flatnonzero(need)
            n = min(int(x[p]), int((left[own] // need[own]).min()))
            if n > 0:
                self._run(n, [(l, used[l] + k * n) for l in own.tolist() for k in range(need[l])])
                left[own] -= n * need[own]
                used[own] += n * need[own]
        self._greedy(left, used)

    def _run(self, n: int, parts: list[tuple[int, int]]) -> None:
        slices, at = [], 0
        for l, rank in parts:
            slices.append((l, int(rank), 0, l, at))
            at += l
        self.runs.append((self.sequences, n, slices))
        self.sequences += n

    def _greedy(self, left: np.ndarray, used: np.ndarray) -> None:
        """Lots of equal slices, the longest first; each gap takes the longest lot that fits, or cuts one to size."""
        lots: dict[int, list] = defaultdict(list)  # length -> [class, first rank, start, count]
        for l in np.flatnonzero(left).tolist():
            lots[l].append([l, int(used[l]), 0, int(left[l])])
        lengths = np.zeros(self.window + 1, bool)
        lengths[list(lots)] = True

        def longest(most: int) -> int:
            hit = np.flatnonzero(lengths[: most + 1])
            return int(hit[-1]) if len(hit) else 0

        while (l := longest(self.window)) > 0:
            picks, gap, times = [], self.window, None
            count: dict[int, int] = defaultdict(int)  # slices of the first lot of each length in this pattern
            while gap and (l := self._free(longest, lots, count, gap)):
                picks.append((l, l))
                count[l] += 1
                gap -= l
            cut = None
            if gap:
                l = self._free(longest, lots, count, self.window)
                if l > gap:
                    cut = l
                    count[l] += 1
            times = min(lots[l][0][3] // k for l, k in count.items())
            slices, at = [], 0
            for l, _ in picks:
                c, r, s, n = lots[l][0]
                slices.append((c, r, s, l, at))
                lots[l][0][1], lots[l][0][3] = r + times, n - times
                at += l
            if cut:
                c, r, s, n = lots[cut][0]
                slices.append((c, r, s, gap, at))
                lots[cut][0][1], lots[cut][0][3] = r + times, n - times
                lots[cut - gap].append([c, r, s + gap, times])
                lengths[cut - gap] = True
            self.runs.append((self.sequences, times, slices))
            self.sequences += times
            for l in count:
                if not lots[l][0][3]:
                    lots[l].pop(0)
                    if not lots[l]:
                        del lots[l]
                        lengths[l] = False

    @staticmethod
    def _free(longest, lots, count, most: int) -> int:
        """The longest length up to most whose first lot has another slice."""
        while (l := longest(most)) and count[l] >= lots[l][0][3]:
            most = l - 1
        return l

    def by_class(self) -> dict[int, tuple]:
        """Per length class its slices, by first rank: arrays of first rank, repeats, start, length, offset, sequence."""
        own: dict[int, list] = defaultdict(list)
        for first, n, slices in self.runs:
            for c, r, s, size, at in slices:
                own[c].append((r, n, s, size, at, first))
        return {c: np.array(sorted(x), np.int64) for c, x in own.items()}


def pack(tokens: DataFrame, *, window: int = WINDOW, width: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces of tokens (doc_id, ids of width bytes): doc_id, start, ids (of 4 bytes), doc_tokens, sequence_id, offset."""
    spark = tokens.sparkSession
    written = write_shared(tokens.select("doc_id", "ids", (F.octet_length("ids") / width).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")), "packing-ids")
    tail = (F.col("n") % window).cast("int")
    found = written.groupBy(tail.alias("c")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.floor(F.col("n") / window)).alias("w")).collect()
    counts, total, full = np.zeros(window, np.int64), 0, 0
    for x in found:
        total, full = total + x["k"], full + x["w"]
        if x["c"]:
            counts[x["c"]] = x["k"]
    plan = Plan(counts, window)
    # buckets of a class: enough that one holds at most about cap rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cap = max(1, min(bucket_rows, total // (4 * parts)))
    held = {x["c"]: x["k"] for x in found}
    many = [-(-held.get(c, 0) // cap) or 1 for c in range(window)]
    base = np.concatenate([[0], np.cumsum(many)])
    array = lambda v: F.array(*[F.lit(int(i)) for i in v])
    spread = F.create_map(*[F.lit(v) for c in range(window) if many[c] > 1 for v in (c, int(many[c]))]) if max(many) > 1 else None
    # the few classes with more than one bucket are listed in the plan; the others' bucket is 0
    salt = F.pmod(F.xxhash64("row"), F.coalesce(spread[tail], F.lit(1))).cast("int") if spread is not None else F.lit(0)
    keyed = written.withColumns({"c": tail, "salt": salt})
    per = {(x["c"], x["salt"]): (x["k"], x["w"]) for x in keyed.groupBy("c", "salt").agg(F.count(F.lit(1)).alias("k"), F.sum(F.floor(F.col("n") / window)).alias("w")).collect()}
    ranks, fulls = np.zeros(int(base[-1]), np.int64), np.zeros(int(base[-1]), np.int64)
    whole = plan.sequences
    for c in range(window):
        rank = 0
        for s in range(many[c]):
            ranks[base[c] + s], fulls[base[c] + s] = rank, whole
            k, w = per.get((c, s), (0, 0))
            rank, whole = rank + k, whole + w
    sent = spark.sparkContext.broadcast((base, ranks, fulls, plan.by_class()))  # bounded by the window and rows / bucket_rows
    order = W.partitionBy("c", "salt").orderBy("row")
    numbered = keyed.withColumns({"rank": F.row_number().over(order) - 1, "before": F.coalesce(F.sum(F.floor(F.col("n") / window)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})

    def run(batches):
        base, ranks, fulls, classes = sent.value
        for batch in batches:
            keys, rows = [], []
            col = {n: batch.column(n).to_pylist() for n in ("doc_id", "n", "c", "salt", "rank", "before")}
            for i, ids in enumerate(batch.column("ids")):
                ids = ids.as_buffer()
                n, c, b = col["n"][i], col["c"][i], int(base[col["c"][i]]) + col["salt"][i]
                top, first = n - c, int(fulls[b]) + col["before"][i]
                pieces = [(k * window, window, first + k, 0) for k in range(n // window)]
                if c:
                    rank, x = int(ranks[b]) + col["rank"][i], classes[c]
                    # slices of this class with first <= rank < first + repeats
                    for r, times, s, size, at, seq in x[(x[:, 0] <= rank) & (rank < x[:, 0] + x[:, 1])].tolist():
                        pieces.append((top + s, size, seq + rank - r, at))
                for s, size, seq, at in pieces:
                    keys.append(col["doc_id"][i])
                    rows.append((s, np.frombuffer(ids, f"<u{width}", size, width * s).astype("<u4").tobytes(), n, seq, at))
                if len(rows) > 2000:
                    yield _pieces(keys, rows, batch)
                    keys, rows = [], []
            yield _pieces(keys, rows, batch)

    kind = written.schema["doc_id"].dataType.simpleString()
    return numbered.select("doc_id", "ids", "n", "c", "salt", "rank", "before").mapInArrow(run, f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def _pieces(keys, rows, batch) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(keys, batch.column("doc_id").type), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, width: int = 2) -> DataFrame:
    """The digest of docs (doc_id, text) packed; ids below 2**16 take two bytes until they are packed."""
    return digest(pack(tokenise(docs, tokenizer_path(), width=width), width=width))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
