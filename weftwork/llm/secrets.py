r"""Secret scans with multipart credential linking.

Strong parts are reported wherever they stand: key assignments, access identifiers and long hex runs.
Weak parts - account names, endpoints and unlabelled high-entropy tokens - say little alone. All parts
of a text are intervals; an interval join inside each scope (the text, parts at most REACH code points
apart) links a weak part with complementary parts, which are of another kind and don't overlap it, and it
is reported only if one of its sets of complements is whole:

* ``token`` (mixed-class run of 20+ characters): a name (access identifier or account) and an endpoint, a name and
  an assignment, or an endpoint and an assignment;
* ``account``: an assignment, or an endpoint and a secret (hex run or token);
* ``endpoint``: a name and a secret (assignment, hex run or token).

So the address of a page that holds or stands near a hash is not reported for that.

The join sorts the ends of each kind once and bisects, so a text with k parts takes k log k steps, never k * k.

Defined results: a null text counts as empty and has no spans; repeated rows are rows of their own;
other columns are ignored. Spans count code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices, table

REACH = 400
KINDS = ("assign", "access", "hex", "account", "endpoint", "token")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ACCOUNT = re.compile(r"""(?<![A-Za-z])(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.A | re.I)
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+]{1,9}://[^\s\"'<>]{4,}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?(?![\d.])", re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Every assignment holds one of these after its key word.
_HAS_SIGN = re.compile(r"[:=]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong parts, leftmost and non-overlapping within each kind."""
    found = []
    if _HAS_SIGN.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a whole run of 24 or more is what HEX finds there, as runs are maximal
    found += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return found


#: For each weak kind, sets of complements; of each member of a set one kind must be in reach.
_NAME, _SECRET, _BARE = ("access", "account"), ("assign", "hex", "token"), ("hex", "token")
COMPLEMENTS = {
    "token": ((_NAME, ("endpoint",)), (_NAME, ("assign",)), (("endpoint",), ("assign",))),
    "account": ((("assign",),), (("endpoint",), _BARE)),
    "endpoint": ((_NAME, _SECRET),),
}


class _Intervals:
    """Intervals of one kind, ready for 'does one lie beside this interval, within reach and without overlap'."""

    def __init__(self, spans):
        self.starts, self.ends = sorted(a for _, a, _ in spans), sorted(b for _, _, b in spans)

    def beside(self, a: int, b: int, reach: int) -> bool:
        left, right = bisect_left(self.ends, a - reach), bisect_left(self.starts, b)
        return left < len(self.ends) and self.ends[left] <= a or right < len(self.starts) and self.starts[right] <= b + reach


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """Weak parts whose complements co-occur."""
    if ":" not in text and "=" not in text and "." not in text:
        return []
    accounts = [("account", *m.span()) for m in ACCOUNT.finditer(text)]
    endpoints = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not base and not (accounts and endpoints):
        return []
    weak = accounts + endpoints + _tokens(text, base)
    by: dict[str, list] = {k: [] for k in KINDS}
    for s in base + weak:
        by[s[0]].append(s)
    parts = {k: _Intervals(x) for k, x in by.items()}
    near = lambda s, kinds: any(parts[k].beside(s[1], s[2], reach) for k in kinds)
    return [s for s in weak if any(all(near(s, kinds) for kinds in whole) for whole in COMPLEMENTS[s[0]])]


_LOWER, _UPPER, _DIGIT = re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]")


def _tokens(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of letters of both cases and digits that overlap no strong part."""
    found = [("token", *m.span()) for m in TOKEN.finditer(text) if all(c.search(m[0]) for c in (_LOWER, _UPPER, _DIGIT))]
    if not found or not base:
        return found
    strong = sorted((a, b) for _, a, b in base)
    out, k, end = [], 0, 0
    for s in found:  # in order, as the strong parts are
        while k < len(strong) and strong[k][0] < s[2]:
            end = max(end, strong[k][1])
            k += 1
        if end <= s[1]:
            out.append(s)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """Per row of docs: key, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for x in part.column(1):
                    x = x.as_py()
                    base = base_spans(x) if x else []
                    weak = linked_spans(x, base, reach) if x else []
                    kinds = [s[0] for s in base]
                    rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + weak), len(weak)))
                cols = list(zip(*rows))
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[removed]") -> str:
    """text with each run of overlapping spans replaced by the mark."""
    out, done = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, *, reach: int = REACH) -> DataFrame:
    """docs with the secrets and linked parts of text replaced; n_chars, if there as a whole number, follows."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    size = next((i for i, f in enumerate(docs.schema.fields) if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)), None)

    def run(batches):
        for batch in batches:
            for part in slices(batch, inner[at]):
                cols, texts, changed = list(part.columns), [], []
                for x in cols[at]:
                    x = x.as_py()
                    spans = base_spans(x) if x else []
                    spans += linked_spans(x, spans, reach) if x else []
                    texts.append(redacted(x, spans) if spans else x)
                    changed.append(bool(spans))
                if any(changed):
                    cols[at] = pa.array(texts, pa.string())
                    if size is not None:
                        cols[size] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, cols[size].to_pylist())], cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, names=inner)

    plain = docs.toDF(*inner)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
