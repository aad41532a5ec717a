"""String similarity: the normalised indel ratio 2 * LCS / (len a + len b), on strings and on sorted tokens.

``ratio`` is a Column expression (two nested folds over characters) for few, short strings such as
distinct names. ``ratio_udf`` gives the same numbers from Arrow batches with a bit-parallel LCS.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit of a big integer for each character of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def plain_ratio(a: str, b: str) -> float:
    """0 to 1; 1 for equal strings, 0 if just one is empty."""
    if a == b:
        return 1.0
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def plain_token_sort(a: str | None, b: str | None) -> float:
    """0 to 1 on blank-separated tokens in code point order; 0 if one is missing."""
    return plain_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) if a and b else 0.0


def plain_partial(a: str, b: str) -> float:
    """Best ratio of the shorter string against windows of its length, and shorter ones at the ends, of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        if part and part[0 if i < 0 else -1] in short:
            best = max(best, plain_ratio(short, part))
            if best == 1.0:
                break
    return best


@arrow("double")
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else plain_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@arrow("double")
def partial_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else plain_partial(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sorted(c: Column) -> Column:
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.array_sort(words), " ")


def lcs(a: Column, b: Column) -> Column:
    """LCS length as folds: one row of the table for each character of a."""
    from .text import let

    return let(F.split(b, ""), lambda right: _lcs(F.split(a, ""), right))


def _lcs(left: Column, right: Column) -> Column:
    zero = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))

    def row(above: Column, c: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("row"), F.lit(0).alias("last"))

        def cell(acc: Column, j: Column) -> Column:
            here = F.when(F.get(right, j - 1) == c, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), acc["last"]))
            return F.struct(F.concat(acc["row"], F.array(here)).alias("row"), here.alias("last"))

        return F.aggregate(F.sequence(F.lit(1), F.size(right)), start, cell, lambda acc: acc["row"])

    return F.aggregate(left, zero, row, lambda last: F.element_at(last, -1))


def ratio(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(2.0 * lcs(a, b) / (F.length(a) + F.length(b)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 1; 0 if one is missing or empty."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), ratio(token_sorted(a), token_sorted(b))).otherwise(0.0)


#: 64-bit words of a signature.
WORDS = 2


def signature(c: Column) -> Column:
    """A bit for each character and number of its repeat: bits that only one string has are characters it does not share."""
    chars = F.array_sort(F.split(c, ""))
    place = F.transform(chars, lambda x, i: F.pmod(F.xxhash64(x, i - F.array_position(chars, x)), F.lit(64 * WORDS)))
    word = lambda k: F.aggregate(place, F.lit(0).cast("long"), lambda acc, p: F.when(F.floor(p / 64) == k, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")))).otherwise(acc))
    return F.struct(*[word(k).alias(f"w{k}") for k in range(WORDS)])


def may_reach(n: Column, nb: Column, sig: Column, sig_b: Column, least: float) -> Column:
    """False only where the ratio can't reach least: the LCS of strings of lengths n and nb leaves out characters not shared."""
    alone = lambda x, y: sum((F.bit_count(x[f"w{k}"].bitwiseAND(F.bitwise_not(y[f"w{k}"]))) for k in range(WORDS)), F.lit(0))
    return 2 * F.least(n - alone(sig, sig_b), nb - alone(sig_b, sig)) >= least * (n + nb) - 1e-9
