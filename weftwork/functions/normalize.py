"""Normalizers: pure Column functions that pass null and blank values through and give the same result twice."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .arrow import arrow
from .fuzzy import plain_token_sort
from .text import digits, first_by, found, lookup, squeeze, strip


def kept_blank(c: Column, out: Column) -> Column:
    """out, but null and blank values as they are."""
    return F.when(F.length(strip(c)) > 0, out).otherwise(c)


def email(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.lower(strip(c))).otherwise(c)


@arrow("string")
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def name(c: Column, compatibility: bool = True) -> Column:
    """Capitalised words, particles in lower case unless first, initials kept; NFKC only where a character is not ASCII."""
    text = F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c) if compatibility else c
    words = F.split(squeeze(text), " ")

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        initial = F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(low, 2, 1 << 30))
        return F.when((i > 0) & low.isin(*V.NAME_PARTICLES), low).when(w.rlike(r"^[a-zA-Z]\.$"), initial).otherwise(capital)

    return kept_blank(c, F.array_join(F.transform(words, word), " "))


def phone(c: Column, region: str = "IN") -> Column:
    """E.164 for Indian and North American numbers and for any number with +; others stripped.

    This is the part of numbering plans that needs no library: a number with + keeps its digits; IN takes 10
    digits, 0 and 10, or 91 and 10; US and CA take 10, or 1 and 10."""
    text, n = strip(c), digits(c)
    international = text.rlike(r"^\(?\s*\+") & F.length(n).between(7, 15)
    if region == "IN":
        local = F.when(F.length(n) == 10, F.concat(F.lit("+91"), n)).when((F.length(n) == 11) & n.startswith("0"), F.concat(F.lit("+91"), F.substring(n, 2, 10))).when((F.length(n) == 12) & n.startswith("91"), F.concat(F.lit("+"), n))
    elif region in ("US", "CA"):
        local = F.when(F.length(n) == 10, F.concat(F.lit("+1"), n)).when((F.length(n) == 11) & n.startswith("1"), F.concat(F.lit("+"), n))
    else:
        local = F.lit(None).cast("string")
    written = ~text.rlike("[A-Za-z]")
    return F.when(F.length(c) > 0, F.when(F.length(n) < 7, text).when(international & written, F.concat(F.lit("+"), n)).when(written, F.coalesce(local, text)).otherwise(text)).otherwise(c)


_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH_NUMBERS = {name[:size]: str(k) for k, name in enumerate(_MONTHS, 1) for size in (3, len(name))}


def year_month(c: Column) -> Column:
    """YYYY-MM of the layouts that are read in the JVM, null for others: the text's shape says where year, month and
    day stand, and one cast checks them. The month comes first where a date could be read in two ways."""
    month = lookup(F.regexp_extract(c, "[A-Z][a-z]+", 0), MONTH_NUMBERS)
    day, year = F.regexp_extract(c, r"\b(\d{1,2})\b", 1), F.regexp_extract(c, r"\d{4}", 0)
    iso = F.when(c.rlike(r"^\d{4}[-/]\d{1,2}$"), F.concat(F.replace(c, F.lit("/"), F.lit("-")), F.lit("-1")))
    for shape, order in ((r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"), (r"^(\d{1,2})[-/](\d{4})$", "$2-$1-1"), (r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$", "$4-$1-$3")):
        iso = iso.when(c.rlike(shape), F.regexp_replace(c, shape, order))
    iso = iso.when(c.rlike(r"^[A-Z][a-z]+ \d{4}$"), F.concat(year, F.lit("-"), month, F.lit("-1")))
    iso = iso.when(c.rlike(r"^(\d{1,2} [A-Z][a-z]+|[A-Z][a-z]+ \d{1,2}) \d{4}$"), F.concat(year, F.lit("-"), month, F.lit("-"), day))
    return F.substring(iso.try_cast("date").cast("string"), 1, 7)


@arrow("string")
def _other_date(c: pd.Series) -> pd.Series:
    from datetime import datetime

    from dateutil import parser

    def read(x):
        try:
            return None if x is None else parser.parse(x, default=datetime(2000, 1, 1)).strftime("%Y-%m")
        except (ValueError, OverflowError, TypeError):
            return None

    return c.map(read)


def date(c: Column, other_layouts: bool = True) -> Column:
    """YYYY or YYYY-MM; null for ongoing; unreadable dates stripped. Layouts not listed are read from Arrow batches."""
    text = strip(c)
    plain = F.regexp_replace(F.regexp_replace(F.initcap(F.regexp_replace(text, ",", " ")), r"\bSept\b", "Sep"), r"\s+", " ")
    read = year_month(plain)
    other = _other_date(F.when(read.isNull() & text.rlike(r"\d"), text)) if other_layouts else F.lit(None).cast("string")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, c).when(found(text, rf"^(?:{V.PRESENT})$"), F.lit(None).cast("string")).when(text.rlike(r"^\d{4}$"), text).otherwise(F.coalesce(read, other, text))


def url(c: Column) -> Column:
    """With a scheme; scheme and host in lower case; no / at the end of a path, / for none."""
    text = strip(c)
    text = F.when(text.startswith("http://") | text.startswith("https://"), text).otherwise(F.concat(F.lit("https://"), text))
    parts = r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(.*)$"
    part = lambda k: F.regexp_extract(text, parts, k)
    # parameters after ; of the last path segment are no part of the path
    path, params = F.regexp_extract(part(3), r"(?s)^(.*?)(;[^/;]*)?$", 1), F.regexp_extract(part(3), r"(?s)^(.*?)(;[^/;]*)?$", 2)
    clean = F.regexp_replace(path, r"/+$", "")
    return kept_blank(c, F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(F.length(clean) == 0, "/").otherwise(clean), params, F.regexp_replace(part(4), r"^[?#]$|[?#]$", "")))


def synonym_index(groups: dict[str, list[str]]) -> dict[str, str]:
    return {x.lower(): canonical for canonical, names in groups.items() for x in [canonical, *names]}


def skill_synonyms(items: Column, groups: dict[str, list[str]], case_sensitive: bool = False) -> Column:
    """Canonical names, then no repeats."""
    index = synonym_index(groups)
    named = F.transform(items, lambda s: F.coalesce(lookup(F.lower(s), index), s)) if index else items
    return F.array_distinct(named) if case_sensitive else first_by(named, lambda s: F.lower(s))


def _keep_apart(xs) -> list[str]:
    out: list[str] = []
    for x in xs:
        if all(plain_token_sort(x.lower(), y.lower()) < 0.85 for y in out):
            out.append(x)
    return out


@arrow("array<string>")
def near_distinct(items: pd.Series) -> pd.Series:
    """Without skills that come near (85 %) one kept before."""
    return items.map(lambda xs: None if xs is None else _keep_apart(xs))


def skills(items: Column, groups: dict[str, list[str]], case_sensitive: bool = False) -> Column:
    """Canonical names without repeats and near repeats. Lists of two or more go to one Arrow function whole: its
    argument stays a plain column, as Spark can't plan Arrow functions of nested lambdas."""
    index = synonym_index(groups)

    def tidy(lists: pd.Series) -> pd.Series:
        def one(xs):
            if xs is None:
                return None
            named: dict[str, str] = {}
            for s in (index.get(x.lower(), x) for x in xs):
                named.setdefault(s if case_sensitive else s.lower(), s)
            return _keep_apart(named.values())

        return lists.map(one)

    return F.when(F.size(items) < 2, skill_synonyms(items, groups, case_sensitive)).otherwise(F.pandas_udf(tidy, "array<string>")(F.when(F.size(items) > 1, items)))


# Forms that are compared, never shown


def similarity_text(c: Column) -> Column:
    """Lower case, letters, digits and _ only, single blanks."""
    return squeeze(F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s]", ""))


def phone_digits(c: Column) -> Column:
    n = digits(c)
    return F.when((F.length(n) > 10) & n.startswith("0"), F.substring(n, 2, 1 << 30)).otherwise(n)


def location(c: Column, aliases: dict[str, str] | None = None) -> Column:
    aliases = V.LOCATION_ALIASES if aliases is None else aliases
    text = similarity_text(c)
    if not aliases:
        return text
    tokens = F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(lookup(t, aliases), t)), " ")
    return F.coalesce(lookup(tokens, aliases), tokens)


def degree(c: Column) -> Column:
    """Degree without subject, by its long name where the first word is a known abbreviation."""
    clean = strip(F.lower(F.regexp_replace(c, r"(?<=[A-Za-z])\.(?=[A-Za-z])", "")))
    core = strip(F.regexp_replace(clean, r"(?U)[,(].*$|\s+in\s+.*$", ""))
    first = F.regexp_extract(F.regexp_replace(core, r"[^a-z\s]", ""), r"^([a-z]+)", 1)
    return F.coalesce(lookup(first, V.DEGREES), F.when(F.length(core) > 0, core), clean, F.lit(""))


def longer(a: Column, b: Column) -> Column:
    """The longer text, the first one of equals."""
    return F.when(F.coalesce(F.length(a), F.lit(0)) == 0, b).when(F.coalesce(F.length(b), F.lit(0)) > F.length(a), b).otherwise(a)
