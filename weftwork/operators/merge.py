"""Survivorship: one golden record for each group, field by field.

Scalars and lists of scalars are aggregates (min_by, max_by) that combine before the shuffle. Lists of
experience and education are folded in a fixed order, as similar entries merge one after another; only
groups with two entries or more reach the Arrow function that does it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MergeRules
from ..functions import fuzzy as Z
from ..functions import normalize as N
from ..functions import text as X
from ..functions.arrow import arrow
from ..schema import EDUCATION, EXPERIENCE, LISTS, SCALARS

# Similarity from which entries are one.
COMPANY, STRONG_COMPANY, PART_OF_TITLE, INSTITUTION, DEGREE = 0.80, 0.90, 0.80, 0.80, 0.70


def rank(priority: tuple[str, ...], source: Column | None = None) -> Column:
    """Place of a source in a priority list; unlisted ones come last."""
    source = F.col("source") if source is None else source
    out = F.lit(len(priority))
    for k, s in reversed(list(enumerate(priority))):
        out = F.when(source == s, k).otherwise(out)
    return out


def held(c: Column) -> Column:
    return F.length(X.strip(c)) > 0


def with_last(members: DataFrame) -> DataFrame:
    """members with is_last: whether a record is the last one of its source in its group."""
    last = members.groupBy("group_id", "source").agg(F.max("record_id").alias("last_id"))
    return members.join(last, ["group_id", "source"]).withColumn("is_last", F.col("record_id") == F.col("last_id")).drop("last_id")


def priority_scalar(name: str, priority: tuple[str, ...]) -> Column:
    """The value of the first listed source whose last record has one; else the first value of the group.

    A blank in the last record of a source hides that source's earlier values in the first step only."""
    c, r = F.col(name), rank(priority)
    return F.coalesce(F.min_by(c, F.when(held(c) & F.col("is_last") & (r < len(priority)), r)), F.min_by(c, F.when(held(c), F.col("record_id"))))


def most_complete_scalar(name: str) -> Column:
    """The longest value, the earliest of equals."""
    c = F.col(name)
    return F.max_by(c, F.when(held(c), F.struct(F.length(c), -F.col("record_id"))))


def scalar(name: str, rules: MergeRules) -> Column:
    rule = rules.rule(name)
    return most_complete_scalar(name) if rule.strategy == "most_complete" else priority_scalar(name, rule.priority)


def first_list(name: str, priority: tuple[str, ...]) -> Column:
    """The first list with an element, by priority and then order."""
    c = F.col(name)
    return F.coalesce(F.min_by(c, F.when(F.size(c) > 0, F.struct(rank(priority), F.col("record_id")))), F.array().cast(LISTS[name]))


def ordered_items(name: str, priority: tuple[str, ...]) -> Column:
    """All elements of a group by priority, record and position."""
    rows = F.array_sort(F.collect_list(F.when(F.size(name) > 0, F.struct(rank(priority).alias("rank"), F.col("record_id"), F.col(name).alias("items")))))
    return F.flatten(F.transform(rows, lambda x: x["items"]))


def union_skills(members: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """(group_id, skills): each skill once whatever its case, as first spelt; by way of rows, so a group may be large."""
    rows = members.select("group_id", rank(priority).alias("rank"), "record_id", F.posexplode("skills").alias("pos", "skill"))
    at = F.struct("rank", "record_id", "pos")
    once = rows.groupBy("group_id", F.lower("skill").alias("k")).agg(F.min(F.struct(at.alias("at"), "skill")).alias("x"))
    return once.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["skill"]).alias("skills"))


def extra_map(members: DataFrame) -> DataFrame:
    """(group_id, extra_fields): per key the value of the first record that has it, keys in that order; by way of rows."""
    rows = members.select("group_id", "record_id", F.posexplode(F.map_entries("extra_fields")).alias("pos", "e"))
    at = F.struct("record_id", "pos", F.col("e.value").alias("value"))
    once = rows.groupBy("group_id", F.col("e.key").alias("key")).agg(F.min(at).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at.record_id", "at.pos", "key", "at.value")))
    return once.groupBy("group_id").agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["key"], x["value"]))).alias("extra_fields"))


def _scores(ratio, kept: list[str | None], new: str | None) -> np.ndarray:
    """Similarity of new to each of kept; NaN where either has nothing to compare, so that no test on it holds."""
    return np.array([ratio(x, new) if x and new else np.nan for x in kept])


#: For each kind of entry: fields compared, fields that take the longest value, fields that take the first one.
KINDS = {
    "experience": (("company", "title"), ("company", "title", "description"), ("location", "duration")),
    "education": (("institution", "form"), ("institution", "degree"), ("field_of_study", "duration", "gpa")),
}


def alike(kind: str, kept: dict[str, list], new: dict, ratio=Z.plain_token_sort) -> np.ndarray:
    """Which kept entries (columns of values) new is one with: every score is taken once, then the first case decides."""
    place, role = KINDS[kind][0]
    at, of = _scores(ratio, kept[place], new[place]), _scores(ratio, kept[role], new[role])
    if kind == "education":
        return np.select([at < INSTITUTION, of < DEGREE], [False, False], (at >= INSTITUTION) | (of >= DEGREE))
    # one source may have company and title the other way round; a title may be part of the other
    swapped = np.fmax(_scores(ratio, kept[role], new[place]), _scores(ratio, kept[place], new[role]))
    inside = _scores(lambda x, y: Z.plain_partial(x.lower(), y.lower()), kept[role], new[role])
    cases = [(at < COMPANY, swapped >= COMPANY), (at >= STRONG_COMPANY, ~(inside < PART_OF_TITLE)), (of < COMPANY, np.zeros(len(of), bool))]
    return np.select(*map(list, zip(*cases)), (at >= COMPANY) | (of >= COMPANY))


class _Memo:
    """Ratios of pairs of values; a group's entries repeat the same few."""

    def __init__(self):
        self.known: dict[tuple, float] = {}

    def __call__(self, a: str, b: str) -> float:
        if (v := self.known.get((a, b))) is None:
            v = self.known[a, b] = Z.plain_token_sort(a, b)
        return v


def fold_entries(items: list[dict], kind: str) -> list[dict]:
    """Entries in order, each dropped if it equals one kept, put into the first kept one it is alike, or kept.

    Education entries carry form, the comparable form of their degree, which follows the degree."""
    compared, longest, first = KINDS[kind]
    kept, ratio = [], _Memo()
    for x in items:
        if x in kept:
            continue
        same = alike(kind, {f: [y[f] for y in kept] for f in compared}, x, ratio) if kept else np.zeros(0, bool)
        if not same.any():
            kept.append(x)
            continue
        y = kept[int(same.argmax())]
        if "form" in x and len(x["degree"] or "") > len(y["degree"] or ""):
            y["form"] = x["form"]
        for f in longest:
            y[f] = max(y[f], x[f], key=lambda v: len(v or ""))  # the kept one of equals
        for f in first:
            if y[f] is None or y[f] == "":
                y[f] = x[f]
    return kept


def _plain(x):
    """Arrow values as plain ones: rows as dicts, NaN as None."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return None if isinstance(x, float) and x != x else x


@arrow(f"array<{EXPERIENCE}>")
def _fold_experience(items: pd.Series) -> pd.Series:
    return items.map(lambda xs: None if xs is None else fold_entries([_plain(x) for x in xs], "experience"))


@arrow(f"array<{EDUCATION}>")
def _fold_education(items: pd.Series, forms: pd.Series) -> pd.Series:
    def one(xs, fs):
        kept = fold_entries([_plain(x) | {"form": f} for x, f in zip(xs, fs)], "education")
        return [{k: v for k, v in y.items() if k != "form"} for y in kept]

    return pd.Series([None if xs is None else one(xs, fs) for xs, fs in zip(items, forms)], dtype=object)


def fold_experience(items: Column) -> Column:
    """Distinct jobs of a list."""
    return _fold_experience(items)


def fold_education(items: Column) -> Column:
    """Distinct schools and degrees of a list; degrees are compared in the form of functions.normalize."""
    return _fold_education(items, F.transform(items, lambda x: N.degree(x["degree"])))


def merge(members: DataFrame, rules: MergeRules) -> DataFrame:
    """Golden records of members (records with group_id): group_id, fields, extra_fields, n_records."""
    aggs = {f: scalar(f, rules).alias(f) for f in SCALARS}
    apart = None
    for f in LISTS:
        rule = rules.rule(f)
        if rule.strategy != "union":
            aggs[f] = first_list(f, rule.priority).alias(f)
        elif f == "skills":
            apart = rule.priority
        else:
            aggs[f] = ordered_items(f, rule.priority).alias(f)
    out = with_last(members).groupBy("group_id").agg(*aggs.values(), F.count(F.lit(1)).alias("n_records"))
    out = out.join(extra_map(members), "group_id", "left").withColumn("extra_fields", F.coalesce("extra_fields", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")))
    if apart is not None:
        out = out.join(union_skills(members, apart), "group_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    if rules.rule("links").strategy == "union":
        out = out.withColumn("links", X.merge_links(F.col("links")))
    for f, fold in (("experience", fold_experience), ("education", fold_education)):
        if rules.rule(f).strategy == "union":
            out = out.withColumn(f, F.when(F.size(f) < 2, F.col(f)).otherwise(F.coalesce(fold(F.when(F.size(f) > 1, F.col(f))), F.col(f))))
    return out
