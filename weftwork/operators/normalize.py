"""Extracted records to normalized ones; what a field was before stays in an original column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Normalization
from ..functions import normalize as N
from ..functions.arrow import arrow

#: Fields whose change is recorded; nested dates are not.
TRACKED = ("name", "email", "phone", "skills")


def _dates(d: Column, other_layouts: bool) -> Column:
    fixed = F.struct(N.date(d["start"], False).alias("start"), N.date(d["end"], False).alias("end"), d["is_current"].alias("is_current"))
    return F.when(d.isNotNull(), fixed)


def normalize(records: DataFrame, config: Normalization) -> DataFrame:
    """records with normalized fields, and original (name, email, phone, skills, links) beside them.

    Python functions can't run inside array expressions, so odd date layouts in the lists are read
    in a second step, only where the first one has left something unread."""
    groups = config.skills.synonyms
    out = records.withColumn("original", F.struct(*[F.col(f) for f in (*TRACKED, "links")]))
    out = out.withColumns(
        {
            "name": N.name(F.col("name")),
            "email": N.email(F.col("email")),
            "phone": N.phone(F.col("phone"), config.phone.default_country_code),
            "skills": N.skills(F.col("skills"), groups, config.skills.case_sensitive),
            "experience": F.transform("experience", lambda x: x.withField("duration", _dates(x["duration"], False))),
            "education": F.transform("education", lambda x: x.withField("duration", _dates(x["duration"], False))),
            "links": F.transform("links", lambda x: x.withField("url", F.coalesce(N.url(x["url"]), x["url"]))),
        }
    )
    return _rest(out)


@arrow("array<string>")
def _read_dates(xs: pd.Series) -> pd.Series:
    from datetime import datetime

    from dateutil import parser

    def read(x):
        if x is None or not any(c.isdigit() for c in x):
            return x
        try:
            return parser.parse(x, default=datetime(2000, 1, 1)).strftime("%Y-%m")
        except (ValueError, OverflowError, TypeError):
            return x

    return xs.map(lambda row: None if row is None else [read(x) for x in row])


def _rest(df: DataFrame) -> DataFrame:
    """Dates that no listed layout fits."""
    from ..functions.vocabulary import CANONICAL_DATE

    for name in ("experience", "education"):
        both = F.flatten(F.transform(name, lambda x: F.array(x["duration"]["start"], x["duration"]["end"])))
        odd = F.exists(both, lambda d: ~F.coalesce(d.rlike(CANONICAL_DATE), F.lit(True)))
        df = df.withColumn("_dates", _read_dates(F.when(odd, both)))
        put = F.transform(name, lambda x, i: x.withField("duration", F.when(x["duration"].isNotNull(), F.struct(F.get("_dates", 2 * i).alias("start"), F.get("_dates", 2 * i + 1).alias("end"), x["duration"]["is_current"].alias("is_current")))))
        df = df.withColumn(name, F.when(F.col("_dates").isNotNull(), put).otherwise(F.col(name))).drop("_dates")
    return df


def changes(df: DataFrame) -> Column:
    """Map of changed field to (original, normalized), as JSON text for lists; links by label, the last one counts."""
    pair = lambda a, b: F.struct(a.alias("original"), b.alias("normalized"))
    entries = []
    for f in TRACKED:
        a, b = F.col("original")[f], F.col(f)
        shown = (F.to_json(a), F.to_json(b)) if f == "skills" else (a, b)
        entries.append(F.when(~a.eqNullSafe(b), F.struct(F.lit(f).alias("key"), pair(*shown).alias("value"))))
    own = F.transform(F.arrays_zip(F.col("original.links").alias("a"), F.col("links").alias("b")), lambda x: F.struct(F.concat(F.lit("link:"), F.coalesce(x["a"]["label"], F.lit("None"))).alias("key"), pair(x["a"]["url"], x["b"]["url"]).alias("value")))
    moved = F.filter(own, lambda x: ~x["value"]["original"].eqNullSafe(x["value"]["normalized"]))
    keys = F.transform(moved, lambda x: x["key"])
    last = F.filter(moved, lambda x, i: F.size(keys) - F.array_position(F.reverse(keys), x["key"]) == i)
    return F.map_from_entries(F.concat(F.array_compact(F.array(*entries)), last))
