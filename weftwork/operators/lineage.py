"""Lineage: where each field of each group comes from, an entry for each record and field that holds a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Reliability
from ..functions import text as X
from ..schema import FIELDS, LISTS
from .score import reliability
from .validate import python_repr


def method(name: str, source: Column) -> Column:
    """How a value was obtained: patterns in PDF text, its name guessed; other sources give it directly."""
    return F.when(source == "resume_pdf", "inferred" if name == "name" else "regex").otherwise("direct")


def shown(c: Column, name: str) -> Column:
    return F.to_json(c) if name in LISTS else c


def provenance(members: DataFrame, trust: Reliability) -> DataFrame:
    """members: normalized records with original and group_id."""

    def entry(k: int, f: str) -> Column:
        now = F.col(f)
        before = F.col("original")[f] if f in ("name", "email", "phone", "skills") else now
        changed = ~before.eqNullSafe(now)
        was = shown(before, f) if f == "skills" else python_repr(before) if f in ("name", "email", "phone") else F.lit("")
        return F.struct(
            F.lit(k).alias("ord"), F.lit(f).alias("field_name"), F.col("source"), shown(before, f).alias("original_value"), shown(now, f).alias("normalized_value"),
            method(f, F.col("source")).alias("extraction_method"), reliability(F.col("source"), trust).alias("confidence"),
            F.when(changed, F.concat(F.lit("normalized from "), was)).alias("notes"), X.non_empty(now, "array" if f in LISTS else "string").alias("held"),
        )

    rows = members.select("group_id", "record_id", F.explode(F.array(*[entry(k, f) for k, f in enumerate(FIELDS)])).alias("x"))
    return rows.where("x.held").select("group_id", "record_id", "x.*").drop("held")


def by_group(entries: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("record_id", "ord", "field_name", "source", "original_value", "normalized_value", "extraction_method", "confidence", "notes")))
    return entries.groupBy("group_id").agg(F.transform(rows, lambda x: x.dropFields("record_id", "ord")).alias("provenance"))
