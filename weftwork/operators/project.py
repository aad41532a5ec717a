"""Output: which fields appear and how they are called, and checks of the result's shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Projection
from ..schema import FIELDS, ISSUE, LISTS, SCALARS
from .validate import issue, no_issues


def _default(value, kind: str) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, list):
        return F.array(*[F.lit(x) for x in value]).cast(kind)
    return F.lit(value).cast(kind)


def output_fields(config: Projection, columns: list[str]) -> list[Column]:
    """Included fields under their output names, with defaults for nulls; a source that is no field gives its default."""
    out = []
    for f in config.included():
        kind = LISTS.get(f.source, "string")
        value = F.col(f.source) if f.source in columns else F.lit(None).cast(kind)
        out.append(F.coalesce(value, _default(f.default, kind)).alias(f.output_name))
    return out


def keep_scores(scores: Column, config: Projection) -> Column:
    names = list(config.output_map())
    return F.filter(scores, lambda x: x["field_name"].isin(*names)) if names else scores


def keep_provenance(entries: Column, config: Projection) -> Column:
    if not config.include_provenance:
        return F.slice(entries, 1, 0)
    names = list(config.output_map())
    return F.filter(entries, lambda x: x["field_name"].isin(*names)) if names else entries


def keep_issues(issues: Column, config: Projection) -> Column:
    """Issues of included fields by exact name, and those of the score."""
    names = list(config.output_map())
    return F.filter(issues, lambda x: x["field"].startswith("confidence.") | x["field"].isin(*names)) if names else issues


def keep_explanations(lines: Column, config: Projection) -> Column:
    """Lines in which no excluded field's name stands as a word."""
    names = config.output_map()
    gone = [f for f in FIELDS if f not in names] if names else []
    return F.filter(lines, lambda x: ~x.rlike(rf"(?U)\b(?:{'|'.join(map(re.escape, gone))})\b")) if gone else lines


def project(golden: DataFrame, report: DataFrame | None, provenance: DataFrame | None, issues: DataFrame | None, config: Projection, version: str = "1.0.0", generated_at: Column | None = None) -> DataFrame:
    """Profiles: group_id, fields, confidence, provenance, validation, generated_at, pipeline_version."""
    fields = output_fields(config, golden.columns)
    df = golden.select("group_id", (F.struct(*fields) if fields else F.lit(None).cast("struct<_:string>")).alias("fields"))
    if report is not None and config.include_confidence:
        parts = F.struct("overall_score", keep_scores(F.col("field_scores"), config).alias("field_scores"), "completeness", "source_agreement", keep_explanations(F.col("explanations"), config).alias("explanations"), "diversity_bonus", "validation_penalty")
        df = df.join(report.select("group_id", parts.alias("confidence")), "group_id", "left")
    else:
        df = df.withColumn("confidence", F.lit(None).cast("struct<overall_score:double>"))
    if provenance is not None and config.include_provenance:
        df = df.join(provenance.select("group_id", keep_provenance(F.col("provenance"), config).alias("provenance")), "group_id", "left")
    else:
        df = df.withColumn("provenance", F.array().cast("array<struct<field_name:string>>"))
    if issues is not None and config.include_validation:
        valid = ~F.exists("issues", lambda x: x["severity"] == "error")
        df = df.join(issues.select("group_id", F.struct(valid.alias("is_valid"), keep_issues(F.col("issues"), config).alias("issues")).alias("validation")), "group_id", "left")
    else:
        df = df.withColumn("validation", F.lit(None).cast("struct<is_valid:boolean>"))
    return df.withColumns({"generated_at": F.current_timestamp() if generated_at is None else generated_at, "pipeline_version": F.lit(version)})


def shape_issues(schema: T.StructType, config: Projection) -> list[tuple[str, str, str]]:
    """(field, severity, message) for output fields that are missing or of the wrong kind; known from the schema alone."""
    kinds = {f.name: f.dataType for f in schema.fields}
    out = []
    for f in config.included():
        kind = kinds.get(f.output_name)
        if kind is None:
            out.append((f.output_name, "error", f"Required output field '{f.output_name}' is missing (source: '{f.source}')"))
        elif f.source in LISTS and not isinstance(kind, (T.ArrayType, T.NullType)):
            out.append((f.output_name, "error", f"Field '{f.output_name}' must be a list (source: '{f.source}'), got {kind.simpleString()}"))
        elif f.source in SCALARS and isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            out.append((f.output_name, "warning", f"Field '{f.output_name}' is a scalar field (source: '{f.source}') but received {kind.simpleString()}"))
    return out


def bounds_issues(report: DataFrame) -> DataFrame:
    """(group_id, field, severity, message, value) for scores outside 0 to 1."""
    outside = lambda c: ~F.coalesce(c.between(0, 1), F.lit(True))
    whole = F.when(outside(F.col("overall_score")), F.array(issue("confidence.overall_score", "error", F.concat(F.lit("overall_score "), F.col("overall_score").cast("string"), F.lit(" is outside [0.0, 1.0]")), F.col("overall_score")))).otherwise(no_issues())
    bad = F.filter("field_scores", lambda x: outside(x["score"]))
    each = F.transform(bad, lambda x: issue(F.concat(F.lit("confidence.field_scores["), x["field_name"], F.lit("]")), "error", F.concat(F.lit("Field score for '"), x["field_name"], F.lit("' is "), x["score"].cast("string"), F.lit(", outside [0.0, 1.0]")), x["score"]))
    return report.select("group_id", F.explode(F.concat(whole.cast(f"array<{ISSUE}>"), each.cast(f"array<{ISSUE}>"))).alias("x")).select("group_id", "x.*")
