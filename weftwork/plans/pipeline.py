"""The whole run as one DataFrame plan: read, extract, normalize, validate, resolve, merge, score, trace, project."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, standard
from ..operators import extract, lineage, merge, normalize, project, resolve, score, validate
from ..schema import FIELDS
from ..sources import readers, sinks


@dataclass
class Result:
    """Tables of a run; all are lazy but what resolution has checkpointed."""

    records: DataFrame  # normalized and validated, with group_id
    rejects: DataFrame  # inputs that could not be read, and why
    golden: DataFrame
    report: DataFrame
    provenance: DataFrame
    profiles: DataFrame
    shape: list[tuple[str, str, str]]  # what is wrong with the output's shape
    bounds: DataFrame  # scores out of bounds

    def metrics(self) -> dict[str, int]:
        """Numbers of inputs, groups and rejects: one pass."""
        r = self.records.agg(F.count(F.lit(1)).alias("inputs"), F.count_distinct("group_id").alias("groups")).first()
        return {"total_inputs": r["inputs"], "total_groups": r["groups"], "rejected": self.rejects.count()}


def run_records(extracted: DataFrame, config: Config | None = None, as_of: Column | datetime | None = None) -> Result:
    """From extracted records (the record schema) to profiles. as_of is the time that freshness counts from."""
    config = config or standard()
    now = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    records = validate.validate(normalize.normalize(extracted, config.normalization), config.confidence.field_categories)
    keys = resolve.checkpointed(records.select("record_id", "name", "email"))  # all that resolution needs
    members = resolve.checkpointed(records.join(resolve.resolve(keys, config.entity_resolution), "record_id"))  # read by every later step
    golden = merge.merge(members, config.merge_rules)
    issues = validate.combined(members)
    report = score.score(golden, members, issues, config.confidence, config.source_reliability, now)
    entries = lineage.provenance(members, config.source_reliability)
    traced = lineage.by_group(entries) if config.projection.include_provenance else None
    profiles = project.project(golden, report, traced, issues, config.projection, config.version, now)
    shape = project.shape_issues(golden.select(*project.output_fields(config.projection, golden.columns)).schema, config.projection) if config.projection.included() else []
    rejects = members.where(F.size("parse_errors") > 0).select("record_id", "source", "source_file", "parse_errors")
    return Result(members, rejects, golden, report, entries, profiles, shape, project.bounds_issues(report))


def run(spark: SparkSession, inputs: list[tuple[str, str]], config: Config | None = None, output: str | None = None, as_of=None, lines: bool = False) -> Result:
    """inputs: (source, path). output: a JSON array in one local file, or with lines a folder of JSON lines."""
    result = run_records(extract.extract(readers.read_all(spark, inputs)), config, as_of)
    if output:
        (sinks.write_json_lines if lines else sinks.write_json_array)(result.profiles, output)
    return result


def field_map(config: Config) -> dict[str, str]:
    """Output name to source field."""
    return {v: k for k, v in config.projection.output_map().items()}


__all__ = ["FIELDS", "Result", "field_map", "run", "run_records"]
