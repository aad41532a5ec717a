"""Sinks for profiles."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(profiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A profile on each line, in parallel; the sink for large outputs."""
    profiles.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json_array(profiles: DataFrame, path: str, order: str = "group_id", most: int = 100_000) -> int:
    """One indented array in a local file, [] for none; for up to most profiles. Returns their number."""
    rows = profiles.orderBy(order).select(F.to_json(F.struct(*[c for c in profiles.columns if c != order]), {"ignoreNullFields": "false"})).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} profiles: use write_json_lines")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r[0]) for r in rows], f, indent=2, ensure_ascii=False)
    return len(rows)
