"""Raw records to typed records, one transform for each kind of source."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..schema import DURATION, EDUCATION, EXPERIENCE, FIELDS, LISTS, SCALARS
from . import resume

Extractor = Callable[[DataFrame], DataFrame]
_EXTRACTORS: dict[str, Extractor] = {}

_EXTRA = "map<string,string>"


def register(source: str) -> Callable[[Extractor], Extractor]:
    def put(extractor: Extractor) -> Extractor:
        _EXTRACTORS[source] = extractor
        return extractor

    return put


def registered() -> list[str]:
    return list(_EXTRACTORS)


def _blank(name: str) -> Column:
    return F.array().cast(LISTS[name]) if name in LISTS else F.lit(None).cast("string")


def record(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The record schema from columns; what is not given is blank."""
    own = {f: values.get(f, _blank(f)).alias(f) for f in FIELDS}
    extra = values.get("extra_fields", F.map_from_arrays(F.array(), F.array()).cast(_EXTRA)).alias("extra_fields")
    return df.select("record_id", "source", "source_file", *own.values(), extra, "parse_errors")


def extract(raw: DataFrame) -> DataFrame:
    """Records of all sources; one without an extractor gives blank records."""
    known = list(_EXTRACTORS)
    out = record(raw.where(~F.col("source").isin(*known)), {})
    for source, own in _EXTRACTORS.items():
        out = out.unionByName(own(raw.where(F.col("source") == source)))
    return out


# CSV


#: What a column of a CSV file stands for, by its compared name; no name stands for two things.
CSV_KINDS = {name: kind for kind, names in V.CSV_COLUMNS.items() for name in names}


def csv_cells() -> Column:
    """Kind of column to its first value, in column order: every name is compared once for each row."""
    cells = F.transform("fields", lambda f: F.struct(X.lookup(X.key(f["key"]), CSV_KINDS).alias("key"), X.strip(f["value"]).alias("value")))
    full = F.filter(cells, lambda c: c["key"].isNotNull() & (F.length(c["value"]) > 0))
    return F.map_from_entries(X.first_by(full, lambda c: c["key"]))


def _value(kind: str) -> Column:
    return F.col("cells")[kind]


def _blob() -> Column:
    return F.array_join(F.filter(F.transform("fields", lambda f: f["value"]), lambda v: F.length(X.strip(v)) > 0), "\n")


def csv_experience() -> Column:
    v = {k: _value(k) for k in ("company", "title", "exp_start", "exp_end", "description", "exp_location")}
    start, end = v["exp_start"], v["exp_end"]
    duration = F.when(F.coalesce(start, end).isNotNull(), F.struct(start.alias("start"), end.alias("end"), (start.isNotNull() & end.isNull()).alias("is_current")).cast(DURATION))
    entry = F.struct(v["company"].alias("company"), v["title"].alias("title"), duration.alias("duration"), v["description"].alias("description"), v["exp_location"].alias("location")).cast(EXPERIENCE)
    return F.when(F.coalesce(v["company"], v["title"], start, v["description"]).isNotNull(), F.array(entry)).otherwise(_blank("experience"))


def gpa(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\d.]", ""), 1, 10).try_cast("double")


def csv_education() -> Column:
    v = {k: _value(k) for k in ("institution", "degree", "field", "gpa", "edu_start", "edu_end")}
    duration = F.when(F.coalesce(v["edu_start"], v["edu_end"]).isNotNull(), F.struct(v["edu_start"].alias("start"), v["edu_end"].alias("end"), F.lit(False).alias("is_current")).cast(DURATION))
    entry = F.struct(v["institution"].alias("institution"), v["degree"].alias("degree"), v["field"].alias("field_of_study"), duration.alias("duration"), gpa(v["gpa"]).alias("gpa")).cast(EDUCATION)
    return F.when(F.coalesce(v["institution"], v["degree"], v["field"]).isNotNull(), F.array(entry)).otherwise(_blank("education"))


def text_or_columns(blob: Column, parse: Callable[[Column], Column], columns: Column) -> Column:
    """A value with line breaks is parsed as text; if it is none, or gives nothing, columns count."""
    lined = F.coalesce(F.contains(blob, F.lit("\n")), F.lit(False))
    return F.when(lined, X.let(X.let(blob, parse), lambda parsed: F.when(F.size(parsed) > 0, parsed).otherwise(columns))).otherwise(columns)


def csv_links() -> Column:
    labels = {name: label for label, names in V.LINK_COLUMNS["csv"].items() for name in names}
    held = F.filter("fields", lambda f: F.length(X.strip(f["value"])) > 0)
    direct = F.transform(F.filter(held, lambda f: X.key(f["key"]).isin(*labels)), lambda f: X.link(X.with_scheme(f["value"]), X.lookup(X.key(f["key"]), labels)))
    base, site = {k: v[0] for k, v in V.USERNAME_COLUMNS.items()}, {k: v[1] for k, v in V.USERNAME_COLUMNS.items()}
    user = lambda f: F.regexp_replace(X.strip(f["value"]), "^@+", "")
    handles = F.transform(F.filter(held, lambda f: X.key(f["key"]).isin(*base) & (F.length(user(f)) > 0)), lambda f: X.link(F.concat(X.lookup(X.key(f["key"]), base), user(f)), X.lookup(X.key(f["key"]), site)))
    return X.merge_links(F.concat(direct, handles, X.text_links(F.col("blob"))))


#: Columns that extraction takes; spellings of the general fields other than these stay in extra_fields too.
CSV_TAKEN = sorted({"name", "email", "phone", "location", "summary", "skills", "experience", "education", *V.USERNAME_COLUMNS, *(n for names in V.LINK_COLUMNS["csv"].values() for n in names), *(n for names in V.CSV_COLUMNS.values() for n in names)})


def _named(names: list[str]) -> Callable[[Column], Column]:
    return lambda f: X.key(f["key"]).isin(*names)


def csv_extra() -> Column:
    rest = F.filter("fields", lambda f: ~X.key(f["key"]).isin(*CSV_TAKEN))
    lists = []
    for name in V.MISC:
        cells = F.filter(F.transform(F.filter("fields", _named(V.CSV_COLUMNS[name])), lambda f: X.cell_list(f["value"])), lambda x: F.size(x) > 0)
        lists.append(F.struct(F.lit(name).alias("key"), F.to_json(F.get(cells, F.lit(0))).alias("value")))
    found = F.filter(F.array(*lists), lambda x: x["value"].isNotNull())
    names = F.transform(found, lambda x: x["key"])
    return F.map_from_entries(F.concat(F.filter(rest, lambda f: ~F.array_contains(names, f["key"])), found)).cast(_EXTRA)


@register("csv")
def extract_csv(raw: DataFrame) -> DataFrame:
    df = raw.withColumns({"known": X.known_fields(F.col("fields")), "blob": _blob(), "cells": csv_cells()})
    known = lambda k: F.col("known")[k]
    values = {f: F.nullif(known(f), F.lit("")) for f in SCALARS}
    values |= {
        "skills": X.with_scanned(X.tidy_skills(X.cell_list(known("skills"))), F.col("blob")),
        "experience": text_or_columns(known("experience"), resume.experience, csv_experience()),
        "education": text_or_columns(known("education"), resume.education, csv_education()),
        "links": csv_links(), "extra_fields": csv_extra(),
    }
    return record(df, values)


# Text


def extract_text(raw: DataFrame) -> DataFrame:
    df = raw.withColumn("body", F.nullif("raw_text", F.lit("")))
    given = F.transform(F.filter("fields", lambda f: f["key"] == "link"), lambda f: X.link(X.with_scheme(f["value"]), X.site(f["value"])))
    df = df.withColumn("parts", F.when(F.col("body").isNotNull(), resume.sections(F.col("body"))))
    values = {f: F.when(F.col("body").isNotNull(), v).otherwise(_blank(f)) for f, v in resume.parsed(F.col("body"), F.col("parts"), given).items()}
    return record(df, values)


register("resume_txt")(extract_text)
register("resume_pdf")(extract_text)


# JSON: free trees, so they are walked in Arrow batches; skills and links then use the Column functions.


def plain(x) -> str | None:
    """Text of a value as it is shown; null for blanks."""
    text = None if x is None else str(x).strip()
    return text or None


def _is_root(data: dict) -> bool:
    lists = {*V.JSON_KEYS["experience"], *V.JSON_KEYS["education"], *V.JSON_KEYS["skills"]}
    return any((k := X.plain_key(key)) in lists or k in V.JSON_KEYS["root"] and isinstance(v, str) and bool(v.strip()) for key, v in data.items())


def unwrap(data: dict, levels: int = 4) -> dict:
    """The object that holds a person's fields, inside at most so many wrappers."""
    for _ in range(levels):
        if _is_root(data):
            break
        inner = next((v for k, v in data.items() if X.plain_key(k) in V.JSON_WRAPPERS and isinstance(v, dict)), None)
        if inner is None:
            break
        data = inner
    return data


def known_of(data: dict) -> dict:
    """Canonical field to value: of this level, then of objects one level down."""

    def level(d: dict) -> dict:
        out: dict = {}
        for k, v in d.items():
            if name := X.ALIASES.get(X.plain_key(k)):
                out.setdefault(name, v)
        return {k: v for k, v in out.items() if k not in SCALARS or isinstance(v, str)}

    fields = level(data)
    apart = {*V.JSON_KEYS["experience"], *V.JSON_KEYS["education"], *V.JSON_KEYS["links"]}
    for k, v in data.items():
        if isinstance(v, dict) and X.plain_key(k) not in apart:
            fields = level(v) | fields
    return fields


def leaves(x) -> Iterator[str]:
    """String leaves, depth first."""
    if isinstance(x, str):
        yield x
    elif isinstance(x, (dict, list)):
        for v in x.values() if isinstance(x, dict) else x:
            yield from leaves(v)


def _pick(item: dict, name: str) -> str | None:
    return next((t for k in V.JSON_ITEM[name] if (t := plain(item.get(k)))), None)


def _list_of(data: dict, name: str) -> list[dict]:
    found = next((v for k, v in data.items() if X.plain_key(k) in V.JSON_KEYS[name] and isinstance(v, list)), [])
    return [x for x in found if isinstance(x, dict)]


#: Flags that say that a job goes on, and what they say.
CURRENT_FLAGS, YES = ("is_current", "current", "currently_working"), {"true", "yes", "1", "current"}


def _span(start: str | None, end: str | None, goes_on: bool) -> dict | None:
    """A duration: its end is none if it is a word for the present; without any end a job that has begun goes on."""
    ongoing_end = end is not None and re.fullmatch(V.PRESENT, end, re.I) is not None
    last = None if ongoing_end else end
    return {"start": start, "end": last, "is_current": goes_on or not end or ongoing_end} if start or last else None


def _json_experience(item: dict) -> dict:
    said = next((plain(item[k]) for k in CURRENT_FLAGS if item.get(k)), None) or ""
    picked = {name: _pick(item, name) for name in ("company", "title", "description", "exp_start", "exp_end")}
    duration = _span(picked.pop("exp_start"), picked.pop("exp_end"), said.lower() in YES)
    return picked | {"duration": duration, "location": plain(item.get("location"))}


def _json_gpa(item: dict) -> float | None:
    for k in V.JSON_ITEM["gpa"]:
        try:
            return float(re.sub(r"[^\d.]", "", str(item[k]))[:10])
        except (KeyError, ValueError):
            continue
    return None


def _json_education(item: dict) -> dict:
    start, end = _pick(item, "edu_start"), _pick(item, "edu_end")
    duration = {"start": start, "end": end, "is_current": False} if start or end else None
    return {"institution": _pick(item, "institution"), "degree": _pick(item, "degree"), "field_of_study": _pick(item, "field"), "duration": duration, "gpa": _json_gpa(item)}


def _cells(v) -> list[str]:
    """Items of a value as cell_list has them; lists as they are."""
    if isinstance(v, list):
        return [t for x in v if (t := str(x).strip())]
    if not isinstance(v, str) or not v.strip():
        return []
    if v.strip().startswith("["):
        try:
            if isinstance(x := json.loads(v), list):
                return _cells(x)
        except ValueError:
            pass
    return [t.strip() for t in re.split(r"[,;|\n]+", v) if t.strip()]


def _json_misc(data: dict) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in V.MISC:
        for k, v in data.items():
            if X.plain_key(k) not in V.JSON_KEYS[name]:
                continue
            items = _cells(v) if isinstance(v, str) else []
            if isinstance(v, list):
                items = [s.strip() for s in v if isinstance(s, str) and s.strip()] or [s.strip() for e in v if isinstance(e, dict) for s in e.values() if isinstance(s, str) and s.strip()]
            if items:
                out[name] = items
                break
    return out


_SITES = {name: label for label, names in V.LINK_COLUMNS["json"].items() for name in names}


def _json_links(data: dict) -> list[dict]:
    """Links of fields, containers and arrays, in this order; those of no label get one from their URL later."""
    found: list[tuple[str, str | None]] = [(v, _SITES[n]) for k, v in data.items() if (n := X.plain_key(k)) in _SITES and isinstance(v, str) and v.strip()]
    boxes = [v for k, v in data.items() if X.plain_key(k) in V.JSON_KEYS["links"]]
    for box in (b for b in boxes if isinstance(b, dict)):
        for k, v in box.items():
            if isinstance(v, str) and v.strip():
                if (n := X.plain_key(k)) in _SITES:
                    found.append((v, _SITES[n]))
                elif v.strip().startswith(("http://", "https://")):
                    found.append((v, None))
    for item in (i for b in boxes if isinstance(b, list) for i in b):
        if isinstance(item, dict):
            url = item.get("url") or item.get("href") or item.get("link")
            if isinstance(url, str) and url.strip():
                label = item.get("label") or item.get("type")
                found.append((url, None if not label else str(label)))
        elif isinstance(item, str) and item.strip():
            found.append((item, None))
    return [{"url": u, "label": label} for u, label in found]


#: Keys that extraction takes from a JSON object.
JSON_TAKEN = {"name", "email", "phone", "location", "summary", "skills", "experience", "education", *(k for name, keys in V.JSON_KEYS.items() if name != "root" for k in keys)}


def walk(text: str | None) -> dict:
    """What a JSON record holds; of text that is no object nothing, and parse_errors says why."""
    raw, errors = {}, []
    try:
        raw = json.loads(text) if text else {}
    except (ValueError, RecursionError) as e:
        errors = [f"JSON decode error at line {e.lineno}: {e.msg}" if isinstance(e, json.JSONDecodeError) else f"JSON decode error: {e}"]
    if not isinstance(raw, dict):
        raw, errors = {}, [f"Unexpected JSON root type: {type(raw).__name__}"]
    data = unwrap(raw)
    fields, misc = known_of(data), _json_misc(data)
    extra = {k: v for k, v in data.items() if X.plain_key(str(k)) not in JSON_TAKEN} | misc
    return {f: plain(fields.get(f)) for f in SCALARS} | {
        "skills": _cells(fields.get("skills")), "experience": [_json_experience(x) for x in _list_of(data, "experience")], "education": [_json_education(x) for x in _list_of(data, "education")],
        "links": _json_links(data), "extra_fields": [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in extra.items()],
        "all_text": "\n".join(leaves(raw)), "own_text": "\n".join(leaves(data)), "parse_errors": errors,
    }


@register("json")
def extract_json(raw: DataFrame) -> DataFrame:
    fields = ", ".join([*(f"{c} string" for c in SCALARS), *(f"{c} {t}" for c, t in LISTS.items()), f"extra_fields {_EXTRA}", "all_text string", "own_text string"])
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..schema import struct_type

    schema = struct_type(f"record_id long, source string, source_file string, parse_errors array<string>, {fields}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = walk(r["raw_json"])
                out.append(own | {k: r[k] for k in ("record_id", "source", "source_file")} | {"parse_errors": (r["parse_errors"] or []) + own["parse_errors"]})
            yield pa.RecordBatch.from_pylist(out, arrow)

    walked = raw.select("record_id", "source", "source_file", "parse_errors", "raw_json").mapInArrow(run, schema)
    given = F.transform("links", lambda x: X.link(X.with_scheme(x["url"]), F.coalesce(x["label"], X.site(X.with_scheme(x["url"])))))
    values = {f: F.col(f) for f in FIELDS} | {
        "skills": X.with_scanned(X.tidy_skills(F.col("skills")), F.col("all_text")),
        "links": X.merge_links(F.concat(given, X.text_links(F.col("own_text")))), "extra_fields": F.col("extra_fields"),
    }
    return record(walked, values)


