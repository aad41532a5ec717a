"""Queries that run the engine's operators over whole tables, each with the same result as DuckDB SQL where SQL can say it.

The tables hold no person records, so each query makes record-like columns from them; the SQL makes the same ones.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import fuzzy as Z
from ..functions import normalize as N
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import extract, lineage, merge, normalize, project, resolve, resume, score, validate
from ..schema import DURATION, EDUCATION, EXPERIENCE, RAW, SCALARS
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = datetime.datetime(2025, 6, 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _records(df: DataFrame) -> DataFrame:
    """The record schema around some of its columns."""
    return extract.record(df.withColumns({c: F.lit(None).cast(t) for c, t in (("source_file", "string"), ("parse_errors", "array<string>")) if c not in df.columns}), {c: F.col(c) for c in df.columns if c in (*SCALARS, "skills", "experience", "education", "links", "extra_fields")})


# Golden records

# Every person has a name of its own; every seventh customer's name lacks a letter and no one shares its e-mail, so that
# only the default name threshold brings it to its person. The SQL knows whose misspelling each one is.
_LETTERS = "translate(md5(CAST(person AS VARCHAR)), '0123456789abcdef', 'abcdefghijklmnop')"
_FULL_NAME = f"'a' || {_LETTERS}[1:12] || ' z' || {_LETTERS}[13:24]"
_PEOPLE = f"""
SELECT record_id, source, summary, skill, location, person, typo, CASE WHEN typo THEN 'typo' || (record_id // 4) || '@example.com' ELSE email END AS email,
  CASE WHEN typo THEN name[1:(record_id // 4) % 10 + 1] || name[(record_id // 4) % 10 + 3:] ELSE name END AS name FROM (
SELECT *, CASE WHEN named THEN {_FULL_NAME} END AS name FROM (
SELECT c_custkey * 4 AS record_id, 'csv' AS source, c_custkey % 500 AS person, 'user' || (c_custkey % 500) || '@Example.com' AS email, true AS named, c_custkey % 7 = 0 AS typo, n_name AS location, CAST(NULL AS VARCHAR) AS summary, c_mktsegment AS skill
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT o_orderkey * 4 + 1, 'json', o_custkey % 500, 'USER' || (o_custkey % 500) || '@example.com', false, false, NULL, o_orderpriority, o_orderstatus FROM orders
UNION ALL SELECT s_suppkey * 4 + 2, 'ats', s_suppkey % 500, 'User' || (s_suppkey % 500) || '@example.com', true, false, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE 'city ' || s_nationkey END, NULL, 'Machinery' FROM supplier))
"""
#: A misspelt name belongs to its person if another record has the person's full name, else to the person's other misspelt ones.
_GROUPED = f"""
WITH p AS ({_PEOPLE}), k AS (SELECT *, CASE WHEN typo AND NOT coalesce(bool_or(name IS NOT NULL AND NOT typo) OVER (PARTITION BY person), false) THEN 1000000 + person ELSE person END AS k FROM p),
m AS (SELECT *, min(record_id) OVER (PARTITION BY k) AS group_id FROM k)
"""


def people(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    mail = lambda start, key, end: F.concat(F.lit(start), (F.col(key) % 500).cast("string"), F.lit(end))
    letters = lambda key: F.translate(F.md5((F.col(key) % 500).cast("string").cast("binary")), "0123456789abcdef", "abcdefghijklmnop")
    name = lambda key: F.concat(F.lit("a"), F.substring(letters(key), 1, 12), F.lit(" z"), F.substring(letters(key), 13, 12))
    key = F.col("c_custkey")
    planted, at = key % 7 == 0, (key % 10 + 2).cast("int")  # a letter of the first word goes
    typo = F.concat(F.substr(name("c_custkey"), F.lit(1), at - 1), F.substr(name("c_custkey"), at + 1, F.lit(99)))
    own = F.concat(F.lit("typo"), key.cast("string"), F.lit("@example.com"))
    a = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select((key * 4).alias("record_id"), F.lit("csv").alias("source"), F.when(planted, own).otherwise(mail("user", "c_custkey", "@Example.com")).alias("email"), F.when(planted, typo).otherwise(name("c_custkey")).alias("name"), F.col("n_name").alias("location"), none.alias("summary"), F.array("c_mktsegment").alias("skills"))
    b = table(spark, d, "orders").select((F.col("o_orderkey") * 4 + 1).alias("record_id"), F.lit("json"), mail("USER", "o_custkey", "@example.com"), none, none, F.col("o_orderpriority"), F.array("o_orderstatus"))
    c = table(spark, d, "supplier").select((F.col("s_suppkey") * 4 + 2).alias("record_id"), F.lit("ats"), mail("User", "s_suppkey", "@example.com"), name("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.concat(F.lit("city "), F.col("s_nationkey").cast("string"))), none, F.array(F.lit("Machinery")))
    return _records(a.union(b).union(c))


def grouped_people(spark: SparkSession, d: str) -> DataFrame:
    """With group_id, resolved with the default thresholds."""
    records = people(spark, d)
    return resolve.checkpointed(records.join(resolve.resolve(records, C.Resolution()), "record_id"))


_GOLDEN = f"""
{_GROUPED}, l AS (SELECT *, record_id = max(record_id) OVER (PARTITION BY group_id, source) AS is_last FROM m),
s AS (SELECT group_id, string_agg(skill, ',' ORDER BY r, record_id) AS skills FROM (
  SELECT group_id, arg_min(skill, (CAST(r AS BIGINT) * 1000000000 + record_id)) AS skill, min(r) AS r, min(record_id) FILTER (r = mr) AS record_id FROM (
    SELECT *, min(r) OVER (PARTITION BY group_id, lower(skill)) AS mr FROM (SELECT *, CASE source WHEN 'ats' THEN 2 WHEN 'json' THEN 3 ELSE 4 END AS r FROM m))
  GROUP BY group_id, lower(skill)) GROUP BY group_id),
g AS (SELECT group_id, count(*) AS n_records,
  coalesce(arg_min(name, CASE source WHEN 'ats' THEN 2 WHEN 'json' THEN 3 ELSE 4 END) FILTER (is_last AND length(trim(name)) > 0), arg_min(name, record_id) FILTER (length(trim(name)) > 0)) AS name,
  coalesce(arg_min(email, CASE source WHEN 'csv' THEN 0 WHEN 'json' THEN 1 ELSE 2 END) FILTER (is_last), arg_min(email, record_id)) AS email,
  coalesce(arg_min(location, CASE source WHEN 'ats' THEN 2 WHEN 'json' THEN 3 ELSE 4 END) FILTER (is_last AND length(trim(location)) > 0), arg_min(location, record_id) FILTER (length(trim(location)) > 0)) AS location,
  arg_max(summary, length(summary) * 1000000000 - record_id) FILTER (length(trim(summary)) > 0) AS summary
  FROM l GROUP BY group_id)
"""


@query(
    _GOLDEN
    + """SELECT group_id, n_records, name AS full_name, email AS email_address, location, summary AS professional_summary, skills,
  round((CASE WHEN name IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 0.08 ELSE 0 END) + CASE WHEN skills IS NOT NULL THEN 0.20 ELSE 0 END, 3)::DOUBLE AS completeness
FROM g LEFT JOIN s USING (group_id)"""
)
def entity_golden_record(spark, d):
    golden = merge.merge(grouped_people(spark, d), C.standard().merge_rules)
    names = C.STANDARD_PROJECTION
    return golden.select("group_id", "n_records", *[F.col(f).alias(names[f]) for f in ("name", "email", "location", "summary")], F.array_join("skills", ",").alias("skills"), score.completeness(C.Confidence()).alias("completeness"))


@query()
def entity_profiles(spark, d):
    """The whole pipeline; SQL can't say all of it."""
    profiles = pipeline.run_records(people(spark, d), C.standard(), AS_OF).profiles
    return profiles.select("group_id", F.to_json("fields").alias("fields"), F.to_json("confidence").alias("confidence"), F.to_json("validation").alias("validation"))


@query(
    f"""{_GROUPED}
SELECT group_id, count(*) AS size, count(*) = 1 AS is_singleton, string_agg(source, ',' ORDER BY record_id) AS sources, arg_min(email, record_id) AS primary_email,
  arg_min(name, record_id) FILTER (length(name) > 0) AS primary_name FROM m GROUP BY group_id"""
)
def email_groups(spark, d):
    return resolve.groups(grouped_people(spark, d)).withColumn("sources", F.array_join("sources", ","))


# Contacts and links of texts


@query(f"SELECT doc_id, nullif(regexp_extract(text, {_q('(?i)' + V.EMAIL)}), '') AS email, lower(nullif(regexp_extract(text, {_q('(?i)' + V.EMAIL)}), '')) AS normalized FROM documents")
def email_extract(spark, d):
    found = X.email(F.col("text"))
    return table(spark, d, "documents").select("doc_id", found.alias("email"), N.email(found).alias("normalized"))


@query(f"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {_q(V.PHONE)}), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(regexp_replace(x, '\\D', '', 'g')) BETWEEN 7 AND 15)[1] AS phone FROM documents""")
def phone_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", X.phone(F.col("text")).alias("phone"))


_PHONE_CASES = ["98765{k}", "+91 98765-{k}", "(+91)98765{k}", "098765{k}", "9198765{k}", "123", "not-a-phone", "+1-800-55{k}"]
_PHONE_SQL = " ".join(f"WHEN {i} THEN {_q(x)}" for i, x in enumerate(_PHONE_CASES))


@query(
    f"""WITH p AS (SELECT c_custkey, replace(CASE c_custkey % 8 {_PHONE_SQL} END, '{{k}}', lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')) AS phone FROM customer),
q AS (SELECT *, regexp_replace(phone, '\\D', '', 'g') AS n FROM p)
SELECT c_custkey, phone, CASE WHEN length(n) < 7 OR phone ~ '.*[A-Za-z].*' THEN phone WHEN starts_with(ltrim(phone, '('), '+') THEN '+' || n WHEN length(n) = 10 THEN '+91' || n
  WHEN length(n) = 11 AND n[1] = '0' THEN '+91' || n[2:] WHEN length(n) = 12 AND starts_with(n, '91') THEN '+' || n ELSE phone END AS normalized,
  length(n) BETWEEN 7 AND 15 AS valid FROM q"""
)
def phone_normalize(spark, d):
    shape = X.lookup((F.col("c_custkey") % 8).cast("string"), {str(i): x for i, x in enumerate(_PHONE_CASES)})
    phone = F.replace(shape, F.lit("{k}"), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    return table(spark, d, "customer").select("c_custkey", phone.alias("phone")).withColumns({"normalized": N.phone(F.col("phone")), "valid": validate.valid_phone(F.col("phone"))})


_URL_SQL = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN upper(regexp_extract(url, '^https?://[^/]*')) || regexp_extract(url, '^https?://[^/]*(.*)$', 1) WHEN 2 THEN regexp_replace(url, '^https?://', '')
  WHEN 3 THEN ' ' || regexp_extract(url, '^https?://[^/]*') || ' ' ELSE regexp_extract(url, '^https?://[^/?#]*') || '/WWW/a//' END AS u FROM pages"""


def _urls(spark, d):
    u, k = F.col("url"), F.col("page_id") % 5
    host = F.regexp_extract(u, "^https?://[^/]*", 0)
    shaped = F.when(k == 0, u).when(k == 1, F.concat(F.upper(host), F.regexp_extract(u, "^https?://[^/]*(.*)$", 1))).when(k == 2, F.regexp_replace(u, "^https?://", "")).when(k == 3, F.concat(F.lit(" "), host, F.lit(" "))).otherwise(F.concat(F.regexp_extract(u, "^https?://[^/?#]*", 0), F.lit("/WWW/a//")))
    return table(spark, d, "pages").select("page_id", shaped.alias("u"))


@query(
    f"""WITH p AS ({_URL_SQL}), q AS (SELECT page_id, u, CASE WHEN trim(u) LIKE 'http://%' OR trim(u) LIKE 'https://%' THEN trim(u) ELSE 'https://' || trim(u) END AS t FROM p),
r AS (SELECT *, regexp_extract(t, '^([^:/?#]+)://([^/?#]*)([^?#]*)(.*)$', ['scheme', 'host', 'path', 'rest']) AS x FROM q)
SELECT page_id, u AS url, lower(x.scheme) || '://' || lower(x.host) || CASE WHEN rtrim(x.path, '/') = '' THEN '/' ELSE rtrim(x.path, '/') END || x.rest AS normalized,
  coalesce(regexp_matches(trim(u), '^(?i:https?)://[^/?#]+'), false) AS valid FROM r"""
)
def url_normalize(spark, d):
    return _urls(spark, d).select("page_id", F.col("u").alias("url"), N.url(F.col("u")).alias("normalized"), validate.valid_url(F.trim("u")).alias("valid"))


@query(f"WITH p AS ({_URL_SQL}) SELECT page_id, rtrim(regexp_replace(regexp_replace(lower(trim(u)), '^https?://', ''), '^www\\.', ''), '/') AS url_key FROM p")
def url_dedupe_key(spark, d):
    return _urls(spark, d).select("page_id", X.url_key(F.col("u")).alias("url_key"))


_SITES = ["https://LinkedIn.com/in/x", "http://gist.github.com/y", "leetcode.com/z", "https://notkaggle.com/a", "//kaggle.com/b", "https://medium.com/@c", "https://stackoverflow.com/u", "https://codechef.com/users/d", "https://www.hackerrank.com/e"]
_SITE_SQL = " ".join(f"WHEN {i} THEN {_q(x)}" for i, x in enumerate(_SITES))


@query(
    f"""WITH p AS (SELECT page_id, coalesce(CASE page_id % 10 {_SITE_SQL} END, url) AS u FROM pages)
SELECT page_id, CASE """
    + " ".join(f"WHEN regexp_matches(u, '(?i)(?:^|//|\\.){host}\\.com') THEN '{label}'" for label, host in V.LINK_SITES.items())
    + " ELSE 'Website' END AS label, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE 'https://' || u END AS with_scheme FROM p"
)
def url_classify(spark, d):
    u = F.coalesce(X.lookup((F.col("page_id") % 10).cast("string"), {str(i): x for i, x in enumerate(_SITES)}), F.col("url"))
    return table(spark, d, "pages").select("page_id", X.site(u).alias("label"), X.with_scheme(u).alias("with_scheme"))


def links_of_pages(spark, d):
    """Links of each page's source, in order and without repeats."""
    found = X.merge_links(X.text_links(F.concat_ws(" ", "url", "html")))
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "x")).select("page_id", "pos", "x.*")


# Names, dates, degrees, skills

_PARTICLES = ", ".join(map(_q, V.NAME_PARTICLES))


@query(
    f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_name) || ' ' WHEN 1 THEN 'jan VAN  der ' || p_name WHEN 2 THEN 'j. o''BRIEN mc-donald ' || p_brand ELSE p_name END AS name FROM part),
w AS (SELECT p_partkey, name, string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ') AS ws FROM p)
SELECT p_partkey, name, array_to_string(list_transform(ws, lambda x, i: CASE WHEN i > 1 AND lower(x) IN ({_PARTICLES}) THEN lower(x) WHEN regexp_matches(x, '^[a-zA-Z]\\.$') THEN upper(x[1]) || '.' ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS normalized FROM w"""
)
def name_normalize(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("  "), F.upper(n), F.lit(" "))).when(k == 1, F.concat(F.lit("jan VAN  der "), n)).when(k == 2, F.concat(F.lit("j. o'BRIEN mc-donald "), F.col("p_brand"))).otherwise(n)
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("normalized", N.name(F.col("name")))


_DATE_FORMS = {0: ("yyyy-MM-dd", "%Y-%m-%d"), 1: ("MMM yyyy", "%b %Y"), 2: ("MMMM yyyy", "%B %Y"), 3: ("MM/yyyy", "%m/%Y"), 4: ("yyyy", "%Y"), 5: ("MMM d, yyyy", "%b %-d, %Y"), 6: ("M/d/yyyy", "%-m/%-d/%Y")}
_DATE_CASES = " ".join(f"WHEN {k} THEN strftime(o_orderdate, {_q(sql)})" for k, (_, sql) in _DATE_FORMS.items())


def _dated(spark, d):
    k = F.col("o_orderkey") % 9
    text = F.when(k == 7, "Present").when(k == 8, "some day")
    for i, (layout, _) in _DATE_FORMS.items():
        text = text.when(k == i, F.date_format("o_orderdate", layout))
    return table(spark, d, "orders").select("o_orderkey", text.alias("raw"))


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 7 THEN 'Present' WHEN 8 THEN 'some day' {_DATE_CASES} END AS raw,
  CASE o_orderkey % 9 WHEN 7 THEN NULL WHEN 8 THEN 'some day' WHEN 4 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS normalized FROM orders"""
)
def date_normalize(spark, d):
    return _dated(spark, d).withColumn("normalized", N.date(F.col("raw")))


@query(f"""WITH p AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 7 THEN 'Present' WHEN 8 THEN 'some day' {_DATE_CASES} END AS raw FROM orders) SELECT o_orderkey, regexp_matches(raw, {_q(V.CANONICAL_DATE)}) AS canonical FROM p""")
def date_validate(spark, d):
    return _dated(spark, d).select("o_orderkey", validate.canonical_date(F.col("raw")).alias("canonical"))


_TERMS = ["the", "of", "tion", "de", "la", "and", *V.TECH_TERMS]  # words that the texts hold, and the whole dictionary


def _sql_term(t: str) -> str:
    import re

    return _q(rf"(?i)(?:^|[^A-Za-z0-9]){re.escape(t)}(?:$|[^A-Za-z0-9+#.])")


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, {_sql_term(t)}) THEN {_q(t)} END" for t in _TERMS) + ") AS terms FROM documents")
def tech_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.tech_terms(F.col("text"), _TERMS), ",").alias("terms"))


_SKILLS = ["Python", "py", "JS", "javascript", "ReactJS", "SQL", "sql", "AWS", "aws", "Docker Container", "docker", "Go", "C++"]
_SKILL_LIST = "[" + ", ".join(map(_q, _SKILLS)) + "]"
_SYNONYMS = N.synonym_index(C.STANDARD_SYNONYMS)
_SYNONYM_MAP = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in _SYNONYMS.items()) + "}"
_PICK = f"list_transform(range(6), lambda i: {_SKILL_LIST}[((p_partkey * 7 + i * 5) % {len(_SKILLS)}) + 1])"
_NAMED = f"list_transform({_PICK}, lambda s: coalesce({_SYNONYM_MAP}[lower(s)], s))"


def _skilled(spark, d):
    own = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.get(F.array(*map(F.lit, _SKILLS)), ((F.col("p_partkey") * 7 + i * 5) % len(_SKILLS)).cast("int")))
    return table(spark, d, "part").select("p_partkey", own.alias("skills"))


@query(f"WITH p AS (SELECT p_partkey, {_NAMED} AS s FROM part) SELECT p_partkey, array_to_string(list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i), ',') AS skills FROM p")
def skill_synonyms_dedup(spark, d):
    return _skilled(spark, d).select("p_partkey", F.array_join(N.skill_synonyms(F.col("skills"), C.STANDARD_SYNONYMS), ",").alias("skills"))


@query(
    "__LCS__, near AS (SELECT list(a || '|' || b) AS x FROM scored WHERE score >= 0.85), g AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY p_brand)"
    " SELECT p_brand, array_to_string(list_reduce(list_transform(names, lambda n: [n]), lambda acc, n: CASE WHEN len(list_filter(acc, lambda y: list_contains(near.x, y || '|' || n[1]))) = 0 THEN list_concat(acc, n) ELSE acc END), ',') AS kept FROM g, near"
)
def skill_fuzzy_dedup(spark, d):
    names = table(spark, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    return names.select("p_brand", F.array_join(N.near_distinct(F.col("names")), ",").alias("kept"))


_DEGREES = ["B.E", "B.E. in Computer Science", "Bachelor of Engineering (B.E.)", "M.S., Physics", "MBA", "Ph.D in Law", "Diploma", "BTech (Hons)", ""]


def _degree_sql(c: str) -> str:
    clean = f"trim(lower(regexp_replace({c}, '([A-Za-z])\\.([A-Za-z])', '\\1\\2', 'g')))"
    core = f"trim(regexp_replace({clean}, '[,(].*$|\\s+in\\s+.*$', ''))"
    first = f"regexp_extract(regexp_replace({core}, '[^a-z\\s]', '', 'g'), '^([a-z]+)', 1)"
    return f"coalesce(MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in V.DEGREES.items())}}}[{first}], nullif({core}, ''), {clean})"


@query(f"WITH p AS (SELECT n_nationkey, i, [{', '.join(map(_q, _DEGREES))}][i] AS degree FROM nation, range(1, {len(_DEGREES) + 1}) AS r(i)) SELECT n_nationkey, CAST(i AS BIGINT) AS i, degree, {_degree_sql('degree')} AS canonical FROM p")
def degree_canonical(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, _DEGREES))).alias("i", "degree"))
    return rows.select("n_nationkey", (F.col("i") + 1).cast("long").alias("i"), "degree", N.degree(F.col("degree")).alias("canonical"))


# Similarity

_LCS = """
WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s FROM part),
pairs AS (SELECT a.name AS a, b.name AS b, a.s AS sa, b.s AS sb FROM n a JOIN n b ON a.name < b.name),
lcs AS (SELECT a, b, sa, sb, 0 AS i, list_transform(range(length(sb) + 1), lambda x: 0) AS r FROM pairs
  UNION ALL SELECT a, b, sa, sb, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(sb) + 1), lambda j: [j])),
    lambda acc, x: list_append(acc, CASE WHEN sb[x[1]] = sa[i + 1] THEN r[x[1]] + 1 ELSE greatest(r[x[1] + 1], acc[len(acc)]) END)) FROM lcs WHERE i < length(sa)),
scored AS (SELECT a, b, 2.0 * r[len(r)] / (length(sa) + length(sb)) AS score FROM lcs WHERE i = length(sa))
"""


ORACLE_SQL["skill_fuzzy_dedup"] = ORACLE_SQL["skill_fuzzy_dedup"].replace("__LCS__", _LCS)  # the scored pairs of names are made above


@query(_LCS + "SELECT a, b, CAST(round(score, 6) AS DOUBLE) AS score FROM scored WHERE score >= 0.8")
def token_sort_pairs(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return resolve.name_pairs(names, 0.8).select("a", "b", F.round("score", 6).alias("score"))


@query(_LCS + "SELECT a, b, CAST(round(score, 6) AS DOUBLE) AS score FROM scored")
def token_sort_ratio_all(spark, d):
    """The ratio as a Column expression, for each pair of the few distinct part names."""
    names = table(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b")).select("a", "b", F.round(Z.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("score"))


@query(
    _LCS
    + """, f AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name),
e AS (SELECT x.id AS i, y.id AS j FROM scored JOIN f x ON a = x.name JOIN f y ON b = y.name WHERE score >= 0.85),
both_ways AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
reach AS (SELECT id AS i, id AS j FROM f UNION SELECT reach.i, both_ways.j FROM reach JOIN both_ways ON reach.j = both_ways.i)
SELECT p_partkey AS record_id, g.group_id FROM part JOIN f ON p_name = name JOIN (SELECT i, min(j) AS group_id FROM reach GROUP BY i) g ON g.i = f.id"""
)
def fuzzy_components(spark, d):
    records = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("email"))
    return resolve.resolve(records, C.Resolution())


@query(
    """WITH p AS (SELECT p_partkey AS id, lower('P' || (p_partkey // 4)) AS mail FROM part)
SELECT x.id AS i, y.id AS j, 'email:exact' AS reason FROM p x JOIN p y ON x.mail = y.mail AND x.id < y.id"""
)
def match_reasons_email(spark, d):
    """Matching pairs by e-mail over every part; four parts share a key, at any size."""
    records = table(spark, d, "part").select(F.col("p_partkey").alias("record_id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 4).cast("string")).alias("email"))
    return resolve.matches(records, C.Resolution())


_PLACES = ["Bengaluru, India", "Bangalore", "NYC", "New York City", "Hyderabad", "Hyderabad, IN", "UK"]
_ALIAS_MAP = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in V.LOCATION_ALIASES.items()) + "}"


def _place_sql(c: str) -> str:
    text = f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    tokens = f"array_to_string(list_transform(string_split({text}, ' '), lambda t: coalesce({_ALIAS_MAP}[t], t)), ' ')"
    return f"coalesce({_ALIAS_MAP}[{tokens}], {tokens})"


@query(
    f"""WITH p AS (SELECT c_custkey, [{', '.join(map(_q, _PLACES))}][(c_custkey % 7) + 1] AS a, [{', '.join(map(_q, _PLACES))}][((c_custkey // 7) % 7) + 1] AS b,
  lpad(CAST(c_custkey % 10 AS VARCHAR), 10, '9') AS p1, CASE c_custkey % 3 WHEN 0 THEN '+91 ' WHEN 1 THEN '' ELSE '0-0' END || lpad(CAST(c_custkey % 10 AS VARCHAR), 10, '9') AS p2 FROM customer),
q AS (SELECT *, {_place_sql('a')} AS fa, {_place_sql('b')} AS fb, regexp_replace(p2, '\\D', '', 'g') AS n2 FROM p)
SELECT c_custkey, fa, fb, fa = fb AS same_place, fa <> fb AND (contains(fa, fb) OR contains(fb, fa)) AS inside,
  CASE WHEN length(n2) > 10 AND n2[1] = '0' THEN n2[2:] ELSE n2 END AS phone_form,
  CASE WHEN p1 = CASE WHEN length(n2) > 10 AND n2[1] = '0' THEN n2[2:] ELSE n2 END THEN 1.0 WHEN ends_with(n2, p1) THEN 0.95 END::DOUBLE AS phone_similarity FROM q"""
)
def field_similarity(spark, d):
    places = F.array(*map(F.lit, _PLACES))
    k, conf = F.col("c_custkey"), C.Confidence()
    p1 = F.lpad((k % 10).cast("string"), 10, "9")
    df = table(spark, d, "customer").select("c_custkey", score.form("location", F.get(places, (k % 7).cast("int")), conf).alias("fa"), score.form("location", F.get(places, (F.floor(k / 7) % 7).cast("int")), conf).alias("fb"), score.form("phone", p1, conf).alias("p1"), score.form("phone", F.concat(F.when(k % 3 == 0, "+91 ").when(k % 3 == 1, "").otherwise("0-0"), p1), conf).alias("phone_form"))
    place = score.similarity("location", F.col("fa"), F.col("fb"), lambda a, b: F.lit(0.0))
    return df.select("c_custkey", "fa", "fb", (place == 1.0).alias("same_place"), (place == 0.9).alias("inside"), "phone_form", score.similarity("phone", F.col("p1"), F.col("phone_form"), lambda a, b: F.lit(None).cast("double")).alias("phone_similarity"))


# Survivorship

_SOURCE_SQL = "['ats', 'csv', 'resume_txt', 'json', 'resume_pdf'][(o_orderkey % 5) + 1]"
_SOURCE_LIST = ["ats", "csv", "resume_txt", "json", "resume_pdf"]


def _members(spark, d) -> DataFrame:
    """Orders as records of their customers; blanks hide values in every third and fourth."""
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, " ").when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), k.alias("record_id"), F.get(F.array(*map(F.lit, _SOURCE_LIST)), (k % 5).cast("int")).alias("source"), value.alias("name"))


_MEMBERS = f"SELECT o_custkey AS group_id, o_orderkey AS record_id, {_SOURCE_SQL} AS source, CASE WHEN o_orderkey % 3 = 0 THEN ' ' WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS name FROM orders"
_RANK = "CASE source WHEN 'resume_pdf' THEN 0 WHEN 'linkedin' THEN 1 WHEN 'ats' THEN 2 WHEN 'json' THEN 3 WHEN 'csv' THEN 4 ELSE 5 END"
_PRIORITY = ("resume_pdf", "linkedin", "ats", "json", "csv")


@query(
    f"""WITH m AS (SELECT *, {_RANK} AS r FROM ({_MEMBERS})), l AS (SELECT *, record_id = max(record_id) OVER (PARTITION BY group_id, source) AS is_last FROM m)
SELECT group_id, coalesce(arg_min(name, r) FILTER (is_last AND r < 5 AND length(trim(name)) > 0), arg_min(name, record_id) FILTER (length(trim(name)) > 0)) AS name FROM l GROUP BY group_id"""
)
def merge_priority(spark, d):
    return merge.with_last(_members(spark, d)).groupBy("group_id").agg(merge.priority_scalar("name", _PRIORITY).alias("name"))


@query(f"WITH m AS ({_MEMBERS}) SELECT group_id, arg_max(name, length(name) * 1000000000 - record_id) FILTER (length(trim(name)) > 0) AS name FROM m GROUP BY group_id")
def merge_most_complete(spark, d):
    return _members(spark, d).groupBy("group_id").agg(merge.most_complete_scalar("name").alias("name"))


_ITEM_SQL = f"""SELECT l_suppkey AS group_id, l_orderkey * 10 + l_linenumber AS record_id, ['ats', 'csv', 'resume_txt', 'json', 'resume_pdf'][(l_orderkey % 5) + 1] AS source,
  CASE WHEN l_orderkey % 6 = 0 THEN [] ELSE [p_brand, CASE WHEN l_linenumber % 2 = 0 THEN lower(p_type) ELSE p_type END] END AS skills FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _skill_members(spark, d):
    k = F.col("l_orderkey")
    df = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_brand"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))))
    return df.select(F.col("l_suppkey").alias("group_id"), (k * 10 + F.col("l_linenumber")).alias("record_id"), F.get(F.array(*map(F.lit, _SOURCE_LIST)), (k % 5).cast("int")).alias("source"), own.alias("skills"))


@query(
    f"""WITH m AS (SELECT *, {_RANK} AS r FROM ({_ITEM_SQL})), x AS (SELECT group_id, r, record_id, unnest(skills) AS skill, generate_subscripts(skills, 1) AS pos FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, lower(skill) ORDER BY r, record_id, pos, skill) AS k FROM x)
SELECT group_id, string_agg(skill, ',' ORDER BY r, record_id, pos, skill) AS skills FROM o WHERE k = 1 GROUP BY group_id"""
)
def merge_union_skills(spark, d):
    return merge.union_skills(_skill_members(spark, d), _PRIORITY).select("group_id", F.array_join("skills", ",").alias("skills"))


@query(f"""WITH m AS (SELECT *, {_RANK} AS r FROM ({_ITEM_SQL})), o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY r, record_id, skills) AS k FROM m WHERE len(skills) > 0) SELECT group_id, array_to_string(skills, ',') AS skills FROM o WHERE k = 1""")
def merge_list_first(spark, d):
    one = _skill_members(spark, d).groupBy("group_id", "record_id", "source").agg(F.min("skills").alias("skills"))
    return one.groupBy("group_id").agg(F.array_join(merge.first_list("skills", _PRIORITY), ",").alias("skills"))


@query("""WITH p AS (SELECT user_id AS group_id, event_id AS record_id, event_type AS k, CAST(value AS VARCHAR) AS v FROM events), q AS (SELECT group_id, record_id, k, v FROM p UNION ALL SELECT group_id, record_id, 'seen', CAST(record_id AS VARCHAR) FROM p)
SELECT group_id, k AS key, arg_min(v, record_id) AS value FROM q GROUP BY group_id, k""")
def merge_extra_map(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("record_id"), F.create_map(F.col("event_type"), F.col("value").cast("string"), F.lit("seen"), F.col("event_id").cast("string")).alias("extra_fields"))
    return merge.extra_map(rows).select("group_id", F.explode("extra_fields").alias("key", "value"))


def _site_sql(u: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({u}, '(?i)(?:^|//|\\.){host}\\.com') THEN '{label}'" for label, host in V.LINK_SITES.items()) + " ELSE 'Website' END"


def _url_key_sql(u: str) -> str:
    return f"rtrim(regexp_replace(regexp_replace(lower(trim({u})), '^https?://', ''), '^www\\.', ''), '/')"


#: Of links (g, ord, url, label): the first of each telling label, and of other ones the first of each URL.
_FIRST_LINKS = f"""k AS (SELECT *, lower(label) IN ({', '.join(map(_q, V.GENERIC_LABELS))}) AS plain, {_url_key_sql('url')} AS u FROM x),
kept AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY g, plain, CASE WHEN plain THEN u ELSE lower(label) END ORDER BY ord) = 1)"""


@query(
    f"""WITH r AS (SELECT page_id // 10 AS g, page_id, [url, 'https://github.com/u' || (page_id % 7)] AS urls FROM pages),
x AS (SELECT g, page_id * 2 + i AS ord, urls[i] AS url, {_site_sql('urls[i]')} AS label FROM r, range(1, 3) AS t(i)), {_FIRST_LINKS}
SELECT g AS group_id, CAST(row_number() OVER (PARTITION BY g ORDER BY ord) - 1 AS INTEGER) AS pos, url, label FROM kept"""
)
def merge_links(spark, d):
    rows = table(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("group_id"), F.col("page_id").alias("record_id"), F.lit("csv").alias("source"), F.array(X.link(F.col("url"), X.site(F.col("url"))), X.link(F.concat(F.lit("https://github.com/u"), (F.col("page_id") % 7).cast("string")), F.lit("GitHub"))).alias("links"))
    return rows.groupBy("group_id").agg(X.merge_links(merge.ordered_items("links", ("csv",))).alias("links")).select("group_id", F.posexplode("links").alias("pos", "x")).select("group_id", "pos", "x.*")


_COMPANIES = ["Acme Rockets", "Blue Kitchens", "Zug Transport", "Quiet Forge"]


@query(
    f"""WITH j AS (SELECT o_custkey AS g, o_orderkey AS k, {_COMPANIES}[o_orderkey % 4 + 1] AS company, CASE WHEN o_orderkey % 3 > 0 THEN 'Head Cook' END AS title, o_orderpriority AS description, CASE WHEN o_orderkey % 5 > 1 THEN o_orderstatus END AS location FROM orders),
f AS (SELECT g, company, min(k) AS k, any_value(title) AS title, arg_max(description, length(description) * 1000000000 - k) AS description, arg_min(location, k) FILTER (location IS NOT NULL) AS location FROM j GROUP BY g, company)
SELECT g AS group_id, CAST(row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS INTEGER) AS pos, company, title, description, location FROM f"""
)
def merge_experience(spark, d):
    """Orders as jobs of their customers, folded into distinct ones: no two companies are alike, and titles are alike or missing."""
    k = F.col("o_orderkey")
    job = F.struct(F.get(F.array(*map(F.lit, _COMPANIES)), (k % 4).cast("int")).alias("company"), F.when(k % 3 > 0, "Head Cook").alias("title"), F.lit(None).cast(DURATION).alias("duration"), F.col("o_orderpriority").alias("description"), F.when(k % 5 > 1, F.col("o_orderstatus")).alias("location")).cast(EXPERIENCE)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), k.alias("record_id"), F.lit("resume_pdf").alias("source"), F.array(job).alias("experience"))
    folded = rows.groupBy("group_id").agg(merge.ordered_items("experience", ("resume_pdf",)).alias("x")).select("group_id", merge.fold_experience(F.col("x")).alias("x"))
    return folded.select("group_id", F.posexplode("x").alias("pos", "x")).select("group_id", "pos", "x.company", "x.title", "x.description", "x.location")


_SCHOOLS = ["MIT", "Oxford University", "ETH Zurich"]
_BACHELORS = ["B.E", "Bachelor of Engineering in Physics", "B.E., Law"]


@query(
    f"""WITH j AS (SELECT o_custkey AS g, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN 'PhD' ELSE {_BACHELORS}[o_orderkey % 3 + 1] END AS degree, {_SCHOOLS}[(o_orderkey // 4) % 3 + 1] AS school, o_orderkey % 4 = 3 AS doctor, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey / 8.0::DOUBLE END AS gpa FROM orders),
f AS (SELECT g, school, doctor, min(k) AS k, arg_max(degree, length(degree) * 1000000000 - k) AS degree, arg_min(gpa, k) FILTER (gpa IS NOT NULL) AS gpa FROM j GROUP BY g, school, doctor)
SELECT g AS group_id, CAST(row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS INTEGER) AS pos, school AS institution, degree, gpa FROM f"""
)
def merge_education(spark, d):
    """Orders as degrees of their customers: one entry for each school and degree, however the degree is written."""
    k = F.col("o_orderkey")
    degree = F.when(k % 4 == 3, "PhD").otherwise(F.get(F.array(*map(F.lit, _BACHELORS)), (k % 3).cast("int")))
    school = F.get(F.array(*map(F.lit, _SCHOOLS)), (F.floor(k / 4) % 3).cast("int"))
    entry = F.struct(school.alias("institution"), degree.alias("degree"), F.lit(None).cast("string").alias("field_of_study"), F.lit(None).cast(DURATION).alias("duration"), F.when(k % 2 == 0, k / F.lit(8.0)).alias("gpa")).cast(EDUCATION)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), k.alias("record_id"), F.lit("resume_pdf").alias("source"), F.array(entry).alias("education"))
    folded = rows.groupBy("group_id").agg(merge.ordered_items("education", ("resume_pdf",)).alias("x")).select("group_id", merge.fold_education(F.col("x")).alias("x"))
    return folded.select("group_id", F.posexplode("x").alias("pos", "x")).select("group_id", "pos", "x.institution", "x.degree", "x.gpa")


def _links_sql() -> str:
    """Site by site: its links, then a text without them; last, the other URLs."""
    steps, parts = ["t0 AS (SELECT page_id, concat_ws(' ', url, html) AS t FROM pages)"], []
    for k, (label, host) in enumerate(V.LINK_SITES.items()):
        own = rf"(?:https?://)?(?:www\.)?{host}\.com/[\w\-_%/{'@' if label == 'Medium' else ''}]+"
        parts.append(f"SELECT page_id, {k} AS site, i, CASE WHEN regexp_matches(trim(m), '(?i)^https?://') THEN trim(m) ELSE 'https://' || trim(m) END AS url, '{label}' AS label FROM (SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT page_id, regexp_extract_all(t, {_q('(?i)' + own)}) AS ms FROM t{k}))")
        left = _q("(?i)(?:https?://[^\\s()<>\"']*?)?" + own)
        steps.append(f"t{k + 1} AS (SELECT page_id, regexp_replace(t, {left}, chr(1), 'g') AS t FROM t{k})")
    last = len(V.LINK_SITES)
    url = "regexp_replace(m, '[.,;:)]+$', '')"
    parts.append(f"SELECT page_id, {last}, i, {url}, {_site_sql(url)} FROM (SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT page_id, regexp_extract_all(t, {_q('(?i)' + V.GENERIC_URL)}) AS ms FROM t{last})) WHERE NOT contains({url}, chr(1))")
    return "WITH " + ", ".join(steps) + f", x AS (SELECT page_id AS g, CAST(site AS BIGINT) * 1000000000 + i AS ord, url, label FROM ({' UNION ALL '.join(parts)})), {_FIRST_LINKS} SELECT g AS page_id, CAST(row_number() OVER (PARTITION BY g ORDER BY ord) - 1 AS INTEGER) AS pos, url, label FROM kept"


query(_links_sql())(links_of_pages)

# Data quality


def _faulty(spark, d):
    k = F.col("c_custkey")
    return _records(
        table(spark, d, "customer").select(
            k.alias("record_id"), F.lit("csv").alias("source"),
            F.when(k % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"),
            F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, F.concat(F.lit("bad mail "), k.cast("string"))).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.com"))).alias("email"),
            F.when(k % 4 == 0, "12-34").when(k % 4 == 1, F.lit(None).cast("string")).otherwise("+919876543210").alias("phone"),
            F.when(k % 3 == 0, F.array(F.lit("SQL"), F.lit("sql "), F.lit("Go"))).otherwise(F.array(F.lit("SQL"))).alias("skills"),
            F.array(F.struct(F.lit("A").alias("company"), F.lit("B").alias("title"), F.struct(F.when(k % 6 == 0, "May 2020").otherwise("2020-05").alias("start"), F.when(k % 6 == 1, "2020-13").alias("end"), F.lit(False).alias("is_current")).alias("duration"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("location")).cast(EXPERIENCE)).alias("experience"),
            F.when(k % 8 == 0, F.array(X.link(F.lit("ftp://x"), F.lit("Site")))).otherwise(X.no_links()).alias("links"),
        )
    )


_FAULTY = """SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'bad mail ' || c_custkey ELSE 'c' || c_custkey || '@x.com' END AS email,
  CASE c_custkey % 4 WHEN 0 THEN '12-34' WHEN 1 THEN NULL ELSE '+919876543210' END AS phone FROM customer"""
_ISSUES = f"""WITH c AS ({_FAULTY}), i AS (
SELECT k, 'name' AS field, 'error' AS severity, 'Candidate name is required' AS message FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'email', 'error', 'Candidate email is required' FROM c WHERE email IS NULL
UNION ALL SELECT k, 'email', 'error', '''' || email || ''' is not a valid email address' FROM c WHERE k % 7 = 1
UNION ALL SELECT k, 'phone', 'warning', '''12-34'' does not appear to be a valid phone number' FROM c WHERE k % 4 = 0
UNION ALL SELECT k, 'experience[0].duration.start', 'warning', 'Non-canonical date ''May 2020'' in experience record' FROM c WHERE k % 6 = 0
UNION ALL SELECT k, 'experience[0].duration.end', 'warning', 'Non-canonical date ''2020-13'' in experience record' FROM c WHERE k % 6 = 1
UNION ALL SELECT k, 'skills', 'warning', 'Duplicate skill detected: ''sql '' (already present as ''SQL'')' FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'links[0].url', 'warning', '''ftp://x'' is not a valid URL (label: ''Site'')' FROM c WHERE k % 8 = 0
UNION ALL SELECT k, 'name', 'warning', 'Candidate name is missing' FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'email', 'warning', 'Email address is missing' FROM c WHERE email IS NULL
UNION ALL SELECT k, 'phone', 'warning', 'Phone number is missing' FROM c WHERE phone IS NULL
UNION ALL SELECT k, 'education', 'warning', 'Education history is missing' FROM c
UNION ALL SELECT k, 'links', 'warning', 'Professional links (LinkedIn/GitHub/Portfolio) not provided — recommended for a complete profile' FROM c WHERE k % 8 <> 0
UNION ALL SELECT k, 'summary', 'info', 'Professional summary not provided (optional)' FROM c
UNION ALL SELECT k, 'location', 'info', 'Location not provided (optional)' FROM c)"""


@query(_ISSUES + " SELECT k AS record_id, field, severity, message FROM i")
def validation_issues(spark, d):
    return validate.issue_rows(validate.validate(_faulty(spark, d))).select("record_id", "field", "severity", "message")


@query(
    _ISSUES
    + """, s AS (SELECT k, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM i GROUP BY k)
SELECT k AS record_id, e = 0 AS is_valid, CAST(e AS BIGINT) AS errors, CAST(w AS BIGINT) AS warnings, CAST(round(least(0.20, e * 0.05) + least(0.10, w * 0.01), 6) AS DOUBLE) AS penalty FROM s"""
)
def validation_summary(spark, d):
    count = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s)).cast("long")
    return validate.validate(_faulty(spark, d)).select("record_id", "is_valid", count("error").alias("errors"), count("warning").alias("warnings"), F.round(validate.penalty(F.col("issues"), C.Confidence()), 6).alias("penalty"))


@query(
    _ISSUES
    + """ SELECT k % 10 AS group_id, count(DISTINCT field || severity || message) AS issues, count(DISTINCT field || message) FILTER (severity = 'error') AS errors FROM i GROUP BY 1"""
)
def validation_union(spark, d):
    members = validate.validate(_faulty(spark, d)).withColumn("group_id", F.col("record_id") % 10)
    return validate.combined(members).select("group_id", F.size("issues").cast("long").alias("issues"), F.size(F.filter("issues", lambda x: x["severity"] == "error")).cast("long").alias("errors"))


@query(
    """SELECT c_custkey AS record_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS bad_mail, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS no_company, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS strange_link FROM customer"""
)
def cross_field_issues(spark, d):
    k = F.col("c_custkey")
    job = lambda company, title: F.array(F.struct(company.alias("company"), F.lit(title).alias("title"), F.lit(None).cast(DURATION).alias("duration"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("location")).cast(EXPERIENCE))
    df = table(spark, d, "customer").select(
        k.alias("record_id"), F.when(k % 3 == 0, "a b@c").otherwise("a@b.c").alias("email"), F.lit("Ada Lovelace").alias("name"),
        F.when(k % 4 == 0, job(F.lit(""), "Engineer")).when(k % 4 == 1, job(F.lit(""), "Freelancer")).otherwise(job(F.lit("X"), "Engineer")).alias("experience"),
        F.array(X.link(F.when(k % 5 == 0, "https://linkedin.com/in/bob").otherwise("https://linkedin.com/in/ADA1"), F.lit("LinkedIn"))).alias("links"),
    )
    n = lambda f: F.size(F.filter("x", lambda i: i["field"] == f)).cast("int")
    return df.withColumn("x", validate.cross_field()).select("record_id", n("email").alias("bad_mail"), n("experience").alias("no_company"), n("links").alias("strange_link"))


# Scores

_RELIABILITY_SQL = "CASE source WHEN 'ats' THEN 0.95 WHEN 'resume_pdf' THEN 0.85 WHEN 'json' THEN 0.75 WHEN 'csv' THEN 0.70 ELSE 0.5 END"


@query(f"WITH m AS (SELECT event_id // 4 AS block, ['ats', 'csv', 'resume_txt', 'json', 'resume_pdf'][(event_id % 5) + 1] AS source FROM events) SELECT block, count(*) AS n, CAST(round(1 - product(CAST(1 - {_RELIABILITY_SQL} AS DOUBLE)), 9) AS DOUBLE) AS combined FROM m GROUP BY block")
def noisy_or_reliability(spark, d):
    """Over every event; a whole user's product is 1 to nine digits, so four events share a key, at any size."""
    source = F.get(F.array(*map(F.lit, _SOURCE_LIST)), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 4).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.round(score.noisy_or(score.reliability(source, C.standard().source_reliability)), 9).alias("combined"))


@query(
    """WITH p AS (SELECT c_custkey, (c_custkey % 101) / 100.0::DOUBLE AS s FROM customer) SELECT c_custkey, CAST(round(CASE WHEN s >= 0.95::DOUBLE THEN 0.05::DOUBLE * s WHEN s >= 0.80::DOUBLE THEN 0.05::DOUBLE * 0.95::DOUBLE * (s - 0.80::DOUBLE) / (0.95::DOUBLE - 0.80::DOUBLE) ELSE -0.10::DOUBLE * (1 - s / 0.80::DOUBLE) END, 9) AS DOUBLE) AS adjustment FROM p"""
)
def agreement_curve(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(score.agreement_curve((F.col("c_custkey") % 101) / F.lit(100.0), 0.95, 0.80, 0.05, 0.10), 9).alias("adjustment"))


@query(
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN TIMESTAMP '2030-01-01' ELSE ts END AS t FROM events)
SELECT event_id, CAST(round(CASE WHEN t IS NULL OR t > TIMESTAMP '2025-06-01' THEN 1.0 ELSE greatest(0.5, pow(0.5, floor((epoch_us(TIMESTAMP '2025-06-01') // 1000000 - epoch_us(t) // 1000000) / 86400.0) / 365.0)) END, 9) AS DOUBLE) AS phone_weight, CAST(1.0 AS DOUBLE) AS name_weight FROM p"""
)
def freshness_decay(spark, d):
    k, now, conf = F.col("event_id") % 50, F.lit(AS_OF), C.Confidence()
    t = F.when(k == 0, F.lit(None).cast("timestamp")).when(k == 1, F.lit(datetime.datetime(2030, 1, 1)).cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.round(score.freshness("phone", t, now.cast("timestamp"), conf), 9).alias("phone_weight"), score.freshness("name", t, now.cast("timestamp"), conf).alias("name_weight"))


@query(
    f"""WITH m AS (SELECT o_custkey AS group_id, {_SOURCE_SQL} AS source, o_totalprice FROM orders), g AS (SELECT group_id, count(*) AS n, count(*) FILTER ({_RELIABILITY_SQL} >= 0.75) AS t, (max(CAST(floor(o_totalprice) AS BIGINT)) % 97) / 97.0::DOUBLE AS f FROM m GROUP BY group_id),
b AS (SELECT *, CASE WHEN t >= 2 THEN 0.05 ELSE 0.0 END::DOUBLE AS bonus FROM g)
SELECT group_id, n, bonus, CAST(round(greatest(0, least(1, f * CASE WHEN n <= 1 THEN 0.70 WHEN n < 5 THEN 0.50 ELSE 0.45 END::DOUBLE + 0.5::DOUBLE * CASE WHEN n <= 1 THEN 0.30 WHEN n < 5 THEN 0.25 ELSE 0.20 END::DOUBLE
  + 0.8::DOUBLE * CASE WHEN n <= 1 THEN 0.0 WHEN n < 5 THEN 0.25 ELSE 0.35 END::DOUBLE + bonus - 0.03::DOUBLE)), 3) AS DOUBLE) AS overall FROM b"""
)
def adaptive_overall_score(spark, d):
    conf, k = C.Confidence(), F.col("o_orderkey")
    source = F.get(F.array(*map(F.lit, _SOURCE_LIST)), (k % 5).cast("int"))
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(score.reliability(source, C.standard().source_reliability) >= 0.75).alias("t"), ((F.max(F.floor("o_totalprice")) % 97) / F.lit(97.0)).alias("f"))
    g = g.withColumn("bonus", score.diversity_bonus(F.col("t"), conf))
    return g.select("group_id", "n", "bonus", score.overall(F.col("f"), F.lit(0.5), F.lit(0.8), F.col("n"), F.col("bonus"), F.lit(0.03), conf).alias("overall"))


@query(
    """SELECT c_custkey AS record_id, CAST(round(CASE WHEN c_custkey % 2 = 0 THEN 0.10 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0.08 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 0.20 ELSE 0 END, 3) AS DOUBLE) AS completeness FROM customer"""
)
def completeness_score(spark, d):
    k = F.col("c_custkey")
    df = _records(table(spark, d, "customer").select(k.alias("record_id"), F.lit("csv").alias("source"), F.when(k % 2 == 0, F.col("c_name")).otherwise(" ").alias("name"), F.when(k % 3 == 0, "a@b.c").alias("email"), F.when(k % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("skills"), F.lit("here").alias("location")))
    return df.select("record_id", score.completeness(C.Confidence()).alias("completeness"))


@query(
    f"""WITH p AS (SELECT o_custkey AS group_id, o_orderkey AS record_id, 'U' || (o_orderkey % 2) || '@x.com' AS email FROM orders), g AS (SELECT group_id, count(*) AS n, count(DISTINCT lower(email)) AS d FROM p GROUP BY group_id)
SELECT group_id, n, CASE WHEN n < 2 THEN NULL WHEN d = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM g"""
)
def source_agreement(spark, d):
    none = F.lit(None).cast("string")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("record_id"), F.concat(F.lit("U"), (F.col("o_orderkey") % 2).cast("string"), F.lit("@x.com")).alias("email"), none.alias("name"), none.alias("phone"), none.alias("location"), none.alias("summary"))
    return score.least_similarity(rows, C.Confidence()).where("field = 'email'").select("group_id", "n", "similarity")


_CONF = C.Confidence()
_MAIL = _CONF.thresholds("email")


@query(
    f"""WITH m AS (SELECT o_custkey AS g, o_orderkey AS k, {_SOURCE_SQL} AS source, 'u' || (CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_orderkey % 2 END) || '@x.com' AS email, o_orderkey % 3 = 0 AS skilled FROM orders),
w AS (SELECT *, CAST({_RELIABILITY_SQL} AS DOUBLE) AS w FROM m),
e AS (SELECT g, count(*) AS n, 1 - product(1 - w) AS c, CASE WHEN count(*) > 1 THEN CASE WHEN count(DISTINCT email) = 1 THEN 1.0 ELSE 0.0 END END AS s FROM w GROUP BY g),
k AS (SELECT g, count(*) AS n, 1 - product(1 - w) AS c FROM w WHERE skilled GROUP BY g)
SELECT g AS group_id, 'email' AS field, CAST(round(greatest(0, least(1, c + CASE WHEN s = 1 THEN {_CONF.max_agreement_bonus} WHEN s = 0 THEN -{_CONF.conflict_penalty} ELSE 0 END)), 3) AS DOUBLE) AS score, CAST(s AS DOUBLE) AS similarity,
  n || ' source(s) contributing' || CASE WHEN s = 1 THEN '; sources agree' WHEN s = 0 THEN '; sources conflict (similarity=0%)' ELSE '' END AS reason FROM e
UNION ALL SELECT g, 'skills', CASE WHEN k.g IS NULL THEN 0.0 ELSE CAST(round(least(1, k.c), 3) AS DOUBLE) END, NULL, CASE WHEN k.g IS NULL THEN 'field absent' ELSE k.n || ' source(s) contributing' END FROM e LEFT JOIN k USING (g)
UNION ALL SELECT g, f, 0.0, NULL, 'field absent' FROM e, (SELECT unnest(['name', 'phone', 'location', 'summary', 'experience', 'education', 'links']) AS f)"""
)
def field_confidence(spark, d):
    """Orders as records of their customers: e-mails agree for even customers, some records have a skill."""
    k, g = F.col("o_orderkey"), F.col("o_custkey")
    mail = F.concat(F.lit("u"), F.when(g % 2 == 0, 0).otherwise(k % 2).cast("string"), F.lit("@x.com"))
    skills = F.when(k % 3 == 0, F.array(F.lit("SQL"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "orders").select(g.alias("group_id"), k.alias("record_id"), F.get(F.array(*map(F.lit, _SOURCE_LIST)), (k % 5).cast("int")).alias("source"), mail.alias("email"), skills.alias("skills"))
    members = _records(rows).join(rows.select("record_id", "group_id"), "record_id")
    golden = merge.merge(members, C.standard().merge_rules)
    return score.field_scores(golden, members, _CONF, C.standard().source_reliability, F.lit(AS_OF)).select("group_id", "field", "score", "similarity", "reason")


@query()
def field_scores(spark, d):
    members = grouped_people(spark, d)
    golden = merge.merge(members, C.standard().merge_rules)
    return score.field_scores(golden, members, C.Confidence(), C.standard().source_reliability, F.lit(AS_OF)).select("group_id", "field", "score", "similarity", "reason")


@query(
    """SELECT c_custkey AS group_id, 'confidence.overall_score' AS field, 'error' AS severity FROM customer WHERE c_acctbal / 5000 NOT BETWEEN 0 AND 1
UNION ALL SELECT c_custkey, 'confidence.field_scores[name]', 'error' FROM customer WHERE c_acctbal / 3000 NOT BETWEEN 0 AND 1"""
)
def schema_bounds_check(spark, d):
    bal = F.col("c_acctbal")
    report = table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), (bal / 5000).alias("overall_score"), F.array(F.struct(F.lit("name").alias("field_name"), (bal / 3000).alias("score"))).alias("field_scores"))
    return project.bounds_issues(report).select("group_id", "field", "severity")


# Lineage and projection


@query(
    """WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'resume_pdf' ELSE 'csv' END AS source, ' ' || c_name AS name, 'C' || c_custkey || '@X.com' AS email, c_mktsegment AS location FROM customer)
SELECT k % 100 AS group_id, k AS record_id, 'name' AS field_name, source, name AS original_value, trim(name) AS normalized_value, CASE WHEN source = 'csv' THEN 'direct' ELSE 'inferred' END AS extraction_method, 'normalized from ''' || name || '''' AS notes FROM p
UNION ALL SELECT k % 100, k, 'email', source, email, lower(email), CASE WHEN source = 'csv' THEN 'direct' ELSE 'regex' END, 'normalized from ''' || email || '''' FROM p
UNION ALL SELECT k % 100, k, 'location', source, location, location, CASE WHEN source = 'csv' THEN 'direct' ELSE 'regex' END, NULL FROM p"""
)
def provenance_unpivot(spark, d):
    k = F.col("c_custkey")
    df = _records(table(spark, d, "customer").select(k.alias("record_id"), F.when(k % 2 == 0, "resume_pdf").otherwise("csv").alias("source"), F.concat(F.lit(" "), F.col("c_name")).alias("name"), F.concat(F.lit("C"), k.cast("string"), F.lit("@X.com")).alias("email"), F.col("c_mktsegment").alias("location")))
    members = normalize.normalize(df, C.standard().normalization).withColumn("group_id", F.col("record_id") % 100)
    return lineage.provenance(members, C.standard().source_reliability).select("group_id", "record_id", "field_name", "source", "original_value", "normalized_value", "extraction_method", "notes")


@query("SELECT c_custkey AS group_id, c_name AS full_name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'n/a') AS place, '' AS skills FROM customer")
def projection_rename_default(spark, d):
    df = _records(table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.lit("csv").alias("source"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("location"), F.lit(None).cast("array<string>").alias("skills")))
    conf = C.Projection((C.Projected("name", "full_name"), C.Projected("email", "mail", include=False), C.Projected("location", "place", default="n/a"), C.Projected("skills", "skills", default=[])))
    return df.select(F.col("record_id").alias("group_id"), *project.output_fields(conf, df.columns)).withColumn("skills", F.array_join("skills", ","))


@query("SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN 'name,links' ELSE 'name' END AS scores, CASE WHEN o_orderkey % 2 = 0 THEN 'my name' ELSE 'the surname' END AS lines FROM orders")
def projection_filters(spark, d):
    conf = C.Projection((C.Projected("name", "n"), C.Projected("links", "l")))
    k = F.col("o_orderkey") % 2
    mark = lambda f: F.struct(F.lit(f).alias("field_name"))
    scores = F.when(k == 0, F.array(mark("name"), mark("email"), mark("links"))).otherwise(F.array(mark("skills"), mark("name")))
    text = F.when(k == 0, F.array(F.lit("my name"), F.lit("no email here"))).otherwise(F.array(F.lit("few skills"), F.lit("the surname"), F.lit("phone: absent")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.array_join(F.transform(project.keep_scores(scores, conf), lambda x: x["field_name"]), ",").alias("scores"), F.array_join(project.keep_explanations(text, conf), ",").alias("lines"))


# Extraction

_HEADERS = ["Full Name", "E-Mail", "mobile no", "Current-City", "Tech Stack", "Bio", "x", " LinkedIn URL "]


@query(
    "WITH h AS (SELECT n_nationkey, unnest(["
    + ", ".join(map(_q, _HEADERS))
    + "]) AS header FROM nation) SELECT n_nationkey, header, MAP {"
    + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in X.ALIASES.items())
    + "}[translate(lower(trim(header)), ' -', '__')] AS field FROM h"
)
def field_alias_resolve(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _HEADERS))).alias("header"))
    return rows.withColumn("field", X.resolve_field(F.col("header")))


def _raw(df: DataFrame) -> DataFrame:
    kinds = {p.split(" ", 1)[0]: p.split(" ", 1)[1] for p in ["record_id long", "input_ord int", "row_ord long", "source string", "source_file string", "fields array<struct<key:string,value:string>>", "raw_json string", "raw_text string", "parse_errors array<string>"]}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


@query(
    """SELECT c_custkey AS record_id, c_name AS name, 'c' || c_custkey || '@x.com' AS email, c_mktsegment AS company, CASE WHEN c_custkey % 2 = 0 THEN '2020' END AS started, c_custkey % 2 = 0 AS is_current,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 10) + 0.51 END::DOUBLE AS gpa, 'Python,SQL,Go,Rust,Kotlin' AS skills, 'https://github.com/u' || c_custkey AS link, CAST(c_acctbal AS VARCHAR) AS extra, '["Chess","Go"]' AS achievements FROM customer"""
)
def csv_extract(spark, d):
    k = F.col("c_custkey")
    cells = {
        "Candidate_ID": F.col("c_acctbal").cast("string"), "Full Name": F.col("c_name"), "E-mail": F.concat(F.lit("c"), k.cast("string"), F.lit("@x.com")), "Employer": F.col("c_mktsegment"), "Start Date": F.when(k % 2 == 0, "2020"),
        "College": F.lit("MIT"), "CGPA": F.when(k % 3 == 0, "n/a").otherwise(F.concat((k % 10).cast("string"), F.lit(".5 / 10"))), "Skills": F.lit('["python", "SQL", "sql", "Go"]'), "More": F.lit("Rust; Kotlin"), "github_username": F.concat(F.lit("@u"), k.cast("string")), "Awards": F.lit("Chess; Go"),
    }
    raw = _raw(table(spark, d, "customer").select(k.alias("record_id"), F.lit("csv").alias("source"), F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in cells.items()]).alias("fields"), F.array().cast("array<string>").alias("parse_errors")))
    job = F.get("experience", F.lit(0))
    return extract.extract_csv(raw).select("record_id", "name", "email", job["company"].alias("company"), job["duration"]["start"].alias("started"), F.coalesce(job["duration"]["is_current"], F.lit(False)).alias("is_current"), F.get("education", F.lit(0))["gpa"].alias("gpa"), F.array_join("skills", ",").alias("skills"), F.get("links", F.lit(0))["url"].alias("link"), F.col("extra_fields")["Candidate_ID"].alias("extra"), F.col("extra_fields")["achievements"].alias("achievements"))


@query(
    """SELECT event_id AS record_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS name, 'e' || event_id || '@x.com' AS email, json_extract_string(props, '$.k') AS k, 'Acme' AS company, CASE WHEN event_id % 2 = 0 THEN NULL ELSE '2022' END AS ended, event_id % 2 = 0 AS is_current FROM events"""
)
def json_unwrap(spark, d):
    """Events as JSON records inside none to two wrappers, with a contact section one level down."""
    e, n = table(spark, d, "events"), F.col("event_id")
    inner = F.concat(
        F.lit('{"name": '), F.when(n % 4 == 3, "7").otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))), F.lit(', "props": '), F.col("props"),
        F.lit(', "contact": {"email": "e'), n.cast("string"), F.lit('@x.com"}, "employment": [{"organization": "Acme", "from": 2020, "to": '), F.when(n % 2 == 0, '"Present"').otherwise("2022"), F.lit("}]}"),
    )
    wrapped = F.when(n % 3 == 0, inner).when(n % 3 == 1, F.concat(F.lit('{"Candidate": '), inner, F.lit("}"))).otherwise(F.concat(F.lit('{"data": {"applicant": '), inner, F.lit("}}")))
    raw = _raw(e.select(n.alias("record_id"), F.lit("json").alias("source"), wrapped.alias("raw_json"), F.array().cast("array<string>").alias("parse_errors")))
    job = F.get("experience", F.lit(0))
    return extract.extract_json(raw).select("record_id", "name", "email", F.get_json_object(F.col("extra_fields")["props"], "$.k").alias("k"), job["company"].alias("company"), job["duration"]["end"].alias("ended"), job["duration"]["is_current"].alias("is_current"))


@query(
    """SELECT doc_id, 'Jane Q. Doe' AS header, trim(regexp_replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '^\\s+|\\s+$', '', 'g')) AS summary, CASE WHEN doc_id % 2 = 0 THEN 'Second' ELSE 'First' END AS skills FROM documents"""
)
def section_split(spark, d):
    flat = X.strip(F.translate("text", "\n\r", "  "))
    body = F.concat(F.lit("Jane Q. Doe\n\nSUMMARY:\n"), flat, F.lit("\n\n- Technical Skills -\nFirst\n"), F.when(F.col("doc_id") % 2 == 0, "Skills\nSecond\n").otherwise(""))
    parts = F.col("parts")
    return table(spark, d, "documents").withColumn("parts", resume.sections(body)).select("doc_id", resume.section(parts, "_header").alias("header"), resume.section(parts, "summary").alias("summary"), resume.section(parts, "skills").alias("skills"))


@query(
    """SELECT o_orderkey AS record_id, 'Engineer ' || o_orderstatus AS title, 'Acme ' || (o_custkey % 900) AS company, strftime(o_orderdate, '%b %Y') AS started, CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%b %Y') END AS ended, o_orderkey % 3 <> 1 AS is_current,
  CASE WHEN o_orderkey % 2 = 0 THEN 'built things - ' || o_orderpriority END AS description FROM orders"""
)
def experience_parse(spark, d):
    k, when = F.col("o_orderkey"), F.date_format("o_orderdate", "MMM yyyy")
    title, company = F.concat(F.lit("Engineer "), F.col("o_orderstatus")), F.concat(F.lit("Acme "), (F.col("o_custkey") % 900).cast("string"))
    span = F.when(k % 3 == 0, F.concat(when, F.lit(" - Present"))).when(k % 3 == 1, F.concat(when, F.lit(" – "), when)).otherwise(when)
    text = F.concat_ws("\n", F.when(k % 4 == 0, company).otherwise(F.concat(F.lit("Role: "), title)), F.when(k % 4 == 0, title).otherwise(company), span, F.when(k % 2 == 0, F.concat(F.lit("built things - "), F.col("o_orderpriority"))))
    x = F.get(resume.experience(text), F.lit(0))
    return table(spark, d, "orders").select(k.alias("record_id"), x["title"].alias("title"), x["company"].alias("company"), x["duration"]["start"].alias("started"), x["duration"]["end"].alias("ended"), x["duration"]["is_current"].alias("is_current"), x["description"].alias("description"))


@query(
    """SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS entries, 'Uni ' || o_custkey AS institution, 'B.E in Physics' AS degree, '2018' AS started, CASE WHEN o_orderkey % 3 = 0 THEN '2022' END AS ended, CAST(8.25 AS DOUBLE) AS gpa FROM orders"""
)
def education_fragment_merge(spark, d):
    """Degree and institution in two paragraphs are one entry; with an institution in the first they are two."""
    k = F.col("o_orderkey")
    place = F.concat(F.lit("Uni "), F.col("o_custkey").cast("string"))
    years = F.when(k % 3 == 0, "2018 - 2022").when(k % 3 == 1, "2018 – present").otherwise("2018")
    one = F.concat(F.lit("B.E in Physics\nCGPA: 8.25 / 10\n"), years)
    text = F.when(k % 2 == 0, F.concat(one, F.lit("\n\n"), place)).otherwise(F.concat(place, F.lit("\n"), one, F.lit("\n\nOther School\n2010")))
    x = resume.education(text)
    first = F.get(x, F.lit(0))
    return table(spark, d, "orders").select(k.alias("record_id"), F.size(x).alias("entries"), first["institution"].alias("institution"), first["degree"].alias("degree"), first["duration"]["start"].alias("started"), first["duration"]["end"].alias("ended"), first["gpa"].alias("gpa"))


@query("SELECT c_custkey AS record_id, 'Ada M. Lovelace' AS name, 'ada' || c_custkey || '@x.org' AS email, '+91 98765-43210' AS phone, 'Python,Go,C++,Rust,Kotlin' AS skills, 'LinkedIn,GitHub,Website' AS labels FROM customer")
def resume_parse(spark, d):
    text = F.concat(
        F.lit("Curriculum vitae 2024\nAda M. Lovelace\nada"), F.col("c_custkey").cast("string"), F.lit("@x.org | +91 98765-43210\nlinkedin.com/in/ada github.com/ada https://ada.dev.\n\nTechnical Skills and Coursework\nLanguages: Python, Go/cpp\n• Rust; Kotlin | x\n\nProjects\nSomething"),
    )
    raw = _raw(table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.lit("resume_txt").alias("source"), text.alias("raw_text"), F.array().cast("array<string>").alias("parse_errors")))
    return extract.extract_text(raw).select("record_id", "name", "email", "phone", F.array_join("skills", ",").alias("skills"), F.array_join(F.transform("links", lambda x: x["label"]), ",").alias("labels"))


@query("SELECT p_partkey, 'a,b c,d' AS cells, CASE WHEN p_partkey % 2 = 0 THEN 'Frameworks: ' ELSE '' END || p_name AS line FROM part")
def cell_split(spark, d):
    k = F.col("p_partkey")
    cell = F.when(k % 3 == 0, '["a", " b c ", "", "d"]').when(k % 3 == 1, "a; b c|,d").otherwise(" a\nb c\n\nd ")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.cell_list(cell), ",").alias("cells"), F.concat(F.when(k % 2 == 0, "Frameworks: ").otherwise(""), F.col("p_name")).alias("line"))


@query("SELECT source, coalesce(sum(n), 0)::BIGINT AS records FROM (SELECT 'csv' AS source, count(*) AS n FROM customer UNION ALL SELECT 'json', count(*) FROM orders UNION ALL SELECT 'ats', count(*) FROM supplier) GROUP BY source")
def union_sources(spark, d):
    return people(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("records"))


__all__ = ["EDUCATION", "ORACLE_SQL", "QUERIES", "RAW", "Column"]
