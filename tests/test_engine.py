"""Stages and the whole run on small inputs."""

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from weftwork import cli
from weftwork import config as C
from weftwork.functions import fuzzy as Z
from weftwork.operators import extract, lineage, merge, project, resolve, score, validate
from weftwork.plans import pipeline
from weftwork.schema import RECORD
from weftwork.sources import readers, sinks
from weftwork.streaming import stream

FULL = {"source_file": None, "name": None, "email": None, "phone": None, "location": None, "summary": None, "skills": [], "experience": [], "education": [], "links": [], "extra_fields": {}, "parse_errors": []}
JOB = {"company": "Acme", "title": "Engineer", "duration": None, "description": None, "location": None}


def records(spark, *rows):
    return spark.createDataFrame([FULL | {"record_id": i, "source": "csv"} | r for i, r in enumerate(rows)], RECORD)


def people(spark, rows):
    return spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(rows)], "record_id long, name string, email string")


# Resolution


def brute(rows, threshold=0.85):
    from weftwork.functions.fuzzy import plain_token_sort

    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        (a, m), (b, n) = rows[i], rows[j]
        if m and n and m.lower() == n.lower() or a and b and plain_token_sort(a, b) >= threshold:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize("seed,threshold", [(1, 0.85), (2, 0.7), (3, 0.95), (4, 1.0)])
def test_groups_equal_all_pairs(spark, seed, threshold):
    rng = random.Random(seed)
    names = ["John Smith", "Smith John", "Jon Smith", "Jane Doe", "J Doe", "Al", "A", "Maria de la Cruz", "Maria dela Cruz", "Christopher Longname", "Kristopher Longname", None, "", " "]
    rows = [("".join(c if rng.random() > 0.05 else rng.choice("xyz") for c in n) if (n := rng.choice(names)) else n, rng.choice([None, "", f"u{rng.randint(0, 9)}@X.com", f"U{rng.randint(0, 9)}@x.com"]) if rng.random() < 0.4 else None) for _ in range(60)]
    got = resolve.resolve(people(spark, rows).repartition(3), C.Resolution(name_similarity_threshold=threshold)).orderBy("record_id").collect()
    assert [r.group_id for r in got] == brute(rows, threshold)


@pytest.mark.parametrize("threshold", [0.4, 0.8, 0.85, 1.0])
def test_name_pairs_equal_brute_force(spark, threshold):
    r = random.Random(3)
    word = lambda k: "".join(r.choice("abcdeé") for _ in range(k))
    names = {" ".join(word(r.randint(1, 7)) for _ in range(r.randint(1, 3))) for _ in range(60)} | {"", " ", "a", "ab", "ab c", "c ab", "c  ab"}
    for x in sorted(names)[:40]:
        k = r.randrange(len(x) + 1)
        names.add(x[:k] + r.choice("abz") + x[k + 1 :])
    long = [word(resolve.PLACED + k) for k in (0, 1, 30)]
    names |= set(long) | {x[3:50] + x[52:] for x in long} | {x[:40] + "zz" + x[40:] for x in long}
    got = {(x.a, x.b): x.score for x in resolve.name_pairs(spark.createDataFrame([(x,) for x in names], "name string"), threshold).collect()}
    want = {(a, b): v for a, b in itertools.combinations(sorted(names), 2) if a.strip() and b.strip() and (v := Z.plain_token_sort(a, b)) >= threshold}
    assert got == want


def test_chain_and_reasons(spark):
    rows = [("Ann Lee", "a@x.com"), ("Zoe Other", "A@X.COM"), ("Zoe Othr", None), ("Far Away", None)]
    df = people(spark, rows).withColumn("source", F.lit("csv"))
    members = df.join(resolve.resolve(df, C.Resolution()), "record_id")
    out = {r.group_id: r for r in resolve.groups(members, resolve.matches(df, C.Resolution())).collect()}
    assert out[0].size == 3 and out[0].match_reasons == ["email:exact", "name:fuzzy(0.94)"] and out[0].primary_email == "a@x.com"
    assert out[3].is_singleton and out[3].match_reasons == []


# Survivorship


def plain_priority(rows, priority):
    last = {s: v for s, v in rows}
    full = lambda v: v is not None and v.strip() != ""
    return next((last[s] for s in priority if s in last and full(last[s])), next((v for _, v in rows if full(v)), None))


def test_priority_and_most_complete(spark):
    rng = random.Random(6)
    priority = ("resume_pdf", "json", "csv")
    groups = {g: [(rng.choice(["csv", "json", "resume_pdf", "resume_txt"]), rng.choice([None, "", " ", "a", "bb", "cc", "ddd"])) for _ in range(rng.randint(1, 5))] for g in range(200)}
    rows = [(g, g * 10 + k, s, v) for g, xs in groups.items() for k, (s, v) in enumerate(xs)]
    df = spark.createDataFrame(rows, "group_id long, record_id long, source string, name string").repartition(4)
    got = {r.group_id: r for r in merge.with_last(df).groupBy("group_id").agg(merge.priority_scalar("name", priority).alias("p"), merge.most_complete_scalar("name").alias("m")).collect()}
    for g, xs in groups.items():
        assert got[g].p == plain_priority(xs, priority)
        full = [v for _, v in xs if v and v.strip()]
        assert got[g].m == (max(full, key=len) if full else None)


def test_merge(spark):
    a = {"source": "csv", "name": "Ann", "email": "a@x.c", "skills": ["SQL", "Go"], "experience": [JOB | {"description": "short"}], "extra_fields": {"k": "1", "only": "x"}, "links": [{"url": "https://a.com", "label": "Website"}]}
    b = {"source": "resume_pdf", "name": "Ann B", "email": "", "skills": ["go", "Rust"], "experience": [JOB | {"title": "Engineer II", "description": "much longer"}, JOB | {"company": "Other Company", "title": "Cook"}], "extra_fields": {"k": "2"}, "links": [{"url": "http://www.a.com/", "label": None}]}
    members = records(spark, a, b).withColumn("group_id", F.lit(0).cast("long"))
    r = merge.merge(members, C.standard().merge_rules).first()
    assert (r.name, r.email, r.n_records) == ("Ann B", "a@x.c", 2)
    assert r.skills == ["go", "Rust", "SQL"] and r.extra_fields == {"k": "1", "only": "x"}
    assert [(x.company, x.title, x.description) for x in r.experience] == [("Acme", "Engineer II", "much longer"), ("Other Company", "Cook", None)]
    assert [x.url for x in r.links] == ["http://www.a.com/"]
    plain = merge.merge(members, C.MergeRules()).first()
    assert plain.skills == ["go", "Rust"]


def same(kind, a, b):
    return bool(merge.alike(kind, {f: [a[f]] for f in merge.KINDS[kind][0]}, b)[0])


def test_entries_that_are_one():
    job = lambda company, title: JOB | {"company": company, "title": title}
    for a, b, want in [
        (job("Infosys", "AI/ML Intern"), job("Infosys", "AI/ML Intern (Virtual Internship 6.0)"), True),
        (job("Engineer", "Acme"), job("Acme", "Engineer"), True),  # the other way round
        (job("Acme", "Cook"), job("Acme", "Engineer"), False),
        (job("Acme", None), job("Acme", "Engineer"), True),
        (job(None, "Cook"), job(None, "Cook"), True), (job(None, "Cook"), job("Acme", "Cook"), True),
        (job(None, None), job("Acme", "Cook"), False), (job("Acme", None), job(None, "Cook"), False),
        (job("Company 1", "Cook"), job("Company 2", "Cook"), True), (job("Company 1", "Cook"), job("Company 2", "Driver"), False),
    ]:
        assert same("experience", a, b) == same("experience", b, a) == want, (a, b)
    school = lambda i, d: {"institution": i, "form": d}
    be = "bachelor of engineering"
    for a, b, want in [(school("MIT", be), school("MIT", be), True), (school("MIT", None), school("Yale", None), False), (school("MIT", be), school("MIT", "doctor of philosophy"), False), (school(None, be), school("MIT", be), True), (school(None, None), school("MIT", be), False)]:
        assert same("education", a, b) == same("education", b, a) == want, (a, b)


def test_fold_of_schools(spark):
    entry = lambda i, d, gpa=None: {"institution": i, "degree": d, "field_of_study": None, "duration": None, "gpa": gpa}
    xs = [entry("MIT", "B.E."), entry("MIT", "Bachelor of Engineering in CS", 0.0), entry("Yale", "B.E."), entry("MIT", "B.E.", 7.0), entry("MIT", "PhD")]
    df = records(spark, {"education": xs}, {}, {"education": []}).withColumn("education", F.when(F.col("record_id") != 1, F.col("education")))
    out = [r.x for r in df.orderBy("record_id").select(merge.fold_education(F.col("education")).alias("x")).collect()]
    assert [(x.institution, x.degree, x.gpa) for x in out[0]] == [("MIT", "Bachelor of Engineering in CS", 0.0), ("Yale", "B.E.", None), ("MIT", "PhD", None)]
    assert out[1] is None and out[2] == []


# Validation, scores, lineage, projection


def test_worked_example(spark):
    one = {"name": "Ann Lee", "email": "a@x.com", "phone": "+919876543210", "skills": ["SQL"], "experience": [JOB], "education": [{"institution": "MIT", "degree": "BE", "field_of_study": None, "duration": None, "gpa": None}]}
    result = pipeline.run_records(records(spark, one), as_of=datetime.datetime(2025, 1, 1))
    r = result.report.first()
    assert r.overall_score == pytest.approx(0.7405, abs=1e-3)
    assert (r.completeness, r.source_agreement, r.validation_penalty, r.diversity_bonus) == (0.95, 1.0, 0.01, 0.0)
    assert "Single source: csv (reliability 70%)" in r.explanations and "✖ links: absent" in r.explanations and "✔ Profile 95% complete" in r.explanations
    p = result.profiles.first()
    assert p.fields.full_name == "Ann Lee" and p.pipeline_version == "1.0.0" and p.validation.is_valid
    assert {i.field for i in p.validation.issues} == {"links", "summary", "location"}
    assert result.shape == [] and result.bounds.count() == 0


def test_scores_of_two_sources(spark):
    a = {"source": "ats", "name": "Ann Lee", "email": "a@x.com", "location": "Bengaluru", "phone": "9876543210"}
    b = {"source": "linkedin", "name": "Ann Li", "email": "A@x.com ", "location": "Pune", "phone": "+91 98765 43210"}
    r = pipeline.run_records(records(spark, a, b), as_of=datetime.datetime(2025, 1, 1)).report.first()
    by = {x.field_name: x for x in r.field_scores}
    assert by["email"].score == 1.0 and by["email"].reason == "2 source(s) contributing; sources agree"
    assert by["location"].reason.startswith("2 source(s) contributing; sources conflict (similarity=") and by["location"].score < by["email"].score
    assert by["summary"].reason == "field absent" and r.diversity_bonus == 0.05


def test_freshness(spark):
    conf, now = C.Confidence(), F.lit(datetime.datetime(2025, 1, 1))
    at = lambda f, t: spark.range(1).select(score.freshness(f, F.lit(t).cast("timestamp"), now, conf).alias("w")).first().w
    assert at("location", datetime.datetime(2000, 1, 1)) == 0.5 and at("name", datetime.datetime(2000, 1, 1)) == 1.0
    assert at("phone", datetime.datetime(2024, 1, 2)) == pytest.approx(0.5 ** (365 / 365)) and at("phone", datetime.datetime(2030, 1, 1)) == 1.0


def test_validation_extra_rule(spark):
    rule = lambda: F.array(validate.issue("name", "error", F.lit("no")))
    r = validate.validate(records(spark, {"name": "A", "email": "a@b.co"}), extra=[rule]).first()
    assert not r.is_valid and r.issues[-1].message == "no"


def test_projection(spark):
    conf = C.Projection((C.Projected("name", "n"), C.Projected("skills", "s", False), C.Projected("nope", "x", default="d")), include_validation=False, include_provenance=True)
    config = C.replace(C.standard(), projection=conf)
    result = pipeline.run_records(records(spark, {"name": "ann lee", "skills": ["x"]}), config, datetime.datetime(2025, 1, 1))
    p = result.profiles.first()
    assert p.fields.asDict() == {"n": "Ann Lee", "x": "d"} and p.validation is None
    assert [x.field_name for x in p.confidence.field_scores] == ["name"] and not any("skills" in x for x in p.confidence.explanations)
    assert [(x.field_name, x.original_value, x.normalized_value, x.notes) for x in p.provenance] == [("name", "ann lee", "Ann Lee", "normalized from 'ann lee'")]
    assert pipeline.field_map(config) == {"n": "name", "x": "nope"}
    kind = spark.createDataFrame([], "n array<string>").schema
    assert [x[:2] for x in project.shape_issues(kind, conf)] == [("n", "warning"), ("x", "error")]
    assert lineage.method("name", F.lit("csv")) is not None


# Sources


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", "﻿Full Name, Email ,Skills,Employer,Role,Start Date,College,CGPA,id\r\n Ann Lee ,a@x.com,\"SQL, go\",Acme,Cook,2020,MIT,8.5/10,7\r\n , ,,,,,,,\r\nBob,b@x.com,\"line\nbreak\",,,,,,8,surplus\r\n")
    raw = readers.read(spark, "csv", path).orderBy("record_id").collect()
    assert [r.row_ord for r in raw] == [0, 2] and raw[0].fields[0].asDict() == {"key": "Full Name", "value": "Ann Lee"}
    a, b = extract.extract(readers.read(spark, "csv", path)).orderBy("record_id").collect()
    assert (a.name, a.email, a.experience[0].company, a.experience[0].duration.is_current, a.education[0].gpa) == ("Ann Lee", "a@x.com", "Acme", True, 8.510)
    assert a.extra_fields == {"Full Name": "Ann Lee", "id": "7"} and a.skills == ["SQL", "go"] and b.skills == ["line", "break"]
    old = readers.read(spark, "csv", write(tmp_path, "b.csv", "name\nJos\xe9".encode("latin-1"))).first()
    assert old.fields[0].value == "José" and len(old.parse_errors) == 2
    assert readers.read(spark, "csv", write(tmp_path, "c.csv", "")).count() == 0
    big = readers.read_large_csv(spark, write(tmp_path, "d.csv", "name,x\nA,1\n,\nB,2\n"))
    assert [[f.value for f in r.fields] for r in big.collect()] == [["A", "1"], ["B", "2"]]


def test_json(spark, tmp_path):
    person = {"data": {"Candidate": {"Name": " Ann ", "contact": {"email": "a@x.com", "phone": 7}, "work_history": [{"employer": "Acme", "role": "Cook", "from_date": 2020, "current": True}, "odd"], "education": [{"school": "MIT", "year": 2019, "grade": "A", "score": "9/10"}], "profiles": {"github": "github.com/ann", "x": "https://x.org"}, "links": [{"href": "kaggle.com/ann", "type": "K"}, "medium.com/@ann"], "awards": [{"a": "Chess"}], "languages": "English; Hindi", "age": 30}}}
    path = write(tmp_path, "a.json", json.dumps([person, 5, {"full_name": "Bob", "skills": "sql, Python"}]))
    a, b = extract.extract(readers.read(spark, "json", path)).orderBy("record_id").collect()
    assert (a.name, a.email, a.phone) == ("Ann", "a@x.com", None)
    job, school = a.experience[0], a.education[0]
    assert (len(a.experience), job.company, job.title, job.duration.start, job.duration.is_current) == (1, "Acme", "Cook", "2020", True)
    assert (school.institution, school.duration.end, school.gpa) == ("MIT", "2019", 910.0)
    assert [(x.label, x.url) for x in a.links] == [("GitHub", "https://github.com/ann"), ("Website", "https://x.org"), ("K", "https://kaggle.com/ann"), ("Medium", "https://medium.com/@ann")]
    assert json.loads(a.extra_fields["achievements"]) == ["Chess"] and json.loads(a.extra_fields["languages"]) == ["English", "Hindi"] and a.extra_fields["age"] == "30"
    assert a.skills == ["English", "Hindi"] and b.skills == ["SQL", "Python"]
    errors = lambda c: readers.read(spark, "json", write(tmp_path, "e.json", c)).first().parse_errors[0]
    assert errors("{\n bad").startswith("JSON decode error at line 2") and errors("5") == "Unexpected JSON root type: int" and "BOM" in errors("﻿{}")
    lines = extract.extract(readers.read(spark, "json_lines", write(tmp_path, "l.jsonl", '{"name": "A"}\nbroken\n[1, 2]\n7\n{"a": \n'))).orderBy("record_id").collect()
    assert [(r.name, bool(r.parse_errors), r.source) for r in lines] == [("A", False, "json")] + [(None, True, "json")] * 4


def test_walk_never_raises():
    for text, said in [(None, None), ("", None), ("{}", None), ("{\n bad", "JSON decode error at line 2"), ("[1, 2]", "Unexpected JSON root type: list"), ("7", "Unexpected JSON root type: int"), ("null", "Unexpected JSON root type: NoneType"), ("[" * 100_000, "JSON decode error")]:
        got = extract.walk(text)
        assert got["name"] is None and (got["parse_errors"][0].startswith(said) if said else got["parse_errors"] == [])


def test_numbers_keep_the_order_of_inputs(spark):
    rows = readers._error_rows(spark, "f", "e")
    many = rows.crossJoin(spark.range(2000).toDF("n")).drop("n").repartition(300)
    ids = [[r.record_id for r in readers._raw(many, "csv", k).select("record_id").collect()] for k in (0, 1, 2)]
    assert len({i for x in ids for i in x}) == 6000 and max(ids[0]) < min(ids[1]) and max(ids[1]) < min(ids[2])


def test_empty_text_files_have_numbers_of_their_own(spark, tmp_path):
    for name, content in (("a.txt", ""), ("b.txt", ""), ("c.txt", "Bob")):
        write(tmp_path, name, content)
    got = readers.read(spark, "resume_txt", str(tmp_path / "*.txt")).collect()
    assert len(got) == 3 == len({r.record_id for r in got}) and sum(bool(r.parse_errors) for r in got) == 2


def test_other_sources(spark, tmp_path):
    errors = lambda source, path: readers.read(spark, source, path).first().parse_errors[0]
    assert errors("csv", str(tmp_path / "no.csv")).startswith("File not found")
    assert errors("fax", "x").startswith("No parser registered for source 'fax'")
    assert errors("resume_txt", write(tmp_path, "e.txt", "")) == "TXT file is empty"
    assert errors("resume_pdf", write(tmp_path, "e.pdf", "x")).startswith("PDF extraction failed")
    assert readers.read(spark, "resume_txt", write(tmp_path, "a.txt", "caf\xe9\r\nx ".encode("latin-1"))).first().raw_text == "café\nx"
    assert readers.route(["a.CSV", "b.docx", "c.exe", "d"]) == ([("csv", "a.CSV"), ("resume_pdf", "b.docx")], ["c.exe", "d"])
    assert readers.read_all(spark, []).count() == 0 and "csv" in readers.registered() and "json" in extract.registered()


# Whole runs


def test_run_and_cli(spark, tmp_path, capsys):
    a = write(tmp_path, "a.csv", "name,email,phone\nAnn Lee,a@x.com,9876543210\nBob Ray,b@x.com,\n")
    b = write(tmp_path, "b.json", json.dumps({"name": "Lee Ann", "summary": "hi", "skills": ["SQL"]}))
    c = write(tmp_path, "c.txt", "Bob Ray\nb@x.com\n\nSkills\nGo, Rust\n")
    out = str(tmp_path / "o" / "p.json")
    assert cli.main(["--txt", c, "--csv", a, "--json", b, "--json", str(tmp_path / "none.json"), "-o", out], spark) == 0
    said = capsys.readouterr().out
    assert "Inputs parsed:     5" in said and "Candidate groups:  3" in said and "Rejected inputs:   1" in said
    profiles = json.load(open(out, encoding="utf-8"))
    assert [p["fields"]["full_name"] for p in profiles] == ["Lee Ann", "Bob Ray", None]
    assert profiles[0]["fields"]["professional_summary"] == "hi" and profiles[1]["fields"]["skills"] == ["Go", "Rust"]
    assert cli.main([], spark) == 1
    args = cli.parser().parse_args(["--txt", "t", "--csv", "a", "--pdf", "p", "--json", "j", "--csv", "b"])
    assert cli.inputs_of(args) == [("csv", "a"), ("csv", "b"), ("json", "j"), ("resume_pdf", "p"), ("resume_txt", "t")]


def test_empty_run(spark, tmp_path):
    result = pipeline.run(spark, [], output=str(tmp_path / "e.json"))
    assert json.load(open(tmp_path / "e.json")) == [] and result.metrics() == {"total_inputs": 0, "total_groups": 0, "rejected": 0}
    sinks.write_json_lines(result.profiles, str(tmp_path / "lines"))


def test_result_does_not_depend_on_partitions(spark):
    rows = [{"name": f"Person Number{i % 7}x{'abcdefg'[i % 7] * 6}", "email": f"p{i % 5}@x.com" if i % 2 else None, "skills": [f"S{i % 3}", "sql"], "source": ["csv", "json", "ats"][i % 3]} for i in range(30)]
    out = []
    for n in (1, 5):
        r = pipeline.run_records(records(spark, *rows).repartition(n), as_of=datetime.datetime(2025, 1, 1))
        out.append(sorted(x[0] for x in r.profiles.select(F.to_json(F.struct("group_id", "fields", "confidence", "validation"))).collect()))
    assert out[0] == out[1]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    raw = readers.read(spark, "csv", write(tmp_path, "a.csv", "name,email\nAnn Lee,a@x.com\nAnn Lee,\nBob Ray,b@x.com\n"))
    raw.coalesce(1).write.json(str(folder))
    seen = []
    query = stream.start(stream.raw_stream(spark, str(folder)), str(tmp_path / "table"), str(tmp_path / "check"), lambda r, n: seen.append(r.metrics()))
    query.awaitTermination(120)
    assert seen == [{"total_inputs": 3, "total_groups": 2, "rejected": 0}]
    assert stream.validated_stream(stream.raw_stream(spark, str(folder))).isStreaming


# Configuration


def test_config(tmp_path):
    (tmp_path / "pipeline.yaml").write_text("version: 2.0.0\nlog_level: debug\nconfidence:\n  diversity:\n    max_bonus: 0.1\n")
    (tmp_path / "merge_rules.yaml").write_text("field_rules:\n  name:\n    priority: [csv]\n    strategy: most_complete\n")
    C.load.cache_clear()
    c = C.load(str(tmp_path / "pipeline.yaml"))
    assert (c.version, c.log_level, c.confidence.diversity.max_bonus) == ("2.0.0", "DEBUG", 0.1)
    assert c.merge_rules.rule("name") == C.Rule(("csv",), "most_complete") and c.merge_rules.rule("skills").strategy == "priority"
    assert c.projection.fields == () and c.normalization.skills.synonyms == {}
    alone = tmp_path / "p.yaml"
    alone.write_text("fields:\n  - source: name\n    output_name: n\ninclude_provenance: true\n")
    p = C.load(str(alone)).projection
    assert p.output_map() == {"name": "n"} and p.include_provenance
    for bad in (lambda: C.Rule(strategy="x"), lambda: C.Reliability({"csv": 2.0}), lambda: C.Confidence(field_weights={"name": 0.5}), lambda: C.Config(log_level="LOUD"), lambda: C.AdaptiveWeights(one_source_field=1.0)):
        with pytest.raises(C.ConfigError):
            bad()


def test_match_reasons_use_every_part(spark, tmp_path):
    from weftwork.plans import queries

    spark.range(1001).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r.i, r.j) for r in queries.QUERIES["match_reasons_email"](spark, str(tmp_path)).collect())
    assert got == [(i, j) for i in range(1001) for j in range(i + 1, 1001) if i // 4 == j // 4]


def test_noisy_or_uses_every_event(spark, tmp_path):
    from weftwork.plans import queries

    spark.range(1001).select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    left = [0.05, 0.30, 0.5, 0.25, 0.15]
    got = sorted(tuple(r) for r in queries.QUERIES["noisy_or_reliability"](spark, str(tmp_path)).collect())
    want = []
    for block in range(251):
        rest, ids = 1.0, range(4 * block, min(4 * block + 4, 1001))
        for i in ids:
            rest *= left[i % 5]
        want.append((block, len(ids), pytest.approx(1 - rest, abs=1e-8)))
    assert got == want


def test_profiles_link_misspelled_names(spark):
    from weftwork.plans import queries

    d = "/root/testdata/sf0.001"
    rows = queries.people(spark, d).select("record_id", "email", "name").collect()
    want, linked = set(), 0
    for person in range(500):
        own = [r for r in rows if r.email.lower() == f"user{person}@example.com"]
        typo = [r.record_id for r in rows if r.email.startswith("typo") and r.record_id // 4 % 500 == person]
        if any(r.name for r in own) and typo:
            linked += 1
            want.add(min([r.record_id for r in own] + typo))
        else:
            want |= {min(g) for g in ([r.record_id for r in own], typo) if g}
    assert linked
    assert {r.group_id for r in queries.entity_profiles(spark, d).select("group_id").collect()} == want
    assert {r.group_id for r in queries.field_scores(spark, d).select("group_id").distinct().collect()} == want
