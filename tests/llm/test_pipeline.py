"""The corpus pipeline stage by stage, each against what it was given."""

import os
import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from weftwork.llm import decontaminate, jaccard, secrets  # noqa: E402
from weftwork.llm.common import write_shared  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols, given, labels = docs.columns, {}, spark.read.parquet(f"{DATA}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = write_shared(stage(spark, docs, DATA), "test")
        given[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == cols
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
            docs = out
    before, after = given["quality_classifier"]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    known = labels.join(before, "doc_id", "left_semi").collect()
    assert sum((r.doc_id in kept) == bool(r.quality) for r in known) >= 0.95 * len(known)
    before, after = given["near_duplicates"]
    groups = {r.component_id for r in jaccard.join_groups(before).collect()}
    assert {r.doc_id for r in after.collect()} == groups
    before, after = given["decontamination"]
    report = decontaminate.report(after, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert report.where("contaminated").count() == 0
    before, after = given["secret_scans"]
    assert after.count() == before.count()
    assert secrets.scan(after).where("n_assign + n_access + n_hex > 0").count() == 0
    before, after = given["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` != `max(doc_tokens)`").count() == 0


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    rng, d = random.Random(3), str(tmp_path_factory.mktemp("odd"))
    good = [". ".join(words(rng, 12).capitalize() for _ in range(4)) + ".\n" + words(rng, 30) for _ in range(60)]
    bad = ["\n".join("### $$$ | " * 5 + words(rng, 2) for _ in range(4)) for _ in range(20)]
    item = words(rng, 14)
    texts = good + bad + [good[0], good[1] + " one more", f"{good[2]}\n{item} {words(rng, 9)}", f"{good[3]}\n{item}\n{words(rng, 9)}\n{' '.join(item.split(' ')[::-1])}"]
    texts += ["password = hunter2hunter2 " + words(rng, 40), "\n".join(words(rng, 15) for _ in range(20_000)), "", " \n\t", None]
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t), "mine", 7.0, "p", "h", "t", 5) for i, t in enumerate(texts)]
    rows += [rows[5], (None, good[6], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, items string, score double, predicted string, hits string, token string, `a.b` long"
    docs = spark.createDataFrame(rows, names)
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)] + [(0, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, " ".join(item.split(" ")[::-1])), (3, None), (4, ""), (1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{d}/empty/{t}.parquet")
    return d, rows, len(good), len(bad)


def test_stages_take_any_rows(spark, odd):
    d, rows, n_good, n_bad = odd
    docs = spark.read.parquet(f"{d}/documents.parquet")
    given, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = write_shared(stage(spark, docs, d), "odd")
        given[name] = docs, out
        docs = out
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    for name in [n for n, _ in corpus_pipeline.STAGES[:-1]]:
        before, after = given[name]
        assert after.columns == columns
        others = [c for c in columns if c not in ("text", "n_chars")]
        assert after.select(*[f"`{c}`" for c in others]).exceptAll(before.select(*[f"`{c}`" for c in others])).count() == 0  # nothing else changes
    bad = range(n_good, n_good + n_bad)
    kept = ids(given["quality_classifier"][1])
    assert not set(kept) & set(bad) and set(kept) >= set(range(n_good)) and kept.count(None) == 2
    near = ids(given["near_duplicates"][1])
    n = n_good + n_bad
    assert near.count(5) == 1 and 0 in near and n not in near and n + 1 not in near  # the repeat, the copy and the near copy
    assert near.count(None) == 1  # good[6] has a doc_id elsewhere; the row of nulls is alone
    clean = {r.doc_id: r for r in given["decontamination"][1].collect()}
    assert n + 3 not in clean and n + 2 in clean
    item = spark.read.parquet(f"{d}/benchmark.parquet").where("item_id = 1").first().text
    assert item not in clean[n + 2].text and clean[n + 2].n_chars == len(clean[n + 2].text)
    safe = {r.doc_id: r.text for r in given["secret_scans"][1].collect()}
    assert safe[n + 4].startswith("[removed] ") and safe[n + 6] == "" and safe[None] is None
    pieces = given["packing"][1]
    assert pieces.where("doc_id is null").select("length", "doc_tokens").collect() == [(1, 1)]
    total = {r.doc_id: (r.s, r.t) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("s"), F.max("doc_tokens").alias("t")).collect()}
    assert set(total) == set(safe) and all(s == t for s, t in total.values())


def test_stages_take_empty_tables(spark, odd):
    d = f"{odd[0]}/empty"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0


def test_run_is_the_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "secret_scans", "packing"]
