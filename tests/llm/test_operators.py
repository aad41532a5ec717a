"""Operators against plain brute-force versions, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftwork.llm import common, decontaminate, jaccard, language, packing, quality_crf, quality_rules, secrets, sharding, token_counts, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = ["the", "an", "ti", "er", "ou", "re", "st", "é", "wh", "sh", "in", "Ü", "on"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def sentence(rng, n):
    return " ".join(words(rng, n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [sentence(rng, 60) for _ in range(6)]
    out = [None, "", " \n\t ", "one", "Two words", "a b c d", "a b c d e", "ha ha ha ha ha ha ha ha ha ha ha ha"]
    for b in base:
        w = b.split(" ")
        out += [b, b, b.upper(), " ".join(w[:30] + ["changed"] + w[31:]), " ".join(w[3:] + words(rng, 3)), " ".join(w[:40]), "\n".join([b, sentence(rng, 9), b])]
    out += ["x" * 200_000, "\n".join(sentence(rng, 12) for _ in range(3000)), "日本語 のテキスト", "!!! ### $$$"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", i, i, "w") for i, t in enumerate(texts)]
    rows += [(2, None, None, None, None, None, None), (9, texts[9], "en", "src0", 1, 1, "w")]  # repeated rows
    # extra columns whose names clash with the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, bucket long, token string").repartition(3)


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 1


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(8, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2


@pytest.mark.parametrize("block_bytes", [16 << 20, 400])
def test_decontaminate(spark, docs, texts, block_bytes):
    rng = random.Random(3)
    items = [(1, " ".join(texts[8].split(" ")[10:30])), (2, "An other, item: " + " ".join(texts[8].split(" ")[12:24])), (10, "one"), (3, "two, WORDS"), (4, None), (5, ""), (6, sentence(rng, 20)), (7, "ha ha ha ha ha ha ha ha ha"), (7, "changed")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = collected(decontaminate.report(docs, benchmark, block_bytes=block_bytes), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(((r.doc_id, *brute_hits(r.text, items)) for r in docs.collect()), key=repr)
    assert got == want
    assert any(x[5] for x in want) and any(x[2] and not x[5] for x in want)


def test_decontaminate_cleans(spark):
    docs = spark.createDataFrame([(1, "Start A-b c d e f g h! end", 26), (2, "nothing", 7), (3, None, None)], "doc_id long, text string, n_chars long")
    benchmark = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    got = collected(decontaminate.clean(docs, benchmark), "doc_id", "text", "n_chars")
    assert got == [(1, "Start ! end", 11), (2, "nothing", 7), (3, None, None)]


def test_decontaminate_keeps_other_columns(spark):
    rows = [(1, "Start a b c d e f g h end", "own", 7, "x", "12", 5), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_words int, hits string, n_chars string, `a.b` int")
    benchmark = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    got = decontaminate.clean(docs, benchmark)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "Start  end", "own", 7, "x", "12", 5), rows[1]]
    assert decontaminate.decontaminate(docs, benchmark).where("doc_id = 1").select("n_words", "items").first() == (10, ["1"])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(none, benchmark).count() == 0
    assert decontaminate.report(docs, benchmark).where("n_hit > 0").count() == 0
    assert jaccard.join_groups(none).count() == 0
    assert secrets.scan(none).count() == 0
    assert packing.digest(packing.pack(packing.tokenise(none, packing.tokenizer_path()))).count() == 0
    assert token_counts.token_counts(none, token_counts.tokenizer_path()).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_crf.score(none, quality_crf.fit(none, labels)).count() == 0
    assert quality_rules.apply(none, quality_rules.fit(none, labels)).count() == 0
    assert language.predict(none, language.fit(none)).count() == 0
    assert jaccard.one_of_each(none).count() == 0 and secrets.redact(none).count() == 0 and decontaminate.clean(none, benchmark).count() == 0
    assert quality_crf.good_ones(none, quality_crf.fit(none, labels)).count() == 0
    assert warc.archived(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    key = dict(size=F.lit(1), group=F.col("text"), row=F.col("doc_id"))
    assert sharding.shard(none, **key).count() == 0


# 2


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    u, a = rng.normal(0, 2, 9), rng.normal(0, 1, (2, 2))
    doc = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    good, pair = quality_crf.forward_backward(u, a, doc)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, one, two = 0.0, np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for bits in range(1 << len(at)):
            y = [bits >> i & 1 for i in range(len(at))]
            w = np.exp(sum(u[at[i]] * y[i] for i in range(len(at))) + sum(a[y[i - 1], y[i]] for i in range(1, len(at))))
            total += w
            one += w * np.array(y)
            for i in range(1, len(at)):
                two[i, y[i - 1], y[i]] += w
        assert np.allclose(good[at], one / total)
        assert np.allclose(pair[at], two / total)


def test_likelihood_of_labels_is_exact():
    rng = np.random.default_rng(2)
    u, a, doc = rng.normal(0, 2, 8), rng.normal(0, 1, (2, 2)), np.array([0, 0, 0, 1, 1, 1, 1, 2])
    y = np.array([1, 0, 1, 1, 1, 0, 0, 1])
    want = 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weight = lambda z: np.exp(sum(u[at[i]] * z[i] for i in range(len(at))) + sum(a[z[i - 1], z[i]] for i in range(1, len(at))))
        want += np.log(weight(y[at])) - np.log(sum(weight([bits >> i & 1 for i in range(len(at))]) for bits in range(1 << len(at))))
    inside = np.append(False, doc[1:] == doc[:-1])
    assert np.isclose(quality_crf.log_likelihood(*quality_crf.forward_backward(u, a, doc), y, inside), want)


def test_fit_reaches_the_maximum():
    """No weight has a slope left, and neighbouring labels that repeat give a transition that favours it."""
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(60), 12)
    y = (np.repeat(rng.integers(0, 2, 180), 4)).astype(int)
    x = (y[:, None] + rng.normal(0, 1.5, (len(y), 3))).astype(np.float32)
    w, a = quality_crf._fit_lines(x, y, doc, enough=1e-9)
    good, pair = quality_crf.forward_backward(x @ w[1:] + w[0], a, doc)
    slope = np.append(good.sum() - y.sum(), x.T @ (good - y)) / len(y) + 1e-3 * w
    assert np.abs(slope).max() < 2e-3 and a[0, 0] + a[1, 1] > a[0, 1] + a[1, 0] + 1


def test_document_score_is_the_mean_over_lines(texts):
    """Against a walk over each text's lines, one by one."""
    rng = np.random.default_rng(6)
    model = quality_crf.Model(rng.normal(0, 0.4, 3 * quality_crf.N_OWN + 3), rng.normal(0, 1, (2, 2)), (0.3, 1.2), 0.7)
    rows = [t for t in texts if t is None or len(t) < 5000] + ["a\n\n \nb b b"]
    x, doc, size = quality_crf.line_features(pa.array(rows, pa.string()))
    got = model.documents(x, doc, size, len(rows))
    for i, t in enumerate(rows):
        lines = [s for s in (t or "").split("\n") if s]
        own = np.flatnonzero(doc == i)
        assert [len(s.encode()) for s in lines] == size[own].tolist()
        if not lines:
            assert got[i] == 0.7
            continue
        u = x[own] @ model.w[1:] + model.w[0]
        alpha, beta = np.zeros((len(u), 2)), np.ones((len(u), 2))
        psi = np.exp(np.column_stack([np.zeros(len(u)), u]))
        alpha[0] = psi[0]
        for k in range(1, len(u)):
            alpha[k] = (alpha[k - 1] @ np.exp(model.a)) * psi[k]
        for k in range(len(u) - 2, -1, -1):
            beta[k] = np.exp(model.a) @ (psi[k + 1] * beta[k + 1])
        good = (alpha * beta)[:, 1] / (alpha * beta).sum(1)
        mean = (good * size[own]).sum() / size[own].sum()
        z = 0.3 + 1.2 * np.log((mean + 0.01) / (1.01 - mean))
        assert np.isclose(got[i], 1 / (1 + np.exp(-z))), t[:40]


def test_samples_are_bounded_and_repeatable(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:200]
    rows = [(i, f"text {i} {k}") for i in ids for k in range(3)]  # three texts for each doc_id
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], ids[0] % 2), (None, 1)], "doc_id long, quality int")
    seen = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows[::-1] if n > 1 else rows, "doc_id long, text string").repartition(n)
        some = common.labelled(labels, 50)
        seen.append([tuple(r) for r in common.sample(docs, some, lambda t: (t,), "t string").collect()])
    assert seen[0] == seen[1] and len(seen[0]) == 50 == len({r[0] for r in seen[0]})


def test_quality_keeps_other_columns(spark):
    docs, labels = labelled(spark, 60)
    docs = docs.withColumns({"score": F.lit(7.0), "predicted": F.lit("mine"), "x.y": F.lit(1)})
    kept = quality_crf.good_ones(docs, quality_crf.fit(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < 60
    assert kept.select("score", "predicted").distinct().collect() == [(7.0, "mine")]


def labelled(spark, n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = [" ".join(w + "###" for w in words(rng, 10)) if bad else sentence(rng, 12).capitalize() + "." for _ in range(5)]
        rows.append((i, "\n".join([sentence(rng, 6), *lines]), "de" if i % 3 else "en"))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = quality_crf.score(docs, quality_crf.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    rules = quality_rules.apply(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert (rules["kept"].astype(int) == rules["quality"]).mean() > 0.9


def test_classifiers_take_any_rows(spark, docs):
    _, labels = labelled(spark)
    train, _ = labelled(spark)
    got = quality_crf.score(docs, quality_crf.fit(train, labels)).select("doc_id", "score", "predicted").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    alone = quality_crf.score(docs, quality_crf.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in alone] == [1.0]


def test_fit_takes_all_lines_of_long_texts(spark, monkeypatch):
    lengths = [3, 1000, 401, 7, 2500, 12]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][: len(lengths)]
    text = lambda n: "\n".join("good words here." if k % 2 else "### @@@ ###" for k in range(n))
    docs = spark.createDataFrame([(i, text(n)) for i, n in zip(ids, lengths)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_crf, "train", lambda *a: seen.append(a))
    quality_crf.fit(docs, labels)
    x, label, doc, size, doc_label = seen[0]
    assert sorted(np.bincount(doc)) == sorted(lengths) and len(x) == len(size) == sum(lengths)
    kind = x[:, 0]  # lines of the two kinds take turns, as in the texts
    assert all((kind[1:] != kind[:-1])[doc[1:] == doc[:-1]])


def test_messages_in_blocks_are_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    doc = np.repeat(np.arange(40), rng.integers(1, 60, 40))
    u, a = rng.normal(0, 1, len(doc)), rng.normal(0, 1, (2, 2))
    want = quality_crf.forward_backward(u, a, doc)
    monkeypatch.setattr(quality_crf, "BLOCK_LINES", 50)
    assert all(np.allclose(x, y) for x, y in zip(quality_crf.forward_backward(u, a, doc), want))


# 3


def test_sharding(spark):
    rng = random.Random(2)
    rows = [(i, 8 + rng.randint(0, 400), "same" if i % 3 == 0 else f"t{i // 2}") for i in range(20_000)] + [(1, 50, "same")] * 4000 + [(None, 8, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, size long, slot string")
    got = sharding.shard(df, size=F.col("size"), group=F.col("slot"), row=F.col("doc_id"), shards=12, bucket_rows=300).toDF("doc_id", "size", "text", "shard", "place").toPandas()
    assert Counter((None if x != x else x, y, z) for x, y, z in zip(got["doc_id"], got["size"], got["text"])) == Counter(rows)
    by = got.groupby("shard")
    sizes = by["size"].sum()
    assert len(sizes) == 12 and sizes.max() - sizes.min() < 0.02 * sizes.mean() + 1000
    assert all(sorted(g) == list(range(len(g))) for _, g in by["place"])
    where = got.groupby("text")["shard"].agg(lambda s: s.max() - s.min() + 1 - s.nunique())
    assert (where == 0).all()  # equal texts lie in neighbouring shards
    assert (got[got["text"] != "same"].groupby("text")["shard"].nunique() > 1).sum() <= 11


def test_whole_documents_cross_the_exchange(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = sharding.query(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "crc32(" in plan and plan.index("crc32(") < plan.index("Window [row_number")  # of what arrived in the shards
    laid = sharding.lay_out(docs)
    assert collected(laid, "doc_id", "text") == collected(docs, "doc_id", "text")
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in collected(docs, "doc_id", "text")), key=repr)
    assert collected(df, "doc_id", "size", "text_crc32") == want


# 4


def test_encoder_equals_the_tokenizer(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    for width in (2, 4):
        encode = packing.Encoder(packing.tokenizer_path(), width)
        odd = ["it's 'tis we're 12½ x²", "a <|endoftext|> b", "İstanbul ΑΣ ÀÉ", "tab\tnew\nline  $'s '' 'd'", "é", "\x1c\x85\xa0x", "don''t"]
        for t in [*texts, *odd]:
            if t is not None:
                assert np.frombuffer(encode(t), f"<u{width}").tolist() == model.encode(t, add_special_tokens=False).ids, t[:50]
        assert encode(None) == b""


def test_packing(spark, docs, texts):
    rng = random.Random(4)
    ids = {i: [rng.randint(2, 60_000) for _ in range(rng.choice([0, 1, 7, 100, 500, 1023, 1024, 1500, 1500, 1500, 2047, 2048, 5000]))] + [1] for i in range(400)}
    tokens = spark.createDataFrame([(i, bytearray(np.array(x, "<u2").tobytes())) for i, x in ids.items()], "doc_id long, ids binary")
    got = packing.pack(tokens, width=2, bucket_rows=20).collect()
    parts, sequences = defaultdict(dict), defaultdict(dict)
    for r in got:
        x = np.frombuffer(r.ids, "<u4").tolist()
        assert x == ids[r.doc_id][r.start : r.start + len(x)] and x and r.doc_tokens == len(ids[r.doc_id])
        assert r.start not in parts[r.doc_id] and r.offset not in sequences[r.sequence_id]
        parts[r.doc_id][r.start] = sequences[r.sequence_id][r.offset] = len(x)
    for i, x in ids.items():
        assert sum(parts[i].values()) == len(x)
    for x in sequences.values():
        at = 0
        for start in sorted(x):
            assert start == at
            at += x[start]
        assert at <= 2048
    used = [sum(x.values()) for x in sequences.values()]
    assert sum(2048 - n for n in used if n & (n - 1)) < 2048


def test_nnls_finds_the_exact_mix():
    counts = np.zeros(64, np.int64)
    counts[[40, 24]] = 100
    counts[[32]] = 50
    combos = packing.patterns(counts, 64)
    x = dict(zip(combos, packing.nnls(combos, counts)))
    fit = Counter()
    for c, n in x.items():
        for length in c:
            fit[length] += n
    assert all(abs(fit[k] - counts[k]) < 0.5 for k in (24, 32, 40))


# 5


def test_language(spark):
    rng = random.Random(9)
    parts = {"de": ["ung", "heit", "sch", "ein"], "fr": ["eau", "tion", "é", "ou"], "es": ["ción", "os", "la", "ñ"]}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    rows += [(300, None, "de"), (301, "", None), (302, "123 !!", "fr"), (303, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs, per_lang=60, landmarks=30)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.98
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[303].lang_pred in parts
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(docs, None).where("lang_pred != 'und'").count() == 0


def test_language_by_hand():
    """Gram sets, kernel and ridge solution against plain sets and normal equations."""
    texts = ["The house", "the  HOUSE!", "das Haus", "ein Haus 77", "la casa", "É à"]
    data, off = common.flat(pa.array(texts))
    low = language.folded(data)
    sets = [language.grams(low[off[i] : off[i + 1]]) for i in range(len(texts))]
    code = lambda g: (int.from_bytes(g, "big") | (len(g) - 1) << 24) * 2654435761 % (1 << 32) >> 16
    plain = []
    for t in texts:
        b = re.sub(rb" +", b" ", b" " + re.sub(rb"[^a-z\x80-\xff]", b" ", t.replace("É", "é").lower().encode()) + b" ")
        plain.append({code(b[i : i + k]) for k in (1, 2, 3) for i in range(len(b) - k + 1)})
    assert [set(s.tolist()) for s in sets] == plain
    labels = [0, 0, 1, 1, 2]
    m = language.Model(["en", "de", "es"], sets[:5], labels, 4, 1e-2)
    chosen = [0, 2, 4, 1]  # taken in turns from the languages
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k = np.array([[kernel(plain[i], plain[j]) for j in chosen] for i in range(6)])
    assert np.allclose(m.kernel(m.presence(sets)), k, atol=1e-6)
    w, v = np.linalg.eigh(k[chosen])
    phi = np.column_stack([k @ (v / np.sqrt(w)), np.ones(6)])
    weight = np.array([1 / 2, 1 / 2, 1 / 2, 1 / 2, 1]) * 5 / 3
    target = np.where(np.array(labels)[:, None] == np.arange(3), 1.0, -1.0)
    root = np.sqrt(weight)[:, None]
    beta = np.linalg.lstsq(np.vstack([phi[:5] * root, 0.1 * np.eye(5)]), np.vstack([target * root, np.zeros((5, 3))]), rcond=None)[0]
    assert np.allclose(m.margins(sets), phi @ beta, atol=1e-3)


def test_language_sample_is_bounded(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.least(F.col("id") % 40, F.lit(20)).cast("string")).alias("lang"))
    model = language.fit(docs, max_langs=5, max_train=50)
    assert len(model.langs) <= 5 and "l20" in model.langs


# 6


def test_long_words_stay_in_bounds():
    t = token_counts.Trie(token_counts.pieces(token_counts.tokenizer_path()), max_nodes=500, max_words=100)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    whole = t.text(long)[1]
    assert len(t.best) <= 500 + token_counts.DEPTH + 1 and not t.words
    best = [(0.0, 0)]
    s = "▁" + long
    for j in range(1, len(s) + 1):
        top = (float("-inf"), 0)
        for i in range(max(0, j - t.longest), j):
            if (v := t.score.get(s[i:j])) is not None and best[i][0] + v > top[0]:
                top = (best[i][0] + v, best[i][1] + 1)
        best.append(top)
    assert whole == best[-1][1]
    many = " ".join(f"w{i}x" for i in range(3000))
    assert t.text(many) == token_counts.Trie(t.score).text(many)
    assert len(t.words) <= 100 and len(t.best) <= 500 + token_counts.DEPTH + 1
    big = (many + " ") * 60  # longer than LONG_TEXT: one word at a time
    assert len(big) > token_counts.LONG_TEXT and t.text(big)[1] == token_counts.Trie(t.score).text(big)[1] and t.text(big)[0] == len(t.word.findall(" " + big))


def test_scores_of_ranks_are_log_probabilities():
    score = token_counts.zipf({"a": -1.0, "b": 0.0, "c": -7.0, "d": -7.0})
    h = 1 + 1 / 2 + 1 / 3 + 1 / 4
    assert {w: round(math.exp(s) * h, 9) for w, s in score.items()} == {"b": 1.0, "a": 0.5, "c": 0.25, "d": 0.25}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_token_counts_are_near_those_of_the_files_merges(spark):
    """Within 3 % over all documents; the segmentations are not the same, and one letter repeated 200,000 times is a third off."""
    import sentencepiece

    merges = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = sum(len(merges.encode(r.text or "")) for r in docs.collect())
    assert abs(token_counts.token_counts(docs, token_counts.tokenizer_path()).groupBy().sum("n_tokens").first()[0] - total) <= 0.03 * total


def test_token_counts_equal_plain_viterbi(spark, docs, texts):
    score = token_counts.pieces(token_counts.tokenizer_path())
    small = token_counts.Trie(score, max_nodes=50, max_words=20)  # starts anew all the time
    big = token_counts.Trie(score)
    longest = max(map(len, score))

    def plain(text):
        s = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(s)
        low = 10 * min(score.values())
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - longest), j):
                piece = s[i:j]
                v, n = (score[piece], 1) if piece in score else (low, len(piece.encode())) if j == i + 1 else (None, 0)
                if v is not None and best[i][0] + v > best[j][0]:
                    best[j] = (best[i][0] + v, best[i][1] + n)
        return best[-1][1]

    for t in [*texts[3:20], texts[-2], "two  blanks ", "line\nbreak", "😀 smile"]:
        assert big.text(t)[1] == small.text(t)[1] == plain(t), t[:60]
    assert big.text(None) == big.text("") == (0, 0)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, token_counts.tokenizer_path()).collect()}
    assert got[9] == big.text(texts[9])[1]


# 7


def brute_groups(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def test_jaccard(spark, docs):
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert collected(jaccard.join_groups(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_jaccard_loose_groups(spark):
    """Chains and near misses, with shingles cut in small tiles and blocks and many sets with the same short key."""
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(12):
        w = words(rng, 80)
        for _ in range(14):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(["x1", "x2", "x3"])
            if rng.random() < 0.3:
                w = v  # drift
            rows.append((i, " ".join(v[: rng.randint(66, 80)])))
            i += 1
    want = brute_groups(rows)
    got = jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), key_bits=5, block=3, often=2, tile=4)
    assert collected(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_jaccard_on_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert collected(jaccard.join_groups(docs, block=8, often=3, tile=5), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert len({c for _, _, c in want}) < len(want)


def test_rows_of_one_doc_id(spark):
    """Of a doc_id that stands on several texts, each goes with its own group."""
    rng = random.Random(17)
    w = [words(rng, 60) for _ in range(2)]
    near = " ".join([*w[0][:20], "changed", *w[0][21:]])
    rows = [(1, " ".join(w[0]), "a"), (5, near, "b"), (5, " ".join(w[1]), "c"), (5, "  ".join(w[1]), "d"), (5, "", "e"), (5, None, "f"), (None, "", "g"), (None, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `mark.x` string").withColumnsRenamed({"mark.x": "fp.x"}).repartition(3)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    marks = sorted(r["fp.x"] for r in kept.collect())
    assert marks in (["a", "c", "e", "g", "h"], ["a", "d", "e", "g", "h"], ["a", "c", "f", "g", "h"], ["a", "d", "f", "g", "h"])
    n = len({tuple(w[0][k : k + 5]) for k in range(56)})
    assert (1, n, 1) in collected(jaccard.join_groups(docs), "doc_id", "n_shingles", "component_id") and (5, n, 1) in collected(jaccard.join_groups(docs), "doc_id", "n_shingles", "component_id")


def test_a_large_group_never_meets_itself(spark):
    """A token of 400 rows, all but three in one group: its blocks meet only the others' block."""
    rows = [(7, i, 50, 0) for i in range(397)] + [(7, 1000 + i, 50, i + 1) for i in range(3)]
    df = spark.createDataFrame(rows, "token long, fp long, n long, label long")
    classes = spark.createDataFrame([(r[1], bytearray(b"\x01" * 16)) for r in rows], "fp long, bits binary")
    pairs = jaccard._cross_pairs(df, classes, 50)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {(i, 1000 + k) for i in range(397) for k in range(3)} | {(1000, 1001), (1000, 1002), (1001, 1002)}


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for _ in range(200):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        u, v = (np.frombuffer(jaccard.bitmap(x), np.uint64) for x in (a, b))
        w = min(len(u), len(v))
        hamming = int(np.bitwise_count(jaccard.folded(u, w) ^ jaccard.folded(v, w)).sum())
        assert hamming <= len(np.setxor1d(a, b))


def test_one_of_each(spark, docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    want = {c for _, _, c in brute_groups([(r.doc_id, r.text) for r in docs.collect()])}
    assert set(ids) == want


def test_jaccard_without_doc_ids(spark):
    rng = random.Random(13)
    w = [words(rng, 80) for _ in range(4)]
    near = lambda k, n: " ".join([*w[k][:n], "changed", *w[k][n + 1 :]])
    full = [" ".join(x) for x in w]
    rows = [(None, full[0], "a"), (None, full[0], "b"), (None, near(0, 0), "c")]  # no doc_id in the group
    # two named texts, too far from each other, linked through one without doc_id
    rows += [(5, " ".join(["x1", "x2", "x3", "x4", "x5", *w[1][5:]]), "d"), (None, full[1], "e"), (9, " ".join([*w[1][:75], "y1", "y2", "y3", "y4", "y5"]), "f")]
    rows += [(None, full[2], "g"), (7, full[2], "h"), (3, full[3], "i"), (None, "", "j"), (None, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    got = collected(jaccard.join_groups(docs), "doc_id", "n_shingles", "component_id")
    n = [len({tuple(x[k : k + 5]) for k in range(len(x) - 4)}) for x in w]
    want = [(None, n[0], None)] * 3 + [(5, n[1], 5), (None, n[1], 5), (9, n[1], 5), (None, n[2], 7), (7, n[2], 7), (3, n[3], 3), (None, 0, None), (None, 0, None)]
    assert got == sorted(want, key=repr)
    marks = sorted(r.mark for r in jaccard.one_of_each(docs).collect())
    assert [m for m in marks if m not in "abc"] == ["d", "h", "i", "j", "k"] and sum(m in "abc" for m in marks) == 1


# 8


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?a)([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", *m.span())] * (len(m[2]) >= 6)
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def brute_links(text, base, reach):
    """All pairs of parts: which weak ones have a whole set of complements beside them."""
    weak = [("account", *m.span()) for m in secrets.ACCOUNT.finditer(text)] + [("endpoint", *m.span()) for m in secrets.ENDPOINT.finditer(text)]
    for m in secrets.TOKEN.finditer(text):
        s = m[0]
        if s != s.lower() and s != s.upper() and any(c.isdigit() for c in s) and not any(a < m.end() and m.start() < b for _, a, b in base):
            weak.append(("token", *m.span()))
    out = []
    for kind, a, b in weak:
        near = {k for k, c, d in base + weak if a - reach <= d <= a or b <= c <= b + reach}
        name, place, assigned, bare = bool(near & {"access", "account"}), "endpoint" in near, "assign" in near, bool(near & {"hex", "token"})
        if {"token": name + place + assigned >= 2, "account": assigned or place and bare, "endpoint": name and (assigned or bare)}[kind]:
            out.append((kind, a, b))
    return out


def test_redact_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a secret=abcdefgh b", "x", 5, 19), (2, None, "y", None, None)], "doc_id long, text string, spans string, `a.b` int, n_chars int")
    assert sorted(map(tuple, secrets.redact(docs).collect())) == [(1, "a [removed] b", "x", 5, 13), (2, None, "y", None, None)]
    odd = docs.withColumn("n_chars", F.lit("many"))
    assert sorted(r.n_chars for r in secrets.redact(odd).collect()) == ["many", "many"]


def test_secrets(spark, docs):
    rng = random.Random(1)
    bits = ['password = "hunter22"', "PASSWD:abc", "token=" + "a1" * 20, "AKIA" + "Z9" * 9, "AKIAshort", "ſecret: abcdefg", "api-key=1", "apikey = 'zzzzzzzz", "f" * 30, "https://host.example/x", "user: bob", "10.0.0.1:8080", "Ab1" * 9, "\n", "filler words", "é😀"]
    for k in range(300):
        text = " ".join(rng.choice(bits) for _ in range(k % 9))
        base = secrets.base_spans(text)
        assert sorted(base) == sorted(brute_base(text))
        every = base + secrets.linked_spans(text, base, 60)
        assert set(base) <= set(every) and sorted(every) == sorted(base + brute_links(text, base, 60)), text
    assert secrets.linked_spans("user: bob at nowhere", []) == []
    linked = "user: bob\nhttps://host.example/x\n" + "Ab1" * 9
    assert [s[0] for s in secrets.linked_spans(linked, [])] == ["account", "endpoint", "token"]
    far = "Ab1" * 9 + " word" * 200 + " https://host.example/x user: bob"
    assert secrets.linked_spans(far, []) == []
    commit = "See https://example.org/commit/" + "a1b2c3d4e5" * 4 + " and https://example.org/docs or " + "0123456789abcdef" * 2
    assert [s[0] for s in secrets.base_spans(commit)] == ["hex", "hex"] and secrets.linked_spans(commit, secrets.base_spans(commit)) == []
    named = "login: ada " + commit
    assert {s[0] for s in secrets.linked_spans(named, secrets.base_spans(named))} == {"account", "endpoint"}
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.redacted("a secret=abcdefgh b", [("assign", 2, 17), ("hex", 9, 17)]) == "a [removed] b"


# 9


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics(texts):
    more = ["a\nb\na\n\n\na", "a b c d e a b c d e", "x\r\nx\r\n", "| a | b |\n| a | b |", "\x00a \x0bb", "é é é é é é é"]
    rows = [*texts, *more]
    got = quality_rules.statistics(pa.array(rows, pa.string()))
    for i, t in enumerate(rows):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(t), (i, (t or "")[:40])


def test_trees_never_rise_with_a_falling_feature():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) - x[:, 2] + rng.normal(0, 0.3, 600) > 0).astype(float)
    trees = quality_rules.boost(x, y, (1, 2))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    for j in (1, 2):
        grid = np.repeat(x[:50], 30, axis=0)
        grid[:, j] = np.tile(np.linspace(-3, 3, 30), 50)
        assert (np.diff(trees.score(grid).reshape(50, 30), axis=1) <= 1e-12).all()


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, len(quality_rules.FEATURES)))
    y = (x[:, 0] - x[:, 3] > 0).astype(float)
    t = quality_rules.boost(x, y, tuple(quality_rules.FEATURES.index(f) for f in quality_rules.FALLING), trees=12)

    def walk(row):
        total = t.start
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [walk(r) for r in x])


def test_kept_is_the_rule_and_the_score(spark, docs):
    train, labels = labelled(spark)
    trees = quality_rules.fit(train, labels)
    rows = docs.collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.apply(docs, trees).collect()), key=repr)
    score = trees.score(quality_rules.statistics(pa.array([r.text for r in rows], pa.string()))["features"])
    want = []
    for r, v in zip(rows, score):
        n, *rest = brute_statistics(r.text)
        failed = n < 10 or 100 * rest[-1] > 20 * n
        want.append((r.doc_id, n, *rest, failed, not failed and bool(v >= 0.3)))
    assert got == sorted(want, key=repr) and any(w[-1] for w in want) and any(not w[-1] for w in want)


# 10


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "é" * 80 + "</html>"
    pages = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (7, "u", long), (4, None, "short"), (5, "u", "short"), (6, "u", None), (2, "u", ""), (8, "u", long + "\r\n\r\nWARC/1.1"), (1, "http://b", long)]
    df = spark.createDataFrame(pages, "record_id long, uri string, html string").select("record_id", "uri", F.encode("html", "UTF-8").alias("payload"))
    path = str(tmp_path / "a")
    warc.store(df, path)
    got = warc.load(spark, path).collect()
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(3, "revisit", 1), (1, "response", None), (7, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (2, "response", None), (8, "response", None), (1, "response", None)], key=lambda x: (x[0], x[1]))
    for r in got:
        html = next((h or "").encode() for i, _, h in pages if i == r.record_id)
        assert r.digest == hashlib.sha256(html).hexdigest()
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == (html if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(html) if r.record_type == 'response' else 0}".encode() in head


def test_warc_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "b")
    warc.store(spark.createDataFrame([(1, "u", bytearray(b"x" * 200))], "record_id long, uri string, payload binary"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y" * 200)).write.parquet(f"{path}/other")
    import shutil

    shutil.rmtree(f"{path}/payloads")
    shutil.move(f"{path}/other", f"{path}/payloads")
    with pytest.raises(Exception, match="no payload with digest"):
        warc.load(spark, path).collect()


def test_warc_revisits_are_rebuilt(spark, tmp_path):
    path = str(tmp_path / "c")
    long = b"<p>" + b"z" * 150
    warc.store(spark.createDataFrame([(1, "u", bytearray(long)), (2, "v", bytearray(long)), (3, "w", bytearray(b"short"))], "record_id long, uri string, payload binary"), path)
    got = {r.record_id: (r.record_type, bytes(r.payload)) for r in warc.load(spark, path, rebuild=True).collect()}
    assert got == {1: ("response", long), 2: ("revisit", long), 3: ("response", b"short")}
    assert {r.record_id: r.payload for r in warc.load(spark, path).collect()}[2] is None


@pytest.mark.parametrize("rebuild", [False, True])
def test_warc_revisit_without_original_is_found(spark, tmp_path, rebuild):
    path = str(tmp_path / "d")
    warc.store(spark.createDataFrame([(1, "u", bytearray(b"x" * 200)), (2, "v", bytearray(b"x" * 200))], "record_id long, uri string, payload binary"), path)
    headers = warc.parsed(spark.read.parquet(f"{path}/headers")).where("record_type = 'revisit'").select("digest", "header")
    headers.write.parquet(f"{path}/lost/headers")
    spark.read.parquet(f"{path}/payloads").limit(0).write.parquet(f"{path}/lost/payloads")
    with pytest.raises(Exception, match="no payload with digest"):
        warc.load(spark, f"{path}/lost", rebuild=rebuild).collect()


def test_warc_files(spark, tmp_path):
    """Files as a plain parser reads them; payloads of any bytes, among them what looks like a record."""
    odd = bytes(range(256)) * 3 + b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [("a>b%", "http://x\r\ny", bytearray(odd)), ("c", "u", bytearray(odd)), ("d", None, bytearray(b"")), ("e", "u", None), (None, "u", bytearray(b"short"))]
    store, files = str(tmp_path / "s"), str(tmp_path / "f")
    warc.store(spark.createDataFrame(rows, "record_id string, uri string, payload binary"), store)
    warc.export(spark, store, files, file_records=2)
    import glob

    paths = sorted(glob.glob(f"{files}/part-*"))
    plain = [x for p in paths for x in warc.records_of(open(p, "rb").read())]
    assert len(plain) == 5 and len(paths) >= 3
    for head, payload in plain:
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and lines[-2:] == ["", ""]
        fields = dict(x.split(": ", 1) for x in lines[1:-2])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and {"WARC-Type", "WARC-Record-ID", "Content-Length"} <= set(fields)
        assert int(fields["Content-Length"]) == len(payload)
    got = {r.record_id: (r.record_type, r.uri, r.refers_to, r.n, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, files, "string").collect()}
    assert got == {"a>b%": ("response", "http://x%0D%0Ay", None, len(odd), odd), "c": ("revisit", "u", "a>b%", None, None), "d": ("response", "", None, 0, b""), "e": ("response", "u", None, 0, b""), None: ("response", "u", None, 5, b"short")}
    broken = tmp_path / "g"
    broken.mkdir()
    (broken / "part-0").write_bytes(b"".join(h + p + b"\r\n\r\n" for h, p in plain).replace(b"short", b"shirt"))
    with pytest.raises(Exception, match="another digest"):
        warc.read(spark, str(broken), "string").collect()


@pytest.mark.parametrize("name", ["op1_decontaminate", "op10_warc"])
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_sql(spark, name):
    import duckdb

    from weftwork.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    out = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(df.columns)
    assert collected(df, *names) == sorted(out.fetchall(), key=repr)
