"""Confidence of golden records: per field, overall, and in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Confidence, Reliability
from ..functions import fuzzy as Z
from ..functions import normalize as N
from ..functions import text as X
from ..schema import FIELDS, LISTS, SCALARS
from . import validate


def reliability(source: Column, config: Reliability) -> Column:
    return F.coalesce(X.lookup(source, {k: str(v) for k, v in config.weights.items()}).cast("double"), F.lit(config.default))


def freshness(name: str, timestamp: Column, as_of: Column, config: Confidence) -> Column:
    """Halves in half_life_days down to a floor, for fields that go stale; 1 for no or a future time."""
    f = config.freshness
    if name not in f.staleness_fields:
        return F.lit(1.0)
    days = F.floor((F.unix_seconds(as_of) - F.unix_seconds(timestamp)) / 86400)
    return F.when(timestamp.isNull() | (timestamp > as_of), 1.0).otherwise(F.greatest(F.lit(f.min_freshness), F.pow(F.lit(0.5), days / f.half_life_days)))


def noisy_or(weight: Column) -> Column:
    """1 - the product of 1 - weight over a group; 0 for none."""
    return F.coalesce(1 - F.product(1 - weight), F.lit(0.0))


def agreement_curve(similarity: Column, full: float, partial: float, bonus: float, conflict: float) -> Column:
    """A bonus from the full threshold on, a share of it down to the partial one, then a growing penalty."""
    part = bonus * full * (similarity - partial) / max(full - partial, 1e-9)
    return F.when(similarity >= full, bonus * similarity).when(similarity >= partial, part).otherwise(-conflict * (1 - similarity / max(partial, 1e-9)))


def form(name: str, c: Column, config: Confidence) -> Column:
    """What is compared of a field's value."""
    if name == "email":
        return X.strip(F.lower(c))
    if name == "phone":
        return N.phone_digits(c)
    return N.location(c, config.location_aliases) if name == "location" else N.similarity_text(c)


def similarity(name: str, a: Column, b: Column, ratio=Z.ratio_udf) -> Column:
    """Similarity of two compared forms, 0 to 1; ratio is reached only where no rule decides."""
    if name == "email":
        return (a == b).cast("double")
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    out = F.when(a == b, 1.0)
    if name == "phone":
        out = out.when((F.length(short) >= 7) & F.endswith(long, short), 0.95)
    elif name == "location":
        out = out.when(F.contains(a, b) | F.contains(b, a), 0.90)
    return out.otherwise(F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(ratio(a, b)))


def least_similarity(members: DataFrame, config: Confidence, ratio=Z.ratio_udf) -> DataFrame:
    """(group_id, field, n, similarity): the least similarity of any two values of a compared scalar field.

    Equal forms are one value, so copies make no pairs; similarity is null for fields with one record."""
    names = [f for f in SCALARS if not config.thresholds(f).skip_agreement]
    forms = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.length(X.strip(F.col(f))) > 0, form(f, F.col(f), config)).alias("v")) for f in names])
    own = members.select("group_id", F.explode(forms).alias("x")).select("group_id", "x.*").where("v is not null").groupBy("group_id", "field", "v").agg(F.count(F.lit(1)).alias("k"))
    # two e-mails are alike or not, so they need no pairs
    pairs = own.where("field != 'email'").select("group_id", "field", F.col("v").alias("a")).join(own.select("group_id", "field", F.col("v").alias("b")), ["group_id", "field"]).where("a < b")
    pairs = pairs.withColumn("r", ratio(F.col("a"), F.col("b")))
    s = F.lit(None).cast("double")
    for f in names:
        s = F.when(F.col("field") == f, similarity(f, F.col("a"), F.col("b"), lambda *_: F.col("r"))).otherwise(s)
    least = pairs.groupBy("group_id", "field").agg(F.min(s).alias("s"))
    n = own.groupBy("group_id", "field").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("values"))
    return n.join(least, ["group_id", "field"], "left").select("group_id", "field", "n", F.when(F.col("n") > 1, F.coalesce("s", F.when((F.col("field") == "email") & (F.col("values") > 1), 0.0).otherwise(1.0))).alias("similarity"))


def percent(c: Column) -> Column:
    return F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def field_scores(golden: DataFrame, members: DataFrame, config: Confidence, trust: Reliability, as_of: Column, alike: DataFrame | None = None) -> DataFrame:
    """A row for each group and field: score, contributing_sources, similarity, reason. alike: least similarities, if known."""
    stamp = F.col("source_timestamp") if "source_timestamp" in members.columns else F.lit(None).cast("timestamp")
    sure = F.coalesce("extraction_confidence", F.lit(1.0)) if "extraction_confidence" in members.columns else F.lit(1.0)
    kind = lambda f: "array" if f in LISTS else "string"
    long = lambda f: F.struct(F.lit(f).alias("field"), X.non_empty(F.col(f), kind(f)).alias("held"), (reliability(F.col("source"), trust) * freshness(f, stamp, as_of, config) * sure).alias("w"))
    rows = members.select("group_id", "record_id", "source", F.explode(F.array(*[long(f) for f in FIELDS])).alias("x")).select("group_id", "record_id", "source", "x.*").where("held")
    by = rows.groupBy("group_id", "field").agg(noisy_or(F.col("w")).alias("combined"), F.count(F.lit(1)).alias("contributors"), F.transform(F.array_sort(F.collect_list(F.struct("record_id", "source"))), lambda x: x["source"]).alias("contributing_sources"))
    there = golden.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("ord"), X.non_empty(F.col(f), kind(f)).alias("present")) for k, f in enumerate(FIELDS)])).alias("x")).select("group_id", "x.*")
    alike = (least_similarity(members, config) if alike is None else alike).select("group_id", "field", "similarity")
    df = there.join(by, ["group_id", "field"], "left").join(alike, ["group_id", "field"], "left")
    s, n, adjust, agree = F.col("similarity"), F.col("contributors"), F.lit(None).cast("double"), F.lit("")
    for f in SCALARS:
        t = config.thresholds(f)
        if not t.skip_agreement:
            curve = agreement_curve(s, t.full_threshold, t.partial_threshold, config.max_agreement_bonus, config.conflict_penalty)
            own = F.col("field") == f
            adjust = F.when(own, curve).otherwise(adjust)
            words = F.when(curve > 0, F.when(s >= t.full_threshold, "; sources agree").otherwise(F.concat(F.lit("; sources partially agree ("), percent(s), F.lit(")")))).when(curve < 0, F.concat(F.lit("; sources conflict (similarity="), percent(s), F.lit(")"))).otherwise("")
            agree = F.when(own & s.isNotNull(), words).otherwise(agree)
    full = F.when(s.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("combined") + adjust))).otherwise(F.least(F.lit(1.0), F.col("combined")))
    no_names = F.array().cast("array<string>")
    present = F.col("present")
    return df.select(
        "group_id", "field", "ord",
        F.when(~present, 0.0).when(n.isNull(), 0.5).otherwise(F.round(full, 3)).alias("score"),
        F.when(present, F.coalesce("contributing_sources", no_names)).otherwise(no_names).alias("contributing_sources"),
        F.when(present & n.isNotNull(), F.round(s, 3)).alias("similarity"),
        F.when(~present, "field absent").when(n.isNull(), "no source metadata").otherwise(F.concat(n.cast("string"), F.lit(" source(s) contributing"), agree)).alias("reason"),
    )


def completeness(config: Confidence) -> Column:
    """Weight of the fields that a golden record has."""
    kind = lambda f: "array" if f in LISTS else "string"
    total = F.lit(0.0)
    for f in FIELDS:
        total = total + F.when(X.non_empty(F.col(f), kind(f)), config.field_weights.get(f, 0.0)).otherwise(0.0)
    return F.round(total, 3)


def source_agreement(alike: DataFrame) -> DataFrame:
    """(group_id, source_agreement): mean of the least similarities; groups without any are left out and count as 1."""
    return alike.where("similarity is not null").groupBy("group_id").agg(F.round(F.avg("similarity"), 3).alias("source_agreement"))


def diversity_bonus(trusted: Column, config: Confidence) -> Column:
    """trusted: number of records whose source is reliable enough."""
    d = config.diversity
    return F.when(F.lit(d.enabled) & (trusted >= d.min_sources), d.max_bonus * F.least(F.lit(1.0), trusted / d.min_sources)).otherwise(0.0)


def overall(field_total: Column, complete: Column, agreement: Column, n: Column, bonus: Column, penalty: Column, config: Confidence) -> Column:
    """Weights by number of records, bonus added, penalty taken off; within 0 and 1."""
    w = config.adaptive_weights
    parts = [F.when(n <= 1, a).when(n < w.many_threshold, b).otherwise(c) for a, b, c in zip(w.triplet("one"), w.triplet("two"), w.triplet("many"))]
    score = field_total * parts[0] + complete * parts[1] + agreement * parts[2] + bonus - penalty
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def score(golden: DataFrame, members: DataFrame, issues: DataFrame, config: Confidence, trust: Reliability, as_of: Column, ratio=Z.ratio_udf) -> DataFrame:
    """The report of each group: overall_score, field_scores, completeness, source_agreement, diversity_bonus,
    validation_penalty, explanations; and all_issues, the given issues with those across fields."""
    alike = least_similarity(members, config, ratio)
    fields = field_scores(golden, members, config, trust, as_of, alike)
    weight = X.lookup(F.col("field"), {k: str(v) for k, v in config.field_weights.items()}).cast("double")
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.col("field").alias("field_name"), "score", "contributing_sources", "reason", "similarity")))
    packed = fields.groupBy("group_id").agg(F.sum(F.col("score") * F.coalesce(weight, F.lit(0.0))).alias("field_total"), F.transform(ordered, lambda x: x.dropFields("ord")).alias("field_scores"))
    trusted = members.groupBy("group_id").agg(F.count_if(reliability(F.col("source"), trust) >= config.diversity.min_reliability).alias("trusted"), F.min_by("source", "record_id").alias("first_source"))
    df = golden.join(packed, "group_id").join(trusted, "group_id").join(source_agreement(alike), "group_id", "left").join(issues, "group_id", "left")
    df = df.withColumn("all_issues", F.concat(F.coalesce("issues", validate.no_issues()), validate.cross_field()))
    df = df.withColumns({"completeness": completeness(config), "source_agreement": F.coalesce("source_agreement", F.lit(1.0)), "diversity_bonus": diversity_bonus(F.col("trusted"), config), "validation_penalty": validate.penalty(F.col("all_issues"), config)})
    df = df.withColumn("overall_score", overall(F.col("field_total"), F.col("completeness"), F.col("source_agreement"), F.col("n_records"), F.col("diversity_bonus"), F.col("validation_penalty"), config))
    return df.select("group_id", "overall_score", "field_scores", "completeness", "source_agreement", explanations(config, trust).alias("explanations"), F.round("diversity_bonus", 3).alias("diversity_bonus"), F.round("validation_penalty", 3).alias("validation_penalty"), "all_issues")


def explanations(config: Confidence, trust: Reliability) -> Column:
    """Why a score is what it is, line by line."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    n, agree, whole = F.col("n_records"), F.col("source_agreement"), F.col("completeness")
    head = F.when(n == 1, text("Single source: ", F.col("first_source"), " (reliability ", percent(reliability(F.col("first_source"), trust)), ")")).otherwise(text(n.cast("string"), " source records merged"))
    least = f"{config.diversity.min_reliability:.0%}"
    varied = F.when(F.col("diversity_bonus") > 0, text("✔ Source diversity bonus +", percent(F.col("diversity_bonus")), " (", n.cast("string"), f" sources ≥ {least} reliability)"))

    def of(x: Column) -> Column:
        name, s = x["field_name"], x["similarity"]
        return (
            F.when(x["score"] == 0, text("✖ ", name, ": absent"))
            .when(F.contains(x["reason"], F.lit("conflict")), text("⚠ Warning: ", name, " sources conflict", F.when(s.isNotNull(), text(" (similarity=", percent(s), ")")).otherwise("")))
            .when(F.contains(x["reason"], F.lit("partially agree")), text("~ ", name, ": partial agreement (", percent(s), " similarity, score ", percent(x["score"]), ")"))
            .when(x["score"] >= 0.85, text("✔ ", name, ": high confidence (", percent(x["score"]), ")"))
        )

    agreed = F.when(n >= 2, F.when(agree >= 0.90, text("✔ Sources agree strongly (", percent(agree), ")")).when(agree < 0.70, text("✖ Sources disagree on key fields (", percent(agree), " agreement)")))
    complete = F.when(whole >= 0.80, text("✔ Profile ", percent(whole), " complete")).when(whole < 0.40, text("✖ Profile only ", percent(whole), " complete — key fields missing"))
    some = lambda severity, mark: F.transform(F.slice(F.filter("all_issues", lambda x: x["severity"] == severity), 1, 3), lambda x: F.concat(F.lit(mark), x["message"]))
    return F.array_compact(F.concat(F.array(head, varied), F.transform("field_scores", of), F.array(agreed, complete), some("error", "✖ Error: "), some("warning", "⚠ Warning: "), some("info", "ℹ ")))
