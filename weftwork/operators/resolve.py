"""Entity resolution: records of one person get one group.

Two records match if their e-mails are equal in lower case, or if their names' token-sort ratio reaches the
threshold. All pairs would be n * n, so names are compared once for each distinct name, and pairs of names
only where both lengths and a shared character k-mer of the sorted tokens allow a match: blocking that
loses no pair. E-mails need no pairs at all, only a star to the least record of each e-mail.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Resolution
from ..functions import fuzzy as Z

MAX_ROUNDS = 60


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut with a reliable checkpoint in the folder that spark.checkpoint.dir names; only a session whose
    executors run in this process may leave it unset, as no other machine sees a temporary folder here."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "weftwork-checkpoints"))
    return df.checkpoint()


#: Up to this length of the longer name pieces are looked for at each place they can have moved to; beyond it anywhere.
PLACED = 64


def name_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, score) of different names with a ratio of threshold or more; names has one column, name, distinct.

    A match of lengths n <= nb takes at most d = (1 - t)(n + nb) insertions and deletions. The shorter name is cut into
    d + 1 even pieces. Take the first piece i such that pieces 0 to i hold at most i edits: it is whole, exactly i edits
    stand before it, so it has moved by i, i - 2, ... -i places, and at most d - i edits make up the rest of the
    difference in length. So both names are joined on one key of both lengths, i and the piece. What only agrees by
    chance is dropped by lengths and character signatures, then by the exact ratio. No matching pair is lost."""
    base = names.select("name", Z.token_sorted(F.col("name")).alias("s")).withColumn("n", F.length("s")).where("n > 0")
    base = base.withColumn("sig", Z.signature(F.col("s")))
    # a row for each length that stands somewhere: at most the length of the longest name, whatever the rows
    lengths = F.broadcast(base.select(F.col("n").alias("other")).distinct())
    n, nb, d = F.col("n"), F.col("nb"), F.col("d")
    begin = lambda i: F.floor(i * n / (d + 1)).cast("int")
    key = lambda i, piece: F.xxhash64(n, nb, i, piece)

    def keyed(shorter: bool, keys: Column) -> DataFrame:
        own, far = ("n", "nb") if shorter else ("nb", "n")
        at = base.withColumnRenamed("n", own).join(lengths.withColumnRenamed("other", far), (n <= nb) & (n * (2 - threshold) >= nb * threshold - 1e-6))
        at = at.withColumn("d", F.floor((1 - threshold) * (n + nb) + 1e-9).cast("int"))
        # names too short to be cut into d + 1 pieces are joined by length alone
        found = F.when(d >= n, F.array(key(F.lit(0), F.lit("")))).otherwise(F.array_distinct(keys))
        return at.select("name", "s", own, "sig", F.explode(found).alias("key"))

    each, s = F.sequence(F.lit(0), d), F.col("s")
    part = lambda at, size: F.substr(s, at + 1, size)
    cut = F.transform(each, lambda i: key(F.when(nb <= PLACED, i).otherwise(F.lit(-1)), part(begin(i), begin(i + 1) - begin(i))))

    def moved(i: Column) -> Column:
        size = begin(i + 1) - begin(i)
        can = lambda x: (F.abs(nb - n - x) <= d - i) & (begin(i) + x >= 0) & (begin(i) + x + size <= nb)
        return F.transform(F.filter(F.sequence(-i, i, F.lit(2)), can), lambda x: key(i, part(begin(i) + x, size)))

    even = F.floor(n / (d + 1)).cast("int")
    anywhere = F.transform(F.array(even, even + 1), lambda size: F.transform(F.sequence(F.lit(0), F.greatest(nb - size, F.lit(0))), lambda p: key(F.lit(-1), part(p, size))))
    looked = F.flatten(F.when(nb <= PLACED, F.transform(each, moved)).otherwise(anywhere))
    a, b = keyed(True, cut), keyed(False, looked).withColumnsRenamed({"name": "other", "s": "so", "sig": "sig_o"})
    hits = a.join(b, "key").where(((n < nb) | ((n == nb) & (F.col("name") < F.col("other")))) & Z.may_reach(n, nb, F.col("sig"), F.col("sig_o"), threshold))
    both = hits.select("name", "s", "other", "so").distinct().withColumn("score", Z.ratio_udf("s", "so"))
    return both.where(F.col("score") >= threshold).select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"), "score")


def email_key() -> Column:
    return F.when(F.length("email") > 0, F.lower("email"))


def star_edges(records: DataFrame, config: Resolution) -> DataFrame:
    """Edges (i, j) that give the same groups as all matching pairs: each record with the least one of its e-mail
    and of its name, and the least records of matching names."""
    out = None
    if config.email_exact_match:
        mail = records.select(F.col("record_id").alias("j"), email_key().alias("k")).where("k is not null")
        out = mail.join(mail.groupBy("k").agg(F.min("j").alias("i")), "k").where("i != j").select("i", "j")
    named = records.where(F.length("name") > 0).select(F.col("record_id").alias("j"), F.col("name"))
    first = named.groupBy("name").agg(F.min("j").alias("i"))
    same = named.join(first, "name").where("i != j").select("i", "j")
    near = name_pairs(first.select("name"), config.name_similarity_threshold)
    linked = near.join(first.select(F.col("name").alias("a"), F.col("i")), "a").join(first.select(F.col("name").alias("b"), F.col("i").alias("j")), "b").select("i", "j")
    edges = same.union(linked)
    return edges if out is None else out.union(edges)


def matches(records: DataFrame, config: Resolution) -> DataFrame:
    """All matching pairs with their reason: i < j, email:exact before name:fuzzy(...). Costs each group all its
    pairs, so it is for reports on groups of modest size."""
    a = records.select(F.col("record_id").alias("i"), email_key().alias("mail"), F.col("name").alias("a"))
    b = a.toDF("j", "mail_b", "b")
    pairs = [a.join(b, (F.col("mail") == F.col("mail_b")) & (F.col("i") < F.col("j"))).select("i", "j", F.lit("email:exact").alias("reason"))] if config.email_exact_match else []
    same = a.where(F.length("a") > 0).join(b, (F.col("a") == F.col("b")) & (F.col("i") < F.col("j"))).select("i", "j", F.lit(1.0).alias("score"))
    near = name_pairs(records.where(F.length("name") > 0).select("name").distinct(), config.name_similarity_threshold)
    ids = records.select("record_id", "name")
    far = near.join(ids.toDF("x", "a"), "a").join(ids.toDF("y", "b"), "b").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "score")
    fuzzy = same.union(far).select("i", "j", F.concat(F.lit("name:fuzzy("), F.format_number("score", 2), F.lit(")")).alias("reason"))
    for p in pairs:
        fuzzy = p.union(fuzzy.join(p.select("i", "j"), ["i", "j"], "left_anti"))
    return fuzzy


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, group_id): the least record of each connected component. Least labels pass along edges and
    jump over labels until none changes; it raises rather than return partial labels."""
    both = checkpointed(edges.select("i", "j").union(edges.select(F.col("j"), F.col("i"))).distinct())
    labels = both.groupBy("i").agg(F.min("j").alias("m")).select(F.col("i").alias("node"), F.least("i", "m").alias("label"))
    labels = checkpointed(labels)
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "j"), "j").groupBy("i").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("i")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = checkpointed(step.join(far, "label", "left").select("node", "old", F.coalesce("far", "label").alias("label")))
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            break
    else:
        raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    return nodes.select("record_id").join(labels, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("label", "record_id").alias("group_id"))


def resolve(records: DataFrame, config: Resolution) -> DataFrame:
    """(record_id, group_id); group_id is the least record_id of the group."""
    return components(records, star_edges(records, config))


def groups(members: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per group: size, is_singleton, sources, first e-mail and name, and reasons in order of pairs.

    members: records with group_id."""
    held = lambda c: F.when(F.length(c) > 0, F.col("record_id"))
    out = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) == 1).alias("is_singleton"),
        F.transform(F.array_sort(F.collect_list(F.struct("record_id", "source"))), lambda x: x["source"]).alias("sources"),
        F.min_by("email", held("email")).alias("primary_email"), F.min_by("name", held("name")).alias("primary_name"),
    )
    if pairs is not None:
        why = pairs.join(members.select(F.col("record_id").alias("i"), "group_id"), "i").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "reason"))), lambda x: x["reason"]).alias("match_reasons"))
        out = out.join(why, "group_id", "left").withColumn("match_reasons", F.coalesce("match_reasons", F.array().cast("array<string>")))
    return out
