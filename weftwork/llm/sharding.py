r"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the row); equal texts therefore lie side by side. The
driver looks for the shards' byte boundaries in that order: every round counts the exact bytes below
candidate keys across all partitions, by partial aggregation, and refines only the intervals that hold a
boundary, until each splitter is within the tolerance. Then the rows are exchanged once. Only a group of
equal texts that lies across a boundary is cut, so a group of any size spreads over as many shards as it
fills; a boundary that has a group's edge within the tolerance takes that edge.

Scale: each round returns at most PROBES rows for each open boundary and reads the keys alone; the rows, texts
included, cross one exchange. Slots are numbered in many buckets for each shard, whose counts are summed
up first, so no task holds a shard. The keyed rows are written to the shared folder, as Parquet, because row hashes
must not change when a task runs again.

Law: bytes. Defined results: a null text has size 8 and crc32 0; repeated rows get slots of their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import table, write_shared

SHARDS, TOLERANCE, PROBES, MAX_ROUNDS, BUCKET_ROWS = 24, 0.002, 1024, 16, 100_000
_LOW = -(1 << 63)
_TOP = 1 << 64


class _Cut:
    """A boundary being looked for: shards 0..i hold bytes up to about target.

    done is the bytes below the open interval [lo, hi) of the group key, or of the row key inside
    the one group that the boundary lies in."""

    def __init__(self, target: float):
        self.target, self.group, self.lo, self.hi, self.done, self.key = target, None, 0, _TOP, 0, None


def _from_low(x: int) -> int:
    """An unsigned position as Spark's signed long."""
    return x + _LOW


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (group, row) below which shard i ends, for i in 0..shards-2; keyed has g, r and size."""
    total = keyed.agg(F.sum("size")).first()[0]
    if not total:
        return []
    slack = tolerance * total / shards
    cuts = [_Cut(total * (i + 1) / shards) for i in range(shards - 1)]
    for _ in range(MAX_ROUNDS):
        spans = {}  # boundaries in the same interval share its probes
        for c in cuts:
            if c.key is None:
                spans.setdefault((c.group, c.lo, c.hi), []).append(c)
        if not spans:
            break
        code, low = F.lit(None).cast("int"), {}
        for k, (group, lo, hi) in enumerate(spans):
            step = max(1, -(-(hi - lo) // PROBES))
            low[k] = (group, lo, step)
            col = F.col("g") if group is None else F.col("r")
            inside = (col >= F.lit(_from_low(lo))) & (col <= F.lit(_from_low(hi - 1)))
            if group is not None:
                inside &= F.col("g") == F.lit(_from_low(group))
            # (col - lo) is unsigned below 2**64: split it so that signed division stays exact
            if step >= 2 and (step & (step - 1)) == 0:
                bits = step.bit_length() - 1
                cell = F.shiftrightunsigned(col.bitwiseXOR(F.lit(_LOW)), bits) - F.lit(lo >> bits)
            else:
                cell = F.floor((col - F.lit(_from_low(lo))) / F.lit(step))
            code = F.when(inside, F.lit(k * 2 * PROBES) + cell.cast("int")).otherwise(code)
        counted = keyed.select(code.alias("code"), "g", "size").where("code is not null").groupBy("code").agg(F.sum("size").alias("b"), F.min("g").alias("g0"), F.max("g").alias("g1")).collect()
        cells: dict[int, list] = {}
        for x in sorted(counted, key=lambda x: x["code"]):
            cells.setdefault(x["code"] // (2 * PROBES), []).append((x["code"] % (2 * PROBES), x["b"], x["g0"], x["g1"]))
        for k, own in enumerate(spans.values()):
            group, lo, step = low[k]
            for c in own:
                below = c.done
                for cell, size, g0, g1 in cells.get(k, []):
                    a, b = lo + cell * step, min(lo + (cell + 1) * step, c.hi)
                    if below + size < c.target:
                        below += size
                        continue
                    near_low, near_high = c.target - below <= slack, below + size - c.target <= slack
                    if near_low or near_high or (b - a <= 1 and group is not None):
                        at = a if near_low or c.target - below < below + size - c.target else b
                        c.key = (at, 0) if group is None else (group, at)
                    elif group is None and g0 == g1:  # one group of equal texts lies here: go on inside it
                        c.group, c.lo, c.hi, c.done = g0 - _LOW, 0, _TOP, below
                    else:
                        c.lo, c.hi, c.done = a, b, below
                    break
                else:
                    c.key = (c.hi, 0) if group is None else (group, c.hi)
    for c in cuts:  # not within the tolerance after the last round: rows too large to do better
        c.key = c.key or ((c.lo, 0) if c.group is None else (c.group, c.lo))
    return sorted((g, r) if r < _TOP else (g + 1, 0) for g, r in (c.key for c in cuts))


def shard(rows: DataFrame, *, size, group, row, shards: int = SHARDS, tolerance: float = TOLERANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with shard and slot added. size: bytes of a row; group: equal for rows to keep side by side; row: tells rows apart as far as it can."""
    inner = [f"c{i}" for i in range(len(rows.columns))]  # the caller's names can't clash with ours
    keyed = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(rows.columns, inner)], size.cast("long").alias("size"), F.xxhash64(group).alias("g"), F.xxhash64(row, F.monotonically_increasing_id()).alias("r"))
    keyed = write_shared(keyed, "sharding-keyed")
    cuts = splitters(keyed, shards, tolerance)
    place = F.lit(0)
    for g, r in cuts:
        g_, r_ = F.lit(min(_from_low(g), (1 << 63) - 1)).cast("long"), F.lit(_from_low(r)).cast("long")
        place = place + F.when((F.col("g") > g_) | ((F.col("g") == g_) & (F.col("r") >= r_)), 1).otherwise(0) if g < _TOP else place
    buckets = max(64, -(-keyed.count() // (shards * bucket_rows)))
    placed = keyed.withColumns({"shard": place.cast("int"), "bucket": F.pmod("r", F.lit(buckets)).cast("int")})
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    start = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("g", "r")))
    # at most shards * buckets rows, 16 bytes each, one bucket for bucket_rows rows
    small = F.broadcast(start) if shards * buckets <= 250_000 else start
    return numbered.join(small, ["shard", "bucket"]).select(*[F.col(i).alias(c) for i, c in zip(inner, rows.columns)], "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))


def lay_out(docs: DataFrame) -> DataFrame:
    """Whole documents (doc_id, text) in their shards, with shard and slot."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return shard(docs.select("doc_id", "text"), size=size, group=F.col("text"), row=F.col("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # size and text_crc32 come from the texts that arrived in the shards
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return lay_out(table(spark, sf_dir, "documents")).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
