r"""N-gram Jaccard join: groups of documents linked by a Jaccard similarity of 0.8 or more on 5-word shingles.

1. One pass makes each text's shingle set, its size, a key of the set, and a parity bitmap (bit k is the
   parity of the shingles hashed to k, two to four bits for each shingle). Texts with equal sets are one class
   from here on: sets are told apart by 128 bits, a 64-bit key and a check; where one key has two checks, these
   sets are keyed anew. The pass also counts in how many texts the shingles of each of 2**18 hash buckets stand;
   these counts order all shingles from rare to common.
2. A second pass emits the rarest fifth of each set: two sets with similarity 0.8 share one of these. Rows
   that share a shingle form a tile, banded and sorted by set size. A shingle that a task meets often gets tiles
   of its own for the rows after the first ones, whose first rows stand in the common tile too.
3. In each tile, every row is paired with its neighbour in size order and with the first of its band: a tile
   of m rows makes fewer than 2 m pairs. Bitmaps bound the overlap from above, |A and B| <= (|A| + |B| -
   hamming) / 2; the pairs left are decided by exact intersection of sorted arrays. Links give groups.
4. Shingles whose rows are in one group hold nothing more. For the others, each row takes the partner of another
   group whose bitmap is nearest; these pairs are decided, groups joined, and that is done again. Last, all
   pairs of rows that are still in different groups are held against size and bitmap bounds, block by block,
   and those left are decided. The rows of a large group have blocks of their own, which never meet each other:
   a shingle of m rows, all but r in one group, costs about r m comparisons and not m m.

Scale: rows of copies are merged before the shuffle by shingle, in each task; pair rows carry keys until the
bitmaps have been used; only texts of open pairs are shuffled, one for each set, and made into sorted arrays. The counts
sent to the driver and the executors have 2**18 entries at any size. Groups come from label propagation over
narrow rows, each round written to the shared folder. Tables that no later step reads are deleted.

Defined results: null texts and texts without words have empty sets and are groups of their own, by
doc_id; a text with one to four words is one shingle; repeated rows are copies, and rows of one doc_id with
different texts are looked at one by one; rows with a null doc_id belong to groups like others but never name
one that holds a doc_id; shingles are told apart by 64 bits; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import SPACED_FOLD, Scan, drop_shared, flat, gram_hash, slices, table, write_shared

WORDS, NUM, DEN, BUCKET_BITS, BLOCK, BEST_ROUNDS, MAX_ROUNDS = 5, 4, 5, 18, 256, 2, 100
#: Rows that a task puts into a shingle's common tile, and rows of each of its further tiles.
OFTEN, TILE = 256, 1024


def shingles(column: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    scan = Scan(*flat(column), SPACED_FOLD)
    g, at = scan.grams(k)
    edge = np.searchsorted(at, scan.first)
    out = [np.unique(g[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    for d in np.flatnonzero((scan.count > 0) & (scan.count < k)).tolist():
        a, b = int(scan.first[d]), int(scan.first[d + 1])
        out[d] = gram_hash([scan.hash[i : i + 1] for i in range(a, b)])
    return out


class Keys:
    """64-bit keys of sets; the sets of a key in clash, which stands for several, are keyed with another seed."""

    def __init__(self, clash: frozenset[int] = frozenset(), bits: int = 64):
        self.clash, self.bits = clash, bits

    def __call__(self, s: np.ndarray) -> int:
        key = (xxhash.xxh3_64_intdigest(s.tobytes()) >> (64 - self.bits)) - (1 << (self.bits - 1))
        return xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) - (1 << 63) if key in self.clash else key

    @staticmethod
    def check(s: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(s.tobytes(), seed=2) - (1 << 63)


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of at least 64 and at least 2 len(s) bits, a power of two."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to fewer words; bits that fall together cancel in pairs."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] ^ b[..., half:]
    return b


def may_link(na, nb, hamming):
    """Whether an overlap of (na + nb - hamming) / 2 would do: DEN * overlap >= NUM * union."""
    most = np.minimum((na + nb - hamming) // 2, np.minimum(na, nb))
    return DEN * most >= NUM * (na + nb - most)


def prefix_length(n: int) -> int:
    """Elements that any set with a similarity of NUM / DEN must share one of: n - ceil(n * NUM / DEN) + 1."""
    return n - -(-n * NUM // DEN) + 1


def _profile(docs: DataFrame, keys: Keys) -> DataFrame:
    """Rows of documents (doc_id, t, n, fp, check, bits) and of bucket counts (bucket, texts); t: hash of the text; a task gives a set's bits once."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "t", "n", "fp", "check", "bits", "bucket", "texts"]

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(size, t) for c, t in zip(names, types)], names=names)

    def run(batches):
        counts, seen = np.zeros(1 << BUCKET_BITS, np.int64), set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(part.column("text"))
                n = [len(s) for s in sets]
                if sum(n):
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
                fp, check, bits = [], [], []
                for s in sets:
                    fp.append(keys(s) if len(s) else None)
                    check.append(keys.check(s) if len(s) else None)
                    new = len(s) > 0 and (fp[-1], check[-1]) not in seen
                    if new:
                        seen.add((fp[-1], check[-1]))
                    bits.append(bitmap(s) if new else None)
                yield rows(len(n), doc_id=part.column("doc_id"), t=part.column("t"), n=pa.array(n, pa.int64()), fp=pa.array(fp, pa.int64()), check=pa.array(check, pa.int64()), bits=pa.array(bits, pa.binary()))
        used = np.flatnonzero(counts)
        for a in range(0, len(used), 50_000):
            some = used[a : a + 50_000]
            yield rows(len(some), bucket=pa.array(some), texts=pa.array(counts[some]))

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, f"doc_id {kind.simpleString()}, t long, n long, fp long, check long, bits binary, bucket int, texts long")


def _classes(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, Keys]:
    """The profile, one row for each different set (fp, rep, n, bits, and doc_id and t of a text with this set as row), and the keys used."""
    keys = Keys(bits=bits)
    for _ in range(2):
        profile = write_shared(_profile(docs, keys), "jaccard-profile")
        full = profile.where("fp is not null")
        classes = write_shared(full.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.min(F.struct("doc_id", "t")).alias("row"), F.min("check").alias("c0"), F.max("check").alias("c1")), "jaccard-classes")
        twice = [r["fp"] for r in classes.where("c0 != c1").select("fp").limit(100_001).collect()]  # none, or a few at 10**10 sets
        if not twice:
            return profile, classes.drop("c0", "c1"), keys
        if keys.clash or len(twice) > 100_000:
            break
        drop_shared(profile, classes)
        keys = Keys(frozenset(twice), bits)
    raise RuntimeError("different sets have the same keys")


class _Places:
    """Which tile a row goes to. A token that the task has met OFTEN times goes on in tiles of TILE rows, numbered by the task."""

    def __init__(self, often: int = OFTEN, tile: int = TILE):
        self.often, self.tile, self.met, self.exact = often, tile, np.zeros(1 << 20, np.int32), {}
        context = TaskContext.get()
        self.base = (context.partitionId() if context else 0) << 32

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tile of each token's row, 0 the common one; and which rows stand in the common tile as well."""
        place, firsts = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        bucket = (tokens >> np.uint64(44)).astype(np.int64)
        self.met += np.bincount(bucket, minlength=1 << 20).astype(np.int32)
        for i in np.flatnonzero(self.met[bucket] > self.often).tolist():  # from here on this token's rows are counted exactly
            token = int(tokens[i])
            k = self.exact[token] = self.exact.get(token, -1) + 1
            if k >= self.often:
                place[i] = self.base + 1 + (k - self.often) // self.tile
                firsts[i] = (k - self.often) % self.tile == 0
        return place, firsts


def _prefixes(docs: DataFrame, counts: np.ndarray, keys: Keys, often: int = OFTEN, tile: int = TILE) -> DataFrame:
    """token, tile, fp and n for the rarest shingles of each set; each set once in a task; a second row, in the common tile, has -n."""
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 20) - 1).astype(np.uint32))

    def run(batches):
        rare, seen, places = sent.value, set(), _Places(often, tile)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, fps, ns = [], [], []
                for s in shingles(part.column("text")):
                    n = len(s)
                    if n * (DEN - NUM) < NUM:  # below this size only equal sets are similar enough
                        continue
                    fp = keys(s)
                    if fp in seen:
                        continue
                    seen.add(fp)
                    order = (rare[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(44)) | (s >> np.uint64(20))
                    p = prefix_length(n)
                    tokens.append(s[np.argsort(order, kind="stable")[:p]])
                    fps.append(np.full(p, fp))
                    ns.append(np.full(p, n))
                if tokens:
                    token, fp, n = np.concatenate(tokens), np.concatenate(fps).astype(np.int64), np.concatenate(ns).astype(np.int64)
                    place, firsts = places(token)
                    token = token.view(np.int64)
                    if firsts.any():
                        token, fp, n = np.concatenate([token, token[firsts]]), np.concatenate([fp, fp[firsts]]), np.concatenate([n, -n[firsts]])
                        place = np.concatenate([place, np.zeros(int(firsts.sum()), np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, place, fp, n)], names=["token", "tile", "fp", "n"])

    return docs.select("text").mapInArrow(run, "token long, tile long, fp long, n long")


def _arrays(texts: DataFrame, keys: Keys) -> DataFrame:
    """fp and sorted array of the sets of texts; each set once in a task."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = {keys(s): s for s in shingles(part.column("text")) if len(s)}
                new = [k for k in sets if k not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([sets[k].tobytes() for k in new], pa.binary())], names=["fp", "s"])

    return texts.select("text").mapInArrow(run, "fp long, s binary")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the bitmaps leave open."""
    side = lambda c: classes.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def run(batches):
        for batch in batches:
            x = {c: batch.column(c) for c in batch.schema.names}
            keep = []
            for a, b, na, nb in zip(x["bits_a"], x["bits_b"], x["n_a"].to_pylist(), x["n_b"].to_pylist()):
                u, v = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                w = min(len(u), len(v))
                keep.append(bool(may_link(na, nb, int(np.bitwise_count(folded(u, w) ^ folded(v, w)).sum()))))
            yield pa.RecordBatch.from_arrays([x["a"], x["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _decided(pairs: DataFrame, classes: DataFrame, docs: DataFrame, keys: Keys, label: str) -> DataFrame:
    """Those pairs (a written table) that are similar, by exact intersection."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    wanted = classes.select("fp", "row").join(ends, "fp", "left_semi").select("row")
    texts = docs.select("text", F.struct("doc_id", F.xxhash64("text").alias("t")).alias("row")).join(wanted, "row", "left_semi")
    sets = write_shared(_arrays(texts, keys), f"{label}-sets")  # rows that repeat a doc_id and text lie in one task

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("s_a"), batch.column("s_b")):
                u, v = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([u, v])
                both.sort(kind="stable")  # two sorted runs: a merge
                common = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * common >= NUM * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("fp").alias(c), F.col("s").alias(f"s_{c}"))
    links = write_shared(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long"), f"{label}-links")
    drop_shared(sets)
    return links


def components(links: DataFrame, label: str) -> DataFrame:
    """node and label (the least node of its group) for all nodes of links (a, b)."""
    edges = write_shared(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{label}-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = write_shared(labels, f"{label}-labels")
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = write_shared(step.join(jump, "label", "left").select("node", "old", F.coalesce("far", "label").alias("label")), f"{label}-labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels
    raise RuntimeError("label propagation has not ended")


def contracted(labels: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """labels after links between groups: the groups are the nodes, so most links fall together."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
    between = write_shared(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-between")
    if between.isEmpty():
        return labels
    joined = components(between, label).select(F.col("node").alias("label"), F.col("label").alias("least"))
    known = labels.join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    new = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("least").alias("label"))
    return write_shared(known.union(new), f"{label}-labels")


def _tiles(prefixes: DataFrame) -> DataFrame:
    """Tiles with two or more sets: each row with the one before it and the first of its band."""
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(DEN / NUM)).cast("int")
    w = W.partitionBy("token", "tile").orderBy("band", "n", "fp", "again")
    rows = prefixes.repartition("token", "tile").withColumns({"again": F.col("n") < 0, "n": F.abs("n")})
    rows = rows.withColumn("band", band).withColumn("same", F.lag("fp").over(w)).where("same is null or same != fp")
    rows = rows.withColumns({"p": F.lag("fp").over(w), "p_n": F.lag("n").over(w), "after": F.lead("fp").over(w), "v": F.first("fp").over(W.partitionBy("token", "tile", "band").orderBy("n", "fp", "again"))})
    return rows.where("p is not null or after is not null or tile != 0").select("token", "again", "fp", "n", "p", "p_n", "v")


def _near_pairs(tiles: DataFrame) -> DataFrame:
    by = lambda c: tiles.where(f"{c} is not null and {c} != fp").select(F.least("fp", c).alias("a"), F.greatest("fp", c).alias("b"), "n", *(["p_n"] if c == "p" else []))
    first = by("p").where(f"{DEN} * p_n >= {NUM} * n")
    return first.select("a", "b").union(by("v").select("a", "b")).distinct()


def _mixed(tiles: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Rows (token, fp, n, label) of the tokens whose sets are in more than one group, each set once."""
    rows = tiles.where("not again").select("token", "fp", "n").join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = rows.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("m")).where("l0 != l1 and m > 2").select("token")
    return write_shared(rows.join(mixed, "token").distinct(), f"{name}-mixed")  # several tasks may have met a set


def _cross_pairs(rows: DataFrame, classes: DataFrame, block: int = BLOCK, best: bool = False) -> DataFrame:
    """Pairs of different groups with the same token that sizes and bitmaps leave open; with best, for each row the nearest only.

    The rows of a token are dealt into blocks of about block rows. A group of block rows or more has blocks of its own,
    which meet all blocks but those; the rows of smaller groups share blocks, which meet all."""
    by = W.partitionBy("token")
    own = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).withColumn("large", F.col("c") >= block)
    own = own.withColumn("k", F.when(F.col("large"), F.ceil(F.col("c") / block)).otherwise(0))
    own = own.withColumns({"before": F.sum("k").over(by.orderBy("label")) - F.col("k"), "larges": F.sum("k").over(by), "shared": F.ceil(F.sum(F.when(~F.col("large"), F.col("c")).otherwise(0)).over(by) / block)})
    own = own.select("token", "label", "large", F.when(F.col("large"), F.col("before")).otherwise(F.col("larges")).alias("first"), F.when(F.col("large"), F.col("k")).otherwise(F.col("shared")).alias("k"), (F.col("larges") + F.col("shared")).alias("blocks"))
    placed = rows.join(own, ["token", "label"]).withColumn("own", (F.col("first") + F.pmod(F.xxhash64("fp"), "k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: ~F.col("large") | (x < F.col("first")) | (x >= F.col("first") + F.col("k")))
    rows = placed.withColumn("other", F.explode(others)).withColumn("other", F.col("other").cast("int")).select("token", "fp", "n", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(classes.select("fp", "bits"), "fp")

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            key = np.column_stack([t.column(c).to_numpy() for c in ("token", "i", "j")])
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            last = int(edge[-1]) if len(edge) else 0
            rest = t.slice(last).combine_chunks().to_batches()[0]
            yield from _in_tiles(t.slice(0, last), [0, *edge.tolist()], best)
        if rest is not None:
            yield from _in_tiles(pa.Table.from_batches([rest]), [0, rest.num_rows], best)

    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "fp").mapInArrow(run, "a long, b long").distinct()


def _in_tiles(t: pa.Table, edge: list[int], best: bool):
    if not t.num_rows:
        return
    fp, n, label, own, i, j = (t.column(c).to_numpy() for c in ("fp", "n", "label", "own", "i", "j"))
    bits = t.column("bits").to_pylist()
    out_a, out_b = [], []
    for s, e in zip(edge[:-1], edge[1:]):
        if e - s < 2 or (label[s:e] == label[s]).all():
            continue
        words = np.array([len(b) // 8 for b in bits[s:e]])
        stacked = {w: folded_rows(bits[s:e], words, w) for w in np.unique(words).tolist()}
        size, lab, side = n[s:e], label[s:e], own[s:e]
        cross = i[s] != j[s]
        least, mate = np.full(e - s, 1 << 30), np.zeros(e - s, np.int64)
        stop = np.searchsorted(size, size * DEN // NUM, side="right")
        for k in range(e - s - 1):
            q = np.arange(k + 1, stop[k])
            q = q[lab[q] != lab[k]]
            if cross:
                q = q[side[q] != side[k]]
            if not len(q):
                continue
            m, place = stacked[int(words[k])]
            hamming = np.bitwise_count(m[place[q]] ^ m[place[k]]).sum(1)
            hamming = hamming.astype(np.int64)
            open_ = may_link(size[k], size[q], hamming)
            q, hamming = q[open_], hamming[open_]
            if not best:
                out_a.append(np.full(len(q), fp[s + k]))
                out_b.append(fp[s + q])
            elif len(q):
                nearer = hamming < least[q]
                least[q[nearer]], mate[q[nearer]] = hamming[nearer], k
                n0 = int(hamming.argmin())
                if hamming[n0] < least[k]:
                    least[k], mate[k] = hamming[n0], q[n0]
        if best and (found := np.flatnonzero(least < 1 << 30)).size:
            out_a.append(fp[s + found])
            out_b.append(fp[s + mate[found]])
    if out_a:
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def folded_rows(bits: list[bytes], words: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of w or 2 w words, as w words; and the place of each row in them."""
    use = np.flatnonzero((words == w) | (words == 2 * w))
    place = np.full(len(words), -1)
    place[use] = np.arange(len(use))
    return np.array([folded(np.frombuffer(bits[x], np.uint64), w) for x in use.tolist()]), place


def _groups(docs: DataFrame, *, key_bits: int = 64, block: int = BLOCK, often: int = OFTEN, tile: int = TILE) -> tuple[DataFrame, DataFrame, Keys]:
    """Rows (doc_id, n, fp) of docs (doc_id, text); for each fp its group's label and component_id, null if no row has a doc_id; the keys."""
    docs = docs.select("doc_id", "text")
    profile, classes, keys = _classes(docs, key_bits)
    found = profile.where("bucket is not null").groupBy("bucket").agg(F.sum("texts").alias("texts")).toPandas()  # at most 2**18 rows
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[found["bucket"].to_numpy()] = found["texts"].to_numpy()
    own = profile.where("bucket is null").select("doc_id", "n", "fp")
    tiles = write_shared(_tiles(_prefixes(docs, counts, keys, often, tile)), "jaccard-tiles")
    near = write_shared(_near_pairs(tiles), "jaccard-near")
    open_ = write_shared(_bounded(near, classes), "jaccard-open")
    links = _decided(open_, classes, docs, keys, "jaccard-near")
    labels = components(links, "jaccard-near")
    decided = [near]

    def across(name: str, best: bool) -> DataFrame:
        """labels after the links among the pairs of different groups that are not decided yet."""
        mixed = _mixed(tiles, labels, name)
        pairs = _cross_pairs(mixed, classes, block, best)
        for known in decided:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = write_shared(pairs, name)
        out = contracted(labels, _decided(pairs, classes, docs, keys, name), name)
        drop_shared(mixed)
        decided.append(pairs)
        return out

    for k in range(BEST_ROUNDS):
        labels = across(f"jaccard-best{k}", True)
    labels = across("jaccard-rest", False)
    drop_shared(tiles, open_, *decided)
    named = classes.select("fp", "rep").join(labels.select(F.col("node").alias("fp"), "label"), "fp")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = write_shared(named.join(least, "label").select("fp", "label", "component_id"), "jaccard-groups")
    every = classes.select("fp", "rep").join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "rep").alias("component_id"))
    return own, every, keys


def _named(own: DataFrame, every: DataFrame) -> DataFrame:
    grouped = own.where("fp is not null").join(every, "fp").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return grouped.union(own.where("fp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def join_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of docs (doc_id, text)."""
    own, every, _ = _groups(docs, **options)
    return _named(own, every)


def _keyed(docs: DataFrame, text: str, keys: Keys) -> DataFrame:
    """docs with the key of each text's set as the last column, fp."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                fp = [keys(s) if len(s) else None for s in shingles(part.column(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp, pa.int64())], names=[*part.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group: that of its least doc_id, or of its least key if it has none.

    Rows are decided one by one: of a doc_id that stands on several texts, each is kept or dropped with its own group.
    Rows without words are groups of their own; those of one doc_id are kept once, those without doc_id all."""
    own, every, keys = _groups(docs, **options)
    best = own.where("fp is not null").join(every, "fp").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("x"))
    first = best.select(F.struct("x.doc_id", "x.fp").alias("id"), F.lit(True).alias("first"))
    inner = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names can't clash with ours
    key, text = (inner[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = _keyed(docs.toDF(*inner), text, keys).withColumn("id", F.struct(F.col(key).alias("doc_id"), "fp"))
    alone = F.col("fp").isNull()
    kept = rows.join(first, "id", "left").where(F.col("first") | alone)
    # repeated rows of one doc_id and set are one; nameless rows without words keep numbers of their own
    number = F.when(alone & F.col(key).isNull(), F.monotonically_increasing_id())
    one = kept.withColumn("number", number).groupBy("id", "number").agg(F.min_by(F.struct(*inner), F.coalesce(text, F.lit(""))).alias("x"))
    return one.select(*[F.col("x")[c].alias(name) for c, name in zip(inner, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))
