"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source is cut by a hash of the row into buckets, each bucket's words into blocks of about BLOCK words, so a hot
   source is many small streams. Blocks are dealt by a hash to the pools of the output shards.
2. A source's quota is whole epochs of all its blocks, and a draw of some blocks for the rest. The splitting tree
   partitions the number of drawn blocks among the shards: at each node the left half of the shards gets a
   hypergeometric number, given how many of the node's blocks lie in its pools; so the numbers of all
   shards are multivariate hypergeometric and add up to the quota.
3. Each shard draws the number that the tree gave it from its own pool, in a permuted order: disjoint blocks.
   Drawn blocks are cut to the same share of their words (cumulative rounding), so that the quota is met to the word.
4. Each shard orders its blocks by a hash: a local shuffle.

Nothing is gathered on the driver but sums over sources for the water level of the targets (one row a round), and
no window is wider than a bucket, or than one source's blocks in one shard; the tree of a source sees one row for each shard,
at most MAX_SHARDS. Sources are rows of a table, in any number.

Defined results: null text has size 0 and is never taken; null source is a source of its own, last in
order; repeated rows are documents of their own; an empty table gives no rows; other columns are carried or ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, numbered, read, small, tidy, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, BLOCK, BUCKET_WORDS, SHARD_BLOCKS, LEAST_SHARDS, MAX_SHARDS, SEED = 1.5, 2.0, 1024, 1 << 20, 4096, 16, 4096, 17


def water_level(total: float, cap: float, weights, above) -> float:
    """The level at which sources of weight w get min(level * w, cap * size) and all get `total` together.

    above(level): for each weight (words of the sources above, their number, number of all sources), where a source is above if
    level * weight > cap * size. Infinite if even that is not enough."""
    level = 0.0
    while True:
        sums = above(level)
        free = sum(w * (n - over) for w, (_, over, n) in zip(weights, sums))
        if not free:
            return float("inf")
        higher = (total - cap * sum(words for words, _, _ in sums)) / free
        if higher <= level:
            return level
        level = higher


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """share * all words by weight; a target above cap * its size stops there, the excess goes to the others by weight."""
    kinds = sorted(set(weights))

    def above(level):
        over = [(s, w) for s, w in zip(sizes, weights) if level * w > cap * s]
        return [(sum(s for s, w in over if w == k), sum(w == k for _, w in over), weights.count(k)) for k in kinds]

    level = water_level(share * sum(sizes), cap, kinds, above)
    return [min(level * w, cap * s) for s, w in zip(sizes, weights)]


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n draws without replacement are good."""
    if not good or not n:
        return 0
    if good + bad < 1_000_000_000:  # what numpy's sampler takes
        return int(rng.hypergeometric(good, bad, n))
    # inversion over 12 deviations around the mode: what lies outside has less than 1e-30
    lo, hi = max(0, n - bad), min(good, n)
    p = good / (good + bad)
    width = int(12 * (n * p * (1 - p) * max(0.0, 1 - n / (good + bad))) ** 0.5) + 12
    mode = int((n + 1) * (good + 1) // (good + bad + 2))
    a, b = max(lo, mode - width), min(hi, mode + width)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def split_quota(quota: int, pools: list[int], seed: int, name: object) -> list[int]:
    """How many of `quota` drawn blocks come from each pool: a splitting tree over the pools; they add up, none above its pool."""
    out, upto = [0] * len(pools), np.concatenate([[0], np.cumsum(np.array(pools, dtype=np.int64))])
    todo = [(0, len(pools), quota)]
    while todo:
        lo, hi, n = todo.pop()
        if not n:
            continue
        if hi - lo == 1:
            out[lo] = n
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{name}:{lo}:{hi}".encode()).digest()[:8], "little"))
        left = hypergeometric(int(upto[mid] - upto[lo]), int(upto[hi] - upto[mid]), n, rng)
        todo += [(lo, mid, left), (mid, hi, n - left)]
    return out


def _sources(rows: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """sid, source_name, source_size, target, quota, epochs, rest, buckets: one row for each source."""
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = numbered(sized, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], "sid", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    src = materialise(src.withColumn("weight", weight), "mix-weights")

    kinds = sorted(set(map(float, weights)))

    def above(level: float):
        over = level * F.col("weight") > cap * F.col("source_size")
        got = {r["weight"]: r for r in src.groupBy("weight").agg(F.sum(F.when(over, F.col("source_size")).otherwise(0).cast("decimal(38,0)")).alias("words"), F.count_if(over).alias("over"), F.count(F.lit(1)).alias("n")).collect()}
        return [(int(got[k]["words"]), got[k]["over"], got[k]["n"]) if k in got else (0, 0, 0) for k in kinds]

    total = int(src.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    level = water_level(share * total, cap, kinds, above)
    most = cap * F.col("source_size")
    src = src.withColumn("target", F.least(F.lit(level) * F.col("weight"), most) if level < float("inf") else most.cast("double"))
    src = src.withColumn("quota", F.least(F.round("target"), F.floor(most)).cast("long"))
    some = F.greatest("source_size", F.lit(1))
    return src.select(F.col("sid").cast("long"), F.col("source").alias("source_name"), "source_size", "target", "quota", F.expr("quota div greatest(source_size, 1)").alias("epochs"), (F.col("quota") % some).alias("rest"), F.ceil(some / F.lit(BUCKET_WORDS)).alias("buckets"))


def _copies(rows: DataFrame) -> DataFrame:
    """rows with `copy`: 0, 1, ... among rows of one hash (repeated rows), so that these are dealt apart."""
    many = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    again = rows.select("rid", "h").join(many, "h", "left_semi")
    again = again.select(F.col("rid").alias("__rid"), (F.row_number().over(Window.partitionBy("h").orderBy("rid")) - 1).alias("__copy"))
    return rows.join(again, F.col("rid") == F.col("__rid"), "left").withColumn("copy", F.coalesce("__copy", F.lit(0))).drop("__rid", "__copy")


def _sharded(src: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """sid, shard, draw, words, before: drawn blocks of each source in each shard."""
    pools = blocks.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("pool")).join(small(src.where("drawn > 0").select("sid", "drawn")), "sid")

    @tidy
    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        got = split_quota(table.column("drawn")[0].as_py(), table.column("pool").to_pylist(), seed, table.column("sid")[0].as_py())
        return pa.Table.from_arrays([table.column("sid"), table.column("shard"), pa.array(got, pa.int64())], ["sid", "shard", "draw"])

    return pools.groupBy("sid").applyInArrow(tree, "sid long, shard int, draw long").where("draw > 0")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int | None = None, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()):
    """(per_doc, pieces): one row per input row with rid, size, source_size, target, taken and `carried`;
    one row per drawn piece of a document with shard, order in the shard, word range and epoch."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col), F.col(source_col).cast("string")).alias("h"), F.struct(*carry).alias("carry") if carry else F.lit(0).alias("carry"),
    ).withColumn("rid", F.monotonically_increasing_id())
    rows = materialise(rows, "mix-rows")
    src = materialise(_sources(rows, weights, share, cap), "mix-src")
    # the rows' side is split where one source is hot
    with_source = lambda df: df.join(small(src.select("sid", "source_name", "source_size", "target", "buckets")), F.col("source").eqNullSafe(F.col("source_name")))

    slim = with_source(_copies(rows.where("size > 0").select("rid", "h", "source", "size"))).withColumn("o", F.xxhash64("h", "copy"))
    slim = slim.withColumn("bucket", F.pmod("o", F.col("buckets")).cast("int"))
    stream = Window.partitionBy("sid", "bucket").orderBy("o", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.select("sid", "bucket", "rid", "o", "size").withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
    placed = materialise(placed.drop("o", "size"), "mix-placed")

    # a bucket's blocks are alike to a word: block i of n begins at words * i div n
    buckets = placed.groupBy("sid", "bucket").agg(F.max("end").alias("words")).withColumn("n", F.ceil(F.col("words") / block))
    buckets = materialise(buckets, "mix-buckets")
    per = buckets.groupBy("sid").agg(F.sum("n").alias("blocks"), F.min(F.expr("words div n")).alias("least"))
    drawn = F.least("blocks", F.ceil(F.col("rest") / F.col("least")))  # enough blocks for the rest, whichever they are
    src2 = materialise(src.join(small(per), "sid").select("sid", "epochs", "rest", drawn.cast("long").alias("drawn")), "mix-quota")
    if shards is None:
        shards = min(MAX_SHARDS, max(LEAST_SHARDS, (buckets.agg(F.sum("n")).first()[0] or 0) // SHARD_BLOCKS))
    blocks = buckets.repartition("sid", "bucket").select("sid", "bucket", "words", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    at = lambda i: F.expr(f"(words * ({i})) div n")
    key = lambda salt: F.xxhash64(F.lit(seed + salt), "sid", "bucket", "block")
    blocks = blocks.select("sid", "bucket", "block", at("block").alias("at"), (at("block + 1") - at("block")).alias("len"), F.pmod(key(1), F.lit(shards)).cast("int").alias("shard"), key(2).alias("p"))

    quotas = materialise(_sharded(src2, blocks, seed), "mix-tree")
    mine = blocks.join(quotas, ["sid", "shard"])
    permuted = Window.partitionBy("sid", "shard").orderBy("p", "bucket", "block")
    mine = mine.withColumn("rank", F.row_number().over(permuted)).where("rank <= draw").withColumn("upto", F.sum("len").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    mine = materialise(mine.select("sid", "shard", "bucket", "block", "at", "len", "upto"), "mix-drawn")
    in_shard = mine.groupBy("sid", "shard").agg(F.max("upto").alias("words"))
    over = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each shard
    in_shard = in_shard.select("sid", "shard", (F.sum("words").over(over) - F.col("words")).alias("base"), F.sum("words").over(Window.partitionBy("sid")).alias("all")).join(small(src2.select("sid", "rest")), "sid")
    d38 = lambda c: c.cast("decimal(19,0)")
    cut = lambda upto: F.floor(d38(upto) * d38(F.col("rest")) / d38(F.col("all"))).cast("long")
    mine = mine.join(in_shard, ["sid", "shard"]).withColumn("upto", F.col("base") + F.col("upto"))
    mine = mine.select("sid", "shard", "bucket", "block", "at", (cut(F.col("upto")) - cut(F.col("upto") - F.col("len"))).alias("take")).where("take > 0")

    whole = blocks.join(small(src2.where("epochs > 0").select("sid", "epochs")), "sid")
    whole = whole.select("sid", "shard", "bucket", "block", "at", F.col("len").alias("take"), F.explode(F.sequence(F.lit(1).cast("long"), "epochs")).alias("epoch"))
    slots = whole.unionByName(mine.withColumn("epoch", F.lit(0).cast("long")))
    slots = slots.withColumn("order", F.xxhash64(F.lit(seed + 3), "shard", "sid", "bucket", "block", "epoch"))

    # block i holds word x if i = ((x + 1) * n - 1) div words
    cover = placed.join(buckets, ["sid", "bucket"]).withColumn("block", F.explode(F.sequence(F.expr("((start + 1) * n - 1) div words"), F.expr("(end * n - 1) div words"))))
    pieces = cover.select("sid", "bucket", "block", "rid", "start", "end").join(slots, ["sid", "bucket", "block"])
    pieces = pieces.withColumn("from", F.greatest("start", "at")).withColumn("to", F.least("end", F.col("at") + F.col("take"))).where(F.col("to") > F.col("from"))
    pieces = pieces.select("rid", "shard", "order", "epoch", (F.col("from") - F.col("start")).alias("word_from"), (F.col("to") - F.col("start")).alias("word_to"))
    pieces = materialise(pieces, "mix-pieces")
    discard(mine, quotas, placed)
    taken = pieces.groupBy("rid").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    per_doc = with_source(rows).join(taken, "rid", "left").select("rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("carry").alias("carried"))
    return per_doc, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of the input's columns: one for each document and epoch, cut to the words drawn, in the shard and
    place of its first piece: partitions hold shards, and each is in its shuffled order."""
    per_doc, pieces = mix(docs, carry=tuple(docs.columns), **options)
    text = options.get("text_col", "text")
    piece = F.struct("word_from", "word_to", "shard", "order")
    drawn = pieces.groupBy(F.col("rid").alias("__rid"), "epoch").agg(F.array_sort(F.collect_list(piece)).alias("__p"), F.sum(F.col("word_to") - F.col("word_from")).alias("__n"))
    rows = per_doc.select(F.col("rid").alias("__rid"), F.col("size").alias("__size"), "carried").join(drawn, "__rid")
    words = words_of(F.col("carried")[text])
    cut = F.array_join(F.flatten(F.transform("__p", lambda p: F.slice(F.col("__w"), p["word_from"].cast("int") + 1, (p["word_to"] - p["word_from"]).cast("int")))), " ")
    rows = rows.withColumn("__w", F.when(F.col("__n") < F.col("__size"), words))
    new: Column = F.when(F.col("__n") < F.col("__size"), cut).otherwise(F.col("carried")[text])
    first = F.col("__p")[0]
    out = rows.select(first["shard"].alias("__shard"), first["order"].alias("__order"), F.struct(*[(new if c == text else F.col("carried")[c]).alias(c) for c in docs.columns]).alias("__row"))
    return out.repartition("__shard").sortWithinPartitions("__shard", "__order").select("__row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc, pieces = mix(read(spark, sf_dir, "documents"))
    piece = F.struct("shard", "order", "epoch", "word_from", "word_to")
    where = pieces.groupBy(F.col("rid").alias("r")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return per_doc.join(where, F.col("rid") == F.col("r"), "left").select("doc_id", "size", "source_size", "target", "taken", "pieces")
