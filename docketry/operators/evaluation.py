"""Evaluation: calibration, risk and coverage, precision and recall, curves, ablation and weight search.

Running totals over a whole table go through `ranked`: range-partitioned sort, one row per partition for
the offsets, so no window gathers all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import registry as R
from ..functions import text as T
from . import dedup
from .dedup import checkpoint_folder  # noqa: F401


def ranked(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """df with `rn` (1-based place in the order) and a running total for each of `sums`, and `n` (all rows)."""
    sums = sums or {}
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumn("__o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    named = named.select("*", *[c.cast("double").alias(f"__s_{k}") for k, c in sums.items()])
    dealt = named.repartitionByRange(parts, "__o").withColumn("__p", F.spark_partition_id())
    inside = Window.partitionBy("__p").orderBy("__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.select("*", F.row_number().over(Window.partitionBy("__p").orderBy("__o")).alias("__i"), *[F.sum(f"__s_{k}").over(inside).alias(f"__r_{k}") for k in sums])
    dedup.checkpoint_folder(df)
    placed = placed.checkpoint()
    offsets = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("c"), *[F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = offsets.select("__p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__c"), F.sum("c").over(Window.partitionBy()).alias("n"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0.0)).alias(f"__b_{k}") for k in sums])
    out = placed.join(F.broadcast(offsets), "__p")
    return out.select(*df.columns, (F.col("__c") + F.col("__i")).alias("rn"), "n", *[(F.col(f"__b_{k}") + F.col(f"__r_{k}")).alias(k) for k in sums])


def reliability(df: DataFrame, conf: str, ok: str, bins: int = 10) -> DataFrame:
    """bin, low, high, n, mean_confidence, accuracy, gap (rounded to 4 places) for each bin, empty ones too."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    agg = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("mean_confidence"), F.avg(F.col(ok).cast("double")).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(agg, "bin", "left")
    return out.select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy", F.round(F.abs(F.col("mean_confidence") - F.col("accuracy")), 4).alias("gap"))


def calibration_errors(df: DataFrame, conf: str, ok: str, bins: int = 10) -> DataFrame:
    """ece (expected calibration error, from rounded gaps) and squared_error (mean squared confidence error)."""
    ece = reliability(df, conf, ok, bins).agg((F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))) / F.sum("n")).alias("ece"))
    sq = df.agg(F.avg(F.pow(F.col(conf) - F.col(ok).cast("double"), 2)).alias("squared_error"), F.count(F.lit(1)).alias("n"))
    return ece.crossJoin(sq)


def risk_coverage(df: DataFrame, conf: str, ok: str, id_col: str, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 1.0)) -> DataFrame:
    """coverage, taken, accuracy, threshold of the most confident share of rows."""
    r = ranked(df.select(conf, ok, id_col), [-F.col(conf), F.col(id_col)], {"hits": F.col(ok)})
    level = F.explode(F.array(*[F.lit(x) for x in levels]))
    return r.withColumn("coverage", level).where(F.col("rn") == F.greatest(F.floor(F.col("n") * F.col("coverage")), F.lit(1))).select("coverage", F.col("rn").alias("taken"), (F.col("hits") / F.col("rn")).alias("accuracy"), F.col(conf).alias("threshold"))


def threshold_for(df: DataFrame, conf: str, ok: str, id_col: str, target: float, least: float = 0.05) -> DataFrame:
    """The last prefix by confidence with at least the target accuracy and the least coverage."""
    r = ranked(df.select(conf, ok, id_col), [-F.col(conf), F.col(id_col)], {"hits": F.col(ok)})
    good = r.where((F.col("hits") / F.col("rn") >= target) & (F.col("rn") / F.col("n") >= least))
    return good.agg(F.max(F.struct("rn", "n", "hits", F.col(conf).alias("c"))).alias("x")).select(F.col("x.c").alias("threshold"), (F.col("x.rn") / F.col("x.n")).alias("coverage"), (F.col("x.hits") / F.col("x.rn")).alias("accuracy"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def grouped_prf(df: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Precision, recall and F1 over all rows, by the first key, and by the first with each other key."""
    rows = df.select(*keys, (predicted & actual).cast("long").alias("tp"), (predicted & ~actual).cast("long").alias("fp"), (~predicted & actual).cast("long").alias("fn"))
    sets = [[], [keys[0]], *[[keys[0], k] for k in keys[1:]]]
    out = rows.groupingSets(sets, *keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", "tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def canonical(field: Column, value: Column) -> Column:
    """The form of a field's value that is compared: amounts to two places, dates as they are, ids and vendor names normalised."""
    vendor = F.when(value.startswith("V") & (F.length(value) == 4), value).otherwise(T.norm_vendor(value))
    out = F.when(field == "vendor", vendor).when(field.isin("gstin", "invoice_no"), F.nullif(T.norm_invoice_no(value), F.lit(""))).when(field == "date", value).otherwise(value.try_cast(T.MONEY).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) != "", out)


def judged_fields(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Each field of each receipt that has truth: truth's columns, said, correct, lenient, error. found: receipt_id, field, value;
    truth: receipt_id, field, truth and more. A tax that is truly zero is not judged."""
    rows = truth.join(found.select("receipt_id", "field", F.col("value").alias("said")), ["receipt_id", "field"], "left")
    rows = T.barrier(rows.withColumns({"t": canonical(F.col("field"), F.col("truth")), "p": canonical(F.col("field"), F.col("said"))}))
    rows = rows.where(~(F.col("field").isin("cgst", "sgst", "igst") & F.coalesce(F.col("t") == "0.00", F.lit(False))))
    near = fuzzy.token_set(F.when(F.col("field") == "vendor", F.col("p")), F.when(F.col("field") == "vendor", F.col("t"))) >= 90
    error = F.when(F.col("t").isNull() & F.col("p").isNotNull(), "SPURIOUS").when(F.col("t").isNotNull() & F.col("p").isNull(), "MISSED").when(F.col("t") != F.col("p"), "WRONG_VALUE")
    correct = F.coalesce(F.col("t") == F.col("p"), F.lit(False))
    return rows.select(*truth.columns, "said", correct.alias("correct"), (correct | F.coalesce(near, F.lit(False))).alias("lenient"), error.alias("error"), F.col("t").isNotNull().alias("known"), F.col("p").isNotNull().alias("extracted"))


def extraction_report(judged: DataFrame) -> DataFrame:
    """Precision, recall, F1 and lenient accuracy by field, by field and tier, and by field and template."""
    rows = judged.where("known").select("field", "tier", "template", F.col("extracted").cast("long").alias("e"), F.col("correct").cast("long").alias("c"), F.col("lenient").cast("long").alias("l"))
    g = rows.groupingSets([["field"], ["field", "tier"], ["field", "template"]], "field", "tier", "template").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("extracted"), F.sum("c").alias("correct"), F.sum("l").alias("lenient"))
    p, r = F.when(F.col("extracted") > 0, F.col("correct") / F.col("extracted")).otherwise(0.0), F.col("correct") / F.col("n")
    return g.select("field", "tier", "template", "n", "extracted", "correct", "lenient", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def extraction_errors(judged: DataFrame) -> DataFrame:
    """Rows that are MISSED, WRONG_VALUE or SPURIOUS."""
    return judged.where("error IS NOT NULL")


def band_prf(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 at EXACT, HIGH, MEDIUM and LOW or better, against true pairs."""
    both = pairs.select("a", "b", dedup.band_rank(F.col("band")).alias("rank")).join(truth.select("a", "b").distinct().withColumn("is_true", F.lit(True)), ["a", "b"], "full_outer")
    ranks = {b: i + 1 for i, b in enumerate(R.BAND_ORDER)}
    x = both.withColumn("at", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(ranks[b]).alias("r")) for b, _ in R.BANDS])))
    said, true = F.coalesce(F.col("rank") >= F.col("at.r"), F.lit(False)), F.coalesce("is_true", F.lit(False))
    agg = x.groupBy("at.band").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    return agg.select("band", "tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def recall_by_type(pairs: DataFrame, truth: DataFrame, least: str = "MEDIUM") -> DataFrame:
    rank = R.BAND_ORDER.index(least) + 1
    hit = pairs.where(dedup.band_rank(F.col("band")) >= rank).select("a", "b", F.lit(1).alias("hit"))
    return truth.join(hit, ["a", "b"], "left").groupBy("dup_type").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found")).select("dup_type", "n", "found", (F.col("found") / F.col("n")).alias("recall"))


def precision_curve(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """rn, score, precision, recall at every rank by score (ties by a, b)."""
    t = truth.select("a", "b").distinct().withColumn("hit", F.lit(1.0))
    rows = pairs.select("a", "b", "score").join(t, ["a", "b"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    r = ranked(rows, [-F.col("score"), F.col("a"), F.col("b")], {"tp": F.col("hit")})
    n = truth.select("a", "b").distinct().agg(F.count(F.lit(1)).alias("positives"))
    return r.crossJoin(F.broadcast(n)).select("rn", "n", "a", "b", "score", "hit", "positives", (F.col("tp") / F.col("rn")).alias("precision"), (F.col("tp") / F.greatest("positives", F.lit(1))).alias("recall"))


def sampled_curve(curve: DataFrame, points: int = 20) -> DataFrame:
    i = F.col("rn") - 1
    return curve.where((i % F.greatest(F.floor(F.col("n") / points), F.lit(1)) == 0) | (F.col("rn") == F.col("n"))).select("rn", "score", "precision", "recall")


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.col("precision") * F.col("hit")) / F.greatest(F.max("positives"), F.lit(1))).alias("average_precision"))


def workload(pairs: DataFrame, truth: DataFrame, n_claims: int, k: int = 50) -> DataFrame:
    """Pairs per 1000 claims at MEDIUM or better, and precision among the k best."""
    medium = pairs.agg(F.count_if(dedup.band_rank(F.col("band")) >= 3).alias("medium"), (F.count_if(dedup.band_rank(F.col("band")) >= 3) * 1000 / F.lit(max(n_claims, 1))).alias("per_1000"))
    top = precision_curve(pairs, truth).where(F.col("rn") == F.least("n", F.lit(k))).agg(F.max("precision").alias("precision_at_k"))
    return medium.crossJoin(top)


def weight_vectors(spark, samples: int = 200, seed: int = 7) -> DataFrame:
    """vec, weights: the standing weights as 0, then random points of the simplex (normalised exponentials of hashes)."""
    names = list(R.SIGNAL_WEIGHTS)
    raw = [-F.log((F.abs(F.xxhash64(F.lit(seed), F.lit(n), "id")) % 1_000_003 + 1) / 1_000_004) for n in names]
    total = sum(raw, F.lit(0.0))
    drawn = F.create_map(*[x for n, r in zip(names, raw) for x in (F.lit(n), r / total)])
    fixed = F.create_map(*[F.lit(x) for kv in R.SIGNAL_WEIGHTS.items() for x in kv])
    return spark.range(samples + 1).select(F.col("id").alias("vec"), F.when(F.col("id") == 0, fixed).otherwise(drawn).alias("weights"))


def ablation_vectors(spark) -> DataFrame:
    """All signals, then one left out at a time."""
    rows = [(0, "", dict(R.SIGNAL_WEIGHTS))] + [(i + 1, n, {k: 0.0 if k == n else w for k, w in R.SIGNAL_WEIGHTS.items()}) for i, n in enumerate(R.SIGNAL_WEIGHTS)]
    return spark.createDataFrame(rows, "vec long, without string, weights map<string,double>")


def f1_by_weights(signals: DataFrame, truth: DataFrame, vectors: DataFrame, threshold: float = 0.78) -> DataFrame:
    """F1 at HIGH for each weight vector; signals: a, b, signals map, cross (two employees). One pass over pairs."""
    t = truth.select("a", "b").distinct()
    n_true = t.agg(F.count(F.lit(1)).alias("n_true"))
    names = list(R.SIGNAL_WEIGHTS)
    keys = [c for c in vectors.columns if c != "weights"]
    rows = signals.join(t.withColumn("hit", F.lit(True)), ["a", "b"], "left")
    # pairs alike in all signals count together
    rows = rows.groupBy(*[F.col("signals")[n].alias(f"s_{n}") for n in names], "cross", "hit").agg(F.count(F.lit(1)).alias("pairs"))
    rows = rows.crossJoin(F.broadcast(vectors.select(*keys, *[F.col("weights")[n].alias(f"w_{n}") for n in names])))  # a few hundred vectors
    num = sum((F.coalesce(F.col(f"s_{n}") * F.col(f"w_{n}"), F.lit(0.0)) for n in names), F.lit(0.0))
    den = sum((F.when(F.col(f"s_{n}").isNotNull(), F.col(f"w_{n}")).otherwise(0.0) for n in names), F.lit(0.0))
    score = F.round(F.when(den > 0, num / den).otherwise(0.0) * F.when(F.col("cross"), R.CROSS_EMPLOYEE).otherwise(1.0), 4)
    count = lambda c: F.sum(F.when((score >= threshold) & c, F.col("pairs")).otherwise(0))
    agg = rows.groupBy(*keys).agg(count(F.col("hit").isNotNull()).alias("tp"), count(F.col("hit").isNull()).alias("fp"))
    agg = agg.crossJoin(n_true)
    return agg.select(*keys, "tp", "fp", (F.col("n_true") - F.col("tp")).alias("fn"), *_prf(F.col("tp"), F.col("fp"), F.col("n_true") - F.col("tp")))


def best_weights(scores: DataFrame) -> DataFrame:
    """The vector of the highest F1, the earliest among equals."""
    return scores.agg(F.max_by("vec", F.struct("f1", -F.col("vec"))).alias("vec"), F.max("f1").alias("f1"))


def tuned_weights(signals: DataFrame, truth: DataFrame, claims: DataFrame, vectors: DataFrame, dev: float = 0.6) -> DataFrame:
    """One row: the vector of the highest F1 on a share `dev` of the claims (by a hash of the id), its F1 there and on the others,
    and those of the standing weights (vector 0). Pairs with an end on either side belong to neither."""
    side = ranked(claims.select("claim_id"), [F.xxhash64(F.lit(5), "claim_id"), F.col("claim_id")]).select("claim_id", (F.col("rn") <= F.floor(F.col("n") * dev)).alias("dev"))
    side, signals = dedup.settled(side), dedup.settled(signals)  # both shares read them

    def scores(part: bool) -> DataFrame:
        ids = side.where(F.col("dev") == F.lit(part)).select("claim_id")
        inside = lambda df: df.join(ids.withColumnRenamed("claim_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("claim_id", "b"), "b", "left_semi")
        return f1_by_weights(inside(signals), inside(truth), vectors)

    seen, unseen = dedup.settled(scores(True)), dedup.settled(scores(False))
    first = lambda df, name: df.where("vec = 0").select(F.col("f1").alias(name))
    best = best_weights(seen).select("vec", F.col("f1").alias("dev_f1"))
    out = best.join(unseen.select("vec", F.col("f1").alias("test_f1")), "vec")
    return out.crossJoin(first(seen, "dev_f1_default")).crossJoin(first(unseen, "test_f1_default"))  # one row each
