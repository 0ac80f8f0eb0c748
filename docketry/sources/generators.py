"""Seeded generators: claims with known duplicates, and scanner noise. Every choice is a hash of the row, so
any partitioning gives the same data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.registry import CONFUSIONS

# Noise tier -> error rate, mean confidence, spread.
NOISE = {0: (0.0, 0.97, 0.02), 1: (0.006, 0.92, 0.06), 2: (0.022, 0.82, 0.12), 3: (0.055, 0.68, 0.18)}
# Share of each kind of injected claim, in per mille of the base claims.
MIX = (("PHOTO_REUSE", 60), ("RETYPED", 40), ("SPLIT", 20), ("RESUBMIT_AFTER_REJECT", 20), ("HARD_NEGATIVE", 10))


def pick(n: int, salt: str, *on: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *on), F.lit(n)).cast("int")


def base_claims(spark: SparkSession, n: int, seed: int = 42, employees: int = 25, vendors: int = 20) -> DataFrame:
    s = str(seed)
    r = spark.range(n).withColumn("date", F.date_add(F.lit("2025-01-06").cast("date"), pick(240, s + "d", "id")))
    return r.select(
        F.format_string("C%06d", F.col("id")).alias("claim_id"), F.format_string("E%03d", pick(employees, s + "e", "id") + 1).alias("employee_id"), F.format_string("V%03d", pick(vendors, s + "v", "id") + 1).alias("vendor_canonical"),
        F.concat_ws("-", F.lit("INV"), F.date_format("date", "yyyy"), F.format_string("%05d", F.col("id"))).alias("invoice_no"), "date", ((pick(990_000, s + "t", "id") + 10_000) / 100).cast("decimal(12,2)").alias("total"),
        F.timestamp_add("DAY", 1 + pick(10, s + "s", "id"), F.col("date").cast("timestamp")).alias("submitted_at"), F.element_at(F.array(*[F.lit(x) for x in ("SUBMITTED", "APPROVED", "REJECTED")]), pick(3, s + "st", "id") + 1).alias("status"),
        pick(1000, s + "k", "id").alias("u"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("dup_type"),
    )


def dataset(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Base claims and injected ones: duplicate_of and dup_type say what each is."""
    base = base_claims(spark, n, seed)
    lo, parts = 0, [base]
    for kind, share in MIX:
        src = base.where(F.col("u").between(lo, lo + share - 1))
        lo += share
        new = src.withColumn("duplicate_of", F.col("claim_id")).withColumn("dup_type", F.lit(kind)).withColumn("submitted_at", F.timestamp_add("DAY", F.lit(12), F.col("submitted_at"))).withColumn("status", F.lit("SUBMITTED"))
        if kind == "RETYPED":
            new = new.withColumn("invoice_no", F.concat(F.substring("invoice_no", 1, 9), F.lit("7"), F.substring("invoice_no", 11, 20)))
        if kind == "SPLIT":
            half = F.floor(F.col("total") * 40).cast("decimal(14,0)") / 100
            first, second = half.cast("decimal(12,2)"), (F.col("total") - half.cast("decimal(12,2)")).cast("decimal(12,2)")
            new = new.withColumn("x", F.explode(F.array(F.struct(F.lit("a").alias("s"), first.alias("t")), F.struct(F.lit("b").alias("s"), second.alias("t"))))).withColumn("total", F.col("x.t")).withColumn("invoice_no", F.concat("invoice_no", "x.s"))
            new = new.withColumn("claim_id", F.concat(F.lit("S"), "claim_id", "x.s")).drop("x")
        else:
            new = new.withColumn("claim_id", F.concat(F.lit(kind[0]), "claim_id"))
        if kind == "HARD_NEGATIVE":
            new = new.withColumn("date", F.date_add("date", 9)).withColumn("invoice_no", F.concat("invoice_no", F.lit("9"))).withColumn("total", (F.col("total") * F.lit("1.07").cast("decimal(3,2)")).cast("decimal(12,2)"))
        parts.append(new.select(*base.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("u")


def _noisy(key: str, text: str, tier: int) -> tuple[str, list[float]]:
    rate, mean, spread = NOISE[tier]
    rng = np.random.default_rng(np.frombuffer(key.encode().ljust(8, b"."), dtype=np.uint8))
    normal, chance, digit_rate = rng.standard_normal, rng.random, rate * 0.45
    out, conf = [], []
    for ch in text or "":
        c = mean + spread * normal()
        c = 0.05 if c < 0.05 else 1.0 if c > 1.0 else c
        if not ch.isspace() and chance() < (digit_rate if ch.isdigit() else rate):
            c *= 0.6
            how = rng.integers(4)
            swap = CONFUSIONS.get(ch.upper(), "")
            if how == 0 and swap:
                ch = swap[rng.integers(len(swap))]
            elif how == 1:
                ch = "."
            elif how == 2:
                continue
            else:
                ch *= 2
        out.append(ch)
        conf += [c] * len(ch)
    return "".join(out), conf


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("char_conf", ArrayType(DoubleType()))]))
def _noisy_udf(key: pa.Array, text: pa.Array, tier: pa.Array) -> pa.Array:
    read = [_noisy(k, t, int(n)) for k, t, n in zip(key.to_pylist(), text.to_pylist(), tier.to_pylist())]
    conf = pa.array([c for _, c in read], pa.list_(pa.float64()))
    return pa.StructArray.from_arrays([pa.array([t for t, _ in read], pa.string()), conf], names=["text", "char_conf"])


def degrade(receipts: DataFrame, tier: Column, seed: int = 42) -> DataFrame:
    """receipt_id, text, char_conf as a scanner of a noise tier would read them."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("receipt_id").cast("string"))
    return receipts.select("receipt_id", _noisy_udf(key, F.col("text"), tier).alias("x")).select("receipt_id", "x.text", "x.char_conf")


def retype_vendor(name: Column, salt: Column) -> Column:
    """A vendor name as a hurried hand types it again: a legal form written out or left out, a word less, capitals, two
    letters swapped, or another "and"; the same name where nothing applies."""
    words = F.split(name, " ")
    n = F.size(words)
    word = F.get(words, F.pmod(F.xxhash64(salt, F.lit("w")), n).cast("int"))
    at = F.pmod(F.xxhash64(salt, F.lit("c")), F.greatest(F.length(word) - 1, F.lit(1))).cast("int") + 1
    swapped = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.lit(1)), F.substring(word, at, F.lit(1)), F.substring(word, at + 2, F.lit(10_000)))
    variants = F.array(
        F.when(name.contains(" Pvt Ltd"), F.replace(name, F.lit(" Pvt Ltd"), F.lit(" Private Limited"))), F.when(name.contains(" Pvt Ltd"), F.replace(name, F.lit(" Pvt Ltd"), F.lit(""))),
        F.when(name.contains(" Ltd"), F.replace(name, F.lit(" Ltd"), F.lit(" Limited"))), F.when(n > 1, F.array_join(F.slice(words, F.lit(1), n - 1), " ")), F.when(n > 1, F.upper(name)),
        F.when((n > 1) & (F.length(word) > 3), F.replace(name, word, swapped)), F.replace(name, F.lit(" & "), F.lit(" and ")), F.replace(name, F.lit(" and "), F.lit(" & ")),
    )
    fit = F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (v != "") & (v != name)))
    return F.coalesce(F.get(fit, F.pmod(F.xxhash64(salt, F.lit("v")), F.greatest(F.size(fit), F.lit(1))).cast("int")), name)
