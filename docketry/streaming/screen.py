"""Streaming forms of the incremental screen, gaming windows and workflow (extensions: the batch forms define the results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup


def screen_new_claims(stream: DataFrame, existing_path: str, flags_path: str, checkpoint: str, fuzzy_match: bool = False):
    """Each micro-batch of claims is screened against the stored ones and itself, then stored."""

    def batch(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        new = new.dropDuplicates(["claim_id"])
        old = spark.read.schema(new.schema).parquet(existing_path)
        old = old.join(new.select("claim_id"), "claim_id", "left_anti").select(new.columns)
        found = dedup.find_duplicates_for(new, old.unionByName(new), fuzzy_match=fuzzy_match)
        # a replayed batch overwrites its own flags and adds no claim twice
        found.write.mode("overwrite").parquet(f"{flags_path}/batch={batch_id}")
        new.write.mode("overwrite").parquet(f"{existing_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gaming_windows(stream: DataFrame, limit: float, delay: str = "14 days") -> DataFrame:
    """Employees with three or more claims just under a limit in a sliding week; late rows up to `delay`."""
    near = stream.withWatermark("at", delay).where((F.col("total") >= limit * 0.85) & (F.col("total") < limit))
    return near.groupBy("employee_id", F.window("at", "7 days", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("claim_id").alias("claims")).where("n >= 3")


def split_windows(stream: DataFrame, delay: str = "4 days") -> DataFrame:
    """Claims of one employee on one vendor in two-day windows, three or more."""
    return stream.withWatermark("at", delay).groupBy("employee_id", "vendor_canonical", F.window("at", "2 days")).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total")).where("n >= 3")
