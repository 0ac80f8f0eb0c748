"""What the corpus operators share: word splitting, shared storage, and corpus size."""

from __future__ import annotations

import ctypes
import gc
import inspect
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_REGEX = r"[ \t\n\x0B\f\r]+"


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(text_of(text), WS_REGEX), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master only, a temporary one where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="docketry-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def _on_disk(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/docketry-{tag}-{uuid.uuid4().hex}"
    fs, at = _on_disk(spark, path)
    fs.deleteOnExit(at)
    return path


#: Rows of text travel through these: row groups small enough for two writers in a small heap.
ROW_GROUP = 32 << 20


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends at replicated files."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.docketry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "docketry_path", None):
            fs, at = _on_disk(df.sparkSession, path)
            fs.delete(at, True)


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers stay for later tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def tidy(f):
    """f (a function of one or two tables, or a generator function of batches), giving memory back when it is done."""
    if inspect.isgeneratorfunction(f):

        def each(batches):
            yield from f(batches)
            give_back()

        return each

    def one(table):
        out = f(table)
        give_back()
        return out

    def two(left, right):
        out = f(left, right)
        give_back()
        return out

    return one if len(inspect.signature(f).parameters) == 1 else two


#: Rows of a side that is broadcast after a count of it; a larger one is shuffled.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as the broadcast side of a join where it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """df, written, with the place of each row in an order (0, 1, ...): sorted ranges, and an offset for each range."""
    placed = df.withColumn("__o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, "__o").withColumn("__p", F.spark_partition_id())
    placed = materialise(placed.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy("__o")).cast("long") - 1).drop("__o"), tag)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return placed.join(F.broadcast(base.select("__p", "__b")), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__b", "__i")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs that nothing refers to any more (its cleaner works on its own thread)."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
