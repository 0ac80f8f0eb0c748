"""Reading receipts, claims and vendors, and writing results. Paths go to Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CLAIMS = "claim_id string, employee_id string, receipt_id string, submitted_at timestamp, status string, claimed_amount decimal(12,2), category string, decided_at timestamp, duplicate_of string, dup_type string"
TRUTH = (
    "receipt_id string, image_path string, text_path string, vendor_name string, vendor_canonical string, gstin string, invoice_no string, date date, subtotal decimal(12,2), cgst decimal(12,2), "
    "sgst decimal(12,2), igst decimal(12,2), cess decimal(12,2), round_off decimal(12,2), total decimal(12,2), template_id string, noise_tier int, rotation_deg double"
)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLAIMS).csv(path, header=True)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per receipt; of repeated ids the one with the latest position stays: the last file by name, and in it the last row."""
    raw = spark.read.schema(TRUTH).csv(path, header=True)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = raw.select(*raw.columns, place.alias("__at"))
    cols = [c for c in rows.columns if c not in ("receipt_id", "__at")]
    last = rows.groupBy("receipt_id").agg(F.max_by(F.struct(*cols), "__at").alias("x"))
    return last.select("receipt_id", "x.*")


def read_vendors(spark: SparkSession, path: str) -> DataFrame:
    """vendor_canonical, vendor_name, gstin, from either spelling of the column names."""
    raw = spark.read.csv(path, header=True)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None).cast("string"))
    return raw.select(first("vendor_canonical", "canonical_id").alias("vendor_canonical"), first("vendor_name", "name").alias("vendor_name"), F.nullif(first("gstin"), F.lit("")).alias("gstin"))


#: Confidence of characters by how a text came about; `simulated` texts get theirs from generators.degrade.
TEXT_MODES = {"clean": 0.97, "sidecar": 0.95}


def read_texts(spark: SparkSession, path: str, mode: str = "sidecar") -> DataFrame:
    """receipt_id (file name without its ending), text, char_conf of one text file per receipt."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("receipt_id"), F.col("value").alias("text"))
    return raw.withColumn("char_conf", T.constant_confidence(F.col("text"), TEXT_MODES[mode]))


def prefer_sidecar(ids: DataFrame, sidecar: DataFrame, scanned: DataFrame) -> DataFrame:
    """Text of each id: its sidecar, else its scan, else null with the source `missing`."""
    s = sidecar.select("receipt_id", F.col("text").alias("t1"), F.lit("sidecar").alias("s1"))
    o = scanned.select("receipt_id", F.col("text").alias("t2"), F.lit("ocr").alias("s2"))
    return ids.join(s, "receipt_id", "left").join(o, "receipt_id", "left").select("receipt_id", F.coalesce("t1", "t2").alias("text"), F.coalesce("s1", "s2", F.lit("missing")).alias("source"))


def lines_of_words(words: DataFrame) -> DataFrame:
    """receipt_id, text, char_conf from word boxes (receipt_id, block, par, line, word_no, word, conf in 0 to 100)."""
    w = words.where("word IS NOT NULL AND trim(word) <> ''")
    line = w.groupBy("receipt_id", "block", "par", "line").agg(F.array_sort(F.collect_list(F.struct("word_no", "word", "conf"))).alias("ws"))
    text = F.array_join(F.transform("ws", lambda x: x["word"]), " ")
    conf = F.flatten(F.transform("ws", lambda x, i: F.concat(F.when(i > 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")), F.array_repeat(x["conf"] / 100.0, F.length(x["word"])))))
    doc = line.select("receipt_id", "block", "par", "line", text.alias("t"), conf.alias("c")).groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t", "c"))).alias("ls"))
    return doc.select("receipt_id", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("text"), F.flatten(F.transform("ls", lambda x, i: F.concat(F.when(i > 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")), x["c"]))).alias("char_conf"))


def read_uploads(spark: SparkSession, path: str, max_bytes: int = 15 << 20) -> DataFrame:
    """path, kind, ok, reason of uploaded files, by first bytes and size."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 16).alias("head"))
    kind = T.sniff(F.col("head"))
    reason = F.when(kind.isNull(), "unknown type").when(kind == "heic", "heic").when(F.col("length") > max_bytes, "too large")
    return raw.select("path", kind.alias("kind"), reason.isNull().alias("ok"), reason.alias("reason"))


def sample_heads(spark: SparkSession) -> DataFrame:
    """First bytes of each known file kind."""
    heads = [b"%PDF-1.7 padding..", b"\x89PNG\r\n\x1a\n........", b"\xff\xd8\xff\xe0............", b"GIF89a..........", b"BM..............", b"II*\x00............", b"RIFF\x00\x00\x00\x00WEBP....", b"\x00\x00\x00\x18ftypheic...."]
    return spark.createDataFrame([(bytearray(h),) for h in heads], "content binary")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_errors(errors: DataFrame, path: str, cap: int = 400) -> None:
    """The first `cap` errors by receipt and field."""
    write_csv(errors.orderBy("receipt_id", "field").limit(cap), path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def insert_if_absent(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace a table by rows, one for each key: the least by its other columns."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*rows.columns) if rest else rows.distinct()
    one.write.mode("overwrite").parquet(path)


def render_markdown(sections: dict[str, DataFrame], rows: int = 100) -> str:
    """A report of small tables; one of more than `rows` rows says how many it leaves out."""
    out = []
    for title, df in sections.items():
        data = df.limit(rows).collect()
        title += f" (first {rows} of {df.count()} rows)" if len(data) == rows else ""
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(str(v) for v in r) + " |" for r in data], ""]
    return "\n".join(out)
