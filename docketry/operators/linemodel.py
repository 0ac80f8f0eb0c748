"""Line roles: character n-gram TF-IDF and shape features into a multinomial logistic regression (pyspark.ml).

Scale: training is distributed, over all lines, whose features are made in Arrow batches; the vocabulary is bounded by `vocabulary` terms. A trained model is applied to Arrow batches by
`lineweights`, whose scores are those of the pipeline's own transform; receipts are made once and read twice.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import lineweights
from .dedup import checkpoint_folder, settled
from .lineweights import LineWeights

#: Receipts of a task of the training.
RECEIPTS = 5_000


def featured(lines: DataFrame) -> DataFrame:
    """lines: receipt_id, line_no, text, n (lines of the receipt); adds grams and shape."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.flatten(F.array(*[_grams(F.concat(F.lit(" "), w, F.lit(" ")), k) for k in (3, 4, 5)]))))
    return lines.withColumn("grams", grams).withColumn("shape", array_to_vector(T.shape_features(F.col("text"), F.col("line_no"), F.col("n"))))


def _grams(w: Column, k: int) -> Column:
    n = F.length(w) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def train(lines: DataFrame, vocabulary: int = 30_000, c: float = 4.0, rounds: int = 30) -> PipelineModel:
    n = lines.count()
    stages = [
        StringIndexer(inputCol="role", outputCol="label", stringOrderType="alphabetAsc"), CountVectorizer(inputCol="grams", outputCol="tf", minDF=2, vocabSize=vocabulary), IDF(inputCol="tf", outputCol="tfidf"),
        VectorAssembler(inputCols=["tfidf", "shape"], outputCol="features"), LogisticRegression(regParam=1 / (c * max(n, 1)), standardization=False, maxIter=rounds, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(features(lines))


def features(lines: DataFrame) -> DataFrame:
    """role, grams and shape as featured() has them, made from Arrow batches."""
    made = seen(lines, "role", F.col("line_no").alias("at")).mapInArrow(lineweights.features, "role string, grams array<string>, shape array<double>")
    return made.withColumn("shape", array_to_vector("shape"))


def load(path: str) -> PipelineModel | None:
    """A stored model; None where there is nothing at the path (scores then stay neutral)."""
    spark = SparkSession.getActiveSession()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return PipelineModel.load(path) if found else None


def predict(model: PipelineModel | None, lines: DataFrame) -> DataFrame:
    """receipt_id, line_no, role probabilities as a map; null without a model."""
    if model is None:
        return lines.select("receipt_id", "line_no", F.lit(None).cast("map<string,double>").alias("roles"))
    kind = lines.schema["receipt_id"].dataType.simpleString()
    no = lines.schema["line_no"].dataType.simpleString()
    return seen(lines, "receipt_id", "line_no", F.col("line_no").alias("at")).mapInArrow(weights(model).roles, f"receipt_id {kind}, line_no {no}, roles map<string,double>")


def seen(lines: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, and what `lineweights` reads of each line: text, at (its place) and n, and of a line with characters beyond
    ASCII and ₹€£ its lower case `low` and its `shape` without the place, as featured() has them."""
    text = F.coalesce("text", F.lit(""))
    beyond_ascii = lambda c: F.octet_length(c) != F.length(c)
    odd = beyond_ascii(text) & beyond_ascii(F.translate(text, "₹€£", ""))
    shape = F.slice(T.shape_features(text, F.lit(0), F.lit(1)), 2, 7)
    return lines.select(*columns, text.alias("text"), F.col("n").cast("long").alias("n"), F.when(odd, F.lower(text)).alias("low"), F.when(odd, shape).alias("shape"))


def weights(model: PipelineModel) -> LineWeights:
    index, counts, idf, _, regression = model.stages
    slopes = regression.coefficientMatrix.toArray()
    n = len(counts.vocabulary)
    return LineWeights(list(index.labels), list(counts.vocabulary), (slopes[:, :n] * idf.idf.toArray()).T, slopes[:, n:].T, np.array(regression.interceptVector.toArray()))


def lines_of(receipts: DataFrame) -> DataFrame:
    """receipt_id, n, line_no, text of each line of receipts (receipt_id, text)."""
    r = receipts.withColumn("lines", F.split("text", "\n"))
    return r.select("receipt_id", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "text"))


def labelled_lines(receipts: DataFrame) -> DataFrame:
    return labelled(lines_of(receipts))


def labelled(lines: DataFrame) -> DataFrame:
    role = F.when(F.col("line_no") == 0, "VENDOR").when(F.col("line_no") == 1, "ADDRESS").when(F.col("text").startswith("GSTIN"), "GSTIN").when(F.col("text").startswith("Invoice No"), "INVOICE").when(F.col("text").startswith("Date"), "DATE")
    role = role.when(F.col("text").startswith("Item"), "ITEM").when(F.col("text").startswith("Sub Total"), "SUBTOTAL").when(F.col("text").startswith("CGST") | F.col("text").startswith("SGST"), "TAX").when(F.col("text").startswith("Grand"), "TOTAL").when(F.col("text").startswith("Thank"), "FOOTER").otherwise("OTHER")
    return lines.withColumn("role", role)


def trained(receipts: DataFrame, bound: int | None = None) -> tuple[PipelineModel, DataFrame]:
    """A model of all lines, and all lines with roles. bound: of at most so many lines (the least by hash) for a trial."""
    receipts = stored(receipts.select("receipt_id", "text"))
    lines = lines_of(receipts)
    if bound is None:
        # Parquet packs many receipts into few tasks, and each pass of the training takes long over a line
        parts = max(receipts.sparkSession.sparkContext.defaultParallelism, -(-receipts.count() // RECEIPTS))
        return train(labelled(lines_of(receipts.repartition(parts)))), labelled(lines)
    by = lambda line_no: F.xxhash64("receipt_id", line_no)
    # each receipt has a first line, so no line of the sample hashes beyond the bound-th first line
    last = receipts.where("text IS NOT NULL").select(by(F.lit(0)).alias("h")).orderBy("h").limit(bound).agg(F.max("h"), F.count("h")).first()
    near = lines.where(by(F.col("line_no")) <= F.lit(last[0])) if last[1] == bound else lines
    sample = settled(labelled(near.orderBy(by(F.col("line_no"))).limit(bound)))
    return train(sample), labelled(lines)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder as Parquet and read back."""
    checkpoint_folder(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/receipts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def confusion(model: PipelineModel, lines: DataFrame) -> DataFrame:
    return seen(lines, "role", F.col("line_no").alias("at")).mapInArrow(weights(model).counts, "role string, said string, n long").groupBy("role", "said").agg(F.sum("n").alias("n"))
