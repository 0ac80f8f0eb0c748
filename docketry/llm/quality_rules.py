"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is built-in column expressions; a document is one row from end to end, so nothing shuffles.
Repeated 8-word windows are found per document from 64-bit window hashes (a chance clash inside one
document of w words has probability about w*w / 2**65); only documents in which some hash repeats go
on to the sort that locates the words.

Defined results: null text is an empty text (0 words, fails the base rule); rows repeat as they come
in; columns other than the two named are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_REGEX, read, text_of, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in a is that it on for was with be as are by this at from "
    "de la en un le que des et les el der die und den von das ist nicht mit "
    "los del las por con para est pour dans une qui au se"
).split()


@dataclass(frozen=True)
class Threshold:
    """A document passes where low <= metric <= high; None is an open end."""

    rule: str
    metric: str
    low: float | None
    high: float | None


#: Loose bounds: ordinary prose in any of the languages lies well inside each.
THRESHOLDS = (
    Threshold("mean_word_length", "mean_word_length", 2.5, 12.0),
    Threshold("symbol_ratio", "symbol_ratio", None, 0.25),
    Threshold("exclamation_ratio", "exclamation_ratio", None, 0.5),
    Threshold("stop_word_ratio", "stop_word_ratio", 0.04, None),
    Threshold("duplicate_line_ratio", "duplicate_line_ratio", None, 0.5),
    Threshold("lines_per_word", "lines_per_word", None, 0.75),
)

_METRICS = {
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "exclamation_ratio": "__bangs / greatest(n_words, 1)",
    "stop_word_ratio": "__stops / greatest(n_words, 1)",
    "duplicate_line_ratio": "n_dup_lines / greatest(__lines, 1)",
    "lines_per_word": "__lines / greatest(n_words, 1)",
    "n_words": "n_words",
}


def compile_thresholds(table) -> dict[str, Column]:
    """The threshold table as boolean columns, one for each rule."""
    out = {}
    for t in table:
        metric = F.expr(_METRICS[t.metric])
        passes = F.lit(True)
        if t.low is not None:
            passes = passes & (metric >= F.lit(float(t.low)))
        if t.high is not None:
            passes = passes & (metric <= F.lit(float(t.high)))
        out[t.rule] = passes
    return out


def _window_hashes(df: DataFrame) -> DataFrame:
    """__h8: a hash for each window of 8 words, doubled up from 1 to 2 to 4 to 8."""
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    for have, step in ((1, 1), (2, 2), (4, 4)):
        src, dst = ("__h" if have == 1 else f"__h{have}"), f"__h{2 * have}"
        n = F.greatest(F.size(src) - step, F.lit(0))
        df = df.withColumn(dst, F.zip_with(F.slice(src, 1, n), F.slice(src, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)))
    return df


def _repeat_words(df: DataFrame) -> DataFrame:
    df = _window_hashes(df)
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h8")) < F.size("__h8"), F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("__s") - 1
    df = df.withColumn("__eq", F.when(F.col("__s").isNotNull(), F.zip_with(F.slice("__s", 1, n), F.slice("__s", 2, n), lambda a, b: a["h"] == b["h"])))
    hit = lambda i: F.coalesce(F.get("__eq", i), F.lit(False))
    df = df.withColumn("__at", F.when(F.col("__s").isNotNull(), F.sort_array(F.filter(F.transform("__s", lambda x, i: F.when(hit(i) | hit(i - 1), x["i"])), lambda x: x.isNotNull()))))
    m = F.greatest(F.size("__at") - 1, F.lit(0))
    steps = F.zip_with(F.slice("__at", 1, m), F.slice("__at", 2, m), lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x) + WINDOW
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("__at") > 0, covered), F.lit(0)).cast("long"))


def quality_rules(docs: DataFrame, table=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: counts, base_failed, kept and `failed` (the rules that it breaks).

    `keep` names further input columns to carry.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("__t"), F.struct(*keep).alias("__keep") if keep else F.lit(None).alias("__keep"))
    df = df.withColumn("__w", words_of(F.col("__t")))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0))
    df = _repeat_words(df)
    bare = F.array_remove(F.split(F.lower("__t"), r"[ \t\n\x0B\f\r.,;:!?\"'()#*$%&|<>]+"), "")
    df = df.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.length("__t") - F.length(F.translate("__t", "!", ""))).alias("__bangs"),
        F.size(F.filter(bare, lambda w: w.isin(STOP_WORDS))).alias("__stops"),
        F.size("__l").alias("__lines"),
        "__keep",
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = compile_thresholds(table)
    verdict = F.lit(True)
    for passes in rules.values():
        verdict = verdict & passes
    # the observation keeps later filters above the projection: pushed below, they would copy its nested expressions
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict).alias("kept"),
        F.array_compact(F.array(*[F.when(~p, F.lit(r)) for r, p in rules.items()])).alias("failed"),
        *[F.col("__keep")[c].alias(c) for c in keep],
    ).observe(f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("failed")


def _sql_rules() -> str:
    parts = []
    for t in THRESHOLDS:
        m = _METRICS[t.metric]
        parts += [f"{m} >= {t.low}"] if t.low is not None else []
        parts += [f"{m} <= {t.high}"] if t.high is not None else []
    return " AND ".join(parts)


#: `docs` is any relation with doc_id and text; ids have to be distinct.
SQL_CTES = f"""
q_w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {{docs}}),
q_g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM q_w)),
q_r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM q_g) WHERE c > 1),
q_n AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM q_r GROUP BY doc_id),
q_m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g')) AS __bangs,
    len(list_filter(regexp_split_to_array(lower(t), '[ \\t\\n\\x0B\\f\\r.,;:!?"''()#*$%&|<>]+'), lambda x: x IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}))) AS __stops,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    coalesce(n.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_w w LEFT JOIN q_n n ON w.doc_id IS NOT DISTINCT FROM n.doc_id),
q_c AS (SELECT *, len(ls) AS __lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q_m),
q_k AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed) AND {_sql_rules()} AS kept FROM q_c)
"""
OP5_SQL = "WITH " + SQL_CTES.format(docs="documents") + "SELECT * FROM q_k"
