"""Secret scans: patterns find candidates, corpus-wide ownership decides about the added ones.

The text is scanned once; what it yields (a row of match arrays per document) is written to the shared
folder and everything else works on that. Match positions come from the lengths of the gaps that
splitting at the same pattern leaves. Candidate hashes are aggregated by distinct repositories
(documents) and owners (sources) in two combinable steps, so a hash that sits in a third of all rows
reaches the second step as one row per owner. A candidate of many owners is a widely copied example,
one of few owners is live-looking. Base spans (assign, access, hex) always stay; the method adds
provider-shaped tokens and mixed high-entropy runs that are live-looking.

Defined results: null text is empty (no spans); a null owner counts as one owner; repeated rows are
scanned and counted each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read, text_of

#: kind -> (pattern, least length of the value, group of the value); fixed formats, base kinds first.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
    "provider": (r"(?:gh[opsru]_|glpat-|xox[abprs]-|sk_live_|rk_live_)[A-Za-z0-9_-]{16,}", 20, 0),
    "mixed": (r"[A-Za-z0-9+/_-]{32,}", 32, 0),
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
#: Distinct owners from which a value counts as a copied example.
MANY_OWNERS = 5


def _java(kind: str) -> str:
    """A run pattern starts only where no run character stands before: same matches, no rescans of short runs."""
    p = PATTERNS[kind][0]
    return rf"(?<![A-Za-z0-9+/_-]){p}" if kind == "mixed" else p


def _scan(text: Column, kind: str) -> Column:
    """An array of (gap, match): code points between the last match and this one, and the match."""
    p = F.lit(_java(kind))
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, _java(kind)), lambda g: F.length(g))
    return F.when(text.rlike(_java(kind)), F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """rid, doc_id, owner and the raw matches of each kind; written to the shared folder."""
    t = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), text_of(F.col(text_col)).alias("__t"))
    return materialise(t.select("rid", "doc_id", "owner", *[_scan(F.col("__t"), k).alias(k) for k in KINDS]), "secrets")


def spans(scanned: DataFrame) -> DataFrame:
    """One row per candidate: rid, owner, kind_no, kind, start, end, hash."""
    def tagged(no: int):
        return F.transform(KINDS[no], lambda x, i: F.struct(F.lit(no).alias("kind_no"), i.alias("k"), x["g"].alias("g"), x["m"].alias("m")))

    each = F.flatten(F.array_compact(F.array(*[tagged(no) for no in range(len(KINDS))])))
    rows = scanned.select("rid", "owner", F.explode(each).alias("x")).select("rid", "owner", "x.*").withColumn("n", F.length("m"))
    upto = Window.partitionBy("rid", "kind_no").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("g") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    value = F.when(F.col("kind_no") == 0, F.regexp_extract("m", PATTERNS["assign"][0], 2)).otherwise(F.col("m"))
    least = F.element_at(F.array(*[F.lit(PATTERNS[k][1]) for k in KINDS]), F.col("kind_no") + 1)
    mixed = F.col("m").rlike("[a-z]") & F.col("m").rlike("[A-Z]") & F.col("m").rlike("[0-9]")
    rows = rows.withColumn("value", value).where((F.length("value") >= least) & ((F.col("kind_no") != KINDS.index("mixed")) | mixed))
    return rows.select("rid", "owner", "kind_no", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1).alias("kind"), "start", "end", F.sha2("value", 256).alias("hash"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners over the whole corpus."""
    by_owner = found.groupBy("hash", "rid", "owner").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(found: DataFrame, many_owners: int = MANY_OWNERS) -> DataFrame:
    """The candidates with n_repos, n_owners and `copied`: many owners hold the value. Base ones all stay, added ones only if not copied."""
    out = found.join(ownership(found), "hash", "left").withColumn("copied", F.col("n_owners") >= many_owners)
    return out.where((F.col("kind_no") < len(BASE)) | ~F.col("copied"))


def secret_scan(docs: DataFrame, many_owners: int = MANY_OWNERS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, span list `found` (start, kind_no, kind, end, copied, and documents and owners of its value; sorted)."""
    scanned = scan(docs, id_col, text_col, owner_col)
    by_doc = judged(spans(scanned), many_owners).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end", "copied", "n_repos", "n_owners"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,copied:boolean,n_repos:bigint,n_owners:bigint>>")
    return scanned.select("rid", "doc_id").join(by_doc, "rid", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def redact(docs: DataFrame, mark: str = "[secret]", many_owners: int = MANY_OWNERS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The input rows with every span that secret_scan returns replaced by a mark (overlapping spans by one)."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    scanned = scan(docs.select(F.struct(F.col(id_col).alias("i"), key.alias("h")).alias("__id"), F.col(text_col).alias("__t"), F.col(owner_col).alias("__o")), "__id", "__t", "__o")
    by_doc = judged(spans(scanned), many_owners).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__found"))
    # repeated rows are alike, so one of them speaks for all
    by_doc = scanned.join(by_doc, "rid").groupBy("doc_id").agg(F.any_value("__found").alias("__found")).select(F.col("doc_id.i").alias("__i"), F.col("doc_id.h").alias("__h"), "__found")
    # the kept parts between spans that do not overlap, joined once by the mark
    part = lambda a, n: F.substring(F.col(text_col), a.cast("int") + 1, n.cast("int"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["kept"]).otherwise(F.array_append(acc["kept"], part(acc["at"], x["start"] - acc["at"]))).alias("kept"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("kept"))
    done = F.aggregate("__found", start, step, lambda acc: F.array_join(F.array_append(acc["kept"], part(acc["at"], F.lit(2**31 - 1))), mark))
    rows = docs.withColumn("__k", key).join(by_doc, (F.col("__k") == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__i")), "left")
    text = F.when(F.col("__found").isNull(), F.col(text_col)).otherwise(done)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read(spark, sf_dir, "documents"))
    said = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    live = F.size(F.filter("found", lambda x: ~x["copied"])).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(said(F.filter("found", lambda x: x["kind_no"] < len(BASE))), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), live.alias("n_live"))


def _sql_kind(no: int, kind: str, docs: str) -> str:
    pattern, least, group = PATTERNS[kind]
    p = pattern.replace("'", "''")
    extra = " AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')" if kind == "mixed" else ""
    return f"""SELECT doc_id, owner, {no} AS kind_no, '{kind}' AS kind, start, start + length(m) AS "end", v FROM (
  SELECT doc_id, owner, m, regexp_extract(m, '{p}', {group}) AS v,
    sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS start FROM (
    SELECT doc_id, owner, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS k FROM (
      SELECT doc_id, source AS owner, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs
      FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM {docs}) WHERE regexp_matches(t, '{p}'))))
  WHERE length(v) >= {least}{extra}"""


def sql_ctes(docs: str) -> str:
    """s_keep: the kept candidates of each document; ids have to be distinct."""
    return f"""
s_all AS ({" UNION ALL ".join(_sql_kind(i, k, docs) for i, k in enumerate(KINDS))}),
s_many AS (SELECT v FROM (SELECT DISTINCT v, owner FROM s_all) GROUP BY v HAVING count(*) >= {MANY_OWNERS}),
s_keep AS (SELECT s.*, m.v IS NOT NULL AS copied FROM s_all s LEFT JOIN s_many m ON s.v = m.v WHERE s.kind_no < {len(BASE)} OR m.v IS NULL)
"""


OP8_SQL = f"""WITH {sql_ctes("documents")},
s_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind_no) FILTER (WHERE kind_no < {len(BASE)}) AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind_no) AS spans,
  count(*) FILTER (WHERE NOT copied) AS n_live FROM s_keep GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live FROM documents d LEFT JOIN s_doc s USING (doc_id)"""
