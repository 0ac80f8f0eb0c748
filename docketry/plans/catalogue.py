"""The queries of the library over the standard tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import text as T
from ..operators import dedup, evaluation, extract, workflow
from ..operators import linemodel
from ..sources import generators, receipts_io
from . import adapter as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


ENGINE = (A.CLAIMS_SQL, A.KEYS_SQL, A.PAIRS_SQL, A.SCORED_SQL)


def _pairs(spark, d, full: bool = False):
    """Claims and candidate pairs; full: with the rare-token keys, which the SQL leaves out."""
    c = dedup.settled(A.claims(spark, d))
    return c, dedup.candidate_pairs(c, None if full else dedup.fixed_keys(c))


def _found(spark: SparkSession, d: str, full: bool = False):
    """Claims and scored pairs; full: with rare-token keys, fuzzy matching and text, which the SQL leaves out."""
    c, p = _pairs(spark, d, full)
    p = dedup.settled(p)
    if full:
        return c, dedup.tag_resubmissions(dedup.scored_with_text(p, c), c)
    return c, dedup.tag_resubmissions(dedup.scored_pairs(p, c, fuzzy_match=False), c)


@query("duplicate_claims", _with(*ENGINE) + "SELECT a, b, score, band, rules FROM found")
def duplicate_claims(spark, d, full=False):
    return _found(spark, d, full)[1].select("a", "b", "score", "band", F.array_join("rules_fired", ",").alias("rules"))


@query("block_keys", _with(A.CLAIMS_SQL, A.KEYS_SQL) + "SELECT block, count(*) AS n_keys, count(DISTINCT key) AS n_blocks FROM keys GROUP BY block")
def block_keys(spark, d):
    return dedup.fixed_keys(A.claims(spark, d)).distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n_keys"), F.countDistinct("key").alias("n_blocks"))


@query("candidate_pairs", _with(*ENGINE[:3]) + "SELECT a, b FROM pairs")
def candidate_pairs(spark, d, full=False):
    return _pairs(spark, d, full)[1]


@query("pair_signals", _with(*ENGINE) + "SELECT a, b, invoice, amount, vendor, date, image FROM found")
def pair_signals(spark, d, full=False):
    return _found(spark, d, full)[1].select("a", "b", *[F.col("signals")[k].alias(k) for k in ("invoice", "amount", "vendor", "date", "image", *["text"] * full)])


@query("duplicates_fuzzy")
def duplicates_fuzzy(spark, d):
    c = dedup.settled(A.claims(spark, d))
    out = dedup.find_duplicates(c, policy_limit=150_000)
    return out.select("a", "b", "score", "band", F.array_join("rules_fired", ",").alias("rules"), F.array_join("tags", ",").alias("tags"))


@query("duplicates_incremental")
def duplicates_incremental(spark, d):
    c = dedup.settled(A.claims(spark, d))
    new, old = c.where(F.col("claim_id") >= A.COPY), c.where(F.col("claim_id") < A.COPY)
    return dedup.find_duplicates_for(new, old).select("a", "b", "score", "band")


_STATS = """, k AS (SELECT (SELECT count(*) FROM claims) AS n_claims, (SELECT count(*) FROM pairs) AS n_candidates, (SELECT count(*) FROM truth) AS n_truth, (SELECT count(*) FROM truth JOIN pairs USING (a, b)) AS n_found)
SELECT n_claims, (n_claims * (n_claims - 1) / 2)::BIGINT AS n_possible, n_candidates, n_truth, n_found, 1 - n_candidates / (n_claims * (n_claims - 1) / 2) AS reduction_ratio, 2 * n_candidates / n_claims AS pairs_per_claim,
  CASE WHEN n_truth > 0 THEN n_found / n_truth ELSE 1.0::DOUBLE END AS recall FROM k"""


@query("blocking_stats", _with(*ENGINE[:3]).rstrip() + _STATS)
def blocking_stats(spark, d, full=False):
    c, p = _pairs(spark, d, full)
    return dedup.blocking_stats(c, p, A.truth(spark, d))


_REACH = """edges AS (SELECT a, b FROM {t} UNION SELECT b, a FROM {t}), reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node) """


@query("duplicate_groups", "WITH RECURSIVE " + ", ".join(ENGINE) + ", strong AS (SELECT a, b FROM found WHERE band IN ('EXACT', 'HIGH')), " + _REACH.format(t="strong") + "SELECT node AS claim_id, dense_rank() OVER (ORDER BY component)::INT AS duplicate_group FROM comp")
def duplicate_groups(spark, d, full=False):
    return dedup.clusters(_found(spark, d, full)[1])


@query("transitive_truth", "WITH RECURSIVE " + A.CLAIMS_SQL + ", ft AS (SELECT a, b, dup_type FROM truth UNION ALL SELECT a, b + 1, 'CHAIN' FROM truth), " + _REACH.format(t="ft") + "SELECT x.node AS a, y.node AS b, coalesce(dup_type, 'TRANSITIVE') AS dup_type FROM comp x JOIN comp y ON x.component = y.component AND x.node < y.node LEFT JOIN ft ON ft.a = x.node AND ft.b = y.node")
def transitive_truth(spark, d):
    t = A.truth(spark, d)
    return dedup.transitive_closure(t.unionByName(t.select("a", (F.col("b") + 1).alias("b"), F.lit("CHAIN").alias("dup_type")))).select("a", "b", "dup_type")


_GAME = """, g AS (SELECT claim_id, employee_id, date FROM claims WHERE total >= 0.85 * 150000 AND total < 150000 AND date IS NOT NULL),
w AS (SELECT x.employee_id, x.date, x.claim_id, count(*) AS n FROM g x JOIN g y ON x.employee_id = y.employee_id AND y.date - x.date BETWEEN 0 AND 7 GROUP BY ALL HAVING count(*) >= 3),
f AS (SELECT employee_id, arg_min(claim_id, (date, claim_id)) AS anchor, min(date) AS first FROM w GROUP BY employee_id)
SELECT least(anchor, claim_id) AS a, greatest(anchor, claim_id) AS b FROM f JOIN g USING (employee_id) WHERE date - first BETWEEN 0 AND 7 AND (date > first OR claim_id > anchor)"""


@query("threshold_gaming", _with(A.CLAIMS_SQL).rstrip() + _GAME)
def threshold_gaming(spark, d):
    return dedup.threshold_gaming(A.claims(spark, d), 150_000)


_LINES = "claim_lines AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_suppkey % 50 AS employee_id, l_returnflag AS vendor_raw, l_returnflag || l_linestatus AS vendor_canonical, l_shipdate::DATE AS date, l_quantity::DECIMAL(12,2) AS total FROM lineitem)"
_SPLIT = """, g AS (SELECT *, (date_diff('day', DATE '0001-01-01', date) + 1) // 2 AS day FROM claim_lines), f AS (SELECT employee_id, vendor_canonical, day FROM g GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT g.* FROM g JOIN f USING (employee_id, vendor_canonical, day)),
p2 AS (SELECT w.claim_id AS w, [x.claim_id, y.claim_id] AS ids, employee_id, vendor_canonical, day, w.total AS wt, x.total + y.total AS s FROM m w JOIN m x USING (employee_id, vendor_canonical, day) JOIN m y USING (employee_id, vendor_canonical, day) WHERE x.claim_id < y.claim_id AND w.claim_id NOT IN (x.claim_id, y.claim_id)),
p3 AS (SELECT w, list_append(ids, z.claim_id) AS ids, employee_id, vendor_canonical, day, wt, s + z.total AS s FROM p2 JOIN m z USING (employee_id, vendor_canonical, day) WHERE z.claim_id > ids[2] AND z.claim_id <> w),
p4 AS (SELECT w, list_append(ids, z.claim_id) AS ids, employee_id, vendor_canonical, day, wt, s + z.total AS s FROM p3 JOIN m z USING (employee_id, vendor_canonical, day) WHERE z.claim_id > ids[3] AND z.claim_id <> w),
h AS (SELECT w, min(ids) AS ids FROM (SELECT w, ids, wt, s FROM p2 UNION ALL SELECT w, ids, wt, s FROM p3 UNION ALL SELECT w, ids, wt, s FROM p4) WHERE abs(s - wt) * 100 <= wt GROUP BY w, len(ids))
SELECT DISTINCT least(w, c) AS a, greatest(w, c) AS b FROM (SELECT w, unnest(ids) AS c FROM h)"""


@query("split_suspects", "WITH " + _LINES + _SPLIT)
def split_suspects(spark, d):
    line = A.load(spark, d, "lineitem")
    claims = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_suppkey") % 50).alias("employee_id"), F.col("l_returnflag").alias("vendor_raw"), F.concat("l_returnflag", "l_linestatus").alias("vendor_canonical"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").cast("decimal(12,2)").alias("total"))
    return dedup.split_suspects(claims)


_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0.0::DOUBLE END AS f1"


@query("prf_by_band", _with(*ENGINE).rstrip() + f", lv AS (SELECT * FROM (VALUES ('EXACT', 4), ('HIGH', 3), ('MEDIUM', 2), ('LOW', 1)) v(band, r)), x AS (SELECT f.a IS NOT NULL AS said, CASE f.band WHEN 'EXACT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS rank, t.a IS NOT NULL AS tr FROM found f FULL JOIN truth t ON f.a = t.a AND f.b = t.b), k AS (SELECT lv.band, count(*) FILTER (WHERE rank >= r AND tr) AS tp, count(*) FILTER (WHERE rank >= r AND NOT tr) AS fp, count(*) FILTER (WHERE rank < r AND tr) AS fn FROM x, lv GROUP BY lv.band) SELECT band, tp, fp, fn, {_PRF} FROM k")
def prf_by_band(spark, d, full=False):
    return evaluation.band_prf(_found(spark, d, full)[1], A.truth(spark, d))


@query("recall_by_type", _with(*ENGINE) + "SELECT dup_type, count(*) AS n, count(f.a) AS found, count(f.a) / count(*) AS recall FROM truth t LEFT JOIN (SELECT * FROM found WHERE band IN ('EXACT', 'HIGH', 'MEDIUM')) f ON t.a = f.a AND t.b = f.b GROUP BY dup_type")
def recall_by_type(spark, d, full=False):
    return evaluation.recall_by_type(_found(spark, d, full)[1], A.truth(spark, d))


_CURVE = ", h AS (SELECT f.a, f.b, score, (t.a IS NOT NULL)::INT AS hit FROM found f LEFT JOIN truth t ON f.a = t.a AND f.b = t.b), c AS (SELECT *, row_number() OVER o AS rn, count(*) OVER () AS n, sum(hit) OVER o AS tp FROM h WINDOW o AS (ORDER BY score DESC, a, b ROWS UNBOUNDED PRECEDING)) "


@query("precision_curve", _with(*ENGINE).rstrip() + _CURVE + "SELECT rn, score, tp / rn AS precision, tp / (SELECT count(*) FROM truth) AS recall FROM c WHERE (rn - 1) % greatest(n // 20, 1) = 0 OR rn = n")
def precision_curve(spark, d, full=False):
    return evaluation.sampled_curve(evaluation.precision_curve(_found(spark, d, full)[1], A.truth(spark, d)))


@query("average_precision", _with(*ENGINE).rstrip() + _CURVE + "SELECT sum(tp / rn * hit) / (SELECT count(*) FROM truth) AS average_precision FROM c")
def average_precision(spark, d, full=False):
    return evaluation.average_precision(evaluation.precision_curve(_found(spark, d, full)[1], A.truth(spark, d)))


@query("workload", _with(*ENGINE).rstrip() + _CURVE + "SELECT (SELECT count(*) FROM found WHERE band IN ('EXACT', 'HIGH', 'MEDIUM')) AS medium, (SELECT count(*) FROM found WHERE band IN ('EXACT', 'HIGH', 'MEDIUM')) * 1000 / (SELECT count(*) FROM claims) AS per_1000, max(tp / rn) AS precision_at_k FROM c WHERE rn = least(n, 50)")
def workload(spark, d, full=False):
    c, found = _found(spark, d, full)
    return evaluation.workload(found, A.truth(spark, d), c.count())


def _signals(spark, d):
    c, found = _found(spark, d)
    emp = c.select("claim_id", "employee_id")
    x = found.join(emp.withColumnsRenamed({"claim_id": "a", "employee_id": "ea"}), "a").join(emp.withColumnsRenamed({"claim_id": "b", "employee_id": "eb"}), "b")
    return x.select("a", "b", "signals", (F.col("ea") != F.col("eb")).alias("cross"))


def _all_signals(spark, d):
    """All six signals of every candidate pair, those below KEEP_SCORE too: another weight vector may lift them."""
    c = dedup.settled(A.claims(spark, d))
    p = dedup.settled(dedup.candidate_pairs(c))
    return dedup.signal_rows(p, c, dedup.text_signal(p, c)).select("a", "b", dedup.signal_map().alias("signals"), "cross")


_W = {k: w for k, w in R.SIGNAL_WEIGHTS.items() if k != "text"}
_NUM = " + ".join(f"coalesce({k} * v.{k}, 0)" for k in _W)
_DEN = " + ".join(f"({k} IS NOT NULL)::INT * v.{k}" for k in _W)
_VEC = ", ".join("(" + ", ".join([str(i), f"'{n}'"] + [f"{0.0 if k == n else w}::DOUBLE" for k, w in _W.items()]) + ")" for i, n in enumerate(["", *R.SIGNAL_WEIGHTS]))


@query("ablation", _with(*ENGINE).rstrip() + f""", v(vec, without, {', '.join(_W)}) AS (VALUES {_VEC}),
s AS (SELECT v.vec, v.without, (t.a IS NOT NULL) AS hit, round(({_NUM.replace('coalesce(', 'coalesce(f.')}) / nullif({_DEN.replace('(', '(f.', 1).replace(' + (', ' + (f.')}, 0) * CASE WHEN cross_emp THEN 0.88::DOUBLE ELSE 1 END, 4) AS sc
  FROM found f CROSS JOIN v LEFT JOIN truth t ON f.a = t.a AND f.b = t.b),
k AS (SELECT vec::BIGINT AS vec, without, count(*) FILTER (WHERE sc >= 0.78 AND hit) AS tp, count(*) FILTER (WHERE sc >= 0.78 AND NOT hit) AS fp FROM s GROUP BY ALL), j AS (SELECT *, (SELECT count(*) FROM truth) - tp AS fn FROM k)
SELECT vec, without, tp, fp, fn, {_PRF} FROM j""")
def ablation(spark, d, full=False):
    return evaluation.f1_by_weights((_all_signals if full else _signals)(spark, d), A.truth(spark, d), evaluation.ablation_vectors(spark))


@query("weight_search")
def weight_search(spark, d):
    return evaluation.best_weights(evaluation.f1_by_weights(_all_signals(spark, d), A.truth(spark, d), evaluation.weight_vectors(spark)))


@query("weight_tuning")
def weight_tuning(spark, d):
    return evaluation.tuned_weights(_all_signals(spark, d), A.truth(spark, d), A.claims(spark, d), evaluation.weight_vectors(spark))


_REASONS = "list_transform(list_sort(list_filter([" + ", ".join(f"{{'m': -{k}, 'n': '{k}'}}" for k in R.SIGNAL_WEIGHTS if k != "text") + "], lambda x: x.m <= -0.75)), lambda x: x.n || '=' || printf('%.2f', -x.m))"


@query("pair_reasons", _with(*ENGINE) + f"SELECT a, b, array_to_string(list_concat(CASE WHEN rules = '' THEN []::VARCHAR[] ELSE string_split(rules, ',') END, {_REASONS}), '; ') AS reasons FROM found")
def pair_reasons(spark, d, full=False):
    return dedup.reasons(_found(spark, d, full)[1]).select("a", "b", F.array_join("reasons", "; ").alias("reasons"))


# A confidence that is a plain function of the row, and a verdict from the labels.
_CONF = "conf AS (SELECT l.doc_id, (((l.doc_id * 7919) % 1000) / 1000.0)::DOUBLE AS conf, quality = 1 AS ok, coalesce(lang, '') AS lang, coalesce(source, '') AS source, n_chars > 1000 AS said FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _conf(spark, d):
    l, docs = A.load(spark, d, "labels"), A.load(spark, d, "documents")
    return l.join(docs, "doc_id").select("doc_id", (((F.col("doc_id") * 7919) % 1000) / 1000.0).alias("conf"), (F.col("quality") == 1).alias("ok"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), (F.col("n_chars") > 1000).alias("said"))


_REL = ", r AS (SELECT least(floor(conf * 10), 9)::INT AS bin, count(*) AS n, avg(conf) AS mean_confidence, avg(ok::INT) AS accuracy FROM conf GROUP BY 1), rel AS (SELECT b AS bin, b / 10 AS low, (b + 1) / 10 AS high, coalesce(n, 0) AS n, mean_confidence, accuracy, round(abs(mean_confidence - accuracy), 4) AS gap FROM (SELECT unnest(range(10))::INT AS b) LEFT JOIN r ON b = bin) "


@query("reliability", "WITH " + _CONF + _REL + "SELECT * FROM rel")
def reliability(spark, d):
    return evaluation.reliability(_conf(spark, d), "conf", "ok")


@query("calibration", "WITH " + _CONF + _REL + "SELECT (SELECT sum(n * coalesce(gap, 0)) / sum(n) FROM rel) AS ece, avg((conf - ok::INT) ** 2) AS squared_error, count(*) AS n FROM conf")
def calibration(spark, d):
    return evaluation.calibration_errors(_conf(spark, d), "conf", "ok")


_RANK = ", k AS (SELECT conf, row_number() OVER o AS rn, count(*) OVER () AS n, sum(ok::INT) OVER o AS hits FROM conf WINDOW o AS (ORDER BY conf DESC, doc_id ROWS UNBOUNDED PRECEDING)) "


@query("risk_coverage", "WITH " + _CONF + _RANK + "SELECT c::DOUBLE AS coverage, rn AS taken, hits / rn AS accuracy, conf AS threshold FROM k, (SELECT unnest([0.5, 0.8, 0.9, 1.0]) AS c) WHERE rn = greatest(floor(n * c), 1)")
def risk_coverage(spark, d):
    return evaluation.risk_coverage(_conf(spark, d), "conf", "ok", "doc_id")


@query("accuracy_threshold", "WITH " + _CONF + _RANK + "SELECT conf AS threshold, rn / n AS coverage, hits / rn AS accuracy FROM k WHERE hits / rn >= 0.85 AND rn / n >= 0.05 ORDER BY rn DESC LIMIT 1")
def accuracy_threshold(spark, d):
    return evaluation.threshold_for(_conf(spark, d), "conf", "ok", "doc_id", 0.85)


@query("prf_grouping_sets", "WITH " + _CONF + f", k AS (SELECT lang, source, ok, count(*) AS n, count(*) FILTER (WHERE said AND ok) AS tp, count(*) FILTER (WHERE said AND NOT ok) AS fp, count(*) FILTER (WHERE NOT said AND ok) AS fn FROM conf GROUP BY GROUPING SETS ((), (lang), (lang, source), (lang, ok))) SELECT *, {_PRF} FROM k")
def prf_grouping_sets(spark, d):
    return evaluation.grouped_prf(_conf(spark, d).withColumn("okk", F.col("ok")), ["lang", "source", "ok"], F.col("said"), F.col("okk"))


_TOK = f"tok AS (SELECT doc_id, unnest(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{4,}}'), lambda x: lower(x))), lambda x: x NOT IN ({', '.join(repr(w) for w in R.TOKEN_STOP_WORDS)}))) AS token FROM documents), df AS (SELECT token, count(*) AS df FROM tok GROUP BY token)"


@query("document_frequency", "WITH " + _TOK + " SELECT df, count(*) AS n_tokens FROM df GROUP BY df")
def document_frequency(spark, d):
    return dedup.document_frequency(A.load(spark, d, "documents")).groupBy("df").agg(F.count(F.lit(1)).alias("n_tokens"))


@query("rare_tokens", "WITH " + _TOK + ", k AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, token) AS rn FROM tok JOIN df USING (token) WHERE df <= 5) SELECT doc_id AS claim_id, token FROM k WHERE rn <= 3")
def rare_tokens(spark, d):
    return dedup.rare_tokens(A.load(spark, d, "documents").withColumnRenamed("doc_id", "claim_id"))


_GRAMS = """w AS (SELECT item_id, ' ' || unnest(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) || ' ' AS w FROM benchmark),
g AS (SELECT item_id, substr(w, i, k) AS term FROM (SELECT item_id, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM w, (SELECT unnest([3, 4, 5]) AS k) WHERE length(w) >= k)),
tf0 AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY ALL), top AS (SELECT term FROM tf0 GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 50000), tf AS (SELECT tf0.* FROM tf0 JOIN top USING (term)), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
v AS (SELECT item_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY item_id), u AS (SELECT item_id, term, w / norm AS w FROM v JOIN n USING (item_id))
SELECT x.item_id AS a, y.item_id AS b, round(sum(x.w * y.w), 8) AS text FROM u x JOIN u y ON x.term = y.term AND x.item_id + 1 = y.item_id GROUP BY ALL"""


@query("tfidf_cosine", "WITH " + _GRAMS)
def tfidf_cosine(spark, d):
    b = A.load(spark, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("a")).join(b.select((F.col("item_id")).alias("b")), F.col("a") + 1 == F.col("b"))
    out = dedup.tfidf_scores(pairs, b, "item_id", "text").where("text > 0")
    return out.select("a", "b", F.round("text", 8).alias("text"))


@query("claims_by_status", _with(A.CLAIMS_SQL) + f", k AS (SELECT s AS status, count(c.claim_id) AS n FROM (SELECT unnest({list(workflow.STATUSES)}) AS s) LEFT JOIN claims c ON s = status GROUP BY s) SELECT status, n, n / greatest(max(n) OVER (), 1) AS share_of_max FROM k")
def claims_by_status(spark, d):
    return workflow.status_counts(A.claims(spark, d))


@query("money_by_currency", _with(A.CLAIMS_SQL) + "SELECT currency, sum(total)::DECIMAL(22,2) AS amount, count(*) AS n FROM claims GROUP BY currency")
def money_by_currency(spark, d):
    return workflow.money_by_currency(A.claims(spark, d))


_FLAGS = ", flags AS (SELECT CASE WHEN x.submitted_at >= y.submitted_at THEN a ELSE b END AS claim_id, CASE WHEN x.submitted_at >= y.submitted_at THEN b ELSE a END AS matched_id, band, f.score, CASE WHEN (a + b) % 5 = 0 THEN 'DISMISSED' ELSE 'OPEN' END AS status FROM found f JOIN claims x ON a = x.claim_id JOIN claims y ON b = y.claim_id) "


def _flags(spark, d, full=False):
    c, found = _found(spark, d, full)
    flags = workflow.orient(found.select("a", "b", "band", "score"), c)
    return c, flags.withColumn("status", F.when((F.col("claim_id") + F.col("matched_id")) % 5 == 0, "DISMISSED").otherwise("OPEN"))


@query("flags", _with(*ENGINE).rstrip() + _FLAGS + "SELECT * FROM flags")
def flags(spark, d, full=False):
    return _flags(spark, d, full)[1]


@query("review_queue", _with(*ENGINE).rstrip() + _FLAGS + """, p AS (SELECT claim_id, count(*) AS open_flags, count(*) FILTER (WHERE band IN ('EXACT', 'HIGH')) AS serious_flags, max(list_position(['NONE', 'LOW', 'MEDIUM', 'HIGH', 'EXACT'], band))::BIGINT AS risk FROM flags WHERE status = 'OPEN' GROUP BY claim_id)
SELECT claim_id, total, coalesce(open_flags, 0) AS open_flags, coalesce(serious_flags, 0) AS serious_flags, coalesce(risk, 0) AS risk FROM claims LEFT JOIN p USING (claim_id) WHERE status NOT IN ('APPROVED', 'REJECTED') ORDER BY coalesce(risk, 0) DESC, total DESC, claim_id LIMIT 200""")
def review_queue(spark, d, full=False):
    c, fl = _flags(spark, d, full)
    return workflow.review_queue(c, fl).select("claim_id", "total", "open_flags", "serious_flags", "risk")


@query("approvable", _with(*ENGINE).rstrip() + _FLAGS + "SELECT claim_id FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM flags WHERE status = 'OPEN' AND band IN ('EXACT', 'HIGH'))")
def approvable(spark, d, full=False):
    return workflow.approvable(*_flags(spark, d, full)).select("claim_id")


@query("flags_of_either_side", _with(*ENGINE).rstrip() + _FLAGS + "SELECT node, count(*) AS n FROM (SELECT claim_id AS node FROM flags UNION ALL SELECT matched_id FROM flags) GROUP BY node")
def flags_of_either_side(spark, d, full=False):
    return workflow.flags_of_either_side(_flags(spark, d, full)[1]).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("keep_resolutions", _with(*ENGINE).rstrip() + _FLAGS + "SELECT claim_id, matched_id, status FROM flags")
def keep_resolutions(spark, d, full=False):
    _, fl = _flags(spark, d, full)
    return workflow.keep_resolutions(fl.drop("status"), fl).select("claim_id", "matched_id", "status")


@query("regrouped", "WITH RECURSIVE " + ", ".join(ENGINE) + _FLAGS + ", strong AS (SELECT claim_id AS a, matched_id AS b FROM flags WHERE status <> 'DISMISSED' AND band IN ('EXACT', 'HIGH')), " + _REACH.format(t="strong") + "SELECT claim_id, duplicate_group FROM claims LEFT JOIN (SELECT node, dense_rank() OVER (ORDER BY component)::INT AS duplicate_group FROM comp) ON claim_id = node")
def regrouped(spark, d, full=False):
    return dedup.recomputed_groups(*_flags(spark, d, full))


@query("claims_with_flags", _with(*ENGINE).rstrip() + _FLAGS + "SELECT c.claim_id, coalesce(string_agg(matched_id || ':' || band, ',' ORDER BY matched_id, band), '') AS flags FROM claims c LEFT JOIN flags f ON c.claim_id = f.claim_id GROUP BY c.claim_id")
def claims_with_flags(spark, d, full=False):
    c, fl = _flags(spark, d, full)
    said = F.array_join(F.transform("flags", lambda x: F.concat_ws(":", x["matched_id"].cast("string"), x["band"])), ",")
    return workflow.with_flags(c.select("claim_id"), fl).select("claim_id", said.alias("flags"))


@query("flags_after_rescore", _with(*ENGINE).rstrip() + _FLAGS + "SELECT claim_id, matched_id, band, score, CASE WHEN (claim_id + matched_id) % 5 = 0 AND claim_id % 2 = 0 THEN 'DISMISSED' ELSE 'OPEN' END AS status FROM flags")
def flags_after_rescore(spark, d, full=False):
    """Flags of claims with even ids were there before, some of them dismissed; all pairs are scored again."""
    c, found = _found(spark, d, full)
    pairs = dedup.settled(found.select("a", "b", "band", "score"))
    old = workflow.orient(pairs, c).where("claim_id % 2 = 0")
    old = old.withColumn("status", F.when((F.col("claim_id") + F.col("matched_id")) % 5 == 0, "DISMISSED").otherwise("OPEN"))
    return workflow.persist_flags(old, pairs, c).select("claim_id", "matched_id", "band", "score", "status")


@query("rejected_by_confirmation", _with(*ENGINE).rstrip() + _FLAGS + """, yes AS (SELECT DISTINCT claim_id FROM flags WHERE status = 'OPEN' AND band = 'EXACT' AND (claim_id + matched_id) % 3 = 0)
SELECT c.claim_id, CASE WHEN y.claim_id IS NOT NULL AND status NOT IN ('APPROVED', 'REJECTED') THEN 'REJECTED' ELSE status END AS status FROM claims c LEFT JOIN yes y ON c.claim_id = y.claim_id""")
def rejected_by_confirmation(spark, d, full=False):
    c, fl = _flags(spark, d, full)
    verdicts = fl.where("status = 'OPEN' AND band = 'EXACT' AND (claim_id + matched_id) % 3 = 0").select("claim_id", "matched_id", F.lit("CONFIRMED").alias("verdict"))
    confirmed = workflow.resolve_flags(fl, verdicts)[1]
    return workflow.reject_confirmed(c, confirmed, F.lit("2030-01-01").cast("timestamp")).select("claim_id", "status")


_DRAFTS = "drafts AS (SELECT claim_id, ((claim_id * 7919) % 1000) / 1000.0 AS doc_confidence, CASE WHEN claim_id % 7 = 0 THEN status ELSE 'DRAFT' END AS status FROM claims)"


def _drafts(spark, d):
    c = A.claims(spark, d)
    return c.withColumns({"doc_confidence": ((F.col("claim_id") * 7919) % 1000) / 1000.0, "status": F.when(F.col("claim_id") % 7 == 0, F.col("status")).otherwise("DRAFT")})


@query("submitted_claims", _with(A.CLAIMS_SQL, _DRAFTS) + "SELECT claim_id, CASE WHEN status <> 'DRAFT' THEN status WHEN doc_confidence < 0.6 THEN 'NEEDS_INFO' ELSE 'SUBMITTED' END AS status FROM drafts")
def submitted_claims(spark, d):
    return workflow.submit(_drafts(spark, d), F.lit("2030-01-01").cast("timestamp"))[0].select("claim_id", "status")


@query("submission_audit", _with(A.CLAIMS_SQL, _DRAFTS) + "SELECT claim_id, 'DRAFT' AS from_status, 'SUBMITTED' AS to_status FROM drafts WHERE status = 'DRAFT' UNION ALL SELECT claim_id, 'SUBMITTED', 'NEEDS_INFO' FROM drafts WHERE status = 'DRAFT' AND doc_confidence < 0.6")
def submission_audit(spark, d):
    return workflow.submit(_drafts(spark, d), F.lit("2030-01-01").cast("timestamp"))[1].select("claim_id", "from_status", "to_status")


_REVIEWED = """f AS (SELECT o_orderkey AS receipt_id, unnest(['total', 'date', 'invoice_no']) AS field, unnest([o_totalprice::DECIMAL(12,2)::VARCHAR, o_orderdate::DATE::VARCHAR, 'INV-' || o_orderkey]) AS value, TRUE AS needs_review FROM orders),
k AS (SELECT o_orderkey AS receipt_id, CASE o_orderkey % 5 WHEN 1 THEN 'date' WHEN 2 THEN 'invoice_no' WHEN 3 THEN 'date' ELSE 'total' END AS field, CASE o_orderkey % 5 WHEN 0 THEN '1,234.5' WHEN 1 THEN '2020-13-01' WHEN 2 THEN '  X-9 ' WHEN 3 THEN '2020-02-29' ELSE ' ' END AS value FROM orders)"""


def _reviewed(spark, d):
    o = A.load(spark, d, "orders")
    each = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("total", F.col("o_totalprice").cast("decimal(12,2)").cast("string")), ("date", F.col("o_orderdate").cast("date").cast("string")), ("invoice_no", F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))))])
    fields = o.select(F.col("o_orderkey").alias("receipt_id"), F.explode(each).alias("x")).select("receipt_id", "x.*", F.lit(True).alias("needs_review"))
    k = (F.col("o_orderkey") % 5).cast("int")
    of = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), k)
    new = o.select(F.col("o_orderkey").alias("receipt_id"), of("total", "date", "invoice_no", "date", "total").alias("field"), of("1,234.5", "2020-13-01", "  X-9 ", "2020-02-29", " ").alias("value"))
    return workflow.correct_fields(fields, new)


@query("corrected_fields", _with(_REVIEWED) + "SELECT f.receipt_id, f.field, CASE WHEN k.receipt_id IS NULL OR f.receipt_id % 5 IN (1, 4) THEN f.value WHEN f.receipt_id % 5 = 0 THEN '1234.50' ELSE trim(k.value) END AS value, k.receipt_id IS NULL OR f.receipt_id % 5 IN (1, 4) AS needs_review, k.receipt_id IS NOT NULL AND f.receipt_id % 5 NOT IN (1, 4) AS rescore FROM f LEFT JOIN k USING (receipt_id, field)")
def corrected_fields(spark, d):
    return _reviewed(spark, d)[0].select("receipt_id", "field", "value", "needs_review", "rescore")


@query("refused_corrections", _with(_REVIEWED) + "SELECT receipt_id, field, value, CASE WHEN receipt_id % 5 = 1 THEN 'invalid' ELSE 'blank' END AS reason FROM k WHERE receipt_id % 5 IN (1, 4)")
def refused_corrections(spark, d):
    return _reviewed(spark, d)[1].select("receipt_id", "field", "value", "reason")


@query("corrected_claims", _with(A.CLAIMS_SQL) + "SELECT claim_id, CASE WHEN claim_id % 1000000000 % 5 = 0 THEN 1234.50 ELSE total END::DECIMAL(12,2) AS total FROM claims")
def corrected_claims(spark, d):
    c = A.claims(spark, d).withColumn("receipt_id", F.col("claim_id") % A.COPY)
    return workflow.corrected_claims(c, _reviewed(spark, d)[0]).select("claim_id", "total")


@query("visible_claims", _with(A.CLAIMS_SQL, "u AS (SELECT * FROM (VALUES (0, TRUE), (1, FALSE), (2, FALSE), (4, FALSE)) v(user_id, reviewer))") + "SELECT user_id::BIGINT AS user_id, count(*) AS n, sum(total)::DECIMAL(22,2) AS total FROM u JOIN claims ON reviewer OR employee_id = user_id GROUP BY user_id")
def visible_claims(spark, d):
    users = spark.createDataFrame([(0, True), (1, False), (2, False), (4, False)], "user_id long, reviewer boolean")
    return workflow.visible_claims(A.claims(spark, d), users).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


@query("next_claim_id", "SELECT 'U' || lpad((max(c_custkey) + 1)::VARCHAR, 7, '0') AS next_id FROM customer")
def next_claim_id(spark, d):
    ids = A.load(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("U"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")), F.concat(F.lit("C9"), F.col("c_custkey").cast("string")))).alias("id"))
    return workflow.next_id(ids, "id", "U", 7)


def _actions(spark, d):
    e = A.load(spark, d, "events")
    kinds = F.array(*[F.lit(s) for s in workflow.STATUSES[1:]])
    return e.select(F.col("user_id").alias("claim_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("to_status"))


_OK = " ".join(["CASE {f}", *[f"WHEN '{x}' THEN {{t}} IN ({', '.join(repr(y) for y in to)})" for x, to in workflow.ALLOWED.items() if to], "ELSE FALSE END"])
_LOG = f"""RECURSIVE act AS (SELECT *, (row_number() OVER (PARTITION BY claim_id ORDER BY ts, seq) - 1)::INT AS step FROM (SELECT user_id AS claim_id, ts, event_id AS seq, {list(workflow.STATUSES[1:])}[(event_id % 5 + 1)::INT] AS to_status FROM events)),
log AS (SELECT claim_id, step, ts, seq, to_status, 'DRAFT' AS from_status, {_OK.format(f="'DRAFT'", t="to_status")} AS accepted FROM act WHERE step = 0
  UNION ALL SELECT claim_id, step, ts, seq, to_status, from_status, {_OK.format(f="from_status", t="to_status")} FROM (SELECT x.claim_id, x.step, x.ts, x.seq, x.to_status, CASE WHEN r.accepted THEN r.to_status ELSE r.from_status END AS from_status FROM log r JOIN act x ON x.claim_id = r.claim_id AND x.step = r.step + 1))"""


@query("workflow_log", f"WITH {_LOG} SELECT claim_id, step, ts AS \"at\", seq, to_status, from_status, accepted FROM log")
def workflow_log(spark, d):
    return workflow.apply_actions(_actions(spark, d))


@query("workflow_state", f"WITH {_LOG} SELECT claim_id, arg_max(to_status, step) AS status, max(ts) FILTER (WHERE to_status IN ('APPROVED', 'REJECTED')) AS decided_at FROM log WHERE accepted GROUP BY claim_id")
def workflow_state(spark, d):
    return workflow.current_state(workflow.apply_actions(_actions(spark, d)))


@query("compare_fields", "WITH x AS (SELECT p_brand AS name, min(p_name) AS v FROM part WHERE p_size < 10 GROUP BY 1), y AS (SELECT p_brand AS name, min(p_name) AS v FROM part WHERE p_size >= 5 GROUP BY 1) SELECT coalesce(x.name, y.name) AS name, x.v AS value_a, y.v AS value_b, CASE WHEN x.v IS NULL OR y.v IS NULL THEN 'absent' WHEN x.v = y.v THEN 'identical' ELSE 'differs' END AS verdict FROM x FULL JOIN y ON x.name = y.name")
def compare_fields(spark, d):
    p = A.load(spark, d, "part")
    side = lambda w: p.where(w).groupBy(F.col("p_brand").alias("name")).agg(F.min("p_name").alias("value"))
    return workflow.compare_fields(side("p_size < 10"), side("p_size >= 5"))


@query("parsed_amounts", "SELECT o_orderkey, o_totalprice::DECIMAL(12,2) AS plain, o_totalprice::DECIMAL(12,2) AS grouped, o_totalprice::DECIMAL(12,2) AS comma, -(o_totalprice::DECIMAL(12,2)) AS bracketed, o_totalprice::DECIMAL(12,2) AS rupees FROM orders")
def parsed_amounts(spark, d):
    p = F.format_string("%.2f", F.col("o_totalprice"))
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ",.", ".,")
    return A.load(spark, d, "orders").select("o_orderkey", T.parse_amount(p).alias("plain"), T.parse_amount(us).alias("grouped"), T.parse_amount(eu).alias("comma"), T.parse_amount(F.concat(F.lit("("), us, F.lit(")"))).alias("bracketed"), T.to_decimal(F.concat(F.lit("Rs. "), p)).alias("rupees"))


@query("parsed_dates", "SELECT o_orderkey, o_orderdate::DATE AS ymd, o_orderdate::DATE AS dmy, o_orderdate::DATE AS mdy, o_orderdate::DATE AS named, o_orderdate::DATE AS us_named, o_orderdate::DATE AS compact, day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous FROM orders")
def parsed_dates(spark, d):
    f = lambda fmt: F.date_format("o_orderdate", fmt)
    p = lambda s, prefer="DMY": T.parse_date_multi(s, prefer)["date"]
    return A.load(spark, d, "orders").select("o_orderkey", p(f("yyyy-M-d")).alias("ymd"), p(f("d/M/yyyy")).alias("dmy"), p(f("M/d/yyyy"), "MDY").alias("mdy"), p(f("d-MMM-yyyy")).alias("named"), p(f("MMM d, yyyy")).alias("us_named"), p(f("ddMMyyyy")).alias("compact"), T.parse_date_multi(f("d/M/yyyy"))["ambiguous"].alias("ambiguous"))


@query("hamming", "SELECT o_orderkey, bit_count(xor(o_orderkey * 7919, o_custkey * 104729))::INT AS distance FROM orders")
def hamming(spark, d):
    return A.load(spark, d, "orders").select("o_orderkey", T.hamming(F.col("o_orderkey") * 7919, F.col("o_custkey") * 104729).alias("distance"))


@query("normalised_names", "SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS invoice_form, trim(regexp_replace(regexp_replace(replace(upper(c_name), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS vendor_form FROM customer")
def normalised_names(spark, d):
    return A.load(spark, d, "customer").select("c_custkey", T.norm_invoice_no(F.col("c_name")).alias("invoice_form"), T.norm_vendor(F.col("c_name")).alias("vendor_form"))


_CHECK = "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ((36 - list_sum(list_transform(range(1, 15), lambda i: (((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(p, i, 1)) - 1) * (2 - i % 2)) // 36) + (((instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(p, i, 1)) - 1) * (2 - i % 2)) % 36)))::BIGINT % 36) % 36 + 1)::BIGINT, 1)"


@query("gstin_checks", f"""WITH p AS (SELECT DISTINCT '29AAGCB' || lpad((k % 10000)::VARCHAR, 4, '0') || 'J1Z' AS p FROM (SELECT arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)), c AS (SELECT p, {_CHECK} AS c FROM p)
SELECT p || c AS gstin, TRUE AS ok FROM c UNION SELECT p || 'A', c = 'A' FROM c UNION SELECT '39' || substr(p, 3) || c, FALSE FROM c UNION SELECT p, FALSE FROM c""")
def gstin_checks(spark, d):
    t = A.receipt_truth(spark, d).select("gstin").distinct()
    head = F.substring("gstin", 1, 14)
    forms = F.explode(F.array("gstin", F.concat(head, F.lit("A")), F.concat(F.lit("39"), F.substring("gstin", 3, 13)), head))
    return t.select(forms.alias("gstin")).distinct().select("gstin", T.gstin_checksum_ok(F.col("gstin")).alias("ok"))


@query("detected_currency", "SELECT c_custkey, CASE n_regionkey WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' ELSE 'JPY' END AS code, CASE WHEN n_regionkey = 1 THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey")
def detected_currency(spark, d):
    j = A.load(spark, d, "customer").join(A.load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    symbol = F.get(F.array(*[F.lit(s) for s in ("₹", "$", "€", "£", "¥")]), F.col("n_regionkey"))
    c = T.detect_currency(F.concat(F.lit("to pay "), symbol, F.format_string("%.2f", F.abs("c_acctbal"))))
    return j.select("c_custkey", c["code"].alias("code"), c["confidence"].alias("confidence"))


@query("extracted_receipts", A.RECEIPTS_SQL)
def extracted_receipts(spark, d):
    f = extract.fields(A.receipts(spark, d), _as_of(spark, d), years_back=20)
    return extract.documents(f).select("receipt_id", "invoice_no", "date", "subtotal", "cgst", "sgst", "total", "arithmetic_ok")


def _as_of(spark, d):
    last = A.load(spark, d, "orders").agg(F.max("o_orderdate").cast("date")).first()[0]
    return F.lit(last)


def _judged(spark, d):
    receipts, truth = A.varied_receipts(spark, d)
    f = extract.fields(receipts, _as_of(spark, d), years_back=20)
    found = f.select("receipt_id", "field", F.coalesce("norm_str", F.col("norm_dec").cast("string"), F.col("norm_date").cast("string")).alias("value"))
    return evaluation.judged_fields(found, truth)


@query("extraction_report", "WITH " + A.JUDGED_SQL + """, k AS (SELECT field, tier, template, count(*) AS n, (count(*) - count(*) FILTER (WHERE error = 'MISSED'))::BIGINT AS extracted, (count(*) - count(error))::BIGINT AS correct FROM judged GROUP BY GROUPING SETS ((field), (field, tier), (field, template)))
SELECT field, tier, template, n, extracted, correct, correct AS lenient, CASE WHEN extracted > 0 THEN correct / extracted ELSE 0.0::DOUBLE END AS precision, correct / n AS recall, CASE WHEN correct > 0 THEN 2 * (correct / extracted) * (correct / n) / (correct / extracted + correct / n) ELSE 0.0::DOUBLE END AS f1 FROM k""")
def extraction_report(spark, d):
    return evaluation.extraction_report(_judged(spark, d))


@query("extraction_errors", "WITH " + A.JUDGED_SQL + " SELECT receipt_id, template, tier, field, error FROM judged WHERE error IS NOT NULL")
def extraction_errors(spark, d):
    return evaluation.extraction_errors(_judged(spark, d)).select("receipt_id", "template", "tier", "field", "error")


@query("claims_with_receipts", _with(A.CLAIMS_SQL, f"x AS ({A.RECEIPTS_SQL})") + "SELECT claim_id, x.invoice_no AS read_invoice, x.total AS read_total, claims.total = x.total AS same_total FROM claims LEFT JOIN x ON claim_id % 1000000000 = receipt_id")
def claims_with_receipts(spark, d):
    """Claims and what was read on their receipts; copies share a receipt."""
    read = extract.documents(extract.fields(A.receipts(spark, d), _as_of(spark, d), years_back=20)).select("receipt_id", F.col("invoice_no").alias("read_invoice"), F.col("total").alias("read_total"))
    c = A.claims(spark, d).withColumn("receipt_id", F.col("claim_id") % A.COPY)
    return c.join(read, "receipt_id", "left").select("claim_id", "read_invoice", "read_total", (F.col("total") == F.col("read_total")).alias("same_total"))


_SLIPS = "w AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 4 <> 3 THEN l_quantity::DECIMAL(12,2) END AS subtotal, CASE WHEN l_linenumber % 2 = 0 THEN 1.25 END::DECIMAL(12,2) AS cgst, CASE WHEN l_linenumber % 2 = 0 THEN 1.25 END::DECIMAL(12,2) AS sgst, 2.5::DECIMAL(12,2) AS tax_total, (l_quantity + 2.5 + (l_partkey % 5) * 0.3)::DECIMAL(12,2) AS total FROM lineitem)"


@query("amounts_check", _with(_SLIPS) + """SELECT id, CASE WHEN known THEN expected END AS expected, CASE WHEN known THEN total - expected END::DECIMAL(12,2) AS gap, CASE WHEN NOT known THEN NULL WHEN abs(total - expected) <= greatest(0.02, round_even(total * 0.005, 2)) THEN 'ok' WHEN abs(total - expected) <= 1 THEN 'rounded' ELSE 'gap' END AS verdict
FROM (SELECT *, (coalesce(subtotal, 0) + CASE WHEN cgst IS NOT NULL THEN cgst + sgst ELSE tax_total END)::DECIMAL(12,2) AS expected, (subtotal IS NOT NULL)::INT + CASE WHEN cgst IS NOT NULL THEN 2 ELSE 1 END >= 2 AS known FROM w)""")
def amounts_check(spark, d):
    line = A.load(spark, d, "lineitem")
    dec, no = (lambda c: c.cast("decimal(12,2)")), F.col("l_linenumber")
    part = F.when(no % 2 == 0, F.lit("1.25").cast("decimal(12,2)"))
    w = line.select((F.col("l_orderkey") * 10 + no).alias("id"), F.when(no % 4 != 3, dec(F.col("l_quantity"))).alias("subtotal"), part.alias("cgst"), part.alias("sgst"), F.lit(None).cast("decimal(12,2)").alias("igst"), F.lit("2.50").cast("decimal(12,2)").alias("tax_total"), dec(dec(F.col("l_quantity")) + F.lit("2.5").cast("decimal(3,1)") + (F.col("l_partkey") % 5).cast("int") * F.lit("0.3").cast("decimal(2,1)")).alias("total"))
    return extract.amounts_check(w).select("id", "expected", "gap", "verdict")


_READ = ("vendor", "date", "total", "subtotal", "cgst", "sgst", "gstin", "invoice_no")


@query("reading_scores", f"""WITH f AS (SELECT l_orderkey AS receipt_id, l_linenumber AS attempt, i, field, ((l_partkey * 31 + i * 17) % 100)::INT AS conf, (l_suppkey + i) % 9 <> 0 AS found, CASE l_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS ok FROM lineitem, (SELECT unnest(range({len(_READ)})) AS i, unnest({list(_READ)}) AS field)),
g AS (SELECT receipt_id, attempt, coalesce(sum(conf) FILTER (WHERE found), 0) AS s, count(*) FILTER (WHERE found) AS n, count(*) FILTER (WHERE found AND field IN ('total', 'subtotal', 'cgst', 'sgst')) AS amounts, bool_and(ok) AS ok FROM f GROUP BY ALL)
SELECT receipt_id, attempt, round(s / 1000 + CASE WHEN ok THEN CASE WHEN amounts >= 3 THEN 0.3 ELSE 0.05 END WHEN ok IS NULL THEN 0 ELSE -0.1 END, 6)::DOUBLE AS score, coalesce(ok, FALSE) AND n >= 6 AND s >= 70 * n AS good FROM g""")
def reading_scores(spark, d):
    each = F.posexplode(F.array(*[F.lit(x) for x in _READ])).alias("i", "field")
    r = A.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_linenumber").alias("attempt"), "l_partkey", "l_suppkey", each)
    r = r.withColumns({"confidence": ((F.col("l_partkey") * 31 + F.col("i") * 17) % 100) / 100, "value": F.when((F.col("l_suppkey") + F.col("i")) % 9 != 0, "x"), "arithmetic_ok": F.when(F.col("l_partkey") % 3 == 0, True).when(F.col("l_partkey") % 3 == 1, False)})
    # hundredths: sums of confidences are then exact in any order
    r = r.withColumn("confidence", F.col("confidence").cast("decimal(6,2)"))
    return extract.reading_scores(r).select("receipt_id", "attempt", F.round(F.col("score").cast("double"), 6).alias("score"), "good")


@query("field_confidence")
def field_confidence(spark, d):
    f = extract.fields(A.receipts(spark, d), _as_of(spark, d), years_back=20)
    return f.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.count_if("needs_review").alias("n_review"))


@query("line_roles")
def line_roles(spark, d):
    return linemodel.confusion(*linemodel.trained(A.receipts(spark, d)))


@query("noisy_receipts")
def noisy_receipts(spark, d):
    return generators.degrade(A.receipts(spark, d), F.lit(2)).select("receipt_id", F.length("text").alias("n_chars"), F.size("char_conf").alias("n_conf"))


@query("generated_claims")
def generated_claims(spark, d):
    return generators.dataset(spark, 2000)


@query("sniffed_kinds", "SELECT * FROM (VALUES ('pdf'), ('png'), ('jpeg'), ('gif'), ('bmp'), ('tiff'), ('webp'), ('heic')) v(kind)")
def sniffed_kinds(spark, d):
    return receipts_io.sample_heads(spark).select(T.sniff(F.col("content")).alias("kind"))


#: The same queries by the whole engine (rare-token keys, fuzzy matching, text), for which there is no SQL.
WHOLE_ENGINE = (
    "duplicate_claims", "candidate_pairs", "pair_signals", "blocking_stats", "duplicate_groups", "prf_by_band", "recall_by_type", "precision_curve",
    "average_precision", "workload", "ablation", "flags", "review_queue", "approvable", "flags_of_either_side", "keep_resolutions", "pair_reasons",
)
QUERIES |= {f"{name}_full": partial(QUERIES[name], full=True) for name in WHOLE_ENGINE}
