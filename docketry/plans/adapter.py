"""Claims and receipts over order tables, as DataFrames and as the same SQL.

An order is a claim: customer = employee, first line's supplier = vendor. Orders in status P come twice, as
known duplicates: unchanged, retyped, a day later, or by the next employee, in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

COPY = 1_000_000_000
CURRENCY_OF_REGION = ("INR", "USD", "EUR", "GBP", None)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line, cust, nation, supp = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "nation", "supplier"))
    vendor = line.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("suppkey"))
    base = orders.join(vendor, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    base = base.join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(supp.select("s_suppkey", "s_name"), F.col("suppkey") == F.col("s_suppkey"), "left")
    currency = F.get(F.array(*[F.lit(c) for c in CURRENCY_OF_REGION]), F.col("n_regionkey"))
    day = F.col("o_orderdate").cast("date")
    rejected = F.col("o_orderstatus") == "F"
    one = base.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("employee_id"), F.col("s_name").alias("vendor_raw"), F.concat(F.lit("V"), F.col("suppkey").cast("string")).alias("vendor_canonical"),
        F.when(F.col("suppkey") % 3 == 0, F.concat(F.lit("G"), F.col("suppkey").cast("string"))).alias("gstin"), F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_no"), day.alias("date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total"), currency.alias("currency"), F.timestamp_add("DAY", F.lit(5), F.col("o_orderdate")).alias("submitted_at"),
        F.when(rejected, "REJECTED").when(F.col("o_orderstatus") == "O", "SUBMITTED").otherwise("NEEDS_INFO").alias("status"), F.when(F.col("o_orderstatus") != "O", F.timestamp_add("DAY", F.lit(8), F.col("o_orderdate"))).alias("decided_at"),
        ((F.col("o_orderkey") % 1000003) * F.lit(6700417) * F.lit(1009)).alias("phash"), F.concat_ws(" ", "s_name", "o_orderpriority").alias("text"), "o_orderstatus",
    )
    kind = F.col("claim_id") % 4
    copy = one.where("o_orderstatus = 'P'").select(
        (F.col("claim_id") + COPY).alias("claim_id"), F.when(kind == 3, F.col("employee_id") + 1).otherwise(F.col("employee_id")).alias("employee_id"), "vendor_raw", "vendor_canonical", "gstin",
        F.when(kind == 1, F.concat("invoice_no", F.lit("X"))).otherwise(F.col("invoice_no")).alias("invoice_no"), F.when(kind == 2, F.date_add("date", 1)).otherwise(F.col("date")).alias("date"),
        F.when(kind == 1, F.col("total") + F.lit("0.50").cast("decimal(12,2)")).otherwise(F.col("total")).cast("decimal(12,2)").alias("total"), "currency", F.timestamp_add("DAY", F.lit(20), F.col("submitted_at")).alias("submitted_at"),
        F.lit("SUBMITTED").alias("status"), F.lit(None).cast("timestamp").alias("decided_at"), "phash", "text", "o_orderstatus",
    )
    return one.unionByName(copy).drop("o_orderstatus")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, dup_type of the known duplicates."""
    k = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("PHOTO_REUSE", "RETYPED", "RESUBMIT_AFTER_REJECT", "OTHER_EMPLOYEE")]), (k % 4).cast("int"))
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(k.alias("a"), (k + COPY).alias("b"), kind.alias("dup_type"))


CLAIMS_SQL = f"""c_vendor AS (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS suppkey FROM lineitem GROUP BY l_orderkey),
c_one AS (SELECT o_orderkey AS claim_id, o_custkey AS employee_id, s_name AS vendor_raw, 'V' || suppkey AS vendor_canonical,
  CASE WHEN suppkey % 3 = 0 THEN 'G' || suppkey END AS gstin, 'INV-' || o_orderkey AS invoice_no, o_orderdate::DATE AS date, o_totalprice::DECIMAL(12,2) AS total,
  CASE n_regionkey WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' END AS currency, o_orderdate + INTERVAL 5 DAY AS submitted_at,
  CASE o_orderstatus WHEN 'F' THEN 'REJECTED' WHEN 'O' THEN 'SUBMITTED' ELSE 'NEEDS_INFO' END AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 8 DAY END AS decided_at,
  (o_orderkey % 1000003) * 6700417 * 1009 AS phash, concat_ws(' ', s_name, o_orderpriority) AS text, o_orderstatus
  FROM orders LEFT JOIN c_vendor ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON suppkey = s_suppkey),
claims AS (SELECT * EXCLUDE (o_orderstatus) FROM c_one UNION ALL
  SELECT claim_id + {COPY}, CASE WHEN claim_id % 4 = 3 THEN employee_id + 1 ELSE employee_id END, vendor_raw, vendor_canonical, gstin, CASE WHEN claim_id % 4 = 1 THEN invoice_no || 'X' ELSE invoice_no END,
  CASE WHEN claim_id % 4 = 2 THEN date + 1 ELSE date END, CASE WHEN claim_id % 4 = 1 THEN total + 0.50 ELSE total END, currency, submitted_at + INTERVAL 20 DAY, 'SUBMITTED', NULL, phash, text FROM c_one WHERE o_orderstatus = 'P'),
truth AS (SELECT o_orderkey AS a, o_orderkey + {COPY} AS b, CASE o_orderkey % 4 WHEN 0 THEN 'PHOTO_REUSE' WHEN 1 THEN 'RETYPED' WHEN 2 THEN 'RESUBMIT_AFTER_REJECT' ELSE 'OTHER_EMPLOYEE' END AS dup_type FROM orders WHERE o_orderstatus = 'P')"""

#: keys: claim_id, block, key of B1 to B5.
KEYS_SQL = """keys AS (
  SELECT claim_id, 'B1' AS block, regexp_replace(upper(invoice_no), '[^A-Z0-9]', '', 'g') AS key FROM claims WHERE length(regexp_replace(upper(invoice_no), '[^A-Z0-9]', '', 'g')) >= 4
  UNION SELECT claim_id, 'B2', concat_ws('|', coalesce(vendor_canonical, upper(vendor_raw)), coalesce(currency, ''), trunc(total)::BIGINT) FROM claims WHERE coalesce(vendor_canonical, vendor_raw, '') <> '' AND total IS NOT NULL
  UNION SELECT claim_id, 'B3', concat_ws('|', employee_id, date_diff('day', DATE '0001-01-01', date) + 1 + d) FROM claims, (SELECT unnest(range(-3, 4)) AS d) WHERE date IS NOT NULL
  UNION SELECT claim_id, 'B4', concat_ws('|', employee_id, coalesce(currency, ''), trunc(total / 50)::BIGINT + d, isoyear(date) || '-' || week(date)) FROM claims, (SELECT unnest(range(-1, 2)) AS d) WHERE date IS NOT NULL AND total IS NOT NULL
  UNION SELECT claim_id, 'B5', b || ':' || ((phash >> (21 * b)::INT) & 2097151) FROM claims, (SELECT unnest(range(3)) AS b) WHERE phash IS NOT NULL)"""

PAIRS_SQL = """small AS (SELECT block, key FROM keys GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40),
member AS (SELECT k.*, date FROM keys k JOIN small USING (block, key) JOIN claims USING (claim_id)),
pairs AS (SELECT DISTINCT x.claim_id AS a, y.claim_id AS b FROM member x JOIN member y ON x.block = y.block AND x.key = y.key AND x.claim_id < y.claim_id
  WHERE coalesce(abs(date_diff('day', x.date, y.date)) <= 180, TRUE))"""

#: scored: signals, score and band without text and fuzzy matching.
SCORED_SQL = """rec AS (SELECT p.a, p.b, regexp_replace(upper(x.invoice_no), '[^A-Z0-9]', '', 'g') AS ia, regexp_replace(upper(y.invoice_no), '[^A-Z0-9]', '', 'g') AS ib,
  x.total AS ta, y.total AS tb, x.date AS da, y.date AS db, x.currency AS ca, y.currency AS cb, x.vendor_canonical AS va, y.vendor_canonical AS vb, x.gstin AS ga, y.gstin AS gb, x.phash AS pa, y.phash AS pb,
  x.employee_id AS ea, y.employee_id AS eb, x.status AS sa, y.status AS sb, x.submitted_at AS ua, y.submitted_at AS ub, x.decided_at AS fa, y.decided_at AS fb
  FROM pairs p JOIN claims x ON p.a = x.claim_id JOIN claims y ON p.b = y.claim_id),
sig AS (SELECT *, CASE WHEN length(ia) < 4 OR length(ib) < 4 THEN NULL WHEN ia = ib THEN 1.0 ELSE 0.0 END::DOUBLE AS invoice,
  CASE WHEN ta IS NULL OR tb IS NULL THEN NULL WHEN ca <> cb THEN 0.0 WHEN abs(ta - tb) <= 0.01 THEN 1.0 WHEN greatest(ta, tb) = 0 THEN 1.0 WHEN abs(ta - tb) <= 1 OR abs(ta - tb) * 1000 <= greatest(ta, tb) * 5 THEN 0.95
    WHEN abs(ta - tb) * 100 >= greatest(ta, tb) * 5 THEN 0.0 ELSE 0.95 * (0.05 - abs(ta - tb)::DOUBLE / greatest(ta, tb)::DOUBLE) / 0.045 END::DOUBLE AS amount,
  CASE WHEN ga = gb THEN 1.0 WHEN va IS NOT NULL AND vb IS NOT NULL THEN (va = vb)::INT END::DOUBLE AS vendor,
  CASE WHEN da IS NULL OR db IS NULL THEN NULL WHEN abs(da - db) = 0 THEN 1.0 WHEN abs(da - db) <= 1 THEN 0.9 WHEN abs(da - db) <= 3 THEN 0.75 WHEN abs(da - db) <= 7 THEN 0.5 WHEN abs(da - db) <= 30 THEN 0.2 ELSE 0.0 END::DOUBLE AS date,
  CASE WHEN pa IS NULL OR pb IS NULL THEN NULL WHEN 1 - bit_count(xor(pa, pb)) / 64.0::DOUBLE >= 0.9 THEN 1 - bit_count(xor(pa, pb)) / 64.0::DOUBLE ELSE 0.0 END::DOUBLE AS image FROM rec),
rul AS (SELECT *, coalesce(ga = gb, FALSE) OR coalesce(va = vb, FALSE) AS sv, ea = eb AS se, coalesce(ca = cb, TRUE) AND abs(ta - tb) <= 0.01 AS sm, da = db AS sd FROM sig),
base AS (SELECT *, round(least(greatest((coalesce(invoice * 0.2233, 0) + coalesce(amount * 0.0827, 0) + coalesce(vendor * 0.1946, 0) + coalesce(date * 0.2232, 0) + coalesce(image * 0.0265, 0))
   / nullif((invoice IS NOT NULL)::INT * 0.2233::DOUBLE + (amount IS NOT NULL)::INT * 0.0827::DOUBLE + (vendor IS NOT NULL)::INT * 0.1946::DOUBLE + (date IS NOT NULL)::INT * 0.2232::DOUBLE + (image IS NOT NULL)::INT * 0.0265::DOUBLE, 0)
   * CASE WHEN ea <> eb THEN 0.88::DOUBLE ELSE 1 END, 0), 1), 4) AS s,
  length(ia) >= 4 AND ia = ib AND sv AS r1, se AND sv AND sd AND sm AS r2, coalesce(bit_count(xor(pa, pb)) <= 2, FALSE) AND se AND (sv OR sm) AS r3, se AND sv AND sd AND sm AND ia <> '' AND ib <> '' AND ia <> ib AS r4 FROM rul),
scored AS (SELECT *, CASE WHEN r1 OR r2 OR r3 THEN greatest(s, 0.92) ELSE s END AS score,
  CASE WHEN r1 OR r2 OR r3 THEN 'EXACT' WHEN s >= 0.92 THEN 'EXACT' WHEN s >= 0.78 THEN 'HIGH' WHEN s >= 0.62 THEN 'MEDIUM' WHEN s >= 0.45 THEN 'LOW' ELSE 'NONE' END AS band0,
  concat_ws(',', CASE WHEN r1 THEN 'SAME_INVOICE_SAME_VENDOR' END, CASE WHEN r2 THEN 'SAME_EMP_VENDOR_DATE_AMOUNT' END, CASE WHEN r3 THEN 'SAME_IMAGE d=' || bit_count(xor(pa, pb)) END, CASE WHEN r4 THEN 'SUSPECT_ALTERED_INVOICE_NO' END) AS rules0
  FROM base WHERE s >= 0.45 OR r1 OR r2 OR r3),
tagged AS (SELECT *, coalesce(ea = eb AND CASE WHEN ua > ub THEN sb IN ('REJECTED', 'NEEDS_INFO') AND ua > fb ELSE sa IN ('REJECTED', 'NEEDS_INFO') AND ub > fa END AND band0 <> 'NONE', FALSE) AS resub FROM scored),
found AS (SELECT a, b, score, CASE WHEN NOT resub THEN band0 ELSE CASE band0 WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'EXACT' END END AS band,
  concat_ws(',', nullif(rules0, ''), CASE WHEN resub THEN 'RESUBMIT_AFTER_REJECT' END) AS rules, invoice, amount, vendor, date, image, ea <> eb AS cross_emp FROM tagged)"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_id and text of a GST receipt for each order with lines, whose truth is in `receipt_truth`."""
    t = receipt_truth(spark, sf_dir)
    money = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    text = F.concat_ws(
        "\n", F.concat(F.col("vendor"), F.lit(" Traders")), F.lit("12 Market Road"), F.concat(F.lit("GSTIN: "), F.col("gstin")), F.lit("TAX INVOICE"),
        F.concat(F.lit("Invoice No: "), F.col("invoice_no")), F.concat(F.lit("Date: "), F.date_format("date", "dd-MM-yyyy")), "items", F.concat(F.lit("Total Qty: "), F.col("qty").cast("string")),
        F.concat(F.lit("Sub Total: ₹"), money("subtotal")), F.concat(F.lit("CGST @ 9%: "), money("tax")), F.concat(F.lit("SGST @ 9%: "), money("tax")), F.concat(F.lit("Grand Total: ₹"), money("total")), F.lit("Thank you, visit again"),
    )
    return t.select("receipt_id", text.alias("text"))


def receipt_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    item = F.concat(F.lit("Item "), F.col("l_partkey").cast("string"), F.lit("  "), F.col("l_quantity").cast("int").cast("string"), F.lit(" x  "), F.format_string("%.2f", F.col("l_extendedprice")))
    g = line.groupBy("l_orderkey").agg(F.sum(cents).alias("sub"), F.min(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("suppkey"), F.sum(F.col("l_quantity").cast("int")).alias("qty"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("t")))), lambda x: x["t"]), "\n").alias("items"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    t = g.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    tax = F.floor((F.col("sub") * 9 + 50) / 100).cast("long")
    pan = F.concat(F.lit("29AAGCB"), F.lpad((F.col("suppkey") % 10000).cast("string"), 4, "0"), F.lit("J1Z"))
    dec = lambda c: (c / 100).cast("decimal(12,2)")
    return t.select(
        F.col("l_orderkey").alias("receipt_id"), F.concat(F.lit("Supplier "), F.translate(F.col("suppkey").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("vendor"), F.concat(pan, T.gstin_check_digit(pan)).alias("gstin"),
        F.concat(F.lit("INV-"), F.date_format("date", "yyyy"), F.lit("-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("invoice_no"), "date", "items", "qty",
        dec(F.col("sub")).alias("subtotal"), dec(tax).alias("tax"), dec(F.col("sub") + 2 * tax).alias("total"),
    )


def varied_receipts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(receipt_id and text, long truth) of the receipts in five templates: as they are; without an invoice number; a day late on
    paper; with integrated tax in one line; without tax number and taxable amount."""
    t = receipt_truth(spark, sf_dir).withColumn("template", (F.col("receipt_id") % 5).cast("int"))
    money = lambda c: F.format_string("%.2f", c.cast("double"))
    is_ = lambda *k: F.col("template").isin(*k)
    day = F.when(is_(2), F.date_add("date", 1)).otherwise(F.col("date"))
    text = F.concat_ws(
        "\n", F.concat(F.col("vendor"), F.lit(" Traders")), F.lit("12 Market Road"), F.when(~is_(4), F.concat(F.lit("GSTIN: "), F.col("gstin"))), F.lit("TAX INVOICE"),
        F.when(~is_(1), F.concat(F.lit("Invoice No: "), F.col("invoice_no"))), F.concat(F.lit("Date: "), F.date_format(day, "dd-MM-yyyy")), "items", F.concat(F.lit("Total Qty: "), F.col("qty").cast("string")),
        F.when(~is_(4), F.concat(F.lit("Sub Total: ₹"), money(F.col("subtotal")))), F.when(is_(3), F.concat(F.lit("IGST @ 18%: "), money(2 * F.col("tax")))),
        F.when(~is_(3), F.concat(F.lit("CGST @ 9%: "), money(F.col("tax")))), F.when(~is_(3), F.concat(F.lit("SGST @ 9%: "), money(F.col("tax")))), F.concat(F.lit("Grand Total: ₹"), money(F.col("total"))), F.lit("Thank you, visit again"),
    )
    zero = F.lit(0).cast("decimal(12,2)")
    half, whole = F.when(is_(3), zero).otherwise(F.col("tax")), F.when(is_(3), (2 * F.col("tax")).cast("decimal(12,2)")).otherwise(zero)
    values = {"vendor": F.col("vendor"), "gstin": F.col("gstin"), "invoice_no": F.col("invoice_no"), "date": F.col("date"), "subtotal": F.col("subtotal"), "cgst": half, "sgst": half, "igst": whole, "total": F.col("total")}
    each = F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("truth")) for n, v in values.items()])
    tier = F.when(is_(0, 3), 0).otherwise(1).alias("tier")
    return t.select("receipt_id", text.alias("text")), t.select("receipt_id", "template", tier, F.explode(each).alias("x")).select("receipt_id", "template", "tier", "x.*")


#: judged: what the templates of varied_receipts make of each field.
JUDGED_SQL = """fld AS (SELECT unnest(['vendor', 'gstin', 'invoice_no', 'date', 'subtotal', 'cgst', 'sgst', 'igst', 'total']) AS field),
rcp AS (SELECT DISTINCT l_orderkey AS receipt_id, (l_orderkey % 5)::INT AS template, CASE WHEN l_orderkey % 5 IN (0, 3) THEN 0 ELSE 1 END AS tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
judged AS (SELECT *, CASE WHEN template = 1 AND field = 'invoice_no' OR template = 4 AND field = 'gstin' THEN 'MISSED' WHEN template = 2 AND field = 'date' THEN 'WRONG_VALUE' END AS error
  FROM rcp, fld WHERE CASE WHEN field IN ('cgst', 'sgst') THEN template <> 3 WHEN field = 'igst' THEN template = 3 ELSE TRUE END)"""

RECEIPTS_SQL = """SELECT l_orderkey AS receipt_id, 'INV' || '-' || strftime(o_orderdate, '%Y') || '-' || lpad(l_orderkey::VARCHAR, 8, '0') AS invoice_no, o_orderdate::DATE AS date,
  (sub / 100.0)::DECIMAL(12,2) AS subtotal, (((sub * 9 + 50) // 100) / 100.0)::DECIMAL(12,2) AS cgst, (((sub * 9 + 50) // 100) / 100.0)::DECIMAL(12,2) AS sgst,
  ((sub + 2 * ((sub * 9 + 50) // 100)) / 100.0)::DECIMAL(12,2) AS total, TRUE AS arithmetic_ok
  FROM (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sub FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey"""
