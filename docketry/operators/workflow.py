"""Claim workflow: transitions, guards, audit rows, flag upserts and the review queue.

Actions on a claim are applied in the order of time. A fold over one claim's actions sees only that
claim's rows: transitions come from an edge table small enough to be a map literal, and the fold is a
higher-order function, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("DRAFT", "SUBMITTED", "UNDER_REVIEW", "NEEDS_INFO", "APPROVED", "REJECTED")
# Status -> statuses that an action may lead to.
ALLOWED = {
    "DRAFT": ("SUBMITTED",),
    "SUBMITTED": ("UNDER_REVIEW", "NEEDS_INFO", "APPROVED", "REJECTED"),
    "UNDER_REVIEW": ("APPROVED", "REJECTED", "NEEDS_INFO"),
    "NEEDS_INFO": ("SUBMITTED", "UNDER_REVIEW", "REJECTED"),
    "APPROVED": (),
    "REJECTED": (),
}
DECIDED = ("APPROVED", "REJECTED")


def allowed(state: Column, to: Column) -> Column:
    table = F.create_map(*[x for s, t in ALLOWED.items() for x in (F.lit(s), F.array(*[F.lit(u) for u in t]).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[state], to), F.lit(False))


def apply_actions(actions: DataFrame, start: str = "DRAFT") -> DataFrame:
    """claim_id, step, at, to_status, from_status, accepted: each action against the state that the accepted ones before it
    made. actions: claim_id, at, seq, to_status."""
    ordered = actions.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "to_status"))).alias("xs"))
    zero = F.struct(F.lit(start).alias("state"), F.array().cast("array<struct<at:timestamp,seq:bigint,to_status:string,from_status:string,accepted:boolean>>").alias("log"))

    def step(acc: Column, x: Column) -> Column:
        ok = allowed(acc["state"], x["to_status"])
        entry = F.struct(x["at"].alias("at"), x["seq"].cast("long").alias("seq"), x["to_status"].alias("to_status"), acc["state"].alias("from_status"), ok.alias("accepted"))
        return F.struct(F.when(ok, x["to_status"]).otherwise(acc["state"]).alias("state"), F.concat(acc["log"], F.array(entry)).alias("log"))

    log = ordered.select("claim_id", F.aggregate("xs", zero, step).alias("r"))
    return log.select("claim_id", F.posexplode("r.log").alias("step", "e")).select("claim_id", "step", "e.*")


def current_state(applied: DataFrame) -> DataFrame:
    """claim_id, status, decided_at from applied actions."""
    ok = applied.where("accepted")
    return ok.groupBy("claim_id").agg(F.max_by("to_status", "step").alias("status"), F.max(F.when(F.col("to_status").isin(*DECIDED), F.col("at"))).alias("decided_at"))


def audit_rows(applied: DataFrame, actor: str = "system") -> DataFrame:
    """One row for each accepted transition."""
    return applied.where("accepted").select("claim_id", F.lit(actor).alias("actor"), "from_status", "to_status", "at")


def approvable(claims: DataFrame, flags: DataFrame) -> DataFrame:
    """Claims without an open EXACT or HIGH flag on which they are the newer side."""
    return claims.join(flags.where("status = 'OPEN' AND band IN ('EXACT', 'HIGH')").select("claim_id").distinct(), "claim_id", "left_anti")


def orient(pairs: DataFrame, claims: DataFrame, as_of: Column | None = None) -> DataFrame:
    """claim_id (the newer side), matched_id and the pair's other columns; a null submission counts as as_of (default: later than
    all). Pairs with an unknown side are dropped."""
    never = F.lit("9999-12-31").cast("timestamp")
    at = claims.select("claim_id", F.coalesce("submitted_at", never if as_of is None else as_of).alias("at"))
    x, y = at.select(F.col("claim_id").alias("a"), F.col("at").alias("at_a")), at.select(F.col("claim_id").alias("b"), F.col("at").alias("at_b"))
    rows = pairs.join(x, "a").join(y, "b")
    newer = F.col("at_a") >= F.col("at_b")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return rows.select(F.when(newer, F.col("a")).otherwise(F.col("b")).alias("claim_id"), F.when(newer, F.col("b")).otherwise(F.col("a")).alias("matched_id"), *rest)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows, and the old ones that none of them replaces."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_resolutions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Flags after a rescore: a resolved flag of the same orientation keeps its status; others are OPEN."""
    done = old.where("status <> 'OPEN'").select("claim_id", "matched_id", F.col("status").alias("old_status"))
    return new.join(done, ["claim_id", "matched_id"], "left").withColumn("status", F.coalesce("old_status", F.lit("OPEN"))).drop("old_status")


def resolve_flags(flags: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flags after decisions, claims that a confirmation rejects). decisions: claim_id, matched_id, verdict CONFIRMED or DISMISSED."""
    rows = flags.join(decisions, ["claim_id", "matched_id"], "left")
    out = rows.withColumn("status", F.coalesce("verdict", "status"))
    return out.drop("verdict"), out.where("verdict = 'CONFIRMED'").select("claim_id").distinct()


def flags_of_either_side(flags: DataFrame) -> DataFrame:
    """node and flag columns, once for each endpoint: an equi-joinable form of 'claim or matched claim'."""
    return flags.withColumn("node", F.explode(F.array_distinct(F.array("claim_id", "matched_id"))))


def compare_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, value_a, value_b, verdict of two field lists, by a full outer join on the name."""
    x, y = a.select("name", F.col("value").alias("value_a")), b.select("name", F.col("value").alias("value_b"))
    verdict = F.when(F.col("value_a").isNull() | F.col("value_b").isNull(), "absent").when(F.col("value_a") == F.col("value_b"), "identical").otherwise("differs")
    return x.join(y, "name", "full_outer").select("name", "value_a", "value_b", verdict.alias("verdict"))


def status_counts(claims: DataFrame) -> DataFrame:
    """Count and share of the largest for every status, absent ones as 0."""
    every = claims.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = claims.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    out = every.join(counted, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share_of_max", F.col("n") / F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1)))  # six rows


def money_by_currency(claims: DataFrame) -> DataFrame:
    return claims.groupBy("currency").agg(F.sum("total").alias("amount"), F.count(F.lit(1)).alias("n"))


def review_queue(claims: DataFrame, flags: DataFrame, sort: str = "risk", top: int = 200) -> DataFrame:
    """The first `top` undecided claims with flag counts and worst band, by risk, amount, confidence or date."""
    rank = F.array_position(F.array(*[F.lit(b) for b in ("NONE", "LOW", "MEDIUM", "HIGH", "EXACT")]), F.col("band"))
    per = flags.where("status = 'OPEN'").groupBy("claim_id").agg(F.count(F.lit(1)).alias("open_flags"), F.count_if(F.col("band").isin("EXACT", "HIGH")).alias("serious_flags"), F.max(rank).alias("risk"))
    rows = claims.where(~F.col("status").isin(*DECIDED)).join(per, "claim_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("open_flags", "serious_flags", "risk")})
    order = {"risk": [F.desc("risk"), F.desc("total")], "amount": [F.desc("total")], "confidence": [F.asc("doc_confidence")], "date": [F.desc("submitted_at")]}[sort]
    return rows.orderBy(*order, "claim_id").limit(top)


def foreign_currency(code: Column, confidence: Column, home: str = "INR") -> Column:
    """Clear evidence of another currency."""
    return (code != home) & (confidence >= 0.85)


def persist_flags(old: DataFrame, pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Flags after a scoring: found pairs replace flags of the same orientation, resolved ones keep their status."""
    new = keep_resolutions(orient(pairs, claims), old)
    return upsert(old, new, ["claim_id", "matched_id"])


def reject_confirmed(claims: DataFrame, confirmed: DataFrame, at: Column) -> DataFrame:
    """claims, undecided ones among `confirmed` (claim_id) rejected."""
    hit = claims.join(confirmed.select("claim_id").distinct().withColumn("__hit", F.lit(True)), "claim_id", "left")
    now = F.coalesce("__hit", F.lit(False)) & ~F.col("status").isin(*DECIDED)
    return hit.withColumns({"status": F.when(now, "REJECTED").otherwise(F.col("status")), "decided_at": F.when(now, at).otherwise(F.col("decided_at"))}).drop("__hit")


def submit(drafts: DataFrame, at: Column, least: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """(claims after submission, audit rows): a draft is submitted, and asked about where its document was read with less confidence."""
    unsure = F.coalesce("doc_confidence", F.lit(0.0)) < least
    claims = drafts.withColumn("status", F.when(F.col("status") != "DRAFT", F.col("status")).when(unsure, "NEEDS_INFO").otherwise("SUBMITTED")).withColumn("submitted_at", F.when(F.col("status") == "DRAFT", F.col("submitted_at")).otherwise(F.coalesce("submitted_at", at)))
    step = lambda a, b: F.struct(F.lit(a).alias("from_status"), F.lit(b).alias("to_status"))
    steps = F.when(unsure, F.array(step("DRAFT", "SUBMITTED"), step("SUBMITTED", "NEEDS_INFO"))).otherwise(F.array(step("DRAFT", "SUBMITTED")))
    audit = drafts.where("status = 'DRAFT'").select("claim_id", F.explode(steps).alias("x")).select("claim_id", "x.*", at.alias("at"))
    return claims, audit


AMOUNTS = ("subtotal", "cgst", "sgst", "igst", "total")
RESCORED = ("vendor", "gstin", "invoice_no", "date", "total")


def correct_fields(fields: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields after review, refused corrections with a reason). fields: receipt_id, field, value, needs_review; corrections:
    receipt_id, field, value. Values are trimmed and have to read as their field's type; `rescore` marks
    receipts whose claims have to be compared again."""
    v = F.trim("value")
    amount = F.replace(v, F.lit(","), F.lit("")).try_cast("decimal(12,2)")
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd"))
    clean = F.when(F.col("field").isin(*AMOUNTS), amount.cast("string")).when(F.col("field") == "date", day.cast("string")).otherwise(v)
    reason = F.when(F.coalesce(v, F.lit("")) == "", "blank").when(F.length(v) > 200, "too long").when(clean.isNull(), "invalid")
    judged = corrections.select("receipt_id", "field", "value", clean.alias("corrected"), reason.alias("reason"))
    good = judged.where("reason IS NULL").select("receipt_id", "field", "corrected", F.col("field").isin(*RESCORED).alias("rescore"))
    rows = fields.join(good, ["receipt_id", "field"], "left")
    out = rows.withColumns({"value": F.coalesce("corrected", "value"), "needs_review": F.col("needs_review") & F.col("corrected").isNull(), "rescore": F.coalesce("rescore", F.lit(False))}).drop("corrected")
    return out, judged.where("reason IS NOT NULL").drop("corrected")


def corrected_claims(claims: DataFrame, fields: DataFrame) -> DataFrame:
    """claims (receipt_id, total) with the corrected total of their receipt."""
    total = fields.where("field = 'total' AND rescore").select("receipt_id", F.col("value").cast("decimal(12,2)").alias("__t"))
    return claims.join(total, "receipt_id", "left").withColumn("total", F.coalesce("__t", "total")).drop("__t")


def visible_claims(claims: DataFrame, users: DataFrame) -> DataFrame:
    """user_id and the claims that each user may see: their own; reviewers all. users: user_id, reviewer."""
    own = claims.join(users.where("NOT reviewer").select("user_id"), F.col("employee_id") == F.col("user_id"))
    every = claims.crossJoin(users.where("reviewer").select("user_id"))  # every row, for each reviewer: that is the result
    return own.select("user_id", *claims.columns).unionByName(every.select("user_id", *claims.columns))


def next_id(rows: DataFrame, column: str, prefix: str, width: int = 5) -> DataFrame:
    """One row: the id behind the largest of a prefix."""
    number = F.when(F.col(column).startswith(prefix), F.substring(column, len(prefix) + 1, 18).try_cast("long"))
    return rows.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("n")).select(F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), width, "0")).alias("next_id"))


def with_flags(claims: DataFrame, flags: DataFrame) -> DataFrame:
    """claims with `flags`: matched_id and band of each flag on it, by matched_id; empty where there are none."""
    per = flags.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("matched_id", "band"))).alias("flags"))
    return claims.join(per, "claim_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast(dict(per.dtypes)["flags"])))
