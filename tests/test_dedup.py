import datetime as dt
import math
import random
from collections import Counter
from decimal import Decimal as D
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import dedup, evaluation, splits, workflow
from docketry.plans import adapter as A
from docketry.plans import catalogue

SCHEMA = "claim_id string, employee_id string, vendor_raw string, vendor_canonical string, gstin string, invoice_no string, date date, total decimal(12,2), currency string, submitted_at timestamp, status string, decided_at timestamp, phash long, text string"


def claim(cid, **kw):
    base = dict(claim_id=cid, employee_id="E001", vendor_raw="Sharma Traders", vendor_canonical="V001", gstin="29AAGCB7383J1Z4", invoice_no="INV-2025-001", date=dt.date(2025, 3, 14), total=D("1174.00"), currency="", submitted_at=dt.datetime(2025, 3, 20, 9), status="SUBMITTED", decided_at=None, phash=None, text="")
    return tuple((base | kw).values())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def pairs_of(df):
    return {(r["a"], r["b"]): r for r in df.collect()}


def test_same_bill_is_exact_and_grouped(spark):
    c = table(spark, claim("C1"), claim("C2", employee_id="E002"), claim("C3", invoice_no="ZZZZ99", vendor_canonical="V9", gstin=None, total=D("5"), date=dt.date(2024, 1, 1)))
    found = dedup.find_duplicates(c)
    p = pairs_of(found)
    assert set(p) == {("C1", "C2")} and p["C1", "C2"]["band"] == "EXACT" and "SAME_INVOICE_SAME_VENDOR" in p["C1", "C2"]["rules_fired"]
    assert {r["claim_id"]: r["duplicate_group"] for r in dedup.clusters(found).collect()} == {"C1": 1, "C2": 1}


def plain_text(texts):
    """Cosine of character 3- to 5-gram TF-IDF of each pair of texts that are not blank."""
    tf = {}
    for i, t in texts.items():
        grams = Counter()
        for w in t.lower().split():
            w = f" {w} "
            grams.update(w[k : k + n] for n in (3, 4, 5) for k in range(len(w) - n + 1))
        if grams:
            tf[i] = grams
    df = Counter(g for c in tf.values() for g in c)
    v = {i: {g: n * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in c.values())) for i, c in v.items()}
    return {(a, b): sum(x * v[b].get(g, 0) for g, x in v[a].items()) / norm[a] / norm[b] for a, b in combinations(sorted(v), 2)}


TEXTS = {"C1": "Sharma Traders total 1174 thank you", "C2": "sharma traders  TOTAL 1174 thanks", "C3": "Sharma Traders total 1174 thank you", "C4": " ", "C5": "taxi to the airport"}


def test_batch_has_the_text_signal(spark):
    c = table(spark, *[claim(i, text=t) for i, t in TEXTS.items()])
    got = {k: dict(r["signals"]).get("text") for k, r in pairs_of(dedup.find_duplicates(c)).items()}
    want = plain_text(TEXTS)
    assert set(got) == set(combinations(sorted(TEXTS), 2)) and {k for k, v in got.items() if v is not None} == set(want)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_missing_signals_are_no_evidence(spark):
    c = table(spark, claim("C1", invoice_no=None, date=None), claim("C2", invoice_no=None, date=None))
    pairs = spark.createDataFrame([("C1", "C2")], "a string, b string")
    r = dedup.scored_pairs(pairs, c).collect()[0]
    assert set(r["signals"]) == {"amount", "vendor"} and r["score"] == 1.0


def test_currencies_do_not_mix(spark):
    c = table(spark, claim("C1", currency="INR"), claim("C2", currency="USD", invoice_no="OTHER-77"))
    r = dedup.with_records(spark.createDataFrame([("C1", "C2")], "a string, b string"), c).select(dedup.s_amount().alias("x")).first()
    assert r["x"] == 0.0


def test_resubmission_raises_the_band(spark):
    c = table(spark, claim("C1", status="REJECTED", decided_at=dt.datetime(2025, 3, 22), invoice_no="A-100"), claim("C2", submitted_at=dt.datetime(2025, 3, 25), invoice_no="B-200", date=dt.date(2025, 3, 17)))
    r = pairs_of(dedup.find_duplicates(c))["C1", "C2"]
    assert r["tags"] == ["RESUBMIT_AFTER_REJECT"]


def test_texts_are_compared_only_where_they_can_count(spark, monkeypatch):
    far = dict(employee_id="E2", vendor_canonical="V9", gstin=None, total=D("5"), date=dt.date(2025, 5, 1))
    # C1 and C2 count anyhow, C1 and C3 by their texts, C1 and C4 in no way
    c = table(spark, claim("C1", text="taxi to the airport"), claim("C2", text="taxi"), claim("C3", invoice_no="ZZ-9", text="taxi to the airport", vendor_canonical="V9", gstin=None, total=D("5")), claim("C4", invoice_no="ZZ-9999", text="taxi to the airport", **far))
    pairs = spark.createDataFrame([("C1", "C2"), ("C1", "C3"), ("C1", "C4")], "a string, b string")
    want = {k: tuple(r) for k, r in pairs_of(dedup.scored_pairs(pairs, c, dedup.text_signal(pairs, c))).items()}
    asked, made = [], dedup.text_signal
    monkeypatch.setattr(dedup, "text_signal", lambda p, x: asked.extend(map(tuple, p.select("a", "b").collect())) or made(p, x))
    assert {k: tuple(r) for k, r in pairs_of(dedup.scored_with_text(pairs, c)).items()} == want
    assert sorted(asked) == [("C1", "C2"), ("C1", "C3")] and set(want) == set(asked)


def test_large_blocks_are_dropped(spark):
    rows = [claim(f"C{i:03d}", invoice_no="SAME-1", employee_id=f"E{i}", vendor_canonical=f"V{i}", gstin=None, total=D(i + 1)) for i in range(41)]
    assert dedup.candidate_pairs(table(spark, *rows)).count() == 0
    assert dedup.candidate_pairs(table(spark, *rows[:40])).count() == 780


def test_blocks_are_cut_before_the_exchange(spark):
    rows = [claim(f"C{i:03d}", invoice_no="SAME-1", employee_id=f"E{i}", vendor_canonical=f"V{i}", gstin=None, total=D(i + 1)) for i in range(40)]
    pairs = dedup.candidate_pairs(table(spark, *rows, rows[7]))  # a claim that comes twice counts once
    assert pairs.count() == 780
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def plain_splits(rows):
    out = set()
    for w, wt in rows:
        others = [r for r in rows if r[0] != w]
        for size in (2, 3, 4):
            for combo in combinations(sorted(others), size):
                if abs(sum(t for _, t in combo) - wt) * 100 <= wt:
                    out |= {tuple(sorted((w, c))) for c, _ in combo}
                    break
    return out


def test_split_claims_match_plain_search(spark):
    totals = [("C1", D("1000")), ("C2", D("400")), ("C3", D("600")), ("C4", D("150")), ("C5", D("250")), ("C6", D("335"))]
    c = table(spark, *[claim(i, total=t) for i, t in totals])
    assert {(r["a"], r["b"]) for r in dedup.split_suspects(c).collect()} == plain_splits(totals)


def test_split_claims_of_large_groups_match_plain_search(spark):
    """Groups of more than 8 claims are searched too: totals of few units, and others, some of which equal parts of a cent more."""
    whole = [(f"C{i:02d}", D(100 * (1 + i * 7 % 11))) for i in range(14)]
    mixed = [(f"D{i:02d}", D(["1000.00", "0.01", "333.34", "999.99", "-5.00", "666.67", "4.00"][i % 7]) + i // 7) for i in range(12)]
    c = table(spark, *[claim(i, total=t) for i, t in whole], *[claim(i, employee_id="E2", total=t) for i, t in mixed])
    want = plain_splits(whole) | plain_splits(mixed)
    assert want and {(r["a"], r["b"]) for r in dedup.split_suspects(c).collect()} == want


def test_split_search_with_ids_of_several_totals(monkeypatch):
    rng = random.Random(3)
    for at_once in (1 << 20, 20):
        monkeypatch.setattr(splits, "AT_ONCE", at_once)
        rows = sorted({(rng.randrange(10), rng.randrange(100, 2000)) for _ in range(12)})
        found = splits.combinations(np.unique([r for r, _ in rows], return_inverse=True)[1], np.array([c for _, c in rows]))
        names = sorted({r for r, _ in rows})
        for k, (w, parts) in zip(splits.SIZES, found):
            want = {}
            for r, c in rows:
                combos = [tuple(x for x, _ in p) for p in combinations([x for x in rows if x[0] != r], k) if abs(sum(t for _, t in p) - c) * 100 <= c]
                combos = [x for x in combos if len(set(x)) == k]
                if combos:
                    want[r] = min(*combos, want.get(r, combos[0]))
            assert {names[a]: tuple(names[x] for x in p) for a, p in zip(w.tolist(), parts.tolist())} == want


def test_split_takes_the_first_combination_of_an_id_in_two_groups(spark):
    # C9 is there twice, for two employees, and each group has two claims that add up to it
    group = lambda e, x, y: [claim(x, employee_id=e, total=D("400")), claim(y, employee_id=e, total=D("600")), claim("C9", employee_id=e, total=D("1000"))]
    c = table(spark, *group("E1", "C1", "C2"), *group("E2", "C3", "C4"))
    assert {(r["a"], r["b"]) for r in dedup.split_suspects(c).collect()} == {("C1", "C9"), ("C2", "C9")}


def test_threshold_gaming_starts_at_first_anchor(spark):
    days = [1, 20, 22, 27, 40]
    c = table(spark, *[claim(f"C{i}", total=D("4800"), date=dt.date(2025, 1, 1) + dt.timedelta(d)) for i, d in enumerate(days)])
    assert {(r["a"], r["b"]) for r in dedup.threshold_gaming(c, 5000).collect()} == {("C1", "C2"), ("C1", "C3")}


def test_incremental_agrees_with_batch(spark):
    old, new = table(spark, claim("C1"), claim("C2", invoice_no="INV-777", total=D("99"), date=dt.date(2025, 1, 1))), table(spark, claim("C3", employee_id="E009"))
    assert set(pairs_of(dedup.find_duplicates_for(new, old))) == {("C1", "C3")}


def test_weight_search_sees_every_candidate_pair(spark, monkeypatch):
    # two claims that share an image band and a text, and score below 0.45 under the standing weights
    c = table(spark, claim("C1", phash=0, text="taxi to the airport"), claim("C2", phash=(1 << 62) - (1 << 21), text="taxi to the airport", employee_id="E2", vendor_canonical="V9", gstin=None, invoice_no="ZZ-9999", total=D("5"), date=dt.date(2025, 5, 1)))
    monkeypatch.setattr(catalogue.A, "claims", lambda *a: c)
    monkeypatch.setattr(catalogue.A, "truth", lambda *a: spark.createDataFrame([("C1", "C2", "X")], "a string, b string, dup_type string"))
    rows = catalogue._all_signals(spark, "").collect()
    assert dedup.scored_pairs(dedup.candidate_pairs(c), c, dedup.text_signal(dedup.candidate_pairs(c), c)).count() == 0
    assert [(r["a"], r["b"], r["signals"]["text"], r["cross"]) for r in rows] == [("C1", "C2", 1.0, True)]
    only = spark.createDataFrame([(0, {k: float(k == "text") for k in dedup.R.SIGNAL_WEIGHTS})], "vec long, weights map<string,double>")
    monkeypatch.setattr(evaluation, "weight_vectors", lambda *a: only)
    assert [(r["vec"], r["f1"]) for r in catalogue.weight_search(spark, "").collect()] == [(0, 1.0)]


def test_tuning_computes_the_signals_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(f"C{i}", f"C{j}", {"invoice": 1.0}, False) for i in range(20) for j in range(i + 1, 20)]

    @F.udf("boolean")
    def counted(x):
        seen.add(1)
        return x

    signals = spark.createDataFrame(rows, "a string, b string, signals map<string,double>, cross boolean").withColumn("cross", counted("cross"))
    claims = spark.createDataFrame([(f"C{i}",) for i in range(20)], "claim_id string")
    truth = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    got = evaluation.tuned_weights(signals, truth, claims, evaluation.weight_vectors(spark, 3)).collect()
    assert len(got) == 1 and got[0]["dev_f1_default"] == 1.0 and seen.value == len(rows)


def test_whole_engine_queries(spark, monkeypatch):
    # C1 and C2 share only a rare token; C3 and C4 are retyped: the invoice number has one more letter
    lone = dict(phash=None, vendor_canonical=None, gstin=None, date=None, total=None)
    rows = [claim("C1", text="zeppelin", invoice_no=None, vendor_raw="Sharma Traders", **lone), claim("C2", text="zeppelin", invoice_no=None, vendor_raw="Traders Sharma", employee_id="E2", **lone)]
    rows += [claim("C3", invoice_no="INV-2025-777"), claim("C4", invoice_no="INV-2025-777X")]
    monkeypatch.setattr(catalogue.A, "claims", lambda *a: table(spark, *rows))
    assert set(pairs_of(catalogue.QUERIES["candidate_pairs"](spark, ""))) == {("C3", "C4")}
    assert set(pairs_of(catalogue.QUERIES["candidate_pairs_full"](spark, ""))) == {("C1", "C2"), ("C3", "C4")}
    got = pairs_of(catalogue.QUERIES["pair_signals_full"](spark, ""))
    assert (got["C1", "C2"]["vendor"], got["C1", "C2"]["text"]) == (1.0, 1.0) and (got["C3", "C4"]["invoice"], got["C3", "C4"]["text"]) == (0.8, None)
    assert pairs_of(catalogue.QUERIES["duplicate_claims_full"](spark, ""))["C1", "C2"]["score"] == 0.88
    assert {f"{n}_full" for n in catalogue.WHOLE_ENGINE} <= set(catalogue.QUERIES) - set(catalogue.SQL)


def test_incremental_meets_by_text_and_scores_it(spark):
    far = dict(employee_id="E777", invoice_no="ZZ-9999", total=D("5"), date=dt.date(2025, 2, 1))
    old = table(spark, *[claim(i, text=TEXTS[i]) for i in ("C1", "C2", "C4")], claim("C6", text="unlike anything", vendor_canonical="V9", gstin=None, **far))
    new = table(spark, claim("C9", text="thank sharma traders", employee_id="E5", invoice_no=None, total=None, date=None))
    got = {k: dict(r["signals"]).get("text") for k, r in pairs_of(dedup.find_duplicates_for(new, old)).items()}
    # C4 shares no key (its text is blank), C6 neither; C1 and C2 share only tokens
    near = {"C1": TEXTS["C1"], "C2": TEXTS["C2"], "C9": "thank sharma traders"}
    pairs = dedup.text_near(spark.createDataFrame([("C9", "C1"), ("C9", "C2")], "new_id string, claim_id string"), old.unionByName(new))
    said = {(r["claim_id"], "C9"): r["text"] for r in pairs.collect()}
    want = {k: v for k, v in plain_text(near).items() if k[1] == "C9"}
    assert set(got) == set(said) == set(want)
    assert all(abs(got[k] - v) < 1e-9 and abs(said[k] - v) < 1e-9 for k, v in want.items())


def test_closure_and_components(spark):
    t = spark.createDataFrame([(1, 2, "X"), (2, 3, "X"), (9, 8, "Y")], "a long, b long, dup_type string")
    got = {(r["a"], r["b"]): r["dup_type"] for r in dedup.transitive_closure(t).collect()}
    assert got == {(1, 2): "X", (2, 3): "X", (1, 3): "TRANSITIVE", (8, 9): "TRANSITIVE"}


def test_bands(spark):
    df = spark.createDataFrame([(0.92,), (0.9199,), (0.78,), (0.62,), (0.45,), (0.4499,)], "s double")
    assert [r[0] for r in df.select(dedup.band_for(F.col("s"))).collect()] == ["EXACT", "HIGH", "HIGH", "MEDIUM", "LOW", "NONE"]


def test_running_totals_match_plain(spark):
    rows = [(i, (i * 37 % 101) / 100, i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, conf double, ok boolean")
    got = {r["coverage"]: r["accuracy"] for r in evaluation.risk_coverage(df, "conf", "ok", "id").collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for c, acc in got.items():
        k = int(300 * c)
        assert abs(acc - sum(r[2] for r in order[:k]) / k) < 1e-12


def test_workflow_fold(spark):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    rows = [(1, t(1), 1, "SUBMITTED"), (1, t(2), 2, "SUBMITTED"), (1, t(3), 3, "APPROVED"), (1, t(4), 4, "REJECTED"), (2, t(1), 1, "APPROVED")]
    a = workflow.apply_actions(spark.createDataFrame(rows, "claim_id long, at timestamp, seq long, to_status string"))
    assert [r["accepted"] for r in a.orderBy("claim_id", "step").collect()] == [True, False, True, False, False]
    s = workflow.current_state(a).collect()
    assert [(r["claim_id"], r["status"]) for r in s] == [(1, "APPROVED")] and workflow.audit_rows(a).count() == 2


def test_approval_guard_looks_at_the_newer_side(spark):
    claims = spark.createDataFrame([(1,), (2,)], "claim_id long")
    flags = spark.createDataFrame([(2, 1, "OPEN", "EXACT")], "claim_id long, matched_id long, status string, band string")
    assert [r[0] for r in workflow.approvable(claims, flags).collect()] == [1]


@pytest.mark.parametrize("k", [1, 3, 7])
def test_incremental_takes_the_latest_of_hot_keys(spark, k):
    rng = random.Random(k)
    day = lambda: None if rng.random() < 0.2 else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(700))
    one = lambda i: claim(f"C{i:03d}", employee_id=f"E{i}", vendor_canonical=f"V{rng.randrange(3)}", invoice_no=None, total=None, date=day(), phash=None, text=rng.choice(["", "paper", "paper zebra", "apple paper"]))
    rows = [one(i) for i in range(90)]
    old, new = table(spark, *rows), table(spark, *rows[60:])
    keys = {}
    for r in dedup.incremental_keys(old).collect():
        keys.setdefault(r["claim_id"], set()).add((r["block"], r["key"]))
    date = {r[0]: r[6] for r in rows}
    want = set()
    for x in (r[0] for r in rows[60:]):
        near = [y for y in date if y != x and keys.get(x, set()) & keys.get(y, set()) and (None in (date[x], date[y]) or abs((date[x] - date[y]).days) <= 180)]
        want |= {(x, y) for y in sorted(near, key=lambda y: (date[y] is None, -(date[y] or dt.date.min).toordinal(), y))[:k]}
    assert len(want) > 20
    assert {tuple(r) for r in dedup.latest_candidates(new, old, k).collect()} == want


def test_incremental_makes_only_pairs_that_may_count(spark):
    rng = random.Random(5)
    some = lambda *x: rng.choice(x)

    def one(i):
        return claim(
            f"C{i:03d}", employee_id=some("E1", "E2", "E3", None), vendor_raw=some("Sharma Traders", "Traders Sharma", "Gupta", "", None), vendor_canonical=some("V1", "V2", "", None), gstin=some(None, None, "g1", "G1"),
            invoice_no=some(None, "A-1", f"INV-{rng.randrange(30)}", f"INV-{rng.randrange(30)}X"), total=some(None, D("0"), D("-50"), D(rng.randrange(1000, 1100)), D("1000.5")), currency=some("INR", "INR", "USD", None),
            date=some(None, dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(300))), phash=some(None, 0, 3, 1 << 40), text=some(None, " ", "paper zebra", "apple  Paper", "apple paper zebra"),
        )

    rows = [one(i) for i in range(120)]
    old, new = table(spark, *rows[:80]), table(spark, *rows[80:])
    every = old.unionByName(new)
    near = dedup.latest_candidates(new, old, 25).cache()
    pair = near.select(F.least("new_id", "claim_id").alias("a"), F.greatest("new_id", "claim_id").alias("b"))
    text = dedup.text_near(near, every).select(F.least("new_id", "claim_id").alias("a"), F.greatest("new_id", "claim_id").alias("b"), "text")
    want = pairs_of(dedup.tag_resubmissions(dedup.scored_pairs(pair.distinct(), every, text), every))
    got = pairs_of(dedup.find_duplicates_for(new, old, 25))
    assert set(got) == set(want) and len(want) > 50
    assert all((got[k]["score"], got[k]["band"], got[k]["rules_fired"]) == (want[k]["score"], want[k]["band"], want[k]["rules_fired"]) for k in want)
    made = dedup.screened(new, old, 25, dedup.R.KEEP_SCORE).count()
    assert len(want) <= made < near.count()


def test_empty_claims(spark, sf_dir):
    none = A.claims(spark, sf_dir).where("false")
    assert dedup.candidate_pairs(none).count() == 0


def plain_engine(claims):
    """The whole engine over a few claims, pair by pair: (a, b) -> (score, band, rules, signals)."""
    import re

    from docketry.functions import fuzzy
    from docketry.functions import registry as R

    inv = lambda c: re.sub("[^A-Z0-9]", "", (c["invoice_no"] or "").upper())
    words = lambda c: {w.lower() for w in re.findall("[A-Za-z]{4,}", c["text"] or "")} - set(R.TOKEN_STOP_WORDS)
    df = {}
    for c in claims:
        for w in words(c):
            df[w] = df.get(w, 0) + 1
    blocks = {}
    for c in claims:
        keys = set()
        if len(inv(c)) >= 4:
            keys.add(("B1", inv(c)))
        vendor = c["vendor_canonical"] or (c["vendor_raw"] or "").upper()
        if vendor and c["total"] is not None:
            keys.add(("B2", vendor, c["currency"] or "", int(c["total"])))
        if c["date"]:
            keys |= {("B3", c["employee_id"], c["date"].toordinal() + d) for d in range(-3, 4)}
            if c["total"] is not None:
                keys |= {("B4", c["employee_id"], c["currency"] or "", int(c["total"] / 50) + d, c["date"].isocalendar()[:2]) for d in (-1, 0, 1)}
        if c["phash"] is not None:
            keys |= {("B5", b, (c["phash"] >> (21 * b)) & (2**21 - 1)) for b in range(3)}
        keys |= {("B6", w) for w in sorted((w for w in words(c) if df[w] <= 5), key=lambda w: (df[w], w))[:3]}
        for k in keys:
            blocks.setdefault(k, []).append(c["claim_id"])
    by = {c["claim_id"]: c for c in claims}
    pairs = {p for m in blocks.values() if 2 <= len(m) <= 40 for p in combinations(sorted(m), 2)}
    pairs = {(a, b) for a, b in pairs if None in (by[a]["date"], by[b]["date"]) or abs((by[a]["date"] - by[b]["date"]).days) <= 180}
    grams = {}
    for c in claims:
        if (c["text"] or "").strip():
            g = grams[c["claim_id"]] = {}
            for w in c["text"].lower().split():
                w = f" {w} "
                for k in (3, 4, 5):
                    for i in range(len(w) - k + 1):
                        g[w[i : i + k]] = g.get(w[i : i + k], 0) + 1
    n, dfs = len(grams), {}
    for g in grams.values():
        for t in g:
            dfs[t] = dfs.get(t, 0) + 1
    vec = {}
    for i, g in grams.items():
        v = {t: k * (math.log((1 + n) / (1 + dfs[t])) + 1) for t, k in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {t: x / norm for t, x in v.items()}
    out = {}
    for a, b in pairs:
        x, y = by[a], by[b]
        s, ia, ib = {}, inv(x), inv(y)
        if len(ia) >= 4 and len(ib) >= 4:
            s["invoice"] = 1.0 if ia == ib else 0.8 if fuzzy.indel_ratio(ia, ib) >= 90 else 0.0
        if None not in (x["total"], y["total"]):
            d, big = abs(x["total"] - y["total"]), max(x["total"], y["total"])
            if x["currency"] and y["currency"] and x["currency"] != y["currency"]:
                s["amount"] = 0.0
            elif d <= D("0.01"):
                s["amount"] = 1.0
            elif d <= 1 or d * 1000 <= big * 5:
                s["amount"] = 0.95
            else:
                s["amount"] = 0.0 if d * 100 >= big * 5 else 0.95 * (0.05 - float(d) / float(big)) / 0.045
        va, vb = (x["vendor_raw"] or "").upper(), (y["vendor_raw"] or "").upper()
        gst = bool(x["gstin"]) and x["gstin"] == y["gstin"]
        close = fuzzy.token_set_ratio(va, vb)
        if gst:
            s["vendor"] = 1.0
        elif x["vendor_canonical"] and y["vendor_canonical"]:
            s["vendor"] = float(x["vendor_canonical"] == y["vendor_canonical"])
        elif va and vb:
            s["vendor"] = close / 100
        if x["date"] and y["date"]:
            days = abs((x["date"] - y["date"]).days)
            s["date"] = next((v for most, v in ((0, 1.0), (1, 0.9), (3, 0.75), (7, 0.5), (30, 0.2)) if days <= most), 0.0)
        dist = None if None in (x["phash"], y["phash"]) else (x["phash"] ^ y["phash"]).bit_count()
        if dist is not None:
            s["image"] = 1 - dist / 64 if 1 - dist / 64 >= 0.9 else 0.0
        if a in vec and b in vec:
            s["text"] = sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items())
        den = sum(R.SIGNAL_WEIGHTS[k] for k in s)
        score = sum(R.SIGNAL_WEIGHTS[k] * v for k, v in s.items()) / den if den else 0.0
        same = x["employee_id"] == y["employee_id"]
        score = round(min(max(score * (1 if same else 0.88), 0), 1), 4)
        vendor = gst or (x["vendor_canonical"] == y["vendor_canonical"] if x["vendor_canonical"] and y["vendor_canonical"] else bool(va and vb and close >= 90))
        money = None not in (x["total"], y["total"]) and abs(x["total"] - y["total"]) <= D("0.01") and (not x["currency"] or not y["currency"] or x["currency"] == y["currency"])
        day = x["date"] is not None and x["date"] == y["date"]
        rules = ["SAME_INVOICE_SAME_VENDOR"] * (len(ia) >= 4 and ia == ib and vendor)
        twin = same and vendor and day and money
        rules += ["SAME_EMP_VENDOR_DATE_AMOUNT"] * twin + [f"SAME_IMAGE d={dist}"] * (dist is not None and dist <= 2 and same and (vendor or money))
        forced = bool(rules)
        rules += ["SUSPECT_ALTERED_INVOICE_NO"] * (twin and bool(ia) and bool(ib) and ia != ib)
        band = "EXACT" if forced else next((name for name, least in R.BANDS if score >= least), "NONE")
        score = max(score, 0.92) if forced else score
        if score >= 0.45 or rules:
            out[a, b] = (score, band, rules, s)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_engine_matches_plain(spark, seed):
    rng = random.Random(seed)
    shops = [("Sharma Sweets Corner", "V001", "29AAA"), ("Verma Book House", None, None), ("Lakeside Cafe", "V003", None), ("Corner Sharma Sweets", None, None), ("", None, None)]
    stuff = "masala chai samosa notebook pencil petrol diesel taxi airport lodging breakfast stapler printer cartridge".split()
    claims = []
    for i in range(90):
        if claims and rng.random() < 0.45:  # a claim typed again
            c = dict(rng.choice(claims))
            for k, change in (("invoice_no", lambda v: v and v[:-1] + "9"), ("date", lambda v: v and v + dt.timedelta(rng.choice([0, 1, 5, 40, 300]))), ("total", lambda v: v and v + D(rng.choice(["0", "0.5", "20", "300"]))), ("employee_id", lambda v: v % 9 + 1), ("phash", lambda v: v and v ^ (1 << rng.randrange(60))), ("vendor_canonical", lambda v: None), ("vendor_raw", lambda v: v and v[:-3]), ("text", lambda v: v and v.replace("a", "o", 1))):
                if rng.random() < 0.3:
                    c[k] = change(c[k])
        else:
            name, canon, gst = rng.choice(shops)
            c = {"employee_id": rng.randrange(1, 10), "vendor_raw": name or None, "vendor_canonical": canon, "gstin": gst, "invoice_no": rng.choice([None, f"INV-2025-{rng.randrange(10**5):05d}", f"B{rng.randrange(99)}"]), "date": rng.choice([None, dt.date(2025, 1, 1) + dt.timedelta(rng.randrange(200))]), "total": rng.choice([None, D(rng.randrange(1000, 90000)) / 100]), "currency": rng.choice([None, "INR", "USD"]), "phash": rng.choice([None, rng.getrandbits(63)]), "text": rng.choice([None, " ", " ".join(rng.choices(stuff, k=6)), name + " " + " ".join(rng.choices(stuff, k=4))])}
        claims.append(c | {"claim_id": i, "submitted_at": dt.datetime(2025, 1, 1) + dt.timedelta(i), "status": "SUBMITTED", "decided_at": None})
    kind = "claim_id long, employee_id long, vendor_raw string, vendor_canonical string, gstin string, invoice_no string, date date, total decimal(12,2), currency string, submitted_at timestamp, status string, decided_at timestamp, phash long, text string"
    d = spark.createDataFrame([tuple(c[x.split()[0]] for x in kind.split(", ")) for c in claims], kind)
    want = plain_engine(claims)
    got = {(r["a"], r["b"]): r for r in dedup.find_duplicates(d).collect() if "SPLIT_SUSPECT" not in r["tags"]}
    assert set(got) == set(want) and len(want) > 20
    for p, (score, band, rules, signals) in want.items():
        r = got[p]
        assert r["score"] == pytest.approx(score, abs=1.01e-4) and r["rules_fired"] == rules and r["band"] == band, p
        assert r["signals"] == pytest.approx(signals, abs=1e-9)
    assert {"0.8"} <= {str(s.get("invoice")) for *_, s in want.values()} and any(0 < s.get("vendor", 0) < 1 for *_, s in want.values())


def test_reasons_list_rules_then_strong_signals(spark):
    rows = [(1, 2, {"invoice": 1.0, "text": 0.8, "date": 0.74, "amount": 0.95}, ["R"]), (3, 4, {"date": 0.2}, [])]
    d = spark.createDataFrame(rows, "a int, b int, signals map<string,double>, rules_fired array<string>")
    assert [r["reasons"] for r in dedup.reasons(d).orderBy("a").collect()] == [["R", "invoice=1.00", "amount=0.95", "text=0.80"], []]
