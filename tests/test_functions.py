import datetime as dt
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions import fuzzy
from docketry.functions import registry as R
from docketry.functions import text as T


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.select(expr(F.col("s")).alias("x"), "i").orderBy("i").collect()]


def test_amount_conventions(spark):
    cases = {"1,234.56": "1234.56", "1.234,56": "1234.56", "1 234,56": "1234.56", "1,23,456.78": "123456.78", "34,39": "34.39", "(25.00)": "-25.00", "1,234": "1234.00", "-7.5": "-7.50", "abc": None, "": None, "₹12.00": "12.00", "€9,5": "9.50", "1'234.50": "1234.50", "1234.567": "1234567.00"}
    got = values(spark, list(cases), T.parse_amount)
    assert got == [None if v is None else D(v) for v in cases.values()]


def test_to_decimal_repairs_glyphs(spark):
    assert values(spark, ["Rs. 1,O5O.5O", "₹ 2B.00", "l2.5", None], T.to_decimal) == [D("1050.50"), D("28.00"), D("12.50"), None]


def test_dates(spark):
    rows = ["2025-03-14", "14/03/2025", "03/04/2025", "31-02-2025", "14 Mar 2025", "Mar 14, 2025", "14032025", "05.06.69", "05.06.70", "nope"]
    got = values(spark, rows, T.parse_date_multi)
    d = dt.date
    assert [g["date"] for g in got] == [d(2025, 3, 14), d(2025, 3, 14), d(2025, 4, 3), None, d(2025, 3, 14), d(2025, 3, 14), d(2025, 3, 14), d(2069, 6, 5), d(1970, 6, 5), None]
    assert [g["ambiguous"] for g in got] == [False, False, True, False, False, False, True, True, True, False]
    assert values(spark, ["03/04/2025"], lambda s: T.parse_date_multi(s, "MDY"))[0]["date"] == d(2025, 3, 4)


def test_gstin_check_and_repair(spark):
    good = "29AAGCB7383J1Z4"
    assert values(spark, [good, good[:-1] + "5", "99" + good[2:], None], T.gstin_checksum_ok) == [True, False, False, False]
    assert fuzzy.repair_gstin(good) == good
    assert fuzzy.repair_gstin("29AAGCB73B3J1Z4") == good  # B for 8
    assert fuzzy.repair_gstin("29AAGCB7383J12Z4") == good  # one character too many
    assert fuzzy.repair_gstin("XX") is None


def test_currency_ladder(spark):
    rows = ["Total USD 5", "pay € 5.00", "pay $5.00", "pay $5.00 HST 1", "CGST 9%", "nothing", "CAFE ZUR POST", None]
    got = values(spark, rows, T.detect_currency)
    assert [(g["code"], g["confidence"]) for g in got] == [("USD", 0.98), ("EUR", 0.95), ("USD", 0.60), ("CAD", 0.85), ("INR", 0.70), ("INR", 0.30), ("INR", 0.30), ("INR", 0.30)]


def test_normalisation(spark):
    assert values(spark, ["a  b\r\n\r\n\r\n\r\nRs. 5 – x  "], T.normalize_text) == ["a b\n\n₹ 5 - x"]
    assert values(spark, ["Sharma & Sons Pvt. Ltd.", None], T.norm_vendor)[1] == ""
    assert values(spark, ["inv-2025/001", None], T.norm_invoice_no) == ["INV2025001", ""]
    assert values(spark, ["INV-1", "TAX", "12/03/2025", "12.50", "AB", "A1B"], T.invoice_no_valid) == [True, False, False, False, False, True]


def test_file_kinds(spark):
    from docketry.sources.receipts_io import sample_heads

    assert {r[0] for r in sample_heads(spark).select(T.sniff(F.col("content"))).collect()} == {"pdf", "png", "jpeg", "gif", "bmp", "tiff", "webp", "heic"}


def test_fixed_weights_sum_to_one():
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in R.FIELD_WEIGHTS.values())
    assert abs(sum(R.SIGNAL_WEIGHTS.values()) - 1) < 1e-9


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_lcs_matches_plain(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    assert fuzzy.token_set_ratio(a, b) == pytest.approx(fuzzy.token_set_ratio(b, a))


def test_one_changed_character_is_ninety():
    assert fuzzy.indel_ratio("INV2025001", "INV2025007") == 90.0
    assert fuzzy.token_set_ratio("SHARMA TRADERS", "TRADERS SHARMA DELHI") == 100.0


def test_perceptual_hashes_survive_scaling_and_noise(spark):
    import numpy as np

    from docketry.functions import image

    rng = np.random.default_rng(2)
    soft = lambda a: sum(np.roll(np.roll(a, i, 0), j, 1) for i in range(-6, 7) for j in range(-6, 7)) / 169
    pictures = [np.clip(soft(rng.random((96, 64))) * 900 - 330, 0, 255).astype(np.uint8) for _ in range(2)]
    same = np.kron(pictures[0], np.ones((2, 2), dtype=np.uint8))
    noisy = np.clip(pictures[0].astype(int) + rng.integers(-6, 7, pictures[0].shape), 0, 255).astype(np.uint8)
    color = np.repeat(pictures[0][:, :, None], 3, axis=2)
    rows = [(i, x.shape[0], x.shape[1], 1 if x.ndim == 2 else 3, bytearray(x.tobytes())) for i, x in enumerate([*pictures, same, noisy, color])] + [(9, 4, 4, 1, bytearray(b"xx")), (10, None, None, None, None)]
    d = spark.createDataFrame(rows, "id int, height int, width int, nChannels int, data binary")
    h = {r["id"]: r["h"] for r in d.select("id", image.phash_udf("height", "width", "nChannels", "data").alias("h")).collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert apart(h[0], h[2]) <= 2 and apart(h[0], h[3]) <= 6 and apart(h[0], h[4]) <= 1 and apart(h[0], h[1]) > 10 and h[9] is None and h[10] is None


def test_retyped_vendors_differ_and_repeat(spark):
    from docketry.sources import generators

    names = ["Sharma Traders Pvt Ltd", "Verma & Sons", "Shell", "Om", "Lal and Co Ltd"]
    d = spark.createDataFrame([(n, i) for n in names for i in range(20)], "name string, salt int")
    got = [tuple(r) for r in d.select("name", "salt", generators.retype_vendor(F.col("name"), F.col("salt")).alias("typed")).collect()]
    assert got == [tuple(r) for r in d.select("name", "salt", generators.retype_vendor(F.col("name"), F.col("salt")).alias("typed")).collect()]
    typed = {n: {t for m, _, t in got if m == n} for n in names}
    assert typed["Om"] == {"Om"} and "Sharma Traders Private Limited" in typed["Sharma Traders Pvt Ltd"] and "Verma and Sons" in typed["Verma & Sons"]
    assert all(n not in typed[n] for n in names if n not in ("Om", "Shell"))
