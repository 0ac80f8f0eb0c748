"""Scalar functions on text, amounts, dates and identifiers, as column expressions.

Everything here is built in, so it stays inside generated code; only the compatibility
normalisation of Unicode (`nfkc`) needs Python and works on Arrow batches.
"""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import registry as R

MONEY = "decimal(12,2)"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: bound as the only element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def barrier(df: DataFrame) -> DataFrame:
    """df behind an observation: filters and projections above are not merged with the expressions below."""
    return df.observe(f"step-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def normalize_text(raw: Column, *, compatibility: bool = True) -> Column:
    """Canonical line ends, dashes, rupee marks and white space; null is empty."""
    t = F.coalesce(raw, F.lit(""))
    t = nfkc(t) if compatibility else t
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[‐-―−]", "-")
    t = F.regexp_replace(t, r"(?i)(?<![A-Za-z])(?:INR|Rs\.?|R\s?s\.?|₹)(?=\s*[\d,])", "₹")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?m)^ +| +$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_index_of(text: Column, offset: Column) -> Column:
    """0-based number of the line that holds a character offset."""
    head = F.substring(text, F.lit(1), F.greatest(offset, F.lit(0)).cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def fix_numeric_ocr(s: Column) -> Column:
    """Digits for the letters that scanners take for them; for numeric spans only."""
    return F.translate(s, "OoDlI|SsBZ", "0001115582")


def strip_currency(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "|".join(_quoted(x) for x in R.SYMBOLS), " ")


def parse_amount(raw: Column, kind: str = MONEY) -> Column:
    """An amount in any separator convention: the last point or comma is decimal if 1 or 2 digits follow it."""

    def number(body: Column) -> Column:
        def with_tail(tail: Column) -> Column:
            whole = F.regexp_replace(F.regexp_extract(body, r"^(.*)[.,][^.,]*$", 1), r"\D", "")
            all_digits = F.regexp_replace(body, r"[.,\s]", "")
            text = F.when(F.length(tail).between(1, 2), F.concat(F.lit("0"), whole, F.lit("."), tail)).otherwise(all_digits)
            return F.when(all_digits.rlike(r"^\d+$"), text.try_cast(kind))

        return let(F.regexp_replace(F.regexp_extract(body, r"[.,]([^.,]*)$", 1), r"\D", ""), with_tail)

    def signed(t: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(strip_currency(t), "[^\\d.,   ']", " "), "[  ]", " ")
        value = let(F.trim(F.replace(body, F.lit("'"), F.lit(""))), number)
        negative = t.startswith("-") | (t.startswith("(") & t.endswith(")"))
        return let(value, lambda v: F.when(negative, -v).otherwise(v))

    return let(F.trim(raw), signed)


def to_decimal(s: Column, kind: str = MONEY) -> Column:
    """parse_amount after symbols are stripped and digits repaired; else what is left with the last point decimal."""
    main = parse_amount(fix_numeric_ocr(strip_currency(s)), kind)
    rest = F.regexp_replace(F.trim(s), r"(?i)^\s*(?:INR|Rs\.?|R\s?s\.?)\s*", "")
    rest = F.regexp_replace(F.regexp_replace(fix_numeric_ocr(F.replace(rest, F.lit("₹"), F.lit(""))), r"[,\s]", ""), r"[^\d.\-+]", "")
    rest = F.regexp_replace(rest, r"\.(?=.*\.)", "")
    # digits, a point and one or two digits are read as they stand
    return F.when(s.rlike(r"^\d{1,9}\.\d{1,2}$"), s.try_cast(kind)).otherwise(F.coalesce(main, rest.try_cast(kind)))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def full_year(y: Column) -> Column:
    """Two digits below 70 are 2000s, else 1900s."""
    n = y.try_cast("int")
    return F.when(n < 70, n + 2000).when(n < 100, n + 1900).otherwise(n).cast("string")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(name)).cast("string"), F.lit("0"))


def parse_date_multi(s: Column, prefer: Column | str = "DMY") -> Column:
    """struct(date, fmt, ambiguous) of the first of five grammars that fits; date is null if none does."""
    t = F.trim(s)
    prefer = F.lit(prefer) if isinstance(prefer, str) else prefer
    g = lambda p, i: F.regexp_extract(t, p, i)
    ymd, two = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2}|\d{4})$"
    named, mdy_named = r"^(\d{1,2})[-\s]?([A-Za-z]{3})[a-z]*[-,\s]?\s*(\d{2,4})$", r"^([A-Za-z]{3})[a-z]*[\s'`.,\-]{0,3}(\d{1,2})(?:st|nd|rd|th)?[,;:.\s]+(\d{4})$"
    compact = r"^(\d{2})(\d{2})(\d{4})$"
    y2 = full_year(g(two, 3))
    dmy, mdy = _date(y2, g(two, 2), g(two, 1)), _date(y2, g(two, 1), g(two, 2))
    two_date = F.when(prefer == "DMY", F.coalesce(dmy, mdy)).otherwise(F.coalesce(mdy, dmy))
    out = lambda d, fmt, amb: F.struct(d.alias("date"), F.when(d.isNotNull(), fmt).alias("fmt"), (d.isNotNull() & amb).alias("ambiguous"))
    no = F.lit(False)
    return (
        F.when(t.rlike(ymd), out(_date(g(ymd, 1), g(ymd, 2), g(ymd, 3)), F.lit("ymd"), no))
        .when(t.rlike(two), out(two_date, F.when(prefer == "DMY", F.lit("dmy")).otherwise(F.lit("mdy")), F.coalesce(dmy != mdy, no)))
        .when(t.rlike(named) & _month(g(named, 2)).isNotNull(), out(_date(full_year(g(named, 3)), _month(g(named, 2)), g(named, 1)), F.lit("dMy"), no))
        .when(t.rlike(mdy_named) & _month(g(mdy_named, 1)).isNotNull(), out(_date(g(mdy_named, 3), _month(g(mdy_named, 1)), g(mdy_named, 2)), F.lit("Mdy"), no))
        .when(t.rlike(compact), out(_date(g(compact, 3), g(compact, 2), g(compact, 1)), F.lit("compact"), F.lit(True)))
        .otherwise(out(F.lit(None).cast("date"), F.lit(None).cast("string"), no))
    )


def date_plausible(d: Column, as_of: Column, years_back: int = 3, days_ahead: int = 7) -> Column:
    return d.between(F.date_sub(as_of, 365 * years_back), F.date_add(as_of, days_ahead))


def norm_invoice_no(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]", "")


_LEGAL = r"\b(?:PVT\.?|PRIVATE|LTD\.?|LIMITED|LLP|INC\.?|CO\.?|COMPANY|AND\s+SONS|&\s*SONS|ENTERPRISES?|TRADERS?|STORES?|AGENCIES)\b"


def norm_vendor(s: Column, *, compatibility: bool = False) -> Column:
    v = F.coalesce(s, F.lit(""))
    v = F.replace(F.upper(nfkc(v) if compatibility else v), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, f"(?i){_LEGAL}", " "), "[^A-Z0-9 ]", " "), r"\s+", " "))


def alpha_ratio(s: Column) -> Column:
    seen = F.length(F.regexp_replace(s, r"(?U)\s", ""))
    return F.when(seen > 0, F.length(F.regexp_replace(s, r"\P{L}", "")) / seen).otherwise(F.lit(0.0))


def caps_ratio(s: Column) -> Column:
    letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(s, r"\P{Lu}", "")) / letters).otherwise(F.lit(0.0))


def has_legal_suffix(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(f"(?i){_LEGAL}")


def _quoted(symbol: str) -> str:
    return "\\Q" + symbol + "\\E"


def detect_currency(text: Column, default: str = "INR") -> Column:
    """struct(code, confidence): ISO code, unique symbol at a number, shared symbol with a locale hint, shared
    symbol, hint, default."""
    t = F.coalesce(text, F.lit(""))
    any_symbol = "|".join(_quoted(s) for s in R.SYMBOLS)
    heads = "".join(sorted({s[0] for s in R.SYMBOLS}))  # most places fail at the first letter
    code = F.nullif(F.regexp_extract(F.upper(t), r"\b(" + "|".join(R.CURRENCIES) + r")\b", 1), F.lit(""))
    found = F.regexp_extract_all(t, F.lit(rf"(?:(?=[{heads}])(?:{any_symbol})[ \t]*(?=[\d(])|(?<=[\d)])[ \t]*(?:{any_symbol}))"), F.lit(0))
    found = F.transform(found, lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    owner = {s: [c for c, v in R.CURRENCIES.items() if s in v[0]] for s in R.SYMBOLS}
    alone = {s: o[0] for s, o in owner.items() if len(o) == 1 and s not in R.SHARED_SYMBOLS}
    names = F.create_map(*[F.lit(x) for kv in alone.items() for x in kv])
    hinted = [(t.rlike(p), c) for p, c in R.LOCALE_HINTS]

    def family(members: tuple[str, ...]) -> Column:
        out = None
        for hit, c in hinted:
            if c in members:
                out = F.when(hit, said(c, 0.85)) if out is None else out.when(hit, said(c, 0.85))
        return said(members[0], 0.60) if out is None else out.otherwise(said(members[0], 0.60))

    def said(c, confidence: float) -> Column:
        return F.struct((F.lit(c) if isinstance(c, str) else c).alias("code"), F.lit(confidence).alias("confidence"))

    def decided(seen: Column) -> Column:
        out = F.when(seen["code"].isNotNull(), said(seen["code"], 0.98)).when(seen["unique"].isNotNull(), said(seen["unique"], 0.95))
        for symbol, members in R.SHARED_SYMBOLS.items():
            out = out.when(seen["first"] == symbol, family(members))
        for hit, c in hinted:
            out = out.when(hit, said(c, 0.70))
        return out.otherwise(said(default, 0.30))

    def symbols(xs: Column) -> Column:
        unique = F.get(F.filter(F.transform(xs, lambda s: names[s]), lambda c: c.isNotNull()), F.lit(0))
        return F.struct(code.alias("code"), unique.alias("unique"), F.get(xs, F.lit(0)).alias("first"))

    return let(let(found, symbols), decided)


def symbol_for(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for c, v in R.CURRENCIES.items() for x in (c, v[0][0])])
    return F.coalesce(table[F.upper(code)], F.lit(""))


def format_amount(value: Column, code: Column) -> Column:
    decimals = F.create_map(*[F.lit(x) for c, v in R.CURRENCIES.items() for x in (c, v[3])])
    text = F.when(F.coalesce(decimals[F.upper(code)], F.lit(2)) == 0, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.coalesce(F.concat(symbol_for(code), text), F.lit(""))


def date_order_for(code: Column) -> Column:
    return F.when(F.upper(code) == "USD", F.lit("MDY")).otherwise(F.lit("DMY"))


def tier_of(pattern_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in R.PATTERN_TIERS.items() for x in kv])
    return F.when(F.coalesce(pattern_id, F.lit("")) == "", F.lit("S5")).otherwise(F.coalesce(table[pattern_id], F.lit("S4")))


def specificity(pattern_id: Column, has_currency: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in R.TIER_SCORES.items() for x in kv])
    tier = tier_of(pattern_id)
    return table[F.when((tier == "S2") & has_currency, F.lit("S1")).otherwise(tier)]


_CODE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def gstin_check_digit(first14: Column) -> Column:
    """The mod-36 check character of 14 characters: weights 1 and 2 in turn, digit sums in base 36."""
    at = lambda i: (F.instr(F.lit(_CODE), F.substring(first14, i, F.lit(1))) - 1).cast("long")
    product = lambda i: at(i) * F.when(i % 2 == 1, F.lit(1)).otherwise(F.lit(2))
    digits = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.floor(product(i) / 36) + product(i) % 36)
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.substring(F.lit(_CODE), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))


def gstin_checksum_ok(g: Column) -> Column:
    """Shape, state 1 to 38 and check character."""
    shape = g.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$")
    state = F.substring(g, 1, 2).try_cast("int").between(1, 38)
    return F.coalesce(shape & state & (gstin_check_digit(F.substring(g, 1, 14)) == F.substring(g, 15, 1)), F.lit(False))


def invoice_no_valid(value: Column, gstin: Column | None = None) -> Column:
    v = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    n = norm_invoice_no(v)
    same = F.lit(False) if gstin is None else F.coalesce(n == norm_invoice_no(gstin), F.lit(False))
    return (F.length(n) >= 3) & ~v.isin(*R.INVOICE_STOP_WORDS) & ~same & parse_date_multi(v)["date"].isNull() & ~v.rlike(r"^[\d,]+\.\d{2}$") & v.rlike(r"\d")


def has_currency_marker(text: Column, start: Column) -> Column:
    """A rupee sign among the four characters before an offset."""
    lo = F.greatest(start - 4, F.lit(0))
    return F.substring(text, (lo + 1).cast("int"), (start - lo).cast("int")).contains("₹")


def parsed_rate(text: Column, start: Column, end: Column) -> Column:
    lo = F.greatest(start - 40, F.lit(0))
    return F.nullif(F.regexp_extract(F.substring(text, (lo + 1).cast("int"), (end - lo).cast("int")), r"(\d{1,2}(?:\.\d+)?)\s*%", 1), F.lit("")).try_cast("double")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def positional_prior(place: Column, field: Column) -> Column:
    mu = F.coalesce(F.create_map(*[F.lit(x) for f, (m, _) in R.POSITION_PRIORS.items() for x in (f, m)])[field], F.lit(0.5))
    sigma = F.coalesce(F.create_map(*[F.lit(x) for f, (_, s) in R.POSITION_PRIORS.items() for x in (f, s)])[field], F.lit(0.40))
    return F.exp(-F.pow(place - mu, 2) / (2 * sigma * sigma))


def constant_confidence(text: Column, value: float = 0.95) -> Column:
    return F.array_repeat(F.lit(value), F.length(text))


def span_confidence(char_conf: Column, start: Column, end: Column, otherwise: float = 0.5) -> Column:
    """Mean confidence of a span's characters."""
    part = F.slice(char_conf, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    n = F.size(part)
    return F.when(char_conf.isNotNull() & (n > 0), F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(otherwise))


def remap_confidence(char_conf: Column, length: Column) -> Column:
    """Nearest-index stretch of confidences to another length."""
    m = F.size(char_conf)
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(char_conf, F.least(F.floor(i * m / length), m - 1).cast("int")))).otherwise(F.array().cast("array<double>"))


def amount_tolerance(total: Column) -> Column:
    """max(0.02, half a per cent, half-even to 2 places)."""
    return F.greatest(F.lit(0.02).cast(MONEY), F.bround(F.abs(total) * F.lit(0.005).cast("decimal(6,3)"), 2).cast(MONEY))


def number_on_line(line: Column) -> Column:
    """The last decimal number of a line, else its last number."""
    dec = F.regexp_extract_all(line, F.lit(r"\d+[.,]\d+"), F.lit(0))
    any_ = F.regexp_extract_all(line, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    return to_decimal(F.coalesce(F.try_element_at(dec, F.lit(-1)), F.try_element_at(any_, F.lit(-1))), "decimal(14,3)")


def number_after_word(lines: Column, word: str) -> Column:
    """number_on_line of the first line that names a word and has a number."""
    hits = F.filter(lines, lambda x: x.rlike(rf"(?i)\b{word}\b") & x.rlike(r"\d"))
    return number_on_line(F.get(hits, F.lit(0)))


def rate_times_quantity(lines: Column) -> Column:
    q = F.coalesce(number_after_word(lines, "volume"), number_after_word(lines, "qty"), number_after_word(lines, "quantity"))
    return F.round(number_after_word(lines, "rate") * q, 2).cast(MONEY)


def sniff(head: Column) -> Column:
    """File kind by its first bytes; null if unknown."""
    h = F.hex(F.substring(head, 1, 16))
    return (
        F.when(h.startswith("25504446"), "pdf").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("474946383"), "gif").when(h.startswith("424D"), "bmp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff")
        .when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 8).isin("68656963", "68656978", "6D696631", "68657663"), "heic")
    )


def shape_features(line: Column, index: Column, n: Column) -> Column:
    """Eight shape features of a line for the role model."""
    size = F.greatest(F.length(line), F.lit(1))
    return F.array(
        (index / F.greatest(n - 1, F.lit(1))).cast("double"), F.least(F.length(line) / 80, F.lit(1.0)).cast("double"),
        (F.length(F.regexp_replace(line, r"\D", "")) / size).cast("double"), alpha_ratio(line).cast("double"), caps_ratio(line).cast("double"),
        line.rlike(r"\d+[.,]\d{2}\b").cast("double"), line.contains(":").cast("double"), line.rlike("[₹$€£%]").cast("double"),
    )
