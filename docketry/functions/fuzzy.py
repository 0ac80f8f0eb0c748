"""Indel similarity and token-set similarity, as Arrow-batched functions for pairs that plain equality leaves open."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .registry import CONFUSIONS, GSTIN_SHAPE


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        m = at.get(ch, 0)
        row = (row + (row & m) | (row & ~m)) & full if m else row
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (len a + len b); 100 for two empty strings."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio among common tokens, common + rest of a, common + rest of b; 100 if one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    p, q = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    best = indel_ratio(p, q)
    return max(best, indel_ratio(both, p), indel_ratio(both, q)) if both else best


@F.pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def token_set(a: Column, b: Column) -> Column:
    """token_set_ratio; containment is settled by built-in array functions, and only the rest goes to Python."""
    x, y = F.array_distinct(F.split(F.trim(a), " +")), F.array_distinct(F.split(F.trim(b), " +"))
    empty = (F.trim(a) == "") | (F.trim(b) == "")
    held = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    open_ = a.isNotNull() & b.isNotNull() & ~empty & ~held
    slow = token_set_ratio_udf(F.when(open_, a), F.when(open_, b))
    return F.when(a.isNull() | b.isNull(), None).when(empty, F.lit(0.0)).when(held, F.lit(100.0)).otherwise(slow)


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_PRODUCTS = 4096


def _checksum_ok(g: str) -> bool:
    if len(g) != 15 or any(c not in _DIGITS for c in g) or not g[:2].isdigit() or not 1 <= int(g[:2]) <= 38:
        return False
    ok = all({"D": c.isdigit(), "L": c.isalpha(), "A": True, "Z": c == "Z"}[k] for c, k in zip(g, GSTIN_SHAPE))
    total = 0
    for i, c in enumerate(g[:14]):
        total += sum(divmod(_DIGITS.index(c) * (1 + i % 2), 36))
    return ok and g[12] != "0" and _DIGITS[-total % 36] == g[14]


def _candidates(ch: str, kind: str) -> str:
    if kind == "Z":
        return "Z"
    fits = {"D": str.isdigit, "L": str.isalpha, "A": str.isalnum}[kind]
    found = "".join(c for c in ch + CONFUSIONS.get(ch, "") if fits(c))
    return found or ch


def repair_gstin(value: str | None) -> str | None:
    """The first checksum-valid reading of 15 characters, over confusable characters; of 16 or 17, over one deletion each."""
    v = (value or "").upper()
    if not 15 <= len(v) <= 17:
        return None
    for reading in [v] if len(v) == 15 else [v[:i] + v[i + 1 :] for i in range(len(v))]:
        if len(reading) != 15:
            continue
        options = [_candidates(c, k) for c, k in zip(reading, GSTIN_SHAPE)]
        n = 1
        for o in options:
            n *= len(o)
        if n <= MAX_PRODUCTS:
            for combo in product(*options):
                g = "".join(combo)
                if _checksum_ok(g):
                    return g
    return None


@F.pandas_udf(StringType())
def repair_gstin_udf(v: pd.Series) -> pd.Series:
    return v.map(repair_gstin, na_action="ignore")
