"""Perceptual hashes of images, as Spark's image reader decodes them (no other library is needed)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SIDE, LOW = 32, 8
_K = np.arange(SIDE)
_COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * _K + 1) / (2 * SIDE))


def _means(gray: np.ndarray, side: int) -> np.ndarray:
    """Means of `side` near-equal strips along the first axis."""
    edge = np.linspace(0, len(gray), side + 1)
    lo = np.minimum(np.floor(edge[:-1]).astype(int), len(gray) - 1)
    hi = np.maximum(np.ceil(edge[1:]).astype(int), lo + 1)
    total = np.concatenate([np.zeros((1, *gray.shape[1:])), np.cumsum(gray, axis=0)])
    return (total[hi] - total[lo]) / (hi - lo).reshape(-1, *[1] * (gray.ndim - 1))


def phash(height: int, width: int, channels: int, data: bytes) -> int | None:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 gray image exceed their median; null if unreadable."""
    pixels = np.frombuffer(data, dtype=np.uint8)
    if height < 1 or width < 1 or channels not in (1, 3, 4) or len(pixels) != height * width * channels:
        return None
    x = pixels.reshape(height, width, channels).astype(np.float64)
    gray = x[:, :, 0] if channels == 1 else x[:, :, :3] @ np.array([0.114, 0.587, 0.299])  # blue, green, red
    small = _means(_means(gray, SIDE).T, SIDE).T
    c = _COSINES @ small @ _COSINES.T
    bits = (c > np.median(c)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


@F.pandas_udf(LongType())
def phash_udf(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Of the columns height, width, nChannels and data of spark.read.format("image")."""
    return pd.Series([None if d is None or pd.isna(h) else phash(int(h), int(w), int(n), d) for h, w, n, d in zip(height, width, channels, data)], dtype="Int64")
