"""A model of the sort key: error-bounded linear spline, and a radix table over its knots.

The model maps a key to its position in sorted order.  The greedy corridor keeps
every position of the distribution within eps of the spline.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.stats import cdf


def cross(ax: float, ay: float, bx: float, by: float) -> int:
    """On which side of a direction another one lies: 1 left, -1 right, 0 along it."""
    return int(np.sign(ax * by - ay * bx))


def greedy_spline(keys: np.ndarray, pos: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots on the points themselves; keys ascend strictly.  From a knot on, the corridor of slopes narrows
    point by point; the point before the first one outside it is the next knot.  Points are looked
    at in blocks that double."""
    n = len(keys)
    if n <= 2 or eps < 0:
        return keys.copy(), pos.copy()
    at, base = [0], 0
    while base < n - 1:
        low, high, i, size = -np.inf, np.inf, base + 1, 64
        while i < n:
            j = min(n, i + size)
            dx, dy = keys[i:j] - keys[base], pos[i:j] - pos[base]
            lows = np.maximum(low, np.maximum.accumulate((dy - eps) / dx))
            highs = np.minimum(high, np.minimum.accumulate((dy + eps) / dx))
            slope = dy / dx
            outside = (slope < np.append(low, lows[:-1])) | (slope > np.append(high, highs[:-1]))
            if outside.any():
                i += int(outside.argmax())
                break
            low, high, i, size = lows[-1], highs[-1], j, 2 * size
        base = n - 1 if i >= n else i - 1
        at.append(base)
    return keys[at], pos[at]


def compress(keys: np.ndarray, pos: np.ndarray, knots: int, tolerance: float = 0.01) -> tuple[np.ndarray, np.ndarray, float]:
    """The spline nearest to a wanted number of knots, by bisection over the error bound."""
    lo, hi = 0.0, float(pos[-1] - pos[0] + 1)
    best = (*greedy_spline(keys, pos, hi), hi)
    for _ in range(64):
        mid = (lo + hi) / 2
        k, p = greedy_spline(keys, pos, mid)
        if abs(len(k) - knots) < abs(len(best[0]) - knots):
            best = (k, p, mid)
        if abs(len(k) - knots) <= tolerance * knots:
            return k, p, mid
        lo, hi = (mid, hi) if len(k) > knots else (lo, mid)
    return best


def slopes(keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.diff(pos) / np.diff(keys)


class SplineModel:
    """Knots with a radix table of 2 ** bits + 2 first knots."""

    def __init__(self, keys: np.ndarray, pos: np.ndarray, bits: int = 10):
        self.keys, self.pos, self.bits = np.asarray(keys, float), np.asarray(pos, float), bits
        span = self.keys[-1] - self.keys[0] if len(self.keys) else 0.0
        self.scale = (1 << bits) / span if span > 0 else 0.0
        self.radix = np.searchsorted(self.prefix(self.keys), np.arange((1 << bits) + 2), side="left")

    def prefix(self, y: np.ndarray) -> np.ndarray:
        return ((np.asarray(y, float) - self.keys[0]) * self.scale).astype(np.int64)

    def segment(self, y: float) -> int:
        """The knot that ends the segment of y: a short search inside the radix window."""
        if y <= self.keys[0]:
            return min(1, len(self.keys) - 1)
        if y >= self.keys[-1]:
            return len(self.keys) - 1
        p = int(self.prefix(np.array([y]))[0])
        lo, hi = int(self.radix[p]), min(int(self.radix[p + 1]) + 1, len(self.keys))
        return max(1, lo + int(np.searchsorted(self.keys[lo:hi], y, side="left")))

    def estimate(self, y: np.ndarray) -> np.ndarray:
        """Positions by linear interpolation, clamped to both ends."""
        return np.interp(np.asarray(y, float), self.keys, self.pos)

    def position(self, y: float) -> float:
        """estimate() of one key, by its segment."""
        i = self.segment(y)
        a, b = max(0, i - 1), i
        if y <= self.keys[a] or a == b:
            return float(self.pos[a])
        if y >= self.keys[b]:
            return float(self.pos[b])
        return float(self.pos[a] + (self.pos[b] - self.pos[a]) * (y - self.keys[a]) / (self.keys[b] - self.keys[a]))

    def errors(self, keys: np.ndarray, pos: np.ndarray) -> tuple[float, float]:
        e = np.abs(self.estimate(keys) - pos)
        return float(e.mean()), float(e.max())


def spline_models(points: DataFrame, y: str = "y", by: str = "pid", eps: float = 32.0) -> DataFrame:
    """by, knots, first_knots, n_keys, last, avg_error, max_error: one model per partition (or file) of an
    index.  knots: of the last position of each key's run; first_knots: of its first position; last: the
    greatest position.

    A task holds the distinct keys of a partition, not its rows.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        keys, pos = group["key"].to_numpy(float), group["pos"].to_numpy(float)
        first = np.append(0.0, pos[:-1] + 1)
        out, errors = [], []
        for p in (pos, first):
            knots = greedy_spline(keys, p, eps)
            errors.append(SplineModel(*knots).errors(keys, p))
            out.append([[{"key": a, "pos": b} for a, b in zip(*knots, strict=True)]])
        return pd.DataFrame({"by": [group["by"].iloc[0]], "knots": out[0], "first_knots": out[1], "n_keys": [len(keys)], "last": [int(pos[-1])], "avg_error": [errors[0][0]], "max_error": [max(e for _, e in errors)]})

    kind, knots = dict(points.dtypes)[by], "array<struct<key:double,pos:double>>"
    runs = cdf(points, y, by).select(F.col(by).alias("by"), F.col(y).cast("double").alias("key"), "pos")
    return runs.groupBy("by").applyInPandas(fit, f"by {kind}, knots {knots}, first_knots {knots}, n_keys long, last long, avg_error double, max_error double").withColumnRenamed("by", by)
