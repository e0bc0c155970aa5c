"""Bounding box, count, cumulative distribution: map-side partial aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import is_point
from gridloom.functions.schema import Rect


@dataclass(frozen=True)
class Stats:
    """Envelope and count; add() joins those of two parts."""

    box: Rect | None
    n: int

    def add(self, other: Stats) -> Stats:
        if not self.n or not other.n:
            return other if not self.n else self
        a, b = self.box, other.box
        return Stats(Rect(min(a.x0, b.x0), min(a.y0, b.y0), max(a.x1, b.x1), max(a.y1, b.y1)), self.n + other.n)


def bbox_stats(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """min_x, max_x, min_y, max_y, n over rows with coordinates; nulls and 0 if there are none."""
    return points.where(is_point(x, y)).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.count("*").alias("n"))


def stats(points: DataFrame, x: str = "x", y: str = "y") -> Stats:
    """bbox_stats as a value: a single row comes to the driver."""
    r = bbox_stats(points, x, y).first()
    return Stats(Rect(float(r["min_x"]), float(r["min_y"]), float(r["max_x"]), float(r["max_y"])), r["n"]) if r["n"] else Stats(None, 0)


def cdf(points: DataFrame, y: str = "y", by: str | None = None, buckets: int = 1024) -> DataFrame:
    """For each distinct y the last 0-based position of its run in sorted order.

    Without by, distinct values are first summed in buckets of equal width, so that no
    task sorts all of them.
    """
    rows = points.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    if by:
        runs = rows.groupBy(by, y).agg(F.count("*").alias("n"))
        return runs.select(by, y, (F.sum("n").over(Window.partitionBy(by).orderBy(y)) - 1).alias("pos"))
    runs = rows.groupBy(y).agg(F.count("*").alias("n"))
    ends = runs.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(y) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)).otherwise(0)
    runs = runs.crossJoin(F.broadcast(ends)).select(y, "n", bucket.cast("long").alias("_b"))  # ends: one row
    sums = runs.groupBy("_b").agg(F.sum("n").alias("_n"))  # at most buckets + 1 rows
    before = sums.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("_b").orderBy(y))
    return runs.withColumn("_in", inside).join(F.broadcast(before), "_b").select(y, (F.col("_in") + F.col("_before") - 1).alias("pos"))


def model_errors(rows: DataFrame, estimate: str, truth: str) -> DataFrame:
    """Average and greatest absolute error."""
    e = F.abs(F.col(estimate) - F.col(truth))
    return rows.agg(F.avg(e).alias("avg_error"), F.max(e).alias("max_error"))
