"""The index: points clustered by partition in Parquet, and a manifest of their boxes.

data/      one folder per pid, rows of a pid sorted by y, so that row groups and
           pages carry narrow ranges of y
manifest/  pid, n, min_x, max_x, min_y, max_y: one row per non-empty partition
model/     optional: a spline of y for each file of data (operators/learned.py)

A query reads the manifest on the driver (as many rows as partitions), keeps the
pids whose box meets the query, and scans only their folders.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import is_point
from gridloom.functions.schema import Point, Rect
from gridloom.operators.partition import layout
from gridloom.operators.stats import Stats, stats


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.json(f"{path}/meta", schema="x string, y string, method string, fields string").first()
        self.x, self.y, self.method = meta["x"], meta["y"], meta["method"]
        self.data = spark.read.schema(meta["fields"]).parquet(f"{path}/data")  # no job to find the schema
        self.manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        self._boxes: list | None = None

    def boxes(self) -> list:
        if self._boxes is None:
            self._boxes = [(r["pid"], r["n"], Rect(r["min_x"], r["min_y"], r["max_x"], r["max_y"])) for r in self.manifest.collect()]
        return self._boxes

    def stats(self) -> Stats:
        s = Stats(None, 0)
        for _, n, box in self.boxes():
            s = s.add(Stats(box, n))
        return s

    def pids(self, boxes: Rect | Iterable[Rect] | None) -> list[int]:
        """Partitions that meet one of the boxes; all of them for None."""
        wanted = [boxes] if isinstance(boxes, Rect) else None if boxes is None else list(boxes)
        return sorted(pid for pid, _, box in self.boxes() if wanted is None or any(box.intersects(b) for b in wanted))

    def rows(self, boxes: Rect | Iterable[Rect] | None = None) -> DataFrame:
        """Rows of the partitions that meet the boxes, which is a static partition filter."""
        return self.of(None if boxes is None else self.pids(boxes))

    def of(self, pids: list[int] | None) -> DataFrame:
        """Rows of partitions."""
        return (self.data if pids is None else self.data.where(F.col("pid").isin(pids))).drop("pid")

    def sure_radius(self, q: Point, k: int) -> float:
        """A radius around q that holds k rows: that of the partitions that lie wholly nearest to it."""
        reach = sorted((math.hypot(max(abs(b.x0 - q.x), abs(b.x1 - q.x)), max(abs(b.y0 - q.y), abs(b.y1 - q.y))), n) for _, n, b in self.boxes())
        for far, n in reach:
            k -= n
            if k <= 0:
                return far
        return math.inf

    def __eq__(self, other) -> bool:
        return isinstance(other, Index) and self.path == other.path

    def __hash__(self) -> int:
        return hash(self.path)

    def __repr__(self) -> str:
        return f"Index({self.path!r}, {self.method}, {len(self.boxes())} partitions, {self.stats().n} rows)"


MANIFEST = "pid int, n long, min_x double, max_x double, min_y double, max_y double"


def build_index(points: DataFrame, path: str, method: str = "kdb", n: int = 100, x: str = "x", y: str = "y", seed: int = 42, contiguous: bool = True, mode: str = "errorifexists", task_rows: int = 5_000_000) -> Index:
    """Writes the index.  A partition of more than task_rows rows is written by several tasks.

    Passes over points: one for box and count, one for the sample (tree methods), one for
    the data; the manifest reads two columns of what was written.
    """
    if "pid" in points.columns:
        raise ValueError("a column pid is in the way")
    spark = points.sparkSession
    good = points.where(is_point(x, y))
    s = stats(good, x, y)
    lay = layout(good, method, n, x, y, seed, contiguous, s)
    placed = good.withColumn("pid", lay.pid)
    salts = max(1, -(-s.n // max(1, lay.n) // task_rows))
    parts = max(1, lay.n) * salts
    place = F.col("pid") if salts == 1 else F.col("pid") * salts + F.pmod(F.xxhash64(x, y), F.lit(salts))
    dealt = placed.repartitionById(parts, place.cast("int")) if s.n else placed
    dealt.sortWithinPartitions("pid", y).write.mode(mode).partitionBy("pid").parquet(f"{path}/data")
    if not s.n:
        placed.write.mode("overwrite").parquet(f"{path}/data")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    data = spark.read.schema(placed.schema).parquet(f"{path}/data") if s.n else placed
    manifest(data, x, y).coalesce(1).write.mode(mode).parquet(f"{path}/manifest")
    spark.createDataFrame([(x, y, method, fields)], "x string, y string, method string, fields string").coalesce(1).write.mode(mode).json(f"{path}/meta")
    return Index(spark, path)


def manifest(placed: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """pid, n, min_x, max_x, min_y, max_y."""
    c = lambda v: F.col(v).cast("double")
    return placed.groupBy("pid").agg(F.count("*").alias("n"), F.min(c(x)).alias("min_x"), F.max(c(x)).alias("max_x"), F.min(c(y)).alias("min_y"), F.max(c(y)).alias("max_y"))
