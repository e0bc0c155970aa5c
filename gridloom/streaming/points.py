"""Streams of points: the stateless selections apply as they are; statistics per time window keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import is_point


def stream_points(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_bbox(points: DataFrame, t: str, width: str, late: str, x: str = "x", y: str = "y") -> DataFrame:
    """Bounding box and count per tumbling window; rows later than the watermark are dropped."""
    rows = points.where(is_point(x, y)).withWatermark(t, late)
    out = rows.groupBy(F.window(t, width)).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "min_x", "max_x", "min_y", "max_y", "n")
