"""Results and timing logs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    if fmt not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def timed(spark: SparkSession, label: str, path: str, action: Callable[[], object]) -> object:
    """Runs action and appends (label, milliseconds, time) to the log at path."""
    began = time.perf_counter()
    out = action()
    took = int((time.perf_counter() - began) * 1000)
    spark.createDataFrame([(label, took, time.time())], "label string, ms long, at double").coalesce(1).write.mode("append").json(path)
    return out
