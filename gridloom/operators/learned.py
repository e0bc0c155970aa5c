"""The learned index: a spline of y for each file of an index gives places of rows.

A file of an index is sorted by y, so a row's place in the file is its place in sorted
order.  build_models() fits an error-bounded spline of places to each file and keeps it
beside the data.  A query asks the models of the files that its rectangle meets for the
slice of places between its lower and upper y, widened by the models' error, and reads
rows of that slice only; the exact comparison decides.  The models of those files come to
the driver: as many rows as files, of few knots each.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.schema import Rect
from gridloom.operators.filters import range_query
from gridloom.operators.index import Index
from gridloom.operators.spline import SplineModel, spline_models

EPS = 32.0
_FILE, _PLACE = "_metadata.file_path", "_metadata.row_index"


def build_models(index: Index, eps: float = EPS, mode: str = "errorifexists") -> DataFrame:
    """Writes and returns pid, file, knots, first_knots, n_keys, last, avg_error, max_error: a model per file."""
    rows = index.data.select("pid", F.col(_FILE).alias("file"), index.y)
    files = rows.groupBy("file").agg(F.first("pid").alias("pid"))
    files.join(spline_models(rows, index.y, "file", eps), "file").write.mode(mode).parquet(f"{index.path}/model")
    return models(index)


def models(index: Index) -> DataFrame:
    return index.spark.read.parquet(f"{index.path}/model")


def _spline(knots) -> SplineModel:
    return SplineModel(np.array([k["key"] for k in knots]), np.array([k["pos"] for k in knots]))


def slices(index: Index, rect: Rect) -> list[tuple[str, int, int]]:
    """(file, first place, last place) that can hold y of the rectangle, in files of the partitions it meets."""
    out = []
    for r in models(index).where(F.col("pid").isin(index.pids(rect))).collect():
        first, last, slack = _spline(r["first_knots"]), _spline(r["knots"]), r["max_error"] + 1
        if rect.y0 <= last.keys[-1] and rect.y1 >= last.keys[0]:
            out.append((r["file"], max(0, math.floor(first.position(rect.y0) - slack)), min(r["last"], math.ceil(last.position(rect.y1) + slack))))
    return out


def learned_range_query(index: Index, rect: Rect) -> DataFrame:
    """range_query over the slices that the models give."""
    places = index.spark.createDataFrame(slices(index, rect), "_file string, _lo long, _hi long")
    rows = index.data.where(F.col("pid").isin(index.pids(rect))).select("*", F.col(_FILE).alias("_file"), F.col(_PLACE).alias("_place"))
    rows = rows.join(F.broadcast(places), "_file").where("_place BETWEEN _lo AND _hi")  # a row per file of the partitions met
    return range_query(rows, rect, index.x, index.y).drop("pid", "_file", "_place", "_lo", "_hi")


def count_bound(index: Index, rect: Rect) -> int:
    """At least as many rows as range_query gives, from manifest and models alone."""
    return sum(hi - lo + 1 for _, lo, hi in slices(index, rect))
