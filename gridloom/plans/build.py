"""Build drivers: one index, or one for each partitioner, with their times in a log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.operators import learned
from gridloom.operators.index import Index, build_index
from gridloom.operators.partition import METHODS
from gridloom.sources.sinks import timed


def build(points: DataFrame, path: str, method: str = "kdb", n: int = 100, x: str = "x", y: str = "y", with_models: bool = False, log: str | None = None) -> Index:
    """An index of points; with_models: with a spline per file.  log: a folder that gets label and milliseconds."""

    def make() -> Index:
        index = build_index(points, path, method, n, x, y)
        if with_models:
            learned.build_models(index)
        return index

    return timed(points.sparkSession, f"build {method}", log, make) if log else make()


def build_all(points: DataFrame, root: str, n: int = 100, methods: tuple[str, ...] = METHODS, **options) -> dict[str, Index]:
    """An index for each partitioner, in folders of their names under root."""
    return {m: build(points, f"{root}/{m}", m, n, **options) for m in methods}
