"""Joins of points with rectangles and polygons.

Points are a DataFrame, or an Index, which first drops the partitions that meet none
of the shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.functions.schema import Rect
from gridloom.sources.sinks import write_result

#: Rectangles whose partitions are looked up one by one, and that are broadcast; polygons and edges that become
#: one generated expression; vertices of all polygons that are broadcast.
FEW_RECTS, FEW_POLYGONS, FEW_EDGES = 10_000, 32, 512
FEW_VERTICES = 200_000


def _inside(x: str, y: str):
    return g.rect_contains_point(x, y, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))


def _points(points, rects: DataFrame, x: str, y: str) -> tuple[DataFrame, str, str]:
    """The points to look at and the names of their coordinates."""
    if isinstance(points, DataFrame):
        return points, x, y
    sides = rects.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).where("x0 <= x1 AND y0 <= y1 AND NOT isnan(x1) AND NOT isnan(y1)")
    boxes = sides.limit(FEW_RECTS + 1).collect()
    if len(boxes) > FEW_RECTS:
        boxes = sides.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).collect()
    return points.rows([Rect(*b) for b in boxes]), points.x, points.y


def rect_join_plain(points, rects: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points and rectangles (x0, y0, x1, y1 and more) by inequalities alone: a nested loop, for a handful of
    rectangles and to check the other join."""
    points, x, y = _points(points, rects, x, y)
    return points.join(rects, _inside(x, y))


def rect_join(points, rects: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The same pairs by an equi-join on grid cells with the inequalities as residual.

    Rectangles are put on the level of a grid, widths growing by LEVEL, at which they cover
    at most a few cells; a point has one cell on each level in use.  A pair meets in
    the point's cell alone, so none comes twice.  Inverted rectangles match nothing.
    """
    points, x, y = _points(points, rects, x, y)
    taken = {"_l", "_cx", "_cy"} & {*points.columns, *rects.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used by the join")
    rects = rects.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")) & ~F.isnan("x1") & ~F.isnan("y1"))
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    vertices = F.sum(F.size("ring")) if "ring" in rects.columns else F.count("*")
    size = rects.agg(F.count("*").alias("n"), vertices.alias("vertices"), F.percentile_approx(width, 0.5).alias("w"), F.percentile_approx(height, 0.5).alias("h"), F.max(width).alias("W"), F.max(height).alias("H")).first()
    if size["w"] is None:
        return points.join(rects, F.lit(False))
    w = size["w"] or size["W"] or 1.0
    h = size["h"] or size["H"] or 1.0
    levels = max(1, _levels(size["W"] / w), _levels(size["H"] / h))
    over = lambda a, b, side: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(b) - F.col(a)) / side, F.lit(0.5))) / LEVEL))
    rects = rects.withColumn("_l", F.greatest(over("x0", "x1", w), over("y0", "y1", h)).cast("int"))
    cell = lambda c, side: F.floor(F.col(c) / (F.lit(side) * F.pow(F.lit(2.0**LEVEL), F.col("_l")))).cast("long")
    spread = rects.withColumn("_cx", F.explode(F.sequence(cell("x0", w), cell("x1", w)))).withColumn("_cy", F.explode(F.sequence(cell("y0", h), cell("y1", h))))
    used, few = range(levels), size["n"] <= FEW_RECTS and size["vertices"] <= FEW_VERTICES
    if few:
        used = sorted(r["_l"] for r in rects.select("_l").distinct().collect())
    placed = points.where(g.is_point(x, y)).withColumn("_l", F.explode(F.array(*[F.lit(v) for v in used])))
    placed = placed.withColumns({"_cx": cell(x, w), "_cy": cell(y, h)})
    # few rectangles, of a few cells each, go to the points; else both sides are dealt by cell.  Points never go to all tasks.
    spread = F.broadcast(spread) if few else spread.hint("merge")
    return placed.join(spread, ["_l", "_cx", "_cy"]).where(_inside(x, y)).drop("_l", "_cx", "_cy")


#: Doublings between two levels of the grid: each level is one more copy of a point.
LEVEL = 2


def _levels(ratio: float) -> int:
    """Levels that sides up to ratio times the median's need; at most some 500, as doubles have exponents."""
    n = 1
    while ratio > 2.0 ** (LEVEL * (n - 1)):
        n += 1
    return n + 1  # one to spare for the rounding of logarithms


def rect_join_count(points, rects: DataFrame, rect_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """rect_id, n for every rectangle, those without points too."""
    hits = rect_join(points, rects, x, y).groupBy(rect_id).agg(F.count("*").alias("n"))
    return rects.select(rect_id).join(hits, rect_id, "left").select(rect_id, F.coalesce("n", F.lit(0)).alias("n"))


def _edges_in_code(polygons: DataFrame, x: str, y: str) -> Column | None:
    """Even-odd over the edges of a few polygons as one generated expression of poly_id; None if they are many."""
    rows = polygons.select("poly_id", g.ring_edges(g.closed_ring("ring")).alias("edges")).limit(FEW_POLYGONS + 1).collect()
    if len(rows) > FEW_POLYGONS or sum(len(r["edges"] or ()) for r in rows) > FEW_EDGES or len({r["poly_id"] for r in rows}) < len(rows):
        return None
    inside = None
    for r in rows:
        count = F.lit(0)
        for e in r["edges"] or ():
            if None not in e and e["y1"] != e["y2"]:
                count = count + F.when(g.crosses(F.col(x), F.col(y), *[F.lit(e[k]) for k in ("x1", "y1", "x2", "y2")]), 1).otherwise(0)
        here = F.col("poly_id") == F.lit(r["poly_id"])
        inside = F.when(here, count % 2 == 1) if inside is None else inside.when(here, count % 2 == 1)
    return F.lit(False) if inside is None else inside.otherwise(False)


def polygon_join(points, polygons: DataFrame, mode: str = "exact", x: str = "x", y: str = "y") -> DataFrame:
    """Points and polygons (poly_id, ring and more).  'mbr': by envelope; 'exact': even-odd on top of it."""
    if mode not in ("mbr", "exact"):
        raise ValueError(f"mode is 'mbr' or 'exact', not {mode!r}")
    shapes = polygons.withColumn("ring", g.closed_ring("ring")).withColumn("_e", g.ring_envelope("ring"))
    shapes = shapes.select("*", "_e.x0", "_e.y0", "_e.x1", "_e.y1").drop("_e")
    points, x, y = _points(points, shapes, x, y)
    test = _edges_in_code(polygons, x, y) if mode == "exact" else None
    if mode == "exact" and test is None:  # the edges are made once per polygon, not per pair
        shapes, test = shapes.withColumn("_edges", g.ring_edges("ring")), g.point_in_edges(x, y, "_edges")
    pairs = rect_join(points, shapes, x, y).drop("x0", "y0", "x1", "y1")
    return pairs if mode == "mbr" else pairs.where(test).drop("_edges")


def polygon_collect(points, polygons: DataFrame, mode: str = "exact", x: str = "x", y: str = "y") -> DataFrame:
    """poly_id, points: each polygon with its own points.  For results that fit a row; polygon_join gives
    the same pairs as rows of any number."""
    pairs = polygon_join(points, polygons, mode, x, y)
    x, y = (x, y) if isinstance(points, DataFrame) else (points.x, points.y)
    lists = pairs.groupBy("poly_id").agg(F.sort_array(F.collect_list(g.point(x, y))).alias("points"))
    return polygons.select("poly_id").join(lists, "poly_id", "left").select("poly_id", F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>")).alias("points"))


def run_join(points, shapes: DataFrame, kind: str = "rect", write: bool = False, path: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A join whose pairs are written to path if write is set, and returned in either case."""
    if kind not in ("rect", "polygon"):
        raise ValueError(f"kind is 'rect' or 'polygon', not {kind!r}")
    if write and not path:
        raise ValueError("a path is needed to write to")
    pairs = (rect_join if kind == "rect" else polygon_join)(points, shapes, **options)
    if not write:
        return pairs
    write_result(pairs, path, fmt)
    return pairs.sparkSession.read.schema(pairs.schema).parquet(path) if fmt == "parquet" else pairs
