"""Exact nearest neighbours, nearest first; ties go by the caller's keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.functions.schema import Circle, Point, Rect
from gridloom.operators.filters import circle_query, range_query
from gridloom.operators.stats import stats
from gridloom.sources.storage import stored


SALTS = 16
WIDE = 1_000_000  # rows beyond which a narrower circle is found first


def knn(src, q: Point, k: int, ties: tuple[str, ...] = (), x: str = "x", y: str = "y") -> DataFrame:
    """The k nearest rows with their squared distance d2: one job, per-task top k, then a merge.  An Index
    is asked by knn_windowed."""
    if not isinstance(src, DataFrame):
        return knn_windowed(src, q, k, ties)
    rows = src.where(g.is_point(x, y)).withColumn("d2", g.distance2(x, y, q.x, q.y))
    return rows.orderBy("d2", *(ties or (x, y))).limit(max(0, k))


def nearest(src, q: Point, ties: tuple[str, ...] = (), x: str = "x", y: str = "y") -> DataFrame:
    return knn(src, q, 1, ties, x, y)


def knn_windowed(src, q: Point, k: int, ties: tuple[str, ...] = (), x: str = "x", y: str = "y") -> DataFrame:
    """knn over a circle known to hold k rows; pays on an Index, which then reads few partitions.

    On an Index the manifest alone gives such a radius.  Where the partitions it meets are
    large, the k-th distance in those nearest to q gives a smaller one first.  On a
    DataFrame the first radius follows from the mean density; it doubles until the circle
    holds k rows or everything.
    """
    if not isinstance(src, DataFrame):
        x, y = src.x, src.y
        if k <= 0 or k >= src.stats().n:
            return knn(src.rows(None), q, k, ties, x, y)
        r = src.sure_radius(q, k)
        rows = {pid: n for pid, n, _ in src.boxes()}
        box = Circle(q.x, q.y, r).bounding_box()
        if sum(rows[p] for p in src.pids(box)) > WIDE:
            reach = sorted((math.hypot(max(b.x0 - q.x, 0, q.x - b.x1), max(b.y0 - q.y, 0, q.y - b.y1)), pid) for pid, _, b in src.boxes())
            near, held = [], 0
            while held < k:
                pid = reach[len(near)][1]
                near.append(pid)
                held += rows[pid]
            r = min(r, math.sqrt(knn(src.of(near), q, k, (), x, y).agg(F.max("d2")).first()[0]) * (1 + 1e-12))
        return knn(circle_query(src, Circle(q.x, q.y, math.nextafter(r, math.inf) * (1 + 1e-12))), q, k, ties, x, y)
    if k <= 0:
        return knn(src, q, 0, ties, x, y)
    s = stats(src, x, y)
    if not s.n or k >= s.n:
        return knn(src, q, k, ties, x, y)
    corners = [math.hypot(cx - q.x, cy - q.y) for cx in (s.box.x0, s.box.x1) for cy in (s.box.y0, s.box.y1)]
    r = math.sqrt(k * max(s.box.area, 1e-12) / (math.pi * s.n)) or max(corners)
    r += math.hypot(max(s.box.x0 - q.x, 0, q.x - s.box.x1), max(s.box.y0 - q.y, 0, q.y - s.box.y1))
    while r < max(corners):
        inside = circle_query(src, Circle(q.x, q.y, r), x, y)
        if inside.limit(k).count() >= k:
            return knn(inside, q, k, ties, x, y)
        r *= 2
    return knn(src, q, k, ties, x, y)


def knn_join(queries: DataFrame, points, k: int, ties: tuple[str, ...], qid: str = "qid", qx: str = "qx", qy: str = "qy", x: str = "x", y: str = "y") -> DataFrame:
    """For each query its k nearest points: qid, rank (from 1), d2 and the points' columns.

    Points and queries meet in square cells; a query looks at its 3 x 3 cells and is
    settled once its k-th neighbour is no farther than a cell's width, as all points
    nearer than that are in those cells.  Unsettled queries go on with cells of four
    times the width, or more where all of them lie outside the points' box.  Rounds are as many as the logarithm of the extent.  A query's
    candidates are first cut to k in each of SALTS parts, so that a dense cell does not
    meet in one task.  The cells that a round looks at go to the scan as one range; an
    Index drops the partitions outside it.
    """
    source, x, y = (points, x, y) if isinstance(points, DataFrame) else (points, points.x, points.y)
    points = points.where(g.is_point(x, y)) if isinstance(points, DataFrame) else points.rows(None)
    s = stats(points, x, y) if isinstance(source, DataFrame) else source.stats()
    left = queries.where(g.is_point(qx, qy)).select(F.col(qid).alias("qid"), F.col(qx).cast("double").alias("_qx"), F.col(qy).cast("double").alias("_qy"))
    if k <= 0 or not s.n:
        return left.join(points.limit(0)).select("qid", F.lit(0).alias("rank"), F.lit(0.0).alias("d2"), *points.columns).limit(0)
    reach = left.agg(F.min("_qx"), F.max("_qx"), F.min("_qy"), F.max("_qy")).first()
    box = s.box
    extent = max(box.x1 - box.x0, box.y1 - box.y0, *[abs(a - b) for a, b in ((reach[0] or 0, box.x1), (reach[1] or 0, box.x0), (reach[2] or 0, box.y1), (reach[3] or 0, box.y0))], 1e-9)
    # so wide that a cell holds about k points if they are spread evenly; along a line if the box is flat
    sides = [d for d in (box.x1 - box.x0, box.y1 - box.y0) if d > 0]
    w = max((math.prod(sides) * k / s.n) ** (1 / len(sides)) if sides else extent, extent / 2**20)
    out = None
    while True:
        last = w > extent
        cell = lambda c, w=w: F.floor(F.col(c) / w).cast("long")
        if out is not None:
            reach = left.agg(F.min("_qx"), F.max("_qx"), F.min("_qy"), F.max("_qy")).first()
        wide = 3 * w  # from a query to the end of its cells, and some more
        box = Rect(reach[0] - wide, reach[2] - wide, reach[1] + wide, reach[3] + wide) if reach[0] is not None else None
        cells = range_query(source, box, x, y) if box and not last else points
        cells = cells.withColumns({"_cx": cell(x), "_cy": cell(y)})
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        asks = left.select("qid", "_qx", "_qy", around.alias("o")).select("qid", "_qx", "_qy", (cell("_qx") + F.col("o.i")).alias("_cx"), (cell("_qy") + F.col("o.j")).alias("_cy"))
        dx, dy = F.col(x) - F.col("_qx"), F.col(y) - F.col("_qy")
        near = asks.join(cells, ["_cx", "_cy"]).withColumn("d2", dx * dx + dy * dy)
        part = F.pmod(F.xxhash64(x, y, *ties), F.lit(SALTS))
        first = F.row_number().over(Window.partitionBy("qid", "_part").orderBy("d2", *ties))
        near = near.withColumn("_part", part).withColumn("rank", first).where(F.col("rank") <= k).drop("_part")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", *ties))
        top = near.withColumn("rank", rank).where(F.col("rank") <= k)
        top = top if last else stored(top)
        found = top.select("qid", "rank", "d2", *points.columns)
        if last:
            return found if out is None else out.unionByName(found.join(left.select("qid"), "qid", "left_semi"))
        done = top.groupBy("qid").agg(F.max("rank").alias("n"), F.max("d2").alias("far")).where((F.col("n") == k) & (F.col("far") <= w * w)).select("qid")
        settled = found.join(done, "qid", "left_semi")
        out = settled if out is None else out.unionByName(settled)
        left = stored(left.join(done, "qid", "left_anti"))
        away = [F.greatest(F.lit(a) - F.col(c), F.col(c) - F.lit(b), F.lit(0.0)) for c, a, b in (("_qx", s.box.x0, s.box.x1), ("_qy", s.box.y0, s.box.y1))]
        gap = left.agg(F.min(F.sqrt(away[0] * away[0] + away[1] * away[1]))).first()[0]  # null: all are settled
        if gap is None:
            return out
        w = max(4 * w, w + 1.25 * gap)  # nothing is nearer than the gap to the points' box
