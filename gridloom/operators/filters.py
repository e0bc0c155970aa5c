"""Range, point, distance, circle and space-time selections.

src is a DataFrame or an Index; an Index first drops partitions by their
bounding boxes.  The predicates are plain comparisons of raw columns, which
Parquet scans take over.  They are stateless and hold for streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.functions.schema import Circle, Point, Rect


def _open(src, box: Rect | None, x: str, y: str) -> tuple[DataFrame, str, str]:
    """The rows to look at and the names of their coordinates."""
    if isinstance(src, DataFrame):
        return src, x, y
    return src.rows(box), src.x, src.y


def range_query(src, rect: Rect, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside the closed rectangle; duplicates stay."""
    df, x, y = _open(src, rect, x, y)
    return df.where(g.rect_contains_point(x, y, rect.x0, rect.y0, rect.x1, rect.y1))


def range_count(src, rect: Rect, x: str = "x", y: str = "y") -> DataFrame:
    return range_query(src, rect, x, y).agg(F.count("*").alias("n"))


def point_query(src, p: Point, mode: str = "all", x: str = "x", y: str = "y") -> DataFrame:
    """mode='all': every row at the point; 'first': its coordinates once, if there is a row."""
    if mode not in ("all", "first"):
        raise ValueError(f"mode is 'all' or 'first', not {mode!r}")
    df, x, y = _open(src, p.envelope(), x, y)
    rows = df.where(g.point_equals(x, y, p.x, p.y))
    return rows if mode == "all" else rows.select(x, y).limit(1)


def exists(src, p: Point, x: str = "x", y: str = "y") -> bool:
    return not point_query(src, p, "first", x, y).isEmpty()


def distance_query(src, lat0: float, lon0: float, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows within metres on the sphere.  A degree window goes to the scan, the great circle decides.
    On an Index, x is the latitude and y the longitude, and partitions outside the window are dropped."""
    if metres < 0:
        raise ValueError("a distance is not negative")
    if not isinstance(src, DataFrame):
        src, lat, lon = src.rows(g.degree_boxes(lat0, lon0, metres)), src.x, src.y
    df = src
    return df.where(g.degree_window(lat, lon, lat0, lon0, metres) & (g.haversine(lat, lon, lat0, lon0) <= metres))


def circle_query(src, c: Circle, x: str = "x", y: str = "y") -> DataFrame:
    df, x, y = _open(src, c.bounding_box(), x, y)
    b = c.bounding_box()
    return df.where(g.rect_contains_point(x, y, b.x0, b.y0, b.x1, b.y1) & g.circle_contains_point(x, y, c.cx, c.cy, c.r))


def circle_count(src, c: Circle, x: str = "x", y: str = "y") -> DataFrame:
    return circle_query(src, c, x, y).agg(F.count("*").alias("n"))


def _time(t) -> Column:
    return F.lit(t).cast("timestamp") if isinstance(t, str) else F.lit(t)


def st_range_query(src, rect: Rect, t0, t1, t: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """Closed rectangle and closed time range."""
    return range_query(src, rect, x, y).where((F.col(t) >= _time(t0)) & (F.col(t) <= _time(t1)))


def st_point_query(src, p: Point, at, t: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """Rows at a point at a time."""
    return point_query(src, p, "all", x, y).where(F.col(t) == _time(at))
