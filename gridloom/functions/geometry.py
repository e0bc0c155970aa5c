"""Geometry as column expressions; all of them stay inside whole-stage code generation.

NaN sorts above every number in Spark, so x <= x1 is false for it with any
number x1, and closed ranges exclude it; predicates without an upper bound
exclude it by is_point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.schema import Rect

#: Fixed value: the sphere's radius in metres.
EARTH_RADIUS = 6378137.0


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _l(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def is_point(x, y) -> Column:
    x, y = _c(x), _c(y)
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[_c(v).cast("double").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def point_equals(x, y, qx, qy) -> Column:
    return (_c(x) == _l(qx)) & (_c(y) == _l(qy))


def point_hash(x, y) -> Column:
    return F.xxhash64(_c(x), _c(y))


def point_less(x, y, qx, qy) -> Column:
    """Lexicographic by x, then y."""
    return F.struct(_c(x).alias("a"), _c(y).alias("b")) < F.struct(_l(qx).alias("a"), _l(qy).alias("b"))


def point_envelope(x, y) -> Column:
    return rect(x, y, x, y)


def length(x, y) -> Column:
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y))


def distance2(x, y, qx, qy) -> Column:
    """Squared distance, as products so that it is the same to the last bit in any engine."""
    dx, dy = _c(x) - _l(qx), _c(y) - _l(qy)
    return dx * dx + dy * dy


def distance(x, y, qx, qy) -> Column:
    return F.sqrt(distance2(x, y, qx, qy))


def rect_contains_point(x, y, x0, y0, x1, y1) -> Column:
    """Closed on all sides."""
    x, y = _c(x), _c(y)
    return (x >= _l(x0)) & (x <= _l(x1)) & (y >= _l(y0)) & (y <= _l(y1))


def rect_intersects(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    return (_c(ax0) <= _c(bx1)) & (_c(ax1) >= _c(bx0)) & (_c(ay0) <= _c(by1)) & (_c(ay1) >= _c(by0))


def rect_contains_rect(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    return (_c(ax0) <= _c(bx0)) & (_c(bx1) <= _c(ax1)) & (_c(ay0) <= _c(by0)) & (_c(by1) <= _c(ay1))


def rect_disjoint(*sides) -> Column:
    return ~rect_intersects(*sides)


def rect_area(x0, y0, x1, y1) -> Column:
    return (_c(x1) - _c(x0)) * (_c(y1) - _c(y0))


def rect_union(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    return F.struct(F.least(_c(ax0), _c(bx0)).alias("x0"), F.least(_c(ay0), _c(by0)).alias("y0"), F.greatest(_c(ax1), _c(bx1)).alias("x1"), F.greatest(_c(ay1), _c(by1)).alias("y1"))


def circle_bbox(cx, cy, r) -> Column:
    cx, cy, r = _c(cx), _c(cy), _c(r)
    return rect(cx - r, cy - r, cx + r, cy + r)


def circle_contains_point(x, y, cx, cy, r) -> Column:
    return is_point(x, y) & (distance2(x, y, cx, cy) <= _l(r) * _l(r))


def point_text(x, y) -> Column:
    return F.format_string("(%s|%s)", _c(x), _c(y))


def rect_text(x0, y0, x1, y1) -> Column:
    return F.concat_ws(" ", point_text(x0, y0), point_text(x1, y1))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the sphere between points in degrees."""
    a, b = F.radians(_c(lat1)), F.radians(_l(lat2))
    dlat, dlon = (b - a) / 2, (F.radians(_l(lon2)) - F.radians(_c(lon1))) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(a) * F.cos(b) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def degree_boxes(lat0: float, lon0: float, metres: float) -> list[Rect]:
    """Rectangles of latitude (x) and longitude (y) outside which no point is within metres: a band of
    latitudes and, away from the poles, of longitudes, in parts if it crosses the antimeridian."""
    slack = 1e-9
    angle = metres / EARTH_RADIUS
    band = math.degrees(angle) * (1 + slack) + slack
    south, north = lat0 - band, lat0 + band
    top = math.radians(abs(lat0)) + angle
    if top >= math.pi / 2 * (1 - slack) or angle >= math.pi / 2:
        return [Rect(south, -math.inf, north, math.inf)]
    wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat0))))) * (1 + slack) + slack
    lo, hi = lon0 - wide, lon0 + wide
    out = [Rect(south, lo, north, hi)]
    if lo < -180:
        out.append(Rect(south, lo + 360, north, 360.0))
    if hi > 180:
        out.append(Rect(south, -360.0, north, hi - 360))
    return out


def degree_window(lat, lon, lat0: float, lon0: float, metres: float) -> Column:
    """degree_boxes as conjuncts on raw columns that can be pushed to the scan."""
    lat, lon = _c(lat), _c(lon)
    boxes = degree_boxes(lat0, lon0, metres)
    near = (lat >= boxes[0].x0) & (lat <= boxes[0].x1)
    if math.isinf(boxes[0].y1):
        return near & ~F.isnan(lon)
    inside = None
    for b in boxes:
        part = (lon >= b.y0) & (lon <= b.y1)
        inside = part if inside is None else inside | part
    return near & inside


def ring_envelope(ring) -> Column:
    ring = _c(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def closed_ring(ring) -> Column:
    """The ring with its first point repeated at the end, if it is not yet."""
    ring = _c(ring)
    return F.when(F.size(ring) == 0, ring).when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def ring_edges(ring) -> Column:
    """The edges of a closed ring as structs x1, y1, x2, y2."""
    ring = _c(ring)
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edge = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), edge)


def crosses(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the ray from a point to greater x crosses an edge."""
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)


def point_in_edges(x, y, edges) -> Column:
    """Even-odd rule over the edges of a ring; points on the boundary are unspecified."""
    x, y = _c(x), _c(y)
    hit = lambda e: crosses(x, y, e["x1"], e["y1"], e["x2"], e["y2"])
    return F.aggregate(_c(edges), F.lit(False), lambda odd, e: odd != F.coalesce(hit(e), F.lit(False)))


def point_in_ring(x, y, ring) -> Column:
    return point_in_edges(x, y, ring_edges(ring))
