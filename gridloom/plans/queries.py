"""Registered queries over the driver's tables, and the same in SQL.

Views: pts_li (x = extended price, y = quantity), pts_ev (user, value, time),
pts_geo (degrees from order keys), pts_emb, rects and two polygons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as g
from gridloom.functions.schema import Circle, Point, Rect
from gridloom.operators import filters, index, joins, learned, nearest, partition, spline, stats
from gridloom.plans import build
from gridloom.sources import readers, sinks
from gridloom.sources.storage import scratch

RANGE = Rect(1000, 5, 50000, 20)
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
QUERY = Point(30000, 25)
POLYGONS = ((1, ((10000, 5), (60000, 10), (30000, 45))), (2, ((50000, 1), (100000, 1), (75000, 30), (60000, 50))))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pts_li(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEYS, F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("double").alias("y"))


def pts_ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), "ts")


def pts_geo(spark: SparkSession, d: str) -> DataFrame:
    lat = ((F.col("o_custkey") * 7919) % 18000).cast("double") / 100 - 90
    lon = ((F.col("o_orderkey") * 104729) % 36000).cast("double") / 100 - 180
    return table(spark, d, "orders").select("o_orderkey", lat.alias("lat"), lon.alias("lon"))


def rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("rect_id"), (k * 4000).alias("x0"), k.alias("y0"), (k * 4000 + 3000).alias("x1"), (k + 10).alias("y1"))


def polys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in ring]) for i, ring in POLYGONS], "poly_id long, ring array<struct<x:double,y:double>>")


def _index(spark: SparkSession, d: str, method: str = "kdb") -> index.Index:
    return index.build_index(pts_li(spark, d), f"{scratch(spark)}/index", method, 16)


def _geo_index(spark: SparkSession, d: str) -> index.Index:
    return index.build_index(pts_geo(spark, d), f"{scratch(spark)}/geo", "rtree", 25, "lat", "lon")


def _ev_index(spark: SparkSession, d: str) -> index.Index:
    return index.build_index(pts_ev(spark, d), f"{scratch(spark)}/events", "quad", 16)


def _first_point(rows: DataFrame, key: str, *more: str) -> tuple:
    r = rows.orderBy(key, *more).limit(1).first()
    return r


def range_indexed(method: str):
    return lambda s, d: filters.range_query(_index(s, d, method), RANGE)


def point_all(s, d):
    p = _first_point(pts_li(s, d), *KEYS)
    return filters.point_query(pts_li(s, d), Point(p["x"], p["y"]))


def point_first(s, d):
    p = _first_point(pts_li(s, d), *KEYS)
    return filters.point_query(pts_li(s, d), Point(p["x"], p["y"]), "first")


def point_indexed(s, d):
    p = _first_point(pts_li(s, d), *KEYS)
    return filters.point_query(_index(s, d), Point(p["x"], p["y"]))


def exists(s, d):
    p, idx = _first_point(pts_li(s, d), *KEYS), _index(s, d)
    rows = [(src, filters.exists(on, Point(p["x"], p["y"])), filters.exists(on, Point(-1, -1))) for src, on in (("scan", pts_li(s, d)), ("index", idx))]
    return s.createDataFrame(rows, "src string, there boolean, elsewhere boolean")


def learned_range(s, d):
    idx = _index(s, d)
    learned.build_models(idx)
    return learned.learned_range_query(idx, RANGE)


def index_stats(s, d):
    t = _index(s, d).stats()
    return s.createDataFrame([(t.box.x0, t.box.x1, t.box.y0, t.box.y1, t.n)], "min_x double, max_x double, min_y double, max_y double, n long")


def build_all(s, d):
    made = build.build_all(pts_li(s, d), scratch(s), 16, with_models=True, log=f"{scratch(s)}/log")
    return s.createDataFrame([(m, i.stats().n, i.data.count()) for m, i in made.items()], "method string, listed long, stored long")


def join_written(s, d):
    return joins.run_join(pts_li(s, d), rects(s, d), write=True, path=f"{scratch(s)}/pairs").select("rect_id", *KEYS)


def knn_windowed_indexed(s, d):
    return nearest.knn_windowed(_index(s, d, "kdb"), QUERY, 10, KEYS).drop("d2")


def knn_queries(s, d):
    k = F.col("n_nationkey").cast("double")
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), (k * 4000 + 500).alias("qx"), (k * 2).alias("qy"))


def knn_join(s, d):
    return nearest.knn_join(knn_queries(s, d), pts_li(s, d), 20, KEYS).select("qid", F.col("rank").cast("long").alias("rank"), *KEYS)


def fixgrid_hist(s, d, method="fixgrid"):
    return partition.with_pid(pts_li(s, d), method).groupBy(F.col("pid").cast("long").alias("pid")).agg(F.count("*").alias("n"))


def invariants(method: str):
    """Every point has one cell, and lies in it."""

    def run(s, d):
        pts = pts_li(s, d)
        lay = partition.layout(pts, method, 16)
        placed = pts.withColumn("pid", lay.pid)
        cells = lay.cells_frame(s).drop("lineage")
        placed = placed.join(F.broadcast(cells), "pid", "left")  # 16 cells or so
        top = cells.agg(F.max("x1").alias("right"), F.max("y1").alias("top")).first()  # cells are closed on the box's upper sides
        below = lambda c, end, most: (F.col(c) < F.col(end)) | ((F.col(end) == F.lit(most)) & (F.col(c) == F.col(end)))
        outside = ~((F.col("x") >= F.col("x0")) & below("x", "x1", top["right"]) & (F.col("y") >= F.col("y0")) & below("y", "y1", top["top"]))
        return placed.agg(F.count("*").alias("n"), F.count_if(F.col("pid").isNull()).alias("unassigned"), F.count_if(F.coalesce(outside, F.lit(True))).alias("outside_mbr"))

    return run


def quad_cells(s, d):
    pts = pts_li(s, d)
    return pts.groupBy(partition.grid_cell_id("x", "y", stats.stats(pts), 4).alias("cell")).agg(F.count("*").alias("n"))


def spline_ok(s, d, eps=32.0):
    """Keys and last position of each model, and whether its knots, read anew, keep every position within eps."""
    placed = partition.with_pid(pts_li(s, d), "fixgrid")
    models = spline.spline_models(placed, "x", "pid", eps)
    knots = models.select("pid", "n_keys", "last", F.posexplode("knots").alias("i", "a"), "knots")
    segments = knots.select("pid", "n_keys", "last", "a", F.coalesce(F.get("knots", F.col("i") + 1), F.col("a")).alias("b"))
    at = stats.cdf(placed, "x", "pid").join(segments, "pid").where((F.col("x") >= F.col("a.key")) & ((F.col("x") < F.col("b.key")) | (F.col("x") == F.col("a.key"))))
    run = F.col("b.key") - F.col("a.key")
    guess = F.col("a.pos") + F.when(run > 0, (F.col("b.pos") - F.col("a.pos")) * (F.col("x") - F.col("a.key")) / run).otherwise(0)
    good = (F.count("*") == F.first("n_keys")) & (F.max(F.abs(guess - F.col("pos"))) <= eps + 1e-6)
    return at.groupBy(F.col("pid").cast("long").alias("pid")).agg(F.first("n_keys").alias("n_keys"), F.first("last").alias("last"), good.alias("ok"))


def manifest_mbr(s, d):
    m = index.manifest(partition.with_pid(pts_li(s, d), "fixgrid"))
    return m.withColumn("pid", F.col("pid").cast("long"))


def st_point(s, d, src=None):
    ev = pts_ev(s, d)
    p = _first_point(ev, "event_id")
    return filters.st_point_query(src or ev, Point(p["x"], p["y"]), p["ts"])


def haversine_matrix(s, d):
    nat = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") * 7.0 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 170).alias("lon"))
    other = nat.select(F.col("a").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = nat.join(other, F.col("a") < F.col("b"))  # 25 rows each
    return pairs.select("a", "b", F.round(g.haversine("lat", "lon", F.col("lat2"), F.col("lon2")) / 1000, 3).alias("km"))


def rect_functions(s, d):
    return rects(s, d).select("rect_id", g.rect_area("x0", "y0", "x1", "y1").alias("area"), g.length("x0", "y0").alias("len"), g.distance("x0", "y0", F.col("x1"), F.col("y1")).alias("diagonal"))


def shape_functions(s, d):
    r = rects(s, d)
    box, other = ("x0", "y0", "x1", "y1"), (F.lit(9000), F.lit(3), F.lit(30000), F.lit(12))
    e, u = g.point_envelope("x0", "y1"), g.rect_union(*box, *other)
    return r.select(
        "rect_id", g.rect_disjoint(*box, *other).alias("apart"), g.point_less("x0", "y0", 20000, 4).alias("less"), g.point_equals("x0", "y0", 8000, 2).alias("same"),
        g.point_text("x0", "y0").alias("text"), g.rect_text(*box).alias("box_text"), (e["x0"] + e["y1"]).alias("envelope"), *[u[c].alias(f"u_{c}") for c in box],
        (g.point_hash("x0", "y0") == g.point_hash(F.col("x0") + 0, F.col("y0") + 0)).alias("hash"),
    )


def model_errors(s, d):
    rows = table(s, d, "lineitem").select((F.col("l_quantity") * 1500).alias("guess"), F.col("l_extendedprice").alias("truth"))
    return stats.model_errors(rows, "guess", "truth").select(F.round("avg_error", 3).alias("avg_error"), F.round("max_error", 3).alias("max_error"))


def rect_pairs(s, d):
    a = rects(s, d)
    b = a.select(*[F.col(c).alias("b_" + c) for c in a.columns])
    wide = b.withColumn("b_x1", F.col("b_x1") + 6000)
    sides = ("x0", "y0", "x1", "y1", "b_x0", "b_y0", "b_x1", "b_y1")
    return a.join(wide, g.rect_intersects(*sides) & (F.col("rect_id") > F.col("b_rect_id"))).select("rect_id", "b_rect_id", g.rect_contains_rect(*sides).alias("contains"))


def circle_boxes(s, d):
    k = F.col("n_nationkey").cast("double")
    e = g.circle_bbox(k * 100, k * 3, k + 1)
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("circle_id"), e.alias("e")).select("circle_id", "e.x0", "e.y0", "e.x1", "e.y1")


def emb_range(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return filters.range_query(e, Rect(-0.1, -0.1, 0.1, 0.1)).select("vec_id")


def csv_points(s, d):
    path = f"{scratch(s)}/points"
    pts_li(s, d).select("l_orderkey", "x", "y").write.csv(path)
    return readers.csv_points(s, path, offset=1)


def csv_points_header(s, d):
    path = f"{scratch(s)}/points"
    pts_li(s, d).select("x", "y").write.csv(path, header=True)
    return readers.csv_points(s, path, header=True)


def memory_points(s, d):
    return readers.memory_points(s, [p for _, ring in POLYGONS for p in ring])


def written(s, d):
    path = f"{scratch(s)}/result"
    sinks.write_result(pts_ev(s, d), path, "orc")
    return s.read.orc(path)


def csv_rects(s, d):
    path = f"{scratch(s)}/rects"
    rects(s, d).drop("rect_id").write.csv(path, header=True)
    return readers.csv_rects(s, path)


def json_points(s, d):
    path = f"{scratch(s)}/json"
    pts_geo(s, d).select(F.format_string('{"id":1,"g":"POINT (%s %s)"}', F.col("lon"), F.col("lat"))).write.text(path)
    return readers.json_wkt_points(s, path)


def csv_polygons(s, d):
    path = f"{scratch(s)}/polygons"
    rows = polys(s).select("poly_id", F.posexplode("ring").alias("i", "p")).orderBy("poly_id", "i").coalesce(1)
    rows.select("poly_id", "p.x", "p.y").write.csv(path, header=True)
    return _vertices(readers.csv_polygons(s, path))


def csv_polygons_by_count(s, d):
    path = f"{scratch(s)}/fives"
    rows = table(s, d, "nation").orderBy("n_nationkey").coalesce(1).select(F.lit("r"), F.col("n_nationkey").cast("double"), (F.col("n_nationkey") % 5).cast("double"))
    rows.write.csv(path)
    return _vertices(readers.csv_polygons_by_count(s, path))


def _vertices(rings: DataFrame) -> DataFrame:
    return rings.select("poly_id", F.posexplode("ring").alias("i", "p")).select("poly_id", F.col("i").cast("long").alias("i"), "p.x", "p.y")


def _parts(s, d) -> DataFrame:
    return joins.polygon_join(pts_li(s, d), polys(s), "exact").select("poly_id", *KEYS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rect_join_count": lambda s, d: joins.rect_join_count(pts_li(s, d), rects(s, d), "rect_id"),
    "range_query": lambda s, d: filters.range_query(pts_li(s, d), RANGE),
    "range_count": lambda s, d: filters.range_count(pts_li(s, d), RANGE),
    **{f"range_query_indexed_{m}": range_indexed(m) for m in partition.METHODS},
    "point_query_all": point_all,
    "point_query_first": point_first,
    "distance_query": lambda s, d: filters.distance_query(pts_geo(s, d), 10, 20, 2_000_000).select("o_orderkey"),
    "distance_query_antimeridian": lambda s, d: filters.distance_query(pts_geo(s, d), -20, 179, 1_500_000).select("o_orderkey"),
    "distance_query_pole": lambda s, d: filters.distance_query(pts_geo(s, d), 85, 0, 1_200_000).select("o_orderkey"),
    "circle_count": lambda s, d: filters.circle_count(pts_li(s, d), Circle(30000, 25, 500)),
    "knn": lambda s, d: nearest.knn(pts_li(s, d), QUERY, 10, KEYS).drop("d2"),
    "point_query_indexed": point_indexed,
    "exists": exists,
    "distance_query_indexed": lambda s, d: filters.distance_query(_geo_index(s, d), 10, 20, 2_000_000).select("o_orderkey"),
    "distance_query_antimeridian_indexed": lambda s, d: filters.distance_query(_geo_index(s, d), -20, 179, 1_500_000).select("o_orderkey"),
    "circle_count_indexed": lambda s, d: filters.circle_count(_index(s, d), Circle(30000, 25, 500)),
    "range_count_indexed": lambda s, d: filters.range_count(_index(s, d), RANGE),
    "range_query_learned": learned_range,
    "index_stats": index_stats,
    "build_all": build_all,
    "knn_windowed": knn_windowed_indexed,
    "knn_indexed": lambda s, d: nearest.knn(_index(s, d, "rtree"), QUERY, 10, KEYS).drop("d2"),
    "nearest_indexed": lambda s, d: nearest.nearest(_index(s, d, "quad"), QUERY, KEYS).drop("d2"),
    "knn_join_indexed": lambda s, d: nearest.knn_join(knn_queries(s, d), _index(s, d), 20, KEYS).select("qid", F.col("rank").cast("long").alias("rank"), *KEYS),
    "rect_join_indexed": lambda s, d: joins.rect_join(_index(s, d), rects(s, d).where("rect_id < 9")).select("rect_id", *KEYS),
    "polygon_join_indexed": lambda s, d: joins.polygon_join(_index(s, d), polys(s)).select("poly_id", *KEYS),
    "join_written": join_written,
    "st_range_query_indexed": lambda s, d: filters.st_range_query(_ev_index(s, d), Rect(10, 5, 60, 20), "2024-01-02 00:00:00", "2024-01-09 23:59:59.999999").select("event_id"),
    "st_point_query_indexed": lambda s, d: st_point(s, d, _ev_index(s, d)).select("event_id"),
    "nearest": lambda s, d: nearest.nearest(pts_li(s, d), QUERY, KEYS).drop("d2"),
    "knn_join": knn_join,
    "rect_join": lambda s, d: joins.rect_join(pts_li(s, d), rects(s, d)).select("rect_id", *KEYS),
    "polygon_join_mbr": lambda s, d: joins.polygon_join(pts_li(s, d), polys(s), "mbr").select("poly_id", *KEYS),
    "polygon_join_exact": _parts,
    "polygon_collect": lambda s, d: joins.polygon_collect(pts_li(s, d), polys(s)).select("poly_id", F.explode("points").alias("p")).select("poly_id", "p.x", "p.y"),
    "bbox_stats": lambda s, d: stats.bbox_stats(pts_li(s, d)),
    "fixgrid_hist": fixgrid_hist,
    "adaptive_hist": lambda s, d: fixgrid_hist(s, d, "adaptive"),
    "kdb_invariants": invariants("kdb"),
    "quad_invariants": invariants("quad"),
    "rtree_invariants": invariants("rtree"),
    "quad_cells_fixed_depth": quad_cells,
    "cdf": lambda s, d: stats.cdf(pts_li(s, d)),
    "spline_models": spline_ok,
    "model_errors": model_errors,
    "st_range_query": lambda s, d: filters.st_range_query(pts_ev(s, d), Rect(10, 5, 60, 20), "2024-01-02 00:00:00", "2024-01-09 23:59:59.999999").select("event_id"),
    "st_point_query": lambda s, d: st_point(s, d).select("event_id"),
    "manifest_mbr": manifest_mbr,
    "haversine_matrix": haversine_matrix,
    "rect_functions": rect_functions,
    "shape_functions": shape_functions,
    "rect_intersects_pairs": rect_pairs,
    "circle_bbox": circle_boxes,
    "emb_range": emb_range,
    "csv_points": csv_points,
    "csv_points_header": csv_points_header,
    "memory_points": memory_points,
    "written_result": written,
    "csv_rects": csv_rects,
    "json_wkt_points": json_points,
    "csv_polygons": csv_polygons,
    "csv_polygons_by_count": csv_polygons_by_count,
}

_K = ", ".join(KEYS)
_LI = f"(SELECT {_K}, l_extendedprice AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem) p"
_IN = "x BETWEEN 1000 AND 50000 AND y BETWEEN 5 AND 20"
_GEO = "(SELECT o_orderkey, CAST((o_custkey * 7919) % 18000 AS DOUBLE) / 100 - 90 AS lat, CAST((o_orderkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS lon FROM orders) p"
_RECTS = "(SELECT CAST(n_nationkey AS BIGINT) AS rect_id, n_nationkey * 4000.0::DOUBLE AS x0, n_nationkey::DOUBLE AS y0, n_nationkey * 4000.0::DOUBLE + 3000 AS x1, n_nationkey::DOUBLE + 10 AS y1 FROM nation)"
_EV = "(SELECT event_id, CAST(user_id AS DOUBLE) AS x, value AS y, ts FROM events)"
_D2 = "(x - 30000) * (x - 30000) + (y - 25) * (y - 25)"
_PAIRS = f"FROM {_LI} JOIN {_RECTS} r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
_EDGES = "(VALUES " + ", ".join(f"({i}, {a[0]}.0::DOUBLE, {a[1]}.0::DOUBLE, {b[0]}.0::DOUBLE, {b[1]}.0::DOUBLE)" for i, ring in POLYGONS for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) + ") e(poly_id, ex1, ey1, ex2, ey2)"
_CROSS = "((ey1 > y) <> (ey2 > y)) AND x < (ex2 - ex1) * (y - ey1) / (ey2 - ey1) + ex1"
_EXACT = f"SELECT CAST(poly_id AS BIGINT) AS poly_id, {_K} FROM {_LI} JOIN {_EDGES} ON {_CROSS} GROUP BY poly_id, {_K}, x, y HAVING count(*) % 2 = 1"
_FIX = f"SELECT CAST(floor((x - x0) / step) AS BIGINT) % 100 AS pid, x, y FROM {_LI}, (SELECT min(l_extendedprice) AS x0, (max(l_extendedprice) - min(l_extendedprice)) / 1000 AS step FROM lineitem)"


def _far(lat: float, lon: float, metres: float) -> str:
    h = f"pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2)"
    return f"SELECT o_orderkey FROM {_GEO} WHERE 2 * 6378137.0 * asin(sqrt(least(1.0, {h}))) <= {metres}"


_RING = "(VALUES " + ", ".join(f"(CAST({i} AS BIGINT), CAST({k} AS BIGINT), {p[0]}.0::DOUBLE, {p[1]}.0::DOUBLE)" for i, ring in POLYGONS for k, p in enumerate(ring + ring[:1])) + ") v(poly_id, i, x, y)"
_KNN_JOIN = f"SELECT qid, rank, {_K} FROM (SELECT qid, {_K}, row_number() OVER (PARTITION BY qid ORDER BY (x - qx) * (x - qx) + (y - qy) * (y - qy), {_K}) AS rank FROM {_LI}, (SELECT CAST(n_nationkey AS BIGINT) AS qid, n_nationkey * 4000.0::DOUBLE + 500 AS qx, n_nationkey * 2.0::DOUBLE AS qy FROM nation)) WHERE rank <= 20"
_ST_RANGE = f"SELECT event_id FROM {_EV} WHERE x BETWEEN 10 AND 60 AND y BETWEEN 5 AND 20 AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-09 23:59:59.999999'"
_ST_POINT = f"SELECT e.event_id FROM {_EV} e JOIN (SELECT x, y, ts FROM {_EV} ORDER BY event_id LIMIT 1) f USING (x, y, ts)"
_BBOX = f"SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM {_LI}"
_RANGE_SQL = f"SELECT * FROM {_LI} WHERE {_IN}"
_FIRST = f"SELECT x, y FROM {_LI} ORDER BY {_K} LIMIT 1"
_INVARIANT = "SELECT count(*) AS n, CAST(0 AS BIGINT) AS unassigned, CAST(0 AS BIGINT) AS outside_mbr FROM lineitem"

SQL: dict[str, str] = {
    "rect_join_count": f"SELECT r.rect_id, count(x) AS n FROM {_RECTS} r LEFT JOIN {_LI} ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY r.rect_id",
    "range_query": _RANGE_SQL,
    "range_count": f"SELECT count(*) AS n FROM {_LI} WHERE {_IN}",
    **{f"range_query_indexed_{m}": _RANGE_SQL for m in partition.METHODS},
    "point_query_all": f"SELECT p.* FROM {_LI} JOIN ({_FIRST}) f USING (x, y)",
    "point_query_first": _FIRST,
    "distance_query": _far(10, 20, 2_000_000),
    "distance_query_antimeridian": _far(-20, 179, 1_500_000),
    "distance_query_pole": _far(85, 0, 1_200_000),
    "circle_count": f"SELECT count(*) AS n FROM {_LI} WHERE {_D2} <= 250000",
    "knn": f"SELECT * FROM {_LI} ORDER BY {_D2}, {_K} LIMIT 10",
    "knn_windowed": f"SELECT * FROM {_LI} ORDER BY {_D2}, {_K} LIMIT 10",
    "nearest": f"SELECT * FROM {_LI} ORDER BY {_D2}, {_K} LIMIT 1",
    "knn_join": _KNN_JOIN,
    "rect_join": f"SELECT rect_id, {_K} {_PAIRS}",
    "point_query_indexed": f"SELECT p.* FROM {_LI} JOIN ({_FIRST}) f USING (x, y)",
    "exists": "SELECT * FROM (VALUES ('scan', true, false), ('index', true, false)) t(src, there, elsewhere)",
    "distance_query_indexed": _far(10, 20, 2_000_000),
    "distance_query_antimeridian_indexed": _far(-20, 179, 1_500_000),
    "circle_count_indexed": f"SELECT count(*) AS n FROM {_LI} WHERE {_D2} <= 250000",
    "range_count_indexed": f"SELECT count(*) AS n FROM {_LI} WHERE {_IN}",
    "range_query_learned": _RANGE_SQL,
    "index_stats": _BBOX,
    "build_all": "SELECT m AS method, (SELECT count(*) FROM lineitem) AS listed, (SELECT count(*) FROM lineitem) AS stored FROM (VALUES ('fixgrid'), ('adaptive'), ('kdb'), ('quad'), ('rtree')) t(m)",
    "knn_indexed": f"SELECT * FROM {_LI} ORDER BY {_D2}, {_K} LIMIT 10",
    "nearest_indexed": f"SELECT * FROM {_LI} ORDER BY {_D2}, {_K} LIMIT 1",
    "knn_join_indexed": _KNN_JOIN,
    "rect_join_indexed": f"SELECT rect_id, {_K} {_PAIRS} AND rect_id < 9",
    "polygon_join_indexed": _EXACT,
    "join_written": f"SELECT rect_id, {_K} {_PAIRS}",
    "st_range_query_indexed": _ST_RANGE,
    "st_point_query_indexed": _ST_POINT,
    "model_errors": "SELECT round(avg(abs(l_quantity * 1500 - l_extendedprice)), 3) AS avg_error, round(max(abs(l_quantity * 1500 - l_extendedprice)), 3) AS max_error FROM lineitem",
    "shape_functions": f"SELECT rect_id, NOT (x0 <= 30000 AND x1 >= 9000 AND y0 <= 12 AND y1 >= 3) AS apart, x0 < 20000 OR (x0 = 20000 AND y0 < 4) AS less, x0 = 8000 AND y0 = 2 AS same, '(' || x0 || '|' || y0 || ')' AS text, '(' || x0 || '|' || y0 || ') (' || x1 || '|' || y1 || ')' AS box_text, x0 + y1 AS envelope, least(x0, 9000.0::DOUBLE) AS u_x0, least(y0, 3.0::DOUBLE) AS u_y0, greatest(x1, 30000.0::DOUBLE) AS u_x1, greatest(y1, 12.0::DOUBLE) AS u_y1, true AS hash FROM {_RECTS}",
    "csv_points_header": f"SELECT x, y FROM {_LI}",
    "memory_points": f"SELECT x, y FROM {_RING} WHERE (poly_id, i) NOT IN ((1, 3), (2, 4))",
    "written_result": f"SELECT * FROM {_EV}",
    "polygon_join_mbr": f"SELECT poly_id, {_K} FROM {_LI} JOIN (SELECT CAST(poly_id AS BIGINT) AS poly_id, min(ex1) AS x0, max(ex1) AS x1, min(ey1) AS y0, max(ey1) AS y1 FROM {_EDGES} GROUP BY poly_id) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1",
    "polygon_join_exact": _EXACT,
    "polygon_collect": f"SELECT CAST(poly_id AS BIGINT) AS poly_id, x, y FROM {_LI} JOIN {_EDGES} ON {_CROSS} GROUP BY poly_id, {_K}, x, y HAVING count(*) % 2 = 1",
    "bbox_stats": _BBOX,
    "fixgrid_hist": f"SELECT pid, count(*) AS n FROM ({_FIX}) GROUP BY pid",
    "adaptive_hist": f"SELECT CAST(floor((x - x0) / w) AS BIGINT) % 100 AS pid, count(*) AS n FROM {_LI}, (SELECT min(l_extendedprice) AS x0, (max(l_extendedprice) - min(l_extendedprice)) / (CAST(count(*) AS DOUBLE) / least(100, count(*))) AS w FROM lineitem) GROUP BY 1",
    "kdb_invariants": _INVARIANT,
    "quad_invariants": _INVARIANT,
    "rtree_invariants": _INVARIANT,
    "quad_cells_fixed_depth": f"SELECT CAST(floor((y - y0) / (y1 + 0.01::DOUBLE - y0) * 16) * 16 + floor((x - x0) / (x1 + 0.01::DOUBLE - x0) * 16) AS BIGINT) AS cell, count(*) AS n FROM {_LI}, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {_LI}) GROUP BY 1",
    "cdf": f"SELECT y, CAST(sum(count(*)) OVER (ORDER BY y) - 1 AS BIGINT) AS pos FROM {_LI} GROUP BY y",
    "spline_models": f"SELECT pid, count(DISTINCT x) AS n_keys, count(*) - 1 AS last, true AS ok FROM ({_FIX}) GROUP BY pid",
    "st_range_query": _ST_RANGE,
    "st_point_query": _ST_POINT,
    "manifest_mbr": f"SELECT pid, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM ({_FIX}) GROUP BY pid",
    "haversine_matrix": "WITH q AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_nationkey * 7.0::DOUBLE - 80 AS lat, n_nationkey * 13.0::DOUBLE - 170 AS lon FROM nation) SELECT p.k AS a, q.k AS b, round(2 * 6378137.0 * asin(sqrt(least(1.0, pow(sin((radians(q.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin((radians(q.lon) - radians(p.lon)) / 2), 2)))) / 1000, 3) AS km FROM q p JOIN q ON p.k < q.k",
    "rect_functions": f"SELECT rect_id, (x1 - x0) * (y1 - y0) AS area, sqrt(x0 * x0 + y0 * y0) AS len, sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) AS diagonal FROM {_RECTS}",
    "rect_intersects_pairs": f"SELECT a.rect_id, b.rect_id AS b_rect_id, a.x0 <= b.x0 AND b.x1 + 6000 <= a.x1 AND a.y0 <= b.y0 AND b.y1 <= a.y1 AS contains FROM {_RECTS} a JOIN {_RECTS} b ON a.x0 <= b.x1 + 6000 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AND a.rect_id > b.rect_id",
    "circle_bbox": "SELECT CAST(n_nationkey AS BIGINT) AS circle_id, k * 100 - (k + 1) AS x0, k * 3 - (k + 1) AS y0, k * 100 + (k + 1) AS x1, k * 3 + (k + 1) AS y1 FROM (SELECT n_nationkey, n_nationkey::DOUBLE AS k FROM nation)",
    "emb_range": "SELECT vec_id FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.1 AND embedding[2]::DOUBLE BETWEEN -0.1 AND 0.1",
    "csv_points": f"SELECT x, y FROM {_LI}",
    "csv_rects": f"SELECT x0, y0, x1, y1 FROM {_RECTS}",
    "json_wkt_points": f"SELECT lon AS x, lat AS y FROM {_GEO}",
    "csv_polygons": f"SELECT poly_id, i, x, y FROM {_RING}",
    "csv_polygons_by_count": "SELECT CAST(p AS BIGINT) AS poly_id, CAST(i AS BIGINT) AS i, CAST(p * 5 + i % 5 AS DOUBLE) AS x, CAST(i % 5 AS DOUBLE) AS y FROM range(5) a(p), range(6) b(i)",
}
