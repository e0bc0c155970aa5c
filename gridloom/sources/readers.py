"""Point, rectangle and polygon files as DataFrames.

mode='fail' stops at a malformed row, mode='drop' leaves it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the pattern of a WKT point under the key g.
WKT = r'"g":"POINT \((-?\d+\.\d+) (-?\d+\.\d+)\)"'
_MODES = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}


def _csv(spark: SparkSession, path: str, schema: str, header: bool, mode: str) -> DataFrame:
    if mode not in _MODES:
        raise ValueError(f"mode is 'fail' or 'drop', not {mode!r}")
    return spark.read.csv(path, schema=schema, header=header, mode=_MODES[mode], enforceSchema=True)


def _numeric(df: DataFrame, columns: dict[str, str], types: dict[str, str], mode: str) -> DataFrame:
    """Casts string columns; rows that do not cast fail or go."""
    cast = {new: F.expr(f"try_cast(trim({old}) AS {types.get(new, 'double')})") for new, old in columns.items()}
    good = None
    for c in cast.values():
        good = c.isNotNull() if good is None else good & c.isNotNull()
    if mode == "drop":
        return df.where(good).select(*[c.alias(n) for n, c in cast.items()], *[c for c in df.columns if c.startswith("_m_")])
    fail = F.raise_error(F.concat(F.lit("malformed row: "), F.concat_ws(",", *[F.coalesce(F.col(o), F.lit("null")) for o in columns.values()])))
    return df.select(*[F.when(good, c).otherwise(fail.cast(types.get(n, "double"))).alias(n) for n, c in cast.items()], *[c for c in df.columns if c.startswith("_m_")])


def _fields(spark: SparkSession, path: str, header: bool, last: int) -> DataFrame:
    """Fields 0..last of comma separated lines, with the place of each line in its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_m_file"), F.col("_metadata.file_block_start").alias("_m_block"), F.monotonically_increasing_id().alias("_m_at"))
    parts = F.split("value", ",", -1)
    out = lines.select(*[F.get(parts, F.lit(i)).alias(f"f{i}") for i in range(last + 1)], "_m_file", "_m_block", "_m_at")
    if not header:
        return out
    first = out.where("_m_block = 0").groupBy("_m_file").agg(F.min("_m_at").alias("_first"))
    return out.join(first, "_m_file", "left").where("_m_block > 0 OR _m_at > _first").drop("_first")


def csv_points(spark: SparkSession, path: str, offset: int = 0, header: bool = False, mode: str = "fail") -> DataFrame:
    """x = field[offset], y = field[offset + 1]; other fields are not parsed."""
    schema = ", ".join(f"_c{i} string" for i in range(offset + 2))
    raw = spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE")
    return _numeric(raw, {"x": f"_c{offset}", "y": f"_c{offset + 1}"}, {}, mode)


def json_wkt_points(spark: SparkSession, path: str, mode: str = "drop") -> DataFrame:
    """One document per line; x = longitude, y = latitude of the WKT point under g."""
    lines = spark.read.text(path)
    x, y = F.regexp_extract("value", WKT, 1), F.regexp_extract("value", WKT, 2)
    if mode == "drop":
        return lines.where(x != "").select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    if mode != "fail":
        raise ValueError(f"mode is 'fail' or 'drop', not {mode!r}")
    fail = F.raise_error(F.concat(F.lit("no point in: "), "value")).cast("double")
    return lines.select(F.when(x != "", x.cast("double")).otherwise(fail).alias("x"), F.when(x != "", y.cast("double")).otherwise(fail).alias("y"))


def csv_rects(spark: SparkSession, path: str, header: bool = True, mode: str = "fail") -> DataFrame:
    """x0, y0, x1, y1 from the first four fields."""
    raw = spark.read.csv(path, schema="a string, b string, c string, d string", header=header, mode="PERMISSIVE")
    return _numeric(raw, {"x0": "a", "y0": "b", "x1": "c", "y1": "d"}, {}, mode)


def _rings(rows: DataFrame, *keys: str) -> DataFrame:
    from gridloom.functions.geometry import closed_ring

    ordered = F.sort_array(F.collect_list(F.struct("_m_file", "_m_block", "_m_at", "x", "y")))
    rings = rows.groupBy(*keys).agg(ordered.alias("o"))
    return rings.withColumn("ring", closed_ring(F.transform("o", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))).drop("o")


def csv_polygons(spark: SparkSession, path: str, header: bool = True, mode: str = "fail") -> DataFrame:
    """poly_id, ring from rows (id, x, y) in file order; rings are closed."""
    rows = _numeric(_fields(spark, path, header, 2), {"poly_id": "f0", "x": "f1", "y": "f2"}, {"poly_id": "bigint"}, mode)
    return _rings(rows, "poly_id")


def csv_polygons_by_count(spark: SparkSession, path: str, size: int = 5, mode: str = "fail") -> DataFrame:
    """poly_id, ring: every size consecutive rows of a file are a ring (fields 1 and 2); a rest is dropped.

    Rows are numbered over the whole file, so a ring is not cut where the file is split.
    """
    rows = _numeric(_fields(spark, path, False, 2), {"x": "f1", "y": "f2"}, {}, mode)
    rows = rows.withColumn("_m_part", F.shiftright("_m_at", 33))
    blocks = rows.groupBy("_m_file", "_m_block", "_m_part").agg(F.count("*").alias("n"), F.min("_m_at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_m_file").orderBy("_m_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before)
    in_block = F.row_number().over(Window.partitionBy("_m_file", "_m_block").orderBy("_m_at")) - 1
    seq = rows.withColumn("_i", in_block).join(blocks.select("_m_file", "_m_block", "before"), ["_m_file", "_m_block"])
    seq = seq.withColumn("poly_id", F.floor((F.col("before") + F.col("_i")) / size))
    return _rings(seq, "_m_file", "poly_id").where(F.size("ring") >= size).drop("_m_file")


def memory_points(spark: SparkSession, points: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")


def parquet_points(spark: SparkSession, path: str, x: str, y: str) -> DataFrame:
    """A Parquet table with its columns, plus x and y."""
    return spark.read.parquet(path).withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")})
