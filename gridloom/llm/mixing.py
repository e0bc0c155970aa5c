"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share 150 % of all words; no source gives more than twice its words, the excess
is shared again by weight (water filling).  A source's rate target / size is
split into certain whole copies and a probability p for one more copy.  The
inclusion odds of a document are odds(p) times min(1, (words + 1) / FULL_WORDS):
short documents, which say little, are included with lower probability.  Documents
are ranked by q = odds(u) / inclusion odds, u a reproducible uniform number, and
are taken in that order until the words left to the source are used; the document
on the border is taken if that comes nearer to the target.

The running sum over a source is found digit by digit: words are summed by the
leading twelve bits of the rank, the digit that holds the border is refined by
the next twelve, and only rows of the last border digit are ordered.  No source,
however large, meets in one task.

Edge cases: null text has size 0 and is taken 0 words; an empty table or one
without words gives targets of 0; u follows from id and text, so rows of one id, or
without any, are ranked apart, and only rows that repeat both are ranked alike;
sources are rows of a table, as many as there are; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, id_text, partitions, stored, table

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
FULL_WORDS = 128
DIGIT = 4096
DIGITS = 2


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of some columns over all rows before them in an order, and "<name>_all" over all rows.

    Rows are dealt by ranges of the order and stored; the ranges' sums, as many rows as
    partitions, give each range its start, so no task orders all rows.
    """
    spark = rows.sparkSession
    dealt = stored(rows.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums], *[F.sum(f"_{k}").over(everything).alias(f"{k}_all") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(parts), "_range").withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{k}_before") for k, c in sums.items()})
    return out.select(*rows.columns, *sums, *[f"{k}_all" for k in sums])


def source_targets(sizes: DataFrame, total_share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from source and source_size.  One row per source, of any number."""
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = running(sizes.select("source", "source_size"), by_name, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.select("source", "source_size", weight.alias("weight"))
    # Water level: fill the sources in the order in which they reach their limit.
    cap = max_repeats * F.col("source_size")
    sums = {"full": cap, "lighter": F.col("weight"), "sizes": F.col("source_size")}
    rows = running(rows, [F.col("source_size") / F.col("weight"), *by_name], sums)
    level = (total_share * F.col("sizes_all") - F.col("full")) / (F.col("lighter_all") - F.col("lighter"))
    rows = rows.withColumn("level", level).withColumn("open", F.col("weight") * level <= cap)
    # The first source that stays below its limit sets the level for it and all after it.
    lam = rows.agg(F.max(F.when(F.col("open"), F.struct(-F.col("full"), F.col("level"))))["level"].alias("lam"))
    rows = rows.crossJoin(F.broadcast(lam))  # one row
    target = F.when(F.col("lam").isNull() | (F.col("weight") * F.col("lam") > cap), cap.cast("double")).otherwise(F.col("weight") * F.col("lam"))
    return rows.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, text: Column) -> Column:
    """A reproducible number in (0, 1): 48 bits of the MD5 of the id and the text's MD5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def pareto_mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes), copies, and the columns keep."""
    rows = id_text(docs, F.col(source).cast("string").alias("source"), *[F.col(c).alias(f"keep_{c}") for c in keep], text=text, doc_id=doc_id)
    rows = rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("u"), *[f"keep_{c}" for c in keep])
    rows = stored(rows)
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(targets.withColumn("p", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(0.0)))

    u, w = F.col("u"), F.least(F.lit(1.0), (F.col("size") + 1) / F.lit(float(FULL_WORDS)))
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")) * w)
    drawn = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # rank: q brought to (0, 1) in the same order; 1 where nothing more is to be taken
    drawn = drawn.withColumn("rank", F.when(F.col("p") > 0, q / (1 + q)).otherwise(1.0))
    for k in range(1, DIGITS + 1):
        drawn = drawn.withColumn(f"d{k}", F.floor(F.col("rank") * float(DIGIT**k)).cast("long"))

    # border: the digit of each source in which the words left run out, and the words before it
    border = targets.select(F.col("source").alias("b_source"), "left", F.lit(0).cast("long").alias("digit"), F.lit(0).cast("long").alias("before"))
    for k in range(1, DIGITS + 1):
        part = drawn.where("p > 0").groupBy("source", F.col(f"d{k}").alias("d")).agg(F.sum("size").alias("words"))
        part = part.join(border, F.col("source").eqNullSafe(F.col("b_source")) & (F.floor(F.col("d") / DIGIT) == F.col("digit") if k > 1 else F.lit(True)))
        cum = F.sum("words").over(Window.partitionBy("source").orderBy("d")) + F.col("before")
        part = part.withColumn("upto", cum).where("upto >= left and upto - words < left")
        border = stored(part.groupBy(F.col("source").alias("b_source")).agg(F.first("left").alias("left"), F.min("d").alias("digit"), F.min(F.col("upto") - F.col("words")).alias("before")))
    drawn = drawn.join(border.select("b_source", "digit", "before"), F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source")
    last = F.col(f"d{DIGITS}")
    inside = F.col("p") > 0
    cols = ["doc_id", "size", "source", "source_size", "target", "whole", "left", "rank", "before", *[f"keep_{c}" for c in keep]]
    sure = drawn.where(~inside | F.col("digit").isNull() | (last != F.col("digit")))
    sure = sure.select(*cols, F.when(~inside, 0).when(F.col("digit").isNull() | (last < F.col("digit")), 1).otherwise(0).alias("extra"))
    near = drawn.where(inside & (last == F.col("digit"))).select(*cols)
    w = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.sum("size").over(w) + F.col("before"))
    near = near.select(*cols, F.when((F.col("upto") <= F.col("left")) | ((F.col("upto") - F.col("size") < F.col("left")) & (F.col("upto") - F.col("left") < F.col("left") - (F.col("upto") - F.col("size")))), 1).otherwise(0).alias("extra"))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return sure.unionByName(near).select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (copies * F.col("size")).alias("taken"), copies.alias("copies"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight FROM s
), f AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0)::BIGINT AS full_, coalesce(sum(weight) OVER o, 0) AS lighter,
         sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER () AS heavy FROM k
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (1.5::DOUBLE * total - full_) / (heavy - lighter) AS level FROM f
), m AS (
  SELECT *, (SELECT arg_min(level, full_) FROM l WHERE weight * level <= 2 * source_size) AS lam FROM l
), t AS (
  SELECT source, source_size, CASE WHEN lam IS NULL OR weight * lam > 2 * source_size THEN (2 * source_size)::DOUBLE ELSE weight * lam END AS target FROM m
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), p2 AS (
  SELECT *, target - whole * source_size AS left_, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM p
), u AS (
  SELECT d.doc_id, d.size, p2.*, (('0x' || substr(d.digest, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN p2 ON d.source IS NOT DISTINCT FROM p2.source
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p) * least(1.0::DOUBLE, (size + 1) / 128.0::DOUBLE)) ELSE 1 END AS q FROM u
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM q
), e AS (
  SELECT *, (whole + CASE WHEN p > 0 AND (upto <= left_ OR (upto - size < left_ AND upto - left_ < left_ - (upto - size))) THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
"""
