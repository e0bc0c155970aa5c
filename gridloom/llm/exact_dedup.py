"""Exact dedup by distributed MSD radix partitioning.

Documents are split by length and their first bytes, then the groups left with
more than one member are split by the next, sixteen times longer, run of bytes,
until a group is a singleton or its documents have ended.  Keys are the bytes
themselves, no digest decides equality.  A document that is alone after the
first digit is not moved again.

Hot groups: counting a digit combines on the map side, so a group of copies
reaches a reducer as one row per map task; rows get their group number by a
plain equi-join, which adaptive execution splits where a digit is skewed.  The
joins are merge joins at every size: the list of groups grows with the input.

Edge cases: null text counts as empty; texts that normalise to nothing are one
group; repeated rows are members like others; an empty table gives an empty
result; null doc_ids sort last; other columns are ignored.  Rows that tie in id and
text too are told apart by a row number, if the caller has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, id_text, stored, table

FIRST_BYTES = 32
GROWTH = 16


def _numbered(groups: DataFrame, name: str) -> DataFrame:
    """Groups with a number each.  Stored, as the numbers must not change on a retry."""
    return stored(groups.withColumn(name, F.monotonically_increasing_id()))


def radix_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row (if given), n_points, text_sha256, level, grp: rows with the same (level, grp) have
    equal normalised texts; grp is null for a text that occurs once."""
    names = ["doc_id", *(["row"] if row else []), "n_points", "text_sha256"]
    rows = id_text(docs, *([F.col(row).alias("row")] if row else []), text=text, doc_id=doc_id).select(
        *names[:-2],
        F.char_length("text").cast("long").alias("n_points"),
        F.translate("text", SPACE, "").cast("binary").alias("body"),
    )
    rows = rows.select(*names[:-1], F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").cast("long").alias("n_bytes"), F.substring("body", 1, FIRST_BYTES).alias("digit"), "body")
    several = _numbered(rows.groupBy("n_bytes", "digit").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "grp")
    step = rows.join(several.hint("merge"), ["n_bytes", "digit"], "left").select(
        *names, "n_bytes", "grp",
        F.when(F.col("grp").isNotNull(), F.expr(f"substring(body, {FIRST_BYTES + 1})")).alias("rest"),
    )
    state, done, level, at, take = stored(step), [], 0, FIRST_BYTES, FIRST_BYTES
    while True:
        over = F.col("grp").isNull() | (F.col("n_bytes") <= at)
        done.append(state.where(over).select(*names, F.lit(level).alias("level"), "grp"))
        alive = state.where(~over)
        if alive.isEmpty():
            break
        take *= GROWTH
        alive = alive.select(*names, "n_bytes", F.col("grp").alias("parent"), F.substring("rest", 1, take).alias("digit"), "rest")
        several = _numbered(alive.groupBy("parent", "digit").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "grp")
        step = alive.join(several.hint("merge"), ["parent", "digit"], "left").select(
            *names, "n_bytes", "grp",
            F.when(F.col("grp").isNotNull(), F.expr(f"substring(rest, {take + 1})")).alias("rest"),
        )
        state, level, at = stored(step), level + 1, at + take
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and row (if given).

    Of equal texts the one with most code points, then the smallest doc_id, then the
    smallest row, stays.  Without a row, repeated rows have kept = (doc_id = keep_id) alike.
    """
    rows = radix_groups(docs, text, doc_id, row)
    ranked = [(-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), *([F.col("row").alias("d")] if row else [])]
    # stored, so that the join below deals both sides itself and can split a hot group
    groups = stored(rows.where("grp is not null").groupBy("level", "grp").agg(F.min(F.struct(*ranked)).alias("best"), F.count("*").alias("size")))
    joined = rows.join(groups.hint("merge"), ["level", "grp"], "left")
    alone = F.col("size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("best.c"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.d")) if row else F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
        *(["row"] if row else []),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), w AS (
  SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM w
"""
