"""A corpus from raw documents: language, exact copies, near copies, benchmark leaks, mixing.

STAGES are (name, function) with function(spark, docs, sf_dir) -> DataFrame; run()
writes each stage to the shared folder as Parquet and gives it to the next one.
All but the last return the columns of documents.

A stage numbers its rows and stores them, judges them by number, and drops those
numbers: rows whose doc_id is null or repeats are judged each for itself.  Numbers
that go are stored first; documents are moved only if these are too many to broadcast.

Edge cases: null and empty texts have no language and go in the first stage; rows
that repeat id and text are one document, rows of one id with different texts are
several; a null doc_id sorts last; columns of any name are kept; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, stored, table
from gridloom.llm.decontaminate import benchmark_hits
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.language_id import document_rows, fit_text, language_id
from gridloom.llm.mixing import pareto_mix
from gridloom.llm.simhash import similar_groups


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """Numbered rows but those whose number is in gone's only column, without the numbers."""
    gone = stored(gone.toDF("_gridloom_gone").distinct())
    return rows.join(gone, F.col(row) == F.col("_gridloom_gone"), "left_anti").drop(row)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not told; labels are those of the whole input."""
    rows, row = numbered(docs)
    judged = language_id(document_rows(rows, doc_id=row), fit_text(rows, doc_id=row))
    return _without(rows, row, judged.where("rejected").select("doc_id"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the one with most code points, then the smallest doc_id."""
    rows, row = numbered(docs)
    return _without(rows, row, exact_dedup(rows, row=row).where("NOT kept").select("row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies (five-word shingles, Jaccard 0.8 or more) the smallest doc_id stays."""
    rows, row = numbered(docs)
    groups = similar_groups(rows, doc_id=row)
    several = groups.where("doc_id <> component_id").select("component_id").distinct()
    members = groups.join(several, "component_id").select(F.col("doc_id").alias("member"), "component_id")
    members = stored(members.join(rows.select(F.col(row).alias("member"), F.col("doc_id").cast("long").alias("id")), "member"))
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("member").alias("c"))).alias("best"))
    stay = best.select(F.col("best.c").alias("member"))
    return _without(rows, row, members.join(stay, "member", "left_anti").select("member"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = numbered(docs)
    return _without(rows, row, benchmark_hits(rows, table(spark, sf_dir, "benchmark"), doc_id=row).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pareto_mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
]

#: Language likelihoods and similarity joins are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
