"""Helpers shared by the training-data operators: shared storage, batches, words."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable

import pyarrow
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.storage import stored

#: Functions that go to executors carry this package's code with them; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules["gridloom"])

#: The white space of the contracts, and a word in Java, RE2 and Python syntax.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
#: Rows of an Arrow batch of texts: they can be very long, so few of them go together.
TEXT_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text (null: empty) under their own names, without other columns."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)


def mapped(df: DataFrame, work: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",), batch_rows: int = TEXT_ROWS) -> DataFrame:
    """mapInPandas, its rows kept in the shared folder.  The ids, longs in schema, travel as text:
    pandas would make doubles of a batch of longs that holds a null."""
    sent = df.withColumns({c: F.col(c).cast("string") for c in ids if c in df.columns})
    for c in ids:
        schema = re.sub(rf"\b{c} long\b", f"{c} string", schema)
    return stored(sent.mapInPandas(work, schema).withColumns({c: F.col(c).cast("long") for c in ids}), batch_rows)


def sampled(share: Column | float, *of: str) -> Column:
    """Whether a row is in a sample of that share, by 53 bits of a hash of some columns: no share is
    so small that it counts as nothing."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") < (share if isinstance(share, Column) else F.lit(share)) * float(1 << 53)


#: Rows of files are numbered by FILE_BITS of the file's hash and their place in it; files that this may number.
FILE_BITS, PLACE_BITS, FILES = 37, 26, 200_000


def _place_in_files(docs: DataFrame) -> Column | None:
    """A number for each row of a scan of files, from its file's hash and its place in the file; None if docs
    is no such scan, or there is no number for each.  At most FILES rows come to the driver."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    try:
        path, place = (docs.metadataColumn("_metadata").getField(f) for f in ("file_path", "row_index"))
        mark = lambda salt: F.xxhash64(F.concat(path, F.lit(f"#{salt}"))).bitwiseAND((1 << FILE_BITS) - 1)
        marks = F.array(*[mark(salt) for salt in range(16)])
        files = docs.select(marks.alias("marks"), place.alias("place")).groupBy("marks").agg(F.max("place").alias("most")).limit(FILES + 1).collect()
    except AnalysisException:
        return None
    if len(files) > FILES or any(f["most"] >> PLACE_BITS for f in files):
        return None
    salt = next((s for s in range(16) if len({f["marks"][s] for f in files}) == len(files)), None)
    return None if salt is None else F.shiftleft(mark(salt), PLACE_BITS).bitwiseOR(place)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row that stays whenever docs is read, and that column's name: the
    identity of rows whose ids are null or repeat.  Rows of files have it from their place in them;
    others are numbered and stored."""
    name, taken = "_row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    place = _place_in_files(docs)
    if place is not None:
        return docs.withColumn(name, place), name
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def lowered(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(ASCII_LOWER)


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z only).  bytes.lower and bytes.split know ASCII
    alone, and the white space of the latter is that of the contracts."""
    return (text or "").encode().lower().split()


def release() -> None:
    """Gives memory that a Python worker has freed back to the system, where the C library can."""
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession, floor: int = 8) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))
