"""The folder that all executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder.  A temporary folder stands in only
    where driver and executors are one process; a cluster without a shared folder is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, batch_rows: int | None = None, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    batch_rows: rows of an Arrow batch in this job alone, as rows can be very long.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(ARROW_ROWS)
    try:
        if batch_rows:
            spark.conf.set(ARROW_ROWS, str(batch_rows))
        df.write.options(**options).parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect its garbage: the files of a shuffle go only once its plan is
    found to be unused, and would else lie on the executors' disks beside those of the next steps.
    Twice, as listeners hold a plan for a moment after it has ended."""
    for pause in (0, 1):
        time.sleep(pause)
        spark._jvm.System.gc()
