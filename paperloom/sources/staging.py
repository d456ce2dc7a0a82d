"""The folder that driver and executors share, and tables in it that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local session gets one of its own; a cluster has to name one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own, below the application's."""
    return f"{_own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes what this application wrote there: when no frame that reads it is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = new_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, most: int = 100_000) -> bool:
    """Whether ``df`` has ``most`` rows at most, so that a broadcast of it is bounded."""
    return df.limit(most + 1).count() <= most
