"""The folder that all executors share: checkpoints and intermediate tables.

``spark.checkpoint.dir`` names it. A path without scheme belongs to the session's default file system, as
everywhere in Spark, so it is qualified by Hadoop before anything is written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority of its file system, in the form scheme://authority/path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    scheme, _, rest = found.partition(":")
    return found if rest.startswith("//") else f"{scheme}://{rest}"


def configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where it is unset and all runs on one machine, as in tests, a temporary one. On a cluster that raises RuntimeError."""
    context = spark.sparkContext
    found = configured(spark) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridweave-")
    found = qualified(spark, found)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals both sides to tasks by key. Spark would broadcast a side that it takes for small, so through the driver, and takes packed files for smaller than their rows: for sides that grow with the input."""
    return df.hint("merge")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as parquet to the shared folder and read again: later steps take the columns and rows that they need, and neither repeat its work nor lose it with an executor."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
