"""Tables that a job writes under the shared folder of the session to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new local folder if the executors are threads of this machine,
    else an error, as no other machine could read it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tilecairn-"))
        found = sc.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder under the shared one; it goes when the JVM ends, or by remove()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{new_folder(spark, 'cut')}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a frame that cut() gave, from its files."""
    spark = df.sparkSession
    path = df.inputFiles()
    if not path:
        return 0, 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path[0]).getParent()
    return df.count(), p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
