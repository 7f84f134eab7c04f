"""Helpers that several operators share: scratch tables, text columns and hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
#: Regular expression of a word: a longest run of other characters.
WORD = r"[^ \t\n\x0B\f\r]+"
#: Rows of an Arrow batch at most, in sessions whose texts go to Python.
ARROW_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ARROW_ROWS, if there are more. A batch of whole texts by the
    default number of rows is tens of MB outside the heap, twice while it grows, which the process keeps.
    Operators that give texts to Python do this first, as the setting counts when their plan runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def scratch_root(spark: SparkSession) -> str:
    """The folder for scratch tables: under spark.checkpoint.dir; where that is unset, a new local one if the
    executors are threads of this machine, else an error, as no other machine could read it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tilecairn-"))
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Tables that one run of an operator writes to cut lineage; removed when the JVM ends, or by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/op-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and return a frame that reads it; the shuffle files behind df can then go."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table of this scratch folder that no later step reads."""
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path), True)

    def sweep(self) -> None:
        """Let Spark drop the shuffle files of frames that are no longer referenced."""
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_numbers(docs: DataFrame, key: str) -> None:
    """Raise where the key is not of an integer type."""
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"the key {key} must be of an integer type")


def full_text(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def small_batches(batch, rows: int, size: int, column: int):
    """Slices of an Arrow batch with at most so many rows and, beyond one row, about so many bytes of a column."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)
