"""A pipeline over the documents: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilecairn.llm.common import Scratch, full_text, scratch_root
from tilecairn.llm.jaccard_join import link_documents
from tilecairn.llm.line_dedup import dedup_lines
from tilecairn.llm.packing import pack
from tilecairn.llm.substring_dedup import without_passages
from tilecairn.llm.toxicity import detect_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text, and n_chars of that."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the detector rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return detect_toxic(docs.select(COLUMNS), labels).where("predicted = 0").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id has too go; documents stay, also if nothing is left."""
    return _with_text(dedup_lines(docs.select(COLUMNS)), "kept_text")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of five-word shingles) stays, that with the smallest id.

    Rows are told apart by id and text: where an id comes with several texts, each is in the group of its
    text, and of one group the text with the smallest hash stays. A null id is the largest, so such a row
    stays where its group has no other. Of repeated rows (same id and text) one stays. A text without a
    word is in no group and stays as often as it comes.
    """
    scratch = Scratch(spark)
    linked = link_documents(docs, width=5, percent=80, marks=True).where("n_shingles > 0")
    rows = linked.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_hash")).agg(F.first("first").alias("_first"), F.count("*").alias("_times"))
    marked = scratch.cut(rows.where("not _first or _times > 1"))
    base = docs.select(*COLUMNS, F.xxhash64(full_text("text")).alias("_row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash"))
    once = base.join(marked, same, "left_anti")
    repeated = base.join(marked.where("_first"), same, "left_semi").dropDuplicates(["doc_id", "_row"])
    return once.unionByName(repeated).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too go; documents stay, also if nothing is left."""
    return _with_text(without_passages(docs.select(COLUMNS)), "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in windows of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Packing and the detector's fit are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{i}-{name}")
    return docs
