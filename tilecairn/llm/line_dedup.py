"""Removing lines that several documents share; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilecairn.llm.common import SPACES, Scratch, full_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, threshold: int = 2, least_chars: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with columns n_lines, n_dropped and kept_text.

    A text is split at line feeds. Where a line's key has at least ``least_chars`` code points and is
    found in at least ``threshold`` documents, its lines go from all but the document with the smallest
    key; within that document all of them stay. Lines are compared by 96 bits of two hashes and their
    length. Only hashes are shuffled to be counted, with partial sums on the map side, so a line that
    many documents share is one row a task; the positions to drop then meet each text once. Texts are split and
    hashed once: the lines' hashes and places go to a scratch table, which is read to count and to drop, and
    so do the counts.

    A null text is one empty line, as the empty text is. A row with a null key counts as no document:
    nothing is dropped from it or for its sake. Rows that share a key are one document; repeated rows
    come back as often. An empty table stays empty. Columns with the added names are replaced.
    """
    if threshold < 2:
        raise ValueError("the threshold counts documents and is 2 at least")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.drop("n_lines", "n_dropped", "kept_text")
    keyed = base.select(F.col(key).alias("_doc"), full_text(text).alias("_text")).where(F.col("_doc").isNotNull())
    lines = keyed.select("_doc", F.xxhash64("_text").alias("_row"), F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
    lines = lines.withColumn("_line", line_key(F.col("_line"))).where(F.char_length("_line") >= least_chars)
    lines = scratch.cut(lines.select("_doc", "_row", "_at", F.xxhash64("_line").alias("_h"), F.hash("_line", F.char_length("_line")).alias("_g")))
    first, last = F.min("_doc").alias("_first"), F.max("_doc").alias("_last")
    if threshold == 2:
        shared = lines.groupBy("_h", "_g").agg(first, last).where("_first < _last").select("_h", "_g", "_first")
    else:
        per_doc = lines.select("_h", "_g", "_doc").distinct()
        shared = per_doc.groupBy("_h", "_g").agg(first, F.count("*").alias("_n")).where(F.col("_n") >= threshold).select("_h", "_g", "_first")
    shared = scratch.cut(shared)
    dropped = lines.join(shared, ["_h", "_g"]).where("_doc > _first").groupBy("_doc", "_row").agg(F.collect_set("_at").alias("_drop"))
    dropped = scratch.cut(dropped)
    scratch.drop(lines)
    scratch.drop(shared)
    scratch.sweep()
    whole = base.select(F.struct(*base.columns).alias("_base"), F.col(key).alias("_doc"), full_text(text).alias("_text"))
    joined = whole.withColumn("_row", F.xxhash64("_text")).join(dropped, ["_doc", "_row"], "left").withColumn("_lines", F.split("_text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    return joined.select(
        "_base.*",
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")).alias("kept_text"),
    )
