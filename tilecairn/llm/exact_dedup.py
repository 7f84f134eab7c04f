"""Exact dedup by deterministic block naming."""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilecairn.llm.common import SPACES, Scratch, modest_batches, small_batches

SPACE_BYTES = SPACES.encode()
#: Bytes of a block of normalised text, and of text given out at a time.
BLOCK, AT_ONCE = 8192, 4 << 20
#: The name that an odd last block is paired with, and the first name, downwards, of blocks whose mark others
#: share; all other names are 0 or more, so the three never meet.
PAD, FIRST_SHARED = -1, -2


def _blocks(text: str, size: int) -> tuple[bytes, list[bytes]]:
    """The text without white space, whole and in blocks; the empty text is one empty block."""
    raw = text.encode().translate(None, SPACE_BYTES)
    return raw, [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]


def _mark(block: bytes, bits: int) -> int:
    """A hash of a block as a signed long; fewer bits make blocks share it, as tests do."""
    h = xxhash.xxh3_64_intdigest(block) >> (64 - bits)
    return h - (1 << 64) if h >= 1 << 63 else h


def _describe(batches, size: int, bits: int):
    for big in batches:
        for batch in small_batches(big, 8192, AT_ONCE, 1):
            n, sha, marks = [], [], []
            for text in batch.column(1).to_pylist():
                raw, blocks = _blocks(text, size)
                n.append(len(text))
                sha.append(hashlib.sha256(raw).hexdigest())
                marks.append([_mark(b, bits) for b in blocks])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(marks, pa.list_(pa.int64()))], ["key", "n_chars", "text_sha256", "marks"])


def _contents(batches, size: int, bits: int, places: bool):
    """Marks and blocks, distinct within a batch; or with places, all of them with the document's tag."""
    for big in batches:
        for batch in small_batches(big, 8192, AT_ONCE, 1):
            out = {} if not places else []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, blocks = _blocks(text, size)
                if places:
                    tag = f"{key}:{hashlib.sha256(raw).hexdigest()}"
                    out += [(_mark(b, bits), b, tag, i) for i, b in enumerate(blocks)]
                else:
                    out.update(((_mark(b, bits), b), None) for b in blocks)
            columns = list(zip(*out, strict=True))
            types, names = [pa.int64(), pa.binary(), pa.string(), pa.int32()], ["mark", "block", "tag", "at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: len(columns)])


def _numbered(df: DataFrame, *by: str) -> DataFrame:
    """Distinct rows with an integer name each: their places in sorted order within sorted partitions."""
    return df.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, scratch: Scratch, key: str, text: str, block_bytes: int = BLOCK, mark_bits: int = 64) -> DataFrame:
    """A scratch table with a row per row of docs: rid, key, n_chars, text_sha256, level and name. Two rows have
    the same level and name exactly if their texts without white space are the same bytes.

    Blocks: all distinct ones are sorted by a mark, a hash, and then by their bytes, and get integer
    names. Where a mark has one block only, which is known from that sort, the mark leads to the name;
    where several blocks share a mark, the bytes do. Then adjacent names are paired (an odd last one with
    PAD, which names nothing), distinct pairs are sorted and named, and so on until each document has one name, at the level
    that its number of blocks gives.
    """
    modest_batches(docs.sparkSession)
    source = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_chars", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("marks", T.ArrayType(T.LongType()))])
    rows = scratch.cut(source.mapInArrow(partial(_describe, size=block_bytes, bits=mark_bits), schema).withColumn("rid", F.monotonically_increasing_id()))
    contents = source.mapInArrow(partial(_contents, size=block_bytes, bits=mark_bits, places=False), "mark long, block binary")
    named = scratch.cut(_numbered(contents, "mark", "block").groupBy("mark").agg(F.min("name").alias("name"), F.count("*").alias("blocks")))
    scratch.sweep()
    now = rows.select("rid", F.size("marks").alias("n"), F.posexplode("marks").alias("at", "mark"), "key", "text_sha256")
    if named.where("blocks > 1").limit(1).count():
        shared = named.where("blocks > 1").select("mark")
        exact = scratch.cut(_numbered(contents.join(shared, "mark", "left_semi"), "mark", "block").select("mark", "block", (FIRST_SHARED - F.col("name")).alias("name")))
        placed = source.mapInArrow(partial(_contents, size=block_bytes, bits=mark_bits, places=True), "mark long, block binary, tag string, at int")
        placed = placed.join(exact, ["mark", "block"]).select("tag", "at", F.col("name").alias("exact")).dropDuplicates(["tag", "at"])
        now = now.withColumn("tag", F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("None")), "text_sha256")).join(placed, ["tag", "at"], "left")
        now = now.join(named.select("mark", "name"), "mark").withColumn("name", F.coalesce("exact", "name"))
    else:
        now = now.join(named.select("mark", "name"), "mark")
    now = scratch.cut(now.select("rid", "n", "at", "name"))
    scratch.drop(named)
    level, done = 0, now.where("n = 1").select("rid", F.lit(0).alias("level"), "name")
    while now.where("n > 1").limit(1).count():
        level += 1
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = now.where("n > 1").groupBy("rid", "n", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(side(0).alias("left"), F.coalesce(side(1), F.lit(PAD)).alias("right"))
        pairs = scratch.cut(pairs)
        names = scratch.cut(_numbered(pairs.select("left", "right"), "left", "right"))
        now = scratch.cut(pairs.join(names, ["left", "right"]).select("rid", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), "at", "name"))
        scratch.drop(pairs)
        scratch.drop(names)
        done = done.union(now.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    return scratch.cut(rows.drop("marks").join(done, "rid"))


def dedup_exact(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, mark_bits: int = 64) -> DataFrame:
    """One row per row of docs: the key, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Rows are equal when their texts are after deleting white space; of equal ones the row with the most
    code points in its text, then with the smallest key, stays (of repeated rows, one). Whole texts go
    over the network once, as distinct blocks; afterwards only integers do. Groups are counted with
    partial sums, and a block or a group that very many rows share joins a table of single rows, whose
    large side can be split.

    A null text counts as empty, and empty texts are one group; a null key counts as the largest. An
    empty table gives an empty table; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = name_documents(docs, scratch, key, text, block_bytes, mark_bits)
    best = F.min(F.struct(-F.col("n_chars"), F.col("key").isNull(), F.col("key").alias("key"), F.col("rid").alias("rid"))).alias("best")
    groups = scratch.cut(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), best).select("level", "name", "group_size", F.col("best.key").alias("keep_id"), F.col("best.rid").alias("keep")))
    return rows.join(groups, ["level", "name"]).select(F.col("key").alias(key), "keep_id", "group_size", (F.col("rid") == F.col("keep")).alias("kept"), "text_sha256")
