"""Removing passages that repeat across documents: Rabin-Karp hashes of every window of words."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilecairn.llm.common import Scratch, full_text, small_batches
from tilecairn.llm.postings import AT_ONCE, Hasher, answers, bucket_count, joined_bits, keyed

RESULT = "doc long, row long, null boolean, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


def covered(n_words: int, starts: np.ndarray, width: int) -> tuple[np.ndarray, list[dict]]:
    """Mask of the words under windows that start at these places, and the maximal intervals they merge into."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    mask = np.cumsum(edges)[:-1] > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return mask, [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]


def _cut(batches, width: int, buckets: int):
    hasher = Hasher(width)
    for big in batches:
        for batch in small_batches(big, 4096, AT_ONCE, 2):
            texts, given = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            hit = [i for i, g in enumerate(given) if g]
            hashed = dict(zip(hit, hasher.windows([texts[i] for i in hit]), strict=True))
            n_words, n_removed, spans, kept = [], [], [], []
            for i, text in enumerate(texts):
                words = text.encode().split()
                mask, found = None, []
                if i in hashed:
                    h, side = hashed[i]
                    distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
                    bits = joined_bits(len(distinct), (side[at] % np.uint64(buckets)).astype(np.int32), given[i])
                    mask, found = covered(len(words), np.flatnonzero(bits[back]), width)
                n_words.append(len(words))
                n_removed.append(int(mask.sum()) if mask is not None else 0)
                spans.append(found)
                kept.append((b" ".join(words) if mask is None else b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m)).decode())
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "row", "null", "n_words", "n_removed", "spans", "kept_text"])


def dedup_passages(docs: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, the hash of its text (row), n_words, n_removed, spans and kept_text.

    A window is ``width`` consecutive words of one document. Each word under a window that also starts
    in a document with a smaller key goes; repeated windows merge into the maximal intervals in
    ``spans`` (places of words, end exclusive), and the kept words are joined by one space. Windows are
    judged on the input. They are compared by a Rabin-Karp hash of 64 bits within buckets that a second
    such hash names.

    Every window is posted once a flush of a task (see postings.py), packed, 8 bytes each; the answers,
    which only documents with repeats have, are written to a scratch table, and then each text meets its
    answers in one join by key and text hash.

    A null text has no words; a null key ranks with the largest long, so that nothing goes for its sake, and
    is given back as null. Rows with the same key or rank do not count as repeats of one another. Repeated rows
    come back as often. A key that is not of an integer type raises a TypeError. An empty table gives an empty table; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs, key, text)
    buckets = bucket_count(rows)
    found = scratch.cut(answers(rows, Hasher(width), buckets).select("doc", "row", "given"))
    scratch.sweep()
    given = found.groupBy("doc", "row").agg(F.min_by("given", F.col("given")[0]["flush"]).alias("given"))
    out = rows.join(given, ["doc", "row"], "left").select("doc", "row", "text", "null", "given").mapInArrow(partial(_cut, width=width, buckets=buckets), RESULT)
    return out.select(F.when(~F.col("null"), F.col("doc")).cast(docs.schema[key].dataType).alias(key), "row", "n_words", "n_removed", "spans", "kept_text")


def without_passages(docs: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each text's words cut as by dedup_passages() and joined by one space; where nothing goes,
    the text stays as it is. Further columns are kept; a column n_removed is added."""
    last = F.lit((1 << 63) - 1)
    rank = F.coalesce(F.col(key).cast("long"), last).alias("_key")
    cut = dedup_passages(docs, width, key, text).where("n_removed > 0").select(rank, F.col("row").alias("_row"), "n_removed", "kept_text").dropDuplicates(["_key", "_row"])
    base = docs.select(F.struct(*docs.columns).alias("_base"), rank, F.xxhash64(full_text(text)).alias("_row"))
    joined = base.join(cut, ["_key", "_row"], "left")
    columns = [F.coalesce("kept_text", F.col("_base")[c]).alias(c) if c == text else F.col("_base")[c].alias(c) for c in docs.columns if c != "n_removed"]
    return joined.select(*columns, F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))
