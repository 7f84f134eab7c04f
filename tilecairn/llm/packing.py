"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilecairn.llm.bpe import json_encoding
from tilecairn.llm.common import modest_batches

#: Windows that one differencing balances, and the longest piece given to it; both bound a task's work.
GROUP_WINDOWS, LONGEST_PIECE = 128, 256


def difference(sizes: list[int], k: int) -> np.ndarray:
    """Window of each piece when differencing deals the sizes into k windows of near-equal sums.

    Every piece starts as a partial partition, itself in one window and nothing in the others. The two
    partial partitions with the largest spreads are merged, the fullest window of one with the emptiest
    of the other, until one is left; going back over the merges gives each piece its window.
    """
    n = len(sizes)
    sums: list[np.ndarray] = []
    for s in sizes:
        v = np.zeros(k, np.int64)
        v[0] = s
        sums.append(v)
    parents: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        v = sums[a] + sums[b][::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        sums.append(v - v[-1])
        sums[a] = sums[b] = None
        parents.append((a, b, order))
        heapq.heappush(heap, (int(v[-1] - v[0]), len(sums) - 1))
    out = np.zeros(n, np.int64)
    todo = [(heap[0][1], np.arange(k))] if n else []
    while todo:
        i, windows = todo.pop()
        if i < n:
            out[i] = windows[0]
            continue
        a, b, order = parents[i - n]
        placed = np.empty(k, np.int64)
        placed[order] = windows
        todo += [(a, placed), (b, placed[::-1])]
    return out


def balance(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Windows of the pieces, and their count: the least that could hold them, raised while differencing
    fills one beyond the capacity. No piece may be larger than the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if np.bincount(windows, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return windows, k
        k += 1


class _Packer:
    """Pieces of one task's documents, in windows numbered from a start of the task's own."""

    COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.full = first, capacity, GROUP_WINDOWS * capacity
        self.waiting: list[tuple] = []
        self.total = 0
        self.keys: list = []
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        """Whole windows of the document are windows; the rest waits, in pieces, to be balanced."""
        n, at = len(ids), 0
        crc = lambda a, b: zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes())
        while n - at >= self.capacity:
            self.keys.append(key)
            self.rows.append((at, self.capacity, crc(at, at + self.capacity), n, self.next, 0))
            self.next += 1
            at += self.capacity
        while at < n:
            size = min(n - at, LONGEST_PIECE, self.full - self.total)
            self.waiting.append((key, at, size, crc(at, at + size), n))
            self.total += size
            at += size
            if self.total == self.full:
                self.flush()

    def flush(self) -> None:
        sizes = [x[2] for x in self.waiting]
        if sizes:
            windows, k = balance(sizes, self.capacity)
            filled = [0] * k
            names = np.cumsum(np.bincount(windows, minlength=k) > 0) - 1
            for (key, at, size, crc, n), w in zip(self.waiting, windows.tolist(), strict=True):
                self.keys.append(key)
                self.rows.append((at, size, crc, n, self.next + int(names[w]), filled[w]))
                filled[w] += size
            self.next += int(names[-1]) + 1
        self.waiting, self.total = [], 0

    def take(self, key_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(self.keys, key_type), *(pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True))]
        self.keys, self.rows = [], []
        return pa.RecordBatch.from_arrays(columns, ["key", *self.COLUMNS])


def _pack_batches(batches, path: str, pattern: str, capacity: int, end_id: int):
    encoding, kind = json_encoding(path, pattern), pa.int64()
    packer = _Packer(TaskContext.get().partitionId() << 40, capacity)
    end = np.array([end_id], np.uint32)
    for batch in batches:
        kind = batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            packer.add(key, np.concatenate([encoding.encode(text.as_py() or ""), end]))
            if len(packer.rows) >= 10_000:
                yield packer.take(kind)
    packer.flush()
    if packer.rows:
        yield packer.take(kind)


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: the key, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids and then ``end_id``. Its whole windows become sequences of exactly the
    capacity; what is left is cut into pieces of at most LONGEST_PIECE ids, and differencing deals the
    pieces of GROUP_WINDOWS windows' worth of ids into near-equal windows. Each task packs the rows of
    its own partition as they stream by, so there is no shuffle, a task holds one group at a time, and a
    task that is run again gives the same rows; sequence ids start at the partition's number times 2^40.
    Padding is at most one window a group and one a partition.

    A null or empty text is the end id alone; a null key stays null; repeated rows are packed each; an
    empty table gives no rows; further columns are not read.
    """
    modest_batches(docs.sparkSession)
    fields = [T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in _Packer.COLUMNS)]
    out = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text")).mapInArrow(partial(_pack_batches, path=tokenizer_path, pattern=pattern, capacity=capacity, end_id=end_id), T.StructType(fields))
    return out.withColumnRenamed("key", key)
