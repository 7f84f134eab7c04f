"""Asking, for every distinct hash of every document, what the other documents hold.

A task hashes its documents and gathers postings for a while; of the postings of one hash in that
flush only one is sent, so a hash that very many documents share is one posting a flush. Postings go,
packed, to the bucket that a second, independent hash names; the bucket answers each flush with a bit a
posting, and the answers of a flush, brought together, give a row for each of its documents with a bit
that is set. A document's bits stand in the order of its sorted distinct hashes, so positions need not
travel.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilecairn.llm.common import full_text, modest_batches, shuffle_partitions, small_batches, whole_numbers
from tilecairn.llm.rolling import SIDE_BASE, mixed, window_hashes, word_hashes

#: Postings gathered before a flush, bytes of text that a bucket's postings stand for at most on
#: average, and bytes of text hashed at a time.
FLUSH, BUCKET_BYTES, AT_ONCE = 1_500_000, 24 << 20, 1 << 19
#: Kinds of rows: postings or their answers, bits known in the flush, the roster of all documents, and the
#: directory of those that posted, by whose places the other two name them.
POST, LOCAL, ROSTER, NAMES = 0, 1, 2, 3

POSTS = "kind int, bucket int, flush long, doc array<long>, row array<long>, owner array<long>, other array<long>, n array<long>, data binary"
ANSWERS = "kind int, doc long, row long, owner long, other long, n long, given array<struct<flush:long,part:int,bits:binary>>"
_LISTS = ("doc", "row", "owner", "other", "n")
_POSTS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("flush", pa.int64()), *((x, pa.list_(pa.int64())) for x in _LISTS), ("data", pa.binary())])
_GIVEN = pa.list_(pa.struct([("flush", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())]))
_ANSWERS = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in _LISTS), ("given", _GIVEN)])


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The columns doc (for a null key the largest long), row (a hash of the text), text and null (whether the
    key is). Keys are of an integer type."""
    whole_numbers(docs, key)
    modest_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(full_text(text)).alias("row"), full_text(text).alias("text"), F.col(key).isNull().alias("null"))


def bucket_count(rows: DataFrame) -> int:
    """Buckets for the postings of these texts: at least the shuffle partitions, more for more text."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(rows.sparkSession), -(-int(size) // BUCKET_BYTES))


class Hasher:
    """Distinct hashes of windows of so many words, with their buckets. With ``fold``, A to Z are
    lower-cased and a text of fewer words, but some, is one window."""

    def __init__(self, width: int, fold: bool = False):
        self.width, self.fold = width, fold

    def windows(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text, by the place of its first word: the hash and the second hash of each window."""
        raw = [t.encode() for t in texts]
        words, edges = word_hashes([r.lower() for r in raw] if self.fold else raw)
        first, second = window_hashes(words, self.width), window_hashes(words, self.width, SIDE_BASE)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if self.fold and 0 < b - a < self.width:
                out.append((window_hashes(words[a:b], b - a) ^ np.uint64(b - a), window_hashes(words[a:b], b - a, SIDE_BASE)))
            else:
                end = max(a, b - self.width + 1)
                out.append((first[a:end], second[a:end]))
        return out

    def distinct(self, texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text: its distinct hashes, sorted, and their buckets."""
        out = []
        for h, side in self.windows(texts):
            h, at = np.unique(h, return_index=True)
            out.append((h, (side[at] % np.uint64(buckets)).astype(np.int32)))
        return out


def class_of(h: np.ndarray) -> tuple[int, int]:
    """A set of hashes as two longs, the same for equal sets."""
    return (int(mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)), int(mixed(h ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64)))


def _post(batches, hasher: Hasher, buckets: int, by_class: bool):
    """Rows of posts. by_class: owners are the sets of hashes rather than the documents."""
    task, flushes = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []  # doc, row, owner, other, hashes, buckets
    seen: set = set()
    roster: list[tuple] = []
    total = 0

    def flush():
        nonlocal flushes, total
        name = task | flushes
        flushes += 1
        if roster:
            yield _row(ROSTER, name % buckets, name, list(zip(*roster, strict=True)), b"")
        if held:
            yield from _flushed(held, name, buckets, by_class)
        held.clear()
        seen.clear()
        roster.clear()
        total = 0

    for big in batches:
        for batch in small_batches(big, 4096, AT_ONCE, 2):
            docs, rows, texts, nulls = (c.to_pylist() for c in batch.columns)
            for doc, row, null, (h, b) in zip(docs, rows, nulls, hasher.distinct(texts, buckets), strict=True):
                owner, other = class_of(h) if by_class else (doc, 0)
                if by_class:
                    roster.append((doc, row, owner, other, -1 - len(h) if null else len(h)))
                    if (owner, other) in seen:
                        continue
                    seen.add((owner, other))
                if len(h):
                    held.append((doc, row, owner, other, h, b))
                    total += len(h)
                if total >= FLUSH:
                    yield from flush()
    yield from flush()


def _row(kind: int, bucket: int, flush: int, lists: list, data: bytes) -> pa.RecordBatch:
    columns = [[kind], [bucket], [flush], *([list(x)] for x in lists), [data]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _POSTS, strict=True)], schema=_POSTS)


def _flushed(held: list[tuple], name: int, buckets: int, by_class: bool):
    sizes = np.array([len(x[4]) for x in held])
    names = [[x[k] for x in held] for k in range(4)]
    h, bucket = np.concatenate([x[4] for x in held]), np.concatenate([x[5] for x in held])
    held.clear()  # the hashes are in one array now
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    owners = np.array(names[2], np.int64)
    order = np.argsort(h, kind="stable").astype(np.int32)
    starts = _turns(h, order)
    group = owners[at[order]]
    least = np.minimum.reduceat(group, starts)
    spans = np.diff(starts, append=len(h))
    local = np.empty(len(h), bool)
    marks = np.empty(0, np.int32)
    if by_class:
        many = least != np.maximum.reduceat(group, starts)
        local[order] = np.repeat(many, spans)
        marks = order[starts[many]]  # the hash goes out once for all of them
    else:
        local[order] = group > np.repeat(least, spans)
    del group, least, order
    firsts = np.cumsum(sizes) - sizes
    yield _row(NAMES, name % buckets, name, [*names, []], b"")
    if some := np.unique(at[local]).tolist():
        bits = b"".join(np.packbits(local[firsts[i] : firsts[i] + sizes[i]]).tobytes() for i in some)
        yield _row(LOCAL, name % buckets, name, [some, [], [], [], sizes[some].tolist()], bits)
    asked = np.flatnonzero(~local)
    at = np.concatenate([at[asked], np.full(len(marks), -1, np.int32)])
    index = np.concatenate([asked.astype(np.int32), marks])
    order = np.argsort(bucket[index], kind="stable")
    at, index = at[order], index[order]
    del order, asked, local
    cuts = np.flatnonzero(np.diff(bucket[index])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(index)], strict=True):
        if a == b:
            continue
        part = at[a:b]
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        who = part[edges]
        lists = [who, [], np.where(who < 0, 0, owners[who]), [], np.diff(edges, append=b - a)]
        yield _row(POST, int(bucket[index[a]]), name, lists, h[index[a:b]].tobytes())


def _turns(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where, in this order, a hash differs from the one before; the first counts."""
    turn = np.ones(len(h), bool)
    turn[1:] = h[order[1:]] != h[order[:-1]]
    return np.flatnonzero(turn)


def _answer(batches, by_class: bool):
    """The answers of the buckets in this partition: their posts with bits for hashes, where any is set.
    What needs no answer passes through. Posts are held as arrays."""
    buckets: dict[int, list[tuple]] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        passed = np.flatnonzero(kinds != POST)
        if len(passed):
            yield batch.take(pa.array(passed))
        lists = [batch.column(x) for x in ("doc", "owner", "n")]
        for i in np.flatnonzero(kinds == POST).tolist():
            arrays = [c[i].values.to_numpy().copy() for c in lists]
            buckets.setdefault(batch.column("bucket")[i].as_py(), []).append((batch.column("flush")[i].as_py(), *arrays, np.frombuffer(batch.column("data")[i].as_py(), np.uint64)))
    while buckets:
        bucket, posts = buckets.popitem()
        counts = [x[3] for x in posts]
        h = np.concatenate([x[4] for x in posts])
        posts = [x[:3] for x in posts]
        owner = np.repeat(np.concatenate([x[2] for x in posts]), np.concatenate(counts))
        order = np.argsort(h, kind="stable").astype(np.int32)
        starts, size = _turns(h, order), len(h)
        del h
        group = owner[order]
        least, spans = np.minimum.reduceat(group, starts), np.diff(starts, append=size)
        bit = np.empty(size, bool)
        bit[order] = np.repeat(least != np.maximum.reduceat(group, starts), spans) if by_class else group > np.repeat(least, spans)
        del owner, order, group, least
        at = 0
        for (flush, doc, _), n in zip(posts, counts, strict=True):
            edges = at + np.concatenate([[0], np.cumsum(n)])
            at = int(edges[-1])
            hit = np.flatnonzero((np.add.reduceat(bit[edges[0] : at], edges[:-1] - edges[0]) > 0) & (doc >= 0))
            if len(hit):
                bits = b"".join(np.packbits(bit[edges[i] : edges[i + 1]]).tobytes() for i in hit.tolist())
                yield _row(POST, bucket, flush, [doc[hit], [], [], [], n[hit]], bits)


def _assemble(table: pa.Table) -> pa.Table:
    """The answers of one flush as a row for each document that has one, n being its bits that are set, and
    the flush's roster."""
    given: dict[int, list] = {}
    rows, names = [], {}
    for x in table.to_pylist():
        if x["kind"] == ROSTER:
            rows += [(ROSTER, *y, None) for y in zip(*(x[k] for k in _LISTS), strict=True)]
            continue
        if x["kind"] == NAMES:
            names = x
            continue
        at = 0
        part = -1 if x["kind"] == LOCAL else x["bucket"]
        for i, n in zip(x["doc"], x["n"], strict=True):
            size = -(-n // 8)
            given.setdefault(i, []).append({"flush": x["flush"], "part": part, "bits": x["data"][at : at + size]})
            at += size
    rows += [(POST, *(names[k][i] for k in _LISTS[:4]), sum(int.from_bytes(x["bits"]).bit_count() for x in found), found) for i, found in given.items()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in _ANSWERS]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANSWERS, strict=True)], schema=_ANSWERS)


def answers(rows: DataFrame, hasher: Hasher, buckets: int, by_class: bool = False) -> DataFrame:
    """Rows of ANSWERS for keyed() rows: bits of documents whose hash a smaller document also holds, or by
    class, of those that another set holds too; then also a ROSTER row for each document, n being the size of
    its set, or where the key is null -1 less that.

    The answer that a flush gets tells all bits of its documents, whatever other flushes hold: of several answers
    to one document (repeated rows) or class any one will do."""
    posts = rows.mapInArrow(partial(_post, hasher=hasher, buckets=buckets, by_class=by_class), POSTS)
    found = posts.repartitionById(buckets, F.col("bucket")).mapInArrow(partial(_answer, by_class=by_class), POSTS)
    return found.groupBy("flush").applyInArrow(_assemble, ANSWERS)


def joined_bits(n: int, bucket: np.ndarray, given: list[dict]) -> np.ndarray:
    """The bits of a document's n sorted distinct hashes, from its answers (flush, part, bits)."""
    out = np.zeros(n, bool)
    flushes: dict[int, list] = {}
    for x in given:
        flushes.setdefault(x["flush"], []).append(x)
    for parts in flushes.values():
        bits = np.zeros(n, bool)
        for x in parts:
            if x["part"] < 0:
                bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n).astype(bool)
        asked = ~bits
        for x in parts:
            if x["part"] >= 0:
                at = np.flatnonzero(asked & (bucket == x["part"]))
                bits[at] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(at)).astype(bool)
        out |= bits
    return out
