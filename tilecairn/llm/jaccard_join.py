"""Linking documents whose sets of word n-grams have a Jaccard similarity of at least a share."""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilecairn.llm.common import Scratch, shuffle_partitions, small_batches
from tilecairn.llm.components import connect, joined
from tilecairn.llm.postings import AT_ONCE, ROSTER, Hasher, answers, bucket_count, joined_bits, keyed
from tilecairn.llm.rolling import mixed

#: Members of a bucket that one task compares with another block's at a time.
BLOCK = 512
#: Words of 64 bits in a parity sketch.
SKETCH = 8
SETS = "rep long, n long, unique long, tokens array<long>, alone binary, sketch binary, keys array<long>, partial array<boolean>"
#: Members of a bucket outside its largest component up to which all are compared at once; a bucket with more is
#: split by segments of its own, so many times at most.
DIRECT, SPLITS = 16 * BLOCK, 2


class Similarity:
    """The bound 100 * |a and b| >= percent * |a or b| in terms of the symmetric difference."""

    def __init__(self, percent: int = 90):
        if not 50 < percent <= 100:
            raise ValueError("the percentage is over 50 and 100 at most")
        self.percent = percent

    def most(self, total: int) -> int:
        """The largest symmetric difference of two linked sets whose sizes have this sum."""
        return (100 - self.percent) * total // (100 + self.percent)

    def most_of(self, n: F.Column) -> F.Column:
        """The largest symmetric difference of a set of n and a set it is linked with."""
        return F.floor((100 - self.percent) * (n + F.floor(100 * n / self.percent)) / (100 + self.percent))

    def largest(self, n: int) -> int:
        """The largest set that a set of n can be linked with."""
        return 100 * n // self.percent

    @lru_cache(maxsize=4096)  # noqa: B019
    def band(self, n: int) -> int:
        """The size band of n: linked sets are in the same band or in bands side by side."""
        k, first = 0, 1
        while self.largest(first) + 1 <= n:
            first = self.largest(first) + 1
            k += 1
        return k

    @lru_cache(maxsize=4096)  # noqa: B019
    def plan(self, band: int) -> tuple[int, int]:
        """Of a band: how many segments the universe of tokens is cut into, and how many of them, the
        first ones, also have one-deletion neighbourhoods.

        Let d be the largest difference of a pair whose smaller set is in the band. A segment by itself
        finds pairs that agree in it, one with its one-deletion neighbourhood also those that differ
        there by one token; so p of the one and q of the other miss no pair if p + 2q > d. Of these
        allocations the cheapest is taken: rows written, and chance matches, which get rarer with the
        tokens of a segment and count a thousand times.
        """
        first = 1
        for _ in range(band):
            first = self.largest(first) + 1
        last = self.largest(first)
        d = self.most(last + self.largest(last))

        def cost(q: int) -> float:
            segments = d + 1 - 2 * q + q + (d + 1 - 2 * q < 0)
            tokens = first / segments
            return segments + q * tokens + 1000 * segments * 0.5**tokens

        q = min(range((d + 2) // 2 + 1), key=cost)
        return max(0, d + 1 - 2 * q) + q, q


def segment_keys(tokens: np.ndarray, unique: np.ndarray, band: int, m: int, q: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set in the segmentation of a band, and which of them stand for a segment less one token. Each turn
    has a segmentation of its own.

    A segment with a token that no other set holds can agree with none; in one with a neighbourhood, if
    there is one such token, only the neighbour without it is of use.
    """
    salt = np.uint64(((band + 1) * 0x9E3779B97F4A7C15 ^ turn * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
    spread = mixed(tokens ^ salt)
    segment = (spread % np.uint64(m)).astype(np.int64)
    value = mixed(spread ^ np.uint64(0x632BE59BD9B4E019))
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, segment, value)
    alone = np.bincount(segment, weights=unique, minlength=m)
    name = lambda s, total: mixed(mixed(s.astype(np.uint64) ^ salt) ^ total).astype(np.int64)
    clean = np.flatnonzero(alone == 0)
    less = np.flatnonzero((segment < q) & ((alone[segment] == 0) | ((alone[segment] == 1) & unique)))
    keys = np.concatenate([name(clean, sums[clean]), name(segment[less], sums[segment[less]] - value[less])])
    return keys, np.repeat([False, True], [len(clean), len(less)])


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash: two sets differ in at least as many tokens as their sketches in bits."""
    bits = np.bincount((mixed(tokens ^ np.uint64(0x2127599BF4325C37)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _sets(batches, width: int, buckets: int, percent: int):
    hasher, like = Hasher(width, fold=True), Similarity(percent)
    for big in batches:
        for batch in small_batches(big, 1024, AT_ONCE, 1):
            reps, texts, given = (c.to_pylist() for c in batch.columns[:3])
            rows = []
            for rep, (h, b), g in zip(reps, hasher.distinct(texts, buckets), given, strict=True):
                unique = ~joined_bits(len(h), b, g)
                if unique.sum() > like.most(len(h) + like.largest(len(h))):
                    continue
                band = like.band(len(h))
                found = [segment_keys(h, unique, k, *like.plan(k)) for k in (band, band - 1) if k >= 0]
                rows.append((rep, len(h), int(unique.sum()), h.view(np.int64), np.packbits(unique).tobytes(), sketch(h), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])))
            if rows:
                types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["rep", "n", "unique", "tokens", "alone", "sketch", "keys", "partial"])


_PLACED = ("key", "i", "j", "side", "rep", "partial", "component", "n", "unique", "sketch")


def _pairs_of(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks of a bucket, of different components, that sizes, unique tokens and sketches leave."""
    left, right = np.flatnonzero(x["side"] != 1), np.flatnonzero(x["side"] != 0)
    n, unique, component, less, reps = x["n"], x["unique"], x["component"], x["partial"], x["rep"]
    a, b = [], []
    for at in range(0, len(left), 64):
        i = left[at : at + 64, None]
        j = right[None, :]
        most = (100 - percent) * (n[i] + n[j]) // (100 + percent)
        fits = (component[i] != component[j]) & (unique[i] + unique[j] <= most) & (np.abs(n[i] - n[j]) <= most) & ~(less[i] & less[j]) & ((reps[i] < reps[j]) | (x["side"][i] != 2))
        i, j = np.nonzero(fits)
        if len(i):
            most = most[i, j]
            i, j = left[at : at + 64][i], right[j]
            close = np.bitwise_count(x["sketch"][i] ^ x["sketch"][j]).sum(axis=1) <= most
            a.append(reps[i[close]])
            b.append(reps[j[close]])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def _across(batches, percent: int):
    """Pairs (a, b) of the blocks in a partition whose rows are sorted by (key, i, j)."""
    held = None

    def groups(x: dict[str, np.ndarray], last: bool):
        nonlocal held
        if held is not None:
            x = {c: np.concatenate([held[c], x[c]]) for c in x}
        turns = np.flatnonzero((np.diff(x["key"]) != 0) | (np.diff(x["i"]) != 0) | (np.diff(x["j"]) != 0)) + 1
        edges = [0, *turns.tolist()] + [len(x["key"])] * last
        held = None if last else {c: v[edges[-1] :] for c, v in x.items()}
        for p, q in zip(edges[:-1], edges[1:], strict=True):
            if q - p > 1:
                yield _pairs_of({c: v[p:q] for c, v in x.items()}, percent)

    def rows(found: list):
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    empty = {c: np.empty(0, np.int64) for c in _PLACED} | {"partial": np.empty(0, bool), "sketch": np.empty((0, SKETCH), np.uint64)}
    for last in (False, True):
        for batch in batches if not last else [None]:
            x = empty
            if batch is not None:
                x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _PLACED if c != "sketch"}
                x["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH)
            elif held is None:
                continue
            if found := [p for p in groups(x, last) if len(p[0])]:
                yield rows(found)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets."""
    pick = lambda end: sets.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"), F.col("tokens").alias(f"tokens_{end}"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.join(pick("a"), "a").join(pick("b"), "b").where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def link_documents(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text", marks: bool = False) -> DataFrame:
    """One row per row of docs: the key, n_shingles, class_id and component_id; with ``marks`` also row (the
    hash of the text, which tells texts of one key apart) and first: whether the row has no set or is the
    one of its component with the smallest key, and of that with the smallest row. Repeated rows have the
    same mark.

    A document's set is its distinct ``width``-word shingles, A to Z lower-cased (with fewer words, the
    whole sequence as one). Two documents link when the Jaccard similarity of their sets is at least
    ``percent`` in a hundred; the component is the smallest key reachable by links, the class that of the
    documents with the same set. All links count: nothing is capped.

    1. Each distinct shingle is posted (postings.py), which tells which shingles no other set holds, and
       gives equal sets one class; from here on a class is one set. A set with more such shingles than
       any partner may differ by has no partner and is done.
    2. The rest are cut into segments by a hash of the shingle, the number by size band, and write keys
       of their segments and one-deletion neighbourhoods as Similarity.plan() allocates them.
    3. In each bucket of a key all are compared with its smallest member; components follow.
    4. Where a bucket still holds several components, those outside its largest one meet all members in
       blocks, within a task, after a bucket with very many of them is split again (_open_pairs()). Pairs of
       different components that pass exact bounds (sizes, unique shingles, parity sketches) are compared
       by whole sets.

    A null or empty text has no set and its own key as component. A null key ranks after the largest long and
    comes back as null. Repeated rows come back as often. An empty table gives an empty table; further columns
    are not read. A key that is not of an integer type raises a TypeError.
    """
    like, scratch = Similarity(percent), Scratch(docs.sparkSession)
    rows = keyed(docs, key, text)
    buckets = bucket_count(rows)
    found = scratch.cut(answers(rows, Hasher(width, fold=True), buckets, by_class=True))
    scratch.sweep()
    n, null = F.col("n"), F.col("n") < 0
    roster = found.where(F.col("kind") == ROSTER).select("doc", "row", F.when(null, -1 - n).otherwise(n).alias("n"), null.alias("null"), "owner", "other")
    classes = roster.where("n > 0").groupBy("owner", "other").agg(F.min(F.struct("doc", "null", "row")).alias("first"), F.first("n").alias("n"))
    bits = found.where(F.col("kind") != ROSTER).groupBy("owner", "other").agg(F.max("n").alias("shared"), F.min_by("given", F.col("given")[0]["flush"]).alias("given"))
    named = scratch.cut(classes.join(bits, ["owner", "other"], "left").select("owner", "other", "first", F.monotonically_increasing_id().alias("rep"), "n", "given", "shared"))
    open_ = named.where(F.col("n") - F.col("shared") <= like.most_of(F.col("n"))).select(F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), "rep", "given")
    once = rows.join(open_, ["doc", "row"]).dropDuplicates(["doc", "row"])
    sets = scratch.cut(once.select("rep", "text", "given").mapInArrow(partial(_sets, width=width, buckets=buckets, percent=percent), SETS))
    scratch.sweep()
    keys = sets.select("rep", F.explode(F.arrays_zip("keys", "partial")).alias("k")).select("rep", F.col("k.keys").alias("key"), F.col("k.partial").alias("partial")).groupBy("key", "rep").agg(F.min("partial").alias("partial"))
    counts = keys.groupBy("key").agg(F.count("*").alias("members"), F.min(F.when(~F.col("partial"), F.col("rep"))).alias("lead")).where("members > 1 and lead is not null")
    shared = scratch.cut(keys.join(counts, "key").select("key", "rep", "partial", "members", "lead"))
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = shared.where("rep <> lead").select(*ends(F.col("rep"), F.col("lead"))).distinct()
    component = connect(_verified(stars, sets.select("rep", "n", "tokens"), percent), scratch)
    pairs = _open_pairs(shared.select("key", "rep", "partial"), sets, component, percent, scratch)
    more = scratch.cut(_verified(pairs, sets.select("rep", "n", "tokens"), percent))
    if more.limit(1).count():
        component = joined(component, more, scratch)
    linked = named.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("owner", "other", F.col("first").alias("class"), F.coalesce("component", "rep").alias("component"))
    least = linked.groupBy("component").agg(F.min("class").alias("least"))
    known = scratch.cut(linked.join(least, "component").select("owner", "other", "class", "least"))
    for table in (named, sets, shared, more):
        scratch.drop(table)
    kind, own = docs.schema[key].dataType, F.struct("doc", "null", "row")
    back = lambda c: F.when(~c["null"], c["doc"]).cast(kind)
    out = roster.join(known, ["owner", "other"], "left").select(own.alias("own"), "n", F.coalesce("class", own).alias("class"), F.coalesce("least", own).alias("least"))
    first = [F.col("own.row").alias("row"), (F.col("least") == F.col("own")).alias("first")] if marks else []
    return out.select(back(F.col("own")).alias(key), F.col("n").alias("n_shingles"), back(F.col("class")).alias("class_id"), back(F.col("least")).alias("component_id"), *first)


def _split(batches, percent: int, turn: int):
    """Rows key, rep, partial, component of sets in the buckets that a turn splits theirs into."""
    like, last = Similarity(percent), np.uint64(turn)
    for big in batches:
        for batch in small_batches(big, 64, AT_ONCE, 4):
            for rep, component, within, tokens, alone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.array(tokens, np.int64).view(np.uint64)
                unique = np.unpackbits(np.frombuffer(alone, np.uint8), count=len(h)).astype(bool)
                band = like.band(len(h))
                found = [segment_keys(h, unique, k, *like.plan(k), turn) for k in (band, band - 1) if k >= 0]
                sub, less = (np.concatenate(x) for x in zip(*found, strict=True))
                salts = mixed(np.array(within, np.int64).view(np.uint64) + last)
                keys = mixed(sub.view(np.uint64)[None, :] ^ salts[:, None]).ravel().view(np.int64)
                less = np.tile(less, len(salts))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), rep)), pa.array(less), pa.array(np.full(len(keys), component))], ["key", "rep", "partial", "component"])


def _open_pairs(shared: DataFrame, sets: DataFrame, component: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a key and pass the bounds.

    Members of a bucket's largest component need not meet each other, so all its members meet those that are
    apart from it. Where very many are apart, which sets do that agree in an empty or common segment by chance,
    the bucket is split by a segmentation of its own, in which linked sets agree somewhere again: rows grow by
    the number of segments, the chance falls by the share of a segment. What SPLITS turns leave is compared by
    blocks whatever its size, so nothing is lost.
    """
    named = shared.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "partial", F.coalesce("component", "rep").alias("component"))
    out = None
    for turn in range(SPLITS + 1):
        parts = named.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("top"))
        open_ = parts.select("key", F.col("top.component").alias("top"), F.col("top.n").alias("most"), (F.col("members") - F.col("top.n")).alias("apart")).where("apart > 0")
        here = scratch.cut(named.join(open_, "key"))
        direct = here if turn == SPLITS else here.where(F.col("apart") <= DIRECT)
        met = _met(direct, sets, percent)
        out = met if out is None else out.unionByName(met)
        if turn == SPLITS or not here.where(F.col("apart") > DIRECT).limit(1).count():
            return out.distinct()
        within = here.where(F.col("apart") > DIRECT).groupBy("rep", "component").agg(F.collect_set("key").alias("within"))  # of one set, which has few keys
        dealt = within.join(sets.select("rep", "tokens", "alone"), "rep").select("rep", "component", "within", "tokens", "alone").repartition("rep")
        named = dealt.mapInArrow(partial(_split, percent=percent, turn=turn + 1), "key long, rep long, partial boolean, component long").groupBy("key", "rep", "component").agg(F.min("partial").alias("partial"))
        named = scratch.cut(named.select("key", "rep", "partial", "component"))


def _placed(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of open buckets (with top, most and apart) in all the pairs (i, j) of blocks that they are in.
    Blocks of the largest component come after the others and do not meet each other."""
    others, tops = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("apart", "most"))
    of_top = F.col("component") == F.col("top")
    mine = F.when(of_top, others + F.pmod(F.xxhash64("rep"), tops)).otherwise(F.pmod(F.xxhash64("rep"), others))
    last = F.when(of_top, others - 1).otherwise(others + tops - 1)
    slots = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), F.when(j == mine, 2).when(mine < j, 0).otherwise(1).alias("side")))
    placed = open_.join(sets.select("rep", "n", "unique", "sketch"), "rep").select("key", "rep", "partial", "component", "n", "unique", "sketch", F.explode(slots).alias("slot"))
    return placed.select("key", "slot.i", "slot.j", "slot.side", "rep", "partial", "component", "n", "unique", "sketch")


def _met(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in these buckets, by blocks within tasks."""
    dealt = _placed(open_, sets).select(*_PLACED).repartition(shuffle_partitions(sets.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(partial(_across, percent=percent), "a long, b long")
