"""Document fingerprints by one-permutation MinHash; DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilecairn.llm.common import WORD, full_text, shuffle_partitions, whole_numbers

#: Bins of the permutation, a power of two, and low-order bits kept of each; 8 bits are two hex digits.
BIN_BITS, KEPT_BITS = 7, 8
BINS = 1 << BIN_BITS
MASK63, LOW = (1 << 63) - 1, (1 << KEPT_BITS) - 1


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """63-bit hashes of the runs of so many words; a text of fewer words, but some, is one run."""
    hashed = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        run = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))).bitwiseAND(MASK63)
        many = F.transform(F.sequence(F.lit(0), F.size(h) - words), run)
        return F.when(F.size(h) >= words, many).when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseAND(MASK63))).otherwise(F.array().cast("array<bigint>"))

    return _let(hashed, runs)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint_bytes(hashes: Column) -> Column:
    """The kept bits of each bin as bytes; an empty array where there are no hashes.

    Each hash is used once: its highest bits name the bin, in which the least hash stays. An empty bin
    takes the value of the bin that comes first in a random order of its own over all bins (optimal
    densification): of the filled ones, that with the least hash of both numbers.
    """

    def least(h: Column) -> Column:
        bin_of = lambda x: F.shiftright(x, 63 - BIN_BITS)
        return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))

    def filled(h: Column) -> Column:
        bins = F.transform(h, lambda x: F.shiftright(x, 63 - BIN_BITS))

        def at(i: Column, b: Column) -> Column:
            own = F.array_position(b, i)
            ranked = F.transform(h, lambda x: F.xxhash64(i, F.shiftright(x, 63 - BIN_BITS)).bitwiseAND(~LOW).bitwiseOR(x.bitwiseAND(LOW)))
            return F.when(own > 0, F.get(h, (own - 1).cast("int"))).otherwise(F.array_min(ranked)).bitwiseAND(LOW).cast("int")

        every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda i: i)
        return F.when(F.size(h) > 0, _let(bins, lambda b: F.transform(every, lambda i: (at(i, b) - (LOW + 1) // 2).cast("tinyint")))).otherwise(F.array().cast("array<tinyint>"))

    return _let(F.sort_array(hashes), lambda h: _let(least(h), filled))


def packed(values: Column) -> Column:
    """The bins' bits as lowercase hex, two digits a bin."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.substring(F.hex(v.cast("long") + (LOW + 1) // 2 + (LOW + 1)), -2, 2)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of two texts' shingles from their fingerprints' values: the share
    of equal bins, less what chance makes equal. Two fingerprints without bins are alike, one is not."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 1 / (LOW + 1)
    share = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(share)


def with_next(rows: DataFrame, key: str, tie: str, values: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """derive(rows), worked out where the rows are dealt, with columns next_<value> of the row that follows by descending key (ties by ascending ``tie``;
    null keys last); the first row follows the last.

    Rows go to partitions by ranges of the key, whose bounds are quantiles of the keys alone, so each
    row's values travel once. The first key of each range, one a partition, is known to the driver; its
    rows are also put at the end of the range before, so that no range lacks its last row's neighbour.
    """
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    cuts = rows.select(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], F.lit(10_000)).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts))
    wide = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    below = lambda xs, o: F.size(F.filter(xs, lambda x: x < o))
    step = below(longs([c[-1] for c in chunks]), order)
    inner = F.split(F.get(F.split(F.lit(";".join(",".join(map(str, c)) for c in chunks)), ";"), step), ",").cast("array<bigint>")
    place = (step * wide + F.coalesce(below(inner, order), F.lit(0))) if chunks else F.lit(0)
    placed = rows.withColumn("_order", order).withColumn("_place", place)
    heads = {r["_place"]: r["_first"] for r in placed.groupBy("_place").agg(F.max("_order").alias("_first")).collect()}
    if not heads:
        alone = derive(rows)
        return alone.select("*", *(F.lit(None).cast(alone.schema[v].dataType).alias(f"next_{v}") for v in values))
    used = sorted(heads)  # ascending; the next range by descending key is the one below
    before = {p: used[(i + 1) % len(used)] for i, p in enumerate(used)}
    most = max(used) + 1
    first = longs([heads.get(p, 0) for p in range(most)])
    back = longs([before.get(p, 0) for p in range(most)])
    is_head = F.get(first, F.col("_place")) == F.col("_order")
    spots = F.when(is_head, F.array(F.struct(F.col("_place").cast("int").alias("p"), F.lit(0).alias("g")), F.struct(F.get(back, F.col("_place")).cast("int").alias("p"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("_place").cast("int").alias("p"), F.lit(0).alias("g"))))
    spread = placed.withColumn("_spot", F.explode(spots)).withColumn("_p", F.col("_spot.p")).withColumn("_g", F.col("_spot.g")).drop("_spot", "_place")
    dealt = derive(spread.repartitionById(most, F.col("_p")))
    w = Window.partitionBy("_p").orderBy("_g", F.col("_order").desc(), F.col(tie))
    out = dealt.select("*", *(F.lead(v).over(w).alias(f"next_{v}") for v in values))
    return out.where("_g = 0").drop("_p", "_g", "_order")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next.

    The edited text is the text with its last third, floor(n_chars / 3) code points, replaced by the first
    as many (or all) of the text of the next document by descending key, after the last the first.
    A fingerprint has BINS bins of KEPT_BITS bits, in hex; near_edited and near_next estimate the Jaccard
    similarity of the five-word shingles with those of the edited and of the next text.

    Texts are shuffled once, by ranges of the key. A null text is empty; the empty text has an empty
    fingerprint, like only to another empty one; a null key comes last; rows of one key follow each other
    by a hash of their text, and of repeated rows each is the next of another. A single row is its own
    next. An empty table gives an empty table; further columns are not read. A key that is not of an integer
    type raises a TypeError.
    """
    whole_numbers(docs, key)
    rows = docs.select(F.col(key).alias("_key"), full_text(text).alias("_text"), F.xxhash64(full_text(text)).alias("_tie"))
    marked = lambda df: df.withColumn("_values", fingerprint_bytes(shingle_hashes(F.col("_text"))))
    both = with_next(rows, "_key", "_tie", ["_text", "_values"], marked)
    n = F.char_length("_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - cut), F.substring("next__text", F.lit(1), cut))
    both = both.select("_key", n.cast("long").alias("n_chars"), "_values", F.col("next__values").alias("_next"), edited.alias("_edited"))
    both = both.withColumn("_edited_values", fingerprint_bytes(shingle_hashes(F.col("_edited"))))
    return both.select(
        F.col("_key").alias(key),
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        packed(F.col("_values")).alias("fingerprint"),
        packed(F.col("_edited_values")).alias("edited_fingerprint"),
        likeness(F.col("_values"), F.col("_edited_values")).alias("near_edited"),
        likeness(F.col("_values"), F.col("_next")).alias("near_next"),
    )
