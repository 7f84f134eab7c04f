"""Statistics of tiles: per tile from pixels, and exact merges of stored statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilecairn.functions.pixels import decode, valid, without_outliers

STATS = "struct<count:bigint,sum:double,mean:double,min:double,max:double,stddev:double,sum_squares:double>"
FIELDS = ("count", "sum", "mean", "min", "max", "stddev", "sum_squares")
NAMES = ("count", "min", "max", "sum", "mean", "stddev")


def summary(values: np.ndarray, nodata=None, outliers: bool = False, mask: np.ndarray | None = None) -> dict | None:
    """Statistics of the valid pixels, None without any; stddev is of the population. With ``outliers``, floats
    without a nodata value lose what is ten interquartile ranges off. Sums are in doubles."""
    good = valid(values, nodata)
    if mask is not None:
        good &= mask
    v = values[good]
    if outliers and nodata is None and values.dtype.kind == "f":
        v = without_outliers(v)
    if not len(v):
        return None
    v = v.astype("f8")
    return {"count": len(v), "sum": float(v.sum()), "mean": float(v.mean()), "min": float(v.min()), "max": float(v.max()), "stddev": float(v.std()), "sum_squares": float((v * v).sum())}


def summary_udf(kind: str, nodata=None, compression: str | None = None, outliers: bool = False):
    """A function of a blob column that gives its STATS; null where no pixel is valid."""

    @F.pandas_udf(STATS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield frame([None if b is None else summary(decode(b, kind, compression), nodata, outliers) for b in s])

    return run


def frame(rows: list[dict | None]) -> pd.DataFrame:
    """Rows of STATS; None has null in every field."""
    none = dict.fromkeys(FIELDS)
    out = pd.DataFrame([r or none for r in rows], columns=list(none))
    out["count"] = out["count"].astype("Int64")
    return out


def array_summary(values: Column) -> Column:
    """STATS of an array of doubles by expressions alone; null elements do not count."""
    good = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size(good)
    total = F.aggregate(good, F.lit(0.0), lambda s, v: s + v)
    squares = F.aggregate(good, F.lit(0.0), lambda s, v: s + v * v)
    mean = total / n
    spread = F.sqrt(F.aggregate(good, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n)
    return F.when(n > 0, F.struct(n.cast("long").alias("count"), total.alias("sum"), mean.alias("mean"), F.array_min(good).alias("min"), F.array_max(good).alias("max"), spread.alias("stddev"), squares.alias("sum_squares")))


def stat_columns(stats: Column, band: str) -> list[Column]:
    """The columns {band}_count to {band}_stddev of a tile."""
    return [stats[n].alias(f"{band}_{n}") for n in NAMES]


def merged(count: Column, total: Column, mean: Column, low: Column, high: Column, stddev: Column) -> list[Column]:
    """Aggregates that merge per-tile statistics exactly: count, sum, mean, min, max, stddev."""
    n = F.sum(count)
    whole = F.sum(total)
    squares = F.sum(count * (stddev * stddev + mean * mean))
    average = F.try_divide(whole, n)
    spread = F.sqrt(F.greatest(F.try_divide(squares, n) - average * average, F.lit(0.0)))
    return [n.alias("count"), whole.alias("sum"), average.alias("mean"), F.min(low).alias("min"), F.max(high).alias("max"), spread.alias("stddev")]


def merged_of(stats: str) -> list[Column]:
    """merged() of a STATS column; its squares are summed as they are."""
    c = lambda n: F.col(f"{stats}.{n}")
    n, total, squares = F.sum(c("count")), F.sum(c("sum")), F.sum(c("sum_squares"))
    average = F.try_divide(total, n)
    return [n.alias("count"), total.alias("sum"), average.alias("mean"), F.min(c("min")).alias("min"), F.max(c("max")).alias("max"), F.sqrt(F.greatest(F.try_divide(squares, n) - average * average, F.lit(0.0))).alias("stddev")]


def merged_of_columns(band: str) -> list[Column]:
    """merged() of the stored statistics of a band."""
    return merged(*(F.col(f"{band}_{n}") for n in ("count", "sum", "mean", "min", "max", "stddev")))


def valid_percent(count: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(count / total * 100.0)


def scaled(count: Column, total: Column, levels: Column | int) -> list[Column]:
    """Count and sum at a zoom that is ``levels`` finer, in which a pixel is four."""
    k = F.pow(F.lit(4.0), levels if isinstance(levels, Column) else F.lit(levels))
    return [(count * k).cast("long").alias("count"), (total * k).alias("sum")]


def histogram_udf(kind: str, low: float, high: float, buckets: int, nodata=None, compression: str | None = None):
    """A function of a blob that gives how many valid pixels fall in each of so many equal buckets; the last
    holds its upper end, what lies outside counts nowhere. Counts of tiles add up."""

    @F.pandas_udf("array<bigint>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else counts(decode(b, kind, compression), low, high, buckets, nodata).tolist())

    return run


def counts(values: np.ndarray, low: float, high: float, buckets: int, nodata=None) -> np.ndarray:
    v = values[valid(values, nodata)].astype("f8")
    v = v[(v >= low) & (v <= high)]
    at = np.minimum(np.floor((v - low) / (high - low) * buckets).astype(np.int64), buckets - 1)
    return np.bincount(at, minlength=buckets)
