"""Predicates on cell ids as ranges, which Parquet readers can prune by.

An expression of the id (its zoom, a tile's box) prunes nothing; the same question as BETWEEN over the id
does, since tables are sorted by it. The exact predicate stays as a residual where the ranges are wider.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilecairn.functions.cells import zoom_range
from tilecairn.functions.geometry import Area, Cover, cover

#: Ranges that one predicate holds at most.
MOST_RANGES = 32


def in_zoom(block: Column, zoom: int) -> Column:
    return block.between(*zoom_range(zoom))


def in_ranges(block: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether an id lies in one of the ranges; false without any."""
    tests = [block == a if a == b else block.between(a, b) for a, b in ranges]
    return reduce(lambda p, q: p | q, tests) if tests else F.lit(False)


def in_cover(block: Column, found: Cover, most: int = MOST_RANGES) -> Column:
    """Whether an id is in a cover: a few wide ranges for the reader, and where those were closed over gaps, also the
    exact test. That is a search in the sorted ranges, done in Arrow batches of ids, so that the plan stays
    small however many ranges there are."""
    wide = found.merged(most)
    test = in_ranges(block, wide)
    return test if len(wide) == len(found.merged(1 << 30)) else test & found_udf(found)(block)


def found_udf(found: Cover):
    """A function of an id that says whether it is in a cover."""

    @F.pandas_udf("boolean")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(found.place(ids.to_numpy()) >= 0)

    return run


def intersects(block: Column, area: Area, zoom: int, mode: str = "intersects") -> Column:
    """Whether the tile of an id meets an area, at the zoom of the table."""
    return in_cover(block, cover(area, zoom, mode))
