"""Cell ids: a tile (x, y, zoom) as one sortable positive long.

    cell = 0x48 << 56 | zoom << 52 | morton(x, y) << (52 - 2 zoom) | ones in the bits below

Bit i of x is bit 2i of the Morton code and bit i of y is bit 2i + 1. Ids sort by zoom and then along the
Z-order, so all cells of a zoom, and all descendants of a cell at a zoom, are one range of ids each.
Everything here is bit arithmetic on BIGINT columns and stays within code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ZOOM = 26
#: The bits that every cell has.
BASE = 0x4800000000000000
LOW52 = (1 << 52) - 1
EVEN = 0x5555555555555555
ZOOM_BITS = 31 << 52


def _long(v: Column | int) -> Column:
    return v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long")


def left(v: Column | int, by: Column | int) -> Column:
    """v shifted left by a column of bits."""
    return F.call_function("shiftleft", _long(v), by.cast("int") if isinstance(by, Column) else F.lit(by))


def right(v: Column, by: Column | int) -> Column:
    """v shifted right, without its sign, by a column of bits."""
    return F.call_function("shiftrightunsigned", _long(v), by.cast("int") if isinstance(by, Column) else F.lit(by))


def spread(v: Column) -> Column:
    """The bits of v with a zero after each: its binary digits read as digits to base 4. The column is named once
    only, so that expressions that nest this stay small."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def compact(v: Column) -> Column:
    """Every second bit of v, from the lowest on: digits to base 4, which are 0 and 1, read as binary ones."""
    return F.conv(F.conv(v.bitwiseAND(F.lit(EVEN)).cast("string"), 10, 4), 2, 10).cast("long")


def _below(zoom: Column) -> Column:
    """The ones under the Morton code of a cell of this zoom."""
    return left(1, 52 - 2 * zoom) - 1


def tile_to_cell(x: Column, y: Column, zoom: Column | int) -> Column:
    """The cell of a tile; null where a part is null."""
    z = _long(zoom)
    code = left(spread(_long(x)).bitwiseOR(left(spread(_long(y)), 1)), 52 - 2 * z)
    return F.lit(BASE).bitwiseOR(left(z, 52)).bitwiseOR(code).bitwiseOR(_below(z))


def resolution(cell: Column) -> Column:
    """The zoom of a cell."""
    return right(cell, 52).bitwiseAND(F.lit(31)).cast("int")


def _morton(cell: Column) -> Column:
    return right(cell.bitwiseAND(F.lit(LOW52)), 52 - 2 * resolution(cell))


def cell_x(cell: Column) -> Column:
    return compact(_morton(cell))


def cell_y(cell: Column) -> Column:
    return compact(right(_morton(cell), 1))


def cell_to_tile(cell: Column) -> Column:
    """A struct of x, y and zoom."""
    return F.struct(cell_x(cell).alias("x"), cell_y(cell).alias("y"), resolution(cell).alias("z"))


def parent(cell: Column, zoom: Column | int) -> Column:
    """The ancestor at a zoom of at most the cell's own."""
    z = _long(zoom)
    return cell.bitwiseAND(F.lit(~ZOOM_BITS)).bitwiseOR(left(z, 52)).bitwiseOR(_below(z))


def descendants(cell: Column, zoom: Column | int) -> tuple[Column, Column]:
    """The first and last cell at a zoom of at least the cell's own that lie in it."""
    z, own = _long(zoom), _below(_long(resolution(cell)))
    bare = cell.bitwiseAND(F.lit(~ZOOM_BITS))
    top = left(z, 52)
    return bare.bitwiseAND(F.bitwise_not(own)).bitwiseOR(top).bitwiseOR(_below(z)), bare.bitwiseOR(top).bitwiseOR(own)


def is_cell(v: Column) -> Column:
    """Whether a long is a valid cell: its fixed bits, its zoom, and the ones at its end."""
    z = resolution(v)
    ones = _below(_long(z))
    return (v.bitwiseAND(F.lit(~(ZOOM_BITS | LOW52))) == BASE) & (z <= MOST_ZOOM) & (v.bitwiseAND(ones) == ones)


# The same for single values on the driver.


def cell_of(x: int, y: int, z: int) -> int:
    code = sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(z))
    return BASE | z << 52 | code << (52 - 2 * z) | ((1 << (52 - 2 * z)) - 1)


def tile_of(cell: int) -> tuple[int, int, int]:
    z = (cell >> 52) & 31
    code = (cell & LOW52) >> (52 - 2 * z)
    return sum(((code >> (2 * i)) & 1) << i for i in range(z)), sum(((code >> (2 * i + 1)) & 1) << i for i in range(z)), z


def zoom_range(z: int) -> tuple[int, int]:
    """The range of ids that holds every cell of a zoom."""
    return BASE | z << 52, BASE | z << 52 | LOW52


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def checked_block_size(n: int) -> int:
    """A block size that tables may have: a power of two, 16 at least."""
    if not is_power_of_two(n) or n < 16:
        raise ValueError(f"a block size is a power of two from 16 on, not {n}")
    return n
