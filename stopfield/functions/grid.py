"""The hierarchical square grid: cell ids are longs holding (resolution, row, column).

At resolution ``r`` the plane of longitude and latitude is cut in squares of 360 / 2**r degrees. The id packs the resolution in the top bits
and 26 bits each for row and column, so a parent is two shifts, a neighbour two additions, and every function stays in generated code.
Ids of the public H3 index that an input already carries keep working through :func:`h3_parent`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 26
MASK = (1 << BITS) - 1
EARTH_M = 6_371_000.0
METRES_PER_DEGREE = math.pi * EARTH_M / 180.0


def side_degrees(res: int) -> float:
    return 360.0 / (1 << res)


def side_metres(res: int) -> float:
    """North-south side of a cell."""
    return side_degrees(res) * METRES_PER_DEGREE


def resolution_for(metres: float, lowest: int = 2, highest: int = BITS) -> int:
    """Finest resolution whose cell is still at least ``metres`` high."""
    best = lowest
    for res in range(lowest, highest + 1):
        if side_metres(res) >= metres:
            best = res
    return best


def pack(res: int, row: Column, col: Column) -> Column:
    return F.lit(res << (2 * BITS)).cast("long").bitwiseOR(F.shiftleft(row.cast("long"), BITS)).bitwiseOR(col.cast("long"))


def cell(lon: Column, lat: Column, res: int) -> Column:
    """Cell of a coordinate; null where a coordinate is null."""
    scale = F.lit(float(1 << res))
    return pack(res, F.floor((lat + 180.0) * scale / 360.0), F.floor((lon + 180.0) * scale / 360.0))


def resolution(cell_id: Column) -> Column:
    return F.shiftright(cell_id, 2 * BITS).cast("int")


def row(cell_id: Column) -> Column:
    return F.shiftright(cell_id, BITS).bitwiseAND(F.lit(MASK).cast("long"))


def col(cell_id: Column) -> Column:
    return cell_id.bitwiseAND(F.lit(MASK).cast("long"))


def parent(cell_id: Column, res: int, to: int) -> Column:
    """Ancestor at the coarser resolution ``to`` of a cell of resolution ``res``."""
    step = res - to
    if step < 0:
        raise ValueError("a parent is coarser than its child")
    if step == 0:
        return cell_id
    return pack(to, F.shiftright(row(cell_id), step), F.shiftright(col(cell_id), step))


def children(cell_id: Column, res: int, to: int) -> Column:
    """Array of all descendants at the finer resolution ``to``."""
    step = to - res
    n = 1 << step
    base_row, base_col = F.shiftleft(row(cell_id), step), F.shiftleft(col(cell_id), step)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n * n - 1)),
        lambda i: pack(to, base_row + F.floor(i / n), base_col + F.pmod(i, F.lit(n))),
    )


def disk(cell_id: Column, res: int, k: int) -> Column:
    """Array of the cells at most ``k`` rows and columns away, the cell itself included."""
    width = 2 * k + 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(width * width - 1)),
        lambda i: pack(res, row(cell_id) + F.floor(i / width) - k, col(cell_id) + F.pmod(i, F.lit(width)) - k),
    )


def centre_lon(cell_id: Column, res: int) -> Column:
    return (col(cell_id) + 0.5) * F.lit(side_degrees(res)) - 180.0


def centre_lat(cell_id: Column, res: int) -> Column:
    return (row(cell_id) + 0.5) * F.lit(side_degrees(res)) - 180.0


def area_km2(cell_id: Column, res: int) -> Column:
    side = side_degrees(res) * METRES_PER_DEGREE / 1000.0
    return F.lit(side * side) * F.cos(F.radians(centre_lat(cell_id, res)))


def boundary(cell_id: Column, res: int) -> Column:
    """Closed ring of the four corners as an array of (lon, lat)."""
    s = side_degrees(res)
    west, south = col(cell_id) * F.lit(s) - 180.0, row(cell_id) * F.lit(s) - 180.0
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(
        corner(west, south), corner(west + s, south), corner(west + s, south + s), corner(west, south + s), corner(west, south)
    )


def h3_parent(cell_id: Column, to: int) -> Column:
    """Parent of an H3 index by its public bit layout: set the resolution bits, fill the freed three-bit digits with sevens."""
    cleared = cell_id.bitwiseAND(F.lit(~(15 << 52)).cast("long"))
    return cleared.bitwiseOR(F.lit(to << 52).cast("long")).bitwiseOR(F.lit((1 << (3 * (15 - to))) - 1).cast("long"))
