"""The street grid: scored cells, and the people of cells without a street moved to the nearest cell with one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.operators.apportion import redistribute
from stopfield.operators.spatial import lines_to_cells, nearest, street_cells

# A cell belongs to the grid within this distance of a street; donors move at most this far; reach of a line beyond a cell.
STREET_METRES, MOVE_METRES, REACH_METRES = 125.0, 300.0, 10.0


def move_roadless(cells: DataFrame, street: DataFrame, amounts: Sequence[str], res: int, cap: float) -> DataFrame:
    """Street cells with the amounts of the inhabited cells without a street added to their nearest one within ``cap``.

    Donors beyond the cap leave the table; compare totals before and after to log them.
    """
    at = lambda df: df.select("cell", grid.centre_lon(F.col("cell"), res).alias("lon"), grid.centre_lat(F.col("cell"), res).alias("lat"))
    kept = cells.join(street.select("cell"), "cell", "left_semi")
    donors = cells.join(street.select("cell"), "cell", "left_anti").filter(F.col(amounts[0]) > 0)
    moves = nearest(at(donors), at(kept).withColumnRenamed("cell", "recipient"), "cell", "recipient", cap)
    return redistribute(kept.unionByName(donors), moves.select(F.col("cell").alias("donor"), "recipient"), amounts).join(street.select("cell"), "cell", "left_semi")


def street_grid(edges: DataFrame, people: DataFrame, res: int, reach: float | None = None) -> DataFrame:
    """(cell, los, population): cells near a street with the best score of the lines in reach and the people moved onto them.

    ``edges``: segments with ``los``; ``people``: (cell, population) at the same resolution.
    """
    near = street_cells(edges, res, STREET_METRES)
    side = grid.side_metres(res)
    reach = side / 2 + REACH_METRES if reach is None else reach
    scores = lines_to_cells(edges, "los", res, reach, max(5 * side, STREET_METRES + side))
    cells = people.unionByName(near.join(people, "cell", "left_anti").withColumn("population", F.lit(0.0)))
    moved = move_roadless(cells, near, ["population"], res, MOVE_METRES)
    return moved.join(scores, "cell", "left").withColumn("los", F.coalesce("los", F.lit(0.0)))
