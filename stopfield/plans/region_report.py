"""The flagship question: how well is each region served, and where would housing or transit help?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopfield.functions import grid
from stopfield.operators.rollup import positive, roll, los_mean, weighted_mean
from stopfield.operators.stats import density_fit, equity_flag


def region_report(units: DataFrame, region: str, fine: int, coarse: int, served_above: float = 0.0, gate: float = 1000.0) -> DataFrame:
    """Per region and for the whole (null): coarse cells, residents, weighted score, served share and how many cells carry each flag.

    Units go to fine cells, cells to coarse cells within their region by the three-tier mean, the score is fitted on log density per region
    and every coarse cell is flagged against its region's fit.
    """
    cell = grid.parent(grid.cell(F.col("lon"), F.col("lat"), fine), fine, coarse)
    los = los_mean(F.col("los"), F.col("population"), F.col("jobs"))
    cells = roll(units.withColumn("cell", cell), [region, "cell"], {"population": "sum", "jobs": "sum"}, extra=[los.alias("los")])
    cells = cells.withColumn("density", F.col("population") / grid.area_km2(F.col("cell"), coarse))
    flagged = equity_flag(cells, density_fit(cells, [region], "density", "los"), [region], "density", "los", gate)
    people = F.col("population")
    return flagged.rollup(region).agg(
        F.count("*").alias("cells"),
        F.sum(people).alias("population"),
        weighted_mean(F.col("los"), people).alias("los"),
        (F.sum(F.when(F.col("los") > served_above, people).otherwise(0.0)) / positive(F.sum(people))).alias("served_share"),
        F.count_if(F.col("flag") == "more_housing").alias("more_housing"),
        F.count_if(F.col("flag") == "more_transit").alias("more_transit"),
    )
