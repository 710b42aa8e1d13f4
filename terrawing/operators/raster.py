"""Point clouds to sparse rasters: one row per cell that has a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrawing.operators.quantiles import exact_quantiles
from terrawing.runtime import cut


def rasterise(points: DataFrame, cell: float, bands: dict[str, Column]) -> DataFrame:
    """row, col, each band's aggregate and n; row 0 is the northernmost. Further columns width and height hold the grid's size."""
    box = points.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    rows = points.join(F.broadcast(box), F.lit(True))
    wide, high = F.ceil((F.col("_x1") - F.col("_x0")) / cell).cast("bigint") + 1, F.ceil((F.col("_y1") - F.col("_y0")) / cell).cast("bigint") + 1
    col = F.least(F.floor((F.col("x") - F.col("_x0")) / cell).cast("bigint"), wide - 1)
    row = F.least(F.floor((F.col("_y1") - F.col("y")) / cell).cast("bigint"), high - 1)
    cells = rows.groupBy(row.alias("row"), col.alias("col")).agg(*[a.alias(n) for n, a in bands.items()], F.count(F.lit(1)).alias("n"), F.first(wide).alias("width"), F.first(high).alias("height"))
    return cells


def surface(points: DataFrame, cell: float = 0.2, least: int = 10) -> DataFrame:
    """Highest z and mean colours per cell; a cloud of fewer than ``least`` points gives no raster."""
    enough = points.limit(least).agg((F.count(F.lit(1)) >= least).alias("_ok"))
    cells = rasterise(points, cell, {"height_m": F.max("z"), "red": F.avg("r"), "green": F.avg("g"), "blue": F.avg("b")})
    return cells.join(F.broadcast(enough), F.lit(True)).where("_ok").drop("_ok", "width", "height")


def coverage(points: DataFrame, cell: float = 0.2) -> DataFrame:
    """Mean view_count and confidence of a cell's voxels."""
    return rasterise(points, cell, {"views": F.avg("view_count"), "conf": F.avg("confidence")})


def unobserved(cells: DataFrame) -> DataFrame:
    """One row: share of the grid's cells without point."""
    return cells.agg((1 - F.count(F.lit(1)) / F.first(F.col("width") * F.col("height"))).alias("unobserved"))


def stretched(cells: DataFrame, band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds ``shade``: the band clipped to its quantiles and scaled to 0..1; null if they are equal."""
    cells = cut(cells.sparkSession, cells)
    q = exact_quantiles(cells, band, {"_lo": low, "_hi": high}).select("_lo", "_hi")
    clipped = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(band)))
    return cells.join(F.broadcast(q), F.lit(True)).withColumn("shade", F.try_divide(clipped - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")
