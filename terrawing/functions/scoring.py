"""Small measures, colours and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def polygon_area(vertices: DataFrame, group: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """group and area by the shoelace formula over its vertices in order."""
    w = Window.partitionBy(group).orderBy(order)
    whole = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in (x, y)}
    return vertices.withColumn("_c", F.col(x) * n[y] - n[x] * F.col(y)).groupBy(group).agg((F.abs(F.sum("_c")) / 2).alias("area"))


def ramp(v: Column) -> list[Column]:
    """Blue over yellow to red for 0 to 1."""
    return [F.least(F.lit(1.0), v * 2), F.least(F.lit(1.0), 2 - v * 2), F.greatest(F.lit(0.0), 1 - v * 2)]


def colour_byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c, 0))).cast("int")


def colour_16bit(c: Column) -> Column:
    return colour_byte(c) * 257


def rate_label(done: Column, total: Column, elapsed: Column) -> Column:
    """done/total chunks, rate per minute and, while some are left, the time still to come. A rate on a rounding tie is rounded up, whatever its last bit."""
    rate = F.when(elapsed > 0, done / elapsed * 60.0 + 1e-9).otherwise(0.0)
    eta = F.when((done > 0) & (done < total), F.format_string(", ETA %.0fs", (total - done) * (elapsed / done) + 1e-9)).otherwise("")
    return F.concat(F.format_string("%d/%d chunks, %.1f/min", done, total, rate), eta)


def flipped(x: Column, y: Column, z: Column) -> list[Column]:
    """Between cameras that look along +z with y down and those that look along -z with y up."""
    return [x, -y, -z]


def prior_mode(has_pose: Column, has_intrinsics: Column) -> Column:
    """Which priors a run can use."""
    return F.when(has_pose & has_intrinsics, "pose_and_intrinsics").when(has_intrinsics, "intrinsics_only").otherwise("images_only")


def backbone(choice: Column, prior: Column, has_telemetry: Column, has_checkpoint: Column) -> tuple[Column, Column]:
    """Backbone (A, B, C) and priors (RGB, C, CP) that a run's choice comes to: without telemetry C with images alone; AUTO takes intrinsics, and poses with a tuned checkpoint."""
    auto = F.when(has_checkpoint, "CP").otherwise("C")
    return F.when(~has_telemetry, "C").otherwise(choice), F.when(~has_telemetry, "RGB").when(prior == "AUTO", auto).otherwise(prior)


def mean_gap(rows: DataFrame, group: str, order: str, marked: Column) -> DataFrame:
    """Mean distance between consecutive marked rows of a group, the length of a group of pictures: the way from the first to the last over the steps between; null for one row."""
    g = rows.where(marked).where(F.col(order).isNotNull()).groupBy(group).agg(F.min(order).alias("_a"), F.max(order).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return g.select(group, F.try_divide(F.col("_b") - F.col("_a"), F.col("_n") - 1).alias("mean_gap"))
