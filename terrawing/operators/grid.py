"""Problem 1: irregular readings onto a regular grid.

Consecutive readings are differenced, and each increment is spread over the
grid cells between the two readings in proportion to the overlap. For a
cumulative counter a fall is a reset, after which the counter counts from
zero; for a gauge the spread increments add up to its course through the
cell. A pair of readings further apart than max_gap covers nothing: the cells
between are another flight's, not empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrawing.operators.blocks import FIND, block_of, blocked, hot_sources, placeable


def regular_grid(
    df: DataFrame,
    source: list[str],
    time: str,
    gauges: list[str],
    counters: list[str] = (),
    step: float = 1.0,
    max_gap: float = 600.0,
    rows_per_block: int = 100_000,
) -> DataFrame:
    """One row per source and covered cell, and one per stretch of uncovered cells.

    Columns: source, slot (cell s is s * step <= t < (s + 1) * step),
    last_slot (of an uncovered stretch its last cell, else slot), n_samples, covered_s (seconds of the cell between two readings at most
    max_gap apart), each gauge (time-weighted mean of its course in the cell;
    the mean of the cell's readings where the course has no length), each
    counter as <name>_inc (its increase within the cell) and <name>_reset
    (whether it fell there), and mark: observed (has a sample), filled (has
    none, but a share of the increments of the pair around it) or uncovered
    (none of both: the cells between two samples more than max_gap apart). A
    gauge without reading on either side stays null.

    Samples that are equal in source, time, gauges and counters are one
    sample. Null, NaN and infinite times are dropped. A missing gauge reading is bridged
    from the readings before and after it if they are at most max_gap apart.
    An empty table gives an empty result; further columns are ignored.
    """
    slim = df.select(*source, F.col(time).cast("double").alias("_t"), *[F.col(c).cast("double").alias(c) for c in [*gauges, *counters]])
    part = [*source, "_block"]
    slim = placeable(slim, "_t")
    hot = hot_sources(slim, source, "_t", rows_per_block, step)
    # Once rows of a block are together, repeated deliveries go without another exchange.
    placed = blocked(slim, source, "_t", rows_per_block, max_gap + step, keep=True, hot=hot).repartition(*part).dropDuplicates([*part, "_t", *gauges, *counters])
    w = Window.partitionBy(*part).orderBy("_t")
    # Looking ahead is looking back in the opposite order: a frame that ends at the last row would be gone through once per row.
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*part).orderBy(F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, -1)

    rows = placed.withColumns({"_pt": F.lag("_t").over(w), "_nt": F.lead("_t").over(w)})
    rows = rows.withColumns({f"_p_{c}": F.lag(c).over(w) for c in counters})
    known = {c: F.when(F.col(c).isNotNull(), F.struct("_t", c)) for c in gauges}
    rows = rows.withColumns({f"_b_{c}": F.last(known[c], ignorenulls=True).over(before) for c in gauges})
    rows = rows.withColumns({f"_a_{c}": F.last(known[c], ignorenulls=True).over(after) for c in gauges})
    for c in gauges:
        p, n = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        span = n["_t"] - p["_t"]
        bridged = F.when((span > 0) & (span <= max_gap), p[c] + (n[c] - p[c]) * (F.col("_t") - p["_t"]) / span)
        rows = rows.withColumn(f"_x_{c}", F.coalesce(F.col(c), bridged)).drop(f"_b_{c}", f"_a_{c}")
    if gauges:
        rows = rows.withColumns({f"_px_{c}": F.lag(f"_x_{c}").over(w) for c in gauges})

    # Decimal noise of large clocks must not part a pair that is max_gap apart to the microsecond.
    width = F.col("_t") - F.col("_pt")
    joined = F.col("_pt").isNotNull() & (F.round(width, 6) <= max_gap)
    here, first = F.floor(F.col("_t") / step), F.when(joined, F.floor(F.col("_pt") / step)).otherwise(F.floor(F.col("_t") / step))
    pieces = rows.withColumn("_joined", joined).withColumn("slot", F.explode(F.sequence(first.cast("long"), here.cast("long")))).withColumn("_own", F.col("slot") == here)

    lo, hi = F.greatest(F.col("_pt"), F.col("slot") * step), F.least(F.col("_t"), (F.col("slot") + 1) * step)
    overlap = F.when(F.col("_joined"), F.greatest(hi - lo, F.lit(0.0))).otherwise(0.0)
    pieces = pieces.withColumn("_over", overlap).withColumn("_share", F.when(width > 0, F.col("_over") / width).otherwise(F.when(F.col("_own"), 1.0).otherwise(0.0)))
    middle = F.when(width > 0, ((lo + hi) / 2 - F.col("_pt")) / width)

    aggregates: list[Column] = [F.sum(F.when(F.col("_own"), 1).otherwise(0)).alias("n_samples"), F.sum("_over").alias("covered_s")]
    for c in gauges:
        x, px = F.col(f"_x_{c}"), F.col(f"_px_{c}")
        mean, weight = px + (x - px) * middle, F.when(px.isNotNull() & x.isNotNull(), F.col("_over"))
        aggregates += [F.coalesce(F.try_divide(F.sum(weight * mean), F.sum(weight)), F.avg(F.when(F.col("_own"), F.col(c)))).alias(c)]
    for c in counters:
        x, px = F.col(c), F.col(f"_p_{c}")
        inc = F.when(x >= px, x - px).otherwise(x)
        aggregates += [
            F.coalesce(F.sum(F.when(F.col("_joined") & px.isNotNull(), inc * F.col("_share"))), F.lit(0.0)).alias(f"{c}_inc"),
            F.coalesce(F.bool_or(F.col("_joined") & F.col("_own") & (x < px)), F.lit(False)).alias(f"{c}_reset"),
        ]
    # A cell belongs to the block in which it starts; halo copies let that block see all of its pieces.
    ends = [F.first("_cuts").alias("_cuts")]
    cells = pieces.groupBy(*part, "slot").agg(*aggregates, *ends)
    cells = cells.where(F.col("_block") == block_of(F.col("slot") * F.lit(float(step))))
    mark = F.when(F.col("n_samples") > 0, "observed").when(F.col("covered_s") > 0, "filled")
    named = [x for c in counters for x in (f"{c}_inc", f"{c}_reset")]
    covered = cells.select(*source, "slot", F.col("slot").alias("last_slot"), "n_samples", "covered_s", *gauges, *named, mark.alias("mark"))
    quiet = silences(slim, source, "_t", step, max_gap, rows_per_block, hot=hot).select(
        *source, F.col("from_slot").alias("slot"), F.col("to_slot").alias("last_slot"), F.lit(0).cast("long").alias("n_samples"), F.lit(0.0).alias("covered_s"),
        *[F.lit(None).cast("double").alias(c) for c in gauges], *[F.lit(None).cast(k).alias(f"{c}_{x}") for c in counters for x, k in (("inc", "double"), ("reset", "boolean"))],
        F.lit("uncovered").alias("mark"),
    )
    return covered.unionByName(quiet)


def silences(df: DataFrame, source: list[str], time: str, step: float = 1.0, max_gap: float = 600.0, rows_per_block: int = 100_000, hot: object = FIND) -> DataFrame:
    """The uncovered stretches that part flights: source, from_slot, to_slot (both without sample), silent_s.

    A stretch lies between two consecutive samples more than max_gap apart.
    Stretches within a block come from its own rows; those over a cut from
    the first and last time of each block, one row per block.
    """
    t = F.col("_t")
    placed = blocked(df.select(*source, F.col(time).cast("double").alias("_t")), source, "_t", rows_per_block, hot=hot)
    gap = F.round(t - F.col("_pt"), 6)
    within = placed.withColumn("_pt", F.lag("_t").over(Window.partitionBy(*source, "_block").orderBy("_t")))
    ends = placed.groupBy(*source, "_block").agg(F.min("_t").alias("_t"), F.max("_t").alias("_end"))
    across = ends.withColumn("_pt", F.lag("_end").over(Window.partitionBy(*source).orderBy("_block")))
    both = within.select(*source, "_pt", "_t").unionByName(across.select(*source, "_pt", "_t")).where(gap > max_gap)
    first, last = F.floor(F.col("_pt") / step).cast("long") + 1, F.floor(t / step).cast("long") - 1
    return both.select(*source, first.alias("from_slot"), last.alias("to_slot"), gap.alias("silent_s")).where("from_slot <= to_slot")
