"""Splitting the series of hot sources into blocks of time that workers can take apart."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrawing.runtime import cut, kept, small

#: More rows than this (hot sources, or blocks of them) aren't broadcast; they are joined with a shuffle.
MOST_BROADCAST = 50_000
#: Blocks that a source is cut into at most; of a source of more than so many times rows_per_block rows the blocks are larger. Results don't depend on the cuts.
MOST_BLOCKS = 20_000

_CUTS = "array<array<double>>"


def _up_to(cuts: Column, x: Column) -> Column:
    """How many cuts lie at or before x; the cuts come in groups, so that only two short arrays are looked through."""
    groups = F.size(F.filter(cuts, lambda g: g[0] <= x))
    inside = F.size(F.filter(F.get(cuts, F.greatest(groups - 1, F.lit(0))), lambda c: c <= x))
    return F.when(groups == 0, 0).otherwise((groups - 1) * F.size(cuts[0]) + inside)


def block_of(x: Column) -> Column:
    """The block in which a value of the order lies, from the column that ``blocked(keep=True)`` leaves."""
    return F.when(F.col("_cuts").isNull(), 0).otherwise(_up_to(F.col("_cuts"), x)).cast("int")


def placeable(df: DataFrame, order: str) -> DataFrame:
    """Rows with a place in a series: those whose order is neither null nor NaN nor infinite."""
    return df.where(F.abs(F.col(order).cast("double")) < float("inf"))


def hot_sources(df: DataFrame, source: list[str], order: str, rows_per_block: int, align: float | None = None) -> DataFrame | None:
    """Sources of more than 2 * rows_per_block rows with ``_cuts``, the places where their blocks begin; None if there are none.

    A first job counts the rows of each source, made per partition first; a
    second one, over the hot sources' rows only, takes the quantiles of
    ``order`` (a sketch of bounded size per source), so that neither bursts nor
    stray times make a block large. Both read the source and order columns
    only, and neither is computed again by what uses the result.
    """
    names = [f"_s{i}" for i in range(len(source))]
    named = df.select(*[F.col(c).alias(n) for c, n in zip(source, names)], F.col(order).cast("double").alias("_o"))
    counted = named.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * rows_per_block)
    hot, n = kept(counted.select(*names, F.least(F.ceil(F.col("_n") / rows_per_block), F.lit(MOST_BLOCKS)).cast("int").alias("_parts")), MOST_BROADCAST)
    if not n:
        return None
    most = hot.agg(F.max("_parts")).first()[0]
    steps = 8 * most  # fine enough that every source's own share of them is even
    shares = F.split(F.lit(",".join(repr(i / steps) for i in range(1, steps))), ",").cast("array<double>")
    hot = small(hot.select(*[F.col(c).alias(f"_h{c}") for c in names], "_parts"), MOST_BROADCAST, n)
    theirs = named.join(hot, [F.col(c).eqNullSafe(F.col(f"_h{c}")) for c in names])
    q = theirs.groupBy(*names).agg(F.percentile_approx("_o", shares, max(10_000, 20 * most)).alias("_q"), F.first("_parts").alias("_parts"))
    mine = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.col("_q")[F.round(i * steps / F.col("_parts")).cast("int") - 1])
    if align:
        mine = F.transform(mine, lambda x: F.floor(x / align) * align)
    c, width = F.col("_c"), isqrt(most) + 1
    grouped = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / width).cast("int")), lambda g: F.slice(c, g * width + 1, width))
    cuts, n = kept(q.select(*names, F.array_sort(F.array_distinct(mine)).cast("array<double>").alias("_c")).select(*names, grouped.cast(_CUTS).alias("_cuts")), MOST_BROADCAST)
    return small(cuts, MOST_BROADCAST, n)


def joined_cuts(df: DataFrame, hot: DataFrame | None, source: list[str]) -> DataFrame:
    """df with ``_cuts``, null for sources that aren't hot."""
    if hot is None:
        return df.withColumn("_cuts", F.lit(None).cast(_CUTS))
    names = [f"_s{i}" for i in range(len(source))]
    return df.join(hot, [df[c].eqNullSafe(F.col(n)) for c, n in zip(source, names)], "left").drop(*names)


#: Said of cuts: find them.
FIND = object()


def blocked(df: DataFrame, source: list[str], order: str, rows_per_block: int, halo: float = 0.0, align: float | None = None, keep: bool = False, hot: object = FIND) -> DataFrame:
    """Adds ``_block`` (int) and ``_core`` (boolean) to df.

    A source of at most 2 * rows_per_block rows is one block, 0. A larger one
    is cut along ``order`` at its quantiles into blocks of about rows_per_block
    rows each, more only where so many rows share one value of order (with
    align: one stretch between multiples of it, on which cuts then fall). A
    row within halo of a block comes again in that block, with _core false, so
    that what is near a cut can be computed inside one block; results must be
    kept for core rows only. With keep, the column that block_of needs stays.
    hot is what hot_sources said, if it has been asked already.

    Rows whose order is null, NaN or infinite are dropped: they have no place
    in a series. Null source values form a source of their own, cut as any other.
    """
    df = placeable(df, order)
    o = F.col(order).cast("double")
    hot = hot_sources(df, source, order, rows_per_block, align) if hot is FIND else hot
    if hot is None:
        return (joined_cuts(df, None, source) if keep else df).withColumns({"_block": F.lit(0), "_core": F.lit(True)})
    joined = joined_cuts(df, hot, source)
    extra = [] if keep else ["_cuts"]
    if not halo:
        return joined.withColumns({"_block": block_of(o), "_core": F.lit(True)}).drop(*extra)
    first = F.when(F.col("_cuts").isNull(), 0).otherwise(_up_to(F.col("_cuts"), o - F.lit(float(halo)))).cast("int")
    return (
        joined.withColumns({"_own": block_of(o), "_block": F.explode(F.sequence(first, block_of(o + F.lit(float(halo)))))})
        .withColumn("_core", F.col("_block") == F.col("_own"))
        .drop("_own", *extra)
    )


def neighbours(df: DataFrame, source: list[str], order: str, ties: list[str], value: Column, rows_per_block: int = 200_000) -> DataFrame:
    """Adds ``_prev`` and ``_next``: the last non-null value at or before each row, and the first one after it.

    Rows of a source follow each other by ``order`` and then ``ties``. A hot
    source is cut into blocks; what a block needs from others, the last value
    before it and the first after it, comes from one row per block.
    """
    df = placeable(df.withColumn("_v", value), order)
    hot = hot_sources(df, source, order, rows_per_block)
    part, by = [*source, *(["_block"] if hot is not None else [])], [order, *ties]
    rows = df if hot is None else joined_cuts(df, hot, source).withColumn("_block", block_of(F.col(order).cast("double")))
    up = Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in by]).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_prev", F.last("_v", ignorenulls=True).over(up)).withColumn("_next", F.last("_v", ignorenulls=True).over(down)).drop("_v")
    if hot is None:
        return inside
    place = F.struct(*by)
    ends = rows.where("_cuts is not null").groupBy(*part).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_end"), F.min_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_begin")
    )
    w = Window.partitionBy(*source)
    carried = ends.select(
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)],
        F.last("_end", ignorenulls=True).over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.last("_begin", ignorenulls=True).over(w.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"),
    )
    carried, n = kept(carried, MOST_BROADCAST)
    joined = inside.join(small(carried, MOST_BROADCAST, n), [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)], "left")
    return joined.withColumns({"_prev": F.coalesce("_prev", "_carry"), "_next": F.coalesce("_next", "_ahead")}).drop("_carry", "_ahead", "_block", "_cuts", *[f"_p{i}" for i in range(len(part))])


def numbered(df: DataFrame, source: list[str], order: list[str], name: str, rows_per_block: int = 200_000) -> DataFrame:
    """Adds ``name``, the 0-based place of each row of a source by ``order``, whose first column is a number, and ``_total``, the source's rows.

    The rows are numbered inside blocks; a block begins where the counts of
    those before it, of which there is one row each, end. Rows without order
    come first.
    """
    o = F.coalesce(F.col(order[0]).cast("double"), F.lit(float("-inf")))
    df = df.withColumn("_no", F.when(F.isnan(o), float("inf")).otherwise(o))
    hot = hot_sources(df, source, "_no", rows_per_block)
    part = [*source, *(["_block"] if hot is not None else [])]
    rows = df if hot is None else joined_cuts(df, hot, source).withColumn("_block", block_of(F.col("_no")))
    place = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    if hot is None:
        return rows.withColumns({name: place, "_total": F.count(F.lit(1)).over(Window.partitionBy(*part))}).drop("_no")
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*source)
    starts = counts.select(
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)],
        F.coalesce(F.sum("_n").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(w).alias("_total"),
    )
    starts, n = kept(starts, MOST_BROADCAST)
    joined = rows.withColumn(name, place).join(small(starts, MOST_BROADCAST, n), [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)], "left")
    return joined.withColumn(name, F.col(name) + F.col("_start")).drop("_start", "_no", "_block", "_cuts", *[f"_p{i}" for i in range(len(part))])
