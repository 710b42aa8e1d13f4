"""Voxel fusion of point clouds, nearest neighbours and outliers.

Sums are in doubles. A voxel's sums are made per partition first and merged
then, so a voxel, or a chunk, that holds a third of all points costs one row
per partition in the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrawing.operators.quantiles import exact_quantiles
from terrawing.runtime import cut

#: Bits per axis of a packed voxel key, and the origin's offset.
BITS, OFFSET = 21, 1 << 20


def usable(points: DataFrame, least_conf: float = 0.1) -> DataFrame:
    """Points with finite place and confidence of at least least_conf that aren't masked; a null mask doesn't mask."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    keep = (F.col("conf") >= least_conf) & ~F.coalesce(F.col("masked"), F.lit(False))
    for c in ("x", "y", "z", "conf"):
        keep = keep & finite(c)
    return points.where(keep)


def voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """One bigint per voxel: floor(axis / size) + OFFSET, clamped to BITS, packed."""
    cell = lambda v: F.least(F.greatest(F.floor(v / F.lit(size)).cast("bigint") + OFFSET, F.lit(0)), F.lit((1 << BITS) - 1)).cast("bigint")
    return F.shiftleft(cell(x), 2 * BITS).bitwiseOR(F.shiftleft(cell(y), BITS)).bitwiseOR(cell(z))


def fuse(points: DataFrame, size: float, least_conf: float = 0.1, least_count: int = 1) -> DataFrame:
    """voxel_key, confidence-weighted means of x, y, z, r, g, b, view_count (points), distinct_views and confidence (largest)."""
    sums = [F.sum(F.col("conf") * F.col(c)).alias(f"_{c}") for c in ("x", "y", "z", "r", "g", "b")]
    rows = usable(points, least_conf).withColumn("voxel_key", voxel_key(F.col("x"), F.col("y"), F.col("z"), size))
    cells = rows.groupBy("voxel_key").agg(
        F.sum("conf").alias("_w"), *sums, F.count(F.lit(1)).alias("view_count"), F.max("conf").alias("confidence"), F.countDistinct("view_pos").alias("distinct_views")
    )
    kept = cells.where((F.col("_w") > 1e-9) & (F.col("view_count") >= least_count))
    return kept.select("voxel_key", *[(F.col(f"_{c}") / F.col("_w")).alias(c) for c in ("x", "y", "z", "r", "g", "b")], "view_count", "distinct_views", "confidence")


def merge(fused: DataFrame, batch: DataFrame) -> DataFrame:
    """Sums of two tables of partial sums (voxel_key, w, wx, ..., n, conf): the incremental form of fuse."""
    both = fused.unionByName(batch)
    return both.groupBy("voxel_key").agg(*[F.sum(c).alias(c) for c in fused.columns if c not in ("voxel_key", "conf")], F.max("conf").alias("conf"))


def partial_sums(points: DataFrame, size: float, least_conf: float = 0.1) -> DataFrame:
    rows = usable(points, least_conf).withColumn("voxel_key", voxel_key(F.col("x"), F.col("y"), F.col("z"), size))
    return rows.groupBy("voxel_key").agg(F.sum("conf").alias("w"), *[F.sum(F.col("conf") * F.col(c)).alias(f"w{c}") for c in "xyz"], F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf"))


def budget_size(points: DataFrame, most: int) -> float:
    """Voxel size that leaves about ``most`` points: from the box's volume, corrected once if it leaves more than 1.5 times as many."""
    box = points.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"], F.count(F.lit(1)).alias("n")).first()
    if not box["n"] or box["n"] <= most:
        return 0.0
    volume = 1.0
    for c in "xyz":
        volume *= max(box[f"hi_{c}"] - box[f"lo_{c}"], 1e-6)
    size = (volume / most) ** (1 / 3)
    left = down_sampled(points, size).count()
    return size * (left / most) ** (1 / 3) if left > 1.5 * most else size


def down_sampled(points: DataFrame, size: float) -> DataFrame:
    """The mean point of each cell of a grid anchored at the box's lowest corner; a size of 0 keeps the points."""
    if size <= 0:
        return points.select("x", "y", "z", F.lit(1).cast("bigint").alias("n"))
    low = points.agg(*[F.min(c).alias(f"_lo_{c}") for c in "xyz"])
    cells = points.join(F.broadcast(low), F.lit(True)).groupBy(*[F.floor((F.col(c) - F.col(f"_lo_{c}")) / size).cast("bigint").alias(f"_{c}") for c in "xyz"])
    return cells.agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n")).drop("_x", "_y", "_z")


def above_median(points: DataFrame, column: str = "conf") -> DataFrame:
    """Points whose value exceeds the exact median of all."""
    m = exact_quantiles(points, column, {"_m": 0.5}).select("_m")
    return points.join(F.broadcast(m), F.lit(True)).where(F.col(column) > F.col("_m")).drop("_m")


def at_least_quantile(points: DataFrame, column: str, share: float) -> DataFrame:
    """Points whose value isn't below the exact quantile of all."""
    q = exact_quantiles(points, column, {"_q": share}).select("_q")
    return points.join(F.broadcast(q), F.lit(True)).where(F.col(column) >= F.col("_q")).drop("_q")


def near_pairs(queries: DataFrame, points: DataFrame, cell: float, query_id: str, point_id: str) -> DataFrame:
    """query, point and distance of all points in a query's grid cell and the 26 around it: a join on cells, not of all with all."""
    key = lambda c: F.floor(F.col(c) / cell).cast("bigint")
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    q = queries.select(F.col(query_id).alias("query"), *[F.col(c).alias(f"q{c}") for c in "xyz"], *[key(c).alias(f"k{c}") for c in "xyz"])
    for c in "xyz":
        q = q.withColumn(f"_d{c}", F.explode(around)).withColumn(f"k{c}", F.col(f"k{c}") + F.col(f"_d{c}")).drop(f"_d{c}")
    p = points.select(F.col(point_id).alias("point"), *[F.col(c).alias(f"p{c}") for c in "xyz"], *[key(c).alias(f"j{c}") for c in "xyz"])
    joined = q.join(p, (q["kx"] == p["jx"]) & (q["ky"] == p["jy"]) & (q["kz"] == p["jz"]))
    d = F.sqrt(sum(((F.col(f"q{c}") - F.col(f"p{c}")) ** 2 for c in "yz"), (F.col("qx") - F.col("px")) ** 2))
    return joined.select("query", "point", d.alias("distance"))


#: Points that a cell of the first round may hold; the cells start so small that none holds more.
MOST_IN_CELL = 256


def _finite(df: DataFrame) -> DataFrame:
    keep = F.lit(True)
    for c in "xyz":
        keep = keep & (F.abs(F.col(c)) < float("inf"))  # null and NaN fail as well
    return df.where(keep)


def _fine_cell(places: DataFrame, cell: float) -> float:
    """The given width, halved until no cell holds more than MOST_IN_CELL places, which are all different."""
    while True:
        fullest = places.groupBy(*[F.floor(F.col(c) / cell) for c in "xyz"]).count().agg(F.max("count")).first()[0] or 0
        if fullest <= MOST_IN_CELL or cell < 1e-9:
            return cell
        cell /= 2


def nearest_points(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, cell: float) -> DataFrame:
    """query, point, distance, rank of the k nearest points of each query, itself included if it is one; ties go to the smaller id.

    Points are looked for in a grid whose cells double until each query has k
    of them within one cell's width, which proves them nearest. Queries still
    open go on to the next round, so one sparse corner doesn't widen the
    search everywhere; the rounds end when none is open, which the cell as wide
    as the cloud makes sure of. The first width is halved until cells are
    small, so a dense corner isn't searched pair by pair. Equal places are
    searched once, and of the points at one place only the k smallest ids can
    be among the nearest. Queries for which the whole cloud holds fewer than k
    points get what there is; queries and points whose place isn't finite have
    and give no result.
    """
    spark = points.sparkSession
    asked = _finite(queries.select(F.col(query_id).alias("query"), *[(F.col(c) + 0.0).alias(c) for c in "xyz"]))
    given = _finite(points.select(F.col(point_id).alias("point"), *[(F.col(c) + 0.0).alias(c) for c in "xyz"]))
    at = Window.partitionBy(*"xyz").orderBy("point")
    # Per salted part of a place first, so that a place that holds a third of all points isn't sorted in one task.
    part = Window.partitionBy(*"xyz", F.pmod(F.xxhash64("point"), F.lit(64))).orderBy("point")
    given = given.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= k).withColumn("_k", F.row_number().over(at)).where(F.col("_k") <= k).drop("_k")
    given = cut(spark, given)
    want = min(k, given.limit(k).count())
    places = cut(spark, asked.select(*"xyz").distinct().withColumn("place", F.monotonically_increasing_id()))
    cell = _fine_cell(given.select(*"xyz").distinct(), cell)
    w = Window.partitionBy("query").orderBy("distance", "point")
    done, open_ = None, places
    while want and open_.limit(1).count():
        ranked = cut(spark, near_pairs(open_, given, cell, "place", "point").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= want))
        sure = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_far")).where((F.col("_n") >= want) & (F.col("_far") <= cell)).select("query")
        part = ranked.join(sure, "query", "left_semi")
        done = part if done is None else done.unionByName(part)
        # Another round only sees what is open: the lineage of the rounds before ends here.
        open_ = cut(spark, open_.join(sure, open_["place"] == sure["query"], "left_anti"))
        cell *= 2
    if done is None:
        return asked.limit(0).join(given.limit(0).select("point"), F.lit(True)).select("query", "point", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    found = places.join(done.withColumnRenamed("query", "place"), "place").drop("place")
    return asked.join(found, ["x", "y", "z"]).select("query", "point", "distance", "rank")


def mean_distances(points: DataFrame, k: int, point_id: str, cell: float) -> DataFrame:
    """point_id and mean distance to its k nearest points, itself included."""
    near = nearest_points(points, points, k, point_id, point_id, cell)
    return near.groupBy(F.col("query").alias(point_id)).agg(F.avg("distance").alias("mean_distance"))


def without_outliers(points: DataFrame, point_id: str, cell: float, k: int = 16, ratio: float = 2.0) -> DataFrame:
    """Points whose mean distance to their k nearest is above 0 and below mean + ratio * standard deviation of all."""
    d = mean_distances(points, k, point_id, cell)
    bound = d.agg((F.avg("mean_distance") + ratio * F.stddev_samp("mean_distance")).alias("_b"))
    kept = d.join(F.broadcast(bound), F.lit(True)).where((F.col("mean_distance") > 0) & (F.col("mean_distance") < F.col("_b"))).drop("_b")
    return points.join(kept, point_id)
