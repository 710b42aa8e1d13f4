"""Exact quantiles of large groups, without all of a group's values in one buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrawing.runtime import kept, small

#: Ranks are told to one part in so many by the first pass.
ACCURACY = 10_000
#: More groups than this aren't broadcast.
MOST_GROUPS = 50_000


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float], group: list[str] = []) -> DataFrame:
    """One row per group: group, n and, for each name of shares, the quantile with linear interpolation between neighbours.

    Groups of at most ACCURACY rows are sorted in one buffer of that size. Of
    larger ones a sketch of bounded size brackets each quantile; a second pass
    counts what lies below the bracket and keeps only the distinct values in
    it, with their counts, some eight parts in ACCURACY of the group. Null and
    NaN values don't count; a group of none has no row, no groups at all give
    one row only if there is a value. A null group is a group.
    """
    names = [f"_g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(group, names)], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    large, n_large = kept(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ACCURACY).select(*[F.col(c).alias(f"_l{c}") for c in names], F.lit(True).alias("_large")), MOST_GROUPS)
    large = small(large, MOST_GROUPS, n_large)
    in_large = [F.col(c).eqNullSafe(F.col(f"_l{c}")) for c in names] or [F.lit(True)]
    few = rows if not n_large else rows.join(large, in_large, "left_anti")
    direct = few.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *[F.percentile("_v", F.lit(float(x))).alias(k) for k, x in shares.items()]).where("n > 0")
    direct = direct.select(*[F.col(c).alias(g) for c, g in zip(names, group)], "n", *shares)
    if not n_large:
        return direct
    rows = rows.join(large, in_large, "left_semi")
    near = 4 / ACCURACY
    ends = [x for s in shares.values() for x in (max(s - near, 0.0), min(s + near, 1.0))]
    sketch = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, ACCURACY).alias("_q")).where("_n > 0")
    low = lambda i, s: F.when(F.lit(s - near <= 0), F.col("_min")).otherwise(F.col("_q")[2 * i])
    high = lambda i, s: F.when(F.lit(s + near >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1])
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), low(i, s).alias("lo"), high(i, s).alias("hi"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("p")) for i, s in enumerate(shares.values())])
    marks, n = kept(sketch.select(*[F.col(c).alias(f"_h{c}") for c in names], "_n", brackets.alias("_b")), MOST_GROUPS)
    same = [F.col(c).eqNullSafe(F.col(f"_h{c}")) for c in names] or [F.lit(True)]
    marks = small(marks, MOST_GROUPS, n)
    # Of a value, which brackets it is below, and which it is in.
    each = rows.join(marks, same).select(*names, "_n", "_v", F.explode("_b").alias("b")).where(F.col("_v") <= F.col("b.hi"))
    below = F.col("_v") < F.col("b.lo")
    counted = each.groupBy(*names, "_n", F.col("b.i").alias("i"), F.col("b.p").alias("p"), F.when(~below, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*names, "i").orderBy(F.asc_nulls_first("_v"))
    ranked = counted.withColumns({"_to": F.sum("k").over(w)})
    at = lambda r: F.min(F.when(F.col("_to") > r, F.col("_v")))
    found = ranked.groupBy(*names, "_n", "i", "p").agg(at(F.floor("p")).alias("a"), at(F.ceil("p")).alias("b"))
    value_of = F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.floor("p"))
    out = found.groupBy(*names, "_n").agg(*[F.max(F.when(F.col("i") == i, value_of)).alias(name) for i, name in enumerate(shares)])
    return direct.unionByName(out.select(*[F.col(c).alias(g) for c, g in zip(names, group)], F.col("_n").alias("n"), *shares))
