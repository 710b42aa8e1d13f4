"""Problem 8: records of several sources mixed to target weights.

Poisson replication: each document has a fixed uniform number from a seeded
hash of its id, and its number of copies is the Poisson quantile of that
number at its source's mean rate, cut at the source's cap. The rates are such
that the cut distribution, applied to the very documents, meets the target
tokens: a histogram of the tokens over the uniform numbers, of bounded size,
tells what any rate would draw.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrawing.runtime import small

#: Steps of the uniform numbers. A rate can't be told finer than one step's tokens, a 1/STEPS of a source.
STEPS = 8192
#: Sources whose sums, STEPS of each, are at the driver at once; more sources go batch by batch.
BATCH = 200
#: More rates than this are joined with a shuffle.
MOST_RATES = 20_000


@dataclass(frozen=True)
class Rate:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    mean: float
    thresholds: tuple[float, ...]
    drawn: int


def step_of(item_id: str, seed: int) -> Column:
    """The document's step of the uniform numbers, 0 to STEPS - 1."""
    return F.pmod(F.xxhash64(F.col(item_id).cast("long"), F.lit(seed)), F.lit(STEPS)).cast("int")


def thresholds(mean: float, most: int) -> tuple[float, ...]:
    """Uniform numbers above which a document gets at least 1, 2, ... most copies: the Poisson distribution function at 0, 1, ...

    They end early where the next copy has no probability left.
    """
    if mean <= 0 or most < 1:
        return ()
    if math.isinf(mean):
        return (0.0,) * most
    out, log_p, total = [], -mean, 0.0
    for k in range(most):
        total += math.exp(log_p)
        if total >= 1 - 0.25 / STEPS and k > mean:
            break
        out.append(min(total, 1.0))
        log_p += math.log(mean) - math.log(k + 1)
    return tuple(out)


def drawn(by_step: np.ndarray, cuts: tuple[float, ...]) -> int:
    """Tokens that the thresholds draw, from the tokens of each step."""
    tail = np.concatenate([np.cumsum(by_step[::-1])[::-1], [0]])
    # Step s stands for the number (s + 0.5) / STEPS.
    first = np.floor(np.array(cuts) * STEPS - 0.5).astype(np.int64) + 1
    return int(tail[np.clip(first, 0, STEPS)].sum()) if len(cuts) else 0


def solve(by_step: np.ndarray, target: float, most: int) -> tuple[float, tuple[float, ...]]:
    """The mean whose thresholds draw closest to target."""
    tokens = int(by_step.sum())
    if tokens == 0 or target <= 0:
        return 0.0, ()
    if target >= tokens * most:
        return math.inf, thresholds(math.inf, most)
    lo, hi = 0.0, 1.0
    while drawn(by_step, thresholds(hi, most)) < target and hi < 1e6:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(by_step, thresholds(mid, most)) < target else (lo, mid)
    mean = min((lo, hi), key=lambda m: abs(drawn(by_step, thresholds(m, most)) - target))
    return mean, thresholds(mean, most)


def rates(docs: DataFrame, item_id: str, source: str, size: str, targets: DataFrame, seed: int, total: int | None = None) -> list[Rate]:
    """A rate for each target source. targets: source_name, target_share, max_repeats.

    The mix is as large as the caps allow with all shares met, or ``total``
    tokens if that is smaller. Target sources without tokens can't be drawn;
    their share goes to the others in proportion.
    """
    wanted = [tuple(r) for r in targets.select("source_name", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).toLocalIterator() if r[0] is not None]
    names = [r[0] for r in wanted]
    tokens: dict[str, int] = {}
    for some in _batches(names):
        sums = docs.where(F.col(source).isin(some)).groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n"))
        tokens |= {r["s"]: r["n"] or 0 for r in sums.collect()}
    there = {(n, s, m) for n, s, m in wanted if tokens.get(n, 0) > 0 and (s or 0) > 0 and (m or 0) > 0}
    share = sum(s for n, s, m in wanted if (n, s, m) in there)
    size_of_mix = min((tokens[n] * m / (s / share) for n, s, m in there), default=0.0)
    if total is not None:
        size_of_mix = min(size_of_mix, float(total))
    out = []
    for some in _batches(names):
        mass = {n: np.zeros(STEPS, np.int64) for n in some}
        steps = docs.where(F.col(source).isin(some)).groupBy(F.col(source).alias("s"), step_of(item_id, seed).alias("b")).agg(F.sum(size).alias("n"))
        for r in steps.collect():
            mass[r["s"]][r["b"]] = r["n"] or 0
        for n, s, m in (w for w in wanted if w[0] in mass):
            mean, cuts = solve(mass[n], size_of_mix * s / share, m) if (n, s, m) in there else (0.0, ())
            out.append(Rate(n, s, m, int(mass[n].sum()), mean, cuts, drawn(mass[n], cuts)))
    return out


def _batches(names: list[str]) -> list[list[str]]:
    return [names[i : i + BATCH] for i in range(0, len(names), BATCH)]


def draw(docs: DataFrame, item_id: str, source: str, size: str, plan: list[Rate], seed: int) -> DataFrame:
    """item_id, source, copy (from 0), n_tokens, place: the drawn copies in their global, shuffled order.

    Documents without a source, or of one without target, aren't drawn. No
    document comes more than its source's max_repeats times. ``place`` is a
    hash of id and copy; the result is sorted by it, so that neighbours don't
    share a source. An empty table, or no targets, gives an empty result.
    """
    spark = docs.sparkSession
    drawing = [(r.source, list(r.thresholds)) for r in plan if r.thresholds]
    rate = small(spark.createDataFrame(drawing, "_source string, _cuts array<double>"), MOST_RATES, len(drawing))
    u = (step_of(item_id, seed) + 0.5) / F.lit(STEPS)
    slim = docs.select(F.col(item_id).alias("item_id"), F.col(source).alias("source"), F.col(size).alias("n_tokens"), u.alias("_u"))
    chosen = slim.join(rate, F.col("source") == F.col("_source")).withColumn("_n", F.size(F.filter("_cuts", lambda c: F.col("_u") > c))).where("_n > 0")
    each = chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return each.select("item_id", "source", "copy", "n_tokens", F.xxhash64("item_id", "copy", F.lit(seed + 1)).alias("place")).orderBy("place", "item_id", "copy")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source_name, target_share, reached_share, n_tokens, n_copies, most_copies per target, counted over the drawn copies."""
    per = mix.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_copies"), (F.max("copy") + 1).alias("most_copies"))
    whole = mix.agg(F.sum("n_tokens").alias("all_tokens"))
    per = per.join(F.broadcast(whole), F.lit(True))
    return targets.join(per, targets["source_name"] == per["source"], "left").select(
        "source_name", "target_share", F.round(F.coalesce(F.try_divide("n_tokens", "all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
