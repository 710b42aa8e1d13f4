"""Comparing models: per-frame metrics, normalised scores, eligibility and wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrawing.functions.camera import angle_between
from terrawing.operators.quantiles import exact_quantiles
from terrawing.operators.segments import segments
from terrawing.runtime import cut


def summaries(frames: DataFrame, metrics: list[str], model: str = "model") -> DataFrame:
    """Mean and population deviation of each metric per model; nulls don't count."""
    return frames.groupBy(model).agg(*[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def best_is_one(value: Column, lower_is_better: bool) -> Column:
    """value over all rows, scaled so that the best is 1; null for a null value, or if the best is 0."""
    w = Window.partitionBy()
    return F.try_divide(F.min(value).over(w), value) if lower_is_better else F.try_divide(value, F.max(value).over(w))


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that aren't null."""
    there = F.array_compact(F.array(*parts))
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def scorecard(models: DataFrame, quality: dict[str, bool], geometry: dict[str, bool], runtime: str = "runtime_s", duration_s: float = 600.0, most_s: float = 900.0) -> DataFrame:
    """One row per model (a handful): each metric normalised, their means, total = 0.4 quality + 0.4 geometry + 0.2 speed, eligible, rank.

    A total is null if any part is. Models without cameras, or slower than
    most_s for a video of 600 s, aren't eligible; only eligible ones have a rank.
    """
    norm = models.withColumns({f"{m}_norm": best_is_one(F.col(m), lower) for m, lower in (quality | geometry).items()} | {"speed": best_is_one(F.col(runtime), True)})
    norm = norm.withColumns({"quality": mean_of(*[F.col(f"{m}_norm") for m in quality]), "geometry": mean_of(*[F.col(f"{m}_norm") for m in geometry])})
    eligible = F.coalesce(F.col("has_cameras") & (F.col(runtime) * 600.0 / duration_s <= most_s), F.lit(False))
    norm = norm.withColumns({"total": 0.4 * F.col("quality") + 0.4 * F.col("geometry") + 0.2 * F.col("speed"), "eligible": eligible})
    rank = F.row_number().over(Window.partitionBy("eligible").orderBy(F.col("total").desc_nulls_last(), "model"))
    return norm.withColumn("rank", F.when(F.col("eligible") & F.col("total").isNotNull(), rank))


def wins(frames: DataFrame, metric: str, model: str = "model", frame: str = "frame_index") -> DataFrame:
    """Frames that each model wins by the largest metric; ties go to the first name, frames without any value to nobody."""
    best = frames.where(F.col(metric).isNotNull()).groupBy(frame).agg(F.min_by(model, F.struct((-F.col(metric)).alias("m"), F.col(model))).alias(model))
    return best.groupBy(model).agg(F.count(F.lit(1)).alias("n_wins"))


def paired_wins(a: DataFrame, b: DataFrame, names: tuple[str, str], metric: str = "psnr", position: str = "pos") -> DataFrame:
    """model and n_wins from two result lists met by position; positions that one of them lacks, or without value, win for nobody, ties for the first."""
    left, right = a.select(F.col(position).alias("_p"), F.col(metric).alias("_a")), b.select(F.col(position).alias("_q"), F.col(metric).alias("_b"))
    met = left.join(right, F.col("_p") == F.col("_q"), "full_outer").where("_a is not null and _b is not null")
    return met.select(F.when(F.col("_a") >= F.col("_b"), names[0]).otherwise(names[1]).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n_wins"))


def camera_errors(cameras: DataFrame, extent: float, model: str = "model") -> DataFrame:
    """model, n_cameras, median translation error in percent of the scene's extent and median rotation error in degrees, from (tx, ty, tz) against (ux, uy, uz) and the trace of the turn between."""
    off = F.sqrt((F.col("tx") - F.col("ux")) ** 2 + (F.col("ty") - F.col("uy")) ** 2 + (F.col("tz") - F.col("uz")) ** 2) / extent * 100
    rows = cut(cameras.sparkSession, cameras.select(model, off.alias("_off"), angle_between(F.col("trace")).alias("_turn")))
    q = lambda c, n: exact_quantiles(rows, c, {n: 0.5}, [model])
    return q("_off", "translation_pct").withColumnRenamed("n", "n_cameras").join(q("_turn", "rotation_deg").drop("n"), model)


def markdown(card: DataFrame, model: str = "model") -> str:
    """The scorecard (a handful of models) as a table, eligible models by rank, then the others by name, and the winner."""
    rows = card.select(model, "quality", "geometry", "speed", "total", "eligible", "rank").limit(1000).collect()
    rows.sort(key=lambda r: (r["rank"] is None, r["rank"] or 0, r[model]))
    figure = lambda x: "N/A" if x is None else f"{x:.3f}"
    lines = ["| model | geometry | quality | speed | total | eligible |", "|---|---|---|---|---|---|"]
    lines += [f"| {r[model]} | {figure(r['geometry'])} | {figure(r['quality'])} | {figure(r['speed'])} | {figure(r['total'])} | {'yes' if r['eligible'] else 'no'} |" for r in rows]
    winner = next((r[model] for r in rows if r["rank"] == 1), "none")
    return "\n".join([*lines, "", f"Winner: {winner}", ""])


def psnr(pixels: DataFrame, frame: str, a: str, b: str, mask: str) -> DataFrame:
    """frame and psnr over its masked pixels (values 0..1): 100 if they are equal, null if there are none."""
    mse = F.avg(F.when(F.col(mask), (F.col(a) - F.col(b)) ** 2))
    return pixels.groupBy(frame).agg(mse.alias("_e")).select(frame, F.when(F.col("_e") <= 1e-12, 100.0).otherwise(-10.0 * F.log10("_e")).alias("psnr"))


def ssim_of(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> float | None:
    """Structural similarity of two grey images (0..1), 11 x 11 Gaussian of sigma 1.5, averaged over the mask."""
    if not mask.any():
        return None
    k = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    k /= k.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            x = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 5, mode="reflect") if len(r) > 5 else np.pad(r, 5, mode="edge"), k, mode="valid"), axis, x)
        return x

    ma, mb = blur(a), blur(b)
    va, vb, vab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    s = ((2 * ma * mb + 0.01**2) * (2 * vab + 0.03**2)) / ((ma * ma + mb * mb + 0.01**2) * (va + vb + 0.03**2))
    return float(s[mask].mean())


def ssim(pixels: DataFrame, frame: str = "frame_index") -> DataFrame:
    """frame and ssim from pixels (row, col, a, b, mask); an image's pixels come together in one stream."""
    slim = pixels.select(F.col(frame).cast("long").alias("frame"), "row", "col", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.coalesce("mask", F.lit(False)).alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in segments(batches, ["frame"]):
            row, col = seg.column("row").to_numpy(), seg.column("col").to_numpy()
            shape = int(row.max()) + 1, int(col.max()) + 1
            a, b, m = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
            a[row, col], b[row, col], m[row, col] = seg.column("a").to_numpy(), seg.column("b").to_numpy(), seg.column("mask").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"frame": pa.array([seg.column("frame")[0].as_py()], pa.int64()), "ssim": pa.array([ssim_of(a, b, m)], pa.float64())})

    return slim.repartition("frame").sortWithinPartitions("frame").mapInArrow(run, "frame long, ssim double").withColumnRenamed("frame", frame)
