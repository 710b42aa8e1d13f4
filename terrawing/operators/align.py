"""Chunks onto world places: robust fits, choices between them, and the graph of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrawing.functions import camera
from terrawing.operators.blocks import neighbours, numbered
from terrawing.operators.quantiles import exact_quantiles
from terrawing.operators.segments import segments
from terrawing.runtime import cut, kept, small

#: Fits, one row per chunk, that are broadcast at most.
MOST_FITS = 200_000


def fit_4dof(pairs: DataFrame, chunk: str = "chunk_idx", delta: float = 2.0, rounds: int = 5) -> DataFrame:
    """chunk, scale, yaw, tx, ty, tz, rmse, n: robust scale, turn about z and shift from (sx, sy, sz) to (dx, dy, dz), weighted by w.

    Each round solves the weighted fit in closed form from the sums of each
    chunk and weighs the pairs by their residual anew (Huber). Only sums and
    the fit, one row per chunk, go between rounds. Chunks of fewer than two
    pairs have no fit.
    """
    data = pairs.select(chunk, "sx", "sy", "sz", "dx", "dy", "dz", F.col("w").alias("_w"))
    # The fit of a round is one small row per chunk: it is computed once and goes to the pairs, so that each round reads them once.
    fit, n = kept(_solve(data, chunk).where("n >= 2"), MOST_FITS)
    for _ in range(rounds - 1):
        moved = _residuals(data.join(small(fit, MOST_FITS, n).drop("n"), chunk))
        r = F.sqrt(F.col("_rx") ** 2 + F.col("_ry") ** 2 + F.col("_rz") ** 2)
        # The weights of the last round's residuals replace those before.
        fit, n = kept(_solve(moved.withColumn("_w", F.when(r <= delta, 1.0).otherwise(delta / r)).select(*data.columns), chunk), MOST_FITS)
    rest = _residuals(data.join(small(fit, MOST_FITS, n), chunk)).groupBy(chunk).agg(
        *[F.first(c).alias(c) for c in ("scale", "yaw", "tx", "ty", "tz", "n")], F.sqrt(F.avg(F.col("_rx") ** 2 + F.col("_ry") ** 2 + F.col("_rz") ** 2)).alias("rmse")
    )
    return rest


def _solve(rows: DataFrame, chunk: str) -> DataFrame:
    w = F.col("_w")
    s = lambda x, n: F.sum(w * x).alias(n)
    c = F.col
    sums = rows.groupBy(chunk).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("W"), *[s(c(a), a.upper()) for a in ("sx", "sy", "sz", "dx", "dy", "dz")],
        s(c("sx") * c("dx"), "XX"), s(c("sy") * c("dy"), "YY"), s(c("sx") * c("dy"), "XY"), s(c("sy") * c("dx"), "YX"), s(c("sx") ** 2 + c("sy") ** 2, "SS"),
    ).where("W > 0")
    m = {a: c(a.upper()) / c("W") for a in ("sx", "sy", "sz", "dx", "dy", "dz")}
    xx, yy = c("XX") / c("W") - m["sx"] * m["dx"], c("YY") / c("W") - m["sy"] * m["dy"]
    xy, yx = c("XY") / c("W") - m["sx"] * m["dy"], c("YX") / c("W") - m["sy"] * m["dx"]
    var = c("SS") / c("W") - m["sx"] ** 2 - m["sy"] ** 2
    yaw = F.atan2(xy - yx, xx + yy)
    scale = F.when(var <= 1e-12, 1.0).otherwise(F.greatest(F.sqrt((xx + yy) ** 2 + (xy - yx) ** 2) / var, F.lit(1e-6)))
    fit = sums.select(chunk, "n", scale.alias("scale"), yaw.alias("yaw"), *[v.alias(f"_m{a}") for a, v in m.items()])
    tx = c("_mdx") - c("scale") * (F.cos("yaw") * c("_msx") - F.sin("yaw") * c("_msy"))
    ty = c("_mdy") - c("scale") * (F.sin("yaw") * c("_msx") + F.cos("yaw") * c("_msy"))
    return fit.select(chunk, "n", "scale", "yaw", tx.alias("tx"), ty.alias("ty"), (c("_mdz") - c("scale") * c("_msz")).alias("tz"))


def _residuals(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumns({
        "_rx": c("dx") - c("scale") * (F.cos("yaw") * c("sx") - F.sin("yaw") * c("sy")) - c("tx"),
        "_ry": c("dy") - c("scale") * (F.sin("yaw") * c("sx") + F.cos("yaw") * c("sy")) - c("ty"),
        "_rz": c("dz") - c("scale") * c("sz") - c("tz"),
    })


def collinearity(places: DataFrame, track: str = "track_id") -> DataFrame:
    """track and collinearity: ratio of the smaller to the larger eigenvalue of the covariance of (e, n); 0 for fewer than three places or no spread."""
    s = places.where("e is not null and n is not null").groupBy(track).agg(F.count(F.lit(1)).alias("_k"), F.var_samp("e").alias("_a"), F.var_samp("n").alias("_b"), F.covar_samp("e", "n").alias("_c"))
    mid, off = (F.col("_a") + F.col("_b")) / 2, F.sqrt(((F.col("_a") - F.col("_b")) / 2) ** 2 + F.col("_c") ** 2)
    ratio = F.when((F.col("_k") < 3) | (mid + off <= 1e-9), 0.0).otherwise(F.greatest(mid - off, F.lit(0.0)) / (mid + off))
    return s.select(track, ratio.alias("collinearity"))


def sign_of_up(places: DataFrame, group: str, up: str, height: str, confidence: float) -> DataFrame:
    """group, correlation of up with height, flips (below 0) and the confidence, halved for a correlation weaker than 0.3; none without spread."""
    c = places.groupBy(group).agg(F.var_pop(up).alias("_a"), F.var_pop(height).alias("_b"), F.covar_pop(up, height).alias("_c"))
    r = F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_c") / F.sqrt(F.col("_a") * F.col("_b")))
    return c.select(group, r.alias("correlation"), F.coalesce(r < 0, F.lit(False)).alias("flips"), F.when(F.abs(r) < 0.3, confidence / 2).otherwise(confidence).alias("confidence"))


# ------------------------------------------------------- fits that need a decomposition


def similarity(src: np.ndarray, dst: np.ndarray, w: np.ndarray | None = None, scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift of the weighted least-squares fit; no reflection."""
    w = np.ones(len(src)) if w is None else w
    w = w / w.sum()
    ms, md = w @ src, w @ dst
    a, b = src - ms, dst - md
    u, d, vt = np.linalg.svd((b * w[:, None]).T @ a)
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    r = u @ sign @ vt
    var = float((w * (a**2).sum(1)).sum())
    s = float((d * np.diag(sign)).sum() / var) if scaled and var > 1e-12 else 1.0
    return s, r, md - s * r @ ms


def residual(src: np.ndarray, dst: np.ndarray, s: float, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.linalg.norm(dst - (s * src @ r.T + t), axis=1)


_SIDES = ("sx", "sy", "sz", "dx", "dy", "dz")
_FIT = "scale double, r array<double>, t array<double>, rmse double, n long"


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and one array of sums: n, the six coordinates, the nine products of the sides, and both squares. A chunk of any size is one row per partition."""
    c = F.col
    sums = [F.count(F.lit(1)).cast("double"), *[F.sum(a) for a in _SIDES], *[F.sum(c(d) * c(s)) for d in _SIDES[3:] for s in _SIDES[:3]], F.sum(c("sx") ** 2 + c("sy") ** 2 + c("sz") ** 2), F.sum(c("dx") ** 2 + c("dy") ** 2 + c("dz") ** 2)]
    return rows.groupBy(*by).agg(F.array(*sums).alias("moments"))


def fit_of_moments(m: np.ndarray, scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Scale, rotation, shift and rmse of the least-squares fit that has these moments."""
    n, ms, md = m[0], m[1:4] / m[0], m[4:7] / m[0]
    cov = m[7:16].reshape(3, 3) / n - np.outer(md, ms)
    vs, vd = m[16] / n - ms @ ms, m[17] / n - md @ md
    u, d, vt = np.linalg.svd(cov)
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    r = u @ np.diag(sign) @ vt
    s = float((d * sign).sum() / vs) if scaled and vs > 1e-12 else 1.0
    left = vd + s * s * vs - 2 * s * float((d * sign).sum())
    return s, r, md - s * r @ ms, float(np.sqrt(max(left, 0.0)))


def _fitted(moments: DataFrame, by: list[str], pick: object) -> DataFrame:
    """by, mode and the fit that pick(moments) chooses."""
    kinds = ", ".join(f"{c} long" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [pick(np.array(m)) for m in batch.column("moments").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in by} | {
                "mode": pa.array([g[0] for g in got], pa.string()), "scale": pa.array([g[1] for g in got], pa.float64()), "r": pa.array([g[2].ravel().tolist() for g in got], pa.list_(pa.float64())),
                "t": pa.array([g[3].tolist() for g in got], pa.list_(pa.float64())), "rmse": pa.array([g[4] for g in got], pa.float64()), "n": pa.array([int(m[0]) for m in batch.column("moments").to_pylist()], pa.int64()),
            })

    return moments.select(*[F.col(c).cast("long").alias(c) for c in by], "moments").mapInArrow(run, f"{kinds}, mode string, {_FIT}")


def _better(m: np.ndarray) -> tuple:
    """The similarity if its scale is plausible and it is clearly better than the rigid fit, else the latter."""
    full, rigid = fit_of_moments(m), fit_of_moments(m, scaled=False)
    return ("sim3", *full) if 0.3 <= full[0] <= 3.0 and full[3] < 0.8 * rigid[3] else ("rigid", *rigid)


def fit_chunks(pairs: DataFrame, chunk: str = "chunk_idx", robust: bool = False) -> DataFrame:
    """chunk, mode, scale, r (9), t (3), rmse, n per chunk of at least three pairs: the better of similarity and rigid fit.

    The engine sums a chunk's moments, workers solve 3 x 3 matrices. With
    robust the fit is that to the pairs on which most random draws agree (see
    consensus), and n counts those.
    """
    slim = pairs.select(F.col(chunk).cast("long").alias("chunk"), *[F.col(c).cast("double").alias(c) for c in _SIDES])
    if robust:
        slim = consensus(slim, list(_SIDES), draws=2000, size=8, least=10, solve=_draw_similarity, off=_off_similarity, bound=lambda x: 0.05 * float(np.linalg.norm(x[3:6])))
    moments = _moments(slim, ["chunk"]).where("moments[0] >= 3")
    return _fitted(moments, ["chunk"], (lambda m: ("ransac", *fit_of_moments(m))) if robust else _better).withColumnRenamed("chunk", chunk)


def _draw_similarity(m: np.ndarray) -> np.ndarray | None:
    s, r, t = similarity(m[:, :3], m[:, 3:])
    return np.concatenate([[s], r.ravel(), t])


def _off_similarity(f: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances, one row per fit and one column per pair."""
    moved = np.einsum("hij,nj->hni", f[:, 1:10].reshape(-1, 3, 3) * f[:, :1, None], m[:, :3]) + f[:, None, 10:13]
    return np.linalg.norm(moved - m[None, :, 3:], axis=2)


def _draw_plane(m: np.ndarray) -> np.ndarray | None:
    n = np.cross(m[1] - m[0], m[2] - m[0])
    length = np.linalg.norm(n)
    if length < 1e-9:
        return None
    n = n / length * (1 if n[2] >= 0 else -1)
    return np.concatenate([n, [n @ m[0]]])


def _off_plane(f: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.abs(f[:, :3] @ m.T - f[:, 3:])


def consensus(rows: DataFrame, columns: list[str], draws: int, size: int, least: int, solve: object, off: object, bound: object, best_only: bool = False, seed: int = 0, rows_per_block: int = 20_000) -> DataFrame:
    """Of each chunk the rows that are near the hypothesis with most rows near it; of equal ones the first drawn.

    A hypothesis is solve() of ``size`` rows drawn by the chunk's own seeded
    generator. Drawn rows meet the table by their number; then blocks of a
    chunk are held against its hypotheses, and only counts come together, so a
    chunk that holds a third of all rows is worked on in parallel. A row is
    near if off() is below bound(extent of the columns). Chunks of fewer than
    least rows, near ones included, have no result. With best_only the result
    is chunk, f (the hypothesis), n_near and n.
    """
    spark = rows.sparkSession
    placed = cut(spark, numbered(rows, ["chunk"], columns, "_i"))
    sizes = placed.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.max(c) - F.min(c) for c in columns]).alias("extent")).where(F.col("n") >= max(least, size))
    sizes, n_chunks = kept(sizes, MOST_FITS)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist()):
                rng = np.random.default_rng([seed, abs(chunk)])
                picks = np.concatenate([rng.choice(n, size, replace=False) for _ in range(draws)])
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(picks), pa.int64()), "h": pa.array(np.repeat(np.arange(draws), size), pa.int32()), "_i": pa.array(picks, pa.int64())})

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in segments(batches, ["chunk", "h"]):
            f = solve(np.column_stack([seg.column(c).to_numpy() for c in columns]))
            if f is not None:
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([seg.column("chunk")[0].as_py()], pa.int64()), "h": pa.array([seg.column("h")[0].as_py()], pa.int32()), "f": pa.array([f.tolist()], pa.list_(pa.float64()))})

    picks = sizes.select("chunk", "n").mapInArrow(draw, "chunk long, h int, _i long")
    drawn = picks.join(placed.select("chunk", F.col("_i").cast("long").alias("_i"), *columns), ["chunk", "_i"])
    fits = cut(spark, drawn.repartition("chunk", "h").sortWithinPartitions("chunk", "h", "_i").mapInArrow(solved, "chunk long, h int, f array<double>"))

    block = F.floor(F.col("_i") / rows_per_block).cast("int")
    parts = sizes.select("chunk", "extent", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / rows_per_block).cast("int"))).alias("b"))
    asked = fits.join(small(parts, MOST_FITS), "chunk")

    def near(key: tuple, mine: pa.Table, hyps: pa.Table) -> pa.Table:
        if not mine.num_rows or not hyps.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "h": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        m = np.column_stack([mine.column(c).to_numpy() for c in columns])
        f = np.array(hyps.column("f").to_pylist())
        most = bound(np.array(hyps.column("extent")[0].as_py()))
        n = np.concatenate([(off(f[i : i + 32], m) < most).sum(1) for i in range(0, len(f), 32)])
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(n), pa.int64()), "h": hyps.column("h"), "n": pa.array(n, pa.int64())})

    counted = placed.select("chunk", block.alias("b"), *columns).groupBy("chunk", "b").cogroup(asked.groupBy("chunk", "b")).applyInArrow(near, "chunk long, h int, n long")
    total = counted.groupBy("chunk", "h").agg(F.sum("n").alias("n_near"))
    best = total.groupBy("chunk").agg(F.max_by(F.struct("h", "n_near"), F.struct("n_near", (-F.col("h")).alias("k"))).alias("_b")).select("chunk", "_b.h", "_b.n_near").where(F.col("n_near") >= least)
    best, n = kept(best.join(fits, ["chunk", "h"]).join(small(sizes, MOST_FITS, n_chunks), "chunk").select("chunk", "f", "n_near", "n", "extent"), MOST_FITS)
    if best_only:
        return best.drop("extent")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.column_stack([batch.column(c).to_numpy() for c in columns])
            chunks = batch.column("chunk").to_numpy()
            mask = np.zeros(batch.num_rows, bool)
            for c in np.unique(chunks):
                at = np.flatnonzero(chunks == c)
                f, extent = (np.array(batch.column(x)[int(at[0])].as_py()) for x in ("f", "extent"))
                mask[at] = off(f[None], m[at])[0] < bound(extent)
            yield batch.select(["chunk", *columns]).filter(pa.array(mask))

    met = placed.select("chunk", *columns).join(small(best.select("chunk", "f", "extent"), MOST_FITS, n), "chunk")
    return met.mapInArrow(keep, "chunk long, " + ", ".join(f"{c} double" for c in columns))


def planes(points: DataFrame, chunk: str = "chunk_idx", draws: int = 300, bound: float = 0.05, least: int = 50, least_share: float = 0.08) -> DataFrame:
    """chunk, nx, ny, nz (upward unit normal) and share of the plane near which most points lie; none for fewer than 50 points or 8 % near it."""
    slim = points.select(F.col(chunk).cast("long").alias("chunk"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    sizes = slim.groupBy("chunk").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("chunk")
    got = consensus(slim.join(sizes, "chunk"), list("xyz"), draws, 3, 3, _draw_plane, _off_plane, lambda x: bound, best_only=True)
    share = F.col("n_near") / F.col("n")
    return got.where(share >= least_share).select(F.col("chunk").alias(chunk), *[F.col("f")[i].alias(f"n{c}") for i, c in enumerate("xyz")], share.alias("share"))


def gravity_fixed(pairs: DataFrame, gravity: DataFrame, chunk: str = "chunk_idx") -> DataFrame:
    """chunk, mode, scale, r (9), t (3), rmse, n: each chunk turned so that its up (ux, uy, uz in gravity) is +z, then fitted in scale, turn about z and shift.

    Up needn't have unit length. Chunks without gravity, or with an up of
    length 0, and chunks of fewer than two pairs have no fit.
    """
    length = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    up = gravity.where(length > 0).select(F.col(chunk).alias("_chunk"), *[(F.col(f"u{c}") / length).alias(f"u{c}") for c in "xyz"])
    turn = camera.aligning_to_up([F.col(f"u{c}") for c in "xyz"])
    turns, n = kept(up.select("_chunk", F.array(*[x for row in turn for x in row]).alias("_g")), MOST_FITS)
    turns = small(turns, MOST_FITS, n)
    met = pairs.join(turns, F.col(chunk) == F.col("_chunk"))
    upright = met.withColumns({f"s{c}": sum((F.col("_g")[3 * i + j] * F.col(f"s{b}") for j, b in enumerate("yz", 1)), F.col("_g")[3 * i] * F.col("sx")) for i, c in enumerate("xyz")})
    fit = fit_4dof(upright.select(chunk, *_SIDES, "w"), chunk).join(turns, F.col(chunk) == F.col("_chunk"))
    g = lambda i, j: F.col("_g")[3 * i + j]
    co, si = F.cos("yaw"), F.sin("yaw")
    rows = [[co * g(0, j) - si * g(1, j) for j in range(3)], [si * g(0, j) + co * g(1, j) for j in range(3)], [g(2, j) for j in range(3)]]
    return fit.select(chunk, F.lit("4dof_gps").alias("mode"), "scale", F.array(*[x for row in rows for x in row]).alias("r"), F.array("tx", "ty", "tz").alias("t"), "rmse", "n")


def identity_seed(chunks: DataFrame, chunk: str = "chunk_idx") -> DataFrame:
    """The first chunk as it is, in the form of the other alignments: what the others are aligned to where there are no places."""
    unit = [float(i == j) for i in range(3) for j in range(3)]
    return chunks.agg(F.min(chunk).alias(chunk)).where(f"{chunk} is not null").select(
        chunk, F.lit("identity").alias("mode"), F.lit(1.0).alias("scale"), F.array(*[F.lit(x) for x in unit]).alias("r"), F.array(*[F.lit(0.0)] * 3).alias("t"), F.lit(0.0).alias("rmse"), F.lit(0).cast("long").alias("n")
    )


def mean_rmse(fits: DataFrame) -> DataFrame:
    """One row: the mean of the chunks' rmse, and their number."""
    return fits.agg(F.avg("rmse").alias("mean_rmse"), F.count("rmse").alias("n_chunks"))


def grid_fit(model: DataFrame, reference: DataFrame, frame: str = "frame_index", grid: int = 32, least: int = 10) -> DataFrame:
    """frame, scale, residual_pct, n: the similarity from a model's pixel points to a reference's, met on a normalised grid.

    Both tables hold row, col, x, y, z and the image's height and width, of
    any two sizes. A grid place takes the pixel that its middle lies in;
    points of z = 0 don't count. residual_pct is the exact median of the
    distance over the reference's depth, in percent. Frames that share fewer
    than ``least`` points have no row.
    """
    def sampled(df: DataFrame, side: str) -> DataFrame:
        place = lambda i, n: F.sequence(F.greatest(F.ceil(i * grid / n - 0.5), F.lit(0)).cast("int"), F.least(F.ceil((i + 1) * grid / n - 0.5), F.lit(grid)).cast("int"))
        ok = lambda g, i, n: (F.col(g) < grid) & (F.floor((F.col(g) + 0.5) / grid * n) == i)
        rows = df.where("z != 0").withColumn("_gr", F.explode(place(F.col("row"), F.col("height")))).where(ok("_gr", F.col("row"), F.col("height")))
        rows = rows.withColumn("_gc", F.explode(place(F.col("col"), F.col("width")))).where(ok("_gc", F.col("col"), F.col("width")))
        return rows.select(F.col(frame).cast("long").alias("chunk"), "_gr", "_gc", *[F.col(c).cast("double").alias(f"{side}{c}") for c in "xyz"])

    both = cut(model.sparkSession, sampled(model, "s").join(sampled(reference, "d"), ["chunk", "_gr", "_gc"]))
    fits, n = kept(_fitted(_moments(both, ["chunk"]).where(F.col("moments")[0] >= least), ["chunk"], lambda m: ("sim3", *fit_of_moments(m))), MOST_FITS)
    met = both.join(small(fits, MOST_FITS, n), "chunk")
    off = [F.col(f"d{c}") - F.col("t")[i] - F.col("scale") * sum((F.col("r")[3 * i + j] * F.col(f"s{b}") for j, b in enumerate("yz", 1)), F.col("r")[3 * i] * F.col("sx")) for i, c in enumerate("xyz")]
    share = 100.0 * F.sqrt(off[0] ** 2 + off[1] ** 2 + off[2] ** 2) / F.when(F.abs("dz") > 1e-6, F.abs("dz"))
    medians = exact_quantiles(met.select("chunk", share.alias("_e")), "_e", {"residual_pct": 0.5}, ["chunk"])
    return fits.select("chunk", "scale", "n").join(medians.drop("n"), "chunk").withColumnRenamed("chunk", frame)


def correspondences(elements: DataFrame, images: DataFrame, keypoints: DataFrame, cameras: DataFrame, names: DataFrame) -> DataFrame:
    """point_id, x, y, z, frame_index, u_norm, v_norm: every sighting of a sparse point in a training image, its pixel as shares of the image's size.

    elements (point_id, x, y, z, image_id, keypoint), images (image_id, name,
    camera_id), keypoints (image_id, keypoint, u, v), cameras (camera_id,
    width, height), names (name, kind, frame_index).
    """
    training = names.where("kind = 'training'").select("name", "frame_index")
    known = images.join(training, "name").join(cameras.select("camera_id", "width", "height"), "camera_id").select("image_id", "frame_index", "width", "height")
    return elements.join(known, "image_id").join(keypoints, ["image_id", "keypoint"]).select("point_id", "x", "y", "z", "frame_index", (F.col("u") / F.col("width")).alias("u_norm"), (F.col("v") / F.col("height")).alias("v_norm"))


def at_model_points(found: DataFrame, grid: DataFrame, height: int, width: int) -> DataFrame:
    """Correspondences with the model's point (sx, sy, sz) at their pixel and the sparse point as (dx, dy, dz); model points that aren't finite, or are the origin, don't count."""
    at = lambda share, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), (share * n).cast("int")))
    rows = found.withColumns({"row": at(F.col("v_norm"), height), "col": at(F.col("u_norm"), width)})
    g = grid.select("frame_index", "row", "col", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    for c in "xyz":
        g = g.where(F.abs(F.col(f"s{c}")) < float("inf"))
    g = g.where("sx != 0 or sy != 0 or sz != 0")
    return rows.join(g, ["frame_index", "row", "col"]).select("point_id", "frame_index", "sx", "sy", "sz", *[F.col(c).alias(f"d{c}") for c in "xyz"])


def refine_graph(fits: np.ndarray, overlaps: list[tuple[int, int, np.ndarray, np.ndarray]], places: list[tuple[int, np.ndarray, np.ndarray, float]], rounds: int = 30, delta: float = 1.0) -> np.ndarray:
    """Log scale, yaw and shift of every chunk (rows of ``fits``) that bring shared cameras together and cameras to their places.

    Huber-weighted Gauss-Newton with damping; the graph has one node per
    chunk, so it is solved where its few rows are. A place's residual is
    scaled by the root of its weight.
    """
    x = fits.astype(float).copy()

    def residuals(p: np.ndarray) -> np.ndarray:
        move = lambda f, q: np.exp(f[0]) * np.column_stack([np.cos(f[1]) * q[:, 0] - np.sin(f[1]) * q[:, 1], np.sin(f[1]) * q[:, 0] + np.cos(f[1]) * q[:, 1], q[:, 2]]) + f[2:5]
        out = [(move(p[i], a) - move(p[j], b)).ravel() for i, j, a, b in overlaps]
        out += [np.sqrt(w) * (move(p[i], q[None])[0] - d) for i, q, d, w in places]
        return np.concatenate(out) if out else np.zeros(0)

    def cost(r: np.ndarray) -> float:
        a = np.abs(r)
        return float(np.where(a <= delta, 0.5 * r * r, delta * (a - 0.5 * delta)).sum())

    damp, r = 1e-3, residuals(x)
    for _ in range(rounds):
        jac = np.empty((len(r), x.size))
        for k in range(x.size):
            step = np.zeros(x.size)
            step[k] = 1e-6
            jac[:, k] = (residuals(x + step.reshape(x.shape)) - r) / 1e-6
        w = np.minimum(1.0, delta / np.maximum(np.abs(r), 1e-12))
        h, g = (jac * w[:, None]).T @ jac, (jac * w[:, None]).T @ r
        moved = x - np.linalg.solve(h + damp * np.eye(len(h)), g).reshape(x.shape)
        new = residuals(moved)
        if cost(new) < cost(r):
            done = abs(cost(r) - cost(new)) < 1e-12 * max(1.0, cost(r))
            x, r, damp = moved, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return x


#: The graph's equations, five unknowns a chunk, are solved as one dense matrix at the driver.
MOST_CHUNKS = 500


def _factor_sums(batches: Iterator[pa.RecordBatch], x: np.ndarray, delta: float) -> Iterator[pa.RecordBatch]:
    """i, j, k, v: the Huber-weighted normal matrix (10 x 10), gradient (10) and cost of the factors of each pair of chunks, flat, k the position."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        i, j, w = get("i"), get("j"), np.sqrt(get("w"))
        p, q = (np.column_stack([get(f"{s}{c}") for c in "xyz"]) for s in "pq")
        for a, b in set(zip(i.tolist(), j.tolist())):
            m = (i == a) & (j == b)
            r, jac = _moved(x[a], p[m])
            if b < 0:  # a place
                r, jac = (r - q[m]) * w[m, None], np.concatenate([jac * w[m, None, None], np.zeros_like(jac)], axis=2)
            else:
                r2, jac2 = _moved(x[b], q[m])
                r, jac = r - r2, np.concatenate([jac, -jac2], axis=2)
            r, jac = r.ravel(), jac.reshape(-1, 10)
            size = np.abs(r)
            weighted = jac * np.minimum(1.0, delta / np.maximum(size, 1e-12))[:, None]
            cost = np.where(size <= delta, 0.5 * r * r, delta * (size - 0.5 * delta)).sum()
            sums[a, b] = sums.get((a, b), 0.0) + np.concatenate([(weighted.T @ jac).ravel(), weighted.T @ r, [cost]])
    for (a, b), v in sums.items():
        n = len(v)
        yield pa.RecordBatch.from_pydict({"i": pa.array([a] * n, pa.int32()), "j": pa.array([b] * n, pa.int32()), "k": pa.array(range(n), pa.int32()), "v": pa.array(v)})


def _moved(f: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved by a chunk's fit, and their derivatives (n x 3 x 5) by it."""
    s, c, n = np.exp(f[0]), np.cos(f[1]), np.sin(f[1])
    turned = s * np.column_stack([c * q[:, 0] - n * q[:, 1], n * q[:, 0] + c * q[:, 1], q[:, 2]])
    jac = np.zeros((len(q), 3, 5))
    jac[:, :, 0] = turned
    jac[:, 0, 1], jac[:, 1, 1] = -turned[:, 1], turned[:, 0]
    jac[:, [0, 1, 2], [2, 3, 4]] = 1.0
    return turned + f[2:5], jac


def refine_factors(fits: np.ndarray, factors: DataFrame, rounds: int = 30, delta: float = 1.0) -> np.ndarray:
    """As refine_graph, over a table of factors: i, j, w and points (px, py, pz), (qx, qy, qz).

    With j of -1 a factor is a camera p of chunk i and its place q, of weight
    w; else p of chunk i and q of chunk j are the same camera. Workers reduce
    the factors to sums for each pair of chunks that has some, anew in each
    round; only these come to the driver.
    """
    if len(fits) > MOST_CHUNKS:
        raise ValueError(f"more than {MOST_CHUNKS} chunks")
    x = fits.astype(float).copy()

    def equations(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        sums = factors.mapInArrow(lambda batches: _factor_sums(batches, at, delta), "i int, j int, k int, v double").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
        by: dict[tuple[int, int], np.ndarray] = {}
        for r in sums.collect():
            by.setdefault((r["i"], r["j"]), np.zeros(111))[r["k"]] = r["v"]
        h, g, cost = np.zeros((x.size, x.size)), np.zeros(x.size), 0.0
        for (i, j), v in sorted(by.items()):
            n = 5 if j < 0 else 10
            at_ = np.r_[5 * i : 5 * i + 5, 5 * j : 5 * j + 5][:n]
            h[np.ix_(at_, at_)] += v[:100].reshape(10, 10)[:n, :n]
            g[at_] += v[100:110][:n]
            cost += v[110]
        return h, g, cost

    damp, (h, g, cost) = 1e-3, equations(x)
    for _ in range(rounds):
        moved = x - np.linalg.solve(h + damp * np.eye(len(h)), g).reshape(x.shape)
        new = equations(moved)
        if new[2] < cost:
            done = abs(cost - new[2]) < 1e-12 * max(1.0, cost)
            x, (h, g, cost), damp = moved, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return x


def forward_direction(places: DataFrame, track: str = "track_id", order: str = "frame_index") -> DataFrame:
    """Adds fe and fn: the way to the next place, at the end from the last one, and east where neither is."""
    here = F.struct("e", "n")
    ahead = neighbours(places, [track], order, [], here).drop("_prev").withColumnRenamed("_next", "_ahead")
    back = neighbours(ahead.withColumn("_back", -F.col(order)), [track], "_back", [], here).drop("_prev", "_back")
    way = lambda c, east: F.coalesce(F.col(f"_ahead.{c}") - F.col(c), F.col(c) - F.col(f"_next.{c}"), F.lit(east))
    return back.withColumns({"fe": way("e", 1.0), "fn": way("n", 0.0)}).drop("_ahead", "_next")
