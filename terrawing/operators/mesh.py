"""The relational parts of meshing: what is trimmed, which mesh is taken, and how it is coloured."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrawing.operators.fusion import nearest_points
from terrawing.operators.quantiles import exact_quantiles
from terrawing.runtime import cut

#: Meshing methods in the order in which they are preferred.
METHODS = ("tsdf", "poisson", "ball_pivot", "delaunay")


def without_long_edges(faces: DataFrame, share: float = 0.95, times: float = 2.0) -> DataFrame:
    """Faces whose longest edge is at most ``times`` the quantile of all longest edges (1e-6 at least)."""
    q = exact_quantiles(faces, "max_edge", {"_p": share}).select(F.greatest(times * F.col("_p"), F.lit(1e-6)).alias("_q"))
    return faces.join(F.broadcast(q), F.lit(True)).where(F.col("max_edge") <= F.col("_q")).drop("_q")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of an undirected graph (a, b).

    Each round, a node takes the smallest label around it, and then that
    label's own label, which halves the way left; rounds are written to the
    shared folder. It ends when no label moves.
    """
    spark = edges.sparkSession
    both = cut(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    labels = cut(spark, labels)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        mine = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "m").alias("low"))
        jump = labels.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = cut(spark, mine.join(jump, mine["low"] == jump["n2"], "left").select("node", F.least("low", F.coalesce("c2", "low")).alias("component"), (F.col("component") != F.least("low", F.coalesce("c2", "low"))).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels


def large_components(edges: DataFrame, least: int = 50, share: float = 0.005) -> DataFrame:
    """Nodes of the components with at least max(least, share of all) nodes, with their component."""
    labels = components(edges)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    all_ = labels.agg(F.greatest(F.lit(float(least)), share * F.count(F.lit(1))).alias("_b"))
    return labels.join(sizes.join(F.broadcast(all_), F.lit(True)).where(F.col("n_nodes") >= F.col("_b")).drop("_b"), "component")


def footprint(mesh: DataFrame, cloud: DataFrame) -> DataFrame:
    """One row: area of the mesh's box over that of the cloud's; 1 if the cloud's box has none."""
    area = lambda df, n: df.agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias(n))
    both = area(mesh, "_m").join(area(cloud, "_c"), F.lit(True))
    return both.select(F.when(F.coalesce(F.col("_c"), F.lit(0.0)) <= 0, 1.0).otherwise(F.col("_m") / F.col("_c")).alias("footprint"))


def chosen(meshes: DataFrame, run: str = "run_id", least_faces: int = 10_000, least_footprint: float = 0.5) -> DataFrame:
    """Each run's mesh by METHODS: one of TSDF needs enough faces and footprint, the others any face."""
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    fine = F.when(F.col("method") == "tsdf", (F.col("n_faces") >= least_faces) & (F.col("footprint") >= least_footprint)).otherwise(F.col("n_faces") > 0)
    w = Window.partitionBy(run).orderBy("_r", "method")
    return meshes.where(fine).withColumn("_r", rank).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_r", "_k")


def hybrid_neighbours(points: DataFrame, point_id: str, radius: float = 0.5, most: int = 30) -> DataFrame:
    """query and point: of each point the nearest ``most``, itself included, that are no further than radius."""
    return nearest_points(points, points, most, point_id, point_id, radius).where(F.col("distance") <= radius).select("query", "point")


def normals(points: DataFrame, near: DataFrame, point_id: str) -> DataFrame:
    """Points with nx, ny, nz: the direction in which a point's neighbours spread least.

    near has query and point (see hybrid_neighbours). The sums of each
    neighbourhood are made by the engine; workers only solve 3 x 3 matrices, a
    batch at a time. Fewer than three neighbours give no normal.
    """
    p = points.select(F.col(point_id).alias("point"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    c = near.select("query", "point").join(p, "point").groupBy("query").agg(F.count(F.lit(1)).alias("_n"), *[F.covar_pop(f"p{a}", f"p{b}").alias(f"c{a}{b}") for a, b in pairs]).where("_n >= 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.zeros((batch.num_rows, 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = batch.column(f"c{a}{b}").to_numpy(zero_copy_only=False)
            n = np.linalg.eigh(m)[1][:, :, 0]
            yield pa.RecordBatch.from_arrays([batch.column("query"), *[pa.array(n[:, k]) for k in range(3)]], ["query", "nx", "ny", "nz"])

    solved = c.select(F.col("query").cast("long").alias("query"), *[f"c{a}{b}" for a, b in pairs]).mapInArrow(run, "query long, nx double, ny double, nz double")
    return points.join(solved, points[point_id] == solved["query"]).drop("query")


def towards_camera(normals: DataFrame, cameras: DataFrame, point_id: str, cell: float = 16.0) -> DataFrame:
    """Normals (nx, ny, nz) turned to the side of the nearest camera, of equally near ones that of the smallest camera_id."""
    near = nearest_points(normals, cameras, 1, point_id, "camera_id", cell).select(F.col("query").alias("_q"), F.col("point").alias("_cam"))
    cam = cameras.select(F.col("camera_id").alias("_id"), *[F.col(c).alias(f"_c{c}") for c in "xyz"])
    joined = normals.join(near, F.col(point_id) == F.col("_q")).join(cam, F.col("_cam") == F.col("_id"))
    toward = sum((F.col(f"n{c}") * (F.col(f"_c{c}") - F.col(c)) for c in "yz"), F.col("nx") * (F.col("_cx") - F.col("x")))
    turned = joined.withColumn("_s", F.when(toward < 0, -1.0).otherwise(1.0)).withColumns({f"n{c}": F.col(f"n{c}") * F.col("_s") for c in "xyz"})
    return turned.drop("_q", "_cam", "_id", "_cx", "_cy", "_cz", "_s")
