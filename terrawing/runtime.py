"""What every query needs from the session: the package on the workers, the shared checkpoint folder, checked broadcasts."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Puts the package's sources on the workers' path once per application.

    Executors of a cluster needn't have the package installed: it lies as one
    archive in the shared checkpoint folder. In local mode the workers share
    the driver's path and nothing is sent.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped or _one_machine(sc):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, Path("terrawing") / f.relative_to(PACKAGE))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/terrawing-{sc.applicationId}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)


def _one_machine(sc: SparkContext) -> bool:
    return sc.master.startswith("local") and not sc.master.startswith("local-cluster")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where it names none, as in tests on one machine, one of the driver. On a cluster a missing name is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not _one_machine(sc):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrawing-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there."""
    checkpoint_folder(spark)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """df computed once, and its number of rows: in the driver if it has at most so many (most + 1 are asked for), else in the shared checkpoint folder."""
    spark = df.sparkSession
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        return spark.createDataFrame(rows, df.schema), rows.num_rows
    held = cut(spark, df)
    return held, held.count()


def small(df: DataFrame, most: int, n: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (n, counted if not given), else df for a shuffled join."""
    n = df.limit(most + 1).count() if n is None else n
    return F.broadcast(df) if n <= most else df
