"""Scratch storage that survives lost executors: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-"))
    return sc.getCheckpointDir()


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(df: DataFrame, even: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read back: computed once, compressed, its lineage cut.

    The table goes when the application ends, or earlier by ``drop``. ``even`` says that no partition of df is
    hot: then neighbouring ones are written together, four files a core of the cluster at most, so small tables
    don't become thousands of files.
    """
    spark = df.sparkSession
    df = df.coalesce(4 * spark.sparkContext.defaultParallelism) if even else df
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _folder(spark, path)
    fs.deleteOnExit(p)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def drop(*tables: DataFrame) -> None:
    """Removes tables of ``scratch`` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            fs, p = _folder(t.sparkSession, path)
            fs.delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Gives the workers this package, once for each SparkContext; where they have it already, nothing changes."""
    sc = spark.sparkContext
    if any(f.endswith("/lodestar-package.zip") for f in sc.listFiles):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lodestar-")) / "lodestar-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
