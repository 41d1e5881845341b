"""Session helpers: the shared folder for intermediate tables and bounded settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that every executor can reach.

    ``spark.checkpoint.dir`` names it. Where it is unset and the master is local, a temporary
    folder is set once; on a cluster an unset folder is an error, since a machine-local path
    would lose data with its machine.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="moraine-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir("file://" + folder)
    return "file://" + folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in this application's part of it; its files stay until
    ``remove_scratch``, since results that are read later may need them."""
    return f"{shared_dir(spark)}/moraine/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results not yet read are lost with them:
    call it when an application is done with its results."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/moraine/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialise(df, name: str):
    """Write ``df`` below the shared folder and read it back: the lineage is cut at a table that
    outlives any executor, and several readers compute it once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a narrow plan dealt out to all cores if the input has fewer splits than there are
    cores, as one small file has; an input with enough splits is left alone, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import
    it wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="moraine-")) / "moraine.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
