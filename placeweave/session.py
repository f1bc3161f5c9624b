"""Reading tables and cutting lineage, alike on a laptop and on a cluster."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the directory `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset, as in tests on one machine, a temporary folder is
    made and set as the checkpoint folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if path:
        if not current:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placeweave-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written as a table to the shared folder and read again.

    Columnar and compressed, it takes a fraction of a checkpoint's disk, and a later
    reader takes the columns it needs only. Any executor can read it, whichever wrote
    it. It is deleted when the session's JVM ends, or by `freed`.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(path.toString())
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(path.toString())
    out._placeweave_table = path
    return out


def freed(*tables: DataFrame) -> None:
    """Deletes what `cut` wrote for these very DataFrames, on which nothing still to be computed may rest."""
    for t in tables:
        if (path := getattr(t, "_placeweave_table", None)) is not None:
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Has the driver's JVM collect what no plan refers to any longer: Spark then removes the broadcasts of finished steps, on the driver and the executors."""
    spark.sparkContext._jvm.System.gc()


def _written(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes `data` to a file of the shared folder, to be deleted when the session's JVM ends; its qualified path."""
    sc = spark.sparkContext
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def share_bytes(spark: SparkSession, data: bytes, label: str) -> str:
    """Hands `data` to every executor through the shared folder; its name for SparkFiles.get.

    Executors fetch the file themselves when a task needs it, so that one started
    later, in place of a lost one, gets it as well.
    """
    name = f"{label}-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(_written(spark, data, name))
    return name


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable to the Python workers, wherever they were started; once per session."""
    if getattr(spark.sparkContext, "_placeweave_shipped", False):
        return
    root, buffer = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(_written(spark, buffer.getvalue(), f"placeweave-{uuid.uuid4().hex}.zip"))
    spark.sparkContext._placeweave_shipped = True


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """The rows over enough partitions to keep every core busy; a shuffle only where the scan gives fewer, as with few large row groups."""
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
