"""Sessions, tables and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("corpusloom")
    for k, v in {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver was started from; once for a context."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:
        name = f"{d}/corpusloom-{sc.applicationId}.zip"
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.suffix in (".py", ".npz"):
                    z.write(p, p.relative_to(root.parent))
        keep = Path(SparkFiles.getRootDirectory()) / Path(name).name
        shutil.copy(name, keep)
        sc.addPyFile(str(keep))
    sc._corpusloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder; spread for Python-heavy queries, whose few small files would leave cores idle."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spread:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:  # a bare scan: only its files are listed
            df = df.repartition(cores)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files of one query, beside the checkpoints, which all executors share."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex[:8]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder that the cluster names.

    Where none is set, a local session makes one of its own; on a cluster that is an error, as a machine-local folder
    would not outlive its executor.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _checkpoint_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints"))


_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """df persisted until release() is called; a query that holds several results of its own releases none while they are read."""
    from pyspark import StorageLevel

    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(df)
    return df


def release() -> None:
    """Give back what the queries so far hold; call it when their results have been read or written."""
    while _held:
        df = _held.pop()
        if df.sparkSession.sparkContext._jsc is not None:  # a stopped session holds nothing
            try:
                df.unpersist()
            except Exception as e:  # its JVM is gone
                if "stopped" not in str(e) and "Py4J" not in type(e).__name__:
                    raise
