"""Session helpers: package shipping, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they run and whatever their path is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "2000")  # rows hold whole texts or blocks; the default of 10000 makes batches of tens of MB
    sc = spark.sparkContext
    if getattr(sc, "_strataflow_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="strataflow-"), "strataflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("strataflow", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)
    sc._strataflow_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local one stands in on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_strataflow_root", None) or tempfile.mkdtemp(prefix="strataflow-shared-")
        spark.sparkContext._strataflow_root = root
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's own part of the shared folder, which goes when Python ends."""
    sc = spark.sparkContext
    own = f"{shared_root(spark)}/strataflow/{sc.applicationId}"
    if getattr(sc, "_strataflow_own", None) != own:
        sc._strataflow_own = own
        atexit.register(_drop, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone; what is left is only room taken
        pass


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that this application wrote in the shared folder; DataFrames that read them end with that."""
    own = getattr(spark.sparkContext, "_strataflow_own", None)
    if own:
        _drop(spark, own)


def partitions_for(df: DataFrame, size: int) -> int:
    """spark.sql.shuffle.partitions, or more where df's files, by Catalyst's statistics, hold more than size bytes for each."""
    told = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-told // size)) if told < 1 << 50 else own  # without statistics Catalyst takes the largest long, or a share of it


def steady(df: DataFrame, name: str) -> DataFrame:
    """df, if its rows come in the same order each time; else written and read again. A shuffle's may come in any order."""
    return materialise(df, name) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_path(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written in the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again."""
    return written(df, name)[0]


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables of rounds that are over, and have Spark's cleaner free the shuffles that nothing refers to any more.

    The cleaner works when the driver's collector does; between short rounds that would be far too seldom.
    """
    for path in paths:
        _drop(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
