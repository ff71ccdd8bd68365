"""The fragment store: packed planes partitioned by variable and level, and a manifest of what the reader must know."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.fields import offsets

def write_fragments(frags: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Planes in order within files by variable and level, so that a plan reads the head of few files."""
    out = frags.repartition("var", "level", "block").sortWithinPartitions("var", "level", "block", "plane")
    out.write.mode(mode).partitionBy("var", "level").option("parquet.block.size", 4 << 20).parquet(f"{path}/fragments")


def write_buckets(frags: DataFrame, buckets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The same, with planes merged into buckets (by, level, plane, bucket)."""
    joined = frags.join(buckets.select("block", "var", "level", "plane", "bucket"), ["block", "var", "level", "plane"])
    joined.repartition("var", "level", "bucket").sortWithinPartitions("block", "plane").write.mode(mode).partitionBy("var", "level", "bucket").parquet(f"{path}/fragments")


def read_buckets(spark: SparkSession, path: str, plan: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """The buckets, whole, that hold what a plan takes and an earlier one didn't read: fragments with their bucket.

    The last bucket that any block needs of a variable's level is known to the driver and keeps later ones unread.
    """
    frags, by = spark.read.parquet(f"{path}/fragments"), ["block", "var", "level"]

    def last(p: DataFrame, name: str) -> DataFrame:
        return frags.select(*by, "plane", "bucket").join(p.select(*by, "planes"), by).where("plane < planes").groupBy(*by).agg(F.max("bucket").alias(name))

    need = last(plan, "_last")
    tops = need.groupBy("var", "level").agg(F.max("_last").alias("last")).collect()  # a row for each variable and level
    keep = F.lit(False)
    for r in tops:
        keep |= (F.col("var") == r["var"]) & (F.col("level") == r["level"]) & (F.col("bucket") <= r["last"])
    out = frags.where(keep).join(need, by).where("bucket <= _last").drop("_last")
    if prev is not None:
        out = out.join(last(prev, "_held"), by, "left").where("bucket > coalesce(_held, -1)").drop("_held")
    return out


def write_manifest(manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    manifest.write.mode(mode).parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_fragments(spark: SparkSession, path: str, plan: DataFrame | None = None, prev: DataFrame | None = None) -> DataFrame:
    """The fragments of a plan (block, var, level, planes) that an earlier one lacks.

    The most planes that any block takes of a variable's level is known to the driver, a row for each of the two, and
    becomes a filter that keeps whole partitions and row groups unread; blocks' own counts are joined.
    """
    frags = spark.read.parquet(f"{path}/fragments")
    if plan is None:
        return frags
    tops = plan.groupBy("var", "level").agg(F.max("planes").alias("planes")).where("planes > 0").collect()
    keep = F.lit(False)
    for r in tops:
        keep |= (F.col("var") == r["var"]) & (F.col("level") == r["level"]) & (F.col("plane") < r["planes"])
    out = frags.where(keep).join(plan.select("block", "var", "level", F.col("planes").alias("_stop")), ["block", "var", "level"]).where("plane < _stop")
    if prev is not None:
        out = out.join(prev.select("block", "var", "level", F.col("planes").alias("_from")), ["block", "var", "level"], "left").where("plane >= coalesce(_from, 0)").drop("_from")
    return out.drop("_stop")


def missing(wanted: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The keys for which no result is stored yet."""
    try:
        done = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return wanted
        raise
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def write_at_offsets(field: DataFrame, path: str, dtype: str = "float32") -> DataFrame:
    """(block, offset, body): each block's values as raw bytes, at the byte where the blocks before it end."""
    size = np.dtype(dtype).itemsize

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v = table.sort_by("idx").column("value").to_numpy().astype(np.dtype(dtype).newbyteorder("<"))
        return pa.table({"block": [key[0].as_py()], "body": pa.array([v.tobytes()], pa.binary())})

    starts = offsets(field.groupBy("block").agg((F.count("*") * size).alias("size")), "block", "size").select("block", "offset")
    bodies = field.select("block", "idx", "value").groupBy("block").applyInArrow(pack, "block long, body binary")
    bodies.join(starts, "block").select("block", "offset", "body").write.mode("overwrite").parquet(path)
    return field.sparkSession.read.parquet(path)


def read_raw(spark: SparkSession, path: str, dtype: str = "float32") -> DataFrame:
    """(path, idx, value) of raw files of one element type, through Spark's own reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("path"), batch.column("content"), strict=True):
                v = np.frombuffer(body.as_buffer(), np.dtype(dtype).newbyteorder("<"))
                for a in range(0, len(v), 1 << 20):
                    part = v[a : a + (1 << 20)].astype(np.float64)
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name.as_py()] * len(part)), "idx": np.arange(a, a + len(part)), "value": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, idx long, value double")


def write_raw(field: DataFrame, path: str, dtype: str = "float32", run: int = 1 << 18) -> None:
    """(run, first, body): a field as runs of raw bytes, which follow one another by `first`, a byte offset."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        v = table.column("value").to_numpy().astype(np.dtype(dtype).newbyteorder("<"))
        return pa.table({"run": [key[0].as_py()], "first": [int(table.column("idx")[0].as_py()) * v.itemsize], "body": pa.array([v.tobytes()], pa.binary())})

    field.withColumn("run", F.floor(F.col("idx") / run).cast("long")).select("run", "idx", "value").groupBy("run").applyInArrow(pack, "run long, first long, body binary").write.mode("overwrite").parquet(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each line that has one."""
    word = F.split(F.trim("value"), r"\s+")[0]
    return spark.read.text(path).select(word.alias("sim")).where("sim <> ''")
