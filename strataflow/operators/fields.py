"""Fields as tables of (block, idx, value): masks, dense indexes, differences, prefix sums, axis changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(vx: Column, vy: Column, vz: Column) -> Column:
    """A point counts where its velocity isn't zero."""
    return vx * vx + vy * vy + vz * vz != 0


def compact(df: DataFrame, keep: Column, block: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """The rows to keep, numbered from 0 within their block."""
    place = F.row_number().over(Window.partitionBy(*block).orderBy(*order)) - 1
    return df.where(keep).withColumn(name, place.cast("bigint"))


def expand(points: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every point, with the values of those that have any and 0 for the rest."""
    out = points.join(values.select(*keys, *columns), keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def zip_fields(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two fields' values side by side."""
    return a.join(b, keys)


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a's values less b's, at each place of a; b counts as 0 where it has none."""
    return a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), keys, "left").select(*keys, (F.col("_a") - F.coalesce("_b", F.lit(0.0))).alias("value"))


def accumulate(deltas: list[DataFrame], keys: list[str]) -> DataFrame:
    """The sum of fields by place."""
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out.groupBy(*keys).agg(F.sum("value").alias("value"))


def to_long(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """(keys, var, value), a row for each variable."""
    return df.unpivot(keys, variables, "var", "value")


def frames(df: DataFrame, start: int, step: int, column: str = "frame") -> DataFrame:
    return df.where((F.col(column) >= start) & ((F.col(column) - start) % step == 0))


def axes_to_columns(df: DataFrame, keys: list[str], axis: str = "axis", value: str = "value") -> DataFrame:
    """From a row for each axis to columns x, y, z."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(axis) == a, F.col(value))).alias(a) for a in "xyz"))


def value_range(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Least and largest value, range, largest magnitude, and count."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("range"), F.max(F.abs(v)).alias("max_abs"), F.count(v).alias("n"))


def offsets(sizes: DataFrame, block: str, size: str) -> DataFrame:
    """Where each block begins if blocks follow one another.

    Sums of runs of blocks come first, so that no task orders more than a run, or the runs themselves.
    """
    run = F.floor(F.col(block) / 1024).alias("_run")
    runs = sizes.groupBy(run).agg(F.sum(size).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("_run", F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.sum(size).over(Window.partitionBy("_run").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    out = sizes.withColumn("_run", run).withColumn("_in", F.coalesce(inside, F.lit(0))).join(starts, "_run")
    return out.select(*sizes.columns, (F.col("_base") + F.col("_in")).alias("offset"))


def argmax(df: DataFrame, by: list[str], value: str, index: str, carry: list[str]) -> DataFrame:
    """The row of the largest value; of equals the one with the least index."""
    top = F.max(F.struct(F.col(value), (-F.col(index)).alias("_i"), *carry)).alias("_t")
    return df.groupBy(*by).agg(top).select(*by, F.col(f"_t.{value}").alias(value), (-F.col("_t._i")).alias(index), *(F.col(f"_t.{c}").alias(c) for c in carry))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard deviation (of the population), NaN left out."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
