"""Retrieval planning over the fragments' metadata.

A ladder has a row for each group (of `by`), level and plane: its size, and its gain, the estimated error that it takes
off. Ladders hold planes, not data: a few hundred rows for each block and variable, and groups are planned apart.

Taking the head of a heap of per-level queues is taking rows in the order of the running minimum of gain per byte in
their level, largest first, so the greedy plans are window queries. Ties go to the coarser level, then the earlier plane.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.errors import ladder as error_ladder


def ladder(bounds: DataFrame, sizes: DataFrame, by: list[str], estimate: Callable[[Column, Column], Column] = lambda e, level: e, gain: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """by, level, plane, size, gain, err0 (the estimate with nothing taken).

    bounds: by, level, bound. sizes: by, level, plane, size. estimate(error, level); gain(before, after, level), where
    it isn't the difference of estimates.
    """
    rows = sizes.join(bounds.select(*by, "level", "bound"), [*by, "level"])
    before, after, level = error_ladder(F.col("bound"), F.col("plane")), error_ladder(F.col("bound"), F.col("plane") + 1), F.col("level")
    step = gain(before, after, level) if gain else estimate(before, level) - estimate(after, level)
    total = bounds.groupBy(*by).agg(F.sum(estimate(F.col("bound"), level)).alias("err0"))
    return rows.withColumn("gain", step).join(total, by).select(*by, "level", "plane", "size", "gain", "err0")


def _fresh(rows: DataFrame, by: list[str], prev: DataFrame | None) -> DataFrame:
    """The rows that an earlier plan (by, level, planes) hasn't taken; err0 becomes the estimate after it."""
    if prev is None:
        return rows
    held = rows.join(prev.select(*by, "level", F.col("planes").alias("_had")), [*by, "level"], "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
    spent = held.groupBy(*by).agg(F.sum(F.when(F.col("plane") < F.col("_had"), F.col("gain")).otherwise(F.lit(0.0))).alias("_spent"))
    return held.where(F.col("plane") >= F.col("_had")).join(spent, by).withColumn("err0", F.col("err0") - F.col("_spent")).drop("_had", "_spent")


def _take(rows: DataFrame, by: list[str], order: list[Column], tau: float) -> DataFrame:
    """Rows in order until the estimate is under tau; none if it is from the start."""
    before = F.sum("gain").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_left", F.col("err0") - F.coalesce(before, F.lit(0.0))).where(F.col("_left") >= tau).drop("_left")


def _counts(rows: DataFrame, taken: DataFrame, by: list[str], prev: DataFrame | None) -> DataFrame:
    """by, level, planes (in all), bytes (new): a row for each level, taken from or not."""
    new = taken.groupBy(*by, "level").agg(F.count("*").alias("_n"), F.sum("size").alias("_b"))
    out = rows.select(*by, "level").distinct().join(new, [*by, "level"], "left")
    had = F.lit(0)
    if prev is not None:
        out = out.join(prev.select(*by, "level", F.col("planes").alias("_had")), [*by, "level"], "left")
        had = F.coalesce("_had", F.lit(0))
    return out.select(*by, "level", (F.coalesce("_n", F.lit(0)) + had).cast("int").alias("planes"), F.coalesce("_b", F.lit(0)).cast("bigint").alias("bytes"))


def in_order(rows: DataFrame, tau: float, by: list[str], prev: DataFrame | None = None) -> DataFrame:
    """Level after level."""
    taken = _take(_fresh(rows, by, prev), by, [F.col("level"), F.col("plane")], tau)
    return _counts(rows, taken, by, prev)


def round_robin(rows: DataFrame, tau: float, by: list[str], prev: DataFrame | None = None) -> DataFrame:
    """A plane of each level in turn, levels that are behind first."""
    taken = _take(_fresh(rows, by, prev), by, [F.col("plane"), F.col("level")], tau)
    return _counts(rows, taken, by, prev)


def _running(rows: DataFrame, by: list[str]) -> DataFrame:
    worst = F.min(F.col("gain") / F.col("size")).over(Window.partitionBy(*by, "level").orderBy("plane").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_pm", worst)


def greedy(rows: DataFrame, tau: float, by: list[str], prev: DataFrame | None = None) -> DataFrame:
    """The most gain per byte next."""
    order = [F.desc("_pm"), F.col("level"), F.col("plane")]
    taken = _take(_running(_fresh(rows, by, prev), by), by, order, tau)
    return _counts(rows, taken, by, prev)


def greedy_with_signs(rows: DataFrame, tau: float, by: list[str], prev: DataFrame | None = None) -> DataFrame:
    """Plane 0, which carries most signs, of the levels that tau needs, then the most gain per byte among these.

    The levels are the coarsest ones up to the first by which, read in full, the estimate is under tau.
    """
    per_level = rows.groupBy(*by, "level", "err0").agg(F.sum("gain").alias("_all"))
    short = F.col("err0") - F.coalesce(F.sum("_all").over(Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    needed = per_level.withColumn("_short", short).where(F.col("_short") >= tau).select(*by, "level")
    fresh = _fresh(rows.join(needed, [*by, "level"], "left_semi"), by, prev)
    open_ = fresh.where(F.col("err0") >= tau)
    queue = _running(open_.where("plane > 0"), by)
    both = queue.unionByName(open_.where("plane = 0").withColumn("_pm", F.lit(None).cast("double")))
    order = [F.when(F.col("plane") == 0, 0).otherwise(1), F.desc("_pm"), F.col("level"), F.col("plane")]
    signs = both.where("plane = 0")
    return _counts(rows, _take(both, by, order, tau).unionByName(signs).distinct(), by, prev)


def greedy_runs(rows: DataFrame, tau: float, by: list[str], prev: DataFrame | None = None) -> DataFrame:
    """Like greedy, but a step may take several planes of a level, as many as have the best mean gain per byte.

    The planes to weigh depend on those taken before, so each group, levels times planes rows, is planned in one go.
    """
    import pandas as pd

    schema = rows.select(*by, "level", "plane", "size", "gain", "err0").schema

    def run(df: pd.DataFrame) -> pd.DataFrame:
        levels = {k: g.sort_values("plane") for k, g in df.groupby("level")}
        at, keep, left = dict.fromkeys(levels, 0), [], float(df.err0.iloc[0])

        def best(k: int) -> tuple[float, int]:
            rest = levels[k].iloc[at[k] :]
            means = rest.gain.cumsum() / rest["size"].cumsum()
            return (float(means.max()), int(means.to_numpy().argmax()) + 1) if len(rest) else (-1.0, 0)

        while left >= tau:
            k = max(sorted(levels), key=lambda level: best(level)[0])
            n = best(k)[1]
            if not n:
                break
            step = levels[k].iloc[at[k] : at[k] + n]
            keep.append(step)
            left -= float(step.gain.sum())
            at[k] += n
        return pd.concat(keep) if keep else df.iloc[:0]

    fresh = _fresh(rows, by, prev).select(*by, "level", "plane", "size", "gain", "err0")
    return _counts(rows, fresh.groupBy(*by).applyInPandas(run, schema), by, prev)


PLANNERS = {"in_order": in_order, "round_robin": round_robin, "greedy": greedy, "greedy_with_signs": greedy_with_signs, "greedy_runs": greedy_runs}


def cap_levels(rows: DataFrame, most: int) -> DataFrame:
    """Levels up to one; the error that the others leave stays in err0."""
    return rows.where(F.col("level") <= most)


def reorganised(rows: DataFrame, by: list[str], how: str = "in_order") -> DataFrame:
    """With seq and start: the place of each fragment, and its first byte, if fragments follow one another in this order."""
    order = ["level", "plane"] if how == "in_order" else ["plane", "level"]
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"seq": F.row_number().over(w) - 1, "start": start})


def merge_small(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """With bucket: planes in order, a bucket ending once it holds `least` bytes. Plane 0 is in the first.

    A bucket's end depends on the last one's, so each level's few planes are folded in order.
    """
    planes = rows.groupBy(*by, "level").agg(F.array_sort(F.collect_list(F.struct("plane", "size"))).alias("_p"))
    empty = F.array().cast("array<struct<plane:int,size:bigint,bucket:int>>")
    folded = F.aggregate(
        "_p",
        F.struct(empty.alias("out"), F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("held")),
        lambda a, x: F.struct(
            F.concat(a["out"], F.array(F.struct(x["plane"].cast("int").alias("plane"), x["size"].cast("bigint").alias("size"), a["bucket"].alias("bucket")))).alias("out"),
            F.when(a["held"] + x["size"] >= least, a["bucket"] + 1).otherwise(a["bucket"]).cast("int").alias("bucket"),
            F.when(a["held"] + x["size"] >= least, F.lit(0).cast("bigint")).otherwise((a["held"] + x["size"]).cast("bigint")).alias("held"),
        ),
    )["out"]
    return planes.select(*by, "level", F.explode(folded).alias("x")).select(*by, "level", "x.plane", "x.size", "x.bucket")
