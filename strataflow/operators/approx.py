"""Approximations within an absolute bound, residual ladders, and snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from strataflow.functions.grid import unflatten

#: The base bound's share of the range; segments of single and double precision; rungs of snapshots.
BASE_SHARE, SEGMENTS, RUNGS = 0.001, {"float": 7, "double": 16}, {"serial": 18, "parallel": 10}


#: Fixed value: from here on doubles are more than 1 apart, or just that.
WHOLE = float(1 << 53)


def quantise(v: Column, bound: Column) -> Column:
    """The number of the cell, of width twice the bound, that a value lies in.

    Null where there are no cells, as the bound is 0, or so small that doubles of the value's size can't tell cells apart.
    """
    cell = v / F.when(bound > 0, bound * 2)
    return F.floor(F.when(F.abs(cell) < WHOLE, cell) + 0.5).cast("bigint")


def restore(cell: Column, bound: Column) -> Column:
    return cell.cast("double") * (bound * 2)


def approximate(v: Column, bound: Column) -> Column:
    """The cell's middle, within the bound of the value but for rounding; the value itself where there are no cells."""
    return F.coalesce(restore(quantise(v, bound), bound), v)


def predicted(v: Column, bound: Column, before: Column) -> Column:
    """The number of the cell of what a value differs by from the approximation of the one before it."""
    return quantise(v, bound) - F.coalesce(quantise(before, bound), F.lit(0))


def predict_lines(field: DataFrame, by: list[str], bound: str = "bound0") -> DataFrame:
    """field with code: small numbers for smooth lines, from which `unpredict_lines` makes the approximation again.

    Cells are numbered alike all along a line, so the difference of neighbours' numbers is the code and nothing drifts.
    """
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("idx"))
    return field.withColumn("code", predicted(F.col("value"), F.col(bound), before))


def unpredict_lines(coded: DataFrame, by: list[str], bound: str = "bound0") -> DataFrame:
    """coded with base, the approximation: running sums of the codes are the cells."""
    cell = F.sum("code").over(Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return coded.withColumn("base", restore(cell, F.col(bound)))


def predict_boxes(field: DataFrame, by: list[str], dims: list[int], bound: str = "bound0") -> DataFrame:
    """As predict_lines for boxes: the difference is taken along every axis in turn, flat index row-major."""
    out = field.withColumn("code", quantise(F.col("value"), F.col(bound)))
    return _along(out, by, dims, lambda w: F.col("code") - F.coalesce(F.lag("code").over(w), F.lit(0)))


def unpredict_boxes(coded: DataFrame, by: list[str], dims: list[int], bound: str = "bound0") -> DataFrame:
    """Running sums along every axis in turn."""
    cells = _along(coded.withColumn("_code", F.col("code")), by, dims, lambda w: F.sum("code").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cells.withColumn("base", restore(F.col("code"), F.col(bound))).withColumn("code", F.col("_code")).drop("_code")


def _along(rows: DataFrame, by: list[str], dims: list[int], change: Callable[[WindowSpec], Column]) -> DataFrame:
    at = unflatten(F.col("idx"), dims)
    names = [f"_a{i}" for i in range(len(dims))]
    rows = rows.withColumns(dict(zip(names, at, strict=True)))
    for name in names:
        rows = rows.withColumn("code", change(Window.partitionBy(*by, *(x for x in names if x != name)).orderBy(name)))
    return rows.drop(*names)


def nothing(v: Column) -> Column:
    """The approximation that predicts 0: the residual is the value."""
    return v * 0


def rung_bound(span: Column, rung: int) -> Column:
    return span / F.lit(float(10 ** (rung + 1)))


def delta_segments(v: Column, span: Column, segments: int) -> Column:
    """An array: segment i approximates what segments before it leave, within span / 10^(i + 1). No shuffle.

    A fold rather than nested columns, whose size would grow by a power of the number of segments.
    """
    bounds = F.array(*(rung_bound(span, i) for i in range(segments)))
    empty = F.array().cast("array<double>")

    def step(acc: Column, bound: Column) -> Column:
        q = approximate(acc["rest"], bound)
        return F.struct((acc["rest"] - q).alias("rest"), F.concat(acc["out"], F.array(q)).alias("out"))

    return F.aggregate(bounds, F.struct(v.alias("rest"), empty.alias("out")), step)["out"]


def segments_needed(span: Column, tau: Column, segments: int) -> Column:
    """How many segments bring the bound, the span at first, down to tau."""
    out = F.lit(segments)
    for k in range(segments - 1, -1, -1):
        bound = span if k == 0 else rung_bound(span, k - 1)
        out = F.when(bound <= tau, F.lit(k)).otherwise(out)
    return out.cast("int")


def with_range(field: DataFrame, by: list[str]) -> DataFrame:
    """field with span, its range over the whole group. `by` may be empty: one range for all."""
    spans = field.groupBy(*by).agg((F.max("value") - F.min("value")).alias("span"))
    return field.join(spans, by) if by else field.join(F.broadcast(spans))


def refactor_deltas(field: DataFrame, keys: list[str], by: list[str], segments: int) -> DataFrame:
    """keys, segment, value, span: a row for each segment."""
    ranged = with_range(field, by)
    parts = delta_segments(F.col("value"), F.col("span"), segments)
    return ranged.select(*keys, "span", F.posexplode(parts)).select(*keys, F.col("pos").alias("segment"), F.col("col").alias("value"), "span")


def reconstruct_deltas(deltas: DataFrame, keys: list[str], tau: float, segments: int) -> DataFrame:
    """The sum of the segments that tau needs, in order; 0 if it needs none."""
    need = segments_needed(F.col("span"), F.lit(tau), segments)
    held = F.array_sort(F.collect_list(F.when(F.col("segment") < need, F.struct("segment", "value"))))
    sums = deltas.groupBy(*keys).agg(F.aggregate(held, F.lit(0.0), lambda a, x: a + x["value"]).alias("value"))
    return sums


def snapshots(field: DataFrame, keys: list[str], by: list[str], rungs: int) -> DataFrame:
    """keys, snapshot, value: whole copies within span / 10^(snapshot + 1) each."""
    ranged = with_range(field, by)
    copies = F.array(*(approximate(F.col("value"), rung_bound(F.col("span"), i)) for i in range(rungs)))
    return ranged.select(*keys, F.posexplode(copies)).select(*keys, F.col("pos").alias("snapshot"), F.col("col").alias("value"))


def rung_bits(rung: int) -> int:
    """Bits of a cell's number in a snapshot: the range has 10^(rung + 1) / 2 cells and one, counted from the lowest value's."""
    return (10 ** (rung + 1) // 2 + 1).bit_length()


def segment_bits(segment: int) -> int:
    """Bits of a cell's number in a delta segment: of the range in the first, of the cell before in the others, with a sign."""
    return rung_bits(0) if segment == 0 else 4


def snapshot_for(relative: Column, rungs: int) -> Column:
    """The coarsest snapshot whose relative bound is at most the one asked; the finest if none is."""
    out = F.lit(rungs - 1)
    for i in range(rungs - 1, -1, -1):
        out = F.when(relative >= F.lit(float(f"1e-{i + 1}")), F.lit(i)).otherwise(out)
    return out.cast("int")


def based_residual(field: DataFrame, by: list[str], share: float = BASE_SHARE) -> DataFrame:
    """With base and residual: an approximation within a share of the range, and what it leaves for the planes."""
    ranged = with_range(field, by).withColumn("bound0", F.col("span") * share)
    base = approximate(F.col("value"), F.col("bound0"))
    return ranged.withColumn("base", base).withColumn("residual", F.col("value") - F.col("base"))
