"""Multilevel transform in the hierarchical basis, and, block by block, in the orthogonal one.

A new element's coefficient is its value less the mean of its two neighbours on its level. Neighbours are coarser
elements, whose values the hierarchical basis keeps, so each coarser element sends its value to the finer ones beside it
and one grouped sum gives all coefficients. Going back, where each level needs the one before, is worked a block at a time
in NumPy, with one shuffle for all levels; so are fields of two or three axes, and the orthogonal basis (which solves a
tridiagonal system on each line). A block is the unit that a caller chooses to fit in memory.

`by` names the columns that make up a block: the block's number, and the variable where there are several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.grid import level_dims, level_of, places
from strataflow.session import ship_package

BY = ("block",)


def with_extent(field: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """field with n, the number of elements in its block."""
    sizes = field.groupBy(*by).agg((F.max("idx") + 1).alias("n"))
    return field.join(sizes, list(by))


def with_level(field: DataFrame, levels: int) -> DataFrame:
    return field.withColumn("level", level_of(F.col("idx"), F.col("n"), levels))


def _sends(levels: int) -> Column:
    """The finer elements beside an element, on all levels that are finer than its own."""
    idx, n = F.col("idx"), F.col("n")
    out = []
    for k, (c, m) in enumerate(places(idx, n, levels)):
        if k == levels:
            continue
        coarse = F.col("level") < levels - k
        for step in (-1, 1):
            to = c + step
            inside = coarse & (to > 0) & (to % 2 == 1) & (to < m - 1)
            out.append(F.when(inside, to * (1 << k)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def decompose(field: DataFrame, levels: int, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, idx, n, level, value): coefficients of new elements, values of the coarsest."""
    keys = [*by, "idx"]
    own = with_level(with_extent(field.select(*keys, "value"), by), levels)
    sent = own.select(*by, F.explode(_sends(levels)).alias("idx"), F.col("value").alias("beside"))
    rows = own.select(*keys, "n", "level", "value", F.lit(None).cast("double").alias("beside")).unionByName(
        sent.select(*keys, F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("value"), "beside")
    )
    whole = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.max("level").alias("level"), F.max("value").alias("_v"), F.sum("beside").alias("_b"))
    return whole.select(*keys, "n", "level", F.when(F.col("level") == 0, F.col("_v")).otherwise(F.col("_v") - F.col("_b") / 2).alias("value"))


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def recompose(coefficients: DataFrame, levels: int, upto: int | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, idx, n, level, value) of the elements on levels 0..upto, from their coefficients.

    Elements of finer levels are not made up; `upsample` does that.
    """
    ship_package(coefficients.sparkSession)
    held = coefficients if upto is None else coefficients.where(F.col("level") <= upto)
    columns = [*by, "idx", "n", "level", "value"]
    held = held.select(*columns[:-1], F.col("value").cast("double").alias("value"))

    def run(table: pa.Table) -> pa.Table:
        idx = table.column("idx").to_numpy()
        flat = np.zeros(int(table.column("n")[0].as_py()))
        flat[idx] = table.column("value").to_numpy()
        return table.set_column(len(columns) - 1, "value", pa.array(block_recompose(flat, levels)[idx]))

    return held.groupBy(*by).applyInArrow(run, _kinds(held, columns))


def zero_beyond(coefficients: DataFrame, level: int) -> DataFrame:
    """Coefficients with all finer than a level set to 0."""
    return coefficients.withColumn("value", F.when(F.col("level") <= level, F.col("value")).otherwise(F.lit(0.0)))


def upsample(coefficients: DataFrame, levels: int, level: int, by: tuple[str, ...] = BY) -> DataFrame:
    """The full grid that the levels up to one give, coefficients of the finer ones being 0."""
    return recompose(zero_beyond(coefficients, level), levels, by=by)


def interleave(coefficients: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """With pos, an element's place among those of its block and level, by index."""
    return coefficients.withColumn("pos", (F.row_number().over(Window.partitionBy(*by, "level").orderBy("idx")) - 1).cast("bigint"))


# ---- whole blocks in NumPy ----


def _coarse(n: int) -> np.ndarray:
    at = np.arange(0, n, 2)
    return at if n % 2 else np.append(at, n - 1)


def _line_split(v: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse values, and new elements less the mean of their neighbours, along an axis."""
    v = np.moveaxis(v, axis, 0)
    n = v.shape[0]
    odd = np.arange(1, n - 1, 2)
    return v[_coarse(n)], v[odd] - (v[odd - 1] + v[odd + 1]) / 2


def _mass_solve(f: np.ndarray) -> np.ndarray:
    """Solves the mass matrix of hat functions on a uniform line (1/6, 4/6, 1/6; 2/6 at the ends) along axis 0."""
    n = f.shape[0]
    diag, off = np.full(n, 4 / 6), 1 / 6
    diag[0] = diag[-1] = 2 / 6
    c, d = np.zeros(n), np.array(f, float)
    for i in range(n):
        m = diag[i] - (off * c[i - 1] if i else 0)
        c[i] = off / m
        d[i] = (d[i] - (off * d[i - 1] if i else 0)) / m
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def _correction(coef: np.ndarray, coarse: int) -> np.ndarray:
    """Projection of the new elements' hats onto the coarse space: what the coarse values gain, along axis 0."""
    load = np.zeros((coarse, *coef.shape[1:]))
    m = coef.shape[0]
    # a hat of half the width under two coarse hats: 1/4 of a coarse cell's mass each
    load[:m] += coef / 4
    load[1 : m + 1] += coef / 4
    return _mass_solve(load)


def _between(low: np.ndarray, dims: tuple[int, ...]) -> np.ndarray:
    """A coarse box's values on the finer grid: means of neighbours, axis after axis."""
    for axis, n in enumerate(dims):
        v = np.moveaxis(low, axis, 0)
        fine = np.empty((n, *v.shape[1:]))
        fine[_coarse(n)] = v
        odd = np.arange(1, n - 1, 2)
        fine[odd] = (fine[odd - 1] + fine[odd + 1]) / 2
        low = np.moveaxis(fine, 0, axis)
    return low


def block_decompose(v: np.ndarray, levels: int, basis: str = "hierarchical") -> np.ndarray:
    """Coefficients in the places of the values.

    Hierarchical: a new element's difference from what the coarser box gives there, so errors of levels just add up.
    Orthogonal: axis by axis, with the projection of what is new added to what is coarse.
    """
    out = np.array(v, float)
    at = [np.arange(n) for n in v.shape]
    for _ in range(levels):
        box = out[np.ix_(*at)]
        if basis == "hierarchical":
            coarse = np.ix_(*(_coarse(n) for n in box.shape))
            new = box - _between(box[coarse], box.shape)
            new[coarse] = box[coarse]
            out[np.ix_(*at)] = new
            at = [a[_coarse(len(a))] for a in at]
            continue
        for axis in range(v.ndim):
            n = box.shape[axis]
            low, new = _line_split(box, axis)
            low = low + _correction(new, low.shape[0])
            joined = np.empty((n, *low.shape[1:]))
            joined[_coarse(n)], joined[np.arange(1, n - 1, 2)] = low, new
            box = np.moveaxis(joined, 0, axis)
        out[np.ix_(*at)] = box
        at = [a[_coarse(len(a))] for a in at]
    return out


def block_recompose(c: np.ndarray, levels: int, basis: str = "hierarchical") -> np.ndarray:
    out = np.array(c, float)
    grids = [[np.arange(n) for n in c.shape]]
    for _ in range(levels):
        grids.append([a[_coarse(len(a))] for a in grids[-1]])
    for at in grids[-2::-1] if levels else ():
        box = out[np.ix_(*at)]
        if basis == "hierarchical":
            coarse = np.ix_(*(_coarse(n) for n in box.shape))
            low = box[coarse]
            new = box + _between(low, box.shape)
            new[coarse] = low
            out[np.ix_(*at)] = new
            continue
        for axis in reversed(range(c.ndim)):
            v = np.array(np.moveaxis(box, axis, 0))
            n = v.shape[0]
            odd = np.arange(1, n - 1, 2)
            v[_coarse(n)] -= _correction(v[odd], len(_coarse(n)))
            v[odd] += (v[odd - 1] + v[odd + 1]) / 2
            box = np.moveaxis(v, 0, axis)
        out[np.ix_(*at)] = box
    return out


def block_levels(dims: list[int], levels: int) -> np.ndarray:
    """The level on which each element of a box is new."""
    out = np.zeros(dims, np.int32)
    at = [np.arange(n) for n in dims]
    for level in range(levels, 0, -1):
        box = np.full([len(a) for a in at], level, np.int32)
        box[np.ix_(*(_coarse(len(a)) for a in at))] = 0
        out[np.ix_(*at)] = np.where(box > 0, box, out[np.ix_(*at)])
        at = [a[_coarse(len(a))] for a in at]
    return out


def transform_blocks(field: DataFrame, dims: list[int], levels: int, basis: str = "hierarchical", inverse: bool = False, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, idx, level, value) of fields whose blocks are boxes of these extents, flat index row-major."""
    if len(level_dims(dims, levels)[0]) > 3:
        raise ValueError("one to three axes")
    ship_package(field.sparkSession)
    held = field.select(*by, "idx", F.lit(0).alias("level"), F.col("value").cast("double").alias("value"))

    def run(table: pa.Table) -> pa.Table:
        idx = table.column("idx").to_numpy()
        flat = np.zeros(int(np.prod(dims)))
        flat[idx] = table.column("value").to_numpy()
        box = (block_recompose if inverse else block_decompose)(flat.reshape(dims), levels, basis)
        table = table.set_column(len(by) + 1, "level", pa.array(block_levels(dims, levels).ravel()[idx]))
        return table.set_column(len(by) + 2, "value", pa.array(box.ravel()[idx]))

    return held.groupBy(*by).applyInArrow(run, _kinds(held, [*by, "idx", "level", "value"]))
