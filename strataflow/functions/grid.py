"""Level grids: extents, counts, levels of elements, binary exponents.

A grid of n points along an axis has (n >> 1) + 1 on the next coarser level: the even places, and the last one where
n is even. Levels count from 0, the coarsest.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_dims(dims: list[int], levels: int) -> list[list[int]]:
    """Extents of levels 0..levels, coarsest first."""
    out = [list(dims)]
    for _ in range(levels):
        out.append([(n >> 1) + 1 for n in out[-1]])
    return out[::-1]


def level_elements(dims: list[int], levels: int) -> list[int]:
    """Number of elements that are new on each level."""
    sizes = [prod(d) for d in level_dims(dims, levels)]
    return [a - b for a, b in zip(sizes, [0, *sizes[:-1]], strict=True)]


def most_levels(dims: list[int]) -> int:
    return max(0, min(dims).bit_length() - 2)


def check_levels(dims: list[int], levels: int) -> None:
    """Refuses a number of levels that the shortest axis can't be halved by; nothing is written then."""
    if not dims or len(dims) > 3:
        raise ValueError(f"a field has one to three axes, not {len(dims)}")
    if not 0 <= levels <= most_levels(dims):
        raise ValueError(f"{levels} levels asked of extents {dims}; at most {most_levels(dims)}")


def pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def exponent(x: Column) -> Column:
    """The exponent e with |x| = m * 2^e, 0.5 <= m < 1; 0 for 0. Logarithms alone miss powers of two."""
    a = F.abs(x)
    guess = F.floor(F.log2(F.when(a > 0, a))).cast("int") + 1
    exact = F.when(a >= pow2(guess), guess + 1).when(a < pow2(guess - 1), guess - 1).otherwise(guess)
    return F.coalesce(exact, F.lit(0)).cast("int")


def places(idx: Column, n: Column, levels: int) -> list[tuple[Column, Column]]:
    """For levels from the finest to 0: the element's place there (null where it has none) and the level's extent.

    Halving an extent k times leaves (n - 2 >> k) + 2. The last element stays last; others stay if 2^k divides idx.
    """
    out = [(idx, n)]
    for k in range(1, levels + 1):
        coarse = F.shiftright(n.cast("bigint") - 2, k) + 2
        out.append((F.when(idx == n - 1, coarse - 1).when(idx % (1 << k) == 0, F.shiftright(idx.cast("bigint"), k)), coarse))
    return out


def level_of(idx: Column, n: Column, levels: int) -> Column:
    """The level on which an element of a line of n is new."""
    out = F.lit(0)
    at = places(idx, n, levels)
    for k in range(levels - 1, -1, -1):
        c, m = at[k]
        out = F.when((c % 2 == 1) & (c != m - 1), F.lit(levels - k)).otherwise(out)
    return out.cast("int")


def level_of_3d(i: Column, j: Column, k: Column, dims: tuple[int, int, int], levels: int) -> Column:
    """The level on which an element of a box is new: the finest of its coordinates' levels."""
    return F.greatest(*(level_of(c, F.lit(n), levels) for c, n in zip((i, j, k), dims, strict=True)))


def unflatten(idx: Column, dims: list[int]) -> list[Column]:
    """Row-major coordinates of a flat index."""
    out, step = [], 1
    for n in reversed(dims):
        out.append((F.floor(idx / F.lit(step)) % n).cast("bigint"))
        step *= n
    return out[::-1]
