"""Error ladders and estimators, as column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.grid import exponent, pow2

#: The orthogonal basis's factor by number of axes.
ORTHOGONAL = {1: 4 * (1 + sqrt(3) / 2), 2: 4 * (1 + 9 / 4), 3: 4 * (1 + 21 * sqrt(3) / 8)}


def level_bound(largest: Column, negabinary: bool = False) -> Column:
    """A level's bound before any plane: its largest magnitude, four times that for negabinary."""
    return largest * 4 if negabinary else largest


def ladder(bound: Column, taken: Column) -> Column:
    """Largest error after so many planes. A level of zeros has none, whatever is taken."""
    return F.when(bound == 0, F.lit(0.0)).when(taken == 0, bound).otherwise(pow2(exponent(bound) - taken))


def hierarchical(error: Column) -> Column:
    """Estimate for the hierarchical basis: errors of levels add up as they are."""
    return error


def orthogonal(error: Column, axes: int) -> Column:
    """Estimate for the orthogonal basis."""
    return error * F.lit(ORTHOGONAL[axes])


def squared_hierarchical(error: Column, level: Column, axes: int, levels: int) -> Column:
    """Estimate of the squared error for the hierarchical basis."""
    return pow2((F.lit(levels) - level) * axes) * error * 2


def squared_hierarchical_gain(before: Column, after: Column, level: Column, axes: int, levels: int) -> Column:
    """What a plane takes off the squared error; without the estimate's factor 2."""
    return pow2((F.lit(levels) - level) * axes) * (before - after)


def s_norm(error: Column, level: Column, axes: int, levels: int, s: float) -> Column:
    """Estimate of the squared error in the norm of smoothness s."""
    return pow2(level * (2 * s) + (F.lit(levels) - level) * axes) * error
