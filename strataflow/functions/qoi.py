"""Derived quantities of flow fields, and bounds of their errors, as column expressions.

A bound is NULL where the error can't be bounded (a divisor whose error reaches zero): a zero would read as exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gas constant, heat ratio, and Sutherland's reference viscosity, temperature and constant.
R, GAMMA, MU_R, T_R, S = 287.1, 1.4, 1.716e-5, 273.15, 110.4


def square_bound(x: Column, e: Column) -> Column:
    return F.abs(x) * 2 * e + e * e


def square_inverse(x: Column, tau: Column) -> Column:
    """The largest error of x that keeps x^2 within tau."""
    return F.sqrt(x * x + tau) - F.abs(x)


def sqrt_bound(x: Column, e: Column) -> Column:
    inside = F.greatest(x - e, F.lit(0.0))
    return F.when(x == 0, F.sqrt(e)).when(x > e, e / (F.sqrt(inside) + F.sqrt(x))).when(x > 0, e / F.sqrt(x))


def sqrt_inverse(x: Column, e: Column, tau: Column) -> Column:
    inside = F.greatest(x - e, F.lit(0.0))
    return F.when(x == 0, tau * tau).when(x > e, tau * (F.sqrt(inside) + F.sqrt(x))).when(x > 0, tau * F.sqrt(x))


def _beyond(x: Column, e: Column) -> Column:
    """x moved by e towards zero; null where that reaches or crosses it."""
    return F.when(F.abs(x) > e, F.when(x > 0, x - e).otherwise(x + e))


def reciprocal_bound(x: Column, a: Column, e: Column) -> Column:
    return e / F.abs(_beyond(x + a, e) * (x + a))


def reciprocal_inverse(x: Column, a: Column, e: Column, tau: Column) -> Column:
    return tau * F.abs(_beyond(x + a, e) * (x + a))


def product_bound(x: Column, y: Column, ex: Column, ey: Column) -> Column:
    return F.abs(x) * ey + F.abs(y) * ex + ex * ey


def quotient_bound(x: Column, y: Column, ex: Column, ey: Column) -> Column:
    return (F.abs(x) * ey + F.abs(y) * ex) / F.abs(y * _beyond(y, ey))


def _sum(terms: Iterable[Column]) -> Column:
    return reduce(add, terms)


def speed2(*v: Column) -> Column:
    return _sum(x * x for x in v)


def speed(*v: Column) -> Column:
    """The length of a vector of any number of components."""
    return F.sqrt(speed2(*v))


def speed_bound(v: Sequence[Column], e: Sequence[Column]) -> Column:
    """Bound of the speed's error, from the squares' bounds."""
    return sqrt_bound(speed2(*v), _sum(square_bound(x, b) for x, b in zip(v, e, strict=True)))


def tighten_speed(v: tuple[Column, Column, Column], e: tuple[Column, Column, Column], tau: Column) -> Column:
    """The factor on all three errors that brings the speed's bound to tau: a quadratic's positive root."""
    total = square_bound(v[0], e[0]) + square_bound(v[1], e[1]) + square_bound(v[2], e[2])
    allowed = sqrt_inverse(speed2(*v), total, tau)
    a = e[0] * e[0] + e[1] * e[1] + e[2] * e[2]
    b = (F.abs(v[0]) * e[0] + F.abs(v[1]) * e[1] + F.abs(v[2]) * e[2]) * 2
    return (F.sqrt(b * b + a * allowed * 4) - b) / F.when(a > 0, a * 2)


def tighten_temperature(p: Column, d: Column, ep: Column, ed: Column, c: Column, tau: Column) -> Column:
    """The factor on both errors that brings the temperature's bound to tau."""
    bound = c * quotient_bound(p, d, ep, ed)
    return tau / F.when(bound > 0, bound)


def temperature(p: Column, d: Column) -> Column:
    return p / F.when(d != 0, d * F.lit(R))


def sound(t: Column) -> Column:
    return F.sqrt(F.lit(GAMMA * R) * t)


def viscosity(t: Column) -> Column:
    q = t / F.lit(T_R)
    return F.lit(MU_R) * F.sqrt(q * q * q) * F.lit(T_R + S) / (t + F.lit(S))


def mach(v: Column, c: Column) -> Column:
    return v / F.when(c != 0, c)


def total_pressure(p: Column, m: Column) -> Column:
    """Products rather than a power, which engines round differently."""
    q = m * m * F.lit((GAMMA - 1) / 2) + 1
    q3 = q * q * q
    return p * F.sqrt(q3 * q3 * q)


def all_quantities(vx: Column, vy: Column, vz: Column, p: Column, d: Column) -> dict[str, Column]:
    v, t = speed(vx, vy, vz), temperature(p, d)
    c = sound(t)
    m = mach(v, c)
    return {"v_tot": v, "temp": t, "c": c, "mach": m, "pt": total_pressure(p, m), "mu": viscosity(t)}


def normalise_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Two coefficients in units of the smaller; two equal ones are 1.5 each."""
    low = F.least(a, b)
    low = F.when(low != 0, low)
    x, y = a / low, b / low
    both = (x == 1) & (y == 1)
    return F.when(both, F.lit(1.5)).otherwise(x), F.when(both, F.lit(1.5)).otherwise(y)
