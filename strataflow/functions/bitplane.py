"""Bitplane forms of fixed-point numbers, as column expressions.

Planes count from 0, the most significant, to planes - 1. `exp` is the binary exponent of the level's largest
magnitude, before any widening that a form makes itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.grid import pow2

#: Fixed value: every second bit of 62, the offset between binary and negabinary.
ALTERNATE = 0x2AAAAAAAAAAAAAAA
MOST_PLANES = 60
#: Widening of the exponent, and scale of the value, by form.
WIDEN = {"perbit": (0, 1), "grouped": (0, 1), "negabinary": (2, 1), "weighted_negabinary": (3, 2)}


def check_planes(planes: int, form: str = "perbit") -> None:
    """Negabinary numbers end in a place of fixed sign only with an even number of planes."""
    if form not in WIDEN:
        raise ValueError(f"no form {form!r}")
    if not 1 <= planes <= MOST_PLANES:
        raise ValueError(f"{planes} planes; 1 to {MOST_PLANES} are possible")
    if "negabinary" in form and planes % 2:
        raise ValueError(f"{planes} planes; negabinary needs an even number")


def fixed_point(value: Column, exp: Column, planes: int, weight: Column | int = 0) -> Column:
    """The value in units of 2^(exp - planes - weight), cut towards zero."""
    shift = F.lit(planes) - exp + (F.lit(weight) if isinstance(weight, int) else weight)
    return (value * pow2(shift)).cast("bigint")


def to_negabinary(x: Column) -> Column:
    return (x + F.lit(ALTERNATE)).bitwiseXOR(F.lit(ALTERNATE))


def from_negabinary(x: Column) -> Column:
    return x.bitwiseXOR(F.lit(ALTERNATE)) - F.lit(ALTERNATE)


def bit(code: Column, plane: Column | int, planes: int) -> Column:
    """The bit of a code (magnitude or negabinary) in a plane."""
    at = F.lit(planes - 1) - (F.lit(plane) if isinstance(plane, int) else plane)
    return F.call_function("shiftright", code, at.cast("int")).bitwiseAND(F.lit(1)).cast("int")


def keep_planes(code: Column, taken: Column | int, planes: int) -> Column:
    """The code with all but its first `taken` planes zero."""
    drop = (F.lit(planes) - (F.lit(taken) if isinstance(taken, int) else taken)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", code, drop), drop)


def first_plane(magnitude: Column, planes: int) -> Column:
    """The plane of a magnitude's first one bit; planes for 0."""
    return F.when(magnitude == 0, F.lit(planes)).otherwise(F.lit(planes) - F.length(F.bin(magnitude))).cast("int")


def encode(value: Column, exp: Column, planes: int, form: str = "perbit") -> tuple[Column, Column]:
    """(code, sign) of a value: a magnitude and whether it is negative, or a negabinary code and false. -0.0 is positive."""
    widen, scale = WIDEN[form]
    fix = fixed_point(value * scale, exp + widen, planes)
    if "negabinary" in form:
        return to_negabinary(fix), F.lit(False)
    return F.abs(fix), value < 0


def decode(code: Column, sign: Column, exp: Column, planes: int, taken: Column | int, form: str = "perbit") -> Column:
    """The value that the first `taken` planes give."""
    widen, scale = WIDEN[form]
    kept = keep_planes(code, taken, planes)
    unit = pow2(exp + widen - planes)
    if "negabinary" in form:
        return from_negabinary(kept).cast("double") * unit / scale
    return F.when(sign, -kept.cast("double")).otherwise(kept.cast("double")) * unit


def delta(code: Column, sign: Column, exp: Column, planes: int, start: Column | int, stop: Column | int, form: str = "perbit") -> Column:
    """What planes start..stop-1 add to a value that planes before them gave."""
    return decode(code, sign, exp, planes, stop, form) - decode(code, sign, exp, planes, start, form)


def weighted_encode(value: Column, exp: Column, planes: int, weight: Column) -> tuple[Column, Column]:
    """Per-bit code of a value with so many extra bits of precision; widen exp by the largest weight to decode."""
    return F.abs(fixed_point(value, exp, planes, weight)), value < 0


def weighted_decode(code: Column, sign: Column, exp: Column, planes: int, weight: Column, most: int, taken: Column | int) -> Column:
    """The value that the first `taken` of planes + most planes give; each value's weight applies once."""
    kept = keep_planes(code, taken, planes + most)
    return F.when(sign, -kept.cast("double")).otherwise(kept.cast("double")) * pow2(exp - planes - weight)
