"""Retrieval controlled by the error of a derived quantity, the length of a vector of variables (the speed of a flow)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions import qoi
from strataflow.operators import approx
from strataflow.operators.fields import argmax
from strataflow.session import cut

#: What the errors are divided by, and how many rounds are tried.
STEP, ROUNDS = 1.5, 5
VARIABLES = ("vx", "vy", "vz")

Bounds = tuple[float, ...]


def speed_errors(points: DataFrame, bounds: Sequence[float | Column], mask: Column | None = None, names: Sequence[str] = VARIABLES) -> DataFrame:
    """points (with the named variables) with v_tot and est, the bound of its error; 0 for masked points."""
    v = [F.col(n) for n in names]
    est = qoi.speed_bound(v, [b if isinstance(b, Column) else F.lit(float(b)) for b in bounds])
    if mask is not None:
        est = F.when(mask, est).otherwise(F.lit(0.0))
    return points.withColumn("v_tot", qoi.speed(*v)).withColumn("est", est)


def worst_point(points: DataFrame, by: list[str], bounds: Sequence[float], mask: Column | None = None, names: Sequence[str] = VARIABLES) -> DataFrame:
    """The point with the largest estimate; of equals the one with the least index."""
    return argmax(speed_errors(points, bounds, mask, names), by, "est", "idx", list(names))


def tighten(v: Sequence[float], bounds: Bounds, tau: float) -> tuple[Bounds, int]:
    """Bounds divided by STEP until the point's estimate is within tau, and how often that was."""

    def estimate(e: Bounds) -> float:
        x = sum(a * a for a in v)
        d = sum(2 * abs(a) * b + b * b for a, b in zip(v, e, strict=True))
        return sqrt(d) if x == 0 else d / (sqrt(x - d) + sqrt(x)) if x > d else d / sqrt(x)

    if tau <= 0:
        raise ValueError("tau must be positive")
    n = 0
    while estimate(bounds) > tau:
        bounds = tuple(b / STEP for b in bounds)
        n += 1
    return bounds, n


def tightened(worst: DataFrame, bounds: Sequence[float | Column], tau: float, most: int = 200, names: Sequence[str] = VARIABLES) -> DataFrame:
    """worst points with steps, the number of divisions that bring their estimate within tau."""
    v = [F.col(n) for n in names]
    held = [b if isinstance(b, Column) else F.lit(float(b)) for b in bounds]
    over = lambda n: qoi.speed_bound(v, [b / F.pow(F.lit(STEP), n) for b in held]) > F.lit(tau)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(most)), F.lit(0), lambda n, _: F.when(over(n), n + 1).otherwise(n))
    return worst.withColumn("steps", steps)


@dataclass
class Outcome:
    """points: (block, idx, variables); met: whether every point's estimate is there and within tau; estimate: the largest.

    uncontrolled: points without an estimate, as a variable is NULL or can't be bounded there; elements: points in all;
    bounds: of the variables at the end; bytes: read so far, None if what was fetched from doesn't tell.
    """

    points: DataFrame
    met: bool
    rounds: int
    estimate: float
    bounds: Bounds
    uncontrolled: int = 0
    elements: int = 0
    bytes: int | None = None

    @property
    def ratio(self) -> float | None:
        """Bytes of the variables as doubles over bytes read."""
        return self.elements * len(self.bounds) * 8 / self.bytes if self.bytes else None

    @property
    def bitrate(self) -> float | None:
        """Bits read for each value."""
        return self.bytes * 8 / (self.elements * len(self.bounds)) if self.bytes is not None and self.elements else None


def retrieve_speed(fetch: Callable[[Bounds], DataFrame], bounds: Bounds, tau: float, mask: Column | None = None, rounds: int = ROUNDS, names: Sequence[str] = VARIABLES) -> Outcome:
    """Fetches fields within bounds, estimates, and tightens, until the speed's error is within tau or rounds are up.

    fetch(bounds) gives (block, idx, variables), each within its bound: Sessions, Snapshots, or a function. Only the worst
    point of all comes to the driver. Points without an estimate keep the target from being met; if there are only these
    beyond it, all bounds are divided by STEP once a round.
    """
    if tau <= 0:
        raise ValueError("tau must be positive")
    points, estimate, met, done, lost, n = None, float("inf"), False, 0, 0, 0
    while done < rounds and not met:
        done += 1
        points = cut(fetch(bounds))
        rated = speed_errors(points, bounds, mask, names)
        row = rated.agg(F.max(F.when(F.col("est").isNotNull(), F.struct("est", (-F.col("idx")).alias("_i"), *names))).alias("top"), F.count_if(F.col("est").isNull()).alias("lost"), F.count("*").alias("n")).first()
        worst, lost, n = row["top"], row["lost"], row["n"]
        estimate = worst["est"] if worst is not None else (float("inf") if n else 0.0)
        met = lost == 0 and estimate <= tau
        if met or done == rounds:
            break
        if worst is not None and estimate > tau:
            bounds, _ = tighten([worst[c] for c in names], bounds, tau)
        else:
            bounds = tuple(b / STEP for b in bounds)
    told = getattr(fetch, "bytes", None)
    return Outcome(points, met, done, estimate, bounds, lost, n, told() if told else None)


class Sessions:
    """Fetches from one Session for each variable; each request reads only what it adds."""

    def __init__(self, sessions: dict[str, object]):
        self.sessions = sessions

    def __call__(self, bounds: Bounds) -> DataFrame:
        out = None
        for (name, session), bound in zip(self.sessions.items(), bounds, strict=True):
            one = session.reconstruct(bound).select("block", "idx", F.col("value").alias(name))
            out = one if out is None else out.join(one, ["block", "idx"])
        return out

    def bytes(self) -> int:
        return sum(s.retrieved().agg(F.sum("bytes")).first()[0] or 0 for s in self.sessions.values())


class Snapshots:
    """Fetches from snapshot tables (block, idx, snapshot, value), or from delta tables (block, idx, segment, value).

    spans: ranges of the variables over all blocks. A bound beyond the last rung gets the last rung. Of snapshots each
    one asked for is read anew; of deltas only segments not read before count as bytes.
    """

    def __init__(self, fields: dict[str, DataFrame], spans: dict[str, float], rungs: int, deltas: bool = False):
        self.fields, self.spans, self.rungs, self.deltas = fields, spans, rungs, deltas
        self.read: dict[str, set[int]] = {name: set() for name in fields}

    def __call__(self, bounds: Bounds) -> DataFrame:
        out, index = None, "segment" if self.deltas else "snapshot"
        for (name, rows), bound in zip(self.fields.items(), bounds, strict=True):
            i = next((k for k in range(self.rungs) if self.spans[name] * 10.0 ** -(k + 1) <= bound), self.rungs - 1)
            self.read[name] |= set(range(i + 1)) if self.deltas else {i}
            one = rows.where(F.col(index) <= i if self.deltas else F.col(index) == i).groupBy("block", "idx").agg(F.sum("value").alias(name))
            out = one if out is None else out.join(one, ["block", "idx"])
        return out

    def bytes(self) -> int:
        """Cells' numbers in as many bits as a rung or segment takes."""
        bits = approx.segment_bits if self.deltas else approx.rung_bits
        index, total = "segment" if self.deltas else "snapshot", 0
        for name, rows in self.fields.items():
            n = rows.where(F.col(index) == 0).count()
            total += sum(-(-n * bits(i) // 8) for i in self.read[name])
        return total


def retrieve_blocks(snapshots: dict[str, DataFrame], spans: dict[str, float], bounds: Bounds, tau: float, rungs: int, mask: Column | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """As retrieve_speed, for each block on its own, all blocks at once, with ranges over all of them.

    Returns (block, idx, variables) of all blocks, and (block, met, rounds, estimate, uncontrolled, elements, bytes).
    Blocks that met the target are not read again. What comes to the driver is a count each round.
    """
    names = list(snapshots)
    start = snapshots[names[0]].select("block").distinct()
    open_ = cut(start.select("block", *(F.lit(float(b)).alias(f"e{i}") for i, b in enumerate(bounds)), F.lit(0).cast("bigint").alias("bytes")))
    points = states = None
    for done in range(1, rounds + 1):
        got = open_
        for i, name in enumerate(names):
            rung = approx.snapshot_for(F.col(f"e{i}") / F.lit(spans[name]), rungs) if spans[name] > 0 else F.lit(0)
            open_ = open_.withColumn(f"r{i}", rung)
        for i, name in enumerate(names):
            one = snapshots[name].join(open_.select("block", F.col(f"r{i}").alias("snapshot")), ["block", "snapshot"]).select("block", "idx", F.col("value").alias(name))
            got = one if i == 0 else got.join(one, ["block", "idx"])
        rated = cut(speed_errors(got.join(open_, "block"), [F.col(f"e{i}") for i in range(len(names))], mask, names))
        held = [f"e{i}" for i in range(len(names))] + [f"r{i}" for i in range(len(names))]
        top = F.max(F.when(F.col("est").isNotNull(), F.struct("est", (-F.col("idx")).alias("_i"), *names))).alias("top")
        state = rated.groupBy("block", "bytes", *held).agg(top, F.count_if(F.col("est").isNull()).alias("uncontrolled"), F.count("*").alias("elements"))
        size = sum((F.element_at(F.array(*(F.lit(approx.rung_bits(k)) for k in range(rungs))), F.col(f"r{i}") + 1) for i in range(len(names))), F.lit(0))
        state = state.withColumn("bytes", F.col("bytes") + F.ceil(F.col("elements") * size / 8))
        met = (F.col("uncontrolled") == 0) & (F.col("top.est") <= tau)
        state = cut(state.withColumn("met", F.coalesce(met, F.lit(False))))
        ended = state if done == rounds else state.where("met")
        closed = ended.select("block", "met", F.lit(done).alias("rounds"), F.coalesce("top.est", F.lit(float("inf"))).alias("estimate"), "uncontrolled", "elements", "bytes")
        part = rated.join(ended.select("block"), "block", "left_semi").select("block", "idx", *names)
        points, states = (part, closed) if points is None else (points.unionByName(part), states.unionByName(closed))
        rest = state.where(~F.col("met"))
        if done == rounds or rest.isEmpty():
            break
        worst = tightened(rest.select("block", "bytes", "top.*", *held[: len(names)]), [F.col(f"e{i}") for i in range(len(names))], tau, names=names)
        steps = F.greatest("steps", F.lit(1))  # where only points without an estimate are left
        open_ = cut(worst.select("block", *((F.col(f"e{i}") / F.pow(F.lit(STEP), steps)).alias(f"e{i}") for i in range(len(names))), "bytes"))
    return points, states


def ratio(raw_bytes: Column, read_bytes: Column) -> Column:
    return raw_bytes / F.when(read_bytes > 0, read_bytes)


def bitrate(read_bytes: Column, elements: Column, variables: int) -> Column:
    """Bits read for each value."""
    return read_bytes * 8 / (elements * variables)
