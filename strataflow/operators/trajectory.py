"""Analyses of molecular trajectories, tables of (frame, atom, x, y, z)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.session import ship_package

CUTOFF = 10.0


def select_atoms(trajectory: DataFrame, atoms: DataFrame) -> DataFrame:
    """The atoms that a topology table names."""
    return trajectory.join(atoms.select("atom").distinct(), "atom", "left_semi")


def rmsd(trajectory: DataFrame, reference: DataFrame, by: list[str] = ["frame"]) -> DataFrame:  # noqa: B006
    """Root mean square distance of each frame to a reference frame (atom, x, y, z), without superposition."""
    ref = reference.select("atom", *(F.col(c).alias(f"_{c}") for c in "xyz"))
    dx, dy, dz = (F.col(c) - F.col(f"_{c}") for c in "xyz")
    return trajectory.join(ref, "atom").groupBy(*by).agg(F.sqrt(F.avg(dx * dx + dy * dy + dz * dz)).alias("rmsd"), F.count("*").alias("n_atoms"))


def rmsf(trajectory: DataFrame, by: list[str] = ["atom"]) -> DataFrame:  # noqa: B006
    """Root mean square fluctuation of each atom about its mean place."""
    spread = F.var_pop("x") + F.var_pop("y") + F.var_pop("z")
    return trajectory.groupBy(*by).agg(F.sqrt(spread).alias("rmsf"), F.count("*").alias("n_frames"))


def aligned_rmsf(trajectory: DataFrame, selections: dict[str, DataFrame], reference: DataFrame | None = None) -> DataFrame:
    """(selection, atom, rmsf, n_frames): for each selection, fluctuations of its atoms once frames are superposed by them.

    The reference is the first frame, unless one (atom, x, y, z) is given.
    """
    out = None
    for name, atoms in selections.items():  # selections, not data
        picked = select_atoms(trajectory, atoms)
        fixed = reference if reference is not None else picked.groupBy("atom").agg(*(F.min_by(c, "frame").alias(c) for c in "xyz"))
        one = rmsf(align(picked, fixed)).select(F.lit(name).alias("selection"), "atom", "rmsf", "n_frames")
        out = one if out is None else out.unionByName(one)
    return out


def contacts(trajectory: DataFrame, cutoff: float = CUTOFF, by: list[str] = ["frame"], box: tuple[float, float, float] | None = None) -> DataFrame:  # noqa: B006
    """Pairs of atoms (a < b) of a frame nearer than the cutoff; at exactly the cutoff they aren't.

    Atoms meet by grid cells of the cutoff's width: an atom looks at its own cell and those beside it, round the box if
    there is one, so a frame's pairs are never all formed.
    """
    width = F.lit(float(cutoff))
    size = dict(zip("xyz", box or (None,) * 3, strict=True))
    cells = {c: max(1, int(s // cutoff)) if s else None for c, s in size.items()}

    def cell(c: str):
        if cells[c]:
            return F.least(F.floor((F.col(c) - F.floor(F.col(c) / size[c]) * size[c]) / F.lit(size[c] / cells[c])), F.lit(cells[c] - 1))
        return F.floor(F.col(c) / width)

    placed = trajectory.select(*by, "atom", "x", "y", "z", *(cell(c).cast("bigint").alias(f"c{c}") for c in "xyz"))
    near = placed
    for c in "xyz":
        beside = F.array(*(F.col(f"c{c}") + d for d in (-1, 0, 1)))
        if cells[c]:
            beside = F.array_distinct(F.array(*(F.pmod(F.col(f"c{c}") + d, F.lit(cells[c])) for d in (-1, 0, 1))))
        near = near.withColumn(f"c{c}", F.explode(beside))
    near = near.select(*by, "cx", "cy", "cz", F.col("atom").alias("a"), *(F.col(c).alias(f"_{c}") for c in "xyz"))
    pairs = near.join(placed.withColumnRenamed("atom", "b"), [*by, "cx", "cy", "cz"]).where("a < b")

    def gap(c: str):
        d = F.col(c) - F.col(f"_{c}")
        return d - F.round(d / size[c]) * size[c] if size[c] else d

    d2 = sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0))
    return pairs.withColumn("d2", d2).where(F.col("d2") < width * width).select(*by, "a", "b", "d2")


def contact_map(trajectory: DataFrame, cutoff: float = CUTOFF, start: int = 0, step: int = 1, sims: bool = False) -> DataFrame:
    """Pairs of atoms with the number and share of frames, of those taken, in which they touch."""
    frame = ["sim", "frame"] if sims else ["frame"]
    group = ["sim"] if sims else []
    taken = trajectory.where((F.col("frame") >= start) & ((F.col("frame") - start) % step == 0))
    n = taken.groupBy(*group).agg(F.count_distinct("frame").alias("n_frames"))
    hits = contacts(taken, cutoff, frame).groupBy(*group, "a", "b").agg(F.count("*").alias("hits"))
    hits = hits.join(n, group) if group else hits.join(F.broadcast(n))
    return hits.withColumn("share", F.col("hits") / F.col("n_frames"))


def _superpose(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two centres that bring moving nearest to fixed."""
    a, b = moving.mean(axis=0), fixed.mean(axis=0)
    u, _, vt = np.linalg.svd((moving - a).T @ (fixed - b))
    d = np.sign(np.linalg.det(u @ vt))
    return u @ np.diag([1.0, 1.0, d]) @ vt, a, b


def align(trajectory: DataFrame, reference: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Each frame superposed on a reference frame by the selected atoms; a frame is worked in one go.

    The reference travels with the frames by a join on the atom, whatever its size.
    """
    ship_package(trajectory.sparkSession)
    ref = reference.select("atom", *(F.col(c).cast("double").alias(f"_{c}") for c in "xyz"))
    if selection is not None:
        ref = ref.join(selection.select("atom").distinct(), "atom", "left_semi")
    both = trajectory.select("frame", "atom", *(F.col(c).cast("double") for c in "xyz")).join(ref, "atom", "left")

    def run(table: pa.Table) -> pa.Table:
        xyz = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        fixed = np.stack([table.column(f"_{c}").to_numpy() for c in "xyz"], axis=1)
        used = ~np.isnan(fixed).any(axis=1)
        if used.sum() >= 3:
            turn, a, b = _superpose(xyz[used], fixed[used])
            xyz = (xyz - a) @ turn + b
        return pa.table({"frame": table.column("frame"), "atom": table.column("atom"), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.groupBy("frame").applyInArrow(run, f"frame {kinds['frame']}, atom {kinds['atom']}, x double, y double, z double")


def with_coordinates(trajectory: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A trajectory with reconstructed coordinates in place of its own."""
    return trajectory.drop("x", "y", "z").join(rebuilt.select("frame", "atom", "x", "y", "z"), ["frame", "atom"])
