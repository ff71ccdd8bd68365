"""Refactoring fields into the fragment store, and reading them back within an error.

    store = refactor(field, "/path", Config(levels=4, planes=32))
    session = Session(spark, "/path")
    answer = session.reconstruct(1e-3)      # reads what that takes
    answer = session.reconstruct(1e-6)      # reads only what that adds
"""

from __future__ import annotations

from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import bitplane, errors
from strataflow.functions.grid import check_levels
from strataflow.operators import approx, encode, transform
from strataflow.plans import planner
from strataflow.session import cut, ship_package
from strataflow.sources import store


@dataclass(frozen=True)
class Config:
    """levels and planes; form: perbit, grouped, negabinary, weighted_negabinary; basis; policy: adaptive, all, none.

    grouped has the planes of perbit, laid out by words of 32 elements without the planes before a word's first one.

    dims: extents of every block, for fields of two or three axes and for the orthogonal basis; else blocks are lines.
    """

    levels: int = 0
    planes: int = 32
    form: str = "perbit"
    basis: str = "hierarchical"
    policy: str = "adaptive"
    latter: int = 64
    dims: tuple[int, ...] = default(default=())


_FIELD = ("block", "var")


def _coefficients(df: DataFrame, config: Config) -> DataFrame:
    """(block, var, idx, level, value): blocks of all variables in one pass."""
    if config.dims:
        check_levels(list(config.dims), config.levels)
        if df.isEmpty():
            raise ValueError("no variable")
        return transform.transform_blocks(df, list(config.dims), config.levels, config.basis, by=_FIELD)
    if config.basis != "hierarchical":
        raise ValueError("the orthogonal basis needs the blocks' extents")
    # lines may differ in length; shorter ones have levels without elements, but one must be long enough
    longest = df.agg((F.max("idx") + 1).alias("n")).first()["n"]
    if longest is None:
        raise ValueError("no variable")
    check_levels([longest], config.levels)
    return transform.decompose(df, config.levels, _FIELD).drop("n")


def refactor(df: DataFrame, path: str, config: Config, base: DataFrame | None = None) -> DataFrame:
    """Writes fragments and manifest of (block, var, idx, value); returns the manifest. Nothing is written of a bad config.

    base: block, var, approximator_eb, the bound of an approximation that the field was taken from.
    """
    ship_package(df.sparkSession)
    bitplane.check_planes(config.planes, config.form)
    if df.where("value is null or isnan(value)").limit(1).count():
        raise ValueError("a field can't hold null or NaN; mask such points")
    coef = cut(_coefficients(df, config))
    by = ["block", "var", "level"]
    bounds = encode.level_bounds(coef, by, "negabinary" in config.form)
    coded = encode.encoded(encode.dense(coef, by).join(bounds.select(*by, "exp"), by), config.planes, config.form)
    store.write_fragments(encode.fragments(coded, config.planes, config.form, config.policy, config.latter), path)
    manifest = bounds.select("block", "var", F.lit(list(config.dims)).cast("array<int>").alias("dims"), F.lit(config.levels).alias("levels"), F.lit(config.planes).alias("planes"), F.lit(config.form).alias("form"), F.lit(config.basis).alias("basis"), "level", "max_abs", "exp", "bound", "n")
    eb = F.lit(None).cast("double").alias("approximator_eb")
    store.write_manifest(manifest.select("*", eb) if base is None else manifest.join(base.select("block", "var", "approximator_eb"), ["block", "var"], "left"), path)
    coef.select(*by, "idx").join(bounds.select(*by, "n"), by).write.mode("overwrite").partitionBy("var", "level").parquet(f"{path}/places")
    return store.read_manifest(df.sparkSession, path)


class Session:
    """Progressive reading of one store. Each answer reads only planes that earlier ones haven't."""

    def __init__(self, spark: SparkSession, path: str, planner_name: str = "greedy_with_signs"):
        ship_package(spark)
        self.spark, self.path, self.planner = spark, path, planner.PLANNERS[planner_name]
        self.manifest = store.read_manifest(spark, path)
        head = self.manifest.select("planes", "form", "levels", "basis", "dims").first()
        if head is None:
            raise ValueError("an empty store")
        self.planes, self.form, self.levels, self.basis, self.dims = head["planes"], head["form"], head["levels"], head["basis"], list(head["dims"])
        self.plan: DataFrame | None = None
        self.codes: DataFrame | None = None

    def ladder(self) -> DataFrame:
        by = ["block", "var"]
        bounds = self.manifest.select(*by, "level", "bound")
        sizes = self.spark.read.parquet(f"{self.path}/fragments").select(*by, "level", "plane", "size")
        if self.basis == "orthogonal":
            axes = max(1, len(self.dims))
            return planner.ladder(bounds, sizes, by, lambda e, level: errors.orthogonal(e, axes))
        return planner.ladder(bounds, sizes, by)

    def plan_for(self, tau: float, most: int | None = None) -> DataFrame:
        """(block, var, level, planes, bytes): what an error under tau takes, beyond what was read before."""
        rows = self.ladder() if most is None else planner.cap_levels(self.ladder(), most)
        return cut(self.planner(rows, tau, ["block", "var"], self.plan))

    def coefficients(self, tau: float, most: int | None = None) -> DataFrame:
        plan = self.plan_for(tau, most)
        new = store.read_fragments(self.spark, self.path, plan, self.plan)
        self.plan = plan
        # codes so far are kept in the shared folder, and new planes' bits added to them
        self.codes = got = cut(encode.unpack(new, self.planes, self.form, self.codes))
        keys = ["block", "var", "level"]
        exps = self.manifest.select(*keys, "exp")
        value = bitplane.decode(F.col("code"), F.col("sign"), F.col("exp"), self.planes, F.col("taken"), self.form)
        decoded = got.join(exps, keys).select(*keys, "pos", value.alias("value"))
        places = encode.dense(self.spark.read.parquet(f"{self.path}/places"), keys)
        return places.join(decoded, [*keys, "pos"], "left").select(*keys, "idx", F.coalesce("value", F.lit(0.0)).alias("value"))

    def reconstruct(self, tau: float, most: int | None = None) -> DataFrame:
        """(block, var, idx, value) on the full grid, every value within tau unless `most` forbids the levels for it."""
        coef = self.coefficients(tau, most)
        if self.dims:
            back = transform.transform_blocks(coef, self.dims, self.levels, self.basis, inverse=True, by=_FIELD)
        else:
            back = transform.recompose(transform.with_extent(coef, _FIELD), self.levels, by=_FIELD)
        return back.select("block", "var", "idx", "value")

    def estimate(self) -> DataFrame:
        """(block, var, estimate): the error bound of what has been read so far."""
        rows = self.ladder()
        if self.plan is None:
            return rows.select("block", "var", F.col("err0").alias("estimate")).distinct()
        left = rows.join(self.plan.select("block", "var", "level", "planes"), ["block", "var", "level"], "left")
        spent = F.sum(F.when(F.col("plane") < F.coalesce("planes", F.lit(0)), F.col("gain")).otherwise(0.0))
        return left.groupBy("block", "var").agg((F.first("err0") - spent).alias("estimate"))

    def retrieved(self) -> DataFrame:
        """(var, planes, bytes) read so far, over all blocks."""
        frags = self.spark.read.parquet(f"{self.path}/fragments").select("block", "var", "level", "plane", "size")
        if self.plan is None:
            return frags.groupBy("var").agg(F.lit(0).cast("bigint").alias("planes"), F.lit(0).cast("bigint").alias("bytes"))
        held = frags.join(self.plan.select("block", "var", "level", "planes"), ["block", "var", "level"]).where("plane < planes")
        return held.groupBy("var").agg(F.count("*").alias("planes"), F.sum("size").alias("bytes"))


def refactor_precision(df: DataFrame, path: str, config: Config, share: float = approx.BASE_SHARE) -> DataFrame:
    """An approximation within a share of the range, and planes of what it leaves as one level."""
    based = cut(approx.based_residual(df, ["block", "var"], share))
    based.select("block", "var", "idx", "base", "bound0").write.mode("overwrite").partitionBy("var").parquet(f"{path}/base")
    held = based.groupBy("block", "var").agg(F.max("bound0").alias("approximator_eb"))
    return refactor(based.select("block", "var", "idx", F.col("residual").alias("value")), path, Config(0, config.planes, config.form, "hierarchical", config.policy, config.latter), held)


def refactor_deltas(df: DataFrame, path: str, segments: int, dims: tuple[int, ...] = ()) -> DataFrame:
    """Residual segments of (block, var, idx, value), partitioned by variable and segment, and a manifest of ranges and sizes."""
    rows = approx.refactor_deltas(df, ["block", "var", "idx"], ["block", "var"], segments)
    rows.write.mode("overwrite").partitionBy("var", "segment").parquet(f"{path}/segments")
    held = df.groupBy("block", "var").agg((F.max("value") - F.min("value")).alias("value_range"), F.count("*").alias("n"))
    sizes = F.array(*(F.ceil(F.col("n") * approx.segment_bits(i) / 8).cast("bigint") for i in range(segments)))
    store.write_manifest(held.select("block", "var", F.lit(list(dims)).cast("array<int>").alias("dims"), "value_range", F.lit(segments).alias("num_segments"), F.when(F.col("value_range") > 0, sizes).otherwise(F.array_repeat(F.lit(0).cast("bigint"), segments)).alias("segment_sizes"), "n"), path)
    return store.read_manifest(df.sparkSession, path)


def reconstruct_deltas(spark: SparkSession, path: str, tau: float) -> DataFrame:
    """(block, var, idx, value) within tau: segments that a variable doesn't need are not read."""
    manifest = store.read_manifest(spark, path)
    most = manifest.agg(F.max("num_segments")).first()[0]
    need = manifest.select("block", "var", approx.segments_needed(F.col("value_range"), F.lit(tau), most).alias("need"))
    tops = {r["var"]: r["need"] for r in need.groupBy("var").agg(F.max("need").alias("need")).collect()}  # a row for each variable
    keep = F.lit(False)
    for var, top in tops.items():
        keep |= (F.col("var") == var) & (F.col("segment") < max(top, 1))
    rows = spark.read.parquet(f"{path}/segments").where(keep)
    return approx.reconstruct_deltas(rows, ["block", "var", "idx"], tau, most)


def reconstruct_precision(session: Session, tau: float) -> DataFrame:
    """The approximation, once, plus the planes that tau takes."""
    base = session.spark.read.parquet(f"{session.path}/base").select("block", "var", "idx", "base")
    got = session.coefficients(tau).select("block", "var", "idx", "value")
    return base.join(got, ["block", "var", "idx"], "left").select("block", "var", "idx", (F.col("base") + F.coalesce("value", F.lit(0.0))).alias("value"))


#: The reference data sets' settings: variables, levels, planes, axes, whether points without velocity are masked.
PROFILES = {
    "engine": {"vars": ["VelocityX", "VelocityY", "VelocityZ", "Pressure", "Density"], "levels": 8, "planes": 60, "axes": 1, "masked": ["VelocityX", "VelocityY", "VelocityZ"]},
    "combustion": {"vars": ["H2", "O2", "H2O", "H", "O", "OH"], "levels": 4, "planes": 60, "axes": 3, "masked": []},
    "velocity": {"vars": ["velocity_x", "velocity_y", "velocity_z"], "levels": 4, "planes": 60, "axes": 1, "masked": ["velocity_x", "velocity_y", "velocity_z"]},
    "velocity_box": {"vars": ["velocity_x", "velocity_y", "velocity_z"], "levels": 4, "planes": 60, "axes": 3, "masked": []},
}


def refactor_profile(df: DataFrame, path: str, profile: str, dims: tuple[int, ...] = ()) -> DataFrame:
    """A profile's variables, columns of (block, idx, ...); points without velocity are left out of the masked ones."""
    from strataflow.operators.fields import compact, to_long, valid

    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}; there are {', '.join(PROFILES)}")
    p = PROFILES[profile]
    rest = [v for v in p["vars"] if v not in p["masked"]]
    parts = []
    if p["masked"]:
        kept = compact(df, valid(*(F.col(v) for v in p["masked"][:3])), ["block"], ["idx"])
        parts.append(to_long(kept.drop("idx").withColumnRenamed("pos", "idx"), ["block", "idx"], p["masked"]))
    if rest:
        parts.append(to_long(df, ["block", "idx"], rest))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    config = Config(p["levels"], p["planes"], "perbit", "hierarchical", "adaptive", 64, dims if p["axes"] == 3 else ())
    return refactor(long, path, config)
