"""The engine's queries over the test tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import bitplane, errors, qoi
from strataflow.operators import approx, encode, fields, trajectory, transform
from strataflow.plans import control, planner, refactor
from strataflow.session import materialise, read_table, shared_path, ship_package
from strataflow.sources import store
from strataflow.streaming import steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLOCK, LEVELS, PLANES = 4096, 4, 32


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- inputs, and the same as SQL ----


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("event_id").alias("idx"), "value")


def orders(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(F.floor(key / BLOCK).cast("bigint").alias("block"), (key % BLOCK).alias("idx"), F.col("o_totalprice").alias("value"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))


def velocity(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), *(e[i].cast("double").alias(v) for i, v in enumerate(("vx", "vy", "vz"))))


def gas(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("vx"), F.col("l_tax").alias("vy"), F.lit(0.01).alias("vz"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("d"))


def atoms(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    triples = F.array(*(F.struct(F.lit(a).cast("bigint").alias("atom"), e[3 * a].cast("double").alias("x"), e[3 * a + 1].cast("double").alias("y"), e[3 * a + 2].cast("double").alias("z")) for a in range(21)))
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.explode(triples).alias("t")).select("frame", "t.*")


def coded_events(spark: SparkSession, d: str, form: str) -> DataFrame:
    """Events as one level; every element has the level's exponent."""
    rows = encode.with_exponent(events(spark, d).withColumn("level", F.lit(0)), ["level"])
    return encode.encoded(rows, PLANES, form)


def _exp(x: str) -> str:
    return f"CAST(CASE WHEN {x} = 0 THEN 0 WHEN {x} >= pow(2.0, floor(log2({x})) + 1) THEN floor(log2({x})) + 2 WHEN {x} < pow(2.0, floor(log2({x}))) THEN floor(log2({x})) ELSE floor(log2({x})) + 1 END AS INTEGER)"


_EV = f"""WITH ev AS (SELECT event_id AS idx, value FROM events), ex AS (SELECT {_exp('m')} AS e FROM (SELECT max(abs(value)) AS m FROM ev))"""
_PB = _EV + f""", c AS (SELECT idx, value, e, value < 0 AS sign, abs(CAST(trunc(value * pow(2.0, {PLANES} - e)) AS BIGINT)) AS code FROM ev, ex)"""
_NEG = bitplane.ALTERNATE


def _nb(shift: int, scale: int) -> str:
    return _EV + f""", f AS (SELECT idx, value, e, CAST(trunc(value * {scale} * pow(2.0, {PLANES} - e - {shift})) AS BIGINT) AS fix FROM ev, ex), c AS (SELECT idx, value, e, xor(fix + {_NEG}, {_NEG}) AS code FROM f)"""


def _unnb(code: str) -> str:
    return f"(xor({code}, {_NEG}) - {_NEG})"


_ORD = f"""WITH o AS (SELECT CAST(o_orderkey // {BLOCK} AS BIGINT) AS block, o_orderkey % {BLOCK} AS idx, o_totalprice AS value FROM orders),
 s AS (SELECT block, max(idx) + 1 AS n FROM o GROUP BY block),
 l AS (SELECT o.*, n, (idx & -idx) AS tz, CAST(CASE WHEN idx = 0 OR idx = n - 1 OR (idx & -idx) >= {1 << LEVELS} THEN 0 ELSE {LEVELS} - CAST(log2(idx & -idx) AS INTEGER) END AS INTEGER) AS level FROM o JOIN s USING (block)),
 k AS (SELECT l.block, l.idx, l.level, CASE WHEN l.level = 0 THEN l.value ELSE l.value - (a.value + b.value) / 2 END AS value
   FROM l LEFT JOIN o a ON a.block = l.block AND a.idx = l.idx - l.tz LEFT JOIN o b ON b.block = l.block AND b.idx = least(l.idx + l.tz, l.n - 1))"""
_BND = _ORD + f""", b AS (SELECT block, level, m AS max_abs, {_exp('m')} AS e, n FROM (SELECT block, level, max(abs(value)) AS m, count(*) AS n FROM k GROUP BY block, level))"""


# ---- the flagship: one field, read to an error ----


@query(_PB + """, t AS (SELECT CAST(greatest(0, ceil(0.0)) AS INTEGER) AS z, (SELECT min(b) FROM range(0, 33) r(b), ex WHERE (CASE WHEN b = 0 THEN (SELECT max(abs(value)) FROM ev) ELSE pow(2.0, e - b) END) < 0.5) AS b)
 SELECT idx, value AS original, dec AS decoded, abs(value - dec) AS abs_err, pow(2.0, e - b) AS bound FROM (
 SELECT idx, value, e, b, (CASE WHEN sign THEN -1 ELSE 1 END) * CAST((code >> CAST(32 - b AS INTEGER)) << CAST(32 - b AS INTEGER) AS DOUBLE) * pow(2.0, e - 32) AS dec FROM c, t)""")
def decode_within(spark: SparkSession, d: str) -> DataFrame:
    """Events read to an error under 0.5: the plan's planes, and each value's error against its bound."""
    coded = coded_events(spark, d, "perbit")
    bounds = encode.level_bounds(coded, ["level"]).withColumn("block", F.lit(0))
    sizes = bounds.select("block", "level", F.explode(F.sequence(F.lit(0), F.lit(PLANES - 1))).alias("plane"), (F.ceil(F.col("n") / 64) * 8).alias("size"))
    plan = planner.in_order(planner.ladder(bounds, sizes, ["block"]), 0.5, ["block"])
    rows = coded.join(F.broadcast(plan.select("level", "planes")), "level")  # a row for each level
    got = rows.withColumn("decoded", bitplane.decode(F.col("code"), F.col("sign"), F.col("exp"), PLANES, F.col("planes")))
    return got.select("idx", F.col("value").alias("original"), "decoded", F.abs(F.col("value") - F.col("decoded")).alias("abs_err"), errors.ladder(F.col("max_abs"), F.col("planes")).alias("bound"))


# ---- fields ----


@query("SELECT (l_discount * l_discount + l_tax * l_tax + 0.0 * 0.0) <> 0 AS valid, count(*) AS n FROM lineitem GROUP BY 1")
def mask_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem")
    return rows.groupBy(fields.valid(F.col("l_discount"), F.col("l_tax"), F.lit(0.0)).alias("valid")).agg(F.count("*").alias("n"))


_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_discount, l_tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(_LI)}) - 1 AS pos FROM lineitem WHERE l_discount * l_discount + l_tax * l_tax <> 0")
def mask_compact(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem")
    return fields.compact(rows, fields.valid(F.col("l_discount"), F.col("l_tax"), F.lit(0.0)), ["l_suppkey"], _LI).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", "pos")


@query("SELECT event_id AS idx, CASE WHEN event_type = 'purchase' OR event_id % 7 <> 0 THEN value ELSE 0.0 END AS value FROM events")
def mask_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").withColumnRenamed("event_id", "idx")
    kept = rows.where("event_type = 'purchase' or idx % 7 <> 0")
    return fields.expand(rows.select("idx"), kept, ["idx"], ["value"])


@query("SELECT vec_id AS idx, unnest(['vx', 'vy', 'vz']) AS var, unnest([CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)]) AS value FROM embeddings")
def variables_long(spark: SparkSession, d: str) -> DataFrame:
    return fields.to_long(velocity(spark, d), ["idx"], ["vx", "vy", "vz"])


@query("SELECT vec_id AS frame, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings")
def axes_to_columns(spark: SparkSession, d: str) -> DataFrame:
    long = fields.to_long(velocity(spark, d).toDF("frame", "x", "y", "z"), ["frame"], ["x", "y", "z"])
    return fields.axes_to_columns(long.withColumnRenamed("var", "axis"), ["frame"])


@query("SELECT vec_id AS frame FROM embeddings WHERE vec_id >= 3 AND (vec_id - 3) % 4 = 0")
def frame_subset(spark: SparkSession, d: str) -> DataFrame:
    return fields.frames(read_table(spark, d, "embeddings").select(F.col("vec_id").alias("frame")), 3, 4)


@query("SELECT l_returnflag, min(l_extendedprice) AS low, max(l_extendedprice) AS high, max(l_extendedprice) - min(l_extendedprice) AS range, max(abs(l_extendedprice)) AS max_abs, count(l_extendedprice) AS n FROM lineitem GROUP BY 1")
def value_range(spark: SparkSession, d: str) -> DataFrame:
    return fields.value_range(read_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("SELECT block, n, CAST(coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM (SELECT CAST(o_orderkey // 1000 AS BIGINT) AS block, count(*) AS n FROM orders GROUP BY 1)")
def block_offsets(spark: SparkSession, d: str) -> DataFrame:
    sizes = read_table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).cast("bigint").alias("block")).agg(F.count("*").alias("n"))
    return fields.offsets(sizes, "block", "n")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM events GROUP BY 1")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    out = fields.summary(read_table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("SELECT event_id AS idx, value - floor(value) AS value FROM events")
def field_difference(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d)
    return fields.subtract(v, v.select("idx", F.floor("value").cast("double").alias("value")), ["idx"])


@query("SELECT event_id AS idx, value + floor(value) AS value FROM events")
def field_accumulate(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d)
    return fields.accumulate([v, v.select("idx", F.floor("value").cast("double").alias("value"))], ["idx"])


@query("SELECT event_id AS idx, value AS a, -value AS b FROM events")
def field_zip(spark: SparkSession, d: str) -> DataFrame:
    v = events(spark, d)
    return fields.zip_fields(v.withColumnRenamed("value", "a"), v.select("idx", (-F.col("value")).alias("b")), ["idx"])


# ---- levels and transform ----

_SIZES = ["CAST(count(*) AS BIGINT)"]
for _ in range(LEVELS):
    _SIZES.append(f"({_SIZES[-1]} // 2 + 1)")


@query("WITH s AS (SELECT " + ", ".join(f"{x} AS s{i}" for i, x in enumerate(_SIZES)) + f" FROM part) SELECT CAST(0 AS INTEGER) AS level, s{LEVELS} AS n FROM s" + "".join(f" UNION ALL SELECT {LEVELS - i}, s{i} - s{i + 1} FROM s" for i in range(LEVELS)))
def level_elements(spark: SparkSession, d: str) -> DataFrame:
    """Counted, which must be what the extents say."""
    rows = transform.with_extent(parts(spark, d).withColumn("block", F.lit(0)))
    return transform.with_level(rows, LEVELS).groupBy("level").agg(F.count("*").alias("n"))


@query(_ORD + " SELECT block, idx, level FROM l")
def level_assign(spark: SparkSession, d: str) -> DataFrame:
    return transform.with_level(transform.with_extent(orders(spark, d)), LEVELS).select("block", "idx", "level")


@query("""WITH g AS (SELECT i, j, k FROM range(0, 9) a(i), range(0, 10) b(j), range(0, 17) c(k)),
 a AS (SELECT *, CASE WHEN i = 0 OR i = 8 OR i & -i >= 4 THEN 0 ELSE 2 - CAST(log2(i & -i) AS INTEGER) END AS li, CASE WHEN j = 0 OR j = 9 OR j & -j >= 4 THEN 0 ELSE 2 - CAST(log2(j & -j) AS INTEGER) END AS lj, CASE WHEN k = 0 OR k = 16 OR k & -k >= 4 THEN 0 ELSE 2 - CAST(log2(k & -k) AS INTEGER) END AS lk FROM g)
 SELECT CAST(greatest(li, lj, lk) AS INTEGER) AS level, count(*) AS n FROM a GROUP BY 1""")
def level_assign_box(spark: SparkSession, d: str) -> DataFrame:
    from strataflow.functions.grid import level_of_3d, unflatten

    i, j, k = unflatten(F.col("id"), [9, 10, 17])
    return spark.range(9 * 10 * 17).groupBy(level_of_3d(i, j, k, (9, 10, 17), 2).alias("level")).agg(F.count("*").alias("n"))


@query(_ORD + " SELECT block, idx, level, value FROM k")
def hier_decompose(spark: SparkSession, d: str) -> DataFrame:
    return transform.decompose(orders(spark, d), LEVELS).select("block", "idx", "level", "value")


@query(_ORD + f" SELECT l.block, l.idx, l.level, round(CASE WHEN l.level = {LEVELS} THEN l.value + k.value ELSE l.value END, 4) AS value FROM l JOIN k USING (block, idx)")
def hier_recompose(spark: SparkSession, d: str) -> DataFrame:
    """Back from coefficients of which the finest are doubled: the values, and there what the coefficient adds."""
    there = transform.decompose(orders(spark, d), LEVELS)
    twice = there.withColumn("value", F.col("value") * F.when(F.col("level") == LEVELS, 2.0).otherwise(1.0))
    back = transform.recompose(twice, LEVELS)
    return back.select("block", "idx", "level", F.round("value", 4).alias("value"))


@query(_ORD + f""" SELECT block, idx, CASE WHEN level <= 1 THEN value ELSE 0.0 END AS value FROM k""")
def zero_beyond(spark: SparkSession, d: str) -> DataFrame:
    return transform.zero_beyond(transform.decompose(orders(spark, d), LEVELS), 1).select("block", "idx", "value")


@query(_ORD + f""", u AS (SELECT l.block, l.idx, l.level, l.value, a.value AS va, b.value AS vb FROM l LEFT JOIN l a ON a.block = l.block AND a.idx = l.idx - l.tz AND a.level < {LEVELS} LEFT JOIN l b ON b.block = l.block AND b.idx = least(l.idx + l.tz, l.n - 1))
 SELECT block, idx, round(CASE WHEN level < {LEVELS} THEN value ELSE (va + vb) / 2 END, 4) AS value FROM u""")
def upsample(spark: SparkSession, d: str) -> DataFrame:
    """The full grid from all levels but the finest."""
    return transform.upsample(transform.decompose(orders(spark, d), LEVELS), LEVELS, LEVELS - 1).select("block", "idx", F.round("value", 4).alias("value"))


@query(_ORD + " SELECT block, idx, level, row_number() OVER (PARTITION BY block, level ORDER BY idx) - 1 AS pos FROM l")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    return transform.interleave(transform.decompose(orders(spark, d), LEVELS)).select("block", "idx", "level", "pos")


@query(_BND + " SELECT block, level, max_abs, e AS exp, max_abs * 4 AS bound, n FROM b")
def level_bounds(spark: SparkSession, d: str) -> DataFrame:
    return encode.level_bounds(transform.decompose(orders(spark, d), LEVELS), ["block", "level"], negabinary=True)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.floor(F.col("idx") / 125).cast("bigint").alias("block"), (F.col("idx") % 125).alias("idx"), "value")


def _near(c: str) -> str:
    return f"(b.{c} % 2 = 0 AND o.{c} = b.{c} OR b.{c} % 2 = 1 AND abs(o.{c} - b.{c}) = 1)"


@query(f"""WITH b AS (SELECT CAST(event_id // 125 AS BIGINT) AS block, event_id % 125 AS idx, value, (event_id % 125) // 25 AS i, (event_id % 25) // 5 AS j, event_id % 5 AS k FROM events),
 w AS (SELECT b.block, b.idx, coalesce(sum(o.value), 0.0) / pow(2, any_value(b.i % 2 + b.j % 2 + b.k % 2)) AS mean FROM b LEFT JOIN b o ON b.block = o.block AND {_near('i')} AND {_near('j')} AND {_near('k')} GROUP BY 1, 2)
 SELECT block, idx, round(CASE WHEN i % 2 + j % 2 + k % 2 = 0 THEN value ELSE value - mean END, 8) AS coefficient, round(value, 4) AS value FROM b JOIN w USING (block, idx)""")
def box_transform(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of 5 x 5 x 5 in the hierarchical basis: coefficients, and the values back from them."""
    there = transform.transform_blocks(_boxes(spark, d), [5, 5, 5], 1)
    back = transform.transform_blocks(there, [5, 5, 5], 1, inverse=True)
    both = there.select("block", "idx", F.round("value", 8).alias("coefficient"))
    return both.join(back.select("block", "idx", F.round("value", 4).alias("value")), ["block", "idx"])


_LINE = "".join(f", coalesce(max(value) FILTER (event_id % 5 = {i}), 0.0) AS v{i}" for i in range(5))


@query(f"""WITH p AS (SELECT CAST(event_id // 5 AS BIGINT) AS block{_LINE} FROM events GROUP BY 1), c AS (SELECT *, v1 - (v0 + v2) / 2 AS c1, v3 - (v2 + v4) / 2 AS c3 FROM p),
 o AS (SELECT block, [v0 + 0.5 * (7 * c1 / 4 - 2 * (c1 + c3) / 4 + c3 / 4), c1, v2 + 0.5 * (4 * (c1 + c3) / 4 - 2 * c1 / 4 - 2 * c3 / 4), c3, v4 + 0.5 * (c1 / 4 - 2 * (c1 + c3) / 4 + 7 * c3 / 4)] AS x FROM c)
 SELECT block, event_id % 5 AS idx, round(x[event_id % 5 + 1], 8) AS coefficient, round(value, 4) AS value FROM events JOIN o ON block = event_id // 5""")
def orthogonal_transform(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 5 in the orthogonal basis: coefficients, and the values back from them."""
    field = events(spark, d).select(F.floor(F.col("idx") / 5).cast("bigint").alias("block"), (F.col("idx") % 5).alias("idx"), "value")
    there = transform.transform_blocks(field, [5], 1, "orthogonal")
    back = transform.transform_blocks(there, [5], 1, "orthogonal", inverse=True)
    both = there.select("block", "idx", F.round("value", 8).alias("coefficient"))
    return both.join(back.select("block", "idx", F.round("value", 4).alias("value")), ["block", "idx"])


@query("SELECT CAST(event_id // 125 AS BIGINT) AS block, event_id % 125 AS idx, round(value, 4) AS value FROM events")
def orthogonal_there_and_back(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 125 on five levels in the orthogonal basis, there and back."""
    there = transform.transform_blocks(_boxes(spark, d), [125], 4, "orthogonal")
    return transform.transform_blocks(there, [125], 4, "orthogonal", inverse=True).select("block", "idx", F.round("value", 4).alias("value"))


# ---- bitplanes ----


@query(_EV + f" SELECT idx, CAST(trunc(value * pow(2.0, {PLANES} - e)) AS BIGINT) AS fix FROM ev, ex")
def fixed_point(spark: SparkSession, d: str) -> DataFrame:
    rows = coded_events(spark, d, "perbit")
    return rows.select("idx", bitplane.fixed_point(F.col("value"), F.col("exp"), PLANES).alias("fix"))


@query(_nb(2, 1) + " SELECT idx, code FROM c")
def negabinary(spark: SparkSession, d: str) -> DataFrame:
    return coded_events(spark, d, "negabinary").select("idx", "code")


def _decoded(form: str, taken: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: encode.decoded(coded_events(spark, d, form), PLANES, taken, form).select("idx", "decoded")


def _nb_decoded(shift: int, scale: int, taken: int) -> str:
    cut = f"((code >> {PLANES - taken}) << {PLANES - taken})"
    return _nb(shift, scale) + f" SELECT idx, CAST({_unnb(cut)} AS DOUBLE) * pow(2.0, e + {shift} - {PLANES}) / {scale} AS decoded FROM c"


def _pb_value(taken: int) -> str:
    return f"(CASE WHEN sign THEN -1 ELSE 1 END) * CAST((code >> {PLANES - taken}) << {PLANES - taken} AS DOUBLE) * pow(2.0, e - {PLANES})"


for _name, _form, _taken, _sql in (
    ("negabinary_decode", "negabinary", 12, _nb_decoded(2, 1, 12)),
    ("negabinary_decode_full", "negabinary", PLANES, _nb_decoded(2, 1, PLANES)),
    ("perbit_decode", "perbit", 10, _PB + f" SELECT idx, {_pb_value(10)} AS decoded FROM c"),
    ("perbit_decode_full", "perbit", PLANES, _PB + f" SELECT idx, {_pb_value(PLANES)} AS decoded FROM c"),
    ("grouped_decode", "grouped", 20, _PB + f" SELECT idx, {_pb_value(20)} AS decoded FROM c"),
    ("weighted_negabinary_decode", "weighted_negabinary", 14, _nb_decoded(3, 2, 14)),
):
    QUERIES[_name], ORACLES[_name] = _decoded(_form, _taken), _sql


@query(_EV + f""", w AS (SELECT idx, value, e, idx % 3 AS w FROM ev, ex), c AS (SELECT idx, value < 0 AS sign, e, w, abs(CAST(trunc(value * pow(2.0, 24 - e + w)) AS BIGINT)) AS code FROM w)
 SELECT idx, (CASE WHEN sign THEN -1 ELSE 1 END) * CAST((code >> 10) << 10 AS DOUBLE) * pow(2.0, e - 24 - w) AS decoded FROM c""")
def weighted_perbit_decode(spark: SparkSession, d: str) -> DataFrame:
    """24 planes and up to 2 of weight; the first 16 of all 26."""
    rows = encode.with_exponent(events(spark, d).withColumn("level", F.lit(0)), ["level"]).withColumn("w", (F.col("idx") % 3).cast("int"))
    code, sign = bitplane.weighted_encode(F.col("value"), F.col("exp"), 24, F.col("w"))
    return rows.withColumns({"code": code, "sign": sign}).select("idx", bitplane.weighted_decode(F.col("code"), F.col("sign"), F.col("exp"), 24, F.col("w"), 2, 16).alias("decoded"))


@query(_nb(2, 1) + f" SELECT CAST(p AS INTEGER) AS plane, CAST(sum((code >> CAST({PLANES - 1} - p AS INTEGER)) & 1) AS BIGINT) AS ones FROM c, range(0, {PLANES}) r(p) GROUP BY p")
def bitplane_counts(spark: SparkSession, d: str) -> DataFrame:
    return encode.ones_by_plane(coded_events(spark, d, "negabinary"), ["level"], PLANES).select("plane", "ones")


_FIRST = f"CASE WHEN code = 0 THEN {PLANES} ELSE {PLANES} - length(bin(code)) END"


@query(_PB + f" SELECT CAST(p AS INTEGER) AS plane, count(*) + count(*) FILTER (({_FIRST}) = p) AS bits, CAST(ceil((count(*) + count(*) FILTER (({_FIRST}) = p)) / 64) * 8 AS BIGINT) AS bytes FROM c, range(0, {PLANES}) r(p) GROUP BY p")
def perbit_plane_sizes(spark: SparkSession, d: str) -> DataFrame:
    return encode.perbit_sizes(coded_events(spark, d, "perbit"), ["level"], PLANES).select("plane", "bits", "bytes")


@query(_PB + f" SELECT CAST(idx // 32 AS BIGINT) AS grp, CAST(p AS INTEGER) AS plane, CAST(bit_or(((code >> CAST({PLANES - 1} - p AS INTEGER)) & 1) << CAST(idx % 32 AS INTEGER)) AS BIGINT) AS word_bits FROM c, range(0, {PLANES}) r(p) GROUP BY ALL")
def grouped_words(spark: SparkSession, d: str) -> DataFrame:
    return encode.group_words(coded_events(spark, d, "grouped").withColumn("pos", F.col("idx")), ["level"], PLANES).select("grp", "plane", "word_bits")


@query(_PB + f" SELECT CAST(idx // 32 AS BIGINT) AS grp, CAST(min({_FIRST}) AS INTEGER) AS start, CAST(bit_or(CAST(sign AS BIGINT) << CAST(idx % 32 AS INTEGER)) AS BIGINT) AS signs FROM c GROUP BY 1")
def grouped_start_plane(spark: SparkSession, d: str) -> DataFrame:
    return encode.group_starts(coded_events(spark, d, "grouped").withColumn("pos", F.col("idx")), ["level"], PLANES).select("grp", "start", "signs")


@query(f"""WITH ev AS (SELECT p_partkey AS idx, p_retailprice AS value FROM part), ex AS (SELECT {_exp('m')} AS e FROM (SELECT max(abs(value)) AS m FROM ev)), c AS (SELECT idx, abs(CAST(trunc(value * pow(2.0, 16 - e)) AS BIGINT)) AS code FROM ev, ex)
 SELECT idx, CAST(p AS INTEGER) AS plane, CAST((code >> CAST(15 - p AS INTEGER)) & 1 AS INTEGER) AS bit FROM c, range(0, 16) r(p)""")
def plane_bits(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.encoded(encode.with_exponent(parts(spark, d).withColumn("level", F.lit(0)), ["level"]), 16)
    return encode.plane_bits(rows, ["idx"], 16)


@query(_PB + f" SELECT idx, {_pb_value(16)} - {_pb_value(8)} AS delta FROM c")
def progressive_delta(spark: SparkSession, d: str) -> DataFrame:
    """What planes 8 to 15 add."""
    rows = coded_events(spark, d, "perbit")
    return rows.select("idx", bitplane.delta(F.col("code"), F.col("sign"), F.col("exp"), PLANES, 8, 16).alias("delta"))


_PB_ANY = f"(CASE WHEN sign THEN -1 ELSE 1 END) * CAST((code >> CAST({PLANES} - b AS INTEGER)) << CAST({PLANES} - b AS INTEGER) AS DOUBLE) * pow(2.0, e - {PLANES})"


@query(_PB + f" SELECT CAST(b AS INTEGER) AS taken, max(abs(value - {_PB_ANY})) AS max_error FROM c, range(0, {PLANES + 1}) r(b) GROUP BY b")
def max_error_by_plane(spark: SparkSession, d: str) -> DataFrame:
    return encode.largest_errors(coded_events(spark, d, "perbit"), ["level"], PLANES).select("taken", "max_error")


@query(_PB + f" SELECT CAST(b AS INTEGER) AS taken, round(sum((value - {_PB_ANY}) * (value - {_PB_ANY})), 2) AS squared_error FROM c, range(0, {PLANES + 1}) r(b) GROUP BY b")
def squared_error_by_plane(spark: SparkSession, d: str) -> DataFrame:
    out = encode.squared_errors(coded_events(spark, d, "perbit"), ["level"], PLANES)
    return out.select("taken", F.round("squared_error", 2).alias("squared_error"))


_NB_ANY = f"CAST({_unnb('((code >> CAST(32 - b AS INTEGER)) << CAST(32 - b AS INTEGER))')} AS DOUBLE) * pow(2.0, e + 2 - {PLANES})"


@query(_nb(2, 1) + f" SELECT CAST(b AS INTEGER) AS taken, round(sum((value - {_NB_ANY}) * (value - {_NB_ANY})), 3) AS squared_error FROM c, range(0, {PLANES + 1}) r(b) GROUP BY b")
def squared_error_negabinary(spark: SparkSession, d: str) -> DataFrame:
    out = encode.squared_errors(coded_events(spark, d, "negabinary"), ["level"], PLANES, "negabinary")
    return out.select("taken", F.round("squared_error", 3).alias("squared_error"))


@query(_PB + f" SELECT CAST(idx // 32 AS BIGINT) AS grp, CAST(b AS INTEGER) AS taken, round(sum((value - {_PB_ANY}) * (value - {_PB_ANY})), 7) AS squared_error FROM c, range(0, {PLANES + 1}) r(b) GROUP BY 1, 2")
def squared_error_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Of each group of 32 elements."""
    rows = coded_events(spark, d, "grouped").withColumn("grp", F.floor(F.col("idx") / 32).cast("bigint"))
    return encode.squared_errors(rows, ["grp"], PLANES, "grouped").select("grp", "taken", F.round("squared_error", 7).alias("squared_error"))


def _packed(spark: SparkSession, d: str, form: str) -> DataFrame:
    """Events in blocks, coded with the whole field's exponent."""
    block = F.floor(F.col("idx") / BLOCK).cast("bigint")
    return coded_events(spark, d, form).select(block.alias("block"), F.lit("value").alias("var"), "level", (F.col("idx") % BLOCK).alias("pos"), "code", "sign", "exp")


def _from_codes(codes: DataFrame, packed: DataFrame, taken: int, form: str) -> DataFrame:
    exp = packed.select("block", "var", "level", "exp").distinct()
    value = bitplane.decode(F.col("code"), F.col("sign"), F.col("exp"), PLANES, taken, form)
    return codes.join(exp, ["block", "var", "level"]).select((F.col("block") * BLOCK + F.col("pos")).alias("idx"), value.alias("decoded"))


@query(_PB + f" SELECT idx, {_pb_value(20)} AS decoded FROM c")
def grouped_progressive(spark: SparkSession, d: str) -> DataFrame:
    """The grouped layout, packed and compressed; the first 7 planes, then 13 more on top of them."""
    ship_package(spark)
    packed = _packed(spark, d, "grouped")
    frags = materialise(encode.fragments(packed, PLANES, "grouped"), "grouped")
    first = encode.unpack(frags.where("plane < 7"), PLANES, "grouped")
    return _from_codes(encode.unpack(frags.where("plane >= 7 and plane < 20"), PLANES, "grouped", first), packed, 20, "grouped")


def _group_bytes() -> str:
    """A plane's bytes: a bit for each group not begun before, and a word for each that begins, and for each begun by then."""
    return f""", g AS (SELECT idx // {BLOCK} AS block, (idx % {BLOCK}) // 32 AS grp, min({_FIRST}) AS start FROM c GROUP BY 1, 2)
 SELECT CAST(block AS BIGINT) AS block, CAST(p AS INTEGER) AS plane, CAST(ceil(count(*) FILTER (start >= p) / 8) + 4 * count(*) FILTER (start = p) + 4 * count(*) FILTER (start <= p) AS BIGINT) AS raw_size FROM g, range(0, {PLANES}) r(p) GROUP BY 1, 2"""


@query(_PB + _group_bytes())
def grouped_plane_sizes(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return encode.fragments(_packed(spark, d, "grouped"), PLANES, "grouped", "none").select("block", "plane", "raw_size")


@query(_nb(3, 2) + f" SELECT idx, (CAST({_unnb('((code >> 16) << 16)')} AS DOUBLE) - CAST({_unnb('((code >> 26) << 26)')} AS DOUBLE)) * pow(2.0, e + 3 - {PLANES}) / 2 AS delta FROM c")
def weighted_delta(spark: SparkSession, d: str) -> DataFrame:
    """What planes 6 to 15 of the weighted form add."""
    rows = coded_events(spark, d, "weighted_negabinary")
    return rows.select("idx", bitplane.delta(F.col("code"), F.col("sign"), F.col("exp"), PLANES, 6, 16, "weighted_negabinary").alias("delta"))


# ---- errors and plans ----


def order_bounds(spark: SparkSession, d: str) -> DataFrame:
    return encode.level_bounds(transform.decompose(orders(spark, d), LEVELS), ["block", "level"])


def order_ladder(spark: SparkSession, d: str, **how: Callable[..., Column]) -> DataFrame:
    """Planes of uncompressed size, so that no codec decides the plan."""
    bounds = order_bounds(spark, d)
    sizes = bounds.select("block", "level", F.explode(F.sequence(F.lit(0), F.lit(PLANES - 1))).alias("plane"), (F.ceil(F.col("n") / 64) * 8).cast("bigint").alias("size"))
    return materialise(planner.ladder(bounds, sizes, ["block"], **how), "ladder")


_LADDER = "CASE WHEN max_abs = 0 THEN 0.0 WHEN {b} = 0 THEN max_abs ELSE pow(2.0, e - {b}) END"
_LAD = _BND + f""", g AS (SELECT block, level, CAST(p AS INTEGER) AS plane, CAST(ceil(n / 64) * 8 AS BIGINT) AS size, ({_LADDER.format(b='p')}) - ({_LADDER.format(b='(p + 1)')}) AS gain FROM b, range(0, {PLANES}) r(p)),
 t AS (SELECT block, sum(max_abs) AS err0 FROM b GROUP BY block), lad AS (SELECT g.*, err0 FROM g JOIN t USING (block))"""


@query(_BND + f" SELECT block, level, CAST(t AS INTEGER) AS taken, {_LADDER.format(b='t')} AS error FROM b, range(0, {PLANES + 1}) r(t)")
def error_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = order_bounds(spark, d).select("block", "level", "bound", F.explode(F.sequence(F.lit(0), F.lit(PLANES))).alias("taken"))
    return rows.select("block", "level", "taken", errors.ladder(F.col("bound"), F.col("taken")).alias("error"))


@query(_LAD + " SELECT block, level, plane, size, gain FROM lad")
def error_gain(spark: SparkSession, d: str) -> DataFrame:
    return order_ladder(spark, d).select("block", "level", "plane", "size", "gain")


_C1 = repr(errors.ORTHOGONAL[1])


@query(_BND + f" SELECT block, level, max_abs AS hierarchical, max_abs * {_C1}::DOUBLE AS orthogonal, pow(2.0, {LEVELS} - level) * max_abs * 2 AS l2, pow(2.0, {LEVELS} - level) * (max_abs - max_abs / 2) AS l2_gain, pow(2.0, level * 2.0 + ({LEVELS} - level)) * max_abs AS s_norm FROM b")
def error_estimates(spark: SparkSession, d: str) -> DataFrame:
    e, level = F.col("bound"), F.col("level")
    return order_bounds(spark, d).select("block", "level", errors.hierarchical(e).alias("hierarchical"), errors.orthogonal(e, 1).alias("orthogonal"), errors.squared_hierarchical(e, level, 1, LEVELS).alias("l2"), errors.squared_hierarchical_gain(e, e / 2, level, 1, LEVELS).alias("l2_gain"), errors.s_norm(e, level, 1, LEVELS, 1.0).alias("s_norm"))


def _plan_sql(order: str, tau: float, prepare: str = "", source: str = "lad") -> str:
    return _LAD + prepare + f""", o2 AS (SELECT *, err0 - coalesce(sum(gain) OVER (PARTITION BY block ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM {source}),
 k2 AS (SELECT block, level, count(*) AS n, sum(size) AS s FROM o2 WHERE rest >= {tau} GROUP BY block, level)
 SELECT block, level, CAST(coalesce(k2.n, 0) AS INTEGER) AS planes, CAST(coalesce(s, 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT block, level FROM lad) LEFT JOIN k2 USING (block, level)"""


_PM = ", q AS (SELECT *, min(gain / size) OVER (PARTITION BY block, level ORDER BY plane ROWS UNBOUNDED PRECEDING) AS pm FROM lad)"
_SIGNS = """, pl AS (SELECT block, level, err0, sum(gain) AS a FROM lad GROUP BY ALL), nd AS (SELECT * FROM (SELECT block, level, err0 - coalesce(sum(a) OVER (PARTITION BY block ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS short FROM pl) WHERE short >= {tau}),
 q1 AS (SELECT lad.* FROM lad SEMI JOIN nd USING (block, level)), q AS (SELECT *, CASE WHEN plane = 0 THEN 0 ELSE 1 END AS later, min(CASE WHEN plane > 0 THEN gain / size END) OVER (PARTITION BY block, level ORDER BY plane ROWS UNBOUNDED PRECEDING) AS pm FROM q1)"""


@query(_plan_sql("level, plane", 60.5))
def plan_inorder(spark: SparkSession, d: str) -> DataFrame:
    return planner.in_order(order_ladder(spark, d), 60.5, ["block"])


@query(_plan_sql("plane, level", 60.5))
def plan_roundrobin(spark: SparkSession, d: str) -> DataFrame:
    return planner.round_robin(order_ladder(spark, d), 60.5, ["block"])


@query(_plan_sql("pm DESC, level, plane", 60.5, _PM, "q"))
def plan_greedy(spark: SparkSession, d: str) -> DataFrame:
    return planner.greedy(order_ladder(spark, d), 60.5, ["block"])


@query(_plan_sql("later, pm DESC NULLS LAST, level, plane", 60.5, _SIGNS.format(tau=60.5), "q"))
def plan_greedy_signexcl(spark: SparkSession, d: str) -> DataFrame:
    return planner.greedy_with_signs(order_ladder(spark, d), 60.5, ["block"])


@query(_plan_sql("level, plane", 60.5, ", m AS (SELECT * FROM lad WHERE level <= 2)", "m").replace("(SELECT DISTINCT block, level FROM lad)", "(SELECT DISTINCT block, level FROM lad WHERE level <= 2)"))
def plan_maxlevel(spark: SparkSession, d: str) -> DataFrame:
    return planner.in_order(planner.cap_levels(order_ladder(spark, d), 2), 60.5, ["block"])


@query(_plan_sql("pm DESC, level, plane", 0.9, _PM, "q").replace("AS bytes FROM", "AS total FROM"))
def plan_resumed(spark: SparkSession, d: str) -> DataFrame:
    """First to 60.5, then on to 0.9: the planes of one greedy plan to 0.9; total, the bytes of both."""
    rows = order_ladder(spark, d)
    first = planner.greedy(rows, 60.5, ["block"])
    then = planner.greedy(rows, 0.9, ["block"], first)
    return then.join(first.select("block", "level", F.col("bytes").alias("before")), ["block", "level"]).select("block", "level", "planes", (F.col("bytes") + F.col("before")).alias("total"))


@query()
def plan_greedy_runs(spark: SparkSession, d: str) -> DataFrame:
    ship_package(spark)
    return planner.greedy_runs(order_ladder(spark, d), 60.5, ["block"])


def _reorg(order: str) -> str:
    return _LAD + f" SELECT block, level, plane, row_number() OVER w - 1 AS seq, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lad WINDOW w AS (PARTITION BY block ORDER BY {order})"


for _name, _how, _order in (("reorg_inorder", "in_order", "level, plane"), ("reorg_roundrobin", "round_robin", "plane, level")):
    QUERIES[_name] = lambda spark, d, how=_how: planner.reorganised(order_ladder(spark, d), ["block"], how).select("block", "level", "plane", F.col("seq").cast("bigint").alias("seq"), "start")
    ORACLES[_name] = _reorg(_order)


@query(_LAD + " SELECT block, level, plane, size, CAST(plane // CAST(ceil(1000 / size) AS INTEGER) AS INTEGER) AS bucket FROM lad")
def merge_small(spark: SparkSession, d: str) -> DataFrame:
    """Planes of a level are of one size here, so a bucket holds the same number of each."""
    return planner.merge_small(order_ladder(spark, d), ["block"], 1000)


# ---- approximations ----

_PT = "WITH pt AS (SELECT p_partkey AS idx, p_retailprice AS value FROM part), sp AS (SELECT max(value) - min(value) AS span FROM pt)"


@query(_PT + ", b AS (SELECT idx, value, span * 0.001::DOUBLE AS e FROM pt, sp) SELECT idx, CAST(floor(value / (e * 2) + 0.5) AS BIGINT) AS cell, floor(value / (e * 2) + 0.5) * (e * 2) AS base, value - floor(value / (e * 2) + 0.5) * (e * 2) AS residual FROM b")
def quantise_residual(spark: SparkSession, d: str) -> DataFrame:
    out = approx.based_residual(parts(spark, d), [])
    return out.select("idx", approx.quantise(F.col("value"), F.col("bound0")).alias("cell"), "base", "residual")


def _chain(segments: int) -> str:
    sql, prev = _PT + ", r0 AS (SELECT idx, span, value AS rest, CAST(0 AS DOUBLE) AS q FROM pt, sp)", "r0"
    for i in range(segments):
        cell = f"floor(rest / (e * 2) + 0.5) * (e * 2)"
        sql += f", e{i} AS (SELECT *, span / {float(10 ** (i + 1))!r}::DOUBLE AS e FROM {prev}), r{i + 1} AS (SELECT idx, span, {cell} AS q, rest - {cell} AS rest FROM e{i})"
        prev = f"r{i + 1}"
    return sql


@query(_chain(7) + " " + " UNION ALL ".join(f"SELECT idx, CAST({i} AS INTEGER) AS segment, q AS value FROM r{i + 1}" for i in range(7)))
def delta_segments(spark: SparkSession, d: str) -> DataFrame:
    return approx.refactor_deltas(parts(spark, d), ["idx"], [], approx.SEGMENTS["float"]).select("idx", "segment", "value")


@query(_chain(7) + ", need AS (SELECT (CASE WHEN span <= 0.5 THEN 0 " + " ".join(f"WHEN span / {float(10**k)!r}::DOUBLE <= 0.5 THEN {k}" for k in range(1, 7)) + " ELSE 7 END) AS k FROM sp) SELECT r1.idx, " + " + ".join(["0.0::DOUBLE", *(f"(CASE WHEN k > {i} THEN r{i + 1}.q ELSE 0 END)" for i in range(7))]) + " AS value FROM r1 " + " ".join(f"JOIN r{i + 1} ON r{i + 1}.idx = r1.idx" for i in range(1, 7)) + ", need")
def delta_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """The segments that an error of 0.5 takes, summed in order."""
    return approx.reconstruct_deltas(approx.refactor_deltas(parts(spark, d), ["idx"], [], 7), ["idx"], 0.5, 7)


@query(_PT + ", c AS (SELECT idx, value, CAST(i AS INTEGER) AS snapshot, span / (CASE i " + " ".join(f"WHEN {i} THEN {float(10 ** (i + 1))!r}::DOUBLE" for i in range(10)) + " END) AS e FROM pt, sp, range(0, 10) r(i)) SELECT idx, snapshot, floor(value / (e * 2) + 0.5) * (e * 2) AS value FROM c")
def snapshot_ladder(spark: SparkSession, d: str) -> DataFrame:
    return approx.snapshots(parts(spark, d), ["idx"], [], approx.RUNGS["parallel"])


@query(_chain(16) + " " + " UNION ALL ".join(f"SELECT idx, CAST({i} AS INTEGER) AS segment, q AS value FROM r{i + 1}" for i in range(16)))
def delta_segments_double(spark: SparkSession, d: str) -> DataFrame:
    return approx.refactor_deltas(parts(spark, d), ["idx"], [], approx.SEGMENTS["double"]).select("idx", "segment", "value")


@query(_PT + ", c AS (SELECT idx, value, CAST(i AS INTEGER) AS snapshot, span / (CASE i " + " ".join(f"WHEN {i} THEN {float(10 ** (i + 1))!r}::DOUBLE" for i in range(18)) + " END) AS e FROM pt, sp, range(0, 18) r(i)) SELECT idx, snapshot, CASE WHEN abs(value / (e * 2)) < pow(2.0, 53) THEN floor(value / (e * 2) + 0.5) * (e * 2) ELSE value END AS value FROM c")
def snapshot_ladder_serial(spark: SparkSession, d: str) -> DataFrame:
    return approx.snapshots(parts(spark, d), ["idx"], [], approx.RUNGS["serial"])


@query("SELECT p_partkey AS idx, 0.0::DOUBLE AS base, p_retailprice AS residual FROM part")
def approximate_by_nothing(spark: SparkSession, d: str) -> DataFrame:
    base = approx.nothing(F.col("value"))
    return parts(spark, d).select("idx", base.alias("base"), (F.col("value") - base).alias("residual"))


@query(f"WITH o AS (SELECT CAST(o_orderkey // {BLOCK} AS BIGINT) AS block, o_orderkey % {BLOCK} AS idx, CAST(floor(o_totalprice / (0.5::DOUBLE * 2) + 0.5) AS BIGINT) AS cell FROM orders) SELECT block, idx, CAST(cell - coalesce(lag(cell) OVER (PARTITION BY block ORDER BY idx), 0) AS BIGINT) AS code, cell * 1.0::DOUBLE AS base FROM o")
def predicted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cells' differences along lines, and the approximation back from them."""
    coded = approx.predict_lines(orders(spark, d).withColumn("bound0", F.lit(0.5)), ["block"])
    return approx.unpredict_lines(coded.select("block", "idx", "code", "bound0"), ["block"]).select("block", "idx", "code", "base")


_DIFF = lambda c, of, rest: f"CAST({of} - coalesce(lag({of}) OVER (PARTITION BY block, {rest} ORDER BY {c}), 0) AS BIGINT)"


@query(f"""WITH b AS (SELECT CAST(event_id // 125 AS BIGINT) AS block, event_id % 125 AS idx, (event_id % 125) // 25 AS i, (event_id % 25) // 5 AS j, event_id % 5 AS k, CAST(floor(value / (0.25::DOUBLE * 2) + 0.5) AS BIGINT) AS cell FROM events),
 x AS (SELECT *, {_DIFF('i', 'cell', 'j, k')} AS d1 FROM b), y AS (SELECT *, {_DIFF('j', 'd1', 'i, k')} AS d2 FROM x), z AS (SELECT *, {_DIFF('k', 'd2', 'i, j')} AS code FROM y)
 SELECT block, idx, code, cell * 0.5::DOUBLE AS base FROM z""")
def predicted_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The same in boxes of 5 x 5 x 5, along all axes."""
    coded = approx.predict_boxes(_boxes(spark, d).withColumn("bound0", F.lit(0.25)), ["block"], [5, 5, 5])
    return approx.unpredict_boxes(coded.select("block", "idx", "code", "bound0"), ["block"], [5, 5, 5]).select("block", "idx", "code", "base")


@query("WITH q AS (SELECT event_id AS idx, value / 100000.0::DOUBLE AS relative FROM events) SELECT idx, relative, CAST(CASE " + " ".join(f"WHEN relative >= 1e-{i + 1}::DOUBLE THEN {i}" for i in range(17)) + " ELSE 17 END AS INTEGER) AS snapshot FROM q")
def snapshot_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("idx", (F.col("value") / 100000.0).alias("relative"))
    return rows.withColumn("snapshot", approx.snapshot_for(F.col("relative"), approx.RUNGS["serial"]))


# ---- derived quantities ----

_VEL = "WITH v AS (SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS vx, CAST(embedding[2] AS DOUBLE) AS vy, CAST(embedding[3] AS DOUBLE) AS vz FROM embeddings)"
_GAS = f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS vx, l_tax AS vy, 0.01::DOUBLE AS vz, l_extendedprice AS p, l_quantity AS d FROM lineitem),
 t AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS v_tot, p / (d * 287.1::DOUBLE) AS temp FROM g), c AS (SELECT *, sqrt({qoi.GAMMA * qoi.R!r}::DOUBLE * temp) AS c FROM t), m AS (SELECT *, v_tot / c AS mach FROM c),
 r AS (SELECT *, mach * mach * {(qoi.GAMMA - 1) / 2!r}::DOUBLE + 1 AS q, temp / 273.15::DOUBLE AS u FROM m)"""
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_QOI_SQL = {"v_tot": "v_tot", "temp": "temp", "c": "c", "mach": "mach", "pt": "p * sqrt((q * q * q) * (q * q * q) * q)", "mu": f"1.716e-5::DOUBLE * sqrt(u * u * u) * {qoi.T_R + qoi.S!r}::DOUBLE / (temp + 110.4::DOUBLE)"}


def _quantities(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        every = qoi.all_quantities(*(F.col(c) for c in ("vx", "vy", "vz", "p", "d")))
        return gas(spark, d).select(*_KEY.split(", "), *(every[n].alias(n) for n in names))

    return run


for _name, _which in (*((f"qoi_{n}", [n]) for n in _QOI_SQL), ("qoi_all", list(_QOI_SQL))):
    QUERIES[_name] = _quantities(_which)
    ORACLES[_name] = _GAS + f" SELECT {_KEY}, " + ", ".join(f"{_QOI_SQL[n]} AS {n}" for n in _which) + " FROM r"

_SQRT_B = "CASE WHEN {x} = 0 THEN sqrt({e}) WHEN {x} > {e} THEN {e} / (sqrt(greatest({x} - {e}, 0.0)) + sqrt({x})) WHEN {x} > 0 THEN {e} / sqrt({x}) END"
_SQRT_I = "CASE WHEN {x} = 0 THEN {t} * {t} WHEN {x} > {e} THEN {t} * (sqrt(greatest({x} - {e}, 0.0)) + sqrt({x})) WHEN {x} > 0 THEN {t} * sqrt({x}) END"
_BEY = "CASE WHEN abs({x}) > {e} THEN CASE WHEN {x} > 0 THEN {x} - {e} ELSE {x} + {e} END END"
_E, _T = "0.25::DOUBLE", "0.5::DOUBLE"
for _name, _col, _sql in (
    ("bound_square", lambda x, y, e, t: qoi.square_bound(x, e), f"abs(vx) * 2 * {_E} + {_E} * {_E}"),
    ("inv_bound_square", lambda x, y, e, t: qoi.square_inverse(x, t), f"sqrt(vx * vx + {_T}) - abs(vx)"),
    ("bound_sqrt", lambda x, y, e, t: qoi.sqrt_bound(F.abs(x), e), _SQRT_B.format(x="abs(vx)", e=_E)),
    ("inv_bound_sqrt", lambda x, y, e, t: qoi.sqrt_inverse(F.abs(x), e, t), _SQRT_I.format(x="abs(vx)", e=_E, t=_T)),
    ("bound_reciprocal", lambda x, y, e, t: qoi.reciprocal_bound(x, F.lit(0.125), e), f"{_E} / abs(({_BEY.format(x='(vx + 0.125)', e=_E)}) * (vx + 0.125))"),
    ("inv_bound_reciprocal", lambda x, y, e, t: qoi.reciprocal_inverse(x, F.lit(0.125), e, t), f"{_T} * abs(({_BEY.format(x='(vx + 0.125)', e=_E)}) * (vx + 0.125))"),
    ("bound_product", lambda x, y, e, t: qoi.product_bound(x, y, e, t), f"abs(vx) * {_T} + abs(vy) * {_E} + {_E} * {_T}"),
    ("bound_quotient", lambda x, y, e, t: qoi.quotient_bound(x, y, e, e), f"(abs(vx) * {_E} + abs(vy) * {_E}) / abs(vy * ({_BEY.format(x='vy', e=_E)}))"),
):
    QUERIES[_name] = lambda spark, d, c=_col: velocity(spark, d).select("idx", c(F.col("vx"), F.col("vy"), F.lit(0.25), F.lit(0.5)).alias("bound"))
    ORACLES[_name] = _VEL + f" SELECT idx, {_sql} AS bound FROM v"

_S2 = "(vx * vx + vy * vy + vz * vz)"
_E2 = "(abs(vx) * 2 * {e} + {e} * {e} + (abs(vy) * 2 * {e} + {e} * {e}) + (abs(vz) * 2 * {e} + {e} * {e}))"


@query(_VEL + f", a AS (SELECT *, {_SQRT_I.format(x=_S2, e=_E2.format(e='0.01::DOUBLE'), t='0.001::DOUBLE')} AS al, 0.01::DOUBLE * 0.01 + 0.01::DOUBLE * 0.01 + 0.01::DOUBLE * 0.01 AS qa, (abs(vx) * 0.01::DOUBLE + abs(vy) * 0.01::DOUBLE + abs(vz) * 0.01::DOUBLE) * 2 AS qb FROM v) SELECT idx, (sqrt(qb * qb + qa * al * 4) - qb) / (qa * 2) AS scale FROM a")
def tighten_speed(spark: SparkSession, d: str) -> DataFrame:
    e = (F.lit(0.01),) * 3
    return velocity(spark, d).select("idx", qoi.tighten_speed((F.col("vx"), F.col("vy"), F.col("vz")), e, F.lit(0.001)).alias("scale"))


@query(f"SELECT {_KEY}, 0.01::DOUBLE / ({1 / 287.1!r}::DOUBLE * ((abs(l_extendedprice) * 0.5::DOUBLE + abs(l_quantity) * 1.0::DOUBLE) / abs(l_quantity * ({_BEY.format(x='l_quantity', e='0.5::DOUBLE')})))) AS scale FROM lineitem")
def tighten_temperature(spark: SparkSession, d: str) -> DataFrame:
    return gas(spark, d).select(*_KEY.split(", "), qoi.tighten_temperature(F.col("p"), F.col("d"), F.lit(1.0), F.lit(0.5), F.lit(1 / 287.1), F.lit(0.01)).alias("scale"))


@query(f"SELECT {_KEY}, CASE WHEN l_quantity = l_linenumber THEN 1.5 ELSE l_quantity / least(l_quantity, CAST(l_linenumber AS DOUBLE)) END AS a, CASE WHEN l_quantity = l_linenumber THEN 1.5 ELSE l_linenumber / least(l_quantity, CAST(l_linenumber AS DOUBLE)) END AS b FROM lineitem")
def normalise_pair(spark: SparkSession, d: str) -> DataFrame:
    a, b = qoi.normalise_pair(F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    return read_table(spark, d, "lineitem").select(*_KEY.split(", "), a.alias("a"), b.alias("b"))


_EST = _VEL + f", s AS (SELECT idx, vx, vy, vz, sqrt{_S2} AS v_tot, {_SQRT_B.format(x=_S2, e=_E2.format(e='0.001::DOUBLE'))} AS est FROM v)"


@query(_EST + " SELECT idx, v_tot, est FROM s")
def vtot_error_points(spark: SparkSession, d: str) -> DataFrame:
    return control.speed_errors(velocity(spark, d), (0.001, 0.001, 0.001)).select("idx", "v_tot", "est")


@query(_EST + " SELECT est, idx, vx, vy, vz FROM s ORDER BY est DESC, idx LIMIT 1")
def vtot_error_argmax(spark: SparkSession, d: str) -> DataFrame:
    return control.worst_point(velocity(spark, d), [], (0.001, 0.001, 0.001))


@query(_VEL + f", z AS (SELECT idx, n, {_SQRT_B.format(x=_S2, e=_E2.format(e='(0.1::DOUBLE / pow(1.5::DOUBLE, n))'))} AS est FROM v, range(0, 60) r(n)) SELECT idx, CAST(min(n) FILTER (est <= 0.001) AS INTEGER) AS steps FROM z GROUP BY idx")
def vtot_tighten(spark: SparkSession, d: str) -> DataFrame:
    """For each point, the divisions by 1.5 that bring the estimate within 0.001."""
    return control.tightened(velocity(spark, d), (0.1, 0.1, 0.1), 0.001).select("idx", "steps")


@query(_PB + f", z AS (SELECT p, count(*) AS n, ceil((count(*) + count(*) FILTER (({_FIRST}) = p)) / 64) * 8 AS b FROM c, range(0, {PLANES}) r(p) GROUP BY p) SELECT CAST(p AS INTEGER) AS plane, (n * 8) / sum(b) OVER w AS ratio, (sum(b) OVER w) * 8 / (n * 1) AS bitrate FROM z WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)")
def ratio_and_bitrate(spark: SparkSession, d: str) -> DataFrame:
    """Raw bytes over bytes read, and bits a value, after each plane."""
    from pyspark.sql import Window

    rows = encode.perbit_sizes(coded_events(spark, d, "perbit"), ["level"], PLANES)
    n = read_table(spark, d, "events").agg(F.count("*").alias("n"))
    read = F.sum("bytes").over(Window.partitionBy("level").orderBy("plane").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(n)).withColumn("read", read)  # one row for each plane
    return rows.select("plane", control.ratio(F.col("n") * 8, F.col("read")).alias("ratio"), control.bitrate(F.col("read"), F.col("n"), 1).alias("bitrate"))


# ---- trajectories ----

_AT = "WITH a AS (SELECT vec_id AS frame, CAST(k AS BIGINT) AS atom, CAST(embedding[CAST(3 * k + 1 AS INTEGER)] AS DOUBLE) AS x, CAST(embedding[CAST(3 * k + 2 AS INTEGER)] AS DOUBLE) AS y, CAST(embedding[CAST(3 * k + 3 AS INTEGER)] AS DOUBLE) AS z FROM embeddings, range(0, 21) r(k))"


@query(_AT + ", r0 AS (SELECT atom, x AS rx, y AS ry, z AS rz FROM a WHERE frame = 0 AND atom % 2 = 0) SELECT frame, round(sqrt(avg((x - rx) * (x - rx) + (y - ry) * (y - ry) + (z - rz) * (z - rz))), 6) AS rmsd, count(*) AS n_atoms FROM a JOIN r0 USING (atom) GROUP BY frame")
def rmsd_by_frame(spark: SparkSession, d: str) -> DataFrame:
    """Against frame 0, over every second atom."""
    rows = atoms(spark, d)
    picked = trajectory.select_atoms(rows, spark.range(21).where("id % 2 = 0").withColumnRenamed("id", "atom"))
    return trajectory.rmsd(picked, rows.where("frame = 0")).select("frame", F.round("rmsd", 6).alias("rmsd"), "n_atoms")


@query(_AT + " SELECT atom, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rmsf, count(*) AS n_frames FROM a GROUP BY atom")
def rmsf_by_atom(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.rmsf(atoms(spark, d)).select("atom", F.round("rmsf", 6).alias("rmsf"), "n_frames")


@query(_AT + ", f AS (SELECT round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rmsf FROM a GROUP BY atom) SELECT round(avg(rmsf), 5) AS mean, round(stddev_pop(rmsf), 5) AS std, count(rmsf) AS n FROM f")
def rmsf_summary(spark: SparkSession, d: str) -> DataFrame:
    out = fields.summary(rmsf_by_atom(spark, d), [], "rmsf")
    return out.select(F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


_TOUCH = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) < 0.5::DOUBLE * 0.5::DOUBLE"


@query(_AT + f" SELECT a.atom AS a, b.atom AS b, count(*) AS hits, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id >= 1 AND (vec_id - 1) % 2 = 0) AS n_frames, count(*) / (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id >= 1 AND (vec_id - 1) % 2 = 0) AS share FROM a JOIN a b ON a.frame = b.frame AND a.atom < b.atom AND {_TOUCH} WHERE a.frame >= 1 AND (a.frame - 1) % 2 = 0 GROUP BY 1, 2")
def contact_map(spark: SparkSession, d: str) -> DataFrame:
    """Pairs nearer than 0.5 in every second frame from 1 on."""
    return trajectory.contact_map(atoms(spark, d), 0.5, 1, 2)


@query(_AT + f" SELECT a.frame % 3 AS sim, a.atom AS a, b.atom AS b, count(*) AS hits FROM a JOIN a b ON a.frame = b.frame AND a.atom < b.atom AND {_TOUCH} GROUP BY 1, 2, 3")
def contact_map_sims(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.contact_map(atoms(spark, d).withColumn("sim", F.col("frame") % 3), 0.5, sims=True).select("sim", "a", "b", "hits")


def _least_rmsd() -> str:
    """The least RMSD by superposition, from the largest root of the key matrix's characteristic polynomial, by Newton's steps."""
    axes = [(p, q) for p in "xyz" for q in "xyz"]
    sql = _AT + ", m AS (SELECT frame, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM a GROUP BY frame), c AS (SELECT frame, atom, x - mx AS x, y - my AS y, z - mz AS z FROM a JOIN m USING (frame)), r0 AS (SELECT atom, x AS rx, y AS ry, z AS rz FROM c WHERE frame = 0)"
    sql += ", s AS (SELECT frame, count(*) AS n, (sum(x * x + y * y + z * z) + sum(rx * rx + ry * ry + rz * rz)) / 2 AS e0, " + ", ".join(f"sum({p} * r{q}) AS {p}{q}" for p, q in axes) + " FROM c JOIN r0 USING (atom) GROUP BY frame)"
    square = [[" + ".join(f"{k}{i} * {k}{j}" for k in "xyz") for j in "xyz"] for i in "xyz"]
    trace, trace2 = " + ".join(f"({square[i][i]})" for i in range(3)), " + ".join(f"({square[i][j]}) * ({square[i][j]})" for i in range(3) for j in range(3))
    sql += f", k AS (SELECT frame, n, e0, -2 * ({trace}) AS c2, -8 * (xx * (yy * zz - yz * zy) - xy * (yx * zz - yz * zx) + xz * (yx * zy - yy * zx)) AS c1, 2 * ({trace2}) - ({trace}) * ({trace}) AS c0 FROM s), l0 AS (SELECT *, e0 AS l FROM k)"
    for i in range(40):
        sql += f", l{i + 1} AS (SELECT frame, n, e0, c2, c1, c0, CASE WHEN 4 * l * l * l + 2 * c2 * l + c1 = 0 THEN l ELSE l - (l * l * l * l + c2 * l * l + c1 * l + c0) / (4 * l * l * l + 2 * c2 * l + c1) END AS l FROM l{i})"
    return sql + ", d AS (SELECT frame, sqrt(greatest(0, 2 * (e0 - l) / n)) AS rmsd FROM l40)"


@query(_least_rmsd() + ", b AS (SELECT frame, sqrt(avg((x - rx) * (x - rx) + (y - ry) * (y - ry) + (z - rz) * (z - rz))) AS before FROM a JOIN (SELECT atom, x AS rx, y AS ry, z AS rz FROM a WHERE frame = 0) USING (atom) GROUP BY frame) SELECT frame, round(before, 5) AS before, round(rmsd, 5) AS after FROM d JOIN b USING (frame)")
def align_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames superposed on frame 0: distances from it before and after, the latter the least that there is."""
    rows = atoms(spark, d)
    first = rows.where("frame = 0")
    after = trajectory.with_coordinates(rows, trajectory.align(rows, first))
    told = trajectory.rmsd(rows, first).select("frame", F.round("rmsd", 5).alias("before"))
    return told.join(trajectory.rmsd(after, first).select("frame", F.round("rmsd", 5).alias("after")), "frame")


@query()
def rmsf_by_selection(spark: SparkSession, d: str) -> DataFrame:
    """Fluctuations of two selections, each after superposition by its own atoms; tests compare with what must come out."""
    picks = {name: spark.range(21).where(F.col("id") % 2 == k).withColumnRenamed("id", "atom") for k, name in enumerate(("even", "odd"))}
    return trajectory.aligned_rmsf(atoms(spark, d), picks).withColumn("rmsf", F.round("rmsf", 6))


# ---- the store, progressive reading, controlled reading, streams ----


def _order_field(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).withColumn("var", F.lit("price"))


def _negabinary_ladder() -> str:
    """Codes and in-order plans of the orders' coefficients, to 64 and to 1."""
    err = f"CASE WHEN max_abs = 0 THEN 0.0 WHEN {{b}} = 0 THEN max_abs * 4 ELSE pow(2.0, e + 2 - {{b}}) END"
    lad = _BND + f""", g AS (SELECT block, level, CAST(p AS INTEGER) AS plane, ({err.format(b='p')}) - ({err.format(b='(p + 1)')}) AS gain FROM b, range(0, {PLANES}) r(p)),
 t AS (SELECT block, sum(max_abs * 4) AS err0 FROM b GROUP BY block), w AS (SELECT g.*, err0 - coalesce(sum(gain) OVER (PARTITION BY block ORDER BY level, plane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM g JOIN t USING (block)),
 n AS (SELECT block, level, CAST(count(*) FILTER (rest >= 64.0) AS INTEGER) AS n64, CAST(count(*) FILTER (rest >= 1.0) AS INTEGER) AS n1 FROM w GROUP BY block, level)"""
    cut = lambda n: f"CAST({_unnb(f'((code >> ({PLANES} - {n})) << ({PLANES} - {n}))')} AS DOUBLE) * pow(2.0, e + 2 - {PLANES})"
    lad += f", f AS (SELECT k.block, k.idx, k.level, l.n, l.tz, b.e, n64, n1, xor(CAST(trunc(k.value * pow(2.0, {PLANES} - b.e - 2)) AS BIGINT) + {_NEG}, {_NEG}) AS code FROM k JOIN l USING (block, idx) JOIN b ON b.block = k.block AND b.level = k.level JOIN n ON n.block = k.block AND n.level = k.level)"
    lad += f", c0 AS (SELECT block, idx, level, n, tz, {cut('n64')} AS a64, {cut('n1')} AS a1 FROM f), d0 AS (SELECT block, idx, a64, a1 FROM c0 WHERE level = 0)"
    for i in range(1, LEVELS + 1):
        lad += f", d{i} AS (SELECT * FROM d{i - 1} UNION ALL SELECT c.block, c.idx, c.a64 + (x.a64 + y.a64) / 2, c.a1 + (x.a1 + y.a1) / 2 FROM c0 c JOIN d{i - 1} x ON x.block = c.block AND x.idx = c.idx - c.tz JOIN d{i - 1} y ON y.block = c.block AND y.idx = least(c.idx + c.tz, c.n - 1) WHERE c.level = {i})"
    return lad


@query(_negabinary_ladder() + f" SELECT block, idx, a64 AS v64, a1 AS v1 FROM d{LEVELS}")
def store_progressive(spark: SparkSession, d: str) -> DataFrame:
    """Written as fragments, read to 64 and then on to 1 with what was read before: the values of both answers."""
    path = shared_path(spark, "store")
    refactor.refactor(_order_field(spark, d), path, refactor.Config(LEVELS, PLANES, "negabinary"))
    session = refactor.Session(spark, path, "in_order")
    first = session.reconstruct(64.0).select("block", "idx", F.col("value").alias("v64"))
    then = session.reconstruct(1.0).select("block", "idx", F.col("value").alias("v1"))
    return first.join(then, ["block", "idx"])


@query(_negabinary_ladder() + f", u AS (SELECT level, n64, n1, CAST(ceil(b.n / 8) AS BIGINT) AS size FROM n JOIN b USING (block, level)) SELECT CAST(sum(n64) AS BIGINT) AS planes64, CAST(sum(n64 * size) AS BIGINT) AS bytes64, CAST(sum(n1) AS BIGINT) AS planes1, CAST(sum(n1 * size) AS BIGINT) AS bytes1 FROM u")
def store_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Planes and bytes of both answers, of planes that aren't compressed."""
    path = shared_path(spark, "store")
    refactor.refactor(_order_field(spark, d), path, refactor.Config(LEVELS, PLANES, "negabinary", policy="none"))
    session = refactor.Session(spark, path, "in_order")
    told = []
    for tau in (64.0, 1.0):
        session.coefficients(tau)
        told.append(session.retrieved().agg(F.sum("planes").alias(f"planes{tau:g}"), F.sum("bytes").alias(f"bytes{tau:g}")))
    return told[0].join(told[1])  # a row each


_LEAST = 300


@query(_negabinary_ladder() + f""", z AS (SELECT n.block, n.level, n1, CAST(ceil(b.n / 8) AS BIGINT) AS size FROM n JOIN b USING (block, level)), m AS (SELECT *, CAST(ceil({_LEAST} / size) AS BIGINT) AS each FROM z)
 SELECT block, level, CAST(least({PLANES}, ((n1 - 1) // each + 1) * each) AS BIGINT) AS planes, CAST((n1 - 1) // each + 1 AS BIGINT) AS buckets FROM m WHERE n1 > 0""")
def store_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Planes merged into buckets of 300 bytes at least: what is read, in whole buckets, for an error of 1."""
    path = shared_path(spark, "store")
    refactor.refactor(_order_field(spark, d), path, refactor.Config(LEVELS, PLANES, "negabinary", policy="none"))
    frags = spark.read.parquet(f"{path}/fragments")
    merged = shared_path(spark, "buckets")
    store.write_buckets(frags, planner.merge_small(frags.select("block", "var", "level", "plane", "size"), ["block", "var"], _LEAST), merged)
    plan = refactor.Session(spark, path, "in_order").plan_for(1.0)
    return store.read_buckets(spark, merged, plan).groupBy("block", "level").agg(F.count("*").alias("planes"), F.count_distinct("bucket").alias("buckets"))


@query(f"WITH o AS (SELECT CAST(o_orderkey // {BLOCK} AS BIGINT) AS block, count(*) AS n FROM orders GROUP BY 1) SELECT block, CAST(n * 4 AS BIGINT) AS size, CAST(coalesce(sum(n * 4) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM o")
def write_at_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Each block's raw bytes, written where those of the blocks before it end."""
    ship_package(spark)
    return store.write_at_offsets(orders(spark, d), shared_path(spark, "at-offsets")).select("block", F.octet_length("body").cast("bigint").alias("size"), "offset")


@query("SELECT event_id // 1000 AS run, CAST(min(event_id) * 8 AS BIGINT) AS first, CAST(count(*) * 8 AS BIGINT) AS size FROM events GROUP BY 1")
def raw_runs(spark: SparkSession, d: str) -> DataFrame:
    """A field as runs of raw doubles."""
    ship_package(spark)
    path = shared_path(spark, "raw")
    store.write_raw(events(spark, d), path, "float64", 1000)
    return spark.read.parquet(path).select("run", "first", F.octet_length("body").cast("bigint").alias("size"))


@query("SELECT c_custkey AS sim FROM customer WHERE c_custkey % 3 <> 0")
def missing_results(spark: SparkSession, d: str) -> DataFrame:
    """The customers for whom no result is stored."""
    path, wanted = shared_path(spark, "results"), read_table(spark, d, "customer").select(F.col("c_custkey").alias("sim"))
    wanted.where("sim % 3 = 0").withColumn("result", F.lit(1.0)).write.parquet(path)
    return store.missing(wanted, spark, path, ["sim"])


@query("SELECT split_part(n_name, ' ', 1) AS sim FROM nation")
def simulation_names(spark: SparkSession, d: str) -> DataFrame:
    """Names out of a text file, one a line with other words behind it, and empty lines between."""
    path = shared_path(spark, "names")
    names = read_table(spark, d, "nation")
    lines = names.select(F.concat(F.lit("  "), "n_name", F.lit(" of the list")).alias("value")).unionByName(names.select(F.lit("").alias("value")))
    lines.write.text(path)
    return store.read_names(spark, path)


@query("WITH v AS (SELECT vec_id, unnest(['velocity_x', 'velocity_y', 'velocity_z']) AS var, unnest([CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)]) AS value FROM embeddings WHERE vec_id % 10 <> 0) SELECT var, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY var")
def profile_masked(spark: SparkSession, d: str) -> DataFrame:
    """A profile's variables, refactored without the points that have no velocity."""
    rows = velocity(spark, d).select(F.lit(0).cast("bigint").alias("block"), "idx", *(F.when(F.col("idx") % 10 != 0, F.col(c)).otherwise(0.0).alias(f"velocity_{c[1]}") for c in ("vx", "vy", "vz")))
    return refactor.refactor_profile(rows, shared_path(spark, "profile"), "velocity").groupBy("var").agg(F.sum("n").alias("n"))


@query(f"SELECT CAST(o_orderkey // {BLOCK} AS BIGINT) AS block, max(o_totalprice) - min(o_totalprice) AS value_range, CAST(7 AS INTEGER) AS num_segments, CAST(ceil(count(*) * 3 / 8) AS BIGINT) AS first_size, CAST(ceil(count(*) * 4 / 8) AS BIGINT) AS next_size FROM orders GROUP BY 1")
def delta_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Ranges and sizes of delta segments, written and read."""
    manifest = refactor.refactor_deltas(_order_field(spark, d), shared_path(spark, "deltas"), 7)
    return manifest.select("block", "value_range", "num_segments", F.col("segment_sizes")[0].alias("first_size"), F.col("segment_sizes")[6].alias("next_size"))


_SIGNS_IN = f"count(*) FILTER (({_FIRST}) = p)"


@query(_PB + f" SELECT CAST(idx // {BLOCK} AS BIGINT) AS block, CAST(p AS INTEGER) AS plane, CAST(ceil(count(*) / 8) + ceil({_SIGNS_IN} / 8) AS BIGINT) AS raw_size, count(*) AS n FROM c, range(0, {PLANES}) r(p) GROUP BY 1, 2")
def pack_planes(spark: SparkSession, d: str) -> DataFrame:
    """Planes as bytes: their bits, then the signs of elements whose first one is there."""
    ship_package(spark)
    return encode.fragments(_packed(spark, d, "perbit"), PLANES, "perbit", "none").select("block", "plane", "raw_size", "n")


@query(_PB + f" SELECT idx, {_pb_value(12)} AS decoded FROM c")
def compress_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Packed, compressed plane by plane while that pays; the first 12 planes expanded and decoded."""
    ship_package(spark)
    packed = _packed(spark, d, "perbit")
    back = encode.unpack(encode.fragments(packed, PLANES, "perbit", "adaptive").where("plane < 12"), PLANES)
    return _from_codes(back, packed, 12, "perbit")


_PRECISION = f"""WITH p AS (SELECT CAST(p_partkey // {BLOCK} AS BIGINT) AS block, p_partkey AS idx, p_retailprice AS value FROM part), s AS (SELECT block, (max(value) - min(value)) * 0.001::DOUBLE AS eb FROM p GROUP BY block),
 a AS (SELECT block, idx, value, eb, CASE WHEN eb > 0 THEN floor(value / (eb * 2) + 0.5) * (eb * 2) ELSE value END AS base FROM p JOIN s USING (block)), m AS (SELECT block, any_value(eb) AS eb, max(abs(value - base)) AS m FROM a GROUP BY block), x AS (SELECT block, eb, m, {_exp('m')} AS e FROM m),
 n AS (SELECT block, eb, m, e, CAST((SELECT min(b) FROM range(0, 33) r(b) WHERE (CASE WHEN b = 0 THEN m ELSE pow(2.0, e - b) END) < 0.01) AS INTEGER) AS b FROM x)"""


@query(_PRECISION + f" SELECT idx, base + (CASE WHEN value - base < 0 THEN -1 ELSE 1 END) * CAST((abs(CAST(trunc((value - base) * pow(2.0, {PLANES} - e)) AS BIGINT)) >> ({PLANES} - b)) << ({PLANES} - b) AS DOUBLE) * pow(2.0, e - {PLANES}) AS got FROM a JOIN n USING (block)")
def precision_progressive(spark: SparkSession, d: str) -> DataFrame:
    """An approximation, and planes of what it leaves, to within 0.01: the values."""
    path = shared_path(spark, "precision")
    refactor.refactor_precision(_part_field(spark, d), path, refactor.Config(0, PLANES))
    return refactor.reconstruct_precision(refactor.Session(spark, path), 0.01).select("idx", F.col("value").alias("got"))


def _part_field(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select(F.floor(F.col("idx") / BLOCK).cast("bigint").alias("block"), F.lit("price").alias("var"), "idx", "value")


@query(_PRECISION + f" SELECT block, m AS max_abs, e AS exp, eb AS approximator_eb, CAST({PLANES} AS INTEGER) AS planes FROM x")
def precision_manifest(spark: SparkSession, d: str) -> DataFrame:
    manifest = refactor.refactor_precision(_part_field(spark, d), shared_path(spark, "precision"), refactor.Config(0, PLANES))
    return manifest.select("block", "max_abs", "exp", "approximator_eb", "planes")


def _deltas_sql(rungs: int) -> str:
    """Sums of the first segments of each variable, and the speed's estimate after each round of control from deltas."""
    names = ("vx", "vy", "vz")
    sql = _VEL + ", sp AS (SELECT " + ", ".join(f"max({c}) - min({c}) AS s{c}" for c in names) + " FROM v), p0 AS (SELECT idx, " + ", ".join(f"{c} AS r{c}, CAST([] AS DOUBLE[]) AS p{c}" for c in names) + " FROM v)"
    for i in range(rungs):
        e = {c: f"(s{c} / {float(10 ** (i + 1))!r}::DOUBLE)" for c in names}
        cell = {c: f"floor(r{c} / ({e[c]} * 2) + 0.5) * ({e[c]} * 2)" for c in names}
        last = {c: f"coalesce(p{c}[{i}], 0.0)" for c in names}
        sql += f", p{i + 1} AS (SELECT idx, " + ", ".join(f"r{c} - {cell[c]} AS r{c}, list_append(p{c}, {last[c]} + {cell[c]}) AS p{c}" for c in names) + f" FROM p{i}, sp)"
    sql += ", b1 AS (SELECT " + ", ".join(f"s{c} * 0.1::DOUBLE AS e{c}" for c in names) + " FROM sp)"
    s2 = "(vx * vx + vy * vy + vz * vz)"
    for r in range(1, control.ROUNDS + 1):
        rung = {c: "(CASE " + " ".join(f"WHEN s{c} * {10.0 ** -(k + 1)!r}::DOUBLE <= e{c} THEN {k + 1}" for k in range(rungs)) + f" ELSE {rungs} END)" for c in names}
        e2 = lambda by: " + ".join(f"(abs({c}) * 2 * (e{c} / {by}) + (e{c} / {by}) * (e{c} / {by}))" for c in names)
        sql += f", q{r} AS (SELECT idx, b.*, " + ", ".join(f"p{c}[{rung[c]}] AS {c}" for c in names) + f" FROM p{rungs}, sp, b{r} b)"
        sql += f", t{r} AS (SELECT *, {_SQRT_B.format(x=s2, e='(' + e2('1') + ')')} AS est FROM q{r}), w{r} AS (SELECT * FROM t{r} ORDER BY est DESC, idx LIMIT 1)"
        sql += f", n{r} AS (SELECT min(n) AS n FROM (SELECT n, {_SQRT_B.format(x=s2, e='(' + e2('pow(1.5::DOUBLE, n)') + ')')} AS est FROM w{r}, range(0, 200) k(n)) WHERE est <= 0.001)"
        sql += f", b{r + 1} AS (SELECT " + ", ".join(f"e{c} / pow(1.5::DOUBLE, n) AS e{c}" for c in names) + f" FROM w{r}, n{r})"
    ended = " UNION ALL ".join(f"SELECT {r} AS r, est <= 0.001 AS met FROM w{r}" for r in range(1, control.ROUNDS + 1))
    return sql + f", z AS (SELECT coalesce(min(r) FILTER (met), {control.ROUNDS}) AS r, bool_or(met) AS met FROM ({ended}))"


@query(_deltas_sql(10) + " SELECT idx, CAST(r AS INTEGER) AS rounds, met, round(sqrt(vx * vx + vy * vy + vz * vz), 7) AS speed FROM (" + " UNION ALL ".join(f"SELECT {r} AS r, idx, vx, vy, vz FROM t{r}" for r in range(1, control.ROUNDS + 1)) + ") JOIN z USING (r)")
def qoi_controlled(spark: SparkSession, d: str) -> DataFrame:
    """Speeds to within 0.001 of the true ones, from delta snapshots, tightened as far as that takes."""
    v = velocity(spark, d).withColumn("block", F.lit(0).cast("bigint"))
    spans = v.agg(*((F.max(c) - F.min(c)).alias(c) for c in ("vx", "vy", "vz"))).first().asDict()
    held = {c: materialise(approx.refactor_deltas(v.select("block", "idx", F.col(c).alias("value")), ["block", "idx"], [], approx.RUNGS["parallel"]), f"deltas-{c}") for c in spans}
    out = control.retrieve_speed(control.Snapshots(held, spans, approx.RUNGS["parallel"], deltas=True), tuple(spans[c] * 0.1 for c in ("vx", "vy", "vz")), 0.001)
    speed = qoi.speed(F.col("vx"), F.col("vy"), F.col("vz"))
    return out.points.select("idx", F.lit(out.rounds).alias("rounds"), F.lit(out.met).alias("met"), F.round(speed, 7).alias("speed"))


def _blocks_of(spark: SparkSession, d: str) -> DataFrame:
    """Flows of eight blocks; those of higher numbers are slower."""
    slow = F.lit(1.0) + F.col("idx") % 8
    return velocity(spark, d).select((F.col("idx") % 8).alias("block"), "idx", *((F.col(c) / slow).alias(c) for c in ("vx", "vy", "vz")))


@query()
def qoi_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each block controlled on its own, by ranges over all: rounds, bytes, ratio and bitrate; tests compare with blocks done alone."""
    v = _blocks_of(spark, d)
    spans = v.agg(*((F.max(c) - F.min(c)).alias(c) for c in ("vx", "vy", "vz"))).first().asDict()
    held = {c: materialise(approx.snapshots(v.select("block", "idx", F.col(c).alias("value")), ["block", "idx"], [], approx.RUNGS["parallel"]), f"snapshots-{c}") for c in spans}
    _, states = control.retrieve_blocks(held, spans, tuple(spans[c] * 0.1 for c in spans), 0.001, approx.RUNGS["parallel"])
    raw = F.col("elements") * len(spans) * 8
    return states.select("*", control.ratio(raw, F.col("bytes")).alias("ratio"), control.bitrate(F.col("bytes"), F.col("elements"), len(spans)).alias("bitrate"))


@query()
def qoi_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Speeds to within 0.01 from one progressive store for each variable; tests compare values and bytes."""
    v = velocity(spark, d).withColumn("block", F.floor(F.col("idx") / BLOCK).cast("bigint"))
    spans = v.agg(*((F.max(c) - F.min(c)).alias(c) for c in ("vx", "vy", "vz"))).first().asDict()
    sessions = {}
    for c in spans:
        path = shared_path(spark, f"flow-{c}")
        refactor.refactor(v.select("block", F.lit(c).alias("var"), "idx", F.col(c).alias("value")), path, refactor.Config(2, PLANES))
        sessions[c] = refactor.Session(spark, path)
    out = control.retrieve_speed(control.Sessions(sessions), tuple(spans[c] * 0.1 for c in spans), 0.01)
    speed = lambda df, name: df.select("idx", qoi.speed(F.col("vx"), F.col("vy"), F.col("vz")).alias(name))
    told = {"met": F.lit(out.met), "rounds": F.lit(out.rounds), "bytes": F.lit(out.bytes), "ratio": F.lit(out.ratio), "bitrate": F.lit(out.bitrate)}
    return speed(v, "true").join(speed(out.points, "got"), "idx").select("idx", "got", (F.abs(F.col("true") - F.col("got")) <= 0.01).alias("within"), *(c.alias(n) for n, c in told.items()))


@query("SELECT CAST(date_part('day', ts) AS INTEGER) AS step, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def stream_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events ingested day by day as a stream of steps; the steps' ranges as a batch would find them."""
    source, sink, marks = shared_path(spark, "steps"), shared_path(spark, "ranges"), shared_path(spark, "marks")
    rows = read_table(spark, d, "events").select(F.dayofmonth("ts").alias("step"), "value")
    rows.repartitionByRange(8, "step").write.parquet(source)

    def work(batch: DataFrame, step: int) -> None:
        batch.groupBy("step").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).write.mode("overwrite").parquet(f"{sink}/batch={step}")

    steps.each_step(steps.step_source(spark, source, rows.schema), work, marks)
    return spark.read.parquet(sink).groupBy("step").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("SELECT o_orderpriority AS var, CAST(max(o_orderkey % 32) AS INTEGER) AS taken, CAST(max(o_orderkey % 32) AS BIGINT) AS fresh FROM orders GROUP BY 1")
def stream_progressive(spark: SparkSession, d: str) -> DataFrame:
    """Requests for planes as a stream: what each variable holds at the end, and the planes that all requests added."""
    ship_package(spark)
    source, sink, marks = shared_path(spark, "requests"), shared_path(spark, "held"), shared_path(spark, "marks")
    rows = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("var"), (F.col("o_orderkey") % 32).cast("int").alias("planes"))
    rows.repartition(4).write.parquet(source)
    held = steps.accumulate_planes(steps.step_source(spark, source, rows.schema), ["var"])

    def work(batch: DataFrame, step: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={step}")

    query = held.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink).groupBy("var").agg(F.max("taken").alias("taken"), F.sum("fresh").alias("fresh"))
