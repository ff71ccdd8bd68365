"""Properties of the engine: bounds hold, there-and-back is exact, progressive is direct, plans are the heap's."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.functions import bitplane, errors, grid, qoi
from strataflow.operators import approx, encode, trajectory, transform
from strataflow.plans import control, planner, refactor
from strataflow.sources import store


def line(spark, values, block=0):
    return spark.createDataFrame([(block, i, float(v)) for i, v in enumerate(values)], "block long, idx long, value double")


def test_exponent(spark):
    xs = [0.0, 1.0, -3.0, 0.1, 1e-12, 1e12, *(2.0**k for k in range(-40, 41)), *(-(2.0**k) * 1.3 for k in range(-20, 20))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", grid.exponent(F.col("x")).alias("e")).collect()
    assert all(r.e == math.frexp(r.x)[1] for r in got)


def test_grid():
    assert [d[0] for d in grid.level_dims([1000], 3)] == [126, 251, 501, 1000]
    assert [d[0] for d in grid.level_dims([17], 3)] == [3, 5, 9, 17]
    assert sum(grid.level_elements([9, 10, 17], 2)) == 9 * 10 * 17
    with pytest.raises(ValueError):
        grid.check_levels([9], 4)
    with pytest.raises(ValueError):
        grid.check_levels([9, 9, 9, 9], 1)


@pytest.mark.parametrize("n", [3, 10, 17, 31, 64, 65])
def test_level_counts(spark, n):
    levels = grid.most_levels([n])
    got = {r.level: r["count"] for r in transform.with_level(transform.with_extent(line(spark, range(n))), levels).groupBy("level").count().collect()}
    assert [got.get(i, 0) for i in range(levels + 1)] == grid.level_elements([n], levels)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 33, 100])
def test_transform_native_is_blocks(spark, n):
    v = np.random.default_rng(n).normal(size=n) * 100
    levels = grid.most_levels([n])
    native = transform.decompose(line(spark, v), levels)
    got = {r.idx: r.value for r in native.collect()}
    want = transform.block_decompose(v, levels)
    assert np.allclose([got[i] for i in range(n)], want)
    back = {r.idx: r.value for r in transform.recompose(native, levels).collect()}
    assert np.allclose([back[i] for i in range(n)], v)


@pytest.mark.parametrize("basis", ["hierarchical", "orthogonal"])
@pytest.mark.parametrize("dims", [(17,), (10,), (9, 10), (9, 10, 17), (5, 6, 7)])
def test_blocks_there_and_back(dims, basis):
    v = np.random.default_rng(1).normal(size=dims)
    levels = grid.most_levels(list(dims))
    c = transform.block_decompose(v, levels, basis)
    assert np.allclose(transform.block_recompose(c, levels, basis), v)
    counts = np.bincount(transform.block_levels(list(dims), levels).ravel(), minlength=levels + 1)
    assert counts.tolist() == grid.level_elements(list(dims), levels)
    # linear: coefficients of a sum are sums of coefficients
    w = np.random.default_rng(2).normal(size=dims)
    assert np.allclose(transform.block_decompose(v + w, levels, basis), c + transform.block_decompose(w, levels, basis))


EDGES = {
    "zero": [0.0] * 64,
    "constant": [3.25] * 65,
    "powers": [s * 2.0**k for k in range(-30, 31) for s in (1, -1)],
    "one": [7.5],
    "signs": [1.5, -1.5, 0.0, -0.0, -2.25, 3.0],
    "wide": [s * 10.0**k for k in range(-12, 13) for s in (1, -1)],
    "word": list(range(-32, 32)),
}


@pytest.mark.parametrize("form", ["perbit", "negabinary", "weighted_negabinary"])
@pytest.mark.parametrize("name", EDGES)
def test_ladder_holds(spark, name, form):
    planes = 32
    rows = encode.with_exponent(line(spark, EDGES[name]).withColumn("level", F.lit(0)), ["level"])
    coded = encode.encoded(rows, planes, form)
    got = encode.largest_errors(coded, ["level", "max_abs"], planes, form)
    negabinary = "negabinary" in form
    bound = errors.ladder(errors.level_bound(F.col("max_abs"), negabinary), F.col("taken"))
    for r in got.withColumn("bound", bound).collect():
        assert r.max_error <= r.bound, (r.taken, r.max_error, r.bound)


def test_deltas_add_up(spark):
    rows = encode.with_exponent(line(spark, EDGES["signs"] + [0.3, -0.7]).withColumn("level", F.lit(0)), ["level"])
    for form in ("perbit", "negabinary"):
        c = encode.encoded(rows, 20, form)
        args = (F.col("code"), F.col("sign"), F.col("exp"), 20)
        steps = bitplane.delta(*args, 0, 5, form) + bitplane.delta(*args, 5, 11, form) + bitplane.delta(*args, 11, 20, form)
        for r in c.select(steps.alias("a"), bitplane.decode(*args, 20, form).alias("b")).collect():
            assert r.a == r.b


def test_odd_negabinary_refused():
    with pytest.raises(ValueError):
        bitplane.check_planes(7, "negabinary")
    with pytest.raises(ValueError):
        bitplane.check_planes(61)
    bitplane.check_planes(7)


@pytest.mark.parametrize("signed", [True, False])
def test_packing(signed):
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 33):
        code, sign = rng.integers(0, 1 << 12, n), rng.random(n) < 0.5
        bodies = encode.pack_planes(code, sign, 12, signed)
        got, signs = encode.unpack_planes(bodies, n, 12, signed)
        assert (got == code).all()
        if signed:
            assert (signs == (sign & (code > 0))).all()
        part, _ = encode.unpack_planes(bodies[:5], n, 12, signed)
        assert (part == code >> 7 << 7).all()


def test_compression_policy():
    assert encode.kept_compressed([1.0, 2.0, 1.0, 2.0, 2.0], "adaptive", 4) == [True, True, True, False, True]
    assert encode.kept_compressed([1.0, 2.0], "none") == [False, False]
    assert encode.kept_compressed([1.0, 2.0], "all") == [True, True]


def _heap(levels, tau, err):
    """The plan of a heap of per-level queues."""
    at = dict.fromkeys(levels, 0)
    heap = [(-g[0][0] / g[0][1], k) for k, g in levels.items() if g]
    heapq.heapify(heap)
    while err >= tau and heap:
        _, k = heapq.heappop(heap)
        err -= levels[k][at[k]][0]
        at[k] += 1
        if at[k] < len(levels[k]):
            g, s = levels[k][at[k]]
            heapq.heappush(heap, (-g / s, k))
    return at


def test_greedy_is_heap(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for case in range(30):
        levels = {k: [(rng.uniform(0.1, 9), rng.randint(1, 50)) for _ in range(6)] for k in range(3)}
        err = sum(g for v in levels.values() for g, _ in v)
        want[case] = _heap(levels, err / 3, err)
        rows += [(case, k, p, s, g / (err / 3), 3.0) for k, v in levels.items() for p, (g, s) in enumerate(v)]
    df = spark.createDataFrame(rows, "block int, level int, plane int, size int, gain double, err0 double")
    got = planner.greedy(df, 1.0, ["block"]).collect()
    assert all(want[r.block][r.level] == r.planes for r in got) and len(got) == 90


def test_plans_meet_tau_and_more_bytes_never_hurt(spark):
    rows = []
    for k, top in enumerate((64.0, 8.0, 3.0)):
        err = [top] + [2.0 ** (math.frexp(top)[1] - b) for b in range(1, 21)]
        rows += [(0, k, p, 8 * (k + 1), err[p] - err[p + 1], 75.0) for p in range(20)]
    df = spark.createDataFrame(rows, "block int, level int, plane int, size int, gain double, err0 double").cache()
    gain = {(r.level, r.plane): r.gain for r in df.collect()}
    for name, plan in planner.PLANNERS.items():
        last = -1
        for tau in (100.0, 10.0, 1.0, 0.1):
            got = plan(df, tau, ["block"]).collect()
            left = 75.0 - sum(gain[r.level, p] for r in got for p in range(r.planes))
            assert left < tau, name
            size = sum(r.bytes for r in got)
            assert size >= last
            last = size
            if tau > 75:
                assert size == 0, name  # satisfied from the start


@pytest.mark.parametrize("form,policy,method", [("perbit", "adaptive", "greedy_with_signs"), ("negabinary", "all", "greedy"), ("weighted_negabinary", "none", "round_robin"), ("grouped", "adaptive", "in_order")])
def test_progressive_is_direct(spark, tmp_path, form, policy, method):
    v = np.cumsum(np.random.default_rng(5).normal(size=100))
    field = line(spark, v).unionByName(line(spark, v * 3, 1)).withColumn("var", F.lit("u"))
    path = str(tmp_path / "s")
    refactor.refactor(field, path, refactor.Config(3, 24, form, policy=policy))
    step, direct = refactor.Session(spark, path, method), refactor.Session(spark, path, method)
    want = {(r.block, r.idx): r.value for r in field.collect()}
    sizes = []
    for tau in (5.0, 0.5, 0.01):
        got = {(r.block, r.idx): r.value for r in step.reconstruct(tau).collect()}
        assert max(abs(got[k] - want[k]) for k in want) < tau
        assert all(r.estimate < tau for r in step.estimate().collect())
        sizes.append(step.retrieved().agg(F.sum("bytes")).first()[0])
    assert sizes == sorted(sizes)
    once = {(r.block, r.idx): r.value for r in direct.reconstruct(0.01).collect()}
    assert max(abs(once[k] - got[k]) for k in want) < 0.02


@pytest.mark.parametrize("basis", ["hierarchical", "orthogonal"])
def test_box_store(spark, tmp_path, basis):
    v = np.random.default_rng(6).normal(size=9 * 10 * 11)
    field = line(spark, v).withColumn("var", F.lit("u"))
    refactor.refactor(field, str(tmp_path / "s"), refactor.Config(2, 32, "perbit", basis, dims=(9, 10, 11)))
    got = {r.idx: r.value for r in refactor.Session(spark, str(tmp_path / "s")).reconstruct(0.01).collect()}
    assert max(abs(got[i] - x) for i, x in enumerate(v)) < 0.01


def test_bad_fields_write_nothing(spark, tmp_path):
    field = line(spark, [1.0, 2.0, float("nan")]).withColumn("var", F.lit("u"))
    with pytest.raises(ValueError):
        refactor.refactor(field, str(tmp_path / "s"), refactor.Config(0, 8))
    with pytest.raises(ValueError):
        refactor.refactor(line(spark, range(9)).withColumn("var", F.lit("u")), str(tmp_path / "s"), refactor.Config(5, 8, dims=(9,)))
    assert not (tmp_path / "s").exists()


def test_scan_is_pruned(spark, tmp_path):
    field = line(spark, np.arange(64.0)).withColumn("var", F.lit("u"))
    refactor.refactor(field, str(tmp_path / "s"), refactor.Config(2, 16))
    plan = spark.createDataFrame([(0, "u", 0, 3), (0, "u", 1, 0), (0, "u", 2, 0)], "block long, var string, level int, planes int")
    read = store.read_fragments(spark, str(tmp_path / "s"), plan)
    assert sorted((r.level, r.plane) for r in read.collect()) == [(0, 0), (0, 1), (0, 2)]
    text = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "level" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_delta_ladder(spark):
    field = line(spark, np.random.default_rng(7).uniform(-5, 5, 50))
    parts = approx.refactor_deltas(field, ["block", "idx"], [], 7)
    want = {r.idx: r.value for r in field.collect()}
    span = max(want.values()) - min(want.values())
    for tau in (span * 2, 0.5, 1e-3):
        got = {r.idx: r.value for r in approx.reconstruct_deltas(parts, ["block", "idx"], tau, 7).collect()}
        assert all(abs(got[i] - x) <= tau * (1 + 1e-9) for i, x in want.items())
    flat = approx.refactor_deltas(line(spark, [4.0] * 3), ["block", "idx"], [], 7)
    assert {r.value for r in approx.reconstruct_deltas(flat, ["block", "idx"], -1.0, 7).collect()} == {4.0}


def test_uncontrolled_bounds_are_null(spark):
    one = spark.range(1)
    got = one.select(qoi.reciprocal_bound(F.lit(0.1), F.lit(0.0), F.lit(0.5)).alias("a"), qoi.quotient_bound(F.lit(1.0), F.lit(0.1), F.lit(0.1), F.lit(0.5)).alias("b"), qoi.quotient_bound(F.lit(1.0), F.lit(0.0), F.lit(0.1), F.lit(0.0)).alias("c")).first()
    assert got.a is None and got.b is None and got.c is None


def test_bounds_hold(spark):
    rng = np.random.default_rng(8)
    rows = [(float(x), float(y), float(e), float(x + e * s), float(y + e * t)) for x, y, e, s, t in zip(rng.uniform(0.1, 5, 300), rng.uniform(1, 5, 300), rng.uniform(0, 0.05, 300), rng.uniform(-1, 1, 300), rng.uniform(-1, 1, 300))]
    df = spark.createDataFrame(rows, "x double, y double, e double, x2 double, y2 double")
    x, y, e, x2, y2 = (F.col(c) for c in df.columns)
    checks = {
        "square": (x * x - x2 * x2, qoi.square_bound(x, e)),
        "sqrt": (F.sqrt(x) - F.sqrt(x2), qoi.sqrt_bound(x, e)),
        "reciprocal": (1 / (x + 1) - 1 / (x2 + 1), qoi.reciprocal_bound(x, F.lit(1.0), e)),
        "product": (x * y - x2 * y2, qoi.product_bound(x, y, e, e)),
        "quotient": (x / y - x2 / y2, qoi.quotient_bound(x, y, e, e)),
        "inverse": (F.lit(0.0) + F.abs((F.abs(x) + qoi.square_inverse(x, e)) * (F.abs(x) + qoi.square_inverse(x, e)) - x * x), e),
    }
    for name, (gap, bound) in checks.items():
        assert df.where(F.abs(gap) > bound + 1e-12).count() == 0, name


def test_control_reports(spark):
    v = np.random.default_rng(9).normal(size=(60, 3))
    truth = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(v)], "block long, idx long, vx double, vy double, vz double")
    fetch = lambda b: truth.select("block", "idx", *(approx.approximate(F.col(c), F.lit(float(e))).alias(c) for c, e in zip(("vx", "vy", "vz"), b)))
    out = control.retrieve_speed(fetch, (0.5, 0.5, 0.5), 0.01, rounds=20)
    assert out.met and out.estimate <= 0.01
    got = {r.idx: math.sqrt(r.vx**2 + r.vy**2 + r.vz**2) for r in out.points.collect()}
    assert max(abs(got[i] - np.linalg.norm(r)) for i, r in enumerate(v)) <= out.estimate
    assert not control.retrieve_speed(lambda b: fetch((0.5, 0.5, 0.5)), (0.5, 0.5, 0.5), 1e-9, rounds=1).met


def _flow(spark, n=60, blocks=1, seed=9):
    v = np.random.default_rng(seed).normal(size=(blocks, n, 3)) * np.arange(1, blocks + 1)[:, None, None]
    truth = spark.createDataFrame([(b, i, *map(float, v[b, i])) for b in range(blocks) for i in range(n)], "block long, idx long, vx double, vy double, vz double")
    return v, truth


def test_uncontrolled_points_are_not_met(spark):
    v, truth = _flow(spark)
    fetch = lambda b: truth.select("block", "idx", F.when(F.col("idx") != 7, F.col("vx")).alias("vx"), "vy", "vz")
    out = control.retrieve_speed(fetch, (1e-9,) * 3, 0.01, rounds=3)
    assert not out.met and out.uncontrolled == 1 and out.estimate <= 0.01 and out.rounds == 3 and out.bytes is None and out.ratio is None
    assert not control.retrieve_speed(lambda b: truth.select("block", "idx", F.lit(None).cast("double").alias("vx"), "vy", "vz"), (1.0,) * 3, 0.01, rounds=2).met


def test_control_over_sessions(spark, tmp_path):
    v, truth = _flow(spark, 200)
    sessions = {}
    for name in ("vx", "vy", "vz"):
        field = truth.select("block", F.lit(name).alias("var"), "idx", F.col(name).alias("value"))
        refactor.refactor(field, str(tmp_path / name), refactor.Config(3, 40))
        sessions[name] = refactor.Session(spark, str(tmp_path / name))
    out = control.retrieve_speed(control.Sessions(sessions), (0.5,) * 3, 0.001, rounds=8)
    got = {r.idx: math.sqrt(r.vx**2 + r.vy**2 + r.vz**2) for r in out.points.collect()}
    gap = max(abs(got[i] - np.linalg.norm(r)) for i, r in enumerate(v[0]))
    assert out.met and gap <= out.estimate <= 0.001 and out.elements == 200
    assert out.bytes == sum(s.retrieved().first()["bytes"] for s in sessions.values()) and out.ratio == 200 * 24 / out.bytes and out.bitrate == out.bytes * 8 / 600


@pytest.mark.parametrize("deltas", [False, True])
def test_control_over_snapshots(spark, deltas):
    v, truth = _flow(spark, 100)
    spans = {c: float(np.ptp(v[0][:, i])) for i, c in enumerate(("vx", "vy"))}
    make = approx.refactor_deltas if deltas else approx.snapshots
    held = {c: make(truth.select("block", "idx", F.col(c).alias("value")), ["block", "idx"], [], 10) for c in spans}
    fetch = control.Snapshots(held, spans, 10, deltas)
    out = control.retrieve_speed(fetch, (1.0, 1.0), 1e-4, names=("vx", "vy"), rounds=10)  # two variables will do
    got = {r.idx: math.hypot(r.vx, r.vy) for r in out.points.collect()}
    assert out.met and max(abs(got[i] - math.hypot(*r[:2])) for i, r in enumerate(v[0])) <= 1e-4
    bits = approx.segment_bits if deltas else approx.rung_bits
    assert out.bytes == sum(-(-100 * bits(i) // 8) for name in spans for i in fetch.read[name]) and len(fetch.read["vx"]) > 1


def test_control_of_blocks(spark):
    v, truth = _flow(spark, 40, blocks=5)
    truth = truth.withColumn("vz", F.when((F.col("block") != 3) | (F.col("idx") != 2), F.col("vz")))
    spans = {c: float(np.ptp(v[:, :, i])) for i, c in enumerate(("vx", "vy", "vz"))}
    held = {c: approx.snapshots(truth.select("block", "idx", F.col(c).alias("value")), ["block", "idx"], [], 10) for c in spans}
    points, state = control.retrieve_blocks(held, spans, (0.5,) * 3, 0.01, 10, rounds=6)
    got, told = {(r.block, r.idx): r for r in points.collect()}, {r.block: r for r in state.collect()}
    assert len(got) == 200 and len(told) == 5
    for b in range(5):
        # as each block would be done alone
        alone = control.Snapshots({c: x.where(F.col("block") == b) for c, x in held.items()}, spans, 10)
        out = control.retrieve_speed(alone, (0.5,) * 3, 0.01, rounds=6)
        assert (told[b].met, told[b].rounds, told[b].uncontrolled, told[b].elements) == (out.met, out.rounds, out.uncontrolled, 40) and abs(told[b].estimate - out.estimate) < 1e-12
        assert told[b].met == (b != 3) and (b == 3 or {i: got[b, i].vx for i in range(40)} == {r.idx: r.vx for r in out.points.collect()})


def test_grouped_layout():
    rng = np.random.default_rng(21)
    for n in (1, 31, 32, 33, 200):
        code = rng.integers(0, 1 << rng.integers(1, 13, n))
        code[40:80] = 0  # a group without a one
        sign = rng.random(n) < 0.5
        bodies = encode.pack_groups(code, sign, 12)
        got, signs = encode.unpack_groups(bodies, n, 12)
        assert (got == code).all() and (signs == (sign & (code > 0))).all()
        part, some = encode.unpack_groups(bodies[:5], n, 12)
        assert (part == code >> 7 << 7).all()
        rest, signs = encode.unpack_groups(bodies[5:], n, 12, 5, part, some)
        assert (rest == code).all() and (signs == (sign & (code > 0))).all()
    small = rng.integers(0, 16, 3200)
    assert len(encode.pack_groups(small, small > 8, 12)[3]) < 3200 // 8 / 4  # no words before a group's first plane


def test_predictors(spark):
    v = np.cumsum(np.random.default_rng(22).normal(size=120))
    rows = line(spark, v).unionByName(line(spark, v[::-1] * 2, 1)).withColumn("bound0", F.lit(0.01))
    for coded, back in [(approx.predict_lines(rows, ["block"]), approx.unpredict_lines), (approx.predict_boxes(rows, ["block"], [4, 5, 6]), lambda c, by: approx.unpredict_boxes(c, by, [4, 5, 6]))]:
        got = back(coded.select("block", "idx", "code", "bound0"), ["block"]).join(rows.select("block", "idx", "value"), ["block", "idx"]).collect()
        assert len(got) == 240 and all(abs(r.base - r.value) <= 0.01 + 1e-9 for r in got)
    smooth = approx.predict_lines(rows, ["block"]).agg(F.avg(F.abs("code"))).first()[0]
    assert smooth < rows.agg(F.avg(F.abs(approx.quantise(F.col("value"), F.col("bound0"))))).first()[0]


def test_delta_store(spark, tmp_path):
    v = np.random.default_rng(23).uniform(-4, 4, 90)
    field = line(spark, v).withColumn("var", F.lit("u")).unionByName(line(spark, [2.0] * 9, 1).withColumn("var", F.lit("w")))
    manifest = refactor.refactor_deltas(field, str(tmp_path / "d"), 16, (90,))
    rows = {r["var"]: r for r in manifest.collect()}
    assert rows["u"].num_segments == 16 and list(rows["u"].dims) == [90] and rows["u"].segment_sizes[:2] == [-(-90 * 3 // 8), 45] and not any(rows["w"].segment_sizes)
    for tau in (100.0, 0.5, 1e-9):
        got = {(r["var"], r.idx): r.value for r in refactor.reconstruct_deltas(spark, str(tmp_path / "d"), tau).collect()}
        assert len(got) == 99 and all(abs(got["u", i] - x) <= tau * (1 + 1e-6) for i, x in enumerate(v))


def test_buckets(spark, tmp_path):
    field = line(spark, np.cumsum(np.random.default_rng(24).normal(size=300))).withColumn("var", F.lit("u"))
    refactor.refactor(field, str(tmp_path / "s"), refactor.Config(2, 16))
    frags = spark.read.parquet(str(tmp_path / "s" / "fragments"))
    buckets = planner.merge_small(frags.select("block", "var", "level", "plane", "size"), ["block", "var"], 60)
    store.write_buckets(frags, buckets, str(tmp_path / "b"))
    of = {(r.level, r.plane): r.bucket for r in buckets.collect()}
    plan = lambda *n: spark.createDataFrame([(0, "u", i, x) for i, x in enumerate(n)], "block long, var string, level int, planes int")
    first = {(r.level, r.plane) for r in store.read_buckets(spark, str(tmp_path / "b"), plan(3, 1, 0)).collect()}
    assert first == {(k, p) for (k, p), b in of.items() if k < 2 and b <= of[k, (3, 1)[k] - 1]}
    more = {(r.level, r.plane) for r in store.read_buckets(spark, str(tmp_path / "b"), plan(9, 1, 5), plan(3, 1, 0)).collect()}
    assert more == {(k, p) for (k, p), b in of.items() if (k == 0 and of[0, 2] < b <= of[0, 8]) or (k == 2 and b <= of[2, 4])}


def test_write_at_offsets(spark, tmp_path):
    field = line(spark, [1, 2, 3], 4).unionByName(line(spark, [7, 8], 9)).unionByName(line(spark, [5], 2))
    got = store.write_at_offsets(field, str(tmp_path / "o")).orderBy("offset").collect()
    assert [(r.block, r.offset) for r in got] == [(2, 0), (4, 4), (9, 16)]
    assert np.frombuffer(b"".join(bytes(r.body) for r in got), "<f4").tolist() == [5, 1, 2, 3, 7, 8]


def test_precision_manifest(spark, tmp_path):
    field = line(spark, np.linspace(0, 8, 50)).withColumn("var", F.lit("u"))
    manifest = refactor.refactor_precision(field, str(tmp_path / "p"), refactor.Config(0, 20)).first()
    assert abs(manifest.approximator_eb - 0.008) < 1e-12


def test_lines_have_a_level_cap(spark, tmp_path):
    with pytest.raises(ValueError):
        refactor.refactor(line(spark, range(9)).withColumn("var", F.lit("u")), str(tmp_path / "s"), refactor.Config(5, 8))
    assert not (tmp_path / "s").exists()


def _runs_plan(levels, tau, err):
    """Step by step: of all runs of next planes of a level the one with the best mean gain per byte."""
    at = dict.fromkeys(levels, 0)
    while err >= tau:
        best = None
        for k in sorted(levels):
            for n in range(1, len(levels[k]) - at[k] + 1):
                run = levels[k][at[k] : at[k] + n]
                rate = sum(g for g, _ in run) / sum(s for _, s in run)
                if best is None or rate > best[0] + 1e-12:
                    best = rate, k, n
        if best is None:
            break
        _, k, n = best
        err -= sum(g for g, _ in levels[k][at[k] : at[k] + n])
        at[k] += n
    return at


def test_greedy_runs_by_brute_force(spark):
    rng = random.Random(25)
    rows, want = [], {}
    for case in range(20):
        levels = {k: [(rng.uniform(0.1, 9), rng.randint(1, 50)) for _ in range(7)] for k in range(3)}
        err = sum(g for v in levels.values() for g, _ in v)
        want[case] = _runs_plan(levels, err / 4, err)
        rows += [(case, k, p, s, g, err) for k, v in levels.items() for p, (g, s) in enumerate(v)]
    df = spark.createDataFrame([(*r[:4], r[4] / (r[5] / 4), 4.0) for r in rows], "block int, level int, plane int, size int, gain double, err0 double")
    got = planner.greedy_runs(df, 1.0, ["block"]).collect()
    assert len(got) == 60 and all(want[r.block][r.level] == r.planes for r in got)


def test_aligned_rmsf(spark):
    rng = np.random.default_rng(26)
    ref, rows, want = rng.normal(size=(12, 3)) * 4, [], []
    for f in range(6):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn *= np.sign(np.linalg.det(turn))
        p = ref.copy()
        p[8:] += rng.normal(size=(4, 3))  # the rest moves, the selection doesn't
        rows += [(f, i, *map(float, x @ turn + f)) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "frame int, atom int, x double, y double, z double")
    picks = {"stiff": spark.range(8).withColumnRenamed("id", "atom"), "all": spark.range(12).withColumnRenamed("id", "atom")}
    got = {(r.selection, r.atom): r.rmsf for r in trajectory.aligned_rmsf(df, picks).collect()}
    assert len(got) == 20 and all(got["stiff", i] < 1e-9 for i in range(8)) and min(got["all", i] for i in range(8, 12)) > 0.05


def test_contacts(spark):
    rng = np.random.default_rng(10)
    rows = [(f, a, *map(float, rng.uniform(0, 40, 3))) for f in range(2) for a in range(60)] + [(5, 0, 0.0, 0.0, 0.0), (5, 1, 10.0, 0.0, 0.0), (5, 2, 9.99, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame int, atom int, x double, y double, z double")
    for box in (None, (40.0, 40.0, 40.0)):
        want = set()
        for f, a, *p in rows:
            for g, b, *q in rows:
                if f == g and a < b:
                    d = np.array(q) - np.array(p)
                    if box:
                        d -= np.round(d / 40.0) * 40.0
                    if (d * d).sum() < 100.0:
                        want.add((f, a, b))
        assert {(r.frame, r.a, r.b) for r in trajectory.contacts(df, 10.0, box=box).collect()} == want
    assert (5, 0, 1) not in want and (5, 0, 2) in want  # at the cutoff isn't in touch


def test_align(spark):
    rng = np.random.default_rng(11)
    ref = rng.normal(size=(12, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    rows = [(0, i, *map(float, p)) for i, p in enumerate(ref)] + [(1, i, *map(float, p @ turn + 5)) for i, p in enumerate(ref)]
    df = spark.createDataFrame(rows, "frame int, atom int, x double, y double, z double")
    first = df.where("frame = 0")
    got = {r.frame: r.rmsd for r in trajectory.rmsd(trajectory.align(df, first), first).collect()}
    assert got[0] < 1e-9 and got[1] < 1e-9


def test_raw_files(spark, tmp_path):
    v = np.arange(1000, dtype="<f4") / 7
    (tmp_path / "f.bin").write_bytes(v.tobytes())
    got = store.read_raw(spark, str(tmp_path / "f.bin"))
    assert [r.value for r in got.orderBy("idx").collect()] == v.astype(float).tolist()
    store.write_raw(got, str(tmp_path / "out"), run=300)
    runs = spark.read.parquet(str(tmp_path / "out")).orderBy("first").collect()
    assert b"".join(bytes(r.body) for r in runs) == v.tobytes() and [r["first"] for r in runs] == [0, 1200, 2400, 3600]
    (tmp_path / "names").write_text("sim1 x\n\n  sim2\n")
    assert [r.sim for r in store.read_names(spark, str(tmp_path / "names")).collect()] == ["sim1", "sim2"]


def test_missing(spark, tmp_path):
    want = spark.range(5).withColumnRenamed("id", "sim")
    path = str(tmp_path / "done")
    assert store.missing(want, spark, path, ["sim"]).count() == 5
    want.where("sim < 2").write.parquet(path)
    assert sorted(r.sim for r in store.missing(want, spark, path, ["sim"]).collect()) == [2, 3, 4]


def test_state_stream(spark, tmp_path):
    from strataflow.streaming import steps

    rows = spark.createDataFrame([("u", 4), ("v", 2)], "var string, planes int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = steps.accumulate_planes(steps.step_source(spark, str(tmp_path / "in"), rows.schema), ["var"]).writeStream.format("memory").queryName("taken").outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["var"], r.taken, r.fresh) for r in spark.sql("SELECT * FROM taken").collect()} == {("u", 4, 4), ("v", 2, 2)}


def test_profiles(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(0, i, *((0.0,) * 3 if i % 10 == 0 else map(float, rng.normal(size=3)))) for i in range(100)]
    df = spark.createDataFrame(rows, "block long, idx long, velocity_x double, velocity_y double, velocity_z double")
    manifest = refactor.refactor_profile(df, str(tmp_path / "s"), "velocity")
    assert manifest.groupBy("var").agg(F.sum("n").alias("n")).select("n").distinct().first().n == 90
    with pytest.raises(ValueError):
        refactor.refactor_profile(df, str(tmp_path / "t"), "other")
