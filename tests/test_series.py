import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import ieee, special
from weftline.operators import scan, shift
from weftline.operators.convolve import convolve, drawn
from weftline.operators.frame import indexed
from weftline.plans.program import ProgramError, evaluate, metered, parse, run
from weftline.sdk import models as m
from weftline.sdk import nodes as n
from weftline.sources import json_lines, sinks

VALUES = [0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 0.5, 1e300, -1e10, math.inf, -math.inf, math.nan, 3.0, -0.3]
FINITE = lambda v: v if math.isfinite(v) else 0.0


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-12)


def series(spark, xs, **more):
    names = ["x", *more]
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(xs, *more.values(), strict=True))], "idx long, " + ", ".join(f"{k} double" for k in names))


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(3)
    return [math.nan if rng.random() < 0.05 else math.inf if rng.random() < 0.02 else 0.0 if rng.random() < 0.2 else rng.uniform(-3, 3) for _ in range(500)]


def test_unary_follows_numpy(spark):
    df = series(spark, VALUES)
    plain = {"sqrt": np.sqrt, "log": np.log, "log1p": np.log1p, "expm1": np.expm1, "inv": lambda v: np.divide(1.0, v), "floor": np.floor, "ceil": np.ceil, "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh, "cbrt": np.cbrt, "sin": np.sin, "tanh": np.tanh, "asin": np.arcsin}
    with np.errstate(all="ignore"):
        for name, f in plain.items():
            got = [r[0] for r in df.orderBy("idx").select(ieee.UNARY[name](df.x)).collect()]
            want = f(np.array(VALUES))
            assert all(same(a, float(b)) for a, b in zip(got, want, strict=True)), (name, got, want)
    got = [r[0] for r in df.orderBy("idx").select(ieee.UNARY["sgn"](df.x)).collect()]
    assert got[11] == 0 and got[9] == 1 and got[10] == -1


def test_binary_follows_c(spark):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    df = series(spark, [a for a, _ in pairs], y=[b for _, b in pairs])
    plain = {"div": np.divide, "mod": np.fmod, "min": np.fmin, "max": np.fmax, "atan2": np.arctan2, "lt": lambda a, b: (a < b) * 1.0, "gte": lambda a, b: (a >= b) * 1.0, "eq": lambda a, b: (a == b) * 1.0, "neq": lambda a, b: (a != b) * 1.0}
    x, y = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    with np.errstate(all="ignore"):
        for name, f in plain.items():
            got = [r[0] for r in df.orderBy("idx").select(ieee.BINARY[name](df.x, df.y)).collect()]
            bad = [(p, a, float(b)) for p, a, b in zip(pairs, got, f(x, y), strict=True) if not same(a, float(b))]
            assert not bad, (name, bad[:5])


def test_special_functions(spark):
    df = series(spark, [0.5, -0.5, 0.0, -2.0, 5.0, math.inf, math.nan, 200.0])
    got = {k: [r[0] for r in df.orderBy("idx").select(special.UNARY[k](df.x).alias("v")).collect()] for k in special.UNARY}
    assert math.isclose(got["erf"][0], math.erf(0.5), rel_tol=1e-14) and got["tgamma"][4] == 24 and math.isinf(got["tgamma"][7]) and math.isinf(got["lgamma"][3])
    assert got["tgamma"][2] == math.inf


def folded(xs, start, f):
    out, s = [], start
    for x in xs:
        s = f(s, FINITE(x))
        out.append(s)
    return out


def slow(s, x):
    if s < 0:
        return s + 1 if s < -1 else x if x > 0 else s
    if s > 0:
        return s - 1 if s > 1 else x if x < 0 else s
    return x


@pytest.mark.parametrize("blocks", [65_536, 64])
def test_scans_follow_loops(spark, noisy, blocks, monkeypatch):
    from weftline.operators import frame

    monkeypatch.setattr(frame.block, "__defaults__", (blocks,))
    df = series(spark, noisy)
    wanted = {
        scan.cumulative_sum: folded(noisy, 0.0, lambda s, x: s + x),
        scan.clamped_sum: folded(noisy, 0.0, lambda s, x: max(0.0, s + x)),
        scan.running_maximum: folded(noisy, 0.0, max),
        scan.fill_zeros: folded(noisy, 0.0, lambda s, x: x or s),
        scan.log_sum_exp: folded(noisy, 0.0, lambda s, x: float(np.logaddexp(s, x))),
        scan.slow_pass_zero: folded(noisy, 0.0, slow),
    }
    for f, want in wanted.items():
        got = [r.z for r in f(df, "x", "z").orderBy("idx").collect()]
        assert np.allclose(got, want, atol=1e-9), f.__name__
    got = [r.z for r in scan.decaying_sum(df, "x", df.x * 0 + 0.25, "z").orderBy("idx").collect()]
    want, s = [], 0.0
    for x in noisy:
        r = 0.25 if math.isfinite(x) else 0.0
        s = s * (1 - r) + FINITE(x) * r
        want.append(s)
    assert np.allclose(got, want, atol=1e-9)
    got = [r.z for r in shift.delay(df, "x", "z", 70).orderBy("idx").collect()]
    assert all(same(a, b) for a, b in zip(got, [math.nan] * 70 + noisy[:-70], strict=True))


def test_product_and_hold(spark):
    xs = [1.0, 2.0, 0.5, math.nan, 3.0]
    df = series(spark, xs)
    assert [r.z for r in scan.cumulative_product(df, "x", "z").orderBy("idx").collect()] == [1, 2, 1, 0, 0]
    held = run(df, [n.emit("z", n.scan_if(n.gt(n.source("x"), n.f64(0.9)), n.source("x"), n.f64(9.0)))])
    assert [r.z for r in held.orderBy("idx").collect()] == [9, 9, 0.5, None, None]


def test_convolution_direct_and_fft(spark, noisy):
    df = series(spark, noisy)
    x = np.nan_to_num(np.array(noisy), nan=0.0, posinf=1.0)
    df = series(spark, [v if not math.isinf(v) else 1.0 for v in noisy])
    for taps in (5, 64, 65, 300):
        kernel = np.random.default_rng(taps).normal(size=taps)
        got = [r.z for r in convolve(df, "x", kernel, "z", True).orderBy("idx").collect()]
        assert np.allclose(got, np.convolve(x, kernel)[: len(x)], atol=1e-9)


def test_keys_are_series_of_their_own(spark):
    data = [(k, i, float(i * (k + 1))) for k in range(3) for i in range(10)]
    df = indexed(spark.createDataFrame(data, "k int, t int, x double"), ["t"], ["k"]).select("k", "idx", "x")
    got = run(df, [n.emit("z", n.cum_sum(n.source("x"))), n.emit("d", n.sub_delta(n.source("x")))], by=["k"]).collect()
    assert {(r.k, r.idx): (r.z, r.d) for r in got}[2, 3] == (18.0, 3.0) and len(got) == 30


def test_index_without_keys(spark):
    df = indexed(spark.range(1000).selectExpr("(id * 7919) % 1000 as t"), ["t"])
    assert all(r.t == r.idx for r in df.collect())


def test_float_series_and_types(spark):
    df = series(spark, [0.1, 0.2])
    x = n.f32(n.source("x"))
    got = [r.z for r in run(df, [n.emit("z", n.call("add", x, n.f32(0.2)))]).orderBy("idx").collect()]
    assert got == [float(np.float32(np.float32(0.1) + np.float32(0.2))), float(np.float32(0.2) + np.float32(0.2))]
    assert run(df, [n.emit("z", n.call("add", x, n.f64(0.2)))]).columns == ["idx"]  # kinds don't mix; the call is left out
    with pytest.raises(AssertionError):
        evaluate(df, [n.check_eq(n.f64(1), n.f64(2))])


def test_program_text_and_references(spark):
    df = series(spark, [1.0, 2.0])
    program = [n.emit("a", n.square(n.source("x"))), n.emit("b", n.call("add", n.square(n.source("x")), n.f64(1.0)))]
    text = n.dumps(program)
    assert "$ref" in text and json.loads(text)
    assert parse(text)[1][2][1] == ("square", ("input", "x"))
    assert [(r.a, r.b) for r in run(df, text).orderBy("idx").collect()] == [(1, 2), (4, 5)]
    assert [r.y for r in run(df, '[["emit","y",["square",["cast_double",["input","x"]]]]]').orderBy("idx").collect()] == [1, 4]


def test_bad_calls_are_left_out_and_meters(spark):
    df = series(spark, [1.0, 2.0, 3.0])
    out = run(df, [n.emit("a", n.call("nope", n.source("x"))), n.emit("b", n.source("x")), n.emit("c", n.delay(n.source("x"), n.i64(-1)))])
    assert out.columns == ["idx", "b"]
    assert [(r.idx, r.m) for r in metered(df, [n.meter("m", n.source("x"))], [2, 0]).collect()] == [(2, 3.0), (0, 1.0)]
    with pytest.raises(ProgramError):
        metered(df, [], [0.5])


def test_rewrites():
    x = n.source("x")
    assert n.add(x, n.f64(0)) == x and n.mul(x, x) == n.square(x) and n.power(x, n.f64(0.5)) == n.sqrt(x)
    assert n.div(n.f64(1), x) == n.inv(x) and n.cond(x, x, x) == x and n.delay(x, n.i64(0)) == x


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x":1}\n{}\n{"x":null}\n{"x":"a"}\n[1]\nnot json\n{"y":5}\n')
    df = json_lines.read(spark, str(tmp_path), ["x", "y"])
    got = [(r.x, r.y) for r in run(df, [n.emit("x", n.source("x")), n.emit("y", n.source("y"))]).orderBy("idx").collect()]
    assert got == [(1, None), (1, None), (None, None), (None, None), (None, 5)]
    with pytest.raises(ValueError, match="z"):
        json_lines.read(spark, str(tmp_path), ["z"])
    assert json_lines.keys_of(spark, str(tmp_path)) == ["x", "y"]


def test_sinks(spark):
    df = series(spark, [1.0, math.nan, 3.0])
    assert [r.value for r in sinks.json_lines(df, ["x"]).orderBy("idx").collect()] == ['{"x":1.0}', '{"x":null}', '{"x":3.0}']
    data = b"".join(r.data for r in sinks.binary_rows(df, ["x"]).orderBy("idx").collect())
    assert np.array_equal(np.frombuffer(data), [1.0, math.nan, 3.0], equal_nan=True)
    assert sinks.value_at(series(spark, [1.0, 2.0]), "x", 0.25) == 1.25
    low, high = sinks.fitted_range(df, "x")
    assert math.isclose(low, 0.9) and math.isclose(high, 3.1)


def test_drawn(spark):
    points = spark.createDataFrame([(1.0, 10.0), (3.0, 20.0)], "x double, y double")
    got = [r.z for r in drawn(series(spark, [0.0] * 5), points, "z").orderBy("idx").collect()]
    assert math.isnan(got[0]) and got[1:4] == [10, 15, 20] and math.isnan(got[4])


def test_linear_algebra(spark):
    df = series(spark, [0.0])
    a = [[2.0, 1.0, 0.5], [1.0, 3.0, -1.0], [0.0, 1.0, 4.0]]
    want = [1.0, -2.0, 0.5]
    right = [sum(p * q for p, q in zip(row, want, strict=True)) for row in a]
    found = m.solve([[n.to_ts(n.f64(v)) for v in row] for row in a], [n.to_ts(n.f64(v)) for v in right])
    row = run(df, [n.emit(f"s{i}", x) for i, x in enumerate(found)]).first()
    assert np.allclose([row.s0, row.s1, row.s2], want)


def test_empty_frame(spark):
    df = spark.createDataFrame([], "idx long, x double")
    assert run(df, [n.emit("a", n.cum_sum(n.source("x"))), n.emit("b", n.slow_pass_zero(n.source("x")))]).count() == 0


def test_principal_component_of_shared_calls(spark):
    """Eight rounds over three series: programs are graphs, so their size grows with the rounds and not as a power of them."""
    rng = random.Random(12)
    data = np.array([[rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 1)] for _ in range(40)])
    data[:, 2] += data[:, 1]
    centred = [n.source(c) for c in "xyz"]
    found = m.principal(10.0, centred, [1.0, 0.5, 0.25], rounds=8)
    program = [n.emit(c, v) for c, v in zip("abc", found, strict=True)]
    text = n.dumps(program)
    assert len(text) < 40_000 and n.dumps(parse(text)) == text
    df = series(spark, data[:, 0], y=data[:, 1], z=data[:, 2])
    got = np.array([list(r)[1:] for r in run(df, text).orderBy("idx").collect()])
    matrix = np.zeros((3, 3))
    for row, values in enumerate(data):
        matrix = matrix * 0.9 + np.outer(values, values) * 0.1
        v = np.array([1.0, 0.5, 0.25])
        for _ in range(8):
            v = matrix @ (v / np.sqrt(v @ v))
        assert np.allclose(got[row], v, rtol=1e-9), row


def test_special_functions_over_their_domain(spark):
    xs = [*np.linspace(-30, 30, 601).tolist(), 171.5, 172.5, -170.5, -200.25, 1e10]
    rows = series(spark, xs).select("idx", *[f(F.col("x")).alias(k) for k, f in special.UNARY.items()]).collect()

    def whole(f, x):
        try:
            return f(x)
        except (ValueError, OverflowError):
            return None

    for r in rows:
        for name, f in (("erf", math.erf), ("erfc", math.erfc), ("lgamma", math.lgamma), ("tgamma", math.gamma)):
            want = whole(f, xs[r.idx])
            assert want is None or want == 0 or math.isclose(r[name], want, rel_tol=3e-12, abs_tol=1e-13 if name == "lgamma" else 1e-300), (name, xs[r.idx], r[name], want)


def test_power_over_its_domain(spark):
    rng = random.Random(4)
    pairs = [(rng.choice([rng.uniform(-5, 5), float(rng.randint(-4, 4))]), rng.choice([rng.uniform(-9, 9), float(rng.randint(-5, 5))])) for _ in range(500)]
    got = series(spark, [a for a, _ in pairs], y=[b for _, b in pairs]).select("idx", ieee.BINARY["pow"](F.col("x"), F.col("y")).alias("v")).collect()
    with np.errstate(all="ignore"):
        for r in got:
            assert same(r.v, float(np.power(*pairs[r.idx]))), pairs[r.idx]
