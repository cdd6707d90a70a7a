"""Queries of the time-series operators over ``events``, each with SQL that gives the same rows.

The series x and y are made from ``events`` in order of event_id, with NaN and 0 mixed in; z is the result, rounded to six
places, or to 8 to 11 digits from 1e5 on, null where it is not finite.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.ieee import finite
from weftline.operators.frame import IDX, indexed
from weftline.plans.program import metered, run
from weftline.sdk import models as m
from weftline.sdk import nodes as n
from weftline.sources.sinks import sample

_X = "CASE WHEN event_id % 17 = 0 THEN cast('NaN' AS double) WHEN event_id % 5 = 0 THEN cast(0 AS double) ELSE (value - 20) / 50 END"
_Y = "CASE WHEN event_id % 19 = 0 THEN cast('NaN' AS double) WHEN event_id % 7 = 0 THEN cast(0 AS double) ELSE cast((event_id * 7919) % 1000 - 500 AS double) / 100 END"
_W = "CASE WHEN event_id % 3 = 0 THEN " + _X + " END"
_BASE = f"b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, {_X} AS x, {_Y} AS y, {_W} AS w FROM events)"
_NAN = "'NaN'::DOUBLE"


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_X).alias("x"), F.expr(_Y).alias("y"), F.expr(_W).alias("w"))
    return indexed(events, ["event_id"]).select(IDX, "x", "y", "w")


#: Below each size, what a value is multiplied by, or divided by if it is larger, before it is rounded to a whole number: so
#: that a value of any size keeps fewer digits than a double has.
_ROUNDED = ((1e5, 1e6, 1.0), (1e8, 1e3, 1.0), (1e11, 1.0, 1.0), (1e14, 1.0, 1e3), (1e17, 1.0, 1e6), (1e20, 1.0, 1e9))


def _tidy(c: Column) -> Column:
    out = c
    for below, up, down in reversed(_ROUNDED):
        out = F.when(F.abs(c) < below, F.floor(c * up / down + 0.5).cast("double") / up * down).otherwise(out)
    return F.when(finite(c), out)


def _tidy_sql(z: str) -> str:
    rounded = " ".join(f"WHEN abs({z}) < {below} THEN floor({z} * {up} / {down} + 0.5) / {up} * {down}" for below, up, down in _ROUNDED)
    return f"CASE WHEN NOT isfinite({z}) THEN NULL {rounded} ELSE {z} END"


def _result(df: DataFrame) -> DataFrame:
    return df.select(IDX, *[_tidy(F.col(c).cast("double")).alias(c) for c in df.columns if c != IDX])


def _query(node: n.Node) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _result(run(frame(spark, d), [n.emit("z", node)]))


def _sql(z: str, source: str = "b", more: str = "") -> str:
    return f"WITH RECURSIVE {_BASE}{more}, r AS (SELECT idx, {z} AS z FROM {source}) SELECT idx, {_tidy_sql('z')} AS z FROM r"


X, Y, W = n.source("x"), n.source("y"), n.source("w")

# In SQL, NaN is the largest value and equal to itself, as in Spark; each form says what happens to it.
_UNARY = {
    "sgn": "CASE WHEN isnan(x) THEN 0 ELSE sign(x) END",
    "abs": "abs(x)",
    "inv": "1.0 / x",
    "square": "x * x",
    "sqrt": "CASE WHEN x < 0 THEN {nan} ELSE sqrt(x) END",
    "cbrt": "cbrt(x)",
    "exp": "exp(x)",
    "log": "CASE WHEN x <= 0 THEN {nan} ELSE ln(x) END",
    "expm1": "exp(x) - 1",
    "log1p": "CASE WHEN x <= -1 THEN {nan} ELSE ln(1 + x) END",
    "sigmoid": "1 / (1 + exp(-x))",
    "sin": "CASE WHEN isnan(x) THEN x ELSE sin(x) END",
    "cos": "CASE WHEN isnan(x) THEN x ELSE cos(x) END",
    "tan": "CASE WHEN isnan(x) THEN x ELSE tan(x) END",
    "asin": "CASE WHEN isnan(x) OR abs(x) > 1 THEN {nan} ELSE asin(x) END",
    "acos": "CASE WHEN isnan(x) OR abs(x) > 1 THEN {nan} ELSE acos(x) END",
    "atan": "atan(x)",
    "sinh": "sinh(x)",
    "cosh": "cosh(x)",
    "tanh": "tanh(x)",
    "asinh": "asinh(x)",
    "acosh": "CASE WHEN isnan(x) OR x < 1 THEN {nan} ELSE acosh(x) END",
    "atanh": "CASE WHEN isnan(x) OR abs(x) >= 1 THEN {nan} ELSE atanh(x) END",
    "lgamma": "CASE WHEN x = 0 THEN {nan} ELSE lgamma(x) END",
    "tgamma": "CASE WHEN x = 0 THEN {nan} ELSE gamma(x) END",
    "floor": "floor(x)",
    "ceil": "ceil(x)",
    "round": "CASE WHEN x < 0 THEN -floor(-x + 0.5) ELSE floor(x + 0.5) END",
    "not": "CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END",
    "is_nan": "CASE WHEN isnan(x) THEN 1.0 ELSE 0.0 END",
    "is_num": "CASE WHEN isnan(x) THEN 0.0 ELSE 1.0 END",
}
_EITHER = "isnan(x) OR isnan(y)"
_BINARY = {
    "add": "x + y",
    "sub": "x - y",
    "mul": "x * y",
    "div": "x / y",
    "mod": "CASE WHEN isnan(x) OR isnan(y) OR y = 0 THEN {nan} ELSE x - y * trunc(x / y) END",
    "pow": "CASE WHEN x = 1 OR y = 0 THEN 1.0 WHEN isnan(x) OR isnan(y) OR (x = 0 AND y < 0) OR (x < 0 AND y <> trunc(y)) THEN {nan} ELSE pow(x, y) END",
    "atan2": "CASE WHEN isnan(x) OR isnan(y) THEN {nan} ELSE atan2(x, y) END",
    "lt": "CASE WHEN {either} THEN 0.0 WHEN x < y THEN 1.0 ELSE 0.0 END",
    "lte": "CASE WHEN {either} THEN 0.0 WHEN x <= y THEN 1.0 ELSE 0.0 END",
    "gt": "CASE WHEN {either} THEN 0.0 WHEN x > y THEN 1.0 ELSE 0.0 END",
    "gte": "CASE WHEN {either} THEN 0.0 WHEN x >= y THEN 1.0 ELSE 0.0 END",
    "eq": "CASE WHEN {either} THEN 0.0 WHEN x = y THEN 1.0 ELSE 0.0 END",
    "neq": "CASE WHEN {either} THEN 1.0 WHEN x <> y THEN 1.0 ELSE 0.0 END",
    "min": "CASE WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE least(x, y) END",
    "max": "CASE WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE greatest(x, y) END",
    "shrink": "CASE WHEN isnan(x) OR x = 0 THEN x WHEN isnan(y) THEN y WHEN x > 0 THEN CASE WHEN x <= y THEN 0.0 ELSE x - y END WHEN x >= -y THEN 0.0 ELSE x + y END",
    "clamp": "CASE WHEN isnan(x) THEN x WHEN isnan(y) THEN x WHEN x < y THEN greatest(-y, x) ELSE greatest(-y, y) END",
    "nan_to": "CASE WHEN isnan(x) THEN y ELSE x END",
}
_F = "CASE WHEN isfinite(x) THEN x ELSE 0 END"
_SUM = f", c AS (SELECT idx, sum({_F}) OVER (ORDER BY idx) AS s FROM b)"
_STEPS = """, s AS (SELECT idx, {first} AS s FROM b WHERE idx = 0 UNION ALL SELECT b.idx, {next} FROM s JOIN b ON b.idx = s.idx + 1)"""
_KERNEL = "a.idx - k.idx BETWEEN 0 AND {taps} - 1"


def _conv_sql(weight: str, taps: int, backfill: bool) -> str:
    bad = "FALSE" if backfill else f"a.idx < {taps - 1} OR max(CASE WHEN isnan(k.x) THEN 1 ELSE 0 END) = 1"
    body = f", c AS (SELECT a.idx, CASE WHEN {bad} THEN {_NAN} ELSE sum(CASE WHEN isnan(k.x) THEN 0 ELSE k.x END * ({weight})) END AS s FROM b a JOIN b k ON {_KERNEL.format(taps=taps)} GROUP BY a.idx)"
    return _sql("s", "c", body)


def _rect(taps: int) -> n.Window:
    return n.window_rect(n.f64(float(taps)))


_GAUSS = n.Window("gauss", n.i64(100), n.norm(n.gaussian(n.f64(30.0)), n.i64(100)))
_GAUSS_SQL = "exp(-power((a.idx - k.idx) / 30.0, 2)) / (SELECT sum(exp(-power(i / 30.0, 2))) FROM range(100) t(i))"
_RUN_LENGTH = m.runs(Y, 1)
# erf(x) = exp(-x^2) * sum of x^(2n + 1) / gamma(n + 3/2): all terms have one sign
_ERF = "(exp(-x * x) * (SELECT sum(power(x, 2 * i + 1) / gamma(i + 1.5)) FROM range(100) t(i)))"
_SIGNS = ", c AS (SELECT idx, sum(CASE WHEN isnan(y) THEN 0 ELSE sign(y) END) OVER (ORDER BY idx) AS s FROM b)"


def _states(rate: float, states: dict[str, str], source: str) -> str:
    """Common tables ``s`` (idx and each state): moving sums that decay by ``rate``, over rows of ``source``."""
    first = ", ".join(f"({v}) * {rate}::DOUBLE AS {k}" for k, v in states.items())
    after = ", ".join(f"s.{k} * (1 - {rate}::DOUBLE) + ({v}) * {rate}::DOUBLE" for k, v in states.items())
    return f", d AS ({source}), s AS (SELECT idx, {first} FROM d WHERE idx = 0 UNION ALL SELECT d.idx, {after} FROM s JOIN d ON d.idx = s.idx + 1)"


_ZERO_Y, _ZERO_X = (f"CASE WHEN isnan({c}) THEN 0::DOUBLE ELSE {c} END" for c in "yx")
_FIT = _states(1 / 50, {"sx": "t", "sy": "v", "sxy": "t * v", "sxx": "t * t"}, f"SELECT idx, idx * 1e-3::DOUBLE AS t, {_ZERO_Y} AS v FROM b")
_LAGGED = _states(1 / 100, {"sxy": "u * v", "sxx": "u * u"}, f"SELECT idx, coalesce(lag({_ZERO_X}) OVER (ORDER BY idx), 0::DOUBLE) AS u, {_ZERO_Y} AS v FROM b")

_OTHER: dict[str, tuple[n.Node, str | None]] = {
    "erf": (n.erf(X), _sql(_ERF)),
    "erfc": (n.erfc(X), _sql(f"1 - {_ERF}")),
    "input": (W, _sql(f"coalesce(last_value(w IGNORE NULLS) OVER (ORDER BY idx), {_NAN})")),
    "to_ts": (n.add(X, n.to_ts(n.f64(2.5))), _sql("x + 2.5")),
    "to_ts_array": (n.add(X, n.to_ts(n.arr([n.f64(v) for v in (5, 6, 7, 8, 9)]))), _sql("x + CASE WHEN idx < 5 THEN idx + 5 ELSE 0 END")),
    "seq": (n.seq(n.f64(0.25)), _sql("idx * 0.25")),
    "gaussian": (n.gaussian(n.f64(100.0)), _sql("exp(-power(idx / 100.0, 2))")),
    "cast_float": (n.f64(n.f32(Y)), _sql("cast(cast(y AS FLOAT) AS DOUBLE)")),
    "cond": (n.cond(X, Y, n.f64(7.0)), _sql("CASE WHEN x <> 0 THEN y ELSE 7 END")),
    "tri_cond": (n.tri_cond(X, Y, n.f64(7.0), n.mul(Y, n.f64(2.0))), _sql("CASE WHEN isnan(x) OR x = 0 THEN 7 WHEN x < 0 THEN y ELSE y * 2 END")),
    "delay": (n.delay(X, n.i64(3)), _sql("lag(x, 3) OVER (ORDER BY idx)")),
    "sub_delta": (n.sub_delta(X), _sql("x - lag(x) OVER (ORDER BY idx)")),
    "div_delta": (n.div_delta(Y), _sql("y / lag(y) OVER (ORDER BY idx)")),
    "norm": (n.norm(n.nan_to(X, n.f64(0.5)), n.i64(1000)), _sql("CASE WHEN idx < 1000 THEN CASE WHEN isnan(x) THEN 0.5 ELSE x END / (SELECT sum(CASE WHEN isnan(x) THEN 0.5 ELSE x END) FROM b WHERE idx < 1000) ELSE 0 END")),
    "dot": (n.dot([X, Y], [n.f64(2.0), n.f64(3.0)]), _sql("x * 2 + y * 3")),
    "dot_series": (n.dot([X, Y], [Y, Y]), _sql("x * y + y * y")),
    "cum_sum": (n.cum_sum(X), _sql(f"sum({_F}) OVER (ORDER BY idx)")),
    "cum_sum_clamped": (n.cum_sum_clamped(Y), _sql("s - least(0, min(s) OVER (ORDER BY idx))", "c", _SUM.replace("isfinite(x) THEN x", "isfinite(y) THEN y"))),
    "cum_prod": (n.cum_prod(n.add(n.f64(1.0), n.mul(n.nan_to(Y, n.f64(0.0)), n.f64(0.001)))), _sql("product(1 + 0.001 * CASE WHEN isnan(y) THEN 0 ELSE y END) OVER (ORDER BY idx)")),
    "cum_log_sum_exp": (n.cum_log_sum_exp(Y), _sql("ln(1 + sum(exp(CASE WHEN isfinite(y) THEN y ELSE 0 END)) OVER (ORDER BY idx))")),
    "fwd_fill_zero": (n.fwd_fill_zero(X), _sql("coalesce(last_value(CASE WHEN isfinite(x) AND x <> 0 THEN x END IGNORE NULLS) OVER (ORDER BY idx), 0)")),
    "monotonify": (n.monotonify(X), _sql(f"greatest(0, max({_F}) OVER (ORDER BY idx))")),
    "decaying_sum": (n.decaying_sum(X, n.f64(0.25)), _sql("s", "c", f", c AS (SELECT a.idx, sum(CASE WHEN isfinite(k.x) THEN k.x ELSE 0 END * 0.25 * power(0.75, a.idx - k.idx)) AS s FROM b a JOIN b k ON {_KERNEL.format(taps=200)} GROUP BY a.idx)")),
    "decaying_sum_by_row": (n.decaying_sum(X, n.mul(n.absolute(Y), n.f64(0.1))), _sql("s", "s", _STEPS.format(first="CASE WHEN isfinite(x) AND isfinite(y) THEN x * abs(y) * 0.1 ELSE 0 END", next="CASE WHEN isfinite(y) THEN s.s * (1 - abs(y) * 0.1) + CASE WHEN isfinite(x) THEN x ELSE 0 END * abs(y) * 0.1 ELSE s.s END"))),
    "slow_pass_zero": (n.slow_pass_zero(Y), _sql("s", "s", _STEPS.format(first="CASE WHEN isfinite(y) THEN y ELSE 0 END", next="CASE WHEN s.s < -1 THEN s.s + 1 WHEN s.s > 1 THEN s.s - 1 WHEN isnan(y) THEN s.s WHEN s.s < 0 THEN CASE WHEN y > 0 THEN y ELSE s.s END WHEN s.s > 0 THEN CASE WHEN y < 0 THEN y ELSE s.s END ELSE y END"))),
    "scan_if": (n.scan_if(n.gt(Y, n.f64(-3.0)), X, n.f64(0.5)), _sql("coalesce(last_value(CASE WHEN isnan(y) OR NOT y > -3 THEN x END IGNORE NULLS) OVER (ORDER BY idx), 0.5)")),
    "conv_rect": (n.conv(_rect(10), X), _conv_sql("0.1", 10, False)),
    "conv_rect_backfill": (n.conv(_rect(10), X, True), _conv_sql("0.1", 10, True)),
    "conv_gaussian": (n.conv(_GAUSS, n.nan_to(X, n.f64(0.0))), _conv_sql(_GAUSS_SQL, 100, False).replace(_X, f"CASE WHEN isnan({_X}) THEN 0 ELSE {_X} END")),
    "conv_gaussian_backfill": (n.conv(_GAUSS, X, True), _conv_sql(_GAUSS_SQL, 100, True)),
    "regression": (m.Regression(n.seq(n.f64(1e-3)), n.nan_to(Y, n.f64(0.0)), lambda s: m.decay(50, s)).slope, _sql("(sxy - sx * sy) / (sxx - sx * sx)", "s", _FIT)),
    "runs": (_RUN_LENGTH, _sql("(s - least(0, min(s) OVER (ORDER BY idx))) - (-s - least(0, min(-s) OVER (ORDER BY idx)))", "c", _SIGNS)),
    "significance": (m.significance(n.nan_to(Y, n.f64(0.0)), [20, 40], lambda s: n.window_simple(n.f64(float(s)))), None),
    "solve": (m.coefficients([n.nan_to(X, n.f64(0.0))], n.nan_to(Y, n.f64(0.0)), 100, 1)[0], _sql("sxy / sxx", "s", _LAGGED)),
}


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    """One series for each user: cumulative sum and delay."""
    events = indexed(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.expr(_X).alias("x")), ["event_id"], ["user_id"]).select("user_id", IDX, "x")
    out = run(events, [n.emit("total", n.cum_sum(X)), n.emit("before", n.delay(X, n.i64(2)))], by=["user_id"])
    return out.select("user_id", IDX, _tidy(F.col("total")).alias("total"), _tidy(F.col("before")).alias("before"))


def _meter(spark: SparkSession, d: str) -> DataFrame:
    return _result(metered(frame(spark, d), [n.meter("z", n.square(X))], [3, 100, 500]))


def _plot(spark: SparkSession, d: str) -> DataFrame:
    return sample(_result(run(frame(spark, d), [n.emit("z", n.square(X))])), 100, 900, 100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"series_{k}": _query(n.call(k, X)) for k in _UNARY}
    found |= {f"series_{k}": _query(n.call(k, X, Y)) for k in _BINARY}
    found |= {f"series_{k}": _query(node) for k, (node, _) in _OTHER.items()}
    return found | {"series_by_user": _by_user, "series_meter": _meter, "series_plot_sample": _plot}


def oracle_sql() -> dict[str, str]:
    found = {f"series_{k}": _sql(z.format(nan=_NAN)) for k, z in _UNARY.items()}
    found |= {f"series_{k}": _sql(z.format(nan=_NAN, either=_EITHER)) for k, z in _BINARY.items()}
    found |= {f"series_{k}": sql for k, (_, sql) in _OTHER.items() if sql}
    per_user = f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id, {_X} AS x FROM events"
    found["series_by_user"] = f"WITH u AS ({per_user}), r AS (SELECT user_id, idx, sum({_F}) OVER (PARTITION BY user_id ORDER BY idx) AS total, lag(x, 2) OVER (PARTITION BY user_id ORDER BY idx) AS before FROM u) SELECT user_id, idx, {_tidy_sql('total')} AS total, {_tidy_sql('before')} AS before FROM r"
    found["series_meter"] = f"SELECT * FROM ({_sql('x * x')}) WHERE idx IN (3, 100, 500)"
    found["series_plot_sample"] = f"SELECT * FROM ({_sql('x * x')}) WHERE idx >= 100 AND idx < 900 AND (idx - 100) % 8 = 0"
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several operators in one program over the events' series."""
    smooth = n.conv(n.window_simple(n.f64(8.0)), n.nan_to(X, n.f64(0.0)), True)
    program = [n.emit("y", n.square(X)), n.emit("total", n.cum_sum(X)), n.emit("smooth", smooth), n.emit("fast", n.decaying_sum(X, n.f64(1 / math.e)))]
    return run(frame(spark, sf_dir), program)
