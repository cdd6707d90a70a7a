"""Golden cases: a program, sparse input rows and sparse expected rows.  Rows between entries repeat what was before."""

from __future__ import annotations

import math

from weftline.sdk import nodes as n

NAN = math.nan
X, Y = n.source("x"), n.source("y")


def dense(spec: dict[int, dict[str, float]], last: int = 300) -> list[dict[str, float]]:
    rows, now = [], {}
    for i in range(last + 1):
        now = {**now, **spec.get(i, {})}
        rows.append(now)
    return rows


def rows(**columns: list[float]) -> list[dict[str, float]]:
    return [dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)]


def steps(**points: float) -> list[float | None]:
    """A column from its changes, as r0=..., r10=...; NaN is null in the expected rows."""
    spec = {int(k[1:]): {"v": v} for k, v in points.items()}
    return [r["v"] for r in dense(spec)]


PAIRS = rows(x=[NAN, 4, NAN, 2, 6, -7, 6, 123, 7, 0], y=[NAN, 7, 8, -5, NAN, 22, 1, 0, 7, 234])
# What each binary operator gives for those rows.
BINARY = {
    "add": [NAN, 11, NAN, -3, NAN, 15, 7, 123, 14, 234],
    "sub": [NAN, -3, NAN, 7, NAN, -29, 5, 123, 0, -234],
    "mul": [NAN, 28, NAN, -10, NAN, -154, 6, 0, 49, 0],
    "div": [NAN, 4 / 7, NAN, -0.4, NAN, -7 / 22, 6, NAN, 1, 0],
    "mod": [NAN, 4, NAN, 2, NAN, -7, 0, NAN, 0, 0],
    "lt": [0, 1, 0, 0, 0, 1, 0, 0, 0, 1],
    "gt": [0, 0, 0, 1, 0, 0, 1, 1, 0, 0],
    "min": [NAN, 4, 8, -5, 6, -7, 1, 0, 7, 0],
    "max": [NAN, 7, 8, 2, 6, 22, 6, 123, 7, 234],
    "shrink": [NAN, 0, NAN, 7, NAN, 0, 5, 123, 0, 0],
}
ONE = steps(r0=NAN, r10=4, r50=-5, r51=6, r100=0, r200=-7)
UNARY = {
    "sgn": (0, 1, -1, 1, 0, -1),
    "abs": (NAN, 4, 5, 6, 0, 7),
    "inv": (NAN, 1 / 4, -1 / 5, 1 / 6, NAN, -1 / 7),
    "square": (NAN, 16, 25, 36, 0, 49),
    "sqrt": (NAN, 2, NAN, math.sqrt(6), 0, NAN),
    "exp": (NAN, math.exp(4), math.exp(-5), math.exp(6), 1, math.exp(-7)),
    "log": (NAN, math.log(4), NAN, math.log(6), NAN, NAN),
}
SPIKE = steps(r0=0, r10=1, r11=0)
WIDTHS = [2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100, 127, 128, 129, 255, 256, 257]


def rect(width: int) -> n.Window:
    return n.window_rect(n.f64(width))


def spiked(width: int) -> list[float]:
    """Without backfill the first width - 1 rows are null, later ones 1 / width while the spike is in reach."""
    return [NAN if i < width - 1 else 1 / width if 10 <= i < 10 + width else 0.0 for i in range(301)]


def cases() -> dict[str, tuple[dict[str, list], n.Node, list[float]]]:
    pairs = {k: [r[k] for r in PAIRS] for k in ("x", "y")}
    found = {f"binary_{op}": (pairs, n.call(op, X, Y), want) for op, want in BINARY.items()}
    for op, (a, b, c, d, e, f) in UNARY.items():
        found[f"unary_{op}"] = ({"x": ONE}, n.call(op, X), steps(r0=a, r10=b, r50=c, r51=d, r100=e, r200=f))
    filled = steps(r0=NAN, r10=4, r50=5, r51=6, r200=7)
    found["input"] = ({"x": filled}, X, filled)
    zeros = {"x": [0.0] * 301}
    found["arr"] = (zeros, n.call("add", X, n.to_ts(n.arr([n.f64(v) for v in (5, 6, 7, 8, 9)]))), steps(r0=5, r1=6, r2=7, r3=8, r4=9, r5=0))
    flat = lambda v: n.to_ts(n.f64(v))
    found["norm_large"] = (zeros, n.norm(flat(1e9), n.i64(4)), steps(r0=0.25, r4=0))
    found["norm_small"] = (zeros, n.norm(flat(1e-9), n.i64(200)), steps(r0=1 / 200, r200=0))
    found["norm_outside"] = (zeros, n.norm(flat(20), n.i64(100), False), steps(r0=0.01))
    found["norm_list"] = (zeros, n.norm(n.to_ts(n.arr([n.f64(v) for v in (1, 2, 5, 1, 1)])), n.i64(50)), steps(r0=0.1, r1=0.2, r2=0.5, r3=0.1, r5=0))
    for w in WIDTHS:
        found[f"conv_spike_{w}"] = ({"x": SPIKE}, n.conv(rect(w), X, True), [1 / w if 10 <= i < 10 + w else 0.0 for i in range(301)])
    for w in (2, 10, 64, 65, 129):
        found[f"conv_spike_open_{w}"] = ({"x": SPIKE}, n.conv(rect(w), X), spiked(w))
    found["conv_long"] = ({"x": SPIKE}, n.conv(rect(1000), X, True), steps(r0=0, r10=0.001))
    taps = [0.0] * 20
    taps[7], taps[14] = 0.4, 0.6
    kernel = n.Window("taps", n.i64(20), n.to_ts(n.arr([n.f64(t) for t in taps])))
    found["conv_kernel"] = ({"x": SPIKE}, n.conv(kernel, X, True), steps(r0=0, r17=0.4, r18=0, r24=0.6, r25=0))
    broken = steps(r0=1, r20=0, r150=NAN, r200=1)
    n1 = [NAN if i < 9 else float(sum(broken[i - 9 : i + 1])) / 10 for i in range(301)]
    found["conv_nan_1"] = ({"x": broken}, n.conv(rect(10), X), n1)
    known = steps(r0=1, r150=NAN, r180=1)
    found["conv_nan_2"] = ({"x": known}, n.conv(rect(100), X), steps(r0=NAN, r99=1, r150=NAN, r279=1))
    gap = steps(r0=1, r150=NAN, r200=1)
    n3 = [sum(v for v in gap[max(0, i - 9) : i + 1] if v == v) / 10 for i in range(301)]
    found["conv_nan_3"] = ({"x": gap}, n.conv(rect(10), X, True), n3)
    found["conv_nan_4"] = ({"x": steps(r0=0, r150=NAN, r200=0)}, n.conv(rect(100), X, True), [0.0] * 301)
    return found
