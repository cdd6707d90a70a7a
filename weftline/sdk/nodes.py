"""Calls as tuples, and the rewrites that are made while a program is built."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from weftline.plans.calls import Call, digest

Node = Any


@dataclass(frozen=True)
class Window:
    """A convolution kernel: its name, its width (an int64 call) and its values (a series call)."""

    name: str
    width: Node
    kernel: Node


def call(name: str, *args: Node) -> Node:
    return Call((name, *args))


def constant(x: Node) -> float | None:
    """The number that a literal or a cast literal holds."""
    if isinstance(x, int | float) and not isinstance(x, bool):
        return x
    if isinstance(x, tuple) and x[0] == "meta":
        return constant(x[1])
    is_cast = isinstance(x, tuple) and x[0] in ("cast_float", "cast_double", "cast_int64")
    return x[1] if is_cast and isinstance(x[1], int | float) else None


def _cast(kind: str) -> Callable[[Node], Node]:
    def build(x: Node) -> Node:
        known = constant(x)
        return call(f"cast_{kind}", x if known is None else known)

    return build


f32, f64, i64 = _cast("float"), _cast("double"), _cast("int64")
real = f64


def _plain(name: str) -> Callable[..., Node]:
    return lambda *args: call(name, *args)


# Calls without a rewrite, by the name that Python code uses.
(sgn, absolute, inv, square, sqrt, cbrt, exp, log, expm1, log1p, sigmoid, sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, asinh, acosh, atanh, erf, erfc, lgamma, tgamma, floor, ceil, rounded, negated, is_nan, is_num) = map(
    _plain, "sgn abs inv square sqrt cbrt exp log expm1 log1p sigmoid sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh erf erfc lgamma tgamma floor ceil round not is_nan is_num".split()
)
(mod, atan2, lt, lte, gt, gte, eq, neq, minimum, maximum, shrink, clamp, nan_to, tri_cond) = map(_plain, "mod atan2 lt lte gt gte eq neq min max shrink clamp nan_to tri_cond".split())
(cum_sum, cum_sum_clamped, cum_prod, cum_log_sum_exp, fwd_fill_zero, monotonify, slow_pass_zero, decaying_sum, scan_if, sub_delta, div_delta) = map(
    _plain, "cum_sum cum_sum_clamped cum_prod cum_log_sum_exp fwd_fill_zero monotonify slow_pass_zero decaying_sum scan_if sub_delta div_delta".split()
)
(source, to_ts, seq, gaussian, check_eq, info, drawn, meter) = map(_plain, "input to_ts seq gaussian check_eq info drawn meter".split())


def arr(items: Sequence[Node]) -> Node:
    return call("arr", *items)


def add(a: Node, b: Node) -> Node:
    if constant(a) == 0:
        return b
    return a if constant(b) == 0 else call("add", a, b)


def sub(a: Node, b: Node) -> Node:
    return a if constant(b) == 0 else call("sub", a, b)


def mul(a: Node, b: Node) -> Node:
    if constant(a) == 1:
        return b
    if constant(b) == 1:
        return a
    return square(a) if a == b and isinstance(a, tuple) else call("mul", a, b)


def div(a: Node, b: Node) -> Node:
    if constant(a) == 1:
        return inv(b)
    return call("div", a, b) if constant(b) is None else mul(a, inv(b))


_POWERS: dict[float, Callable[[Node], Node]] = {-1: inv, 0.5: sqrt, 1 / 3: cbrt, 1: lambda a: a, 2: square}


def power(a: Node, b: Node) -> Node:
    special = _POWERS.get(constant(b)) if constant(b) is not None else None
    return special(a) if special else call("pow", a, b)


def cond(a: Node, b: Node, c: Node) -> Node:
    return b if b == c else call("cond", a, b, c)


def delay(a: Node, rows: Node) -> Node:
    return a if constant(rows) == 0 else call("delay", a, rows)


def dot(a: Sequence[Node], b: Sequence[Node]) -> Node:
    return call("dot", arr(a), arr(b))


def norm(a: Node, rows: Node, zero_outside: bool = True) -> Node:
    return call("norm", a, rows, zero_outside)


def conv(window: Window, x: Node, backfill: bool = False) -> Node:
    return call("conv", window.kernel, x, info(f"{window.name} width", window.width), backfill)


def emit(key: str, value: Node) -> Node:
    return call("emit", key, value, digest(value))


# The colours of plots, in turn.
COLORS = (0x1F77B4, 0xFF7F0E, 0x2CA02C, 0xD62728, 0x9467BD, 0x8C564B, 0xE377C2, 0x7F7F7F, 0xBCBD22, 0x17BECF)


def _rgba(color: int) -> list[float]:
    return [*(byte / 255 for byte in color.to_bytes(3, "big")), 0]


def plot(name: str, value: Node, offset: bool = False, enabled: bool = True, color: int = COLORS[0]) -> Node:
    return call("plot", name, value, offset, enabled, *_rgba(color))


def drawing(name: str, enabled: bool = True, color: int = COLORS[0]) -> Node:
    return call("drawing", name, enabled, *_rgba(color))


# -- windows


def _gaussian_reach(scale: Node, precision: float) -> Node:
    """Rows after which a gaussian of this scale is below ``precision``."""
    return i64(add(mul(f64(math.sqrt(-math.log(precision))), scale), f64(1.0)))


def window_rect(scale: Node) -> Window:
    """Equal weights."""
    return Window("window_rect", i64(scale), norm(to_ts(inv(scale)), i64(scale)))


def window_simple(scale: Node, precision: float = 1e-9) -> Window:
    """Half a gaussian."""
    width = _gaussian_reach(scale, precision)
    return Window("window_simple", width, norm(gaussian(scale), width))


def window_smooth(scale: Node, ratio: Node = ("cast_double", 2), precision: float = 1e-9) -> Window:
    """A gaussian less a wider one: no jump at the newest row."""
    wide = mul(scale, ratio)
    width = _gaussian_reach(maximum(scale, wide), precision)
    return Window("window_smooth", width, norm(sub(gaussian(scale), gaussian(wide)), width))


def window_delta(scale: Node, ratio: Node = ("cast_double", 2), precision: float = 1e-9) -> Window:
    """A narrow average less a wide one."""
    wide = mul(scale, ratio)
    width = _gaussian_reach(maximum(scale, wide), precision)
    return Window("window_delta", width, sub(norm(gaussian(scale), width), norm(gaussian(wide), width)))


def window_log(scale: Node, sharpness: Node = ("cast_double", 1), precision: float = 1e-9) -> Window:
    """A gaussian of the logarithm of the age, less the line from 0 to its last value."""
    falling = mul(sharpness, f64(-1))
    width = i64(add(mul(exp(sqrt(div(f64(math.log(precision)), falling))), scale), f64(1.0)))

    def weight(age: Node) -> Node:
        return exp(mul(square(log(age)), falling))

    line = seq(div(weight(div(f64(width), scale)), f64(width)))
    return Window("window_log", width, norm(sub(weight(seq(inv(scale))), line), width))


# -- lists of series


def balanced(op: Callable[[Node, Node], Node], items: Sequence[Node]) -> Node:
    """A reduction as a balanced tree, whose order of rounding doesn't depend on how it is run."""
    if not items:
        raise ValueError("nothing to reduce")
    if len(items) == 1:
        return items[0]
    half = len(items) // 2
    return op(balanced(op, items[:half]), balanced(op, items[half:]))


def total(items: Sequence[Node]) -> Node:
    return balanced(add, items)


def average(items: Sequence[Node]) -> Node:
    return div(total(items), real(len(items)))


def magnitude(items: Sequence[Node]) -> Node:
    return sqrt(total([square(x) for x in items]))


def unit(items: Sequence[Node]) -> list[Node]:
    length = magnitude(items)
    return [div(x, length) for x in items]


def times_vector(matrix: Sequence[Sequence[Node]], vector: Sequence[Node]) -> list[Node]:
    return [dot(row, vector) for row in matrix]


def geometric(low: float, high: float, steps: int) -> list[float]:
    return [math.exp(x) for x in linear(math.log(low), math.log(high), steps)]


def linear(low: float, high: float, steps: int) -> list[float]:
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]


def raised(x: Node, factor: float, offset: float = 10.3) -> Node:
    return add(mul(x, real(factor)), real(offset))


# -- text


def dumps(program: Sequence[Node]) -> str:
    """JSON in which a call that was written before is a ``$ref`` to its place."""
    places: dict[Any, str] = {}

    def written(node: Node, path: str) -> Any:
        if not isinstance(node, tuple | list):
            return node
        key = digest(node)
        if key in places:
            return {"$ref": places[key]}
        places[key] = path
        return [written(x, f"{path}/{i}") for i, x in enumerate(node)]

    return json.dumps(written(tuple(program), "#"))


def composed(first: Node, *steps: Callable[[Node], Node]) -> Node:
    return reduce(lambda x, step: step(x), steps, first)
