"""Row-local functions on double Columns with plain IEEE-754 results.

Spark orders NaN as the largest value and equal to itself, throws on a division by zero in ANSI mode and returns null for
some logarithms.  These forms give what C gives: comparisons with NaN are false, 1 / 0 is inf, log(0) is -inf.  NaN stands
for a missing value; a null never comes out of a column that has none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(math.nan)


def inf() -> Column:
    return F.lit(math.inf)


def finite(a: Column) -> Column:
    return ~F.isnan(a) & (F.abs(a) < inf())


def finite_or_zero(a: Column) -> Column:
    return F.when(finite(a), a).otherwise(F.lit(0.0))


def as_double(p: Column) -> Column:
    return F.when(p, F.lit(1.0)).otherwise(F.lit(0.0))


def _negative_sign(a: Column) -> Column:
    return a.cast("string").startswith("-")  # the one built-in that tells -0.0 from 0.0


def divide(a: Column, b: Column) -> Column:
    to_zero = F.when((a == 0) | F.isnan(a), nan()).when((a > 0) != _negative_sign(b), inf()).otherwise(-inf())
    return F.when(b != 0, F.try_divide(a, b)).otherwise(to_zero)


def modulo(a: Column, b: Column) -> Column:
    return F.when((b == 0) | ~finite(a), nan()).otherwise(F.try_mod(a, F.when(b == 0, F.lit(1.0)).otherwise(b)))


def power(a: Column, b: Column) -> Column:
    return F.when(a == 1, F.lit(1.0)).when((a == -1) & (F.abs(b) == inf()), F.lit(1.0)).otherwise(F.pow(a, b))


def arctan2(a: Column, b: Column) -> Column:
    a_minus = (a == 0) & _negative_sign(a)
    b_minus = (b == 0) & _negative_sign(b)
    return F.when(a_minus & ((b < 0) | b_minus), F.lit(-math.pi)).when((a == 0) & ~a_minus & b_minus, F.lit(math.pi)).otherwise(F.atan2(a, b))


def logarithm(a: Column) -> Column:
    return F.when(a > 0, F.ln(a)).when(a == 0, -inf()).otherwise(nan())


def log_one_plus(a: Column) -> Column:
    return F.when(a > -1, F.log1p(a)).when(a == -1, -inf()).otherwise(nan())


def to_whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Spark's floor and ceil give longs; above 2 ** 53 every double is whole."""
    return lambda a: F.when(F.abs(a) < 2.0**53, f(a).cast("double")).otherwise(a)


def smallest(a: Column, b: Column) -> Column:
    return F.least(a, b)  # NaN is Spark's largest, so the other one is taken


def largest(a: Column, b: Column) -> Column:
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a))


def shrink(a: Column, b: Column) -> Column:
    """a moved towards 0 by b, and not past it."""
    up = F.when(a <= b, F.lit(0.0)).otherwise(a - b)
    down = F.when(a >= -b, F.lit(0.0)).otherwise(a + b)
    return F.when(F.isnan(a) | (a == 0), a).when(F.isnan(b), nan()).when(a > 0, up).otherwise(down)


def clamp(a: Column, b: Column) -> Column:
    """a held between -b and b."""
    return F.when(F.isnan(a), a).otherwise(largest(-b, smallest(a, b)))


def sign(a: Column) -> Column:
    return F.when((a > 0) & ~F.isnan(a), F.lit(1.0)).when(a < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


UNARY: dict[str, Callable[[Column], Column]] = {
    "sgn": sign,
    "abs": F.abs,
    "inv": lambda a: divide(F.lit(1.0), a),
    "square": lambda a: a * a,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "exp": F.exp,
    "log": logarithm,
    "expm1": F.expm1,
    "log1p": log_one_plus,
    "sigmoid": lambda a: F.lit(1.0) / (F.lit(1.0) + F.exp(-a)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": lambda a: F.when(a < 0, -F.asinh(-a)).otherwise(F.asinh(a)),  # Spark's own loses large negative values
    "acosh": F.acosh,
    "atanh": F.atanh,
    "floor": to_whole(F.floor),
    "ceil": to_whole(F.ceil),
    "round": lambda a: F.when(F.abs(a) < 2.0**52, F.when(a < 0, -F.floor(-a + 0.5)).otherwise(F.floor(a + 0.5)).cast("double")).otherwise(a),
    "not": lambda a: as_double(a == 0),
    "is_nan": lambda a: as_double(F.isnan(a)),
    "is_num": lambda a: as_double(~F.isnan(a)),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": divide,
    "mod": modulo,
    "pow": power,
    "atan2": arctan2,
    "lt": lambda a, b: as_double((a < b) & ~F.isnan(a) & ~F.isnan(b)),
    "lte": lambda a, b: as_double((a <= b) & ~F.isnan(a) & ~F.isnan(b)),
    "gt": lambda a, b: as_double((a > b) & ~F.isnan(a) & ~F.isnan(b)),
    "gte": lambda a, b: as_double((a >= b) & ~F.isnan(a) & ~F.isnan(b)),
    "eq": lambda a, b: as_double((a == b) & ~F.isnan(a)),
    "neq": lambda a, b: as_double((a != b) | F.isnan(a)),
    "min": smallest,
    "max": largest,
    "shrink": shrink,
    "clamp": clamp,
    "nan_to": F.nanvl,
}


def choose(a: Column, b: Column, c: Column) -> Column:
    """b where a is not 0 (NaN counts as that), else c."""
    return F.when(a != 0, b).otherwise(c)


def choose_by_sign(a: Column, b: Column, c: Column, d: Column) -> Column:
    """b where a < 0, d where a > 0, else (0 and NaN) c."""
    return F.when(a < 0, b).when((a > 0) & ~F.isnan(a), d).otherwise(c)
