"""Error and gamma functions, which Spark lacks, as Columns: polynomials whose coefficients are fitted when this is imported."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from numpy.polynomial import chebyshev
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.ieee import divide

#: Arguments from which erfc is below the smallest double; up to which erf has its own polynomial, in x squared.
_FAR, _NEAR = 27.0, 1.0


def _fitted(f: Callable[[float], float], low: float, high: float, degree: int) -> Callable[[Column], Column]:
    """A polynomial through f at the Chebyshev points of [low, high], as a Column."""
    half, middle = (high - low) / 2, (high + low) / 2
    powers = chebyshev.cheb2poly(chebyshev.chebinterpolate(np.vectorize(lambda u: f(middle + half * u)), degree)).tolist()

    def at(x: Column) -> Column:
        u = (x - middle) / half
        out = F.lit(powers[-1])
        for c in reversed(powers[:-1]):
            out = out * u + c
        return out

    return at


def _scaled(t: float) -> float:
    """log(erfc(z) / t) + z * z for t = 2 / (2 + z); far out by the first terms of the asymptotic series."""
    z = 2 / t - 2
    if z < 20:
        return math.log(math.erfc(z) / t) + z * z
    q = 1 / (2 * z * z)
    return math.log((1 - q + 3 * q**2 - 15 * q**3 + 105 * q**4) / (z * math.sqrt(math.pi) * t))


_near = _fitted(lambda s: math.erf(math.sqrt(s)) / math.sqrt(s) if s > 0 else 2 / math.sqrt(math.pi), 0.0, _NEAR, 14)
_far = [_fitted(_scaled, 2 / (2 + high), 2 / (2 + low), 14) for low, high in ((0.0, 2.0), (2.0, 8.0), (8.0, _FAR + 1))]


def _tail(z: Column) -> Column:
    """erfc of z >= 0."""
    t = F.try_divide(F.lit(2.0), z + 2)
    fitted = F.when(z < 2, _far[0](t)).when(z < 8, _far[1](t)).otherwise(_far[2](t))
    return F.when(z > _FAR, 0.0).otherwise(t * F.exp(fitted - z * z))


def erf(x: Column) -> Column:
    small = x * _near(x * x)
    return F.when(F.isnan(x), x).when(F.abs(x) <= _NEAR, small).when(x > 0, 1 - _tail(x)).otherwise(_tail(-x) - 1)


def erfc(x: Column) -> Column:
    return F.when(F.isnan(x), x).when(F.abs(x) <= _NEAR / 2, 1 - x * _near(x * x)).when(x > 0, _tail(x)).otherwise(2 - _tail(-x))


# Lanczos' approximation with g = 7 and nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _series(y: Column) -> Column:
    out = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        out = out + F.try_divide(F.lit(c), y + i)
    return out


def _log_gamma(x: Column) -> Column:
    """log of gamma for x >= 0.5."""
    y = x - 1
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(y + 7.5) - (y + 7.5) + F.log(_series(y))


def _sine(x: Column) -> Column:
    """sin(pi * x), with x brought to within a half of 0 first."""
    near = F.round(x)
    return F.sin(math.pi * (x - near)) * F.when(F.abs(near) % 2 == 1, -1.0).otherwise(1.0)


def lgamma(x: Column) -> Column:
    whole = (x <= 0) & (x == F.floor(x))
    mirrored = F.lit(math.log(math.pi)) - F.log(F.abs(_sine(x))) - _log_gamma(1 - x)
    return F.when(F.isnan(x), x).when(whole | (F.abs(x) == math.inf), math.inf).when((x == 1) | (x == 2), 0.0).when(x >= 0.5, _log_gamma(x)).otherwise(mirrored)


def tgamma(x: Column) -> Column:
    """NaN at negative whole numbers and at minus infinity; an infinity of 0's sign at 0; infinity and 0 beyond the doubles."""
    y = x - 1
    half = F.pow(y + 7.5, (y + 0.5) / 2)  # in two factors, as the power overflows before gamma does
    above = math.sqrt(2 * math.pi) * half * F.exp(-(y + 7.5)) * half * _series(y)
    z = -x
    half_z = F.pow(z + 7.5, (z + 0.5) / 2)
    mirrored = divide(F.lit(math.pi), _sine(x) * (math.sqrt(2 * math.pi) * half_z * F.exp(-(z + 7.5)) * half_z * _series(z)))
    zero = divide(F.lit(1.0), x)
    exact = F.when((x == F.floor(x)) & (x <= 21), F.round(above)).otherwise(above)
    return F.when(F.isnan(x), x).when(x == 0, zero).when(x == math.inf, math.inf).when((x == -math.inf) | ((x < 0) & (x == F.floor(x))), math.nan).when(x > 172, math.inf).when(x < -185, F.when(F.floor(x) % 2 == 0, 0.0).otherwise(-0.0)).when(x >= 0.5, exact).otherwise(mirrored)


UNARY: dict[str, Callable[[Column], Column]] = {name: lambda a, f=f: f(a.cast("double")) for name, f in {"erf": erf, "erfc": erfc, "lgamma": lgamma, "tgamma": tgamma}.items()}
