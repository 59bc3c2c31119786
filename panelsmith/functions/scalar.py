"""Scalar column expressions. All are built-in Spark expressions, so they stay in generated code.

Missing means NULL everywhere: every function maps NULL to NULL, and a value outside the domain of
a transform (a negative root, a log of zero) also becomes NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-5  # fixed value: clip floor of log_clip, offset of reciprocal


def _col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def log_clip(c: Column | str, floor: float = _EPS) -> Column:
    """ln(max(x, floor) + 1). The guard matters: ``greatest`` skips NULLs."""
    c = _col(c)
    return F.when(c.isNotNull(), F.log(F.greatest(c, F.lit(floor)) + 1))


def power_1_5(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c >= 0, F.pow(c, F.lit(1 / 1.5)))


def square_root(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c >= 0, F.sqrt(c))


def reciprocal(c: Column | str, offset: float = _EPS) -> Column:
    return F.try_divide(F.lit(1.0), _col(c) + F.lit(offset))


def log1p(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c > -1, F.log(c + 1))


def yeo_johnson(c: Column | str, lam: float | Column) -> Column:
    """Yeo-Johnson power transform (2000) for a given lambda, a number or a column."""
    c, lam = _col(c), lam if isinstance(lam, Column) else F.lit(float(lam))
    mirror = F.lit(2.0) - lam
    upper = F.when(lam == 0, F.log(c + 1)).otherwise((F.pow(c + 1, lam) - 1) / lam)
    lower = F.when(mirror == 0, -F.log(1 - c)).otherwise(-(F.pow(1 - c, mirror) - 1) / mirror)
    return F.when(c >= 0, upper).when(c < 0, lower)


def above(c: Column | str, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """Class 1 where the score exceeds the threshold (or reaches it, if inclusive)."""
    c = _col(c)
    hit = c >= F.lit(threshold) if inclusive else c > F.lit(threshold)
    return hit.cast("int")


def hash_key(c: Column | str, seed: int, *more: Column | str) -> Column:
    """Hex md5 of ``value:…:seed``; a repeatable random order that any SQL engine can rebuild."""
    parts = [_col(c).cast("string"), *[_col(m).cast("string") for m in more], F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(key: Column, start: int) -> Column:
    """Eight hex digits of an md5 key, from 1-based ``start``, as a double in [0, 1)."""
    return F.conv(F.substring(key, start, 8), 16, 10).cast("double") / F.lit(float(2**32))


# --- fixed values: coefficients of algorithm AS241 (Wichura 1988), highest power first ---------
AS241_CENTRE_NUM = [
    2.5090809287301226727e3,
    3.3430575583588128105e4,
    6.7265770927008700853e4,
    4.5921953931549871457e4,
    1.3731693765509461125e4,
    1.9715909503065514427e3,
    1.3314166789178437745e2,
    3.3871328727963666080e0,
]
AS241_CENTRE_DEN = [
    5.2264952788528545610e3,
    2.8729085735721942674e4,
    3.9307895800092710610e4,
    2.1213794301586595867e4,
    5.3941960214247511077e3,
    6.8718700749205790830e2,
    4.2313330701600911252e1,
    1.0,
]
AS241_TAIL_NUM = [
    7.74545014278341407640e-4,
    2.27238449892691845833e-2,
    2.41780725177450611770e-1,
    1.27045825245236838258e0,
    3.64784832476320460504e0,
    5.76949722146069140550e0,
    4.63033784615654529590e0,
    1.42343711074968357734e0,
]
AS241_TAIL_DEN = [
    1.05075007164441684324e-9,
    5.47593808499534494600e-4,
    1.51986665636164571966e-2,
    1.48103976427480074590e-1,
    6.89767334985100004550e-1,
    1.67638483018380384940e0,
    2.05319162663775882187e0,
    1.0,
]
AS241_FAR_NUM = [
    2.01033439929228813265e-7,
    2.71155556874348757815e-5,
    1.24266094738807843860e-3,
    2.65321895265761230930e-2,
    2.96560571828504891230e-1,
    1.78482653991729133580e0,
    5.46378491116411436990e0,
    6.65790464350110377720e0,
]
AS241_FAR_DEN = [
    2.04426310338993978564e-15,
    1.42151175831644588870e-7,
    1.84631831751005468180e-5,
    7.86869131145613259100e-4,
    1.48753612908506148525e-2,
    1.36929880922735805310e-1,
    5.99832206555887937690e-1,
    1.0,
]
# --- end of fixed values -----------------------------------------------------------------------


def _polynomial(coefficients: list[float], x: Column) -> Column:
    result = F.lit(coefficients[0])
    for c in coefficients[1:]:
        result = result * x + F.lit(c)
    return result


def normal_quantile(p: Column | str) -> Column:
    """Standard normal quantile of p in (0, 1); rational approximation accurate to ~1e-15."""
    p = _col(p)
    q = p - F.lit(0.5)
    central = F.lit(0.180625) - q * q
    centre = q * _polynomial(AS241_CENTRE_NUM, central) / _polynomial(AS241_CENTRE_DEN, central)
    depth = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near, far = depth - F.lit(1.6), depth - F.lit(5.0)
    tail = F.when(
        depth <= 5.0, _polynomial(AS241_TAIL_NUM, near) / _polynomial(AS241_TAIL_DEN, near)
    ).otherwise(_polynomial(AS241_FAR_NUM, far) / _polynomial(AS241_FAR_DEN, far))
    signed_tail = F.when(q < 0, -tail).otherwise(tail)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(signed_tail))
