"""Chi-squared combination and the Gaussian helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2q(half: Column, n: Column) -> Column:
    """P(chi-squared with 2n degrees of freedom >= 2 half), at most 1."""
    start = F.struct(F.exp(-half).alias("t"), F.exp(-half).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] * half / i
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["s"])
    return F.least(F.lit(1.0), total)


def norm_p(z: Column) -> Column:
    """The normal distribution function, by its series."""
    terms = F.sequence(F.lit(1), F.lit(120))
    first = F.struct(z.alias("t"), z.alias("s"))
    total = F.aggregate(terms, first, lambda a, i: F.struct((a["t"] * z * z / (2 * i + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * i + 1)).alias("s")), lambda a: a["s"])
    return F.when(z > 9, 1.0).when(z < -9, 0.0).otherwise(0.5 + total * F.exp(-z * z / 2) / math.sqrt(2 * math.pi))


#: Coefficients of the published rational approximation of the normal quantile, good to 3e-3.
QUANTILE_TOP, QUANTILE_BOTTOM = (2.30753, 0.27061), (1.0, 0.99229, 0.04481)


def norm_z(z: Column) -> Column:
    """The normal density."""
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def norm_iq(p: Column) -> Column:
    """About the z beyond which a share p of the normal distribution lies; null outside 0 to 1."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    poly = lambda c: sum((F.lit(x) * F.pow(t, F.lit(float(i))) for i, x in enumerate(c)), F.lit(0.0))
    z = F.when(q == 0, F.lit(8.3)).otherwise(t - poly(QUANTILE_TOP) / poly(QUANTILE_BOTTOM))
    return F.when(p.between(0, 1), F.when(p > 0.5, -z).otherwise(z))


def norm_ip(p: Column) -> Column:
    """The z below which a share p lies: the approximation after one Newton step."""
    z = norm_iq(1 - p)
    return z + (p - norm_p(z)) / norm_z(z)
