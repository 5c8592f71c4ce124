"""Normal distribution and reproducible uniforms as column arithmetic.

Spark SQL has neither an error function nor its inverse, and ``randn(seed)``
depends on how rows are partitioned. Both are replaced by expressions whose
value depends on the row alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col

# Published rational approximation of the normal distribution
# (Abramowitz & Stegun 26.2.17) and of its inverse (P. J. Acklam).
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
INV_TAIL = 0.02425
SQRT_2PI = 2.5066282746310002


def _horner(x: Column, coefs) -> Column:
    out = F.lit(float(coefs[0]))
    for c in coefs[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_cdf(x) -> Column:
    x = as_col(x)
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * z)
    tail = F.exp(-z * z / 2.0) / F.lit(SQRT_2PI) * (t * _horner(t, CDF_B[::-1]))
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_inverse(p) -> Column:
    p = as_col(p)
    q = p - 0.5
    r = q * q
    middle = q * _horner(r, INV_A) / _horner(r, INV_B + (1.0,))
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    tail = lambda s: _horner(s, INV_C) / _horner(s, INV_D + (1.0,))
    return F.when(p < INV_TAIL, tail(low)).when(p > 1 - INV_TAIL, -tail(high)).otherwise(middle)


def hash_uniform(*parts) -> Column:
    """Number in (0, 1) from the md5 of the parts: the same on any partitioning."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / 4294967296.0
