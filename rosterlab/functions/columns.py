"""Scalar column helpers. All of them return plain Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clean(x) -> Column:
    """Trimmed text, NULL becomes the empty string."""
    return F.coalesce(F.trim(as_col(x)), F.lit(""))


def code(x) -> Column:
    """Trimmed upper-case code, NULL becomes the empty string."""
    return F.upper(clean(x))


def clip(x, lo, hi) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` alone would return a bound)."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ratio(num, den, default: float | None = 0.0) -> Column:
    """num / den, with ``default`` where the denominator is zero or NULL."""
    out = F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def flag(cond: Column) -> Column:
    """1.0 / 0.0, where an unknown condition counts as false."""
    return F.when(cond, 1.0).otherwise(0.0)


def lookup(x, table: Mapping, default=None) -> Column:
    """Constant map lookup; the map is folded into the plan, nothing is joined."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    out = F.try_element_at(F.create_map(*pairs), as_col(x))
    return out if default is None else F.coalesce(out, F.lit(default))


def weighted_event(x, weights: Mapping[str, float]) -> Column:
    """Points of an event name; names outside the table score 0."""
    x, out = as_col(x), None
    for name, points in weights.items():
        out = F.when(x == name, points) if out is None else out.when(x == name, points)
    return out.otherwise(0.0)


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def signed_power(x, p: float) -> Column:
    x = as_col(x)
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def rescale(x, lo, hi, out_lo, out_hi) -> Column:
    """Map lo..hi linearly onto out_lo..out_hi; the midpoint when lo = hi."""
    x, lo, hi, out_lo, out_hi = map(as_col, (x, lo, hi, out_lo, out_hi))
    return F.when(hi > lo, out_lo + (x - lo) / (hi - lo) * (out_hi - out_lo)).otherwise(
        (out_lo + out_hi) / 2.0
    )


def blend(weight, x, other) -> Column:
    """weight * x + (1 - weight) * other."""
    weight = as_col(weight)
    return weight * as_col(x) + (F.lit(1.0) - weight) * as_col(other)


def innings_from_text(x) -> Column:
    """``"6.1"`` means six innings and one out: 6 1/3. Unreadable text gives 0."""
    x = F.trim(as_col(x))
    whole = F.split_part(x, F.lit("."), F.lit(1)).try_cast("int")
    outs = F.when(F.contains(x, F.lit(".")), F.split_part(x, F.lit("."), F.lit(2)).try_cast("int")).otherwise(0)
    return F.coalesce(whole + outs / F.lit(3.0), F.lit(0.0))


def outs_from_innings(ip) -> Column:
    """Decimal innings to outs: three per whole inning plus the rounded fraction."""
    ip = F.coalesce(as_col(ip).cast("double"), F.lit(0.0))
    whole = F.floor(ip).cast("double")
    return whole * 3.0 + F.bround((ip - whole) * 3.0)


def parse_count(x) -> Column:
    """``"10,200"`` -> 10200, NULL when it is not a whole number."""
    return F.trim(F.replace(as_col(x), F.lit(","), F.lit(""))).try_cast("int")


def epoch_millis(x) -> Column:
    """First run of digits of ``/Date(1700000000000)/`` as a timestamp."""
    digits = F.regexp_extract(as_col(x), r"(\d+)", 1)
    return F.timestamp_millis(F.when(digits != "", digits).try_cast("bigint"))


def prize_value(x) -> Column:
    """First ``$`` amount in a text, with an optional M or K suffix; 0 when absent."""
    pat = r"\$(\d+(?:\.\d+)?)(M|K)?"
    num = F.regexp_extract(as_col(x), pat, 1)
    suffix = F.regexp_extract(as_col(x), pat, 2)
    scale = F.when(suffix == "M", 1e6).when(suffix == "K", 1e3).otherwise(1.0)
    return F.coalesce(F.when(num != "", num).try_cast("double") * scale, F.lit(0.0))


def minutes_to_lock(lock, now, given=None) -> Column:
    """Whole minutes until ``lock``, never negative; an explicit value wins."""
    derived = F.greatest(
        F.floor((F.unix_seconds(as_col(lock)) - F.unix_seconds(as_col(now))) / 60), F.lit(0)
    ).cast("int")
    derived = F.when(as_col(lock).isNotNull(), derived)
    return derived if given is None else F.coalesce(as_col(given), derived)
