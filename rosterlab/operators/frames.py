"""Shape helpers shared by the operators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import first_row


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones become typed NULLs, then defaults fill NULLs."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))  # NaN means missing
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def ensure(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the missing columns with their default and fill NULLs of the present ones."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()}
    )


def features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Align to a feature list: missing or NULL features are 0.0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.select(*keep, *[value(c).alias(c) for c in names])


def rolling_columns(columns: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Columns named ``*_7d``, ``*_14d`` or ``*_30d``, minus the excluded ones."""
    return [c for c in columns if re.search(r"_(7|14|30)d$", c) and c not in exclude]


def terminal_only(df: DataFrame, column: str = "events") -> DataFrame:
    """Rows that end a plate appearance: the event is neither NULL nor empty."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing from one frame are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, keys: Sequence[str], priority: Sequence[Column]) -> DataFrame:
    """One row per key, the last in ``priority`` order (all given descending here)."""
    return first_row(df, keys, priority)


def first_source(df: DataFrame, priority: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the best (lowest) priority: over the whole frame, or per key."""
    best = df.groupBy(*keys).agg(F.min(priority).alias("_best"))
    if not keys:
        return df.filter(F.col(priority) == best.scalar())
    return df.join(best, list(keys)).filter(F.col(priority) == F.col("_best")).drop("_best")


def holdout(df: DataFrame, date: str, year: int, month: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test part is one calendar month; rows without a date train."""
    inside = F.coalesce((F.year(date) == year) & (F.month(date) == month), F.lit(False))
    return df.filter(~inside), df.filter(inside)
