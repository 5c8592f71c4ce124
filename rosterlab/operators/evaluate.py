"""Error, calibration and coverage of quantile predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles

TRIPLE = ("q15", "q50", "q85")


def monotone(df: DataFrame, names: Sequence[str] = TRIPLE) -> DataFrame:
    """q15 at most q50, q85 at least q50."""
    lo, mid, hi = names
    return df.withColumns({lo: F.least(lo, mid), hi: F.greatest(hi, mid)})


def monotonicity_violations(df: DataFrame, names: Sequence[str] = TRIPLE) -> DataFrame:
    lo, mid, hi = names
    return df.agg(F.count_if(F.col(lo) > F.col(mid)).alias("q15_above_q50"), F.count_if(F.col(hi) < F.col(mid)).alias("q85_below_q50"))


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def pinball(df: DataFrame, actual: str, levels: dict[str, float] | None = None) -> DataFrame:
    """Mean quantile loss per level."""
    levels = levels or {"q15": 0.15, "q50": 0.50, "q85": 0.85}
    loss = lambda q, a: F.avg(F.greatest((F.col(actual) - F.col(q)) * a, (F.col(actual) - F.col(q)) * (a - 1))).alias(f"pinball_{q}")
    return df.agg(*[loss(q, a) for q, a in levels.items()])


def regression_errors(df: DataFrame, actual: str, pred: str = "q50", keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and the exact median absolute error."""
    rows = df.withColumn("_e", F.col(pred) - F.coalesce(F.col(actual), F.lit(0.0))).withColumn("_ae", F.abs("_e"))
    means = rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_ae").alias("mae"))
    median = exact_quantiles(rows.select(*keys, "_ae"), "_ae", {"median_ae": 0.5}, keys)
    if keys:
        return means.join(median, list(keys))
    return means.withColumn("median_ae", median.scalar())


def calibration(df: DataFrame, actual: str) -> DataFrame:
    y = F.coalesce(F.col(actual), F.lit(0.0))
    return df.agg(
        _share(y < F.col("q15")).alias("q15_coverage"), _share(y < F.col("q85")).alias("q85_coverage"),
        F.avg(F.col("q85") - F.col("q15")).alias("interval_width"),
    )


def backtest(predictions: DataFrame, actual: str = "points_game") -> DataFrame:
    """One row of metrics: errors, coverage, interval width and the zero share of the actuals.

    Errors use the predictions as they are; coverage is after the monotone fix.
    """
    rows = predictions.withColumn("_y", F.coalesce(F.col(actual), F.lit(0.0)))
    fixed, y = monotone(rows), F.col("_y")
    out = fixed.agg(
        F.sqrt(F.avg((F.col("q50") - y) * (F.col("q50") - y))).alias("rmse"), F.avg(F.abs(F.col("q50") - y)).alias("mae"),
        _share(y < F.col("q15")).alias("q15_coverage"), _share(y < F.col("q85")).alias("q85_coverage"),
        F.avg(F.col("q85") - F.col("q15")).alias("interval_width"), F.avg(y).alias("mean_actual"),
        F.avg("q50").alias("mean_predicted_q50"), _share(y == 0).alias("pct_zero_actual"), F.count(F.lit(1)).alias("n_samples"),
    )
    errors = rows.select(F.abs(F.col("q50") - y).alias("_ae"))
    return out.withColumn("median_ae", exact_quantiles(errors, "_ae", {"median_ae": 0.5}).scalar())


def coverage_report(predictions: DataFrame, actual: str = "points_game") -> DataFrame:
    """Coverage over all rows and over rows that scored, which a zero-heavy label hides."""
    y = F.coalesce(F.col(actual), F.lit(0.0))
    scored = lambda q: F.avg(F.when(y != 0, (y < F.col(q)).cast("double")))
    return predictions.agg(
        _share(y < F.col("q15")).alias("q15_coverage_overall"), _share(y < F.col("q85")).alias("q85_coverage_overall"),
        scored("q15").alias("q15_coverage_nonzero"), scored("q85").alias("q85_coverage_nonzero"),
        _share(y == 0).alias("pct_zero"), F.count(F.lit(1)).alias("n_total"), F.count_if(y != 0).alias("n_nonzero"),
    )


def group_quantile_model(train: DataFrame, keys: Sequence[str], actual: str) -> DataFrame:
    """Empirical q15/q50/q85 of the label per group, exact."""
    return exact_quantiles(train, actual, {"q15": 0.15, "q50": 0.50, "q85": 0.85}, keys)


