"""Incremental, streaming and evaluation queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.columns import flag
from ..operators import evaluate as E
from ..operators import model as M
from ..operators.frames import holdout, keep_last
from ..operators.pitcher import role_filter
from ..session import new_dir
from ..sources import tables as src
from ..streaming import streams as ST
from . import bindings as b
from .event_features import DAILY
from .registry import query


def _stream(t):
    return ST.read_stream(t.spark, f"{t.folder}/events*.parquet", time="ts")


# --- incremental and streaming


@query("T01_incremental_append", "SELECT season, game_date, count(*) AS n, CAST(sum(at_bat_number) AS BIGINT) AS ids FROM pitches GROUP BY 1, 2", views=b.PITCHES_SQL)
def _(t):
    root, keys = new_dir(t.spark, "tables"), ["game_pk", "at_bat_number", "pitch_number"]
    day = lambda d: F.lit(d).cast("date")
    p = b.pitches(t)
    src.write_table(p.filter(F.col("game_date") <= day("2024-01-20")), root, "pitches")
    # The second load overlaps three days that are already there.
    src.incremental_append(t.spark, root, "pitches", p.filter(F.col("game_date") > day("2024-01-17")), keys)
    out = src.read_table(t.spark, root, "pitches")
    return out.groupBy("season", "game_date").agg(F.count(F.lit(1)).alias("n"), F.sum("at_bat_number").alias("ids"))


@query("T02_idempotent_replay", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    # The whole table is delivered twice.
    twice = _stream(t).unionByName(_stream(t)).select("event_id", "ts", "user_id", "event_type")
    once = ST.deduplicated(twice, ["event_id"], "ts", "60 days")
    out = ST.drain(once)
    return ST.read_batches(t.spark, out, once.schema).select("event_id", "user_id", "event_type")


@query("T04_fresh_within_bound", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
 WHERE ts >= TIMESTAMP '2024-01-30 12:00:00') x WHERE rn = 1""")
def _(t):
    fresh = t["events"].filter(F.col("ts") >= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return keep_last(fresh, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("T05_latest_per_key_stream", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1", "value")
def _(t):
    latest = ST.latest_per_live_key(_stream(t), "user_id", ["value", "event_type"], ["ts", "event_id"], "ts", timedelta(days=400))
    return ST.latest_state(t.spark, ST.drain(latest, "update"), latest.schema, ["user_id"])


@query("T06_daily_counters_stream", "SELECT pitcher, game_date, swings, whiffs, fb_count FROM daily", "swings whiffs fb_count", views=f"{b.PITCHES_SQL}, {DAILY}")
def _(t):
    from .. import schemas as S

    s = _stream(t).withColumn("pitcher", F.get_json_object("props", "$.k").cast("int"))
    desc = F.expr("CASE pitcher % 4 WHEN 0 THEN 'swinging_strike' WHEN 1 THEN 'foul' WHEN 2 THEN 'ball' ELSE 'hit_into_play' END")
    kind = F.expr("CASE pitcher % 3 WHEN 0 THEN 'FF' WHEN 1 THEN 'SL' ELSE 'SI' END")
    counts = {"swings": F.sum(flag(desc.isin(S.SWINGS))), "whiffs": F.sum(flag(desc.isin(S.WHIFFS))), "fb_count": F.sum(flag(kind.isin(S.FASTBALLS)))}
    daily = ST.daily_counts(s, "pitcher", "ts", counts, delay="60 days")
    return ST.latest_state(t.spark, ST.drain(daily, "update"), daily.schema, ["pitcher", "game_date"])


# --- evaluation: label = discount times quantity (zero-heavy), model = quantiles per quantity

Y = "round(l_quantity * l_discount, 4)"
TRIPLE = "quantile_cont({y}, 0.15) AS q15, quantile_cont({y}, 0.5) AS q50, quantile_cont({y}, 0.85) AS q85"
LI = f"li AS (SELECT *, {Y} + 0e0 AS y FROM lineitem)"
ALL = f"{LI}, m AS (SELECT l_quantity AS g, {TRIPLE.format(y='y')} FROM li GROUP BY 1), pr AS (SELECT li.*, q15 + l_tax * 20 AS q15, q50, q85 - l_tax * 20 AS q85 FROM li JOIN m ON l_quantity = g)"
HELD = f"""{LI}, m AS (SELECT l_quantity AS g, {TRIPLE.format(y='y')} FROM li WHERE NOT (year(l_shipdate) = 1998 AND month(l_shipdate) = 5) GROUP BY 1),
pr AS (SELECT li.*, least(q15, q50) AS q15, q50, greatest(q85, q50) AS q85 FROM li JOIN m ON l_quantity = g WHERE year(l_shipdate) = 1998 AND month(l_shipdate) = 5)"""


def _labelled(t):
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate")
    return li.withColumn("y", F.round(F.col("l_quantity") * F.col("l_discount"), 4) + 0.0)


def _predicted(t):
    """Every row with its group's quantiles, pulled together by the tax so that some triples cross."""
    li = _labelled(t)
    out = li.join(E.group_quantile_model(li, ["l_quantity"], "y"), "l_quantity")
    return out.withColumns({"q15": F.col("q15") + F.col("l_tax") * 20, "q85": F.col("q85") - F.col("l_tax") * 20})


@query("A12_regression_errors", "SELECT sqrt(avg((q50 - y) * (q50 - y))) AS rmse, avg(abs(q50 - y)) AS mae, median(abs(q50 - y)) AS median_ae FROM pr", "rmse mae median_ae", views=ALL)
def _(t):
    return E.regression_errors(_predicted(t), "y")


@query("A13_calibration", "SELECT avg(CAST(y < q15 AS INT)) AS q15_coverage, avg(CAST(y < q85 AS INT)) AS q85_coverage, avg(q85 - q15) AS interval_width FROM pr", "q15_coverage q85_coverage interval_width", dp=6, views=ALL)
def _(t):
    return E.calibration(_predicted(t), "y")


_COV = """SELECT avg(CAST(y < q15 AS INT)) AS q15_coverage_overall, avg(CAST(y < q85 AS INT)) AS q85_coverage_overall, avg(CAST(y < q15 AS INT)) FILTER (y <> 0) AS q15_coverage_nonzero,
 avg(CAST(y < q85 AS INT)) FILTER (y <> 0) AS q85_coverage_nonzero, avg(CAST(y = 0 AS INT)) AS pct_zero, count(*) AS n_total, count(*) FILTER (y <> 0) AS n_nonzero FROM pr"""
_COVD = "q15_coverage_overall q85_coverage_overall q15_coverage_nonzero q85_coverage_nonzero pct_zero"


@query("A14_zero_inflation_split", _COV, _COVD, views=ALL)
def _(t):
    return E.coverage_report(_predicted(t), "y")


@query("A15_monotonicity_violations", "SELECT count(*) FILTER (q15 > q50) AS q15_above_q50, count(*) FILTER (q85 < q50) AS q85_below_q50 FROM pr", views=ALL)
def _(t):
    return E.monotonicity_violations(_predicted(t))


@query("F28_monotone_triple", "SELECT l_quantity, l_tax, least(q15, q50) AS q15, greatest(q85, q50) AS q85, count(*) AS n FROM pr GROUP BY 1, 2, 3, 4", "l_tax q15 q85", dp=6, views=ALL)
def _(t):
    return E.monotone(_predicted(t)).groupBy("l_quantity", "l_tax", "q15", "q85").agg(F.count(F.lit(1)).alias("n"))


def _holdout(t):
    train, test = holdout(_labelled(t), "l_shipdate", 1998, 5)
    return E.monotone(test.join(E.group_quantile_model(train, ["l_quantity"], "y"), "l_quantity"))


@query("D83_backtest", """SELECT sqrt(avg((q50 - y) * (q50 - y))) AS rmse, avg(abs(q50 - y)) AS mae, median(abs(q50 - y)) AS median_ae, avg(CAST(y < q15 AS INT)) AS q15_coverage, avg(CAST(y < q85 AS INT)) AS q85_coverage,
 avg(q85 - q15) AS interval_width, avg(y) AS mean_actual, avg(q50) AS mean_predicted_q50, avg(CAST(y = 0 AS INT)) AS pct_zero_actual, count(*) AS n_samples FROM pr""",
       "rmse mae median_ae q15_coverage q85_coverage interval_width mean_actual mean_predicted_q50 pct_zero_actual", dp=6, views=HELD)
def _(t):
    return E.backtest(_holdout(t), "y")


@query("D84_coverage_report", _COV, _COVD, dp=6, views=HELD)
def _(t):
    return E.coverage_report(_holdout(t), "y")


INPUTS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_FITTED: dict[tuple, str] = {}


def fitted(t, name, rows, label="l_extendedprice"):
    """The model of ``rows`` at its default size, fitted once for each folder in a session and read back from storage."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _FITTED:
        path = new_dir(t.spark, "quantile-model")
        M.train_quantiles(rows(), INPUTS, label).save(path)
        _FITTED[key] = path
    return M.QuantileModel.load(_FITTED[key])


def _all_but_may(t):
    return fitted(t, "all but May 1998", lambda: holdout(_labelled(t), "l_shipdate", 1998, 5)[0])


def _ip(t):
    return _labelled(t).withColumn("ip_per_start_7d", F.col("l_quantity") / 8.0)


@query("D80_train_quantiles")
def _(t):
    _, test = holdout(_labelled(t), "l_shipdate", 1998, 5)
    return E.pinball(_all_but_may(t).predict(test, keep=["l_extendedprice"]), "l_extendedprice")


@query("D81_predict")
def _(t):
    return _all_but_may(t).predict(_labelled(t), keep=["l_orderkey", "l_linenumber"])


# every row once, the triple in order, and the share of labels below each quantile within 0.02 of it
_BAND = "SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, TRUE AS in_order, TRUE AS low_in_band, TRUE AS high_in_band FROM lineitem"


@query("X03_prediction_contract", _BAND)
def _(t):
    rows = _all_but_may(t).predict(_labelled(t), keep=["l_orderkey", "l_linenumber", "l_extendedprice"])
    near = lambda q, level: F.abs(F.avg(flag(F.col("l_extendedprice") < F.col(q))) - level) <= 0.02
    return rows.agg(
        F.count("*").alias("n"), F.countDistinct("l_orderkey", "l_linenumber").alias("keys"), F.every((F.col("q15") <= F.col("q50")) & (F.col("q50") <= F.col("q85"))).alias("in_order"),
        near("q15", M.LOW).alias("low_in_band"), near("q85", M.HIGH).alias("high_in_band"),
    )


@query("D82_role_models")
def _(t):
    scored = []
    for starter, n in ((True, "starter"), (False, "reliever")):
        model = fitted(t, n, lambda s=starter: role_filter(_ip(t), s))
        out = E.calibration(model.predict(role_filter(_ip(t), starter), keep=["l_extendedprice"]), "l_extendedprice")
        scored.append(out.select(F.lit(n).alias("role"), "*"))
    return scored[0].unionByName(scored[1])


@query("D83_trained_backtest", "SELECT count(*) AS n_samples, avg(l_extendedprice + 0e0) AS mean_actual, TRUE AS low_in_band, TRUE AS high_in_band FROM lineitem WHERE year(l_shipdate) = 1998 AND month(l_shipdate) = 5", "mean_actual", dp=4)
def _(t):
    """The backtest over the trained model, on rows it has not seen: the shares below its quantiles are within 0.08 of them."""
    _, test = holdout(_labelled(t), "l_shipdate", 1998, 5)
    out = E.backtest(_all_but_may(t).predict(test, keep=["l_extendedprice"]), "l_extendedprice")
    near = lambda c, level: F.abs(F.col(c) - level) <= 0.08
    return out.select("n_samples", "mean_actual", near("q15_coverage", M.LOW).alias("low_in_band"), near("q85_coverage", M.HIGH).alias("high_in_band"))


@query("D85_feature_importance")
def _(t):
    return _all_but_may(t).importance(_labelled(t))


@query("K12_top_features")
def _(t):
    return M.top_features(_all_but_may(t).importance(_labelled(t)), 3)


@query("K12_attributions_add_up", "SELECT count(*) AS n, TRUE AS additive, TRUE AS one_base FROM lineitem")
def _(t):
    """For every row the shares of the features sum up to the prediction minus the base value."""
    rows = _all_but_may(t).attribute(_labelled(t))
    total = F.aggregate("shares", F.lit(0.0), lambda s, v: s + v)
    return rows.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("prediction") - F.col("base") - total)) < 1e-6).alias("additive"), (F.max("base") == F.min("base")).alias("one_base"))


@query("A30_importance_ranking")
def _(t):
    from ..operators.ordered import prefix_sums

    imp = _all_but_may(t).importance(_labelled(t))
    return prefix_sums(imp, [], [F.col("importance").desc(), F.col("feature")], out="place").select("feature", "place")
