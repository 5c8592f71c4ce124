"""Slate projections as joins and column arithmetic over the whole pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import blend, clip, code
from ..functions.similarity import indel_ratio
from ..functions.text import token_sort
from .frames import features
from .slate import opponent

Q = ("q15", "q50", "q85")


def market_by_team(totals: DataFrame, team: str, out: str) -> DataFrame:
    """(team, positive implied total) renamed for a join."""
    known = totals.filter(F.col("implied_total") > 0)
    return known.select(code("team").alias(team), F.col("implied_total").alias(out))


def hitter_vectors(pool: DataFrame, latest: DataFrame, totals: DataFrame, multiplier: float | None = 1.0) -> DataFrame:
    """Hitter feature rows for today: latest usable features with market totals laid over.

    ``pool`` carries ``register_id``; a positive total replaces the team's run form, the
    opponent's replaces the runs allowed, and the order multiplier is forced to 1.
    """
    rows = pool.join(latest.withColumnRenamed("batter", "register_id"), "register_id")
    rows = rows.withColumns({"_team": code("team"), "_opp": opponent(F.col("team"), F.col("home_team"), F.col("away_team"))})
    rows = rows.join(market_by_team(totals, "_team", "_own_total"), "_team", "left").join(market_by_team(totals, "_opp", "_opp_total"), "_opp", "left")
    base = lambda c: F.col(c) if c in latest.columns else F.lit(0.0)
    rows = rows.withColumns({
        "team_runs_per_game_30d": F.coalesce("_own_total", base("team_runs_per_game_30d")),
        "opp_runs_allowed_30d": F.coalesce("_opp_total", base("opp_runs_allowed_30d")),
    })
    if multiplier is not None:
        rows = rows.withColumn("batting_order_multiplier", F.lit(multiplier))
    return features(rows, S.batter_feature_columns(), keep=["slate_id", "player_id"])


def pitcher_vectors(pool: DataFrame, latest: DataFrame) -> DataFrame:
    """Pitcher feature rows for today; ``pool`` carries ``register_id`` and ``is_confirmed``.

    A pitcher who does not start gets a typical relief outing where his starts look long.
    """
    rows = pool.join(latest.withColumnRenamed("pitcher", "register_id"), "register_id")
    fixed = {"is_starter": F.when(F.col("is_confirmed"), 1.0).otherwise(0.0)}
    for w in S.WINDOWS:
        c = f"ip_per_start_{w}d"
        value = F.col(c) if c in latest.columns else F.lit(0.0)
        fixed[c] = F.when(~F.col("is_confirmed") & (value > 2.0), 1.0).otherwise(value)
    return features(rows.withColumns(fixed), S.pitcher_feature_columns(), keep=["slate_id", "player_id"])


def confirmed_flag(pool: DataFrame, starters: DataFrame | None, threshold: float = 80.0) -> DataFrame:
    """``is_confirmed``: similar to the team's posted starter, else listed as SP."""
    listed_sp = F.upper(F.coalesce("position", F.lit(""))) == "SP"
    if starters is None:
        return pool.withColumn("is_confirmed", listed_sp)
    right = starters.groupBy(code("team").alias("_t")).agg(F.max("pitcher_name").alias("_posted"))
    out = pool.join(right, code("team") == F.col("_t"), "left")
    # Only pitchers can be starters, so only their names are compared.
    score = indel_ratio(token_sort(F.lower(F.when(F.col("is_pitcher"), F.col("name")))), token_sort(F.lower("_posted")))
    out = out.withColumn("_s", score)
    return out.withColumn("is_confirmed", F.coalesce(F.col("_s") >= threshold, F.lit(False)) | listed_sp).drop("_t", "_posted", "_s")


def fallback_projection(pool: DataFrame, cap: float = 15.0) -> DataFrame:
    """fb_q15/50/85 from the season average; averages of pitchers who do not start are capped."""
    avg = F.coalesce(F.col("avg_points").cast("double"), F.lit(0.0))
    arm = F.when(F.col("is_confirmed"), avg).otherwise(F.least(avg, F.lit(cap)))
    pick = lambda p, h: F.when(F.col("is_pitcher"), arm * p).otherwise(avg * h)
    return pool.withColumns({
        "fb_q15": F.greatest(pick(0.4, 0.5), F.lit(0.0)), "fb_q50": pick(1.0, 1.0), "fb_q85": pick(2.0, 1.8),
    })


def shrink(df: DataFrame, when: Column | None = None, pa: str = "pa_30d", full: int = S.LEAGUE_PA) -> DataFrame:
    """Blend q15/q50/q85 towards the league by recent plate appearances (``full`` means no blending)."""
    weight = F.least(F.coalesce(F.col(pa), F.lit(0)) / F.lit(float(full)), F.lit(1.0))
    value = lambda q: blend(weight, F.col(q), F.lit(S.LEAGUE[q]))
    return df.withColumns({q: value(q) if when is None else F.when(when, value(q)).otherwise(F.col(q)) for q in Q})


def market_adjust(df: DataFrame, totals: DataFrame, when: Column | None = None) -> DataFrame:
    """q50 and q85 times clip(total / 4.5, .75, 1.25), rounded to 4 places; teams without a total unchanged."""
    out = df.withColumn("_team", code("team")).join(market_by_team(totals, "_team", "_total"), "_team", "left")
    use = F.col("_total").isNotNull() & (F.lit(True) if when is None else when)
    factor = clip(F.col("_total") / S.AVERAGE_TOTAL, 0.75, 1.25)
    return out.withColumns({q: F.when(use, F.round(F.col(q) * factor, 4)).otherwise(F.col(q)) for q in Q[1:]}).drop("_team", "_total")


def project_slate(
    pool: DataFrame, predictions: DataFrame, pa_30d: DataFrame, totals: DataFrame,
    probables: DataFrame | None = None, posted: DataFrame | None = None,
) -> DataFrame:
    """Low, median and high projection of every pool player.

    ``predictions(player_id, register_id, model_q15, model_q50, model_q85)`` holds the matched
    players, with NULL quantiles where no model applied; ``pa_30d(register_id, pa_30d)`` their usage.
    A listed starter whom the probable starter contradicts projects to zero.
    """
    out = fallback_projection(confirmed_flag(pool, posted))
    out = out.join(predictions, "player_id", "left").join(pa_30d, "register_id", "left")
    out = out.withColumn("_ruled_out", F.lit(False))
    if probables is not None:
        right = probables.groupBy(code("team").alias("_t")).agg(F.max("pitcher_name").alias("_probable"))
        out = out.join(right, code("team") == F.col("_t"), "left")
        starter = F.col("is_pitcher") & (F.upper("position") == "SP") & (F.col("_probable") != "")
        score = indel_ratio(token_sort(F.lower(F.when(starter, F.col("name")))), token_sort(F.lower("_probable")))
        out = out.withColumn("_s", score).withColumn("_ruled_out", F.coalesce(starter & (F.col("_s") < 80.0), F.lit(False)))
        out = out.drop("_t", "_probable", "_s")
    zero = lambda c: F.greatest(F.col(c), F.lit(0.0))
    usable = F.col("model_q50").isNotNull() & ~((zero("model_q50") <= 0) & (F.coalesce(F.col("avg_points"), F.lit(0.0)) > 0))
    out = out.withColumn("used_model", F.coalesce(usable, F.lit(False)))
    out = out.withColumns({q: F.when(F.col("used_model"), zero(f"model_{q}")).otherwise(F.col(f"fb_{q}")) for q in Q})
    hitter = ~F.col("is_pitcher")
    out = shrink(out, when=hitter & F.col("register_id").isNotNull())
    out = market_adjust(out, totals, when=hitter)
    flat = F.when(F.col("is_pitcher"), S.FLAT_OWNERSHIP["pitcher"]).otherwise(S.FLAT_OWNERSHIP["hitter"])
    gone = F.col("_ruled_out")
    value = lambda c, dp=2: F.when(gone, 0.0).otherwise(F.round(c, dp))
    keep = [c for c in pool.columns if not c.startswith("pts_") and c not in ("ownership_proj", "leverage_score")]
    return out.select(
        *keep, F.col("register_id").isNotNull().alias("matched"), (F.col("used_model") & ~gone).alias("used_model"),
        *[value(F.col(q)).alias(f"pts_{q}") for q in Q], value(flat).alias("ownership_proj"), value(F.col("q50") / flat, 3).alias("leverage_score"),
    )


def usage_counts(projected: DataFrame) -> DataFrame:
    """How many players were matched, unmatched, projected by model or by fallback."""
    return projected.agg(
        F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"),
        F.count_if("used_model").alias("model_used"), F.count_if(~F.col("used_model")).alias("fallback_used"),
    )
