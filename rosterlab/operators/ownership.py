"""Roster popularity: raw score from five signals, then a shaped rescale per pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import clip, code, logistic, ratio, rescale, signed_power
from ..functions.normal import hash_uniform, normal_cdf, normal_inverse
from ..functions.text import primary_position
from .ordered import prefix_sums, top_rows, with_group_stats

POOL = ["slate_id", "is_pitcher"]


def salary_tier(salary, bins=S.TIER_BINS) -> Column:
    """Right-closed bins; outside of all bins NULL."""
    s, out = F.col(salary) if isinstance(salary, str) else salary, None
    for lo, hi, name in bins:
        cond = (s > lo) & (s <= hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def value_zscore(df: DataFrame, bins=S.TIER_BINS) -> DataFrame:
    """z-score of points per 1000 salary within (slate, role, tier); 0 without spread or tier."""
    out = df.withColumns({"_tier": salary_tier("salary", bins), "_raw": ratio("pts_q50", F.col("salary") / 1000.0)})
    out = with_group_stats(
        out, [*POOL, "_tier"], {"_mean": F.avg("_raw"), "_sd": F.stddev_samp("_raw")}
    )
    z = F.when(F.col("_tier").isNotNull() & (F.col("_sd") > 0), (F.col("_raw") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    return out.withColumn("value_zscore", z).drop("_tier", "_raw", "_mean", "_sd")


def salary_rank(df: DataFrame) -> DataFrame:
    """Place by salary within (slate, first position), 0 lowest to 1 highest; ties by player id."""
    out = df.withColumn("_bucket", primary_position("position"))
    out = prefix_sums(out, ["slate_id", "_bucket"], [F.col("salary"), F.col("player_id")], out="_i", total="_n")
    return out.withColumn("salary_rank", (F.col("_i") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_bucket", "_i", "_n")


def recency(df: DataFrame) -> DataFrame:
    """Median projection scaled to 0..1 within the pool, 0.5 when all are equal."""
    out = with_group_stats(df, POOL, {"_lo": F.min("pts_q50"), "_hi": F.max("pts_q50")})
    scaled = F.when(F.col("_hi") > F.col("_lo"), clip((F.col("pts_q50") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 0.0, 1.0))
    return out.withColumn("recency", scaled.otherwise(0.5)).drop("_lo", "_hi")


def stack_multiplier(df: DataFrame, total: str = "team_total") -> DataFrame:
    """Hitters of high-total teams and the top of their team's salary list are stacked more; 1.0 for pitchers."""
    role = F.when(F.col("is_pitcher"), 1).otherwise(0)
    out = prefix_sums(
        df.withColumn("_role", role), ["slate_id", "team", "_role"], [F.col("salary").desc(), F.col("player_id")], out="_i", total="_n"
    )
    base = F.lit(1.0) + F.greatest((F.coalesce(F.col(total), F.lit(S.AVERAGE_TOTAL)) - S.AVERAGE_TOTAL) * 0.06, F.lit(0.0))
    factor = F.lit(1.0) - (F.col("_i") - 1) / F.greatest(F.col("_n"), F.lit(1)) * 0.3
    value = F.when(F.col("is_pitcher"), 1.0).otherwise(clip(base * factor, 0.7, 1.5))
    return out.withColumn("stack_multiplier", value).drop("_role", "_i", "_n")


def with_market(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Implied totals of the player's team and of the opponent."""
    right = lambda name: totals.select(code("team").alias(f"_{name}"), F.col("implied_total").alias(name))
    out = df.join(right("team_total"), code("team") == F.col("_team_total"), "left")
    return out.join(right("opp_total"), code("opponent") == F.col("_opp_total"), "left").drop("_team_total", "_opp_total")


def uniform_frequency(df: DataFrame) -> DataFrame:
    """The stand-in when no scenario is available: every player 1/n of the slate."""
    sizes = df.groupBy("slate_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("frequency"))
    return df.select("slate_id", "player_id").join(sizes, "slate_id")


def flat_ownership(df: DataFrame) -> DataFrame:
    pct = F.when(F.col("is_pitcher"), S.FLAT_OWNERSHIP["pitcher"]).otherwise(S.FLAT_OWNERSHIP["hitter"])
    return df.withColumn("ownership_pct", pct)


def raw_score(df: DataFrame, frequency: DataFrame, totals: DataFrame) -> DataFrame:
    """Weighted popularity score; separate weights for pitchers and hitters."""
    out = df.join(frequency.select("slate_id", "player_id", "frequency"), ["slate_id", "player_id"], "left")
    out = stack_multiplier(recency(salary_rank(value_zscore(with_market(out, totals)))))
    avg = F.lit(S.AVERAGE_TOTAL)
    freq = clip(F.coalesce("frequency", F.lit(0.0)), 0.0, 1.0)
    value = logistic(clip(F.col("value_zscore"), -3.0, 3.0))
    own = clip(F.greatest((F.coalesce("team_total", avg) - avg) * 0.03, F.lit(0.0)) / 0.15 + 0.5, 0.0, 1.0)
    facing = F.greatest(F.lit(1.0) - (F.coalesce("opp_total", avg) - avg) * 0.08, F.lit(0.0))
    p, h = S.PITCHER_WEIGHTS, S.HITTER_WEIGHTS
    signals = {"frequency": freq, "value": value, "salary_rank": F.col("salary_rank"), "recency": F.col("recency")}
    score = lambda w, market: sum((signals[k] * w[k] for k in signals), market * w["market"])
    raw = F.when(F.col("is_pitcher"), score(p, facing)).otherwise(score(h, own) * F.col("stack_multiplier"))
    return out.withColumn("raw_score", F.greatest(raw, F.lit(0.0)))


def slate_size(df: DataFrame) -> DataFrame:
    """small up to 4 games, medium up to 9, else large."""
    known = df.filter((F.col("away_team") != "") & (F.col("home_team") != ""))
    games = known.select("slate_id", "away_team", "home_team").distinct().groupBy("slate_id").agg(F.count(F.lit(1)).alias("games"))
    n = F.coalesce("games", F.lit(0))
    out = df.select("slate_id").distinct().join(games, "slate_id", "left")
    return out.select("slate_id", n.alias("games"), F.when(n <= 4, "small").when(n <= 9, "medium").otherwise("large").alias("slate_size"))


def normalise(df: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Raw scores to ownership percent: centre, signed power .7, logistic, rescale to floor..cap per pool.

    The logistic of a centred, powered score is monotone, so the pool's extremes come from the
    extremes of the raw score and one aggregation per pool is enough. ``pool`` is the plain player
    pool, if at hand, so that counting its games does not repeat the scoring.
    """
    out = df.join(slate_size(df if pool is None else pool), "slate_id")
    out = with_group_stats(out, POOL, {"_mean": F.avg("raw_score"), "_lo": F.min("raw_score"), "_hi": F.max("raw_score")})
    shape = lambda c: logistic(clip(signed_power(F.col(c) - F.col("_mean"), 0.7) * 4.0, -50.0, 50.0))
    cap = F.lit(None).cast("double")
    for size, (p, h) in S.OWNERSHIP_CAP.items():
        cap = F.when(F.col("slate_size") == size, F.when(F.col("is_pitcher"), p).otherwise(h)).otherwise(cap)
    floor = F.when(F.col("is_pitcher"), S.OWNERSHIP_FLOOR[0]).otherwise(S.OWNERSHIP_FLOOR[1])
    out = out.withColumns({"_sig": shape("raw_score"), "_smin": shape("_lo"), "_smax": shape("_hi"), "_cap": cap, "_floor": floor})
    pct = rescale("_sig", "_smin", "_smax", "_floor", "_cap")
    pct = F.least(F.greatest(pct, F.col("_floor")), F.col("_cap"))
    return out.withColumn("ownership_pct", pct).drop("_mean", "_lo", "_hi", "_sig", "_smin", "_smax", "_cap", "_floor", "games", "slate_size")


def apply_ownership(df: DataFrame, ownership: DataFrame | None = None) -> DataFrame:
    """Ownership (default flat, at least .1) and ceiling leverage q85 / ownership.

    ``median_leverage`` keeps the q50-based variant that the reports use.
    """
    if ownership is not None:
        df = df.join(ownership.select("slate_id", "player_id", "ownership_pct"), ["slate_id", "player_id"], "left")
    flat = F.when(F.col("is_pitcher"), S.FLAT_OWNERSHIP["pitcher"]).otherwise(S.FLAT_OWNERSHIP["hitter"])
    own = F.greatest(F.coalesce("ownership_pct", flat), F.lit(0.1))
    out = df.withColumn("_own", own)
    return out.withColumns({
        "ownership_proj": F.round("_own", 2), "leverage_score": F.round(F.col("pts_q85") / F.col("_own"), 3),
        "median_leverage": F.round(F.col("pts_q50") / F.greatest(F.round("_own", 2), F.lit(0.1)), 3),
    }).drop("_own", "ownership_pct")


def scenario_draws(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` truncated-normal values per player: mean q50, sd from the q15..q85 width, bounds 0 and the capped ceiling.

    Draws are generated from the row itself, so they are the same on any cluster.
    """
    mean, sd = F.col("pts_q50"), F.greatest((F.col("pts_q85") - F.col("pts_q15")) / 2.08, F.lit(0.01))
    high = F.greatest(F.col("pts_q85") * 1.5, mean + F.col("_sd"))
    # Everything that depends on the player alone is computed before the rows multiply, and the
    # small pool is spread first so that its draws are not all made by the task that read its file.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.repartition(tasks, "player_id").withColumn("_sd", sd).withColumn("_high", high)
    base = base.withColumns({"_a": normal_cdf((F.lit(0.0) - mean) / F.col("_sd")), "_b": normal_cdf((F.col("_high") - mean) / F.col("_sd"))})
    out = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_u", hash_uniform("player_id", "draw", F.lit(seed)))
    p = clip(F.col("_a") + F.col("_u") * (F.col("_b") - F.col("_a")), 1e-12, 1 - 1e-12)
    value = F.least(F.greatest(mean + F.col("_sd") * normal_inverse(F.col("_p")), F.lit(0.0)), F.col("_high"))
    return out.withColumn("_p", p).withColumn("value", value).drop("_sd", "_a", "_b", "_high", "_u", "_p")


def selection_frequency(draws: DataFrame, n: int, slots: dict[str, int] | None = None) -> DataFrame:
    """Share of draws in which a player ranks within a slot's required count.

    Eligible slots are exploded; the top rows per (slate, draw, slot) are limited before the
    shuffle, so a large pool never meets in one task.
    """
    slots = slots or S.SLOT_COUNTS
    need = F.lit(None).cast("int")
    for name, k in slots.items():
        need = F.when(F.col("slot") == name, k).otherwise(need)
    rows = draws.select("slate_id", "draw", "player_id", "value", F.explode("position_eligibility").alias("slot"))
    rows = rows.filter(F.col("slot").isin(list(slots)))
    best = top_rows(rows, ["slate_id", "draw", "slot"], [F.col("value").desc(), F.col("player_id")], max(slots.values()), rank="_r")
    picked = best.filter(F.col("_r") <= need).select("slate_id", "player_id", "draw").distinct()
    return picked.groupBy("slate_id", "player_id").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("frequency"))


def project_ownership(df: DataFrame, totals: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Projections to ownership and leverage: draws, frequency, raw score, normalisation."""
    freq = selection_frequency(scenario_draws(df, n, seed), n)
    return apply_ownership(normalise(raw_score(df, freq, totals), pool=df))
