"""Pitcher features: pitch events and game logs to one row per pitcher and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import flag, outs_from_innings, ratio
from .batter import PITCH_ORDER
from .frames import ensure
from .ordered import trailing

LOG_STATS = (
    "innings_pitched", "earned_runs", "hits_allowed", "walks_allowed", "hit_batsmen", "wins", "complete_games",
    "shutouts", "strikeouts_gl", "no_hitters",
)


def daily_counts(pitches: DataFrame) -> DataFrame:
    """Pitch events to counts per pitcher and day, aggregated before any shuffle.

    Fastballs without a speed stay in ``fb_count``: the mean divides by all fastballs. The day's
    game is its first one, and ids rise within a day. All buffers are fixed-width, so Spark hashes.
    """
    ev, desc, fast = F.col("events"), F.col("description"), F.col("pitch_type").isin(S.FASTBALLS)
    total = lambda cond, name: F.sum(flag(cond)).alias(name)
    return (
        pitches.filter(F.col("pitcher").isNotNull())
        .groupBy("pitcher", "game_date")
        .agg(
            total(ev.isNotNull() & (ev != ""), "terminal_events"),
            total(ev.isin(S.STRIKEOUTS), "strikeouts"),
            total(ev == "walk", "walks"),
            total(desc.isin(S.SWINGS), "swings"),
            total(desc.isin(S.WHIFFS), "whiffs"),
            F.coalesce(F.sum(F.when(fast, F.col("release_speed"))), F.lit(0.0)).alias("fb_velo_sum"),
            total(fast, "fb_count"),
            F.min("game_pk").alias("game_pk"),
        )
    )


def pitcher_rolling(daily: DataFrame, windows: Sequence[int] = S.WINDOWS) -> DataFrame:
    """Trailing ratios of sums over the last w game days, 0 where nothing was counted."""
    rates = {
        "k_rate": ("strikeouts", "terminal_events"), "bb_rate": ("walks", "terminal_events"),
        "whiff_rate": ("whiffs", "swings"), "velo_mean": ("fb_velo_sum", "fb_count"),
    }

    def build(rows: DataFrame, part: list[str]) -> DataFrame:
        base = Window.partitionBy(*part).orderBy("game_date")
        return rows.select("*", *[
            ratio(F.sum(n).over(base.rowsBetween(-(w - 1), 0)), F.sum(d).over(base.rowsBetween(-(w - 1), 0))).alias(f"{name}_{w}d")
            for name, (n, d) in rates.items() for w in windows
        ])

    return trailing(daily, ["pitcher"], [F.col("game_date")], max(windows), build)


def join_logs(df: DataFrame, logs: DataFrame) -> DataFrame:
    """Game-log counts on (pitcher, date); the log's game id wins, misses are 0."""
    right = logs.select(
        "pitcher", "game_date", F.col("game_pk").alias("_log_game"), F.col("strikeouts").alias("strikeouts_gl"),
        *[c for c in LOG_STATS if c in logs.columns],
    )
    out = df.join(right, ["pitcher", "game_date"], "left")
    game = F.coalesce("_log_game", "game_pk") if "game_pk" in df.columns else F.col("_log_game")
    return ensure(out.withColumn("game_pk", game).drop("_log_game"), {c: 0.0 for c in LOG_STATS})


def innings_features(df: DataFrame, windows: Sequence[int] = S.WINDOWS, key: str = "pitcher") -> DataFrame:
    """Innings per start (current outing included) and per appearance (current one excluded)."""
    order = ["game_date", "game_pk"]

    def build(rows: DataFrame, part: list[str]) -> DataFrame:
        base = Window.partitionBy(*part).orderBy(*order)
        ip = F.coalesce(F.col("innings_pitched"), F.lit(0.0))
        cols = []
        for w in windows:
            incl, prior = base.rowsBetween(-(w - 1), 0), base.rowsBetween(-w, -1)
            cols.append(F.coalesce(F.avg("innings_pitched").over(incl), F.lit(0.0)).alias(f"ip_per_start_{w}d"))
            cols.append(ratio(F.sum(ip).over(prior), F.count(ip).over(prior)).alias(f"ip_per_appearance_{w}d"))
        return rows.select("*", *cols)

    out = trailing(df, [key], [F.col(c) for c in order], max(windows) + 1, build)
    return out.withColumn("is_starter", flag(F.col(f"ip_per_start_{min(windows)}d") >= 3.0))


def era_features(df: DataFrame, windows: Sequence[int] = (14, 30), key: str = "pitcher") -> DataFrame:
    """9 * earned runs / innings over the last w outings, 0 without innings."""
    order = ["game_date", "game_pk"]

    def build(rows: DataFrame, part: list[str]) -> DataFrame:
        base = Window.partitionBy(*part).orderBy(*order)
        cols = []
        for w in windows:
            frame = base.rowsBetween(-(w - 1), 0)
            er, ip = F.sum("earned_runs").over(frame), F.sum("innings_pitched").over(frame)
            cols.append(F.when(ip > 0, er / ip * 9.0).otherwise(0.0).alias(f"era_approx_{w}d"))
        return rows.select("*", *cols)

    return trailing(df, [key], [F.col(c) for c in order], max(windows), build)


def first_known(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First non-NULL value per key in the stated order."""
    at = F.when(F.col(value).isNotNull(), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(F.min_by(value, at).alias(value))


def context(df: DataFrame, pitches: DataFrame, order: Sequence[str] = PITCH_ORDER) -> DataFrame:
    """``pitcher_hand`` (R 1, L 0, unknown 1) and ``is_home`` (first half-inning Top 1, else 0)."""
    known = pitches.filter(F.col("pitcher").isNotNull())
    hand = first_known(known, ["pitcher"], "p_throws", order).withColumnRenamed("p_throws", "_hand")
    half = first_known(known, ["pitcher", "game_date"], "inning_topbot", [c for c in order if c != "game_date"])
    half = half.withColumnRenamed("inning_topbot", "_half")
    return (
        df.join(half, ["pitcher", "game_date"], "left")
        .join(hand, "pitcher", "left")
        .withColumns({
            "pitcher_hand": F.when(F.col("_hand") == "L", 0).otherwise(1),
            "is_home": F.when(F.col("_half") == "Top", 1).otherwise(0),
        })
        .drop("_hand", "_half")
    )


def score_pitching(df: DataFrame, out: str = "points_game") -> DataFrame:
    """Pitching points of an outing; the no-hitter bonus comes from its flag, else from a hitless complete game."""
    p = S.PITCHING_POINTS
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    ks = num("strikeouts_gl") if "strikeouts_gl" in df.columns else num("strikeouts")
    cg, hits = num("complete_games"), num("hits_allowed")
    no_hitter = (num("no_hitters") > 0) | ((cg > 0) & (hits == 0))
    points = (
        outs_from_innings(num("innings_pitched")) * p["out"]
        + ks * p["strikeout"] + num("wins") * p["win"] + num("earned_runs") * p["earned_run"]
        + hits * p["hit"] + num("walks_allowed") * p["walk"] + num("hit_batsmen") * p["hit_batter"]
        + cg * p["complete_game"] + num("shutouts") * p["shutout"]
        + F.when(no_hitter, p["no_hitter"]).otherwise(0.0)
    )
    return df.withColumn(out, points)


def role_filter(df: DataFrame, starters: bool = True, column: str = "ip_per_start_7d") -> DataFrame:
    """Starters average at least three innings; a missing value counts as 0."""
    value = F.coalesce(F.col(column), F.lit(0.0))
    return df.filter(value >= 3.0 if starters else value < 3.0)


def pitcher_feature_matrix(pitches: DataFrame, logs: DataFrame, order: Sequence[str] = PITCH_ORDER) -> DataFrame:
    """Pitcher-day matrix: the 23 features and ``points_game``, outings with innings only."""
    out = join_logs(pitcher_rolling(daily_counts(pitches)), logs)
    out = era_features(innings_features(out))
    out = score_pitching(context(out, pitches, order))
    return out.filter(F.col("innings_pitched") > 0)
