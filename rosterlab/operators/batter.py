"""Hitter features: pitch events to one row per player and game day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import clip, code, flag, lookup, ratio, weighted_event
from .frames import ensure, rolling_columns, terminal_only
from .ordered import first_row, trailing

PITCH_ORDER = ("game_date", "game_pk", "at_bat_number", "pitch_number")
XWOBA = "estimated_woba_using_speedangle"
ROLLING = {
    XWOBA: "xwoba", "launch_speed": "exit_velo", "barrel": "barrel_rate",
    "_hard_hit": "hard_hit", "_k": "k_rate", "_bb": "bb_rate",
}
TRENDS = ("barrel_rate", "hard_hit", "exit_velo")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def event_flags(df: DataFrame) -> DataFrame:
    """0/1 indicators of a plate appearance; unknown inputs count as 0."""
    has = set(df.columns)
    barrel = (
        clip(F.coalesce(F.col("barrel").cast("double"), F.lit(0.0)), 0.0, 1.0) if "barrel" in has
        else flag(F.col("launch_speed_angle") == S.BARREL_CODE) if "launch_speed_angle" in has
        else F.lit(None).cast("double")
    )
    cols = {
        "barrel": barrel,
        "_hard_hit": flag(F.col("launch_speed") >= S.HARD_HIT_SPEED),
        "_k": flag(F.col("events").isin(S.STRIKEOUTS)),
        "_bb": flag(F.col("events") == "walk"),
    }
    if "babip_value" in has:
        cols["babip_value"] = clip(F.coalesce(F.col("babip_value").cast("double"), F.lit(0.0)), 0.0, 1.0)
    return df.withColumns(cols)


def rolling_means(
    df: DataFrame, stats: dict[str, str], key: str = "batter", order: Sequence[str] = PITCH_ORDER,
    windows: Sequence[int] = S.WINDOWS, exclude_current: bool = False,
) -> DataFrame:
    """Mean of the last w rows per key for every (column, prefix) and window: ``{prefix}_{w}d``.

    The current row counts unless ``exclude_current``. All frames share one sort.
    """
    shift = 1 if exclude_current else 0

    def build(rows: DataFrame, part: list[str]) -> DataFrame:
        base = Window.partitionBy(*part).orderBy(*order)
        return rows.select("*", *[
            F.avg(src).over(base.rowsBetween(-(w - 1 + shift), -shift)).alias(f"{out}_{w}d")
            for src, out in stats.items() for w in windows
        ])

    return trailing(df, [key], _cols(order), max(windows), build)


def batter_rolling(
    pa: DataFrame, windows: Sequence[int] = S.WINDOWS, key: str = "batter", order: Sequence[str] = PITCH_ORDER,
    exclude_current: bool = False,
) -> DataFrame:
    """Rolling contact, power and discipline rates with short-against-long trends; rows without a player go."""
    df = event_flags(pa.filter(F.col(key).isNotNull()))
    stats = dict(ROLLING)
    babip = "babip_value" in df.columns
    if babip:
        stats["babip_value"] = "_babip"
    out = rolling_means(df, stats, key, order, windows, exclude_current)
    short, long = min(windows), max(windows)
    out = out.withColumns({f"{t}_trend": F.col(f"{t}_{short}d") - F.col(f"{t}_{long}d") for t in TRENDS})
    gap = F.col("xwoba_7d") - F.col("_babip_7d") if babip and 7 in windows else F.lit(0.0)
    out = out.withColumn("xwoba_babip_gap_7d", gap)
    return out.drop("_hard_hit", "_k", "_bb", *[f"_babip_{w}d" for w in windows])


def hand_history(pitches: DataFrame, key: str = "batter", days: int = 30) -> DataFrame:
    """Per player and day: xwOBA against either hand over the ``days`` before that day.

    Days are pre-aggregated, so the range frame slides over days, not pitches, and the
    lookup side is not restricted to terminal rows.
    """
    side = lambda h: F.when(F.col("p_throws") == h, F.col(XWOBA))
    daily = pitches.groupBy(key, "game_date").agg(
        *[F.sum(side(h)).alias(f"_sum_{h}") for h in "RL"], *[F.count(side(h)).alias(f"_n_{h}") for h in "RL"]
    )
    w = (
        Window.partitionBy(key).orderBy(F.datediff("game_date", F.lit("1970-01-01").cast("date")))
        .rangeBetween(-days, -1)
    )
    return daily.select(
        key, "game_date",
        *[F.sum(f"_sum_{h}").over(w).alias(f"_sum_{h}") for h in "RL"],
        *[F.coalesce(F.sum(f"_n_{h}").over(w), F.lit(0)).alias(f"_n_{h}") for h in "RL"],
    )


def platoon(pa: DataFrame, pitches: DataFrame, key: str = "batter", min_rows: int = 3) -> DataFrame:
    """xwOBA against today's hand, and the size of the split.

    Fewer than ``min_rows`` pitches against the hand: the row's 30-row mean (else .320).
    """
    history = hand_history(pitches, key)
    out = pa.join(history, [key, "game_date"], "left")
    mean = {h: ratio(f"_sum_{h}", f"_n_{h}", None) for h in "RL"}
    enough = {h: F.col(f"_n_{h}") >= min_rows for h in "RL"}
    hand = F.col("p_throws") if "p_throws" in pa.columns else F.lit("R")
    fallback = F.col("xwoba_30d") if "xwoba_30d" in pa.columns else F.lit(0.320)
    vs = F.when((hand == "R") & enough["R"], mean["R"]).when((hand == "L") & enough["L"], mean["L"])
    return out.withColumns({
        "xwoba_vs_hand_30d": vs.otherwise(fallback),
        "platoon_split_magnitude": F.when(enough["R"] & enough["L"], F.abs(mean["R"] - mean["L"])).otherwise(0.0),
    }).drop(*[f"_{p}_{h}" for p in ("sum", "n") for h in "RL"])


def batting_order_multiplier(df: DataFrame, column: str = "batting_order") -> DataFrame:
    value = lookup(F.col(column).cast("int"), S.ORDER_MULTIPLIER, 1.0) if column in df.columns else F.lit(1.0)
    return df.withColumn("batting_order_multiplier", value)


def score_events(df: DataFrame, column: str = "events", out: str = "points") -> DataFrame:
    value = weighted_event(column, S.EVENT_POINTS) if column in df.columns else F.lit(0.0)
    return df.withColumn(out, value)


def score_batting_full(df: DataFrame, out: str = "points_batting") -> DataFrame:
    """Event points plus run, RBI and steal points where those columns exist."""
    box = {"runs_scored": S.RUN_POINTS, "rbi": S.RBI_POINTS, "stolen_bases": S.STEAL_POINTS}
    total = weighted_event("events", S.EVENT_POINTS)
    for c, w in box.items():
        if c in df.columns:
            total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
    return df.withColumn(out, total)


def park_factor(df: DataFrame, column: str = "home_team") -> DataFrame:
    value = lookup(code(column), S.PARK_FACTOR, 1.0) if column in df.columns else F.lit(1.0)
    return df.withColumn("park_factor", value)


def market_total(df: DataFrame, totals: DataFrame | None = None, default: float = S.AVERAGE_TOTAL) -> DataFrame:
    """Implied total of the batting side: away in the top half, else home."""
    if totals is None:
        return df.withColumn("implied_total", F.lit(default))
    side = F.col("home_team")
    if "inning_topbot" in df.columns:
        side = F.when(F.col("inning_topbot") == "Top", F.col("away_team")).otherwise(F.col("home_team"))
    known = totals.select(F.trim("team").alias("_team"), F.col("implied_total").alias("_total"))
    out = df.withColumn("_side", F.trim(side)).join(known, F.col("_side") == F.col("_team"), "left")
    return out.withColumn("implied_total", F.coalesce("_total", F.lit(default))).drop("_side", "_team", "_total")


def join_counting_stats(df: DataFrame, logs: DataFrame, key: str = "batter", label: str | None = None) -> DataFrame:
    """Runs, RBI and steals from the logs on (player, date), misses as 0.

    With ``label`` they are also added to that column at 2, 2 and 5 points.
    """
    stats = ["runs", "rbi", "stolen_bases"]
    right = logs.select(key, "game_date", *[c for c in stats if c in logs.columns])
    out = ensure(df.join(right, [key, "game_date"], "left"), {c: 0 for c in stats})
    if label is None:
        return out
    extra = F.col("runs") * S.RUN_POINTS + F.col("rbi") * S.RBI_POINTS + F.col("stolen_bases") * S.STEAL_POINTS
    return out.withColumn(label, F.coalesce(F.col(label), F.lit(0.0)) + extra)


def to_game_level(
    df: DataFrame, key: str = "batter", order: Sequence[str] = PITCH_ORDER, game_key: str = "game_date",
    label: str = "points_game",
) -> DataFrame:
    """One row per player and day: points summed, rolling features last, context first.

    "Last" and "first" skip NULLs per column, and follow the stated order. Rows without a player go.
    """
    df = df.filter(F.col(key).isNotNull())
    known = set(df.columns)
    last = rolling_columns(df.columns) + [
        c for c in ("platoon_split_magnitude", "batting_order_multiplier", "park_factor", "p_throws", "stand",
                    "barrel_rate_trend", "hard_hit_trend", "exit_velo_trend") if c in known
    ]
    first = [c for c in ("home_team", "away_team", "game_pk") if c in known and c != game_key]
    keys = [key, "game_date"] + ([game_key] if game_key != "game_date" else [])
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in order if c not in keys]))
    numbered = df.withColumn("_seq", seq)
    known_at = lambda c: F.when(F.col(c).isNotNull(), F.col("_seq"))
    return numbered.groupBy(*keys).agg(
        F.sum("points").alias(label),
        F.count(F.lit(1)).alias("pa_count"),
        *[F.max_by(c, known_at(c)).alias(c) for c in last],
        *[F.min_by(c, known_at(c)).alias(c) for c in first],
    )


def join_batting_order(df: DataFrame, orders: DataFrame, key: str = "batter") -> DataFrame:
    """Batting-order slot of the day (first per player and date) and its multiplier."""
    right = first_row(
        orders.select(F.col("mlbam_id").alias(key), "game_date", "batting_order", "game_pk", "team"),
        [key, "game_date"], [F.col("game_pk"), F.col("team"), F.col("batting_order")],
    ).select(key, "game_date", "batting_order")
    return batting_order_multiplier(df.join(right, [key, "game_date"], "left"))


def player_teams(orders: DataFrame, key: str = "batter") -> DataFrame:
    """One team per player and game (first in team order).

    A player has few rows in a game, so rows are shuffled as they are; combining them before would sort them twice.
    """
    keys = orders.select(F.col("mlbam_id").alias(key), "game_pk", F.trim("team").alias("team"))
    keys = keys.filter(F.col(key).isNotNull() & F.col("game_pk").isNotNull() & F.col("team").isNotNull())
    return keys.repartition(key, "game_pk").groupBy(key, "game_pk").agg(F.min("team").alias("team"))


def team_games(logs: DataFrame, teams: DataFrame, key: str = "batter") -> DataFrame:
    """Runs and date of every (team, game), from player logs with their team attached."""
    joined = logs.select(key, "game_pk", "game_date", "runs").join(teams, [key, "game_pk"])
    return joined.groupBy("team", "game_pk").agg(
        F.sum(F.coalesce(F.col("runs"), F.lit(0))).cast("double").alias("runs_scored"),
        F.min("game_date").alias("game_date"),
    )


def runs_allowed(games: DataFrame) -> DataFrame:
    """The other team's runs per (team, game), one row per (team, game) coming in.

    The reference order is by team, so the "first other team" of a game is its lowest
    team, or the second lowest for the lowest itself. No pairs of teams are formed; a
    game's group is bounded by the number of teams.
    """
    w = Window.partitionBy("game_pk").orderBy("team").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_team, first, second = F.first("team").over(w), F.first("runs_scored").over(w), F.nth_value("runs_scored", 2).over(w)
    return games.select("*", F.when(F.col("team") == first_team, second).otherwise(first).alias("runs_allowed"))


def lagged_mean(value: str, part: Sequence[str], order: Sequence[str], n: int, at_least: int) -> Column:
    """Mean of the ``n`` rows before the current one, NULL with fewer than ``at_least`` values."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(-n, -1)
    return F.when(F.count(value).over(w) >= at_least, F.avg(value).over(w))


def team_form(games: DataFrame, n: int = 30, at_least: int = 3, default: float = S.AVERAGE_TOTAL) -> DataFrame:
    """Runs for and against per game over the previous ``n`` games of a team.

    ``opp_runs_allowed_30d`` is the team's own runs allowed, as the feature contract has it.
    Both series are taken from the same rows, which large inputs write once.
    """
    order = ["game_date", "game_pk"]

    def series(rows: DataFrame, part: list[str]) -> DataFrame:
        mean = lambda value, by: F.coalesce(lagged_mean(value, by, order, n, at_least), F.lit(default))
        rows = rows.withColumn("team_runs_per_game_30d", mean("runs_scored", part))
        # Games without an opponent do not enter the series of runs allowed.
        return rows.withColumn("opp_runs_allowed_30d", mean("runs_allowed", [*part, "_met"]))

    rows = runs_allowed(games).withColumn("_met", F.col("runs_allowed").isNotNull())
    rows = trailing(rows, ["team"], _cols(order), n, series, within=["_met"], store=True)
    own = F.when(F.col("_met"), F.col("opp_runs_allowed_30d")).otherwise(default)
    return rows.withColumn("opp_runs_allowed_30d", own).drop("_met")


def team_offense(df: DataFrame, logs: DataFrame, orders: DataFrame, key: str = "batter") -> DataFrame:
    """Attach the batting team's form before the game; unknown teams get the average."""
    teams = player_teams(orders, key)
    form = team_form(team_games(logs, teams, key)).select(
        "team", "game_pk", "team_runs_per_game_30d", "opp_runs_allowed_30d"
    )
    out = df.join(teams, [key, "game_pk"], "left").join(form, ["team", "game_pk"], "left").drop("team")
    return ensure(out, {"team_runs_per_game_30d": S.AVERAGE_TOTAL, "opp_runs_allowed_30d": S.AVERAGE_TOTAL})


def game_starters(pitcher_games: DataFrame) -> DataFrame:
    """One pitcher per game: most innings, lowest id on ties; the whole row is taken."""
    return first_row(
        pitcher_games.filter(F.col("game_pk").isNotNull()), ["game_pk"],
        [F.col("innings_pitched").desc_nulls_last(), F.col("pitcher"), F.col("game_date")],
    )


def opposing_starter(df: DataFrame, pitcher_games: DataFrame, by_team: bool = False) -> DataFrame:
    """Opposing starter's 14-game form per game, league averages for misses.

    Default: one starter per game serves both teams. ``by_team`` expects ``team`` on
    ``pitcher_games`` and ``opponent`` on ``df`` and takes that team's own starter.
    """
    source = {c: c.removeprefix("opp_") for c in S.STARTER_DEFAULTS}
    if by_team:
        games = first_row(
            pitcher_games, ["game_pk", "team"], [F.col("innings_pitched").desc_nulls_last(), F.col("pitcher")]
        ).withColumnRenamed("team", "opponent")
        on = ["game_pk", "opponent"]
    else:
        games, on = game_starters(pitcher_games), ["game_pk"]
    right = games.select(*on, *[F.col(src).alias(out) for out, src in source.items()])
    return ensure(df.join(right, on, "left"), S.STARTER_DEFAULTS)


def batter_feature_matrix(
    pitches: DataFrame, hitting_logs: DataFrame, orders: DataFrame, pitcher_matrix: DataFrame | None = None,
    order: Sequence[str] = PITCH_ORDER,
) -> DataFrame:
    """Player-day matrix: the 26 features, counting stats and the label ``points_game``."""
    pitches = pitches.filter(F.col("batter").isNotNull())
    pa = platoon(batter_rolling(terminal_only(pitches), order=order), pitches)
    games = to_game_level(score_events(park_factor(pa)), order=order)
    games = join_counting_stats(games, hitting_logs, label="points_game")
    games = join_batting_order(games, orders)
    games = team_offense(games, hitting_logs, orders)
    games = opposing_starter(games, pitcher_matrix) if pitcher_matrix is not None else ensure(games, S.STARTER_DEFAULTS)
    return games.filter(F.col("points_game").isNotNull())
