"""Queries over ``events`` presented as pitches, logs and posted batting orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import flag, lookup, weighted_event
from ..operators import batter as B
from ..operators import frames as fr
from ..operators import pitcher as P
from ..operators import slate as SL
from ..operators.ordered import first_row, prefix_sums, with_group_stats
from ..sources import tables as src
from . import bindings as b
from .registry import query

PA = "pa AS (SELECT * FROM pitches WHERE events IS NOT NULL AND events <> '')"
BASE = f"{b.PITCHES_SQL}, {PA}"
ORDER = "game_date, game_pk, at_bat_number, pitch_number"
POINTS = "CASE events " + " ".join(f"WHEN '{e}' THEN {p:e}" for e, p in S.EVENT_POINTS.items()) + " ELSE 0e0 END"
PARK = "CASE home_team " + " ".join(f"WHEN '{k}' THEN {v:e}" for k, v in S.PARK_FACTOR.items()) + " ELSE 1e0 END"
MULT = "CASE batting_order " + " ".join(f"WHEN {k} THEN {v:e}" for k, v in S.ORDER_MULTIPLIER.items()) + " ELSE 1e0 END"


def _pa(t):
    return fr.terminal_only(b.pitches(t))


# --- scans, filters, projections


@query(
    "S01_read_table",
    "SELECT season, count(*) AS n, min(game_date) AS first_date, max(game_date) AS last_date FROM pitches GROUP BY 1",
    views=b.PITCHES_SQL,
)
def _(t):
    return b.pitches(t).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date")
    )


@query(
    "S05_load_seasons",
    "SELECT season, batter, count(*) AS n FROM pitches WHERE season IN (1, 2, 3, 9) GROUP BY 1, 2",
    views=b.PITCHES_SQL,
)
def _(t):
    return src.load_seasons(b.pitches(t), [1, 2, 3, 9]).groupBy("season", "batter").agg(F.count(F.lit(1)).alias("n"))


@query("S19_freshness", "SELECT 'pitches' AS dataset, max(game_date) AS newest, count(*) AS n FROM pitches", views=b.PITCHES_SQL)
def _(t):
    return src.newest_date(b.pitches(t), "pitches")


@query("P01_terminal_events", "SELECT events, count(*) AS n FROM pa GROUP BY 1", views=BASE)
def _(t):
    return _pa(t).groupBy("events").agg(F.count(F.lit(1)).alias("n"))


@query("P02_pruned_columns", "SELECT batter, game_date, p_throws, estimated_woba_using_speedangle AS xwoba FROM pitches WHERE estimated_woba_using_speedangle IS NOT NULL", "xwoba", views=b.PITCHES_SQL)
def _(t):
    return b.pitches(t).filter(F.col(B.XWOBA).isNotNull()).select("batter", "game_date", "p_throws", F.col(B.XWOBA).alias("xwoba"))


@query(
    "P03_positive_exposure",
    "SELECT pitcher, game_date, innings_pitched FROM event_pitching WHERE innings_pitched > 0", "innings_pitched",
    views=b.EVENT_PITCHING_SQL,
)
def _(t):
    return b.event_pitching_logs(t).filter(F.col("innings_pitched") > 0).select("pitcher", "game_date", "innings_pitched")


@query(
    "P05_role_predicate",
    """SELECT pitcher, game_date, CASE WHEN coalesce(m, 0) >= 3 THEN 'starter' ELSE 'reliever' END AS role FROM (
         SELECT pitcher, game_date, avg(innings_pitched) OVER (PARTITION BY pitcher ORDER BY game_date, game_pk
                ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM event_pitching) x""",
    views=b.EVENT_PITCHING_SQL,
)
def _(t):
    rows = P.innings_features(b.event_pitching_logs(t))
    named = lambda df, role: df.select("pitcher", "game_date", F.lit(role).alias("role"))
    return named(P.role_filter(rows), "starter").unionByName(named(P.role_filter(rows, False), "reliever"))


@query(
    "P15_conform_defaults",
    "SELECT game_pk, batter, coalesce(launch_speed, 0) AS launch_speed, coalesce(events, '') AS events, 0.5e0 AS barrel, CAST(NULL AS DOUBLE) AS hit_distance_sc FROM pitches",
    "launch_speed barrel hit_distance_sc", views=b.PITCHES_SQL,
)
def _(t):
    out = fr.conform(b.pitches(t), S.PITCHES, {"launch_speed": 0.0, "events": "", "barrel": 0.5})
    return out.select("game_pk", "batter", "launch_speed", "events", "barrel", "hit_distance_sc")


@query("F30_event_flags", """
SELECT batter, game_date, sum(CASE WHEN launch_speed_angle = 6 THEN 1e0 ELSE 0e0 END) AS barrels,
       sum(CASE WHEN launch_speed >= 95 THEN 1e0 ELSE 0e0 END) AS hard_hits,
       sum(CASE WHEN events IN ('strikeout', 'strikeout_double_play') THEN 1e0 ELSE 0e0 END) AS ks,
       sum(CASE WHEN events = 'walk' THEN 1e0 ELSE 0e0 END) AS bbs, sum(coalesce(babip_value, 0)) AS babip
FROM pa GROUP BY 1, 2""", "barrels hard_hits ks bbs babip", views=BASE)
def _(t):
    f = B.event_flags(_pa(t))
    return f.groupBy("batter", "game_date").agg(
        F.sum("barrel").alias("barrels"), F.sum("_hard_hit").alias("hard_hits"), F.sum("_k").alias("ks"),
        F.sum("_bb").alias("bbs"), F.sum("babip_value").alias("babip"),
    )


@query("F29_event_points", f"SELECT events, {POINTS} AS points, count(*) AS n FROM pitches GROUP BY 1, 2", "points", views=b.PITCHES_SQL)
def _(t):
    return B.score_events(b.pitches(t)).groupBy("events", "points").agg(F.count(F.lit(1)).alias("n"))


@query("F31_date_parts", """
SELECT game_date, year(game_date) AS y, month(game_date) AS m, CAST(game_date + INTERVAL 1 DAY AS DATE) AS next_day,
       least(game_date, DATE '2024-01-15') AS capped, count(*) AS n FROM pitches GROUP BY game_date""", views=b.PITCHES_SQL)
def _(t):
    d = F.col("game_date")
    return b.pitches(t).groupBy(d).agg(F.count(F.lit(1)).alias("n")).select(
        d, F.year(d).alias("y"), F.month(d).alias("m"), F.date_add(d, 1).alias("next_day"),
        F.least(d, F.lit("2024-01-15").cast("date")).alias("capped"), "n",
    )


# --- windows on plate appearances

_MEANS = {"estimated_woba_using_speedangle": "xwoba", "launch_speed": "exit_velo", "brl": "barrel_rate", "hh": "hard_hit", "kk": "k_rate", "bb": "bb_rate"}
FLAGGED = """flagged AS (
  SELECT *, CASE WHEN launch_speed_angle = 6 THEN 1e0 ELSE 0e0 END AS brl, CASE WHEN launch_speed >= 95 THEN 1e0 ELSE 0e0 END AS hh,
         CASE WHEN events IN ('strikeout', 'strikeout_double_play') THEN 1e0 ELSE 0e0 END AS kk,
         CASE WHEN events = 'walk' THEN 1e0 ELSE 0e0 END AS bb, coalesce(babip_value, 0e0) AS bab FROM pa)"""
_ROLL = ", ".join(
    f"avg({s}) OVER (PARTITION BY batter ORDER BY {ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {p}_{w}d"
    for s, p in _MEANS.items() for w in S.WINDOWS
)
ROLLED = f"""{FLAGGED}, rolled AS (
  SELECT *, barrel_rate_7d - barrel_rate_30d AS barrel_rate_trend, hard_hit_7d - hard_hit_30d AS hard_hit_trend,
         exit_velo_7d - exit_velo_30d AS exit_velo_trend, xwoba_7d - bab_7 AS xwoba_babip_gap_7d
  FROM (SELECT *, {_ROLL}, avg(bab) OVER (PARTITION BY batter ORDER BY {ORDER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS bab_7 FROM flagged) r)"""
_ROLL_COLS = [f"{p}_{w}d" for p in _MEANS.values() for w in S.WINDOWS]
_TREND_COLS = ["barrel_rate_trend", "hard_hit_trend", "exit_velo_trend", "xwoba_babip_gap_7d"]


@query("W01_trailing_means", f"SELECT batter, at_bat_number, {', '.join(_ROLL_COLS)} FROM rolled", " ".join(_ROLL_COLS), views=f"{BASE}, {ROLLED}")
def _(t):
    return B.batter_rolling(_pa(t)).select("batter", "at_bat_number", *_ROLL_COLS)


@query("W09_trends", f"SELECT batter, at_bat_number, {', '.join(_TREND_COLS)} FROM rolled", " ".join(_TREND_COLS), views=f"{BASE}, {ROLLED}")
def _(t):
    return B.batter_rolling(_pa(t)).select("batter", "at_bat_number", *_TREND_COLS)


_W02 = ", ".join(
    f"avg({c}) OVER (PARTITION BY pitcher ORDER BY {ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {c}_{w}d"
    for c in ("release_speed", "launch_speed") for w in S.WINDOWS
)
_W02_COLS = [f"{c}_{w}d" for c in ("release_speed", "launch_speed") for w in S.WINDOWS]


@query("W02_rolling_stats", f"SELECT pitcher, at_bat_number, {', '.join(_W02_COLS)} FROM (SELECT *, {_W02} FROM pitches) x", " ".join(_W02_COLS), views=b.PITCHES_SQL)
def _(t):
    out = B.rolling_means(b.pitches(t), {"release_speed": "release_speed", "launch_speed": "launch_speed"}, key="pitcher")
    return out.select("pitcher", "at_bat_number", *_W02_COLS)


HAND = """days AS (
  SELECT batter, game_date, sum(x) FILTER (p_throws = 'R') AS sr, count(x) FILTER (p_throws = 'R') AS nr,
         sum(x) FILTER (p_throws = 'L') AS sl, count(x) FILTER (p_throws = 'L') AS nl
  FROM (SELECT batter, game_date, p_throws, estimated_woba_using_speedangle AS x FROM pitches) q GROUP BY 1, 2),
hist AS (
  SELECT batter, game_date, sum(sr) OVER w AS sr, coalesce(sum(nr) OVER w, 0) AS nr, sum(sl) OVER w AS sl, coalesce(sum(nl) OVER w, 0) AS nl
  FROM days WINDOW w AS (PARTITION BY batter ORDER BY game_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))"""


@query("W08_hand_history_30d", """
SELECT batter, game_date, CASE WHEN nr > 0 THEN sr / nr END AS mean_r, CAST(nr AS BIGINT) AS n_r, CASE WHEN nl > 0 THEN sl / nl END AS mean_l, CAST(nl AS BIGINT) AS n_l FROM hist""",
       "mean_r mean_l", views=f"{b.PITCHES_SQL}, {HAND}")
def _(t):
    h = B.hand_history(b.pitches(t))
    return h.select(
        "batter", "game_date", F.try_divide("_sum_R", "_n_R").alias("mean_r"), F.col("_n_R").alias("n_r"),
        F.try_divide("_sum_L", "_n_L").alias("mean_l"), F.col("_n_L").alias("n_l"),
    )


@query("J09_range_self_join", """
SELECT a.batter, a.game_date, count(p.batter) AS n_prior, sum(p.estimated_woba_using_speedangle) AS sum_prior
FROM (SELECT DISTINCT batter, game_date FROM pitches) a
LEFT JOIN pitches p ON p.batter = a.batter AND p.estimated_woba_using_speedangle IS NOT NULL AND p.game_date >= a.game_date - INTERVAL 30 DAY AND p.game_date < a.game_date
GROUP BY 1, 2""", "sum_prior", views=b.PITCHES_SQL)
def _(t):
    h = B.hand_history(b.pitches(t))
    both = F.coalesce("_sum_R", F.lit(0.0)) + F.coalesce("_sum_L", F.lit(0.0))
    n = F.col("_n_R") + F.col("_n_L")
    return h.select("batter", "game_date", n.alias("n_prior"), F.when(n > 0, both).alias("sum_prior"))


PLATOON = """platooned AS (
  SELECT r.*, CASE WHEN r.p_throws = 'R' AND nr >= 3 THEN sr / nr WHEN r.p_throws = 'L' AND nl >= 3 THEN sl / nl ELSE xwoba_30d END AS xwoba_vs_hand_30d,
         CASE WHEN nr >= 3 AND nl >= 3 THEN abs(sr / nr - sl / nl) ELSE 0e0 END AS platoon_split_magnitude
  FROM rolled r LEFT JOIN hist h ON r.batter = h.batter AND r.game_date = h.game_date)"""
PLATOON_VIEWS = f"{BASE}, {ROLLED}, {HAND}, {PLATOON}"


@query("D01_batter_rolling", f"SELECT batter, game_date, count(*) AS n, {', '.join(f'sum({c}) AS {c}' for c in _ROLL_COLS + _TREND_COLS)} FROM rolled GROUP BY 1, 2", " ".join(_ROLL_COLS + _TREND_COLS), views=f"{BASE}, {ROLLED}")
def _(t):
    out = B.batter_rolling(_pa(t))
    return out.groupBy("batter", "game_date").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in _ROLL_COLS + _TREND_COLS])


@query("D02_platoon", "SELECT batter, at_bat_number, xwoba_vs_hand_30d, platoon_split_magnitude FROM platooned", "xwoba_vs_hand_30d platoon_split_magnitude", views=PLATOON_VIEWS)
def _(t):
    out = B.platoon(B.batter_rolling(_pa(t)), b.pitches(t))
    return out.select("batter", "at_bat_number", "xwoba_vs_hand_30d", "platoon_split_magnitude")


@query("D03_batting_order_multiplier", f"SELECT batting_order, {MULT} AS batting_order_multiplier, count(*) AS n FROM event_orders GROUP BY 1, 2", "batting_order_multiplier", views=f"{b.PITCHES_SQL}, {b.EVENT_ORDERS_SQL}")
def _(t):
    return B.batting_order_multiplier(b.event_orders(t)).groupBy("batting_order", "batting_order_multiplier").agg(F.count(F.lit(1)).alias("n"))


@query("D04_score_events", f"SELECT batter, game_date, sum({POINTS}) AS points FROM pa GROUP BY 1, 2", "points", views=BASE)
def _(t):
    return B.score_events(_pa(t)).groupBy("batter", "game_date").agg(F.sum("points").alias("points"))


@query("D05_score_batting_full", f"""
SELECT p.batter, p.at_bat_number, {POINTS} + coalesce(l.rbi, 0) * 2e0 + coalesce(l.stolen_bases, 0) * 5e0 + coalesce(l.runs, 0) * 2e0 AS points_batting
FROM pa p LEFT JOIN event_logs l ON p.batter = l.batter AND p.game_date = l.game_date""", "points_batting", views=f"{BASE}, {b.EVENT_LOGS_SQL}")
def _(t):
    logs = b.event_logs(t).select("batter", "game_date", F.col("runs").alias("runs_scored"), "rbi", "stolen_bases")
    return B.score_batting_full(_pa(t).join(logs, ["batter", "game_date"], "left")).select("batter", "at_bat_number", "points_batting")


@query("D06_park_factor", f"SELECT home_team, {PARK} AS park_factor, count(*) AS n FROM pitches GROUP BY 1, 2", "park_factor", views=b.PITCHES_SQL)
def _(t):
    return B.park_factor(b.pitches(t)).groupBy("home_team", "park_factor").agg(F.count(F.lit(1)).alias("n"))


# --- aggregation to player-day and joins

_LAST = [c for c in _ROLL_COLS] + ["xwoba_vs_hand_30d", "xwoba_babip_gap_7d", "platoon_split_magnitude", "park_factor", "barrel_rate_trend", "hard_hit_trend", "exit_velo_trend"]
GAMES = f"""games AS (
  SELECT batter, game_date, sum(points) AS points_game, count(*) AS pa_count,
         {', '.join(f'arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS {c}' for c in _LAST + ['p_throws', 'stand'])},
         arg_min(home_team, seq) AS home_team, arg_min(away_team, seq) AS away_team, arg_min(game_pk, seq) AS game_pk
  FROM (SELECT *, {POINTS} AS points, {PARK} AS park_factor, row_number() OVER (PARTITION BY batter, game_date ORDER BY game_pk, at_bat_number, pitch_number) AS seq
        FROM platooned) g GROUP BY 1, 2)"""
GAME_VIEWS = f"{PLATOON_VIEWS}, {GAMES}"
_GAME_DOUBLES = " ".join(["points_game", *_LAST])


@query("A01_game_level_rules", f"SELECT batter, game_date, game_pk, home_team, away_team, p_throws, stand, pa_count, points_game, {', '.join(_LAST)} FROM games", _GAME_DOUBLES, views=GAME_VIEWS)
def _(t):
    pa = B.platoon(B.batter_rolling(_pa(t)), b.pitches(t))
    out = B.to_game_level(B.score_events(B.park_factor(pa)))
    return out.select("batter", "game_date", "game_pk", "home_team", "away_team", "p_throws", "stand", "pa_count", "points_game", *_LAST)


@query("D11_game_level", "SELECT batter, game_date, pa_count, points_game, xwoba_7d, xwoba_vs_hand_30d FROM games", "points_game xwoba_7d xwoba_vs_hand_30d", views=GAME_VIEWS)
def _(t):
    pa = B.platoon(B.batter_rolling(_pa(t)), b.pitches(t))
    return B.to_game_level(B.score_events(B.park_factor(pa))).select("batter", "game_date", "pa_count", "points_game", "xwoba_7d", "xwoba_vs_hand_30d")


@query("P17_suffix_columns", "SELECT column_name FROM (VALUES " + ", ".join(f"('{c}')" for c in sorted(_ROLL_COLS)) + ") v(column_name), (SELECT count(*) AS n FROM pa) c WHERE c.n > 0", views=BASE)
def _(t):
    rolled = B.batter_rolling(_pa(t))
    names = fr.rolling_columns(rolled.columns, exclude=["xwoba_babip_gap_7d"])
    held = rolled.agg(*[F.count(c).alias(c) for c in names])
    return held.select(F.explode(F.array(*[F.when(F.col(c) >= 0, F.lit(c)) for c in names])).alias("column_name"))


@query("J01_left_join_counting_stats", """
SELECT f.batter, f.game_date, f.n, coalesce(l.runs, 0) AS runs, coalesce(l.rbi, 0) AS rbi, coalesce(l.stolen_bases, 0) AS stolen_bases
FROM (SELECT batter, game_date, count(*) AS n FROM pa GROUP BY 1, 2) f LEFT JOIN event_logs l ON f.batter = l.batter AND f.game_date = l.game_date""",
       views=f"{BASE}, {b.EVENT_LOGS_SQL}")
def _(t):
    f = _pa(t).groupBy("batter", "game_date").agg(F.count(F.lit(1)).alias("n"))
    return B.join_counting_stats(f, b.event_logs(t)).select("batter", "game_date", "n", "runs", "rbi", "stolen_bases")


@query("D10_counting_stats_game_level", """
SELECT f.batter, f.game_date, f.p + coalesce(l.runs, 0) * 2 + coalesce(l.rbi, 0) * 2 + coalesce(l.stolen_bases, 0) * 5 AS points_game
FROM (SELECT batter, game_date, sum(points) AS p FROM (SELECT *, """ + POINTS + """ AS points FROM pa) q GROUP BY 1, 2) f LEFT JOIN event_logs l ON f.batter = l.batter AND f.game_date = l.game_date""",
       "points_game", views=f"{BASE}, {b.EVENT_LOGS_SQL}")
def _(t):
    f = B.score_events(_pa(t)).groupBy("batter", "game_date").agg(F.sum("points").alias("points_game"))
    return B.join_counting_stats(f, b.event_logs(t), label="points_game").select("batter", "game_date", "points_game")


ORDERS_DAY = "orders_day AS (SELECT mlbam_id AS batter, game_date, arg_min(batting_order, (game_pk, team, batting_order)) AS batting_order FROM event_orders GROUP BY 1, 2)"


@query("J02_join_deduplicated", f"""
SELECT f.batter, f.game_date, o.batting_order, {MULT} AS batting_order_multiplier
FROM (SELECT DISTINCT batter, game_date FROM pa) f LEFT JOIN orders_day o ON f.batter = o.batter AND f.game_date = o.game_date""",
       "batting_order_multiplier", views=f"{BASE}, {b.EVENT_ORDERS_SQL}, {ORDERS_DAY}")
def _(t):
    f = _pa(t).select("batter", "game_date").distinct()
    return B.join_batting_order(f, b.event_orders(t)).select("batter", "game_date", "batting_order", "batting_order_multiplier")


@query("D12_join_batting_order", f"""
SELECT batting_order, {MULT} AS batting_order_multiplier, count(*) AS n FROM
(SELECT f.batter, f.game_date, o.batting_order FROM (SELECT DISTINCT batter, game_date FROM pa) f LEFT JOIN orders_day o ON f.batter = o.batter AND f.game_date = o.game_date) z GROUP BY 1, 2""",
       "batting_order_multiplier", views=f"{BASE}, {b.EVENT_ORDERS_SQL}, {ORDERS_DAY}")
def _(t):
    f = _pa(t).select("batter", "game_date").distinct()
    return B.join_batting_order(f, b.event_orders(t)).groupBy("batting_order", "batting_order_multiplier").agg(F.count(F.lit(1)).alias("n"))


# --- pitchers

DAILY = """daily AS (
  SELECT pitcher, game_date, CAST(count(*) FILTER (events IS NOT NULL AND events <> '') AS DOUBLE) AS terminal_events,
         CAST(count(*) FILTER (events IN ('strikeout', 'strikeout_double_play')) AS DOUBLE) AS strikeouts,
         CAST(count(*) FILTER (events = 'walk') AS DOUBLE) AS walks,
         CAST(count(*) FILTER (description IN ('hit_into_play', 'foul', 'swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'foul_bunt', 'missed_bunt', 'hit_into_play_score', 'hit_into_play_no_out')) AS DOUBLE) AS swings,
         CAST(count(*) FILTER (description IN ('swinging_strike', 'swinging_strike_blocked', 'foul_tip')) AS DOUBLE) AS whiffs,
         coalesce(sum(release_speed) FILTER (pitch_type IN ('FF', 'SI', 'FC')), 0e0) AS fb_velo_sum,
         CAST(count(*) FILTER (pitch_type IN ('FF', 'SI', 'FC')) AS DOUBLE) AS fb_count,
         arg_min(game_pk, (game_pk, at_bat_number, pitch_number)) AS game_pk
  FROM pitches GROUP BY 1, 2)"""
_DAILY_D = "terminal_events strikeouts walks swings whiffs fb_velo_sum fb_count"


@query("A02_pitcher_daily_counts", "SELECT * FROM daily", _DAILY_D, views=f"{b.PITCHES_SQL}, {DAILY}")
def _(t):
    return P.daily_counts(b.pitches(t))


_RATES = {"k_rate": ("strikeouts", "terminal_events"), "bb_rate": ("walks", "terminal_events"), "whiff_rate": ("whiffs", "swings"), "velo_mean": ("fb_velo_sum", "fb_count")}
_RATE_COLS = [f"{n}_{w}d" for n in _RATES for w in S.WINDOWS]
PROLL = "prolled AS (SELECT *, " + ", ".join(
    f"coalesce(sum({n}) OVER w{w} / nullif(sum({d}) OVER w{w}, 0), 0e0) AS {name}_{w}d" for name, (n, d) in _RATES.items() for w in S.WINDOWS
) + " FROM daily WINDOW " + ", ".join(f"w{w} AS (PARTITION BY pitcher ORDER BY game_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in S.WINDOWS) + ")"


@query("W03_trailing_ratios", f"SELECT pitcher, game_date, {', '.join(_RATE_COLS)} FROM prolled", " ".join(_RATE_COLS), views=f"{b.PITCHES_SQL}, {DAILY}, {PROLL}")
def _(t):
    return P.pitcher_rolling(P.daily_counts(b.pitches(t))).select("pitcher", "game_date", *_RATE_COLS)


@query("D15_pitcher_rolling", "SELECT * FROM prolled", f"{_DAILY_D} {' '.join(_RATE_COLS)}", views=f"{b.PITCHES_SQL}, {DAILY}, {PROLL}")
def _(t):
    return P.pitcher_rolling(P.daily_counts(b.pitches(t)))


@query("A04_first_per_key", "SELECT pitcher, arg_min(p_throws, (game_date, game_pk, at_bat_number, pitch_number)) AS p_throws FROM pitches WHERE p_throws IS NOT NULL GROUP BY 1", views=b.PITCHES_SQL)
def _(t):
    return P.first_known(b.pitches(t), ["pitcher"], "p_throws", B.PITCH_ORDER)


@query("A05_last_per_key", "SELECT batter, arg_max(home_team, (game_date, game_pk, at_bat_number, pitch_number)) AS team FROM pitches GROUP BY 1", views=b.PITCHES_SQL)
def _(t):
    at = F.struct(*B.PITCH_ORDER)
    return b.pitches(t).groupBy("batter").agg(F.max_by("home_team", at).alias("team"))


CONTEXT = """ctx AS (
  SELECT d.*, CASE WHEN h.p_throws = 'L' THEN 0 ELSE 1 END AS pitcher_hand, CASE WHEN i.half = 'Top' THEN 1 ELSE 0 END AS is_home
  FROM {src} d
  LEFT JOIN (SELECT pitcher, arg_min(p_throws, (game_date, game_pk, at_bat_number, pitch_number)) AS p_throws FROM pitches GROUP BY 1) h ON d.pitcher = h.pitcher
  LEFT JOIN (SELECT pitcher, game_date, arg_min(inning_topbot, (game_pk, at_bat_number, pitch_number)) AS half FROM pitches GROUP BY 1, 2) i
    ON d.pitcher = i.pitcher AND d.game_date = i.game_date)"""


@query("D19_pitcher_context", "SELECT pitcher, game_date, pitcher_hand, is_home FROM ctx", views=f"{b.PITCHES_SQL}, {DAILY}, {CONTEXT.format(src='daily')}")
def _(t):
    p = b.pitches(t)
    return P.context(P.daily_counts(p), p).select("pitcher", "game_date", "pitcher_hand", "is_home")


@query("J08_first_half_inning", "SELECT pitcher, game_date, is_home FROM ctx", views=f"{b.PITCHES_SQL}, {DAILY}, {CONTEXT.format(src='daily')}")
def _(t):
    p = b.pitches(t)
    half = P.first_known(p, ["pitcher", "game_date"], "inning_topbot", B.PITCH_ORDER[1:])
    return P.daily_counts(p).join(half, ["pitcher", "game_date"], "left").select(
        "pitcher", "game_date", F.when(F.col("inning_topbot") == "Top", 1).otherwise(0).alias("is_home")
    )


@query("J11_constant_map_lookup", f"SELECT DISTINCT home_team, {PARK} AS park_factor, CASE WHEN p_throws = 'R' THEN 1 ELSE 0 END AS hand FROM pitches", "park_factor", views=b.PITCHES_SQL)
def _(t):
    hand = lookup("p_throws", {"R": 1, "L": 0}, 1).alias("hand")
    return b.pitches(t).select("home_team", lookup("home_team", S.PARK_FACTOR, 1.0).alias("park_factor"), hand).distinct()


_IP = [f"ip_per_{k}_{w}d" for k in ("start", "appearance") for w in S.WINDOWS]
PMATRIX = f"""pl AS (
  SELECT r.*, coalesce(l.game_pk, r.game_pk) AS gp, coalesce(l.innings_pitched, 0) AS innings_pitched, coalesce(l.strikeouts, 0) AS strikeouts_gl,
         coalesce(l.earned_runs, 0) AS earned_runs, coalesce(l.hits_allowed, 0) AS hits_allowed, coalesce(l.walks_allowed, 0) AS walks_allowed,
         coalesce(l.hit_batsmen, 0) AS hit_batsmen, coalesce(l.wins, 0) AS wins, coalesce(l.complete_games, 0) AS complete_games,
         coalesce(l.shutouts, 0) AS shutouts, coalesce(l.no_hitters, 0) AS no_hitters
  FROM prolled r LEFT JOIN event_pitching l ON r.pitcher = l.pitcher AND r.game_date = l.game_date),
pip AS (
  SELECT *, {', '.join(f"avg(innings_pitched) OVER (PARTITION BY pitcher ORDER BY game_date, gp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS ip_per_start_{w}d" for w in S.WINDOWS)},
         {', '.join(f"coalesce(sum(innings_pitched) OVER (PARTITION BY pitcher ORDER BY game_date, gp ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) / nullif(count(innings_pitched) OVER (PARTITION BY pitcher ORDER BY game_date, gp ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0), 0) AS ip_per_appearance_{w}d" for w in S.WINDOWS)},
         {', '.join(f"coalesce(9e0 * sum(earned_runs) OVER (PARTITION BY pitcher ORDER BY game_date, gp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) / nullif(sum(innings_pitched) OVER (PARTITION BY pitcher ORDER BY game_date, gp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 0), 0) AS era_approx_{w}d" for w in (14, 30))}
  FROM pl),
{CONTEXT.format(src='pip')},
pmatrix AS (
  SELECT * EXCLUDE (game_pk, gp), gp AS game_pk, CASE WHEN ip_per_start_7d >= 3 THEN 1e0 ELSE 0e0 END AS is_starter,
         (floor(innings_pitched) * 3 + round_even((innings_pitched - floor(innings_pitched)) * 3, 0)) * 0.75 + strikeouts_gl * 2 + wins * 4 - earned_runs * 2
         - 0.6e0 * (hits_allowed + walks_allowed + hit_batsmen) + 2.5e0 * complete_games + 2.5e0 * shutouts
         + CASE WHEN no_hitters > 0 OR (complete_games > 0 AND hits_allowed = 0) THEN 5 ELSE 0 END AS points_game
  FROM ctx WHERE innings_pitched > 0)"""
PMATRIX_VIEWS = f"{b.PITCHES_SQL}, {DAILY}, {PROLL}, {b.EVENT_PITCHING_SQL}, {PMATRIX}"
_PM = [c for c in S.pitcher_feature_columns() if c not in ("is_home", "pitcher_hand")]


@query("D21_pitcher_feature_matrix", f"SELECT pitcher, game_date, game_pk, is_home, pitcher_hand, points_game, {', '.join(_PM)} FROM pmatrix", f"points_game {' '.join(_PM)}", views=PMATRIX_VIEWS)
def _(t):
    m = P.pitcher_feature_matrix(b.pitches(t), b.event_pitching_logs(t))
    return m.select("pitcher", "game_date", "game_pk", "is_home", "pitcher_hand", "points_game", *_PM)


TEAMGAME = """bt AS (SELECT mlbam_id AS batter, game_pk, arg_min(team, (team, batting_order)) AS team FROM event_orders GROUP BY 1, 2),
tg AS (SELECT team, l.game_pk, CAST(sum(runs) AS DOUBLE) AS runs_scored, min(l.game_date) AS game_date FROM event_logs l JOIN bt ON l.batter = bt.batter AND l.game_pk = bt.game_pk GROUP BY 1, 2),
ra AS (SELECT a.team, a.game_pk, a.game_date, arg_min(o.runs_scored, o.team) AS runs_allowed FROM tg a JOIN tg o ON a.game_pk = o.game_pk AND a.team <> o.team GROUP BY 1, 2, 3),
form AS (
  SELECT g.team, g.game_pk, coalesce(g.f, 4.5e0) AS team_runs_per_game_30d, coalesce(r.f, 4.5e0) AS opp_runs_allowed_30d
  FROM (SELECT *, CASE WHEN count(runs_scored) OVER w >= 3 THEN avg(runs_scored) OVER w END AS f FROM tg
        WINDOW w AS (PARTITION BY team ORDER BY game_date, game_pk ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) g
  LEFT JOIN (SELECT *, CASE WHEN count(runs_allowed) OVER w >= 3 THEN avg(runs_allowed) OVER w END AS f FROM ra
        WINDOW w AS (PARTITION BY team ORDER BY game_date, game_pk ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) r ON g.team = r.team AND g.game_pk = r.game_pk)"""
MATRIX = f"""{TEAMGAME},
starters AS (SELECT game_pk, first(k_rate_14d ORDER BY innings_pitched DESC, pitcher, game_date) AS k, first(era_approx_14d ORDER BY innings_pitched DESC, pitcher, game_date) AS e,
             first(whiff_rate_14d ORDER BY innings_pitched DESC, pitcher, game_date) AS w, first(velo_mean_14d ORDER BY innings_pitched DESC, pitcher, game_date) AS v FROM pmatrix GROUP BY 1),
bmatrix AS (
  SELECT g.* EXCLUDE (points_game), g.points_game + coalesce(l.runs, 0) * 2 + coalesce(l.rbi, 0) * 2 + coalesce(l.stolen_bases, 0) * 5 AS points_game,
         coalesce(l.runs, 0) AS runs, coalesce(l.rbi, 0) AS rbi, coalesce(l.stolen_bases, 0) AS stolen_bases, o.batting_order, {MULT} AS batting_order_multiplier,
         coalesce(f.team_runs_per_game_30d, 4.5e0) AS team_runs_per_game_30d, coalesce(f.opp_runs_allowed_30d, 4.5e0) AS opp_runs_allowed_30d,
         coalesce(s.k, 0.22e0) AS opp_k_rate_14d, coalesce(s.e, 4.2e0) AS opp_era_approx_14d, coalesce(s.w, 0.24e0) AS opp_whiff_rate_14d, coalesce(s.v, 93.5e0) AS opp_velo_mean_14d
  FROM games g LEFT JOIN event_logs l ON g.batter = l.batter AND g.game_date = l.game_date
  LEFT JOIN orders_day o ON g.batter = o.batter AND g.game_date = o.game_date
  LEFT JOIN bt ON g.batter = bt.batter AND g.game_pk = bt.game_pk LEFT JOIN form f ON f.team = bt.team AND f.game_pk = g.game_pk
  LEFT JOIN starters s ON s.game_pk = g.game_pk)"""
MATRIX_VIEWS = ", ".join([GAME_VIEWS, b.EVENT_LOGS_SQL, b.EVENT_ORDERS_SQL, ORDERS_DAY, DAILY, PROLL, b.EVENT_PITCHING_SQL, PMATRIX, MATRIX])
_BM = S.batter_feature_columns()


def batter_matrix(t):
    p = t.once(b.pitches)
    starters = P.pitcher_feature_matrix(p, b.event_pitching_logs(t))
    return B.batter_feature_matrix(p, b.event_logs(t), b.event_orders(t), starters)


@query("D13_batter_feature_matrix", f"SELECT batter, game_date, game_pk, runs, rbi, stolen_bases, batting_order, pa_count, points_game, {', '.join(_BM)} FROM bmatrix", f"points_game {' '.join(_BM)}", views=MATRIX_VIEWS)
def _(t):
    return batter_matrix(t).select("batter", "game_date", "game_pk", "runs", "rbi", "stolen_bases", "batting_order", "pa_count", "points_game", *_BM)


# --- lookups, sets, distinct


@query("J10_second_to_last", """
SELECT batter, game_date, points_game FROM (
  SELECT *, row_number() OVER (PARTITION BY batter ORDER BY game_date DESC) AS rn, count(*) OVER (PARTITION BY batter) AS c FROM games) x WHERE rn = least(2, c)""",
       "points_game", views=GAME_VIEWS)
def _(t):
    pa = B.score_events(B.park_factor(B.platoon(B.batter_rolling(_pa(t)), b.pitches(t))))
    return SL.latest_usable(B.to_game_level(pa), "batter", ["game_date"]).select("batter", "game_date", "points_game")


@query("W11_second_to_last_row", """
SELECT batter, event_id FROM (SELECT batter, at_bat_number AS event_id, row_number() OVER (PARTITION BY batter ORDER BY game_date DESC, at_bat_number DESC) AS rn,
 count(*) OVER (PARTITION BY batter) AS c FROM pitches) x WHERE rn = least(2, c)""", views=b.PITCHES_SQL)
def _(t):
    return SL.latest_usable(b.pitches(t), "batter", ["game_date", "at_bat_number"]).select("batter", F.col("at_bat_number").alias("event_id"))


@query("D42_latest_features", f"""
SELECT pitcher, game_date, {', '.join(_PM)} FROM (SELECT *, row_number() OVER (PARTITION BY pitcher ORDER BY game_date DESC) AS rn, count(*) OVER (PARTITION BY pitcher) AS c FROM pmatrix) x WHERE rn = least(2, c)""",
       " ".join(_PM), views=PMATRIX_VIEWS)
def _(t):
    m = P.pitcher_feature_matrix(b.pitches(t), b.event_pitching_logs(t))
    return SL.latest_usable(m, "pitcher", ["game_date"]).select("pitcher", "game_date", *_PM)


@query("A06_having_min_rows", "SELECT batter, count(*) AS n FROM pitches GROUP BY 1 HAVING count(*) >= 50", views=b.PITCHES_SQL)
def _(t):
    return b.pitches(t).groupBy("batter").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 50)


@query("A07_distinct_counts", "SELECT count(DISTINCT batter) AS batters, count(DISTINCT pitcher) AS pitchers, count(DISTINCT game_pk) AS games FROM pitches", views=b.PITCHES_SQL)
def _(t):
    return b.pitches(t).agg(
        F.countDistinct("batter").alias("batters"), F.countDistinct("pitcher").alias("pitchers"), F.countDistinct("game_pk").alias("games")
    )


PA30 = """SELECT batter, CAST(trunc(CASE WHEN pa > 0 THEN CAST(pa AS DOUBLE) ELSE games * 3.8e0 END) AS BIGINT) AS pa_30d FROM (
  SELECT batter, sum(at_bats + walks + hit_by_pitch) AS pa, count(*) AS games FROM event_logs
  WHERE game_date >= DATE '2024-01-20' - INTERVAL 30 DAY GROUP BY 1) x"""


@query("A11_recent_plate_appearances", PA30, views=b.EVENT_LOGS_SQL)
def _(t):
    return SL.plate_appearances_30d(b.event_logs(t), F.lit("2024-01-20").cast("date")).select("batter", "pa_30d")


@query("D47_pa_30d", f"""
SELECT r.batter, coalesce(p.pa_30d, CAST(trunc(g.games * 3.8e0) AS BIGINT), 0) AS pa_30d
FROM (SELECT DISTINCT batter FROM pitches) r LEFT JOIN ({PA30.replace("DATE '2024-01-20'", "DATE '2024-02-20'")}) p ON r.batter = p.batter
LEFT JOIN (SELECT batter, count(*) AS games FROM (SELECT DISTINCT batter, game_date FROM pa) d WHERE game_date >= DATE '2024-02-20' - INTERVAL 30 DAY GROUP BY 1) g ON r.batter = g.batter""",
       views=f"{BASE}, {b.EVENT_LOGS_SQL}")
def _(t):
    today = F.lit("2024-02-20").cast("date")
    days = _pa(t).select("batter", "game_date").distinct()
    out = SL.plate_appearances_30d(b.event_logs(t), today, fallback=days, players=b.pitches(t).select("batter").distinct())
    return out.select("batter", "pa_30d")


@query("A29_high_water_mark", "SELECT season, max(game_date) AS last_date, CAST(max(game_date) + INTERVAL 1 DAY AS DATE) AS next_start FROM pitches GROUP BY 1", views=b.PITCHES_SQL)
def _(t):
    return src.high_water_mark(b.pitches(t), ["season"])


@query("U01_union_by_name", """
SELECT batter, game_date, runs, CAST(NULL AS DOUBLE) AS innings_pitched FROM event_logs
UNION ALL SELECT pitcher, game_date, NULL, innings_pitched FROM event_pitching""", "innings_pitched", views=f"{b.EVENT_LOGS_SQL}, {b.EVENT_PITCHING_SQL}")
def _(t):
    a = b.event_logs(t).select("batter", "game_date", "runs")
    c = b.event_pitching_logs(t).select(F.col("pitcher").alias("batter"), "game_date", "innings_pitched")
    return fr.union_all(a, c)


@query("U02_set_difference", "SELECT batter FROM pitches GROUP BY 1 HAVING count(*) >= 50 EXCEPT SELECT CAST(pitcher AS BIGINT) FROM pitches", views=b.PITCHES_SQL)
def _(t):
    p = b.pitches(t)
    many = p.groupBy("batter").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 50).select("batter")
    return many.exceptAll(p.select(F.col("pitcher").cast("bigint").alias("batter")).distinct())


@query("D22_qualified_ids", "SELECT batter AS player_id, count(*) AS n FROM pitches WHERE batter NOT IN (SELECT pitcher FROM pitches) GROUP BY 1 HAVING count(*) >= 50", views=b.PITCHES_SQL)
def _(t):
    return src.qualified_ids(b.pitches(t), min_rows=50)


@query("U05_keep_last", "SELECT batter, game_date, arg_max(at_bat_number, (game_pk, at_bat_number)) AS last_at_bat FROM pitches GROUP BY 1, 2", views=b.PITCHES_SQL)
def _(t):
    out = fr.keep_last(b.pitches(t), ["batter", "game_date"], [F.col("game_pk").desc(), F.col("at_bat_number").desc()])
    return out.select("batter", "game_date", F.col("at_bat_number").alias("last_at_bat"))


@query("U06_full_row_distinct", "SELECT DISTINCT home_team, away_team, p_throws, inning_topbot FROM pitches", views=b.PITCHES_SQL)
def _(t):
    return b.pitches(t).select("home_team", "away_team", "p_throws", "inning_topbot").distinct()


@query("U08_first_source_wins", """
SELECT batter, season, count(*) AS n FROM pitches p WHERE season = (SELECT max(season) FROM pitches q WHERE q.batter = p.batter AND q.season IN (4, 5)) GROUP BY 1, 2""", views=b.PITCHES_SQL)
def _(t):
    p = src.load_seasons(b.pitches(t), [5, 4]).withColumn("_priority", F.when(F.col("season") == 5, 0).otherwise(1))
    return fr.first_source(p, "_priority", ["batter"]).groupBy("batter", "season").agg(F.count(F.lit(1)).alias("n"))


@query("K13_total_order", f"SELECT batter, at_bat_number, row_number() OVER (PARTITION BY batter ORDER BY {ORDER}) AS seq FROM pitches", views=b.PITCHES_SQL)
def _(t):
    return prefix_sums(b.pitches(t), ["batter"], [F.col(c) for c in B.PITCH_ORDER], out="seq").select("batter", "at_bat_number", "seq")


@query("D98_posted_orders_view", "SELECT team, batting_order, mlbam_id, game_pk FROM event_orders WHERE game_date = DATE '2024-01-10'", views=f"{b.PITCHES_SQL}, {b.EVENT_ORDERS_SQL}")
def _(t):
    o = b.event_orders(t).filter(F.col("game_date") == F.lit("2024-01-10").cast("date"))
    return o.select("team", "batting_order", "mlbam_id", "game_pk").orderBy("team", "batting_order", "mlbam_id")


# --- JSON payloads of the events


@query("F36_json_navigation", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.note.text'), '') AS note FROM events""")
def _(t):
    props = F.from_json("props", "k int, note struct<text:string>")
    return t["events"].select("event_id", props["k"].alias("k"), F.coalesce(props["note"]["text"], F.lit("")).alias("note"))


@query("S09_flatten_game_logs", """
SELECT user_id AS batter, CAST(ts AS DATE) AS game_date, event_id AS game_pk, CAST(json_extract_string(props, '$.k') AS INTEGER) AS runs, 0 AS rbi, 0 AS stolen_bases FROM events""")
def _(t):
    from ..sources.payloads import flatten_hitting_logs

    e = t["events"]
    # Each event becomes a landed log document with one split; only "runs" is present in its stat block.
    doc = F.concat(
        F.lit('{"stats":[{"splits":[{"date":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('","game":{"gamePk":'), F.col("event_id").cast("string"),
        F.lit('},"stat":{"runs":'), F.get_json_object("props", "$.k"), F.lit("}}]}]}"),
    )
    logs = flatten_hitting_logs(e.select(F.col("user_id").alias("batter"), doc.alias("payload")), "payload", "batter")
    return logs.select("batter", "game_date", "game_pk", "runs", "rbi", "stolen_bases")
