"""Views that present the driver tables in the engine's schemas, in Spark and in DuckDB SQL.

Every view covers its whole table. The two texts of a view say the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PARK_FACTOR
from .registry import Tables

CODES = [*sorted(PARK_FACTOR), "XXX"]  # one code no park table knows
_CODES_SQL = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"

# --------------------------------------------------------------- events as pitches
# batter = user, pitcher = k of the JSON, game = day and k; 60 % of rows end a plate appearance.

_EVENT = {
    "purchase": "home_run", "signup": "double", "view": "single", "click": "walk", "error": "strikeout",
}
_EVENT_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _EVENT.items()) + " END"

_PITCH_COLUMNS = [
    ("season", "{week}"),
    ("game_pk", "{day} * 10 + k % 5"),
    ("game_date", "CAST(ts AS DATE)"),
    ("at_bat_number", "event_id"),
    ("pitch_number", "1"),
    ("batter", "user_id"),
    ("pitcher", "k"),
    ("events", f"CASE WHEN k % 10 IN (3, 6) THEN NULL WHEN k % 10 IN (4, 9) THEN '' ELSE {_EVENT_CASE} END"),
    ("description", "CASE k % 4 WHEN 0 THEN 'swinging_strike' WHEN 1 THEN 'foul' WHEN 2 THEN 'ball' ELSE 'hit_into_play' END"),
    ("pitch_type", "CASE k % 3 WHEN 0 THEN 'FF' WHEN 1 THEN 'SL' ELSE 'SI' END"),
    ("release_speed", "CASE WHEN event_type = 'signup' THEN NULL ELSE 80.0 + value / 23.0 END"),
    ("launch_speed", "CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE value / 3.7 END"),
    ("launch_speed_angle", "CASE WHEN event_type = 'click' THEN NULL ELSE k % 7 END"),
    ("estimated_woba_using_speedangle", "CASE WHEN event_type = 'error' THEN NULL ELSE value / 490.1 END"),
    ("babip_value", "CASE WHEN event_type IN ('view', 'signup') THEN 1.0 WHEN event_type = 'click' THEN NULL ELSE 0.0 END"),
    ("p_throws", "CASE WHEN k % 2 = 0 THEN 'R' ELSE 'L' END"),
    ("stand", "CASE WHEN user_id % 3 = 0 THEN 'L' ELSE 'R' END"),
    ("inning_topbot", "CASE WHEN event_id % 2 = 0 THEN 'Top' ELSE 'Bot' END"),
]


def _pitch_sql(week: str, day: str) -> str:
    return ", ".join(e.format(week=week, day=day) + f" AS {n}" for n, e in _PITCH_COLUMNS)


def pitches(t: Tables) -> DataFrame:
    src = t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    codes = "array(" + ", ".join(f"'{c}'" for c in CODES) + ")"
    week, day = "weekofyear(ts)", "datediff(CAST(ts AS DATE), DATE'2024-01-01')"
    return src.selectExpr(
        *[e.format(week=week, day=day) + f" AS {n}" for n, e in _PITCH_COLUMNS],
        f"element_at({codes}, k % 32 + 1) AS home_team",
        f"element_at({codes}, (k + 7) % 32 + 1) AS away_team",
    )


PITCHES_SQL = f"""
pitches AS (
  SELECT {_pitch_sql("CAST(week(ts) AS INTEGER)", "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))")},
         {_CODES_SQL}[k % 32 + 1] AS home_team, {_CODES_SQL}[(k + 7) % 32 + 1] AS away_team
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""


def event_logs(t: Tables) -> DataFrame:
    """Hitting logs, one row per batter and day, counted from the events."""
    e = t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("batter"), F.col("ts").cast("date").alias("game_date")).agg(
        F.min(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 10 + F.col("k") % 5).alias("game_pk"),
        n("purchase").alias("runs"), n("view").alias("rbi"), n("signup").alias("stolen_bases"),
        F.count(F.lit(1)).alias("at_bats"), n("click").alias("walks"), n("error").alias("hit_by_pitch"),
    )


EVENT_LOGS_SQL = """
event_logs AS (
  SELECT user_id AS batter, CAST(ts AS DATE) AS game_date,
         min(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 10 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS game_pk,
         count(*) FILTER (event_type = 'purchase') AS runs, count(*) FILTER (event_type = 'view') AS rbi,
         count(*) FILTER (event_type = 'signup') AS stolen_bases, count(*) AS at_bats,
         count(*) FILTER (event_type = 'click') AS walks, count(*) FILTER (event_type = 'error') AS hit_by_pitch
  FROM events GROUP BY 1, 2
)"""


def event_orders(t: Tables) -> DataFrame:
    """Posted batting orders: every (game, batter) pair of the events."""
    p = t.stored["pitches"] if "pitches" in t.stored else pitches(t)
    return p.groupBy("game_pk", "game_date", F.col("batter").alias("mlbam_id")).agg(
        F.min(F.when(F.col("inning_topbot") == "Top", F.col("away_team")).otherwise(F.col("home_team"))).alias("team"),
        F.min((F.col("batter") + F.col("game_pk")) % 11).cast("int").alias("batting_order"),
    )


EVENT_ORDERS_SQL = """
event_orders AS (
  SELECT game_pk, game_date, batter AS mlbam_id,
         min(CASE WHEN inning_topbot = 'Top' THEN away_team ELSE home_team END) AS team,
         min((batter + game_pk) % 11) AS batting_order
  FROM pitches GROUP BY 1, 2, 3
)"""


def event_pitching_logs(t: Tables) -> DataFrame:
    """Pitching logs, one row per pitcher and day, counted from the events."""
    e = t["events"].withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    n = lambda kind: F.count_if(F.col("event_type") == kind).cast("int")
    return e.groupBy(F.col("k").cast("bigint").alias("pitcher"), F.col("ts").cast("date").alias("game_date")).agg(
        F.min(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 10 + F.col("k") % 5).alias("game_pk"),
        ((F.count(F.lit(1)) - n("signup")) / 3.0).alias("innings_pitched"),
        n("error").alias("strikeouts"), n("purchase").alias("earned_runs"), n("view").alias("hits_allowed"),
        n("click").alias("walks_allowed"), (n("signup") * 0).alias("hit_batsmen"),
        F.when(n("error") > n("purchase"), 1).otherwise(0).alias("wins"),
        F.when(n("signup") > 1, 1).otherwise(0).alias("complete_games"),
        F.when(n("purchase") == 0, 1).otherwise(0).alias("shutouts"),
        F.lit(0).alias("no_hitters"),
    )


EVENT_PITCHING_SQL = """
event_pitching AS (
  SELECT k AS pitcher, game_date, min(gp) AS game_pk, (count(*) - count(*) FILTER (event_type = 'signup')) / 3.0 AS innings_pitched,
         count(*) FILTER (event_type = 'error') AS strikeouts, count(*) FILTER (event_type = 'purchase') AS earned_runs,
         count(*) FILTER (event_type = 'view') AS hits_allowed, count(*) FILTER (event_type = 'click') AS walks_allowed,
         0 AS hit_batsmen,
         CASE WHEN count(*) FILTER (event_type = 'error') > count(*) FILTER (event_type = 'purchase') THEN 1 ELSE 0 END AS wins,
         CASE WHEN count(*) FILTER (event_type = 'signup') > 1 THEN 1 ELSE 0 END AS complete_games,
         CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 1 ELSE 0 END AS shutouts, 0 AS no_hitters
  FROM (SELECT event_type, CAST(ts AS DATE) AS game_date, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 10 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS gp
        FROM events) e GROUP BY 1, 2
)"""

# --------------------------------------------------- line items as game logs
# player = supplier, team = its nation, game = order; one row per (supplier, order).


def outings(t: Tables) -> DataFrame:
    li = t["lineitem"].select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    o = t["orders"].select("o_orderkey", F.col("o_orderdate").cast("date").alias("game_date"))
    s = t["supplier"].select("s_suppkey", "s_nationkey")
    # The order is the key of the join that follows as well, so one shuffle serves both.
    per = li.repartition("l_orderkey").groupBy(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("game_pk")).agg(
        F.sum("l_quantity").alias("qty"), F.sum(F.floor(F.col("l_discount") * 100)).cast("int").alias("er"),
        F.min("l_linenumber").alias("slot"), F.count(F.lit(1)).cast("int").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("k"),
    )
    return (
        per.join(o, per.game_pk == o.o_orderkey)
        .join(s, per.player == s.s_suppkey)
        .select("player", "game_pk", "game_date", "qty", "er", "slot", "n", "k",
                F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("team"))
    )


OUTINGS_SQL = """
outings AS (
  SELECT l_suppkey AS player, l_orderkey AS game_pk, CAST(any_value(o_orderdate) AS DATE) AS game_date, sum(l_quantity) AS qty,
         CAST(sum(floor(l_discount * 100)) AS BIGINT) AS er, min(l_linenumber) AS slot, count(*) AS n,
         count(*) FILTER (l_returnflag = 'R') AS k, 'T' || any_value(s_nationkey) AS team
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
)"""


def team_outings(t: Tables) -> DataFrame:
    """The columns of the outings that logs and batting orders have."""
    return outings(t).select("player", "game_pk", "game_date", "qty", "slot", "team")


def order_logs(t: Tables) -> DataFrame:
    return t.once(team_outings).select(F.col("player").alias("batter"), "game_pk", "game_date", F.col("qty").alias("runs"))


def order_teams(t: Tables) -> DataFrame:
    return t.once(team_outings).select(F.col("player").alias("mlbam_id"), "game_pk", "game_date", "team", F.col("slot").alias("batting_order"))


def order_pitching(t: Tables) -> DataFrame:
    return outings(t).select(
        F.col("player").alias("pitcher"), "game_pk", "game_date", "team", (F.col("qty") / 3.0).alias("innings_pitched"),
        F.col("k").alias("strikeouts"), F.col("er").alias("earned_runs"), F.col("n").alias("hits_allowed"),
        F.col("slot").alias("walks_allowed"),
        F.when(F.col("n") > 1, 1).otherwise(0).alias("complete_games"), F.when(F.col("er") == 0, 1).otherwise(0).alias("shutouts"),
    )


ORDER_PITCHING_SQL = """
order_pitching AS (
  SELECT player AS pitcher, game_pk, game_date, team, qty / 3.0 AS innings_pitched, k AS strikeouts, er AS earned_runs,
         n AS hits_allowed, slot AS walks_allowed, CASE WHEN n > 1 THEN 1 ELSE 0 END AS complete_games,
         CASE WHEN er = 0 THEN 1 ELSE 0 END AS shutouts
  FROM outings
)"""

# --------------------------------------------------- line items as lineups
# lineup = order, member = part, slot = return flag, game = line status; slate = order month.


def lineup_rows(t: Tables) -> DataFrame:
    """One row per (lineup, member): repeats of a part in an order collapse to their first line."""
    li = t["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    p = t["part"].select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_orderkey").alias("lineup_id"), F.col("l_linenumber").alias("slot_idx"), F.col("l_returnflag").alias("slot"),
        F.col("l_partkey").alias("player_id"), F.col("l_suppkey").alias("line_key"), F.col("p_name").alias("name"),
        F.floor("l_extendedprice").cast("int").alias("salary"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("R"), F.lit("A"))).otherwise(F.array(F.lit("N"))).alias("position_eligibility"),
        F.col("p_brand").alias("team"), F.col("l_linestatus").alias("game"),
        F.when(F.col("p_size") <= 20, "confirmed_starting").when(F.col("p_size") <= 35, "projected_starting")
        .when(F.col("p_size") <= 40, "bench").when(F.col("p_size") <= 45, "scratched").otherwise("odd").alias("lineup_status"),
        (F.col("p_type") == "PROMO").alias("is_pitcher"), F.col("l_quantity").alias("pts_q50"),
        (F.col("l_discount") * 100).alias("ownership_proj"), F.col("l_tax").alias("leverage_score"),
    )


LINEUP_SQL = """
lineup_rows AS (
  SELECT l_orderkey AS lineup_id, l_linenumber AS slot_idx, l_returnflag AS slot, l_partkey AS player_id, l_suppkey AS line_key,
         p_name AS name, CAST(floor(l_extendedprice) AS BIGINT) AS salary,
         CASE WHEN p_size % 2 = 0 THEN ['R', 'A'] ELSE ['N'] END AS position_eligibility, p_brand AS team, l_linestatus AS game,
         CASE WHEN p_size <= 20 THEN 'confirmed_starting' WHEN p_size <= 35 THEN 'projected_starting'
              WHEN p_size <= 40 THEN 'bench' WHEN p_size <= 45 THEN 'scratched' ELSE 'odd' END AS lineup_status,
         p_type = 'PROMO' AS is_pitcher, l_quantity AS pts_q50, l_discount * 100 AS ownership_proj, l_tax AS leverage_score
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

# --------------------------------------------------- orders as contests


def contests(t: Tables) -> DataFrame:
    o = t["orders"]
    return o.select(
        F.col("o_orderkey").alias("contest_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("game_type"),
        F.concat(F.lit("MLB "), F.col("o_orderpriority")).alias("name"), (F.col("o_orderkey") % 40).cast("double").alias("entry_fee"),
        F.floor(F.col("o_totalprice") / 10).cast("int").alias("max_entries"), (F.col("o_orderkey") % 997).cast("int").alias("entries"),
        F.col("o_totalprice").alias("prize_pool"),
        F.expr("o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), 30, 0)").alias("start_utc"),
    )


CONTEST_SQL = """
contests AS (
  SELECT o_orderkey AS contest_id, o_custkey AS group_id, o_orderstatus AS game_type, 'MLB ' || o_orderpriority AS name,
         CAST(o_orderkey % 40 AS DOUBLE) AS entry_fee, CAST(floor(o_totalprice / 10) AS BIGINT) AS max_entries,
         o_orderkey % 997 AS entries, o_totalprice AS prize_pool,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(30) AS start_utc
  FROM orders
)"""

# --------------------------------------------------- parts as a player pool
# Two slates; team = brand, salaries spread over all tiers, a deterministic triple of projections.

_POOL = [
    ("slate_id", "CASE WHEN p_size <= 30 THEN 'S1' ELSE 'S2' END"),
    ("player_id", "p_partkey"),
    ("name", "p_name"),
    ("team", "upper(replace(p_brand, 'Brand#', 'B'))"),
    ("home_team", "CASE WHEN {brand} % 2 = 0 THEN 'B' || {brand} ELSE 'B' || ({brand} + 1) END"),
    ("away_team", "CASE WHEN {brand} % 2 = 0 THEN 'B' || ({brand} - 1) ELSE 'B' || {brand} END"),
    ("position", "CASE p_type WHEN 'PROMO' THEN 'SP' WHEN 'ECONOMY' THEN 'RP' WHEN 'LARGE' THEN '1B/OF' WHEN 'SMALL' THEN 'C' "
                 "WHEN 'MEDIUM' THEN 'OF' ELSE '2B/SS' END"),
    ("salary", "CAST(2000 + (p_partkey * 37) % 6500 AS {int})"),
    ("avg_points", "p_size * 3.717e-1"),
    ("is_pitcher", "p_type IN ('PROMO', 'ECONOMY')"),
    ("pts_q50", "(p_partkey * 13 % 997) / 3.37e1"),
    ("pts_q15", "(p_partkey * 13 % 997) / 3.37e1 * 4.5e-1"),
    ("pts_q85", "(p_partkey * 13 % 997) / 3.37e1 * 1.2e0 + (p_partkey * 7 % 23) / 1.3e0"),
    ("ownership_proj", "1e0 + (p_partkey * 7 % 41) / 1.3e0"),
    ("is_banned", "p_size = 7"),
    ("is_locked", "p_size = 9"),
]


def _pool_sql(brand: str, integer: str) -> str:
    return ", ".join(e.format(brand=brand, int=integer) + f" AS {n}" for n, e in _POOL)


def pool(t: Tables) -> DataFrame:
    exprs = [e.format(brand="CAST(substr(p_brand, 7) AS INT)", int="INT") + f" AS {n}" for n, e in _POOL]
    return t["part"].selectExpr(*exprs).withColumns({
        "opponent": F.expr("CASE WHEN team = home_team THEN away_team WHEN team = away_team THEN home_team END"),
        "position_eligibility": F.split(F.when(F.col("is_pitcher"), "P").otherwise(F.col("position")), "/"),
        "leverage_score": F.col("pts_q85") / F.col("ownership_proj"),
    })


POOL_SQL = f"""
pool AS (
  SELECT *, CASE WHEN team = home_team THEN away_team WHEN team = away_team THEN home_team END AS opponent,
         string_split(CASE WHEN is_pitcher THEN 'P' ELSE position END, '/') AS position_eligibility,
         pts_q85 / ownership_proj AS leverage_score
  FROM (SELECT {_pool_sql("CAST(substr(p_brand, 7) AS INTEGER)", "INTEGER")} FROM part) p
)"""


def totals(t: Tables) -> DataFrame:
    """Implied total per team, from its brand number; the highest brands have no market (NULL)."""
    brands = t["part"].select(F.expr("CAST(substr(p_brand, 7) AS INT)").alias("b")).distinct()
    return brands.select(
        F.concat(F.lit("B"), F.col("b").cast("string")).alias("team"),
        F.when(F.col("b") <= 22, F.lit(2.6) + F.col("b") * 0.13).alias("implied_total"),
    )


TOTALS_SQL = """
totals AS (
  SELECT 'B' || b AS team, CASE WHEN b <= 22 THEN 2.6e0 + b * 1.3e-1 END AS implied_total
  FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS b FROM part) x
)"""
