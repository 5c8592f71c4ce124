"""Queries over line items, orders and suppliers presented as game logs of teams and pitchers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import outs_from_innings
from ..operators import batter as B
from ..operators import frames as fr
from ..operators import pitcher as P
from ..operators import quality as Q
from ..operators.ordered import first_row
from . import bindings as b
from .registry import query

OUT, PIT = b.OUTINGS_SQL, f"{b.OUTINGS_SQL}, {b.ORDER_PITCHING_SQL}"
TG = """tg AS (SELECT team, game_pk, CAST(sum(qty) AS DOUBLE) AS runs_scored, min(game_date) AS game_date FROM outings GROUP BY 1, 2)"""
RA = """ra AS (SELECT a.team, a.game_pk, a.game_date, arg_min(o.runs_scored, o.team) AS runs_allowed FROM tg a JOIN tg o ON a.game_pk = o.game_pk AND a.team <> o.team GROUP BY 1, 2, 3)"""
FORM = """form AS (
  SELECT g.team, g.game_pk, coalesce(g.f, 4.5e0) AS team_runs_per_game_30d, coalesce(r.f, 4.5e0) AS opp_runs_allowed_30d
  FROM (SELECT *, CASE WHEN count(runs_scored) OVER w >= 3 THEN avg(runs_scored) OVER w END AS f FROM tg
        WINDOW w AS (PARTITION BY team ORDER BY game_date, game_pk ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) g
  LEFT JOIN (SELECT *, CASE WHEN count(runs_allowed) OVER w >= 3 THEN avg(runs_allowed) OVER w END AS f FROM ra
        WINDOW w AS (PARTITION BY team ORDER BY game_date, game_pk ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) r ON g.team = r.team AND g.game_pk = r.game_pk)"""


def _games(t):
    return B.team_games(b.order_logs(t), B.player_teams(b.order_teams(t)))


@query("P04_month_holdout", """
SELECT year(game_date) AS y, month(game_date) AS m, CASE WHEN year(game_date) = 1998 AND month(game_date) = 5 THEN 'test' ELSE 'train' END AS part, count(*) AS n
FROM outings GROUP BY 1, 2, 3""", views=OUT)
def _(t):
    train, test = fr.holdout(b.outings(t), "game_date", 1998, 5)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy(F.year("game_date").alias("y"), F.month("game_date").alias("m"), "part").agg(F.count(F.lit(1)).alias("n"))


@query("P16_collision_coalesce", """
SELECT l_suppkey AS pitcher, o_orderkey AS game_pk, coalesce(r.er, 0) AS earned_runs
FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) x JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN (SELECT player, game_pk, er FROM outings WHERE er > 5) r ON l_suppkey = r.player AND l_orderkey = r.game_pk""", views=OUT)
def _(t):
    left = t["lineitem"].select(F.col("l_suppkey").alias("pitcher"), F.col("l_orderkey").alias("g")).distinct()
    left = left.join(t["orders"].select("o_orderkey"), F.col("g") == F.col("o_orderkey")).select("pitcher", F.col("g").alias("game_pk"))
    right = b.outings(t).filter(F.col("er") > 5).select(F.col("player").alias("pitcher"), "game_pk", F.col("er").alias("earned_runs"))
    return fr.ensure(left.join(right, ["pitcher", "game_pk"], "left"), {"earned_runs": 0})


@query("J03_inner_join_team", "SELECT player AS batter, game_pk, qty AS runs, team FROM outings", "runs", views=OUT)
def _(t):
    return b.order_logs(t).join(B.player_teams(b.order_teams(t)), ["batter", "game_pk"]).select("batter", "game_pk", "runs", "team")


@query("A03_team_game_totals", "SELECT * FROM tg", "runs_scored", views=f"{OUT}, {TG}")
def _(t):
    return _games(t)


@query("J04_opponent_runs", "SELECT tg.team, tg.game_pk, tg.runs_scored, ra.runs_allowed FROM tg LEFT JOIN ra ON tg.team = ra.team AND tg.game_pk = ra.game_pk", "runs_scored runs_allowed", views=f"{OUT}, {TG}, {RA}")
def _(t):
    return B.runs_allowed(_games(t)).select("team", "game_pk", "runs_scored", "runs_allowed")


@query("W04_lagged_team_means", "SELECT * FROM form", "team_runs_per_game_30d opp_runs_allowed_30d", views=f"{OUT}, {TG}, {RA}, {FORM}")
def _(t):
    return B.team_form(_games(t)).select("team", "game_pk", "team_runs_per_game_30d", "opp_runs_allowed_30d")


_D08 = """SELECT o.player AS batter, o.game_pk, coalesce(f.team_runs_per_game_30d, 4.5e0) AS team_runs_per_game_30d, coalesce(f.opp_runs_allowed_30d, 4.5e0) AS opp_runs_allowed_30d
FROM outings o LEFT JOIN form f ON o.team = f.team AND o.game_pk = f.game_pk"""


@query("D08_team_offense", _D08, "team_runs_per_game_30d opp_runs_allowed_30d", views=f"{OUT}, {TG}, {RA}, {FORM}")
def _(t):
    keys = b.order_logs(t).select("batter", "game_pk")
    return B.team_offense(keys, b.order_logs(t), b.order_teams(t)).select("batter", "game_pk", "team_runs_per_game_30d", "opp_runs_allowed_30d")


@query("J05_chained_left_joins", f"SELECT game_pk, count(*) AS n, avg(team_runs_per_game_30d) AS runs_for FROM ({_D08}) d GROUP BY 1", "runs_for", views=f"{OUT}, {TG}, {RA}, {FORM}")
def _(t):
    keys = b.order_logs(t).select("batter", "game_pk")
    return B.team_offense(keys, b.order_logs(t), b.order_teams(t)).groupBy("game_pk").agg(
        F.count(F.lit(1)).alias("n"), F.avg("team_runs_per_game_30d").alias("runs_for")
    )


_W = lambda w, lag=0: f"OVER (PARTITION BY pitcher ORDER BY game_date, game_pk ROWS BETWEEN {w - 1 + lag} PRECEDING AND {'1 PRECEDING' if lag else 'CURRENT ROW'})"
INNINGS = "inn AS (SELECT *, " + ", ".join(
    [f"coalesce(avg(innings_pitched) {_W(w)}, 0e0) AS ip_per_start_{w}d" for w in S.WINDOWS]
    + [f"coalesce(sum(innings_pitched) {_W(w, 1)} / nullif(count(innings_pitched) {_W(w, 1)}, 0), 0e0) AS ip_per_appearance_{w}d" for w in S.WINDOWS]
    + [f"coalesce(9e0 * sum(earned_runs) {_W(w)} / nullif(sum(innings_pitched) {_W(w)}, 0), 0e0) AS era_approx_{w}d" for w in (14, 30)]
) + " FROM order_pitching)"
_STARTS, _APPS = [f"ip_per_start_{w}d" for w in S.WINDOWS], [f"ip_per_appearance_{w}d" for w in S.WINDOWS]


@query("W05_innings_per_start", f"SELECT pitcher, game_pk, {', '.join(_STARTS)} FROM inn", " ".join(_STARTS), views=f"{PIT}, {INNINGS}")
def _(t):
    return P.innings_features(b.order_pitching(t)).select("pitcher", "game_pk", *_STARTS)


@query("W06_lagged_innings", f"SELECT pitcher, game_pk, {', '.join(_APPS)} FROM inn", " ".join(_APPS), views=f"{PIT}, {INNINGS}")
def _(t):
    return P.innings_features(b.order_pitching(t)).select("pitcher", "game_pk", *_APPS)


@query("W07_trailing_era", "SELECT pitcher, game_pk, era_approx_14d, era_approx_30d FROM inn", "era_approx_14d era_approx_30d", views=f"{PIT}, {INNINGS}")
def _(t):
    return P.era_features(b.order_pitching(t)).select("pitcher", "game_pk", "era_approx_14d", "era_approx_30d")


@query("D17_ip_features", f"SELECT pitcher, count(*) AS n, sum(CASE WHEN ip_per_start_7d >= 3 THEN 1e0 ELSE 0e0 END) AS starter_games, sum(ip_per_appearance_7d) AS s FROM inn GROUP BY 1", "starter_games s", dp=5, views=f"{PIT}, {INNINGS}")
def _(t):
    return P.innings_features(b.order_pitching(t)).groupBy("pitcher").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_starter").alias("starter_games"), F.sum("ip_per_appearance_7d").alias("s")
    )


@query("D18_era_features", "SELECT pitcher, max(era_approx_14d) AS worst, avg(era_approx_30d) AS mean FROM inn GROUP BY 1", "worst mean", views=f"{PIT}, {INNINGS}")
def _(t):
    return P.era_features(b.order_pitching(t)).groupBy("pitcher").agg(F.max("era_approx_14d").alias("worst"), F.avg("era_approx_30d").alias("mean"))


@query("W10_game_starter", """
SELECT game_pk, pitcher, innings_pitched FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY innings_pitched DESC, pitcher) AS rn FROM order_pitching) x WHERE rn = 1""",
       "innings_pitched", views=PIT)
def _(t):
    return B.game_starters(b.order_pitching(t)).select("game_pk", "pitcher", "innings_pitched")




def _pitcher_games(t):
    p = P.innings_features(P.era_features(b.order_pitching(t)))
    return p.withColumns({"k_rate_14d": F.col("strikeouts") / F.col("hits_allowed"), "whiff_rate_14d": F.col("walks_allowed") / 10.0, "velo_mean_14d": F.lit(90.0) + F.col("hits_allowed")})


_OPP = """SELECT n.o_orderkey AS game_pk, coalesce(CAST(s.strikeouts AS DOUBLE) / s.hits_allowed, 0.22e0) AS opp_k_rate_14d, coalesce(s.era_approx_14d, 4.2e0) AS opp_era_approx_14d,
       coalesce(s.walks_allowed / 10e0, 0.24e0) AS opp_whiff_rate_14d, coalesce(90e0 + s.hits_allowed, 93.5e0) AS opp_velo_mean_14d
FROM orders n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY innings_pitched DESC, pitcher) AS rn FROM inn) x WHERE rn = 1) s ON n.o_orderkey = s.game_pk"""


@query("D09_opposing_starter", _OPP, " ".join(S.STARTER_DEFAULTS), views=f"{PIT}, {INNINGS}")
def _(t):
    games = t["orders"].select(F.col("o_orderkey").alias("game_pk"))
    return B.opposing_starter(games, _pitcher_games(t)).select("game_pk", *S.STARTER_DEFAULTS)


@query("J06_starter_match_rate", """SELECT count(*) AS n, count(s.game_pk) AS matched FROM orders LEFT JOIN (SELECT DISTINCT game_pk FROM order_pitching) s ON o_orderkey = s.game_pk""", views=PIT)
def _(t):
    games = t["orders"].select(F.col("o_orderkey").alias("game_pk"))
    s = B.game_starters(b.order_pitching(t)).select("game_pk", "pitcher")
    return games.join(s, "game_pk", "left").agg(F.count(F.lit(1)).alias("n"), F.count("pitcher").alias("matched"))


LOGDAY = """pday AS (SELECT player AS pitcher, game_date, min(game_pk) AS game_pk, sum(n) AS strikeouts FROM outings GROUP BY 1, 2),
lday AS (SELECT pitcher, game_date, max(game_pk) AS game_pk, sum(innings_pitched) AS innings_pitched, sum(earned_runs) AS earned_runs, sum(strikeouts) AS strikeouts FROM order_pitching GROUP BY 1, 2)"""


def _joined_days(t):
    days = b.outings(t).groupBy(F.col("player").alias("pitcher"), "game_date").agg(F.min("game_pk").alias("game_pk"), F.sum("n").alias("strikeouts"))
    logs = b.order_pitching(t).groupBy("pitcher", "game_date").agg(
        F.max("game_pk").alias("game_pk"), F.sum("innings_pitched").alias("innings_pitched"), F.sum("earned_runs").alias("earned_runs"), F.sum("strikeouts").alias("strikeouts")
    )
    return P.join_logs(days, logs)


@query("J07_log_join_key_coalesce", "SELECT p.pitcher, p.game_date, coalesce(l.game_pk, p.game_pk) AS game_pk FROM pday p LEFT JOIN lday l ON p.pitcher = l.pitcher AND p.game_date = l.game_date", views=f"{PIT}, {LOGDAY}")
def _(t):
    return _joined_days(t).select("pitcher", "game_date", "game_pk")


@query("D16_pitcher_join_logs", """SELECT p.pitcher, p.game_date, p.strikeouts, l.strikeouts AS strikeouts_gl, l.innings_pitched, l.earned_runs, 0e0 AS wins
FROM pday p LEFT JOIN lday l ON p.pitcher = l.pitcher AND p.game_date = l.game_date""", "strikeouts_gl innings_pitched earned_runs wins", views=f"{PIT}, {LOGDAY}")
def _(t):
    out = _joined_days(t)
    return out.select("pitcher", "game_date", "strikeouts", F.col("strikeouts_gl").cast("double").alias("strikeouts_gl"), "innings_pitched", F.col("earned_runs").cast("double").alias("earned_runs"), "wins")


OUTS = "floor(innings_pitched) * 3 + round_even((innings_pitched - floor(innings_pitched)) * 3, 0)"


@query("F21_innings_to_outs", f"SELECT pitcher, game_pk, {OUTS} AS outs FROM order_pitching", "outs", views=PIT)
def _(t):
    return b.order_pitching(t).select("pitcher", "game_pk", outs_from_innings("innings_pitched").alias("outs"))


@query("D20_score_pitching", f"""
SELECT pitcher, game_pk, ({OUTS}) * 0.75e0 + strikeouts * 2 - earned_runs * 2 - 0.6e0 * (hits_allowed + walks_allowed) + 2.5e0 * complete_games + 2.5e0 * shutouts
       + CASE WHEN complete_games > 0 AND hits_allowed = 0 THEN 5 ELSE 0 END AS points_game FROM order_pitching""", "points_game", views=PIT)
def _(t):
    return P.score_pitching(b.order_pitching(t)).select("pitcher", "game_pk", "points_game")


@query("U04_keep_first", """
SELECT l_orderkey AS game_pk, l_suppkey AS first_supplier FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn FROM lineitem) x WHERE rn = 1""")
def _(t):
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey")
    return first_row(li, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_suppkey")]).select(F.col("l_orderkey").alias("game_pk"), F.col("l_suppkey").alias("first_supplier"))


@query("J17_semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT player FROM outings WHERE er > 20)", views=OUT)
def _(t):
    ids = b.outings(t).filter(F.col("er") > 20).select(F.col("player").alias("s_suppkey"))
    return t["supplier"].select("s_suppkey", "s_name").join(ids, "s_suppkey", "left_semi")


@query("J23_orphans", """SELECT 'customer' AS parent, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def _(t):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("parent"), "orphans")
    a = Q.orphans(t["orders"], "o_custkey", t["customer"], "c_custkey")
    c = Q.orphans(t["lineitem"].select("l_orderkey", "l_partkey"), "l_partkey", t["part"].filter(F.col("p_size") > 5), "p_partkey")
    return n(a, "customer").unionByName(n(c, "part"))


# --- data quality


@query("D70_domain_checks", """
SELECT rule, count(*) AS n FROM (
  SELECT unnest(list_filter([CASE WHEN NOT (l_quantity BETWEEN 2 AND 49) THEN 'quantity' END, CASE WHEN NOT (l_discount BETWEEN 0.01 AND 0.09) THEN 'discount' END,
                             CASE WHEN NOT (l_returnflag IN ('A', 'N')) THEN 'returnflag' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) v GROUP BY 1""")
def _(t):
    rules = [("quantity", "l_quantity BETWEEN 2 AND 49"), ("discount", "l_discount BETWEEN CAST(0.01 AS DOUBLE) AND CAST(0.09 AS DOUBLE)"), ("returnflag", "l_returnflag IN ('A', 'N')")]
    return Q.domain_violations(t["lineitem"], rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("D71_not_null", """SELECT 'launch' AS column_name, count(*) - count(nullif(l_tax, 0)) AS nulls, count(*) AS rows FROM lineitem
UNION ALL SELECT 'quantity', count(*) - count(l_quantity), count(*) FROM lineitem""")
def _(t):
    df = t["lineitem"].select(F.nullif("l_tax", F.lit(0.0)).alias("launch"), F.col("l_quantity").alias("quantity"))
    return Q.null_counts(df, ["launch", "quantity"])


@query("D72_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query("D73_orphan_keys", "SELECT l_suppkey AS key, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) GROUP BY 1")
def _(t):
    o = Q.orphans(t["lineitem"].select("l_suppkey", "l_orderkey"), "l_suppkey", t["supplier"].filter(F.col("s_acctbal") > 1000), "s_suppkey")
    return o.groupBy(F.col("l_suppkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
