"""Queries over line items presented as lineups, scored on the part pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import code
from ..operators import lineup as L
from ..operators import quality as Q
from ..operators.ordered import top_rows
from . import bindings as b
from .registry import query

LU = b.LINEUP_SQL
FIRST = """lu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineup_id, player_id ORDER BY slot_idx, slot, line_key) AS rn FROM lineup_rows) x WHERE rn = 1)"""
BASE = f"{LU}, {FIRST}"
# Rules fitted to the line-item lineups: slots A, N, R instead of the real ones.
SLOTS = {"A": 1, "N": 2, "R": 2}
SIZE, CAP, FLOOR = 4, 200_000, 60_000
RULES = {"size": SIZE, "cap": CAP, "floor": FLOOR, "slots": SLOTS, "max_hitters": 2}


def lineups(t):
    return L.first_slot(b.lineup_rows(t))


def lineup_salaries(t):
    """The columns of the lineups that scores and overlaps have."""
    return lineups(t).select("lineup_id", "player_id", "salary")


def scored(t):
    rows = t.stored["lineup_salaries"] if "lineup_salaries" in t.stored else lineups(t)
    return L.score_lineups(rows, b.pool(t))


SCORE = """score AS (
  SELECT l.lineup_id, CAST(sum(l.salary) AS BIGINT) AS total_salary, coalesce(sum(p.pts_q50), 0) AS projected_pts, avg(p.leverage_score) AS leverage_score,
         avg(p.ownership_proj) AS ownership_proj,
         coalesce(sum(p.pts_q50), 0) + 1.2e0 * coalesce(avg(p.leverage_score), 0) - 0.1e0 * coalesce(avg(p.ownership_proj), 0) AS portfolio_score
  FROM lu l LEFT JOIN pool p ON l.player_id = p.player_id GROUP BY 1)"""
SCORED = f"{BASE}, {b.POOL_SQL}, {SCORE}"
_SD = "projected_pts leverage_score ownership_proj portfolio_score"


@query("J20_lineup_projection_lookup", """SELECT l.lineup_id, l.player_id, p.pts_q50 FROM lu l JOIN pool p ON l.player_id = p.player_id""", "pts_q50", views=f"{BASE}, {b.POOL_SQL}")
def _(t):
    return lineups(t).select("lineup_id", "player_id").join(b.pool(t).select("player_id", "pts_q50"), "player_id")


@query("A19_lineup_totals", "SELECT lineup_id, total_salary, projected_pts, leverage_score, ownership_proj FROM score", "projected_pts leverage_score ownership_proj", views=SCORED)
def _(t):
    return scored(t).drop("portfolio_score")


@query("D64_score_lineups", "SELECT * FROM score", _SD, views=SCORED)
def _(t):
    return scored(t)


@query("K01_top_portfolio", "SELECT lineup_id, portfolio_score FROM score ORDER BY round(portfolio_score, 8) DESC, lineup_id LIMIT 20", "portfolio_score", views=SCORED)
def _(t):
    return L.top_lineups(scored(t).withColumn("portfolio_score", F.round("portfolio_score", 8)), 20).select("lineup_id", "portfolio_score")


SETS = "sets AS (SELECT lineup_id, list_sort(list(DISTINCT player_id)) AS ids FROM lineup_rows GROUP BY 1)"


@query("U07_distinct_sets", "SELECT len(ids) AS size, count(DISTINCT ids) AS sets FROM sets GROUP BY 1", views=f"{LU}, {SETS}")
def _(t):
    return L.dedupe_lineups(b.lineup_rows(t)).groupBy("size").agg(F.count(F.lit(1)).alias("sets"))


@query("D63_dedupe_lineups", "SELECT min(lineup_id) AS lineup_id, count(*) AS copies, len(ids) AS size FROM sets GROUP BY ids", views=f"{LU}, {SETS}")
def _(t):
    return L.dedupe_lineups(b.lineup_rows(t))


EXPOSED = "ex AS (SELECT player_id, count(DISTINCT lineup_id) AS appearances, round(count(DISTINCT lineup_id) * 100e0 / (SELECT count(DISTINCT lineup_id) FROM lineup_rows), 4) AS exposure_pct FROM lineup_rows GROUP BY 1)"


@query("A16_player_exposure", "SELECT * FROM ex", "exposure_pct", views=f"{LU}, {EXPOSED}")
def _(t):
    return L.exposure_report(b.lineup_rows(t), dp=4)


@query("K07_top_exposures", "SELECT * FROM ex ORDER BY appearances DESC, player_id LIMIT 20", "exposure_pct", views=f"{LU}, {EXPOSED}")
def _(t):
    return L.exposure_report(b.lineup_rows(t), dp=4).orderBy(F.col("appearances").desc(), "player_id").limit(20)


USAGE = "SELECT player_id, count(DISTINCT lineup_id) AS appearances, count(DISTINCT lineup_id) * 100e0 / (SELECT count(DISTINCT lineup_id) FROM lineup_rows) AS usage_pct FROM lineup_rows WHERE slot = 'R' AND is_pitcher GROUP BY 1"


@query("A17_pitcher_usage", USAGE, "usage_pct", views=LU)
def _(t):
    return L.slot_usage(b.lineup_rows(t), slot="R")


@query("D66_exposure_report", """SELECT name, is_pitcher, count(*) AS appearances, round(count(*) * 100e0 / (SELECT count(DISTINCT lineup_id) FROM lineup_rows), 4) AS exposure_pct
FROM (SELECT DISTINCT lineup_id, name, is_pitcher FROM lineup_rows) x GROUP BY 1, 2""", "exposure_pct", views=LU)
def _(t):
    return L.exposure_report(b.lineup_rows(t), keys=("name", "is_pitcher"), dp=4)


@query("A20_portfolio_averages", "SELECT count(*) AS lineups, avg(total_salary) AS avg_salary, avg(projected_pts) AS avg_points, avg(leverage_score) AS avg_leverage FROM score", "avg_salary avg_points avg_leverage", dp=5, views=SCORED)
def _(t):
    return L.portfolio_summary(scored(t)).drop("salary_used_pct")


@query("D93_portfolio_summary", f"""SELECT count(*) AS lineups, avg(total_salary) AS avg_salary, avg(projected_pts) AS avg_points, avg(leverage_score) AS avg_leverage,
avg(total_salary) / {CAP} * 100 AS salary_used_pct FROM score""", "avg_salary avg_points avg_leverage salary_used_pct", dp=5, views=SCORED)
def _(t):
    return L.portfolio_summary(scored(t), cap=CAP)


@query("F18_display_format", "SELECT lineup_id, round(total_salary / 1000e0, 1) AS salary_k, round(projected_pts, 1) AS points FROM score", "salary_k points", views=SCORED)
def _(t):
    return scored(t).select("lineup_id", F.round(F.col("total_salary") / 1000.0, 1).alias("salary_k"), F.round("projected_pts", 1).alias("points"))


ROLL = "roll AS (SELECT lineup_id, count(*) AS players, CAST(sum(salary) AS BIGINT) AS total_salary, min(game) AS g0, max(game) AS g1, " + ", ".join(
    f"count(*) FILTER (slot = '{s}') AS slot_{s}" for s in SLOTS
) + ", count(*) FILTER (lineup_status = 'scratched') AS scratched, count(*) FILTER (lineup_status = 'odd') AS unknown, count(*) FILTER (lineup_status = 'projected_starting') AS projected FROM lineup_rows GROUP BY 1)"


@query("A22_slot_counts", "SELECT lineup_id, slot_A, slot_N, slot_R FROM roll", views=f"{LU}, {ROLL}")
def _(t):
    return L.lineup_rollup(b.lineup_rows(t), SLOTS).select("lineup_id", "slot_A", "slot_N", "slot_R")


@query("A23_duplicate_players", "SELECT lineup_id, player_id, count(*) AS n FROM lineup_rows GROUP BY 1, 2 HAVING count(*) > 1", views=LU)
def _(t):
    return b.lineup_rows(t).groupBy("lineup_id", "player_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


@query("A24_single_game_lineups", "SELECT lineup_id, players FROM roll WHERE g0 = g1", views=f"{LU}, {ROLL}")
def _(t):
    return L.lineup_rollup(b.lineup_rows(t), SLOTS).filter(F.col("first_game") == F.col("last_game")).select("lineup_id", "players")


@query("A25_team_hitters", "SELECT lineup_id, team, count(*) AS hitters FROM lineup_rows WHERE NOT is_pitcher GROUP BY 1, 2 HAVING count(*) > 1", views=LU)
def _(t):
    return b.lineup_rows(t).filter(~F.col("is_pitcher")).groupBy("lineup_id", "team").agg(F.count(F.lit(1)).alias("hitters")).filter(F.col("hitters") > 1)


# Bans by size; the locks are the three most expensive parts, as a user would pick a few.
CONSTRAINTS = """locks AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3),
cons AS (SELECT p_partkey AS player_id, p_size = 7 AS is_banned, p_partkey IN (SELECT p_partkey FROM locks) AS is_locked, p_name AS name FROM part)"""


def constraints(t):
    p = t["part"].select(F.col("p_partkey").alias("player_id"), "p_size", "p_retailprice", F.col("p_name").alias("name"))
    locks = p.orderBy(F.col("p_retailprice").desc(), "player_id").limit(3).select("player_id", F.lit(True).alias("is_locked"))
    out = p.filter(F.col("p_size") == 7).join(locks, "player_id", "full_outer").join(p.select("player_id", F.col("name").alias("n")), "player_id")
    return out.select("player_id", F.coalesce(F.col("p_size") == 7, F.lit(False)).alias("is_banned"), F.coalesce("is_locked", F.lit(False)).alias("is_locked"), F.col("n").alias("name"))


MISSING = "missing AS (SELECT r.lineup_id, c.player_id, c.name FROM roll r, cons c WHERE c.is_locked AND NOT EXISTS (SELECT 1 FROM lineup_rows x WHERE x.lineup_id = r.lineup_id AND x.player_id = c.player_id))"


@query("J22_required_missing", "SELECT lineup_id, name AS player_name, count(*) AS n FROM missing GROUP BY 1, 2", views=f"{LU}, {ROLL}, {CONSTRAINTS}, {MISSING}")
def _(t):
    return L.locked_missing(b.lineup_rows(t), constraints(t)).groupBy("lineup_id", "player_name").agg(F.count(F.lit(1)).alias("n"))


@query("D73_lineup_member_constraints", """
SELECT 'check' AS constraint_type, 'roster_position' AS rule, count(*) AS violations FROM lineup_rows HAVING count(*) > 0
UNION ALL SELECT 'reference', 'player_id', count(*) FROM lineup_rows WHERE player_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) HAVING count(*) > 0
UNION ALL SELECT 'reference', 'lineup_id', count(*) FROM lineup_rows WHERE lineup_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') HAVING count(*) > 0""", views=LU)
def _(t):
    """All rules of the table of lineup members; none of the slots A, N and R of the line items is a roster position."""
    rows = b.lineup_rows(t).select("lineup_id", "player_id", code("slot").alias("roster_position"))
    parents = {"lineups": t["orders"].filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), "players": t["part"].filter("p_size > 5").select(F.col("p_partkey").alias("id"))}
    return Q.check_table("lineup_players", rows, parents).drop("table_name")


@query("J22_thirty_locks", "SELECT lineup_id, count(*) AS missing FROM roll r, (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30) k WHERE NOT EXISTS (SELECT 1 FROM lineup_rows x WHERE x.lineup_id = r.lineup_id AND x.player_id = k.p_partkey) GROUP BY 1", views=f"{LU}, {ROLL}")
def _(t):
    p = t["part"].select(F.col("p_partkey").alias("player_id"), "p_retailprice", F.col("p_name").alias("name"))
    locks = p.orderBy(F.col("p_retailprice").desc(), "player_id").limit(30).select("player_id", F.lit(False).alias("is_banned"), F.lit(True).alias("is_locked"), "name")
    return L.locked_missing(b.lineup_rows(t), locks).groupBy("lineup_id").agg(F.count("*").alias("missing"))


@query("U10_unknown_slots", "SELECT lineup_id, list_sort(list_filter(list(DISTINCT slot), lambda s: s NOT IN ('A', 'N'))) AS unknown FROM lineup_rows GROUP BY 1 HAVING len(list_filter(list(DISTINCT slot), lambda s: s NOT IN ('A', 'N'))) > 0", views=LU)
def _(t):
    rows = b.lineup_rows(t).select("lineup_id", code("slot").alias("slot")).distinct()
    # At most one entry per slot code, so the list is bounded by the code set.
    out = rows.groupBy("lineup_id").agg(F.array_sort(F.array_except(F.collect_set("slot"), F.array(F.lit("A"), F.lit("N")))).alias("unknown"))
    return out.filter(F.size("unknown") > 0)


VIOL = f"""viol AS (
  SELECT lineup_id, 'player_count' AS rule, 'error' AS severity, CAST(NULL AS VARCHAR) AS player_name FROM roll WHERE players <> {SIZE}
  UNION ALL SELECT lineup_id, 'salary_cap', 'error', NULL FROM roll WHERE total_salary > {CAP}
  UNION ALL SELECT lineup_id, 'salary_floor', 'error', NULL FROM roll WHERE total_salary < {FLOOR}
  UNION ALL SELECT lineup_id, 'min_games', 'error', NULL FROM roll WHERE g0 = g1
  UNION ALL SELECT lineup_id, 'position_slots', 'error', NULL FROM roll WHERE slot_A <> 1
  UNION ALL SELECT lineup_id, 'position_slots', 'error', NULL FROM roll WHERE slot_N <> 2
  UNION ALL SELECT lineup_id, 'position_slots', 'error', NULL FROM roll WHERE slot_R <> 2
  UNION ALL SELECT lineup_id, 'no_duplicates', 'error', min(name) FROM lineup_rows GROUP BY lineup_id, player_id HAVING count(*) > 1
  UNION ALL SELECT lineup_id, 'max_hitters_per_team', 'error', NULL FROM lineup_rows WHERE NOT is_pitcher GROUP BY lineup_id, team HAVING count(*) > 2
  UNION ALL SELECT lineup_id, 'position_eligibility', 'error', name FROM lineup_rows WHERE NOT list_contains(position_eligibility, slot)
  UNION ALL SELECT lineup_id, 'no_scratched', 'error', name FROM lineup_rows WHERE lineup_status = 'scratched'
  UNION ALL SELECT lineup_id, 'lineup_status_unconfirmed', 'warning', name FROM lineup_rows WHERE lineup_status IN ('odd', 'projected_starting')
  UNION ALL SELECT l.lineup_id, 'no_banned', 'error', l.name FROM lineup_rows l JOIN cons c ON l.player_id = c.player_id WHERE c.is_banned
  UNION ALL SELECT lineup_id, 'locked_player_missing', 'error', name FROM missing)"""
VALID = f"{LU}, {ROLL}, {CONSTRAINTS}, {MISSING}, {VIOL}"


def violations(t):
    return L.validate_lineups(b.lineup_rows(t), constraints(t), **RULES)


@query("D68_validate_lineups", "SELECT lineup_id, rule, severity, player_name, count(*) AS n FROM viol GROUP BY 1, 2, 3, 4", views=VALID)
def _(t):
    # Nearly every row is a group of its own: shuffled first, no task counts the groups of a whole split.
    out = violations(t).repartition("lineup_id", "rule")
    return out.groupBy("lineup_id", "rule", "severity", "player_name").agg(F.count(F.lit(1)).alias("n"))


@query("A26_severity_tally", "SELECT severity, count(*) AS n FROM viol GROUP BY 1", views=VALID)
def _(t):
    return L.severity_tally(violations(t))


@query("D68_message_texts", f"""
SELECT lineup_id, players || ' players, where {SIZE} belong' AS message FROM roll WHERE players <> {SIZE}
UNION ALL SELECT lineup_id, 'slot N filled ' || slot_N || ' times instead of 2' FROM roll WHERE slot_N <> 2""", views=f"{LU}, {ROLL}")
def _(t):
    v = L.validate_lineups(b.lineup_rows(t), **RULES)
    return v.filter((F.col("rule") == "player_count") | F.startswith("message", F.lit("slot N "))).select("lineup_id", "message")


_TEXTS = f"""SELECT rule, message, count(*) AS n FROM (
SELECT 'player_count' AS rule, players || ' players, where {SIZE} belong' AS message FROM roll WHERE players <> {SIZE}
UNION ALL SELECT 'salary_cap', 'salaries add up to ' || format('{{:,}}', CAST(total_salary AS BIGINT)) || ', over the cap of {CAP:,}' FROM roll WHERE total_salary > {CAP}
UNION ALL SELECT 'salary_floor', 'salaries add up to ' || format('{{:,}}', CAST(total_salary AS BIGINT)) || ', under the floor of {FLOOR:,}' FROM roll WHERE total_salary < {FLOOR}
UNION ALL SELECT 'min_games', 'only one game (' || g0 || '); two or more are needed' FROM roll WHERE g0 = g1
UNION ALL SELECT 'position_slots', 'slot A filled ' || slot_A || ' times instead of 1' FROM roll WHERE slot_A <> 1
UNION ALL SELECT 'position_slots', 'slot N filled ' || slot_N || ' times instead of 2' FROM roll WHERE slot_N <> 2
UNION ALL SELECT 'position_slots', 'slot R filled ' || slot_R || ' times instead of 2' FROM roll WHERE slot_R <> 2
UNION ALL SELECT 'no_duplicates', min(name) || ' (' || player_id || ') is listed ' || count(*) || ' times' FROM lineup_rows GROUP BY lineup_id, player_id HAVING count(*) > 1
UNION ALL SELECT 'max_hitters_per_team', count(*) || ' hitters of team ' || team || ', over the limit of 2' FROM lineup_rows WHERE NOT is_pitcher GROUP BY lineup_id, team HAVING count(*) > 2
UNION ALL SELECT 'position_eligibility', name || ' is placed at ' || slot || ' and may play ' || array_to_string(position_eligibility, '/') FROM lineup_rows WHERE NOT list_contains(position_eligibility, slot)
UNION ALL SELECT 'no_scratched', name || ' does not play (scratched)' FROM lineup_rows WHERE lineup_status = 'scratched'
UNION ALL SELECT 'lineup_status_unconfirmed', name || ': status ' || CASE lineup_status WHEN 'odd' THEN 'unknown' ELSE lineup_status END || ' is not final' FROM lineup_rows WHERE lineup_status IN ('odd', 'projected_starting')
UNION ALL SELECT 'no_banned', l.name || ' is on the ban list' FROM lineup_rows l JOIN cons c ON l.player_id = c.player_id WHERE c.is_banned
UNION ALL SELECT 'locked_player_missing', 'lacks the locked ' || name || ' (' || player_id || ')' FROM missing
UNION ALL SELECT 'anti_stack', name || ' bats against this lineup''s pitcher' FROM lineup_rows h WHERE NOT is_pitcher AND EXISTS (
  SELECT 1 FROM lineup_rows a WHERE a.lineup_id = h.lineup_id AND a.is_pitcher AND translate(a.team, '12345', '23451') = h.team)) m GROUP BY 1, 2"""


@query("D68_all_message_texts", _TEXTS, views=f"{LU}, {ROLL}, {CONSTRAINTS}, {MISSING}")
def _(t):
    """Every rule with its message, the anti-stack rule included; a part's opponent is the brand with the next digits."""
    rows = b.lineup_rows(t).withColumn("opponent", F.translate("team", "12345", "23451"))
    out = L.validate_lineups(rows, constraints(t), anti_stack=True, **RULES)
    return out.groupBy("rule", "message").agg(F.count("*").alias("n"))


VERDICT = "verdict AS (SELECT r.*, coalesce(e.e, 0) AS errors FROM roll r LEFT JOIN (SELECT lineup_id, count(*) FILTER (severity = 'error') AS e FROM viol GROUP BY 1) e ON r.lineup_id = e.lineup_id)"
_SAFE = f"""SELECT count(*) AS lineup_count, count(*) FILTER (errors = 0) AS valid_lineup_count, count(*) FILTER (scratched > 0) AS with_scratched, count(*) FILTER (unknown > 0) AS with_unknown,
 count(*) FILTER (projected > 0) AS with_projected, count(*) FILTER (total_salary < {FLOOR}) AS below_floor, count(*) FILTER (total_salary BETWEEN 60000 AND 90000) AS in_low_band FROM verdict"""


@query("A27_batch_safety_counts", _SAFE, views=f"{VALID}, {VERDICT}")
def _(t):
    return L.safety_counts(L.lineup_verdicts(b.lineup_rows(t), violations(t)), floor=FLOOR, band=(60_000, 90_000))


@query("D69_export_safety", f"""
SELECT lineup_count, valid_lineup_count, len(blocking_issues) = 0 AS safe_to_export, blocking_issues, warnings FROM (
  SELECT *, list_filter([CASE WHEN valid_lineup_count < 20 THEN valid_lineup_count || ' valid lineups of the 20 that an export needs' END,
           CASE WHEN with_scratched > 0 THEN 'scratched players in ' || with_scratched || ' lineups' END,
           CASE WHEN below_floor > 0 THEN below_floor || ' lineups under the salary floor of 60,000' END,
           CASE WHEN with_unknown > 0 THEN '15 minutes to lock, players of unknown status in ' || with_unknown || ' lineups' END], lambda m: m IS NOT NULL) AS blocking_issues,
         list_filter([CASE WHEN with_projected > 0 THEN 'players not yet confirmed in ' || with_projected || ' lineups' END,
           CASE WHEN in_low_band > 0 THEN in_low_band || ' lineups use little of the cap: 60,000 to 90,000' END,
           CASE WHEN lineup_count < 20 THEN lineup_count || ' lineups made of 20 wanted' END], lambda m: m IS NOT NULL) AS warnings
  FROM ({_SAFE}) s) x""", views=f"{VALID}, {VERDICT}")
def _(t):
    v = L.lineup_verdicts(b.lineup_rows(t), violations(t))
    out = L.export_safety(v, minutes_to_lock=15, floor=FLOOR, band=(60_000, 90_000))
    return out.select("lineup_count", "valid_lineup_count", "safe_to_export", "blocking_issues", "warnings")


@query("W19_slot_instances", "SELECT lineup_id, slot, player_id, row_number() OVER (PARTITION BY lineup_id, slot ORDER BY slot_idx, player_id) AS instance FROM lu", views=BASE)
def _(t):
    return L.slot_instances(lineups(t)).select("lineup_id", "slot", "player_id", "instance")


WIDE = "wide AS (SELECT *, row_number() OVER (PARTITION BY lineup_id, slot ORDER BY slot_idx, player_id) AS inst, name || ' (' || player_id || ')' AS cell FROM lu)"
_WIDE_COLS = ", ".join(f"coalesce(max(cell) FILTER (slot = '{s}' AND inst = {i}), '') AS \"{s}_{i}\"" for s, i in (("R", 1), ("R", 2), ("A", 1), ("N", 1), ("N", 2)))


@query("S17_wide_lineups", f"SELECT lineup_id, {_WIDE_COLS} FROM wide GROUP BY 1", views=f"{BASE}, {WIDE}")
def _(t):
    return L.wide_lineups(lineups(t), columns=["R", "R", "A", "N", "N"])


@query("K14_display_order", "SELECT lineup_id, player_id, CASE slot WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS slot_place FROM lu", views=BASE)
def _(t):
    return L.display_order(lineups(t), slots=list(SLOTS)).select("lineup_id", "player_id", "slot_place")


TOP = "top20 AS (SELECT lineup_id FROM score ORDER BY round(portfolio_score, 8) DESC, lineup_id LIMIT 20)"


@query("D67_overlap_with_portfolio", """
SELECT l.lineup_id, coalesce(max(c), 0) AS max_shared, coalesce(count(*) FILTER (c > 1), 0) AS over_cap FROM (SELECT DISTINCT lineup_id FROM lu) l LEFT JOIN (
  SELECT a.lineup_id, o.lineup_id AS other, count(*) AS c FROM lu a JOIN lu o ON a.player_id = o.player_id AND a.lineup_id <> o.lineup_id
  WHERE o.lineup_id IN (SELECT lineup_id FROM top20) GROUP BY 1, 2) s ON l.lineup_id = s.lineup_id GROUP BY 1""", views=f"{SCORED}, {TOP}")
def _(t):
    rows = t.once(lineup_salaries)
    best = L.top_lineups(scored(t).withColumn("portfolio_score", F.round("portfolio_score", 8)), 20).select("lineup_id")
    return L.overlap_with(rows, rows.join(best, "lineup_id", "left_semi"), cap=1)


def _by_slate(t):
    """Lineups and scores with the order year as slate."""
    years = t["orders"].select(F.col("o_orderkey").alias("lineup_id"), F.year("o_orderdate").cast("string").alias("slate_id"))
    return lineups(t).join(years, "lineup_id"), scored(t).join(years, "lineup_id")


# The sequential pass in SQL: one step per candidate and slate, carrying the members taken so far.
GREEDY = """cand AS (SELECT slate_id, lineup_id, ps, members, row_number() OVER (PARTITION BY slate_id ORDER BY ps DESC, lineup_id) AS rn FROM (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS slate_id, s.lineup_id, round(portfolio_score, 8) AS ps, members FROM score s JOIN orders ON s.lineup_id = o_orderkey
  JOIN (SELECT lineup_id, list(player_id) AS members FROM lu GROUP BY 1) m ON m.lineup_id = s.lineup_id) c),
steps AS (
  SELECT DISTINCT slate_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS held, CAST(0 AS BIGINT) AS taken, FALSE AS ok FROM cand
  UNION ALL
  SELECT slate_id, rn, CASE WHEN ok THEN list_concat(held, members) ELSE held END, taken + CAST(ok AS BIGINT), ok FROM (
    SELECT c.slate_id, c.rn, c.members, s.held, s.taken, s.taken < 20 AND len(list_filter(c.members, lambda m: (len(list_filter(s.held, lambda x: x = m)) + 1) / 20e0 > 0.1e0)) = 0 AS ok
    FROM steps s JOIN cand c ON c.slate_id = s.slate_id AND c.rn = s.rn + 1) n),
picked AS (SELECT c.slate_id, c.lineup_id, c.ps AS portfolio_score, s.taken AS pick, c.members FROM steps s JOIN cand c ON c.slate_id = s.slate_id AND c.rn = s.rn WHERE s.ok)"""
PICKED = f"RECURSIVE {SCORED}, {GREEDY}"


def _picked(t):
    rows, s = _by_slate(t)
    return rows, L.exposure_select(rows, s.withColumn("portfolio_score", F.round("portfolio_score", 8)), n=20, default=0.10)


@query("D65_exposure_select", "SELECT slate_id, lineup_id, portfolio_score, pick FROM picked", "portfolio_score", views=PICKED)
def _(t):
    return _picked(t)[1].select("slate_id", "lineup_id", "portfolio_score", "pick")


@query("W18_running_exposure", "SELECT slate_id, player_id, count(*) AS appearances FROM (SELECT slate_id, unnest(members) AS player_id FROM picked) x GROUP BY 1, 2", views=PICKED)
def _(t):
    rows, chosen = _picked(t)
    chosen = chosen.select("slate_id", "lineup_id")
    return rows.join(chosen, ["slate_id", "lineup_id"]).groupBy("slate_id", "player_id").agg(F.count(F.lit(1)).alias("appearances"))


@query("D68_export_format", f"""
SELECT lineup_id, rule, count(*) AS n FROM (
  SELECT lineup_id, 'player_count' AS rule FROM roll WHERE players <> {SIZE} UNION ALL SELECT lineup_id, 'salary_cap' FROM roll WHERE total_salary > {CAP}
  UNION ALL SELECT lineup_id, 'position_slots' FROM roll WHERE slot_A <> 1 UNION ALL SELECT lineup_id, 'position_slots' FROM roll WHERE slot_N <> 2
  UNION ALL SELECT DISTINCT lineup_id, 'unknown_slot' FROM lineup_rows WHERE slot = 'R') v GROUP BY 1, 2""", views=f"{LU}, {ROLL}")
def _(t):
    v = L.export_format_errors(b.lineup_rows(t), {"A": 1, "N": 2}, SIZE, CAP)
    return v.groupBy("lineup_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("K09_argmax_row", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS slate_id, arg_max(lineup_id, (total_salary, -lineup_id)) AS lineup_id, max(total_salary) AS total_salary
FROM score JOIN orders ON lineup_id = o_orderkey GROUP BY 1""", views=SCORED)
def _(t):
    _, s = _by_slate(t)
    at = F.struct("total_salary", (-F.col("lineup_id")).alias("i"))
    return s.groupBy("slate_id").agg(F.max_by("lineup_id", at).alias("lineup_id"), F.max("total_salary").alias("total_salary"))


@query("K01_top_lineups_per_slate", """
SELECT slate_id, lineup_id FROM (SELECT CAST(year(o_orderdate) AS VARCHAR) AS slate_id, lineup_id,
 row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY round(portfolio_score, 8) DESC, lineup_id) AS rn FROM score JOIN orders ON lineup_id = o_orderkey) x WHERE rn <= 3""", views=SCORED)
def _(t):
    _, s = _by_slate(t)
    return top_rows(s, ["slate_id"], [F.round("portfolio_score", 8).desc(), F.col("lineup_id")], 3).select("slate_id", "lineup_id")
