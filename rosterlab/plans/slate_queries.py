"""Queries over parts presented as a player pool, and orders presented as contests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.columns import blend, clean, clip, code, logistic, ratio, rescale, signed_power
from ..functions.normal import hash_uniform
from ..operators import batter as B
from ..operators import ownership as O
from ..operators import project as PR
from ..operators import report as R
from ..operators import slate as SL
from ..operators.ordered import with_group_stats
from ..sources.payloads import implied_rows
from . import bindings as b
from .registry import query

P, TOT = b.POOL_SQL, b.TOTALS_SQL
PT = f"{P}, {TOT}"


# --- contests

TODAY = "1998-05-10"
QUAL = """qual AS (SELECT * FROM (SELECT *, CAST(start_utc - CASE
    WHEN start_utc >= make_timestamp(year(start_utc), 4, 1 + (7 - dayofweek(make_date(year(start_utc), 4, 1))) % 7, 7, 0, 0)
     AND start_utc < make_timestamp(year(start_utc), 10, 31 - dayofweek(make_date(year(start_utc), 10, 31)), 6, 0, 0) THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS TIMESTAMP) AS local
  FROM contests) c WHERE game_type = 'F' AND contains(name, 'MLB') AND entry_fee <= 25 AND max_entries >= 5000 AND group_id IS NOT NULL {day})"""
ANY_DAY, ONE_DAY = QUAL.format(day=""), QUAL.format(day=f"AND CAST(local AS DATE) = DATE '{TODAY}'")


def _today(d=TODAY):
    return F.lit(d).cast("date")


@query("P07_contest_qualification", "SELECT contest_id, group_id, CAST(local AS DATE) AS local_date FROM qual", views=f"{b.CONTEST_SQL}, {ONE_DAY}")
def _(t):
    q = SL.qualifying_contests(b.contests(t), _today(), game_type="F")
    return q.select("contest_id", "group_id", F.to_date("start_local").alias("local_date"))


@query("F32_time_zone", "SELECT contest_id, strftime(start_utc::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%I:%M %p') AS wall FROM contests", views=b.CONTEST_SQL)
def _(t):
    c = b.contests(t)
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("start_utc"))
    return c.select("contest_id", F.date_format(local, "hh:mm a").alias("wall"))


ROLLUP = """roll AS (SELECT group_id, count(*) AS contest_count, max(max_entries) AS max_entries, sum(entries) AS total_entries, max(prize_pool) AS max_prize_pool,
  min(start_utc) AS lock_time, arg_max(name, (max_entries, -contest_id)) AS name FROM {src} GROUP BY 1)"""


@query("A09_contest_rollup", "SELECT group_id, contest_count, max_entries, CAST(total_entries AS BIGINT) AS total_entries, max_prize_pool, name FROM roll", "max_prize_pool", views=f"{b.CONTEST_SQL}, {ROLLUP.format(src='contests')}")
def _(t):
    return SL.contest_rollup(b.contests(t)).drop("lock_time")


@query("K09_largest_contest", "SELECT group_id, name, max_entries FROM roll ORDER BY max_entries DESC, group_id LIMIT 1", views=f"{b.CONTEST_SQL}, {ROLLUP.format(src='contests')}")
def _(t):
    best = SL.contest_rollup(b.contests(t)).agg(F.max(F.struct("max_entries", (-F.col("group_id")).alias("g"), "name")).alias("m"))
    return best.select((-F.col("m.g")).alias("group_id"), "m.name", "m.max_entries")


@query("K11_slate_order", "SELECT group_id, row_number() OVER (ORDER BY max_entries DESC, group_id) AS place FROM roll", views=f"{b.CONTEST_SQL}, {ROLLUP.format(src='contests')}")
def _(t):
    from ..operators.ordered import prefix_sums

    rows = SL.contest_rollup(b.contests(t)).select("group_id", "max_entries")
    placed = prefix_sums(rows, [], [F.col("max_entries").desc(), F.col("group_id")], out="place")
    return placed.select("group_id", "place")


@query("D37_qualifying_slates", "SELECT group_id, contest_count, max_entries, CAST(total_entries AS BIGINT) AS total_entries, max_prize_pool, name FROM roll", "max_prize_pool", views=f"{b.CONTEST_SQL}, {ONE_DAY}, {ROLLUP.format(src='qual')}")
def _(t):
    return SL.qualifying_slates(b.contests(t), _today(), game_type="F").drop("lock_time", "lock_time_local")


# --- filters and text


@query("P08_position_filter", """SELECT 'ALL' AS choice, count(*) AS n FROM pool UNION ALL SELECT 'HITTERS', count(*) FROM pool WHERE NOT is_pitcher
UNION ALL SELECT 'SP', count(*) FROM pool WHERE is_pitcher AND position = 'SP' UNION ALL SELECT 'OF', count(*) FROM pool WHERE list_contains(position_eligibility, 'OF')""", views=P)
def _(t):
    p = b.pool(t)
    count = lambda c: F.count_if(R.position_filter(c)).alias(c)
    wide = p.agg(*[count(c) for c in ("ALL", "HITTERS", "SP", "OF")])
    return wide.unpivot([], ["ALL", "HITTERS", "SP", "OF"], "choice", "n")


@query("P09_search", "SELECT player_id, name, team FROM pool WHERE contains(lower(name), 'ring') OR contains(lower(team), 'ring')", views=P)
def _(t):
    return b.pool(t).filter(R.search_filter(" RING ")).select("player_id", "name", "team")


@query("P10_salary_team_filter", "SELECT player_id, salary FROM pool WHERE salary BETWEEN 3000 AND 5000 AND team IN ('B1', 'B2')", views=P)
def _(t):
    return b.pool(t).filter(F.col("salary").between(3000, 5000) & F.col("team").isin("B1", "B2")).select("player_id", "salary")


@query("P11_any_eligibility", "SELECT player_id FROM pool WHERE list_has_any(position_eligibility, ['1B', 'SS'])", views=P)
def _(t):
    return b.pool(t).filter(F.arrays_overlap("position_eligibility", F.array(F.lit("1B"), F.lit("SS")))).select("player_id")


@query("P12_multi_eligible", "SELECT player_id, len(position_eligibility) AS n FROM pool WHERE len(position_eligibility) > 1", views=P)
def _(t):
    return b.pool(t).select("player_id", F.size("position_eligibility").alias("n")).filter(F.col("n") > 1)


STATUS = "status AS (SELECT p_partkey AS player_id, CASE WHEN p_size <= 3 THEN 'unavailable' ELSE 'dtd' END AS status FROM part WHERE p_size <= 5)"


def _status(t):
    return t["part"].filter(F.col("p_size") <= 5).select(F.col("p_partkey").alias("player_id"), F.when(F.col("p_size") <= 3, "unavailable").otherwise("dtd").alias("status"))


@query("P13_status_filter", "SELECT player_id, pts_q50 FROM pool WHERE NOT is_banned AND player_id NOT IN (SELECT player_id FROM status WHERE status = 'unavailable')", "pts_q50", views=f"{P}, {STATUS}")
def _(t):
    out = b.pool(t).filter(~F.col("is_banned"))
    return out.join(_status(t).filter(F.col("status") == "unavailable"), "player_id", "left_anti").select("player_id", "pts_q50")


@query("J18_anti_join_bans", "SELECT slate_id, count(*) AS n FROM pool WHERE player_id NOT IN (SELECT player_id FROM status) GROUP BY 1", views=f"{P}, {STATUS}")
def _(t):
    return b.pool(t).join(_status(t), "player_id", "left_anti").groupBy("slate_id").agg(F.count(F.lit(1)).alias("n"))


@query("U03_union_of_bans", "SELECT player_id FROM pool WHERE is_banned UNION SELECT player_id FROM status", views=f"{P}, {STATUS}")
def _(t):
    return b.pool(t).filter("is_banned").select("player_id").union(_status(t).select("player_id")).distinct()


@query("P14_flags", "SELECT player_id, pts_q50 > 25 AS inflated FROM pool", views=P)
def _(t):
    return R.value_flags(b.pool(t)).select("player_id", "inflated")


@query("A10_market_mean_and_flags", "SELECT team, implied_total, CASE WHEN implied_total > 5 THEN 'HOT' WHEN implied_total < 3.5 THEN 'COLD' ELSE '' END AS flag FROM totals WHERE implied_total IS NOT NULL", "implied_total", views=TOT)
def _(t):
    rows = b.totals(t).withColumns({"fetched_at": F.lit("2026-01-01"), "game_id": F.lit("g"), "bookmaker": F.lit("b")})
    return SL.market_flags(SL.team_totals(rows))


@query("D32_team_totals", "SELECT team, avg(x) AS implied_total FROM (SELECT team, implied_total + salary / 1e5 AS x FROM pool JOIN totals USING (team)) q WHERE x IS NOT NULL GROUP BY 1", "implied_total", views=PT)
def _(t):
    books = b.pool(t).select("team", "salary").join(b.totals(t), "team").select("team", (F.col("implied_total") + F.col("salary") / 1e5).alias("implied_total"))
    return SL.team_totals(books, how="mean")


@query("P18_fallback_constants", "SELECT player_id, CASE WHEN is_pitcher THEN 15e0 ELSE 10e0 END AS ownership_pct, 1e0 / count(*) OVER (PARTITION BY slate_id) AS frequency FROM pool", "ownership_pct frequency", views=P)
def _(t):
    p = b.pool(t)
    return O.flat_ownership(p).join(O.uniform_frequency(p), ["slate_id", "player_id"]).select("player_id", "ownership_pct", "frequency")


ACTIONS = """actions AS (SELECT slate_id, player_id, 'ban' AS action, 1 AS at_no, NULL::DOUBLE AS max_exposure FROM pool WHERE salary > 6000
  UNION ALL SELECT slate_id, player_id, 'lock', 2, 0.4e0 FROM pool WHERE salary > 7500 UNION ALL SELECT slate_id, player_id, 'clear', 3, NULL FROM pool WHERE salary > 8000)"""


@query("P19_constraint_overlay", """SELECT p.player_id, CASE WHEN a.action = 'lock' THEN TRUE WHEN a.action IN ('ban', 'clear') THEN FALSE ELSE is_locked END AS is_locked,
 CASE WHEN a.action = 'ban' THEN TRUE WHEN a.action IN ('lock', 'clear') THEN FALSE ELSE is_banned END AS is_banned, a.max_exposure FROM pool p LEFT JOIN (
  SELECT slate_id, player_id, arg_max(action, at_no) AS action, arg_max(max_exposure, at_no) FILTER (max_exposure IS NOT NULL) AS max_exposure FROM actions GROUP BY 1, 2) a ON p.slate_id = a.slate_id AND p.player_id = a.player_id""",
       "max_exposure", views=f"{P}, {ACTIONS}")
def _(t):
    p = b.pool(t)
    act = lambda lo, name, at, exp: p.filter(F.col("salary") > lo).select("slate_id", "player_id", F.lit(name).alias("action"), F.lit(at).alias("at"), F.lit(exp).cast("double").alias("max_exposure"))
    actions = act(6000, "ban", 1, None).union(act(7500, "lock", 2, 0.4)).union(act(8000, "clear", 3, None))
    return SL.constraint_overlay(p, actions).select("player_id", "is_locked", "is_banned", "max_exposure")


@query("F01_clean_text", "SELECT player_id, upper(trim(' ' || name)) AS code, '' AS missing FROM pool", views=P)
def _(t):
    return b.pool(t).select("player_id", code(F.concat(F.lit(" "), F.col("name"))).alias("code"), clean(F.lit(None).cast("string")).alias("missing"))


@query("F02_split_positions", "SELECT player_id, list_filter(list_transform(string_split(position || '/ ', '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pool", views=P)
def _(t):
    return b.pool(t).select("player_id", X.split_positions(F.concat("position", F.lit("/ "))).alias("parts"))


@query("F03_join_array", "SELECT player_id, array_to_string(position_eligibility, '/') AS joined FROM pool", views=P)
def _(t):
    return b.pool(t).select("player_id", F.array_join("position_eligibility", "/").alias("joined"))


@query("F04_primary_position", "SELECT player_id, coalesce(nullif(trim(split_part(CASE WHEN salary < 2500 THEN ' ' ELSE position END, '/', 1)), ''), 'UNK') AS bucket FROM pool", views=P)
def _(t):
    pos = F.when(F.col("salary") < 2500, " ").otherwise(F.col("position"))
    return b.pool(t).select("player_id", X.primary_position(pos).alias("bucket"))


@query("F22_clip", "SELECT player_id, least(greatest(pts_q50, 2), 9) AS v FROM pool", "v", views=P)
def _(t):
    return b.pool(t).select("player_id", clip("pts_q50", 2.0, 9.0).alias("v"))


@query("F23_logistic", "SELECT player_id, 1 / (1 + exp(-(pts_q50 - 10))) AS v FROM pool", "v", views=P)
def _(t):
    return b.pool(t).select("player_id", logistic(F.col("pts_q50") - 10).alias("v"))


@query("F24_signed_power", "SELECT player_id, sign(pts_q50 - 10) * pow(abs(pts_q50 - 10), 0.7e0) AS v FROM pool", "v", views=P)
def _(t):
    return b.pool(t).select("player_id", signed_power(F.col("pts_q50") - 10, 0.7).alias("v"))


@query("F25_linear_rescale", """SELECT player_id, CASE WHEN hi > lo THEN 2 + (pts_q50 - lo) / (hi - lo) * 26 ELSE 15 END AS v
FROM pool JOIN (SELECT team AS tm, min(pts_q50) AS lo, max(pts_q50) AS hi FROM pool GROUP BY 1) g ON team = tm""", "v", views=P)
def _(t):
    out = with_group_stats(b.pool(t), ["team"], {"lo": F.min("pts_q50"), "hi": F.max("pts_q50")})
    return out.select("player_id", rescale("pts_q50", "lo", "hi", F.lit(2.0), F.lit(28.0)).alias("v"))


@query("F26_linear_blend", "SELECT player_id, c * pts_q50 + (1 - c) * 7 AS v FROM (SELECT *, least(salary / 8000e0, 1) AS c FROM pool) x", "v", views=P)
def _(t):
    return b.pool(t).select("player_id", blend(F.least(F.col("salary") / 8000.0, F.lit(1.0)), "pts_q50", F.lit(7.0)).alias("v"))


@query("F27_safe_divide", "SELECT player_id, coalesce(pts_q50 / nullif(salary - 2000, 0), 0) AS a, pts_q50 / greatest(avg_points - 5, 0.1e0) AS b FROM pool", "a b", views=P)
def _(t):
    return b.pool(t).select("player_id", ratio("pts_q50", F.col("salary") - 2000).alias("a"), (F.col("pts_q50") / F.greatest(F.col("avg_points") - 5, F.lit(0.1))).alias("b"))


@query("F34_list_functions", "SELECT player_id, list_contains(position_eligibility, 'OF') AS has, len(position_eligibility) AS n, list_has_any(position_eligibility, ['C', 'P']) AS any_of FROM pool", views=P)
def _(t):
    e = F.col("position_eligibility")
    return b.pool(t).select("player_id", F.array_contains(e, "OF").alias("has"), F.size(e).alias("n"), F.arrays_overlap(e, F.array(F.lit("C"), F.lit("P"))).alias("any_of"))


@query("F38_map_signature", "SELECT team, count(*) AS n, " + " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS HUGEINT)) AS VARCHAR)" for i in range(4)) + """ AS signature
FROM (SELECT team, md5(player_id || chr(1) || name) AS h FROM pool) x GROUP BY 1""", views=P)
def _(t):
    return SL.map_signature(b.pool(t), "player_id", "name", by=["team"])


@query("F39_output_rounding", "SELECT player_id, round(pts_q50, 2) AS q50, round(leverage_score, 3) AS lev FROM pool", "q50 lev", views=P)
def _(t):
    return b.pool(t).select("player_id", F.round("pts_q50", 2).alias("q50"), F.round("leverage_score", 3).alias("lev"))


@query("F40_source_labels", "SELECT player_id, CASE WHEN abs(pts_q50 - avg_points) > 0.1 THEN 'MODEL' ELSE 'AVG' END AS source, round(pts_q50 - avg_points, 2) AS diff FROM pool", "diff", views=P)
def _(t):
    return R.model_vs_average(b.pool(t)).select("player_id", "source", "diff")


@query("D95_model_vs_average", "SELECT CASE WHEN abs(pts_q50 - avg_points) > 0.1 THEN 'MODEL' ELSE 'AVG' END AS source, is_pitcher, count(*) AS n, avg(pts_q50 - avg_points) AS mean_diff FROM pool GROUP BY 1, 2", "mean_diff", dp=6, views=P)
def _(t):
    return R.model_vs_average(b.pool(t)).groupBy("source", "is_pitcher").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pts_q50") - F.col("avg_points")).alias("mean_diff"))


# --- pool joins, summaries, snapshots


@query("J19_roster_merge", "SELECT p.player_id, CASE WHEN s.player_id IS NULL THEN position_eligibility ELSE ['UTIL'] END AS eligibility FROM pool p LEFT JOIN status s USING (player_id)", views=f"{P}, {STATUS}")
def _(t):
    roster = _status(t).select("player_id", F.array(F.lit("UTIL")).alias("elig"))
    out = b.pool(t).select("player_id", "position_eligibility").join(roster, "player_id", "left")
    return out.select("player_id", F.when(F.size("elig") > 0, F.col("elig")).otherwise(F.col("position_eligibility")).alias("eligibility"))


@query("J21_opponent", "SELECT player_id, opponent FROM pool", views=P)
def _(t):
    return b.pool(t).select("player_id", SL.opponent(F.col("team"), F.col("home_team"), F.col("away_team")).alias("opponent"))


@query("A08_slate_summary", "SELECT slate_id, count(*) AS players, count(*) FILTER (is_pitcher) AS pitchers, list_sort(list(DISTINCT team)) AS teams, count(DISTINCT away_team || '@' || home_team) AS games FROM pool GROUP BY 1", views=P)
def _(t):
    return b.pool(t).groupBy("slate_id").agg(
        F.count(F.lit(1)).alias("players"), F.count_if("is_pitcher").alias("pitchers"), F.array_sort(F.collect_set("team")).alias("teams"),
        F.countDistinct(F.concat("away_team", F.lit("@"), "home_team")).alias("games"),
    )


@query("A21_pool_averages", "SELECT avg(ownership_proj) AS mean_ownership, avg(pts_q50) AS mean_points FROM pool", "mean_ownership mean_points", views=P)
def _(t):
    return b.pool(t).agg(F.avg("ownership_proj").alias("mean_ownership"), F.avg("pts_q50").alias("mean_points"))


@query("A31_anti_stack_summary", """SELECT slate_id, count(*) AS pitchers, count(*) FILTER (EXISTS (SELECT 1 FROM pool h WHERE h.slate_id = p.slate_id AND h.team = p.opponent AND NOT h.is_pitcher)) AS facing_hitters
FROM pool p WHERE is_pitcher AND opponent IS NOT NULL GROUP BY 1""", views=P)
def _(t):
    return SL.anti_stack_summary(b.pool(t))


@query("A32_slot_index", "SELECT slate_id, unnest(position_eligibility) AS slot, player_id FROM pool", views=P)
def _(t):
    return SL.slot_index(b.pool(t))


BAN2 = "ban_a AS (SELECT player_id FROM pool WHERE is_banned), ban_b AS (SELECT player_id FROM pool WHERE is_banned AND salary > 4000 UNION SELECT player_id FROM status)"


def _bans(t):
    p = b.pool(t)
    return p.filter("is_banned").select("player_id"), p.filter(F.col("is_banned") & (F.col("salary") > 4000)).select("player_id").union(_status(t).select("player_id")).distinct()


@query("U09_set_delta", "SELECT player_id, 'added' AS change FROM (SELECT * FROM ban_b EXCEPT SELECT * FROM ban_a) x UNION ALL SELECT player_id, 'removed' FROM (SELECT * FROM ban_a EXCEPT SELECT * FROM ban_b) y", views=f"{P}, {STATUS}, {BAN2}")
def _(t):
    before, after = _bans(t)
    new = after.join(before, "player_id", "left_anti").withColumn("change", F.lit("added"))
    return new.unionByName(before.join(after, "player_id", "left_anti").withColumn("change", F.lit("removed")))


SNAP = """snap_a AS (SELECT player_id, status FROM status), snap_b AS (SELECT p_partkey AS player_id, CASE WHEN p_size <= 2 THEN 'unavailable' ELSE 'dtd' END AS status FROM part WHERE p_size BETWEEN 2 AND 6)"""
_DIFF = """SELECT coalesce(a.player_id, z.player_id) AS player_id, a.status AS before_status, z.status AS after_status,
 CASE WHEN a.player_id IS NULL THEN 'added' WHEN z.player_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM snap_a a FULL JOIN snap_b z ON a.player_id = z.player_id WHERE a.status IS DISTINCT FROM z.status"""


def _snapshot_diff(t):
    after = t["part"].filter(F.col("p_size").between(2, 6)).select(F.col("p_partkey").alias("player_id"), F.when(F.col("p_size") <= 2, "unavailable").otherwise("dtd").alias("status"))
    return SL.snapshot_diff(_status(t), after, ["player_id"], ["status"])


@query("T03_snapshot_change_detection", _DIFF, views=f"{STATUS}, {SNAP}")
def _(t):
    return _snapshot_diff(t)


@query("D39_lineup_snapshot_diff", f"SELECT change, count(*) AS n FROM ({_DIFF}) d GROUP BY 1", views=f"{STATUS}, {SNAP}")
def _(t):
    return _snapshot_diff(t).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


ROSTER = """roster AS (SELECT p_partkey AS player_id, CASE WHEN p_size <= 4 THEN 'D10' WHEN p_size <= 8 THEN 'DTD' WHEN p_size = 9 THEN 'D180' ELSE 'A' END AS code, 'roster ' || p_size AS reason FROM part),
inj AS (SELECT p_partkey AS player_id, CASE WHEN p_size IN (2, 6, 12) THEN 'OUT' WHEN p_size IN (3, 13) THEN 'DTD' ELSE 'X' END AS code, CASE WHEN p_size = 12 THEN '' ELSE 'injury ' || p_size END AS description FROM part)"""


def _roster(t):
    s = F.col("p_size")
    roster = t["part"].select(F.col("p_partkey").alias("player_id"), F.when(s <= 4, "D10").when(s <= 8, "DTD").when(s == 9, "D180").otherwise("A").alias("code"), F.concat(F.lit("roster "), s.cast("string")).alias("reason"))
    inj = t["part"].select(F.col("p_partkey").alias("player_id"), F.when(s.isin(2, 6, 12), "OUT").when(s.isin(3, 13), "DTD").otherwise("X").alias("code"), F.when(s == 12, "").otherwise(F.concat(F.lit("injury "), s.cast("string"))).alias("description"))
    return roster, inj


_BAN = "{c} IN ('D7', 'D10', 'D15', 'D60', 'OUT', 'SUSP', 'RM') OR regexp_full_match({c}, 'D[0-9]+')"
AVAIL = f"""avail AS (SELECT r.player_id, CASE WHEN {_BAN.format(c='r.code')} OR {_BAN.format(c='i.code')} THEN 'unavailable' ELSE 'dtd' END AS status,
 CASE WHEN {_BAN.format(c='r.code')} THEN r.reason WHEN r.code = 'DTD' THEN 'DTD — ' || r.reason WHEN {_BAN.format(c='i.code')} THEN 'Injuries feed: ' || coalesce(nullif(description, ''), i.code) ELSE 'DTD (' || coalesce(nullif(description, ''), i.code) || ')' END AS reason
 FROM roster r JOIN inj i ON r.player_id = i.player_id WHERE {_BAN.format(c='r.code')} OR {_BAN.format(c='i.code')} OR r.code = 'DTD' OR i.code = 'DTD')"""


@query("P06_status_codes", f"SELECT code, {_BAN.format(c='code')} AS banned, count(*) AS n FROM roster GROUP BY 1, 2", views=ROSTER)
def _(t):
    return _roster(t)[0].groupBy("code", SL.is_banned_code(F.col("code")).alias("banned")).agg(F.count(F.lit(1)).alias("n"))


@query("D33_availability", "SELECT * FROM avail", views=f"{ROSTER}, {AVAIL}")
def _(t):
    return SL.availability(*_roster(t))


CONF = """prim AS (SELECT team, max(name) AS p FROM pool WHERE position = 'SP' AND salary > 5200 GROUP BY 1), sec AS (SELECT team, max(name) AS s FROM pool WHERE position = 'RP' GROUP BY 1),
conf AS (SELECT coalesce(prim.team, sec.team) AS team, coalesce(p, s) AS pitcher_name, CASE WHEN p IS NULL THEN 'secondary' ELSE 'primary' END AS source,
 coalesce(string_split(p, ' ')[-1] <> string_split(s, ' ')[-1], FALSE) AS conflict FROM prim FULL JOIN sec ON prim.team = sec.team)"""


def starters(t):
    p = b.pool(t)
    prim = p.filter((F.col("position") == "SP") & (F.col("salary") > 5200)).select("team", F.col("name").alias("pitcher_name"))
    return SL.confirmed_starters(prim, p.filter(F.col("position") == "RP").select("team", F.col("name").alias("pitcher_name")))


@query("J16_primary_with_fill", "SELECT team, pitcher_name, source FROM conf", views=f"{P}, {CONF}")
def _(t):
    return starters(t).select("team", "pitcher_name", "source")


@query("D35_confirmed_starters", "SELECT * FROM conf", views=f"{P}, {CONF}")
def _(t):
    return starters(t)


# The pool's teams B1, B2, ... stand for the league's team ids in ascending order.
_TEAMS = {f"B{i}": k for i, k in enumerate(sorted(S.TEAM_ID), 1)}


@query("D38_team_ids", f"SELECT DISTINCT team, team_id FROM pool JOIN (VALUES {', '.join(f'({t!r}, {k})' for t, k in _TEAMS.items())}) v(own, team_id) ON team = own", views=P)
def _(t):
    from ..functions.columns import lookup

    mapped = b.pool(t).select(F.col("team").alias("own"), lookup("team", {n: S.TEAM_ID[k] for n, k in _TEAMS.items()}).alias("team"))
    ids = SL.team_ids(mapped)
    return mapped.distinct().join(ids, "team").select(F.col("own").alias("team"), "team_id")


@query("D31_implied_totals", """SELECT game_id, team, implied_total, opposing_implied FROM (
 SELECT game_id, unnest([home_team, away_team]) AS team, unnest([h, a]) AS implied_total, unnest([a, h]) AS opposing_implied FROM (
  SELECT *, least(greatest((game_total - s) / 2, 2), 9) AS h, least(greatest((game_total + s) / 2, 2), 9) AS a FROM (
   SELECT player_id AS game_id, home_team, away_team, 5 + avg_points AS game_total, CASE WHEN abs(pts_q50 - 12) > 3 THEN 0 ELSE pts_q50 - 12 END AS s FROM pool WHERE salary >= 3000) x) y) z""",
       "implied_total opposing_implied", views=P)
def _(t):
    games = b.pool(t).select(
        F.col("player_id").alias("game_id"), "home_team", "away_team", F.when(F.col("salary") >= 3000, F.col("avg_points") + 5).alias("game_total"),
        (F.col("pts_q50") - 12).alias("spread"), F.lit(None).cast("double").alias("home_ml"), F.lit(None).cast("double").alias("away_ml"),
    ).filter(F.col("game_total").isNotNull())
    return implied_rows(games).select("game_id", "team", "implied_total", "opposing_implied")


@query("D07_market_total", """SELECT player_id, coalesce(t.implied_total, 4.5e0) AS implied_total FROM (SELECT *, CASE WHEN is_pitcher THEN away_team ELSE home_team END AS side FROM pool) p LEFT JOIN totals t ON side = t.team""", "implied_total", views=PT)
def _(t):
    p = b.pool(t).withColumn("inning_topbot", F.when(F.col("is_pitcher"), "Top").otherwise("Bot"))
    return B.market_total(p, b.totals(t)).select("player_id", "implied_total")


# --- projections

PRED = """pred AS (SELECT player_id, player_id + 1000 AS register_id, CASE WHEN salary > 3500 THEN pts_q50 * 0.4e0 END AS model_q15,
 CASE WHEN salary > 3500 THEN pts_q50 - 3 END AS model_q50, CASE WHEN salary > 3500 THEN pts_q50 * 1.9e0 END AS model_q85 FROM pool WHERE salary > 2600),
usage AS (SELECT player_id + 1000 AS register_id, CAST(salary / 50 AS INTEGER) AS pa_30d FROM pool WHERE salary > 3000)"""


def _inputs(t):
    p = b.pool(t)
    m = F.col("salary") > 3500
    pred = p.filter(F.col("salary") > 2600).select(
        "player_id", (F.col("player_id") + 1000).alias("register_id"), F.when(m, F.col("pts_q50") * 0.4).alias("model_q15"),
        F.when(m, F.col("pts_q50") - 3).alias("model_q50"), F.when(m, F.col("pts_q50") * 1.9).alias("model_q85"),
    )
    use = p.filter(F.col("salary") > 3000).select((F.col("player_id") + 1000).alias("register_id"), F.bround(F.col("salary") / 50).cast("int").alias("pa_30d"))
    return p, pred, use


FB = """fb AS (SELECT *, position = 'SP' AS conf, CASE WHEN is_pitcher THEN (CASE WHEN position = 'SP' THEN avg_points ELSE least(avg_points, 15) END) ELSE avg_points END AS base FROM pool),
fbq AS (SELECT *, CASE WHEN is_pitcher THEN base * 0.4e0 ELSE base * 0.5e0 END AS f15, base AS f50, CASE WHEN is_pitcher THEN base * 2 ELSE base * 1.8e0 END AS f85 FROM fb)"""


@query("D46_fallback_projection", "SELECT player_id, f15 AS fb_q15, f50 AS fb_q50, f85 AS fb_q85 FROM fbq", "fb_q15 fb_q50 fb_q85", views=f"{P}, {FB}")
def _(t):
    return PR.fallback_projection(PR.confirmed_flag(b.pool(t), None)).select("player_id", "fb_q15", "fb_q50", "fb_q85")


@query("D48_shrink_to_league", """SELECT player_id, c * pts_q15 + (1 - c) * 3 AS q15, c * pts_q50 + (1 - c) * 7 AS q50, c * pts_q85 + (1 - c) * 16 AS q85
FROM (SELECT *, least(CAST(salary / 50 AS INTEGER) / 115e0, 1) AS c FROM pool) x""", "q15 q50 q85", views=P)
def _(t):
    p = b.pool(t).select("player_id", *[F.col(f"pts_{q}").alias(q) for q in PR.Q], F.bround(F.col("salary") / 50).cast("int").alias("pa_30d"))
    return PR.shrink(p).select("player_id", *PR.Q)


@query("D49_market_multiplier", """SELECT player_id, pts_q15 AS q15, CASE WHEN t.implied_total > 0 THEN round(pts_q50 * m, 4) ELSE pts_q50 END AS q50, CASE WHEN t.implied_total > 0 THEN round(pts_q85 * m, 4) ELSE pts_q85 END AS q85
FROM (SELECT p.*, tt.implied_total, least(greatest(tt.implied_total / 4.5e0, 0.75e0), 1.25e0) AS m FROM pool p LEFT JOIN totals tt USING (team)) t""", "q15 q50 q85", views=PT)
def _(t):
    p = b.pool(t).select("player_id", "team", *[F.col(f"pts_{q}").alias(q) for q in PR.Q])
    return PR.market_adjust(p, b.totals(t)).select("player_id", *PR.Q)


_BL = lambda q, lg: f"CASE WHEN NOT is_pitcher AND register_id IS NOT NULL THEN c * {q} + (1 - c) * {lg} ELSE {q} END"
PROJ = f"""um AS (SELECT f.*, pr.register_id, coalesce(u.pa_30d, 0) AS pa, pr.model_q15, pr.model_q50, pr.model_q85, tt.implied_total,
  coalesce(pr.model_q50 IS NOT NULL AND NOT (greatest(pr.model_q50, 0) <= 0 AND f.avg_points > 0), FALSE) AS used
  FROM fbq f LEFT JOIN pred pr ON f.player_id = pr.player_id LEFT JOIN usage u ON pr.register_id = u.register_id LEFT JOIN totals tt ON f.team = tt.team),
qs AS (SELECT *, least(pa / 115e0, 1) AS c, CASE WHEN used THEN greatest(model_q15, 0) ELSE f15 END AS a15, CASE WHEN used THEN greatest(model_q50, 0) ELSE f50 END AS a50, CASE WHEN used THEN greatest(model_q85, 0) ELSE f85 END AS a85 FROM um),
sh AS (SELECT *, {_BL('a15', 3)} AS b15, {_BL('a50', 7)} AS b50, {_BL('a85', 16)} AS b85, NOT is_pitcher AND implied_total > 0 AS adj, least(greatest(implied_total / 4.5e0, 0.75e0), 1.25e0) AS mm FROM qs),
proj AS (SELECT *, b15 AS c15, CASE WHEN adj THEN round(b50 * mm, 4) ELSE b50 END AS c50, CASE WHEN adj THEN round(b85 * mm, 4) ELSE b85 END AS c85, CASE WHEN is_pitcher THEN 15e0 ELSE 10e0 END AS own FROM sh)"""
PROJ_VIEWS = f"{PT}, {PRED}, {FB}, {PROJ}"


@query("D50_project_slate", "SELECT player_id, register_id IS NOT NULL AS matched, used AS used_model, round(c15, 2) AS pts_q15, round(c50, 2) AS pts_q50, round(c85, 2) AS pts_q85, own AS ownership_proj, round(c50 / own, 3) AS leverage_score FROM proj",
       "pts_q15 pts_q50 pts_q85 ownership_proj leverage_score", views=PROJ_VIEWS)
def _(t):
    p, pred, use = _inputs(t)
    out = PR.project_slate(p, pred, use, b.totals(t))
    return out.select("player_id", "matched", "used_model", "pts_q15", "pts_q50", "pts_q85", "ownership_proj", "leverage_score")


@query("A28_usage_counts", "SELECT count(*) FILTER (register_id IS NOT NULL) AS matched, count(*) FILTER (register_id IS NULL) AS unmatched, count(*) FILTER (used) AS model_used, count(*) FILTER (NOT used) AS fallback_used FROM proj", views=PROJ_VIEWS)
def _(t):
    p, pred, use = _inputs(t)
    return PR.usage_counts(PR.project_slate(p, pred, use, b.totals(t)))


@query("D43_hitter_vectors", """SELECT p.player_id, p.pts_q50 AS xwoba_7d, 1e0 AS batting_order_multiplier, 0e0 AS k_rate_7d,
 CASE WHEN o.implied_total > 0 THEN o.implied_total ELSE p.avg_points END AS team_runs_per_game_30d, CASE WHEN e.implied_total > 0 THEN e.implied_total ELSE 0e0 END AS opp_runs_allowed_30d
FROM pool p LEFT JOIN totals o ON p.team = o.team LEFT JOIN totals e ON p.opponent = e.team WHERE NOT is_pitcher""", "xwoba_7d batting_order_multiplier k_rate_7d team_runs_per_game_30d opp_runs_allowed_30d", views=PT)
def _(t):
    p = b.pool(t).filter(~F.col("is_pitcher"))
    latest = p.select(F.col("player_id").alias("batter"), F.col("pts_q50").alias("xwoba_7d"), F.col("avg_points").alias("team_runs_per_game_30d"))
    v = PR.hitter_vectors(p.select("slate_id", "player_id", F.col("player_id").alias("register_id"), "team", "home_team", "away_team"), latest, b.totals(t))
    return v.select("player_id", "xwoba_7d", "batting_order_multiplier", "k_rate_7d", "team_runs_per_game_30d", "opp_runs_allowed_30d")


@query("D44_pitcher_vectors", """SELECT player_id, pts_q50 AS k_rate_7d, CASE WHEN position = 'SP' THEN 1e0 ELSE 0e0 END AS is_starter, CASE WHEN position <> 'SP' AND avg_points / 4 > 2 THEN 1e0 ELSE avg_points / 4 END AS ip_per_start_7d, 0e0 AS ip_per_start_14d
FROM pool WHERE is_pitcher""", "k_rate_7d is_starter ip_per_start_7d ip_per_start_14d", views=P)
def _(t):
    p = PR.confirmed_flag(b.pool(t).filter("is_pitcher"), None)
    latest = p.select(F.col("player_id").alias("pitcher"), F.col("pts_q50").alias("k_rate_7d"), (F.col("avg_points") / 4).alias("ip_per_start_7d"))
    v = PR.pitcher_vectors(p.select("slate_id", "player_id", F.col("player_id").alias("register_id"), "is_confirmed"), latest)
    return v.select("player_id", "k_rate_7d", "is_starter", "ip_per_start_7d", "ip_per_start_14d")


# --- ownership

TIERED = """tiered AS (SELECT *, CASE WHEN salary > 0 AND salary <= 3000 THEN 'budget' WHEN salary <= 5000 THEN 'mid' WHEN salary <= 7000 THEN 'premium' WHEN salary <= 20000 THEN 'elite' END AS tier,
 coalesce(pts_q50 / nullif(salary / 1000e0, 0), 0) AS rv FROM pool),
zs AS (SELECT player_id, CASE WHEN stddev_samp(rv) OVER w > 0 THEN (rv - avg(rv) OVER w) / stddev_samp(rv) OVER w ELSE 0 END AS value_zscore FROM tiered WINDOW w AS (PARTITION BY slate_id, is_pitcher, tier))"""


@query("W12_tier_zscore", "SELECT * FROM zs", "value_zscore", views=f"{P}, {TIERED}")
def _(t):
    return O.value_zscore(b.pool(t)).select("player_id", "value_zscore")


@query("D55_value_zscore", "SELECT CASE WHEN value_zscore > 3 THEN 'high' WHEN value_zscore < -3 THEN 'low' ELSE 'in' END AS part, count(*) AS n, max(value_zscore) AS top FROM zs GROUP BY 1", "top", views=f"{P}, {TIERED}")
def _(t):
    z = F.col("value_zscore")
    out = O.value_zscore(b.pool(t)).withColumn("part", F.when(z > 3, "high").when(z < -3, "low").otherwise("in"))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(z).alias("top"))


SR = """sr AS (SELECT player_id, (row_number() OVER (PARTITION BY slate_id, split_part(position, '/', 1) ORDER BY salary, player_id) - 1) / greatest(count(*) OVER (PARTITION BY slate_id, split_part(position, '/', 1)) - 1, 1) AS salary_rank FROM pool)"""


@query("W13_normalised_rank", "SELECT * FROM sr", "salary_rank", views=f"{P}, {SR}")
def _(t):
    return O.salary_rank(b.pool(t)).select("player_id", "salary_rank")


@query("D56_salary_rank", "SELECT p.position, avg(sr.salary_rank) AS mean_rank, max(sr.salary_rank) AS top FROM pool p JOIN sr USING (player_id) GROUP BY 1", "mean_rank top", views=f"{P}, {SR}")
def _(t):
    return O.salary_rank(b.pool(t)).groupBy("position").agg(F.avg("salary_rank").alias("mean_rank"), F.max("salary_rank").alias("top"))


RC = "rc AS (SELECT player_id, CASE WHEN max(pts_q50) OVER w > min(pts_q50) OVER w THEN (pts_q50 - min(pts_q50) OVER w) / (max(pts_q50) OVER w - min(pts_q50) OVER w) ELSE 0.5e0 END AS recency FROM pool WINDOW w AS (PARTITION BY slate_id, is_pitcher))"


@query("W14_min_max_scaling", "SELECT * FROM rc", "recency", views=f"{P}, {RC}")
def _(t):
    return O.recency(b.pool(t)).select("player_id", "recency")


ST = """st AS (SELECT player_id, CASE WHEN is_pitcher THEN 1e0 ELSE least(greatest((1 + greatest((coalesce(t.implied_total, 4.5e0) - 4.5e0) * 0.06e0, 0)) *
 (1 - (row_number() OVER (PARTITION BY slate_id, p.team, is_pitcher ORDER BY salary DESC, player_id) - 1) / greatest(count(*) OVER (PARTITION BY slate_id, p.team, is_pitcher), 1) * 0.3e0), 0.7e0), 1.5e0) END AS stack_multiplier
 FROM pool p LEFT JOIN totals t ON p.team = t.team)"""


@query("W15_team_salary_rank", "SELECT player_id, row_number() OVER (PARTITION BY slate_id, team ORDER BY salary DESC, player_id) AS team_rank, count(*) OVER (PARTITION BY slate_id, team) AS n FROM pool WHERE NOT is_pitcher", views=P)
def _(t):
    from ..operators.ordered import prefix_sums

    h = b.pool(t).filter(~F.col("is_pitcher"))
    return prefix_sums(h, ["slate_id", "team"], [F.col("salary").desc(), F.col("player_id")], out="team_rank", total="n").select("player_id", "team_rank", "n")


@query("D57_stack_multiplier", "SELECT * FROM st", "stack_multiplier", views=f"{PT}, {ST}")
def _(t):
    return O.stack_multiplier(O.with_market(b.pool(t), b.totals(t))).select("player_id", "stack_multiplier")


FREQ = "freq AS (SELECT slate_id, player_id, 1e0 / count(*) OVER (PARTITION BY slate_id) * (player_id % 5) AS frequency FROM pool)"
RAW = f"""{FREQ}, raw AS (SELECT p.slate_id, p.player_id, p.is_pitcher, p.pts_q50, p.pts_q85, greatest(CASE WHEN p.is_pitcher THEN
   f * 0.6e0 + v * 0.2e0 + sr.salary_rank * 0.1e0 + rc.recency * 0.05e0 + greatest(1 - (coalesce(o.implied_total, 4.5e0) - 4.5e0) * 0.08e0, 0) * 0.05e0
   ELSE (f * 0.25e0 + least(greatest(greatest((coalesce(t.implied_total, 4.5e0) - 4.5e0) * 0.03e0, 0) / 0.15e0 + 0.5e0, 0), 1) * 0.35e0 + v * 0.25e0 + rc.recency * 0.1e0 + sr.salary_rank * 0.05e0) * st.stack_multiplier END, 0) AS raw_score
  FROM pool p JOIN (SELECT player_id, least(greatest(frequency, 0), 1) AS f FROM freq) q USING (player_id)
  JOIN (SELECT player_id, 1 / (1 + exp(-least(greatest(value_zscore, -3), 3))) AS v FROM zs) z USING (player_id)
  JOIN sr USING (player_id) JOIN rc USING (player_id) JOIN st USING (player_id) LEFT JOIN totals t ON p.team = t.team LEFT JOIN totals o ON p.opponent = o.team)"""
RAW_VIEWS = f"{PT}, {TIERED}, {SR}, {RC}, {ST}, {RAW}"


def _freq(t):
    p = b.pool(t)
    return O.uniform_frequency(p).withColumn("frequency", F.col("frequency") * (F.col("player_id") % 5))


@query("D58_raw_score", "SELECT player_id, raw_score FROM raw", "raw_score", views=RAW_VIEWS)
def _(t):
    return O.raw_score(b.pool(t), _freq(t), b.totals(t)).select("player_id", "raw_score")


@query("W16_mean_centre", "SELECT player_id, pts_q50 - avg(pts_q50) OVER (PARTITION BY slate_id, is_pitcher) AS centred FROM pool", "centred", views=P)
def _(t):
    out = with_group_stats(b.pool(t), O.POOL, {"_m": F.avg("pts_q50")})
    return out.select("player_id", (F.col("pts_q50") - F.col("_m")).alias("centred"))


NORM = """sized AS (SELECT slate_id, CASE WHEN count(DISTINCT away_team || '@' || home_team) <= 4 THEN 'small' WHEN count(DISTINCT away_team || '@' || home_team) <= 9 THEN 'medium' ELSE 'large' END AS sz FROM pool GROUP BY 1),
sg AS (SELECT raw.*, sz, 1 / (1 + exp(-least(greatest(4 * sign(raw_score - avg(raw_score) OVER w) * pow(abs(raw_score - avg(raw_score) OVER w), 0.7e0), -50), 50))) AS s FROM raw JOIN sized USING (slate_id) WINDOW w AS (PARTITION BY slate_id, is_pitcher)),
nm AS (SELECT *, CASE WHEN is_pitcher THEN 3e0 ELSE 2e0 END AS fl, CASE sz WHEN 'small' THEN (CASE WHEN is_pitcher THEN 40e0 ELSE 28e0 END) WHEN 'medium' THEN (CASE WHEN is_pitcher THEN 30e0 ELSE 20e0 END) ELSE (CASE WHEN is_pitcher THEN 20e0 ELSE 12e0 END) END AS cap,
 min(s) OVER w AS s0, max(s) OVER w AS s1 FROM sg WINDOW w AS (PARTITION BY slate_id, is_pitcher)),
ownp AS (SELECT *, least(greatest(CASE WHEN s1 > s0 THEN fl + (s - s0) / (s1 - s0) * (cap - fl) ELSE (fl + cap) / 2 END, fl), cap) AS ownership_pct FROM nm)"""


@query("D59_normalise_ownership", "SELECT player_id, ownership_pct FROM ownp", "ownership_pct", views=f"{RAW_VIEWS}, {NORM}")
def _(t):
    p = b.pool(t)
    return O.normalise(O.raw_score(p, _freq(t), b.totals(t)), pool=p).select("player_id", "ownership_pct")


@query("D60_apply_ownership", """SELECT p.player_id, round(own, 2) AS ownership_proj, round(pts_q85 / own, 3) AS leverage_score, round(pts_q50 / greatest(round(own, 2), 0.1e0), 3) AS median_leverage
FROM (SELECT p.*, greatest(coalesce(o.pct, CASE WHEN is_pitcher THEN 15e0 ELSE 10e0 END), 0.1e0) AS own FROM pool p LEFT JOIN (SELECT player_id, ownership_proj - 2 AS pct FROM pool WHERE salary > 4000) o ON p.player_id = o.player_id) p""",
       "ownership_proj leverage_score median_leverage", views=P)
def _(t):
    own = b.pool(t).filter(F.col("salary") > 4000).select("slate_id", "player_id", (F.col("ownership_proj") - 2).alias("ownership_pct"))
    return O.apply_ownership(b.pool(t), own).select("player_id", "ownership_proj", "leverage_score", "median_leverage")


# --- scenario draws

N = 40
_U = "(CAST('0x' || substr(md5(player_id || '|' || draw || '|0'), 1, 8) AS UBIGINT) + 0.5e0) / 4294967296e0"


def _h(x: str, coefs) -> str:
    out = f"({coefs[0]:.17e})"
    for c in coefs[1:]:
        out = f"({out} * {x} + ({c:.17e}))"
    return out


def _cdf(z: str) -> str:
    from ..functions import normal as NM

    tt = f"(1e0 / (1e0 + {NM.CDF_P:.17e} * abs({z})))"
    tail = f"(exp(-abs({z}) * abs({z}) / 2e0) / {NM.SQRT_2PI:.17e} * ({tt} * {_h(tt, NM.CDF_B[::-1])}))"
    return f"(CASE WHEN {z} >= 0 THEN 1e0 - {tail} ELSE {tail} END)"


def _inv(p: str) -> str:
    from ..functions import normal as NM

    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    low, high = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))"
    tail = lambda s: f"({_h(s, NM.INV_C)} / {_h(s, NM.INV_D + (1.0,))})"
    mid = f"({q} * {_h(r, NM.INV_A)} / {_h(r, NM.INV_B + (1.0,))})"
    return f"(CASE WHEN {p} < {NM.INV_TAIL:.17e} THEN {tail(low)} WHEN {p} > {1 - NM.INV_TAIL:.17e} THEN -{tail(high)} ELSE {mid} END)"


DRAWS = f"""d0 AS (SELECT slate_id, player_id, position_eligibility, pts_q50, greatest((pts_q85 - pts_q15) / 2.08e0, 0.01e0) AS sd, pts_q85 FROM pool),
d1 AS (SELECT *, greatest(pts_q85 * 1.5e0, pts_q50 + sd) AS hi, unnest(range({N})) AS draw FROM d0),
d2 AS (SELECT *, (0e0 - pts_q50) / sd AS za, (hi - pts_q50) / sd AS zb, {_U} AS u FROM d1),
d3 AS (SELECT *, {_cdf('za')} AS pa, {_cdf('zb')} AS pb FROM d2),
d4 AS (SELECT *, least(greatest(pa + u * (pb - pa), 1e-12), {1 - 1e-12:.17e}) AS pp FROM d3),
draws AS (SELECT slate_id, player_id, position_eligibility, draw, least(greatest(pts_q50 + sd * {_inv('pp')}, 0e0), hi) AS value FROM d4)"""


@query("D62_scenario_draws", "SELECT slate_id, player_id, draw, value FROM draws", "value", dp=6, views=f"{P}, {DRAWS}")
def _(t):
    return O.scenario_draws(b.pool(t), N).select("slate_id", "player_id", "draw", "value")


FREQS = f"""elig AS (SELECT slate_id, draw, player_id, value, unnest(position_eligibility) AS slot FROM draws),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slate_id, draw, slot ORDER BY value DESC, player_id) AS r FROM elig WHERE slot IN ('P', 'C', '1B', '2B', '3B', 'SS', 'OF')),
sel AS (SELECT slate_id, player_id, count(DISTINCT draw) / {float(N):e} AS frequency FROM ranked WHERE r <= CASE slot WHEN 'P' THEN 2 WHEN 'OF' THEN 3 ELSE 1 END GROUP BY 1, 2)"""


@query("D61_selection_frequency", "SELECT * FROM sel", "frequency", views=f"{P}, {DRAWS}, {FREQS}")
def _(t):
    return O.selection_frequency(O.scenario_draws(b.pool(t), N), N)


@query("A18_selection_share", "SELECT slate_id, count(*) AS players, max(frequency) AS top, sum(frequency) AS total FROM sel GROUP BY 1", "top total", views=f"{P}, {DRAWS}, {FREQS}")
def _(t):
    f = O.selection_frequency(O.scenario_draws(b.pool(t), N), N)
    return f.groupBy("slate_id").agg(F.count(F.lit(1)).alias("players"), F.max("frequency").alias("top"), F.sum("frequency").alias("total"))


@query("F37_hash_uniform", f"SELECT player_id, sha256(name) AS digest, {_U.replace('draw', '0')} AS u FROM pool", "u", views=P)
def _(t):
    return b.pool(t).select("player_id", F.sha2("name", 256).alias("digest"), hash_uniform("player_id", F.lit(0), F.lit(0)).alias("u"))


# --- reports

BANDS = "bands AS (SELECT *, share AS top_share, CASE WHEN share < 0.2 THEN 'green' WHEN share < 0.6 THEN 'amber' ELSE 'red' END AS band FROM (SELECT *, (rank() OVER (ORDER BY pts_q50 DESC) - 1) / count(*) OVER () AS share FROM pool) x)"


@query("W17_percentile_band", "SELECT player_id, top_share, band FROM bands", "top_share", views=f"{P}, {BANDS}")
def _(t):
    return R.percentile_bands(b.pool(t)).select("player_id", "top_share", "band")


@query("D90_pool_view", "SELECT player_id, band FROM bands WHERE NOT is_pitcher AND (contains(lower(name), 'red') OR contains(lower(team), 'red'))", views=f"{P}, {BANDS}")
def _(t):
    return R.pool_view(b.pool(t), "HITTERS", "red", "salary").select("player_id", "band")


@query("K10_user_sort", "SELECT player_id, team, row_number() OVER (ORDER BY team ASC, player_id) AS place FROM pool", views=P)
def _(t):
    from ..operators.ordered import prefix_sums

    placed = prefix_sums(b.pool(t).select("player_id", "team"), [], [F.col("team"), F.col("player_id")], out="place")
    return R.sort_by(placed, "place", descending=False)


@query("K02_leverage_board", "SELECT player_id, leverage_score FROM pool WHERE NOT is_pitcher AND NOT is_banned ORDER BY leverage_score DESC, player_id LIMIT 10", "leverage_score", views=P)
def _(t):
    return R.leverage_board(b.pool(t)).select("player_id", "leverage_score")


@query("K03_ceiling_board", "SELECT player_id, pts_q85 - pts_q50 AS ceiling_gap FROM pool WHERE NOT is_banned ORDER BY pts_q85 - pts_q50 DESC, player_id LIMIT 8", "ceiling_gap", views=P)
def _(t):
    return R.ceiling_board(b.pool(t)).select("player_id", "ceiling_gap")


@query("D91_boards", """SELECT 'leverage' AS board, player_id FROM (SELECT player_id FROM pool WHERE NOT is_pitcher AND NOT is_banned ORDER BY leverage_score DESC, player_id LIMIT 10) a
UNION ALL SELECT 'ceiling', player_id FROM (SELECT player_id FROM pool WHERE NOT is_banned ORDER BY pts_q85 - pts_q50 DESC, player_id LIMIT 8) z""", views=P)
def _(t):
    p = b.pool(t)
    one = lambda d, n: d.select(F.lit(n).alias("board"), "player_id")
    return one(R.leverage_board(p), "leverage").unionByName(one(R.ceiling_board(p), "ceiling"))


LISTS = """lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY pts_q50 DESC, player_id) AS place FROM (
 SELECT *, CASE WHEN NOT is_pitcher THEN 'hitters' WHEN position = 'SP' THEN 'starters' ELSE 'relievers' END AS list FROM pool) x) y WHERE place <= CASE list WHEN 'relievers' THEN 5 ELSE 10 END)"""


@query("K04_top_lists", "SELECT list, place, player_id FROM lists", views=f"{P}, {LISTS}")
def _(t):
    return R.top_lists(b.pool(t)).select("list", "place", "player_id")


LEVERAGE = "(SELECT player_id, pts_q50 / greatest(ownership_proj, 1e-1) AS lev FROM pool ORDER BY lev DESC, player_id LIMIT 10)"


@query("K05_top_ownership", f"""SELECT 'ownership' AS board, player_id, ownership_proj AS value FROM (SELECT * FROM pool ORDER BY ownership_proj DESC, player_id LIMIT 10) a
UNION ALL SELECT 'leverage', player_id, lev FROM {LEVERAGE} z""", "value", views=P)
def _(t):
    p = b.pool(t)
    one = lambda d, board, value: d.select(F.lit(board).alias("board"), "player_id", F.col(value).alias("value"))
    return one(R.sort_by(p, "ownership_proj").limit(10), "ownership", "ownership_proj").unionByName(one(R.median_leverage_board(p), "leverage", "median_leverage"))


@query("K06_top_totals", "SELECT team, implied_total FROM totals WHERE implied_total IS NOT NULL ORDER BY implied_total DESC, team LIMIT 5", "implied_total", views=TOT)
def _(t):
    return R.top_totals(b.totals(t), 5)


@query("D92_leverage_scatter", """SELECT player_id, mo AS mean_ownership, mp AS mean_points, CASE WHEN pts_q50 >= mp AND ownership_proj < mo THEN 'leverage' WHEN pts_q50 >= mp THEN 'chalk' WHEN ownership_proj < mo THEN 'punt' ELSE 'trap' END AS quadrant,
 CASE WHEN leverage_score >= 1.3e0 THEN 'green' WHEN leverage_score >= 8e-1 THEN 'amber' ELSE 'grey' END AS dot
FROM (SELECT *, avg(ownership_proj) OVER () AS mo, avg(pts_q50) OVER () AS mp FROM pool) x""", "mean_ownership mean_points", views=P)
def _(t):
    return R.leverage_scatter(b.pool(t)).select("player_id", "mean_ownership", "mean_points", "quadrant", "dot")


@query("D94_pre_slate_report", f"""SELECT 'market' AS section, team AS label, v AS value, CASE WHEN v > 5 THEN 'hot' WHEN v < 3.5e0 THEN 'cold' ELSE '' END AS flag FROM (SELECT team, coalesce(implied_total, 0) AS v FROM totals) a
UNION ALL SELECT 'banned', CAST(player_id AS VARCHAR), pts_q50, '' FROM pool WHERE is_banned UNION ALL SELECT 'inflated', CAST(player_id AS VARCHAR), pts_q50, '' FROM pool WHERE pts_q50 > 25
UNION ALL SELECT 'ownership', CAST(player_id AS VARCHAR), ownership_proj, '' FROM (SELECT * FROM pool ORDER BY ownership_proj DESC, player_id LIMIT 10) o
UNION ALL SELECT 'leverage', CAST(player_id AS VARCHAR), lev, '' FROM {LEVERAGE} l
UNION ALL SELECT 'freshness', 'batting log', CAST(max(l_shipdate)::DATE - DATE '1970-01-01' AS DOUBLE), '' FROM lineitem
UNION ALL SELECT 'top ' || list, CAST(player_id AS VARCHAR), pts_q50, '' FROM lists""", "value", views=f"{PT}, {LISTS}")
def _(t):
    fresh = t["lineitem"].agg(F.max(F.to_date("l_shipdate")).alias("day")).withColumn("dataset", F.lit("batting log"))
    return R.pre_slate_report(b.pool(t), b.totals(t), freshness=fresh)


@query("D96_notification_lists", """SELECT team AS label, implied_total AS value FROM (SELECT * FROM totals WHERE implied_total IS NOT NULL ORDER BY implied_total DESC, team LIMIT 3) a
UNION ALL SELECT CAST(player_id AS VARCHAR), leverage_score FROM (SELECT * FROM pool ORDER BY leverage_score DESC, player_id LIMIT 5) z""", "value", views=PT)
def _(t):
    lev = R.sort_by(b.pool(t), "leverage_score").limit(5).select(F.col("player_id").cast("string").alias("label"), F.col("leverage_score").alias("value"))
    return R.top_totals(b.totals(t), 3).select(F.col("team").alias("label"), F.col("implied_total").alias("value")).unionByName(lev)
