"""Name resolution queries: part names against a register of edited names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_last, last_token, slug_name, token_sort, tokens
from ..functions.similarity import indel_ratio
from ..operators import names as N
from ..operators import project as PR
from ..operators import slate as SL
from ..operators.ordered import top_rows
from ..sources.html import page_items
from . import bindings as b
from .registry import query
from .slate_queries import CONF, starters

# Every part name enters the register as "Last, First"; names of odd length with one added letter.
REG = """reg AS (
  SELECT CASE WHEN len(name) % 2 = 0 THEN split_part(name, ' ', 2) ELSE split_part(name, ' ', 2) || 'x' END || ', ' || split_part(name, ' ', 1) AS name, min(player_id) AS register_id
  FROM pool GROUP BY 1),
regn AS (SELECT *, trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) AS normal_name FROM reg),
regteam AS (SELECT r.register_id, p.team FROM reg r JOIN pool p ON p.player_id = r.register_id)"""
SORTED = "array_to_string(list_sort(string_split({x}, ' ')), ' ')"
_CHARS = "list_transform(string_split({y}, ''), lambda ch: list_sum(list_transform(range(len({x})), lambda i: CASE WHEN {x}[i + 1] = ch THEN (1::UBIGINT << i) ELSE 0::UBIGINT END))::UBIGINT)"
_FULL = "((1::UBIGINT << len({x})) - 1)::UBIGINT"


def lcs_sql(x: str, y: str) -> str:
    full = _FULL.format(x=x)
    red = f"list_reduce({_CHARS.format(x=x, y=y)}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(len({x}) - bit_count({red}))"


def ratio_sql(x: str, y: str) -> str:
    return f"(200e0 * {lcs_sql(x, y)} / (len({x}) + len({y})))"


PAIRS = f"""names AS (SELECT DISTINCT name, {SORTED.format(x='name')} AS k FROM pool),
pairs AS (SELECT n.name, r.normal_name, r.register_id, {ratio_sql('n.k', 'r.rk')} AS score FROM names n, (SELECT *, {SORTED.format(x='normal_name')} AS rk FROM regn) r),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, normal_name) AS place FROM pairs WHERE score >= 82) c WHERE place <= 5)"""
BASE = f"{b.POOL_SQL}, {REG}"
FUZZY = f"{BASE}, {PAIRS}"


def _register(t):
    p = b.pool(t).select("name", F.col("player_id").alias("register_id"))
    parts = tokens("name")
    last = F.when(F.length("name") % 2 == 0, F.get(parts, 1)).otherwise(F.concat(F.get(parts, 1), F.lit("x")))
    ev = p.select(F.concat(last, F.lit(", "), F.get(parts, 0)).alias("name"), "register_id")
    none = t.spark.createDataFrame([], "key_mlbam bigint, name_first string, name_last string")
    return N.name_register(ev, none)


def _teams(t):
    return _register(t).select("register_id").join(b.pool(t).select(F.col("player_id").alias("register_id"), "team"), "register_id")


@query("D40_name_register", "SELECT name, register_id, normal_name FROM regn", views=BASE)
def _(t):
    return _register(t).select("name", "register_id", "normal_name")


@query("F11_last_first", "SELECT DISTINCT name, normal_name FROM regn", views=BASE)
def _(t):
    return _register(t).select("name", first_last("name").alias("normal_name")).distinct()


@query("F13_last_token", "SELECT player_id, string_split(name, ' ')[-1] AS surname FROM pool", views=b.POOL_SQL)
def _(t):
    return b.pool(t).select("player_id", last_token("name").alias("surname"))


@query("F14_token_sort", f"SELECT player_id, {SORTED.format(x='name')} AS k FROM pool", views=b.POOL_SQL)
def _(t):
    return b.pool(t).select("player_id", token_sort("name").alias("k"))


@query("F15_indel_similarity", f"SELECT player_id, {ratio_sql('name', 'position')} AS s FROM pool", "s", views=b.POOL_SQL)
def _(t):
    return b.pool(t).select("player_id", indel_ratio("name", "position").alias("s"))


@query("F19_team_containment", "SELECT player_id, contains(team, substr(team, 1, 2)) OR contains(substr(team, 1, 2), team) AS same FROM pool", views=b.POOL_SQL)
def _(t):
    return b.pool(t).select("player_id", N.same_team(F.col("team"), F.substring("team", 1, 2)).alias("same"))


@query("J12_exact_cascade", "SELECT player_id, r.register_id FROM pool p LEFT JOIN regn r ON p.name = r.normal_name", views=BASE)
def _(t):
    return N.exact_cascade(b.pool(t).select("player_id", "name", "team"), _register(t)).select("player_id", "register_id")


@query("J13_similarity_join", "SELECT name, normal_name AS candidate, score FROM pairs WHERE score >= 82", "score", views=FUZZY)
def _(t):
    return N.candidates(b.pool(t), _register(t), limit=None).select("name", "candidate", "score")


@query("K08_top_candidates", "SELECT name, normal_name AS candidate, register_id, score, place FROM cand", "score", views=FUZZY)
def _(t):
    return N.candidates(b.pool(t), _register(t))


@query("J14_team_tie_break", """SELECT name, team, register_id, team_match FROM (SELECT m.name, m.team, c.register_id, CAST(contains(g.team, m.team) OR contains(m.team, g.team) AS BIGINT) AS team_match,
 row_number() OVER (PARTITION BY m.name, m.team ORDER BY CAST(contains(g.team, m.team) OR contains(m.team, g.team) AS BIGINT) DESC, place) AS rn
 FROM (SELECT DISTINCT name, team FROM pool) m JOIN cand c USING (name) JOIN regteam g ON g.register_id = c.register_id) x WHERE rn = 1""", views=FUZZY)
def _(t):
    p = b.pool(t).select("name", "team").distinct()
    return N.pick_by_team(p, N.candidates(p, _register(t)), _teams(t)).select("name", "team", "register_id", "team_match")


@query("D41_resolve_players", """SELECT p.player_id, coalesce(e.register_id, f.register_id) AS register_id, CASE WHEN e.register_id IS NOT NULL THEN 'normalised' WHEN f.register_id IS NOT NULL THEN 'similar' END AS how
FROM pool p LEFT JOIN regn e ON p.name = e.normal_name LEFT JOIN (
 SELECT name, team, register_id FROM (SELECT m.name, m.team, c.register_id,
 row_number() OVER (PARTITION BY m.name, m.team ORDER BY contains(g.team, m.team) OR contains(m.team, g.team) DESC, place) AS rn
 FROM (SELECT DISTINCT name, team FROM pool) m JOIN cand c USING (name) JOIN regteam g ON g.register_id = c.register_id) x WHERE rn = 1) f ON p.name = f.name AND p.team = f.team""", views=FUZZY)
def _(t):
    p = b.pool(t).select("player_id", "name", "team")
    return N.resolve_players(p, _register(t), _teams(t)).select("player_id", "register_id", "how")


# Posted lineup of a team: its first nine hitters, spelled with one extra letter.
POSTED = f"""posted AS (SELECT team, name || 'y' AS name FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY player_id) AS rn FROM pool WHERE NOT is_pitcher) x WHERE rn <= 9),
best AS (SELECT h.player_id, max({ratio_sql('h.k', 'q.k')}) AS similarity FROM (SELECT player_id, team, {SORTED.format(x='lower(name)')} AS k FROM pool WHERE NOT is_pitcher) h
  JOIN (SELECT DISTINCT team, {SORTED.format(x='lower(name)')} AS k FROM posted WHERE team IN (SELECT team FROM posted GROUP BY 1 HAVING count(*) >= 8)) q ON h.team = q.team GROUP BY 1)"""


def _posted(t):
    nine = top_rows(b.pool(t).filter(~F.col("is_pitcher")), ["team"], [F.col("player_id")], 9)
    return nine.select("team", F.concat("name", F.lit("y")).alias("name"))


@query("D34_scratches", "SELECT player_id, similarity FROM best WHERE similarity < 80", "similarity", views=f"{b.POOL_SQL}, {POSTED}")
def _(t):
    return SL.scratches(b.pool(t), _posted(t)).select("player_id", "similarity")


@query("J15_best_match_anti_join", "SELECT p.team, count(*) AS n FROM best JOIN pool p USING (player_id) WHERE similarity < 80 GROUP BY 1", views=f"{b.POOL_SQL}, {POSTED}")
def _(t):
    return SL.scratches(b.pool(t), _posted(t)).groupBy("team").agg(F.count(F.lit(1)).alias("n"))


_SIM = ratio_sql(SORTED.format(x="lower(name)"), SORTED.format(x="lower(pitcher_name)"))


@query("D36_starter_check", f"""SELECT player_id, CASE WHEN c.pitcher_name IS NULL THEN 'no listing' WHEN {_SIM} >= 80 THEN 'confirmed' ELSE 'unconfirmed' END AS verdict
FROM pool p LEFT JOIN conf c ON p.team = c.team WHERE position = 'SP'""", views=f"{b.POOL_SQL}, {CONF}")
def _(t):
    return SL.starter_check(b.pool(t), starters(t)).select("player_id", "verdict")


@query("D45_confirmed_starter", f"SELECT player_id, position = 'SP' OR coalesce(is_pitcher AND {_SIM} >= 80, FALSE) AS is_confirmed FROM pool p LEFT JOIN conf c ON p.team = c.team", views=f"{b.POOL_SQL}, {CONF}")
def _(t):
    return PR.confirmed_flag(b.pool(t), starters(t)).select("player_id", "is_confirmed")


# --- landed pages


@query("S16_extract_from_html", """SELECT page_id, unnest(hrefs) AS href, unnest(titles) AS title, unnest(range(1, len(hrefs) + 1)) AS place FROM (
 SELECT page_id, regexp_extract_all(html, '<li[^>]*>\\s*<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<li[^>]*>\\s*<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS titles FROM pages) p""")
def _(t):
    return page_items(t["pages"], key="page_id", html="html").select("page_id", "href", "title", "place")


@query("F16_slug_to_name", r"""SELECT page_id, url, CASE WHEN contains(url, '.example.com/') THEN array_to_string(list_transform(list_filter(string_split(replace(regexp_replace(trim(split_part(string_split(url, '.example.com/')[-1], '?', 1), '/'), '-[^-]*$', ''), '-', ' '), ' '), lambda w: w <> ''),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name FROM pages""")
def _(t):
    return t["pages"].select("page_id", "url", slug_name("url", r".example.com/").alias("name"))
