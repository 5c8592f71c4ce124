"""Ingest queries: documents and files are made from the driver tables on Spark, then parsed back.

The equivalent SQL reads the tables directly, so a parser that loses or changes a value shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import columns as C
from ..functions import text as X
from ..operators import model as M
from ..operators import slate as SL
from ..session import new_dir
from ..sources import payloads as PL
from ..sources import tables as src
from ..sources.export import lineup_lines
from ..sources.salaries import parse_salaries
from . import bindings as b
from .lineup_queries import BASE as LINEUPS
from .lineup_queries import lineups
from .registry import query
from .stream_queries import _all_but_may, _labelled

# --- text functions on derived text

GAME = "strftime(o_orderdate, '%m/%d/%Y')"


def _orders(t):
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    hour = F.lpad((F.col("o_orderkey") % 12 + 1).cast("string"), 2, "0")
    info = F.concat(F.lit("AAA@BB "), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" "), hour, F.lit(":05PM  ET"))
    return o.withColumn("info", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("postponed")).otherwise(info))


@query("F05_game_info", """SELECT o_orderkey, o_orderpriority <> '5-LOW' AS ok, CASE WHEN o_orderpriority <> '5-LOW' THEN 'AAA' ELSE '' END AS away_team, CASE WHEN o_orderpriority <> '5-LOW' THEN 'BB' ELSE '' END AS home_team,
 CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS game_date, CASE WHEN o_orderpriority <> '5-LOW' THEN lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || ':05PM ET' ELSE '' END AS game_time_et FROM orders""")
def _(t):
    g = X.game_info("info")
    return _orders(t).select("o_orderkey", g.alias("g")).select("o_orderkey", "g.ok", "g.away_team", "g.home_team", "g.game_date", "g.game_time_et")


@query("P20_slate_start", "SELECT o_custkey AS slate, min(CAST(o_orderdate AS DATE)) AS game_date FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def _(t):
    g = X.game_info("info")
    rows = _orders(t).select(F.col("o_custkey").alias("slate"), g.alias("g")).filter("g.ok")
    return rows.groupBy("slate").agg(F.min("g.game_date").alias("game_date"))


@query("F06_number_capture", "SELECT o_orderkey, epoch_ms(o_orderdate) AS millis, CAST(o_orderkey % 50 + 1 AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 1000000 WHEN 1 THEN 1000 ELSE 1 END AS prize FROM orders", "prize")
def _(t):
    o = t["orders"]
    millis = (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000).cast("string")
    suffix = F.when(F.col("o_orderkey") % 3 == 0, "M").when(F.col("o_orderkey") % 3 == 1, "K").otherwise("")
    texts = o.select("o_orderkey", F.concat(F.lit("/Date("), millis, F.lit(")/")).alias("d"), F.concat(F.lit("Big $"), (F.col("o_orderkey") % 50 + 1).cast("string"), suffix, F.lit(" Max")).alias("p"))
    return texts.select("o_orderkey", F.unix_millis(C.epoch_millis("d")).alias("millis"), C.prize_value("p").alias("prize"))


@query("F07_whitespace_collapse", r"SELECT doc_id, regexp_replace(trim(text, ' '), '\s+', ' ', 'g') AS text FROM documents")
def _(t):
    return t["documents"].select("doc_id", X.squeeze("text").alias("text"))


@query("F08_thousands_separator", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS amount FROM orders")
def _(t):
    o = t["orders"].select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("p"))
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.concat("p", F.lit(" or so"))).otherwise(F.col("p"))
    return o.select("o_orderkey", C.parse_count(raw).alias("amount"))


@query("F09_numeric_default", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 0 ELSE o_totalprice END AS value, o_orderkey % 5 = 1 AS warned FROM orders", "value")
def _(t):
    o = t["orders"].select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("raw"))
    number = F.col("raw").try_cast("double")
    return o.select("o_orderkey", F.coalesce(number, F.lit(0.0)).alias("value"), ((F.col("raw") != "") & number.isNull()).alias("warned"))


@query("F10_date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, "13/45/2026").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return t["orders"].select("o_orderkey", F.try_to_date(text, "M/d/yyyy").alias("d"))


@query("F12_accent_fold", "SELECT doc_id, strip_accents(lower(trim(text, ' '))) AS text FROM documents")
def _(t):
    return t["documents"].select("doc_id", X.fold_accents("text").alias("text"))


_NAMES = list(S.TEAM_NAME) + ["Seoul Heroes"]
_CODE = "CASE i " + " ".join(
    f"WHEN {i} THEN '{S.TEAM_ALIAS.get(S.TEAM_NAME.get(n, n[:3].upper()), S.TEAM_NAME.get(n, n[:3].upper()))}'" for i, n in enumerate(_NAMES)
) + " END"


@query("F17_team_codes", f"SELECT c_custkey, {_CODE} AS team FROM (SELECT c_custkey, c_custkey % {len(_NAMES)} AS i FROM customer) c")
def _(t):
    names = F.array(*[F.lit(n) for n in _NAMES])
    full = F.get(names, (F.col("c_custkey") % len(_NAMES)).cast("int"))
    return t["customer"].select("c_custkey", PL.team_code(full).alias("team"))


@query("F20_innings_text", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 3 AS innings FROM lineitem", "innings")
def _(t):
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("outs"))
    text = F.concat(F.floor(F.col("outs") / 3).cast("string"), F.lit("."), (F.col("outs") % 3).cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", C.innings_from_text(text).alias("innings"))


@query("F33_minutes_to_lock", "SELECT o_orderkey, greatest(date_diff('day', TIMESTAMP '1998-01-01', o_orderdate) * 1440, 0) AS minutes FROM orders")
def _(t):
    at = lambda c: F.to_timestamp(F.concat(c, F.lit(" 00:00:00 UTC")), "yyyy-MM-dd HH:mm:ss z")
    o = t["orders"].select("o_orderkey", at(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("lock"))
    return o.select("o_orderkey", C.minutes_to_lock("lock", at(F.lit("1998-01-01"))).alias("minutes"))


@query("F35_array_position", "SELECT player_id, unnest(range(1, len(position_eligibility) + 1)) AS place, unnest(position_eligibility) AS slot FROM pool", views=b.POOL_SQL)
def _(t):
    return b.pool(t).select("player_id", F.posexplode("position_eligibility").alias("p", "slot")).select("player_id", (F.col("p") + 1).alias("place"), "slot")


# --- documents


@query("S10_flatten_schedule_lineups", """SELECT l_orderkey AS game_pk, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS batting_order,
 l_partkey AS mlbam_id, CASE WHEN l_linestatus = 'F' THEN 'LAD' ELSE '7' END AS team FROM lineitem""")
def _(t):
    li = t["lineitem"].select("l_orderkey", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey")
    # A game's players are a handful of lines; their list is the document being made.
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == s, F.struct("l_linenumber", "l_partkey", "l_suppkey")))), lambda x: F.struct(x["l_partkey"].alias("id")))
    g = li.groupBy("l_orderkey").agg(side("F").alias("home"), side("O").alias("away"))
    team = lambda i: F.struct(F.struct(F.lit(i).alias("id")).alias("team"))
    game = F.struct(
        F.col("l_orderkey").alias("gamePk"), F.struct(team(119).alias("home"), team(7).alias("away")).alias("teams"),
        F.struct(F.col("home").alias("homePlayers"), F.col("away").alias("awayPlayers")).alias("lineups"),
    )
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("1998-01-01").alias("date"), F.array(game).alias("games"))).alias("dates")))
    return PL.flatten_schedule_lineups(g.select(doc.alias("payload"))).select("game_pk", "batting_order", "mlbam_id", "team")


@query("S11_flatten_odds", """SELECT game_id, unnest(['LAD', 'ATL']) AS team, unnest([h, a]) AS implied_total, unnest([hm, am]) AS moneyline, total AS game_total FROM (
 SELECT CAST(o_orderkey AS VARCHAR) AS game_id, total, CAST(o_orderkey % 300 AS DOUBLE) AS hm, CAST(-(o_orderkey % 200) AS DOUBLE) AS am,
  least(greatest((total - s) / 2, 2), 9) AS h, least(greatest((total + s) / 2, 2), 9) AS a
 FROM (SELECT *, 3 + (o_orderkey % 33) / 2e0 AS total, CASE WHEN abs((o_orderkey % 19 - 9) / 2e0) > 3 THEN 0 ELSE (o_orderkey % 19 - 9) / 2e0 END AS s FROM orders WHERE o_orderstatus <> 'P') o) x""",
       "implied_total moneyline game_total")
def _(t):
    k = F.col("o_orderkey")
    home, away = "Los Angeles Dodgers", "Atlanta Braves"
    out = lambda name, field, v: F.struct(F.lit(name).alias("name"), v.alias(field))
    total = F.when(F.col("o_orderstatus") != "P", F.lit(3.0) + (k % 33) / 2.0)  # no total: the game is skipped
    market = lambda key, *os: F.struct(F.lit(key).alias("key"), F.to_json(F.array(*os)).alias("o"))
    parts = [market("totals", out("Over", "point", total)), market("spreads", out(home, "point", (k % 19 - 9) / 2.0)),
             market("h2h", out(home, "price", (k % 300).cast("double")), out(away, "price", (-(k % 200)).cast("double")))]
    markets = F.concat_ws(",", *[F.concat(F.lit('{"key":"'), m["key"], F.lit('","outcomes":'), m["o"], F.lit("}")) for m in parts])
    doc = F.concat(F.lit('[{"id":"'), k.cast("string"), F.lit(f'","home_team":"{home}","away_team":"{away}","bookmakers":[{{"key":"b","markets":['), markets, F.lit("]}]}]"))
    docs = t["orders"].select(doc.alias("payload"), F.lit("now").alias("fetched_at"))
    return PL.flatten_odds(docs).select("game_id", "team", "implied_total", "moneyline", "game_total")


@query("S12_flatten_roster_status", """SELECT p_partkey AS player_id, lower(p_name) AS name_key, CASE WHEN p_size <= 9 THEN 'D' || p_size WHEN p_size <= 20 THEN 'DTD' ELSE '' END AS code,
 CASE WHEN p_size <= 9 THEN 'size ' || p_size WHEN p_size <= 20 THEN 'DTD' ELSE 'roster status' END AS reason FROM part""")
def _(t):
    s = F.col("p_size")
    obj = F.to_json(F.struct(F.concat(F.lit("d"), s.cast("string")).alias("code"), F.concat(F.lit("size "), s.cast("string")).alias("description")))
    status = F.when(s <= 9, obj).when(s <= 20, F.lit('"dtd"')).otherwise(F.lit("null"))
    doc = F.concat(F.lit('{"roster":[{"person":{"id":'), F.col("p_partkey").cast("string"), F.lit(',"fullName":" '), "p_name", F.lit('"},"status":'), status, F.lit("}]}"))
    return PL.flatten_roster_status(t["part"].select(doc.alias("payload")))


@query("S13_flatten_injuries", "SELECT p_partkey AS player_id, CASE WHEN p_size < 25 THEN 'OUT' ELSE 'D15' END AS code, p_name AS description FROM part")
def _(t):
    pid, name = F.col("p_partkey").cast("string"), F.col("p_name")
    one = F.concat(F.lit('{"injuries":[{"playerId":'), pid, F.lit(',"status":"out","description":"'), name, F.lit('"}]}'))
    two = F.concat(F.lit('{"teams":[{"id":'), pid, F.lit(',"injuryStatus":{"code":"D15"},"note":"'), name, F.lit('"}]}'))
    return PL.flatten_injuries(t["part"].select(F.when(F.col("p_size") < 25, one).otherwise(two).alias("payload")))


@query("S14_flatten_probables", "SELECT CASE WHEN s_nationkey = 3 THEN 'ARI' ELSE 'N' || s_nationkey END AS team, s_name AS pitcher_name FROM supplier WHERE s_nationkey <> 5")
def _(t):
    code = F.when(F.col("s_nationkey") == 3, "AZ").when(F.col("s_nationkey") == 5, "").otherwise(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    doc = F.concat(F.lit('{"dates":[{"games":[{"teams":{"home":{"team":{"abbreviation":"'), code, F.lit('"},"probablePitcher":{"fullName":"'), "s_name", F.lit('"}},"away":{"team":{"abbreviation":"Q"}}}}]}]}'))
    return PL.flatten_probables(t["supplier"].select(doc.alias("payload")))


@query("S15_flatten_contests", """SELECT o_custkey AS group_id, o_orderpriority AS name, CASE WHEN o_orderkey % 40 = 0 THEN 999e0 ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS entry_fee,
 CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS max_entries, o_totalprice AS prize_pool, epoch_ms(o_orderdate) AS start_ms FROM orders""", "entry_fee prize_pool")
def _(t):
    millis = (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000).cast("string")
    entry = F.struct(
        F.lit("Classic").alias("gameType"), F.col("o_orderpriority").alias("n"), (F.col("o_orderkey") % 40).alias("a"),
        F.when(F.col("o_orderstatus") == "P", "many").otherwise(F.floor("o_totalprice").cast("string")).alias("m"),
        F.col("o_totalprice").cast("string").alias("po"), F.concat(F.lit("/Date("), millis, F.lit(")/")).alias("sd"), F.col("o_custkey").alias("dg"),
    )
    flat = PL.flatten_contests(t["orders"].select(F.to_json(F.struct(F.array(entry).alias("Contests"))).alias("payload")))
    days = F.datediff(F.col("start_utc").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000
    return flat.select("group_id", "name", "entry_fee", "max_entries", "prize_pool", days.alias("start_ms"))


# --- files


def _salary_files(t):
    """One salary file per brand; the files of even brands have the second layout. Some lines are broken on purpose."""
    p = t["part"].select("p_partkey", "p_name", "p_type", "p_size", "p_brand", "p_retailprice")
    key = F.col("p_partkey").cast("string")
    brand = F.substring("p_brand", 7, 2).cast("int")
    salary = F.when(F.col("p_size") == 50, "?").otherwise(F.concat(F.lit('"'), F.format_number(F.floor(F.col("p_retailprice") * 10), 0), F.lit('"')))
    info = F.when(F.col("p_size") == 49, "soon").otherwise("AAA@BBB 05/08/2026 10:10PM ET")
    avg = F.when(F.col("p_size") == 48, "n/a").otherwise(F.col("p_size").cast("string"))
    roster = F.when(F.col("p_size") == 47, "").when(F.col("p_type") == "PROMO", "P").otherwise("1B/OF")
    prefix = F.when(brand % 2 == 0, "," * S.SALARY_PREFIX).otherwise("")
    line = F.concat(prefix, F.concat_ws(",", "p_type", F.concat("p_name", F.lit(" ("), key, F.lit(")")), "p_name", key, roster, salary, info, "p_brand", avg))
    body = p.select(brand.alias("file"), F.lit(2).alias("o"), F.col("p_partkey").alias("k"), line.alias("line"))
    heads = p.select(brand.alias("file")).distinct()
    pre = F.when(F.col("file") % 2 == 0, "," * S.SALARY_PREFIX).otherwise("")
    head = heads.select("file", F.lit(1).alias("o"), F.lit(0).cast("bigint").alias("k"), F.concat(pre, F.lit(",".join(S.SALARY_COLUMNS))).alias("line"))
    note = heads.filter(F.col("file") % 2 == 0).select("file", F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("k"), F.lit("P,P,C,1B,2B,3B,SS,OF,OF,OF,,note").alias("line"))
    rows = head.unionByName(note).unionByName(body).repartition("file").sortWithinPartitions("file", "o", "k")
    out = new_dir(t.spark, "salaries")
    rows.select("file", "line").write.partitionBy("file").text(out)
    return parse_salaries(t.spark, f"{out}/*/*.txt")


@query("D30_parse_salaries", """SELECT CAST(p_partkey AS VARCHAR) AS player_id, p_name AS name, CAST(floor(p_retailprice * 10) AS BIGINT) AS salary, p_type = 'PROMO' AS is_pitcher, p_brand AS team,
 DATE '2026-05-08' AS game_date, CASE WHEN p_type = 'PROMO' THEN ['P'] ELSE ['1B', 'OF'] END AS position_eligibility, CASE WHEN p_size = 48 THEN 0e0 ELSE CAST(p_size AS DOUBLE) END AS avg_points_per_game FROM part WHERE p_size NOT IN (47, 49, 50)""",
       "avg_points_per_game")
def _(t):
    return _salary_files(t).players.select("player_id", "name", "salary", "is_pitcher", "team", "game_date", "position_eligibility", "avg_points_per_game")


_LINE = "row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN 2 ELSE 1 END"


@query("S07_salary_line_numbers", f"""SELECT line AS row, CASE p_size WHEN 50 THEN 'Salary' WHEN 49 THEN 'Game Info' WHEN 48 THEN 'AvgPointsPerGame' ELSE 'Roster Position' END AS field,
 CASE WHEN p_size = 48 THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM (SELECT p_size, {_LINE} AS line FROM part) x WHERE p_size BETWEEN 47 AND 50 GROUP BY 1, 2, 3""")
def _(t):
    return _salary_files(t).errors.groupBy("row", "field", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("S08_file_counts", "SELECT count(*) AS n_rows, count(*) FILTER (p_size NOT IN (47, 49, 50)) AS parsed, count(DISTINCT p_brand) AS files, count(DISTINCT p_brand) AS hashes FROM part")
def _(t):
    s = _salary_files(t).summary
    return s.agg(F.sum("raw_row_count").alias("n_rows"), F.sum("parsed_row_count").alias("parsed"), F.count(F.lit(1)).alias("files"), F.countDistinct("file_hash").alias("hashes"))


@query("S06_salary_summary", "SELECT count(*) AS player_count, count(*) FILTER (p_type = 'PROMO') AS pitcher_count, list_sort(list(DISTINCT p_brand)) AS teams FROM part WHERE p_size NOT IN (47, 49, 50)")
def _(t):
    return SL.slate_summary(_salary_files(t).players).select("player_count", "pitcher_count", "teams")


@query("S02_write_then_read", "SELECT season, batter, count(*) AS n, CAST(sum(at_bat_number) AS BIGINT) AS ids FROM pitches GROUP BY 1, 2", views=b.PITCHES_SQL)
def _(t):
    root = new_dir(t.spark, "tables")
    src.write_table(b.pitches(t), root, "events/pitches")
    stored = src.read_table(t.spark, root, "events/pitches")
    return stored.groupBy("season", "batter").agg(F.count(F.lit(1)).alias("n"), F.sum("at_bat_number").alias("ids"))


def _catalog(t):
    root = new_dir(t.spark, "tables")
    at = lambda s: F.lit(s).cast("timestamp")
    for name in ("orders", "customer"):
        df = t[name]
        src.write_table(df, root, f"base/{name}", partition=None)
        n = src.read_table(t.spark, root, f"base/{name}").count()
        src.record(t.spark, root, name, "pulled", n, 1.0, [1998], at("2026-01-01 00:00:00"))
        src.record(t.spark, root, name, "cached", n, 0.0, [1998], at("2026-01-02 00:00:00"))
    return root


@query("S03_table_meta", "SELECT 'orders' AS dataset, 'cached' AS status, count(*) AS rows FROM orders UNION ALL SELECT 'customer', 'cached', count(*) FROM customer")
def _(t):
    return src.table_meta(t.spark, _catalog(t)).select("dataset", "status", "rows")


@query("S04_list_tables", "SELECT 'base/orders' AS key UNION ALL SELECT 'base/customer'")
def _(t):
    return src.list_tables(t.spark, _catalog(t), "base/").select("key")


@query("D97_load_audit", "SELECT d AS dataset, s AS status, n AS rows FROM (SELECT 'orders' AS d, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer) x, (VALUES ('pulled'), ('cached')) v(s)")
def _(t):
    return src.load_audit(t.spark, _catalog(t)).select("dataset", "status", "rows")


@query("S18_latest_run", "SELECT o_orderpriority AS model_type, max(strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS run_id FROM orders GROUP BY 1")
def _(t):
    run = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    return src.latest_run(t["orders"].select(F.col("o_orderpriority").alias("model_type"), run.alias("run_id")))


@query("S17_export_lines", """SELECT '1998' AS slate_id, CAST(NULL AS BIGINT) AS lineup_id, 'R,A,N' AS line UNION ALL
SELECT '1998', lineup_id, concat_ws(',', coalesce(max(cell) FILTER (slot = 'R'), ''), coalesce(max(cell) FILTER (slot = 'A'), ''), coalesce(max(cell) FILTER (slot = 'N'), '')) FROM (
 SELECT *, row_number() OVER (PARTITION BY lineup_id, slot ORDER BY slot_idx, player_id) AS inst, name || ' (' || player_id || ')' AS cell FROM lu) w WHERE inst = 1 GROUP BY lineup_id""", views=LINEUPS)
def _(t):
    return lineup_lines(lineups(t).withColumn("slate_id", F.lit("1998")), ["R", "A", "N"]).select("slate_id", "lineup_id", "line")


@query("S20_model_save_load", "SELECT count(*) AS n, 0 AS apart FROM lineitem")
def _(t):
    """A model stored, read and stored again predicts what it did: rows whose triples differ."""
    rows, path = _labelled(t), new_dir(t.spark, "model")
    model = _all_but_may(t)
    model.save(path)
    keys = ["l_orderkey", "l_linenumber"]
    both = [m.predict(rows, keep=keys).select(F.xxhash64(*keys, "q15", "q50", "q85").alias("h")) for m in (model, M.QuantileModel.load(path))]
    return both[0].join(both[1].groupBy("h").count(), "h", "left").agg(F.count("*").alias("n"), F.count_if(F.col("count").isNull()).alias("apart"))
