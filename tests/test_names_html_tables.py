import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rosterlab import schemas as S
from rosterlab.functions.similarity import _similarity
from rosterlab.operators import evaluate as E
from rosterlab.operators import frames as fr
from rosterlab.operators import model as M
from rosterlab.operators import names as N
from rosterlab.operators import project as PR
from rosterlab.operators import quality as Q
from rosterlab.operators import slate as SL
from rosterlab.sources import html as H
from rosterlab.sources import tables as T


def words(seed, n, short=False):
    rng = random.Random(seed)
    size = (1, 6) if short else (3, 14)
    return sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(*size))).strip() for _ in range(n)} - {""})


@pytest.mark.parametrize("threshold", [82.0, 80.0, 70.0, 60.0])
@pytest.mark.parametrize("short", [False, True])
def test_similarity_join_loses_no_pair(spark, threshold, short):
    left = words(1, 150, short)
    right = sorted({*words(2, 150, short), *[w + "x" for w in left[:40]], *[w[1:] for w in left[40:80] if len(w) > 1]})
    f = lambda ws: spark.createDataFrame([(w,) for w in ws], "key string")
    got = {(r["left_key"], r["right_key"]) for r in N.similar_names(f(left), f(right), threshold).collect()}
    assert got == {(a, b) for a in left for b in right if _similarity(a, b) >= threshold}


def test_resolution_cascade(spark):
    ev = spark.createDataFrame([("Smith, John", 1, 0), ("Smith, John", 9, 1), ("Doe, Jane", 2, 0)], "name string, register_id long, priority int")
    reg = spark.createDataFrame([(3, "Jon", "Smithe"), (4, "Maria", "Lopez"), (5, "Maria", "Lopes"), (None, "No", "Id"), (6, "", "X")], "key_mlbam long, name_first string, name_last string")
    register = N.name_register(ev, reg)
    assert rows(register, "name", "register_id") == [("Doe, Jane", 2), ("Jon Smithe", 3), ("Maria Lopes", 5), ("Maria Lopez", 4), ("Smith, John", 1)]
    teams = spark.createDataFrame([(4, "NYY"), (5, "BOS"), (1, "KCR"), (3, "LAD")], "register_id long, team string")
    pool = spark.createDataFrame(
        [("a", "John Smith", "KC"), ("b", "Doe, Jane", "X"), ("c", "Lopezz Maria", "BOS"), ("d", "Lopezz Maria", "SEA"), ("e", "Zzz Qqq", "BOS"), ("f", "maria lopez", "NYY")],
        "player_id string, name string, team string")
    got = {r[0]: r[1:] for r in rows(N.resolve_players(pool, register, teams), "player_id", "register_id", "how")}
    assert got == {"a": (1, "normalised"), "b": (2, "exact"), "c": (5, "similar"), "d": (4, "similar"), "e": (None, None), "f": (None, None)}  # case counts


def test_starters_conflict_and_check(spark):
    p = spark.createDataFrame([("A", "José Peña"), ("B", "Al One")], "team string, pitcher_name string")
    s = spark.createDataFrame([("A", "J. Pena"), ("B", "Al Two"), ("C", "Fill In")], "team string, pitcher_name string")
    merged = SL.confirmed_starters(p, s)
    assert rows(merged, "team", "pitcher_name", "source", "conflict") == [("A", "José Peña", "primary", False), ("B", "Al One", "primary", True), ("C", "Fill In", "secondary", False)]
    pool = spark.createDataFrame([("1", "Al One", "b", "SP", True), ("2", "Bo Other", "B", "SP", True), ("3", "Cy", "Q", "SP", True), ("4", "In Fill", "C", "RP", True)], "player_id string, name string, team string, position string, is_pitcher boolean")
    assert rows(SL.starter_check(pool, merged), "player_id", "verdict") == [("1", "confirmed"), ("2", "unconfirmed"), ("3", "no listing")]
    assert rows(PR.confirmed_flag(pool, merged), "player_id", "is_confirmed") == [("1", True), ("2", True), ("3", True), ("4", True)]


def test_slate_projection_rules(spark):
    cols = "slate_id string, player_id string, name string, team string, position string, avg_points double, is_pitcher boolean"
    pool = spark.createDataFrame([
        ("S", "sp", "Al One", "A", "SP", 20.0, True), ("S", "no", "Bo Two", "B", "SP", 20.0, True), ("S", "rp", "Cy", "A", "RP", 20.0, True),
        ("S", "h1", "Di", "A", "OF", 10.0, False), ("S", "h2", "Ed", "A", "OF", 10.0, False), ("S", "h3", "Fy", "Z", "OF", 10.0, False),
    ], cols)
    pred = spark.createDataFrame([("h1", 1, 4.0, 8.0, 12.0), ("h2", 2, -1.0, -1.0, 0.0)], "player_id string, register_id long, model_q15 double, model_q50 double, model_q85 double")
    use = spark.createDataFrame([(1, 115), (2, 0)], "register_id long, pa_30d int")
    totals = spark.createDataFrame([("A", 4.95)], "team string, implied_total double")
    prob = spark.createDataFrame([("B", "Someone Else")], "team string, pitcher_name string")
    out = {r["player_id"]: r for r in PR.project_slate(pool, pred, use, totals, probables=prob).collect()}
    q = lambda p: tuple(out[p][f"pts_{x}"] for x in PR.Q)
    assert q("sp") == (8.0, 20.0, 40.0) and q("no") == (0.0, 0.0, 0.0) and q("rp") == (6.0, 15.0, 30.0)
    assert q("h1") == (4.0, 8.8, 13.2) and out["h1"]["used_model"]
    assert q("h2") == (3.0, 7.7, 17.6) and not out["h2"]["used_model"]
    assert q("h3") == (5.0, 10.0, 18.0) and out["h3"]["leverage_score"] == 1.0 and out["no"]["ownership_proj"] == 0.0


PAGE = """<div class="lineup is-mlb"><div class="lineup__abbr">OAK</div><div class="lineup__abbr">NYY</div>
<ul class="lineup__list is-visit"><li class="lineup__player-highlight mb-0"><div class="lineup__player-highlight-name"><a href="/baseball/player/pat-example-123">P. Example</a></div></li>
<li class="lineup__status is-confirmed">Confirmed</li>
<li class="lineup__player"><a title="Ann A" href="/x">A. A</a></li><li class="lineup__player"><a href="/y">Bob B</a></li></ul>
<ul class="lineup__list is-home"><li class="lineup__player-highlight"><a href="/baseball/player/zed-zed-9">Zed</a></li><li class="lineup__status is-expected">Expected</li><li class="lineup__player"><a title="Cy C" href="/z">C</a></li></ul></div>
<div class="lineup is-mlb"><div class="lineup__abbr">BOS</div></div>"""


def test_posted_page(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    assert rows(H.posted_sides(df), "team", "confirmed") == [("ATH", True), ("NYY", False)]
    assert rows(H.posted_lineups(df)) == [("ATH", 1, "Ann A"), ("ATH", 2, "Bob B")]
    assert rows(H.posted_starters(df)) == [("ATH", "Pat Example")]


def test_table_store(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(2025, 1, 1, 1, 5), (2026, 2, 1, 1, 6)], "season int, game_pk long, at_bat_number int, pitch_number int, x int")
    keys = ["game_pk", "at_bat_number", "pitch_number"]
    assert T.read_table(spark, root, "statcast/pitches") is None and not T.exists(spark, root, "statcast/pitches")
    assert T.read_table(spark, root, "statcast/pitches", S.PITCHES).count() == 0
    T.write_table(df, root, "statcast/pitches")
    T.write_table(df.filter("season = 2026").withColumn("x", F.lit(7)), root, "statcast/pitches")
    assert rows(T.read_table(spark, root, "statcast/pitches"), "season", "x") == [(2025, 5), (2026, 7)]
    new = spark.createDataFrame([(2026, 2, 1, 1, 8), (2026, 3, 1, 1, 9), (2027, 4, 1, 1, 1)], df.schema)
    for _ in range(2):  # a second delivery changes nothing
        T.incremental_append(spark, root, "statcast/pitches", new, keys)
    assert rows(T.read_table(spark, root, "statcast/pitches"), "season", "x") == [(2025, 5), (2026, 8), (2026, 9), (2027, 1)]
    pruned = T.load_seasons(T.read_table(spark, root, "statcast/pitches"), [2025])._jdf.queryExecution().executedPlan().toString()
    assert "= 2025)], PushedFilters" in pruned
    T.write_table(df.drop("season"), root, "crosswalk/ids")
    got = rows(T.list_tables(spark, root), "key", "files")
    assert [k for k, _ in got] == ["crosswalk/ids", "statcast/pitches"]
    assert [k for k, in rows(T.list_tables(spark, root, "stat"), "key")] == ["statcast/pitches"]
    now = lambda s: F.lit(s).cast("timestamp")
    T.record(spark, root, "pitches", "pulled", 2, 1.5, [2025], now("2026-01-01"))
    T.record(spark, root, "pitches", "cached", 4, 0.5, [2025, 2026], now("2026-01-02"))
    m = T.table_meta(spark, root).first()
    assert (m["rows"], m["status"], m["years"]) == (4, "cached", "2025,2026")
    assert rows(T.load_audit(spark, root), "status", "rows") == [("cached", 4), ("pulled", 2)]
    calls = []
    build = lambda: calls.append(1) or df
    for force in (False, False, True):
        assert T.materialize(spark, root, "features/m", build, force).count() == 2
    assert len(calls) == 2
    runs = spark.createDataFrame([("q", "run_1"), ("q", "run_2"), ("p", "run_0")], "model_type string, run_id string")
    assert rows(T.latest_run(runs)) == [("p", "run_0"), ("q", "run_2")]


def test_conform(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "game_pk long, launch_speed double")
    out = fr.conform(df, S.PITCHES, {"events": "none"})
    assert out.columns == S.PITCHES.fieldNames() and rows(out, "launch_speed", "events") == [(3.0, "none"), (None, "none")]
    assert rows(fr.conform(df, S.PITCHES, {"launch_speed": 1.0}), "launch_speed") == [(1.0,), (3.0,)]
    assert rows(fr.features(df, ["launch_speed", "absent"], ["game_pk"])) != []


def test_relational_tables_report_their_violations(spark):
    schema = "id string, slate_id string, player_id string, game_id string, salary int, position_eligibility array<string>, batting_order int, lineup_status string"
    f = lambda **r: tuple({**dict(id="1", slate_id="s", player_id="p", game_id=None, salary=3000, position_eligibility=["P"], batting_order=1, lineup_status="bench"), **r}.values())
    sal = spark.createDataFrame([f(), f(id="2", salary=100, batting_order=10), f(id="3", slate_id="gone", lineup_status="late"), f(id="4", slate_id=None, batting_order=None)], schema)
    parents = {"slates": spark.createDataFrame([("s",)], "id string"), "players": spark.createDataFrame([("p",)], "id string")}
    got = {r[1:] for r in rows(Q.check_table("salaries", sal, parents))}
    assert got == {("check", "salary", 1), ("check", "batting_order", 1), ("check", "lineup_status", 1), ("not_null", "slate_id", 1), ("unique", "slate_id,player_id", 1), ("reference", "slate_id", 1)}
    assert Q.check_table("salaries", sal.limit(0), parents).count() == 0 and Q.broken_constraints(sal).count() == 0
    assert set(S.REQUIRED) | set(S.UNIQUE) | set(S.REFERENCES) >= set(S.CHECKS)


def test_backtest_and_coverage(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (5.0, 6.0, 4.0, 3.0), (0.0, 0.0, 0.0, 0.0), (9.0, 1.0, 8.0, 20.0)], "points_game double, q15 double, q50 double, q85 double")
    v = E.monotonicity_violations(df).first()
    assert (v[0], v[1]) == (1, 1)
    b = E.backtest(df).first()
    assert b["mae"] == 1.0 and b["median_ae"] == 1.0 and b["n_samples"] == 4 and b["pct_zero_actual"] == 0.5
    assert b["q15_coverage"] == 0.25 and b["q85_coverage"] == 0.5
    c = E.coverage_report(df).first()
    assert c["n_nonzero"] == 2 and c["q15_coverage_nonzero"] == 0.5
    assert E.coverage_report(df.withColumn("points_game", F.lit(0.0))).first()["q85_coverage_nonzero"] is None


def test_quantile_model_round_trip(spark, tmp_path):
    df = spark.range(1500).select((F.col("id") % 10).cast("double").alias("a"), (F.hash("id") % 5).cast("double").alias("noise"))
    df = df.withColumn("y", F.col("a") * 3 + F.col("noise")).repartition(3)
    m = M.train_quantiles(df, ["a", "b"], "y", trees=12, depth=3, step=0.3)
    p = m.predict(df, keep=["y"])
    cover = E.calibration(p, "y").first()
    assert p.filter("q15 > q50 or q85 < q50").count() == 0 and 0.02 < cover["q15_coverage"] < 0.4 and 0.6 < cover["q85_coverage"] < 0.98
    m.save(str(tmp_path / "m"))
    again = M.QuantileModel.load(str(tmp_path / "m")).predict(df, keep=["y"])
    assert rows(again) == rows(p)
    assert M.top_features(m.importance(df), 1).first()["feature"] == "a"


def test_streaming_reads_new_files_once(spark, tmp_path):
    from rosterlab.streaming import streams as ST

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev = lambda *r: spark.createDataFrame([(i, dt.datetime(2026, 1, d), k, v) for i, d, k, v in r], "id long, ts timestamp, k string, v double").coalesce(1)
    run = lambda: ST.drain(ST.latest_per_key(ST.read_stream(spark, src, "ts", 1), "k", ["v"], ["ts", "id"]), "update", out)
    ev((1, 1, "a", 1.0), (2, 2, "b", 2.0)).write.parquet(src)
    run()
    ev((3, 3, "a", 3.0), (4, 1, "b", 9.0)).write.mode("append").parquet(src)
    run()
    run()
    schema = ST.latest_per_key(ST.read_stream(spark, src, "ts"), "k", ["v"], ["ts", "id"]).schema
    assert rows(ST.latest_state(spark, out, schema, ["k"])) == [("a", 3.0), ("b", 2.0)]


def test_keys_unseen_for_long_leave_the_state(spark, tmp_path):
    from rosterlab.streaming import streams as ST

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    ev = lambda *r: spark.createDataFrame([(i, day(d), k, v) for i, d, k, v in r], "id long, ts timestamp, k string, v double").coalesce(1)
    seen: list = []

    def run():
        stream = ST.read_stream(spark, src, "ts", 1)
        latest = ST.latest_per_live_key(stream, "k", ["v"], ["ts", "id"], "ts", dt.timedelta(days=10))
        ST.drain(latest, "update", out, progress=seen)
        return rows(ST.latest_state(spark, out, latest.schema, ["k"]))

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    ev((1, 1, "a", 1.0), (2, 2, "b", 2.0), (3, 1, "b", 9.0), (4, 2, "c", None)).write.parquet(src)
    assert run() == [("a", 1.0), ("b", 2.0), ("c", None)]
    ev((5, 3, "a", 3.0), (6, 40, "d", 4.0)).write.mode("append").parquet(src)
    run()
    ev((7, 41, "d", 5.0)).write.mode("append").parquet(src)
    assert run() == [("a", 3.0), ("b", 2.0), ("c", None), ("d", 5.0)]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in seen) >= 3
    assert seen[-1]["stateOperators"][0]["numRowsTotal"] == 1  # a, b and c are gone, what they last were is in the output
