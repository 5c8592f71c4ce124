import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from rosterlab import schemas as S
from rosterlab.operators import batter as B
from rosterlab.operators import frames as fr
from rosterlab.operators import pitcher as P

D0 = dt.date(2026, 4, 1)


def pitch_rows(n=260, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ev = rng.choice(["single", "double", "home_run", "walk", "strikeout", "strikeout_double_play", "field_out", "", None, "triple", "hit_by_pitch"])
        out.append(dict(
            season=2026, game_pk=1000 + i // 9, game_date=D0 + dt.timedelta(days=i // 9), at_bat_number=i, pitch_number=1, batter=rng.randint(1, 3), pitcher=rng.randint(10, 12),
            events=ev, description=rng.choice(S.SWINGS + ["ball"]), pitch_type=rng.choice(["FF", "SL", "FC", None]), release_speed=rng.choice([None, 94.5, 90.1]),
            launch_speed=rng.choice([None, 94.9, 95.0, 101.3]), launch_speed_angle=rng.choice([None, 5, 6]), estimated_woba_using_speedangle=rng.choice([None, 0.1, 0.35, 0.9]),
            babip_value=rng.choice([None, 0.0, 1.0]), p_throws=rng.choice(["R", "L", None]), stand="R", inning_topbot=rng.choice(["Top", "Bot"]), home_team=rng.choice(["COL", " sf ", "ZZZ"]), away_team="ATL",
        ))
    return out


@pytest.fixture(scope="module")
def raw():
    return pitch_rows()


@pytest.fixture(scope="module")
def pitches(spark, raw):
    names = list(raw[0])
    kinds = {f.name: f.dataType.simpleString() for f in S.PITCHES.fields}
    return spark.createDataFrame([tuple(r[n] for n in names) for r in raw], ", ".join(f"{n} {kinds[n]}" for n in names)).repartition(3).cache()


@pytest.fixture(scope="module")
def pdf(raw):
    return pd.DataFrame(raw)


def test_rolling_matches_pandas(pitches, pdf):
    pa = pdf[pdf.events.notna() & (pdf.events != "")].sort_values(["batter", "game_date", "at_bat_number"]).copy()
    pa["barrel"] = (pa.launch_speed_angle == 6).astype(float)
    pa["hard_hit"] = (pa.launch_speed >= 95).astype(float)
    pa["k"] = pa.events.isin(S.STRIKEOUTS).astype(float)
    g = pa.groupby("batter", sort=False)
    want = {}
    for src, out, w in (("estimated_woba_using_speedangle", "xwoba_14d", 14), ("launch_speed", "exit_velo_7d", 7), ("barrel", "barrel_rate_30d", 30), ("hard_hit", "hard_hit_7d", 7), ("k", "k_rate_14d", 14)):
        want[out] = g[src].transform(lambda s, w=w: s.rolling(w, min_periods=1).mean())
    got = B.batter_rolling(fr.terminal_only(pitches)).toPandas().set_index("at_bat_number")
    for c, s in want.items():
        s.index = pa.at_bat_number.astype("int32")
        pd.testing.assert_series_equal(got[c].astype(float).sort_index(), s.astype(float).sort_index(), check_names=False, atol=1e-9)
    gap = (got.hard_hit_7d - got.hard_hit_30d - got.hard_hit_trend).abs().max()
    assert gap < 1e-12


def test_gap_is_zero_without_babip(pitches):
    assert {r[0] for r in B.batter_rolling(fr.terminal_only(pitches).drop("babip_value")).select("xwoba_babip_gap_7d").collect()} == {0.0}


def test_platoon_matches_row_loop(pitches, pdf):
    known = pdf[pdf.estimated_woba_using_speedangle.notna()]
    got = B.platoon(B.batter_rolling(fr.terminal_only(pitches)), pitches).toPandas()
    for r in got.itertuples():
        past = known[(known.batter == r.batter) & (known.game_date >= r.game_date - dt.timedelta(days=30)) & (known.game_date < r.game_date)]
        x = {h: past[past.p_throws == h].estimated_woba_using_speedangle for h in "RL"}
        vs = x.get(r.p_throws)
        want = vs.mean() if vs is not None and len(vs) >= 3 else r.xwoba_30d
        assert (pd.isna(want) and pd.isna(r.xwoba_vs_hand_30d)) or abs(want - r.xwoba_vs_hand_30d) < 1e-9
        split = abs(x["R"].mean() - x["L"].mean()) if min(len(x["R"]), len(x["L"])) >= 3 else 0.0
        assert abs(split - r.platoon_split_magnitude) < 1e-9


def test_thirty_days_is_inclusive_thirty_one_is_not(spark):
    at = lambda d: D0 + dt.timedelta(days=d)
    data = [(1, at(d), "R", 0.5) for d in (0, 0, 0, 30, 31)]
    df = spark.createDataFrame(data, "batter long, game_date date, p_throws string, estimated_woba_using_speedangle double")
    n = dict(rows(B.hand_history(df), "game_date", "_n_R"))
    assert n == {at(0): 0, at(30): 3, at(31): 1}


def test_game_level_last_skips_null(spark):
    data = [(1, D0, 1, 1, 1, 5.0, 0.1, "AAA"), (1, D0, 1, 2, 1, 2.0, 0.2, "BBB"), (1, D0, 1, 3, 1, 0.0, None, None)]
    df = spark.createDataFrame(data, "batter long, game_date date, game_pk long, at_bat_number int, pitch_number int, points double, xwoba_7d double, home_team string")
    r = B.to_game_level(df).first()
    assert (r["points_game"], r["pa_count"], r["xwoba_7d"], r["home_team"]) == (7.0, 3, 0.2, "AAA")


def test_scores_and_parks(pitches, spark):
    df = spark.createDataFrame([("home_run", 1, 2, 1), ("field_out", None, 0, 0), (None, 0, 0, 2)], "events string, runs_scored int, rbi int, stolen_bases int")
    assert [r["points_batting"] for r in B.score_batting_full(df).collect()] == [21.0, 0.0, 10.0]
    assert {(r["home_team"], r["park_factor"]) for r in B.park_factor(pitches).select("home_team", "park_factor").distinct().collect()} == {("COL", 1.122), (" sf ", 0.955), ("ZZZ", 1.0)}
    o = spark.createDataFrame([(1,), (9,), (0,), (None,), (10,)], "batting_order int")
    assert [r[1] for r in B.batting_order_multiplier(o).collect()] == [1.15, 0.85, 1.0, 1.0, 1.0]


def test_daily_counts_match_pandas(pitches, pdf):
    d = pdf.copy()
    d["whiff"], d["swing"] = d.description.isin(S.WHIFFS), d.description.isin(S.SWINGS)
    d["fb"] = d.pitch_type.isin(S.FASTBALLS)
    d["fbv"] = d.release_speed.where(d.fb)
    want = d.groupby(["pitcher", "game_date"]).agg(whiffs=("whiff", "sum"), swings=("swing", "sum"), fb_count=("fb", "sum"), v=("fbv", "sum")).reset_index()
    got = P.daily_counts(pitches).select("pitcher", "game_date", "whiffs", "swings", "fb_count", F.round("fb_velo_sum", 6))
    assert rows(got) == sorted(((r.pitcher, r.game_date, float(r.whiffs), float(r.swings), float(r.fb_count), round(float(r.v), 6)) for r in want.itertuples()), key=str)


def test_pitching_points(spark):
    cols = "innings_pitched double, strikeouts_gl int, wins int, earned_runs int, hits_allowed int, walks_allowed int, hit_batsmen int, complete_games int, shutouts int, no_hitters int"
    df = spark.createDataFrame([(6 + 1 / 3, 7, 1, 2, 5, 1, 1, 0, 0, 0), (9.0, 10, 1, 0, 0, 0, 0, 1, 1, 0), (9.0, 10, 1, 0, 0, 0, 0, 1, 1, 1)], cols)
    got = [r["points_game"] for r in P.score_pitching(df).collect()]
    assert got == pytest.approx([19 * 0.75 + 14 + 4 - 4 - 0.6 * 7, 20.25 + 20 + 4 + 5 + 5, 20.25 + 20 + 4 + 5 + 5])


def test_prior_only_features_do_not_leak(spark):
    def series(last_runs):
        data = [("A", g, D0 + dt.timedelta(days=g), float(g % 5)) for g in range(40)] + [("A", 40, D0 + dt.timedelta(days=40), last_runs)]
        data += [("B", g, d, 3.0) for _, g, d, _ in data]
        return spark.createDataFrame(data, "team string, game_pk long, game_date date, runs_scored double")

    pick = lambda df: [r for r in rows(B.team_form(df), "team", "game_pk", "team_runs_per_game_30d", "opp_runs_allowed_30d") if r[1] == 40]
    assert pick(series(0.0)) == pick(series(50.0))

    def outings(ip):
        data = [(1, g, D0 + dt.timedelta(days=g), 5.0 if g < 9 else ip) for g in range(10)]
        return spark.createDataFrame(data, "pitcher long, game_pk long, game_date date, innings_pitched double")

    last = lambda ip: [r["ip_per_appearance_7d"] for r in P.innings_features(outings(ip)).collect() if r["game_pk"] == 9]
    assert last(1.0) == last(9.0) == [5.0]
    first = [r["ip_per_appearance_7d"] for r in P.innings_features(outings(1.0)).collect() if r["game_pk"] == 0]
    assert first == [0.0]


def test_exclude_current_does_not_leak(pitches):
    a = rows(B.batter_rolling(fr.terminal_only(pitches), exclude_current=True), "at_bat_number", "hard_hit_7d")
    changed = pitches.withColumn("launch_speed", F.when(F.col("at_bat_number") == 255, 120.0).otherwise(F.col("launch_speed")))
    z = rows(B.batter_rolling(fr.terminal_only(changed), exclude_current=True), "at_bat_number", "hard_hit_7d")
    pick = lambda r: [x for x in r if x[0] == 255]
    assert pick(a) == pick(z)


def test_team_aware_starter(spark):
    games = spark.createDataFrame([(1, "A", 10, 6.0, 0.3), (1, "B", 11, 7.0, 0.1), (1, "B", 12, 2.0, 0.9)], "game_pk long, team string, pitcher long, innings_pitched double, k_rate_14d double")
    games = games.withColumns({c: F.lit(1.0) for c in ("era_approx_14d", "whiff_rate_14d", "velo_mean_14d")}).withColumn("game_date", F.lit(D0))
    df = spark.createDataFrame([(1, "A", "B"), (1, "B", "A"), (2, "A", "B")], "game_pk long, own string, opponent string")
    assert rows(B.opposing_starter(df, games), "own", "opp_k_rate_14d") == [("A", 0.1), ("A", 0.22), ("B", 0.1)]
    assert rows(B.opposing_starter(df, games, by_team=True), "own", "opp_k_rate_14d") == [("A", 0.1), ("A", 0.22), ("B", 0.3)]


def test_row_order_and_partitions_do_not_matter(spark, pitches):
    logs = spark.createDataFrame([(b, D0 + dt.timedelta(days=d), 1000 + d, d % 3, 1, 0) for b in (1, 2) for d in range(20)], "batter long, game_date date, game_pk long, runs int, rbi int, stolen_bases int")
    orders = spark.createDataFrame([(1000 + d, "T1" if b == 1 else "T2", b, b, D0 + dt.timedelta(days=d)) for b in (1, 2) for d in range(20)], "game_pk long, team string, mlbam_id long, batting_order int, game_date date")
    cols = ["batter", "game_date", *S.batter_feature_columns(), "points_game"]
    run = lambda p: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(B.batter_feature_matrix(p, logs, orders), *cols)]
    a = run(pitches)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run(pitches.orderBy(F.rand(1))) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(a) == len({(r[0], r[1]) for r in a})


def test_rows_without_a_player_are_left_out(pitches):
    holes = pitches.withColumn("batter", F.when(F.col("at_bat_number") % 7 != 0, F.col("batter")))
    rolled = B.batter_rolling(B.terminal_only(holes))
    assert rolled.count() and not rolled.where("batter is null").count()
    games = B.to_game_level(B.score_events(B.terminal_only(holes)))
    assert games.count() and not games.where("batter is null").count()
