import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rosterlab.operators import slate as SL
from rosterlab.sources import payloads as P


def doc(spark, *objs, **extra):
    df = spark.createDataFrame([(json.dumps(o),) for o in objs], "payload string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def game(total=8.5, spread=-1.5, name="Los Angeles Dodgers", gid="g1"):
    markets = []
    if total is not None:
        markets.append({"key": "totals", "outcomes": [{"name": "Under", "point": 1}, {"name": "Over", "point": total}]})
    if spread is not None:
        markets.append({"key": "spreads", "outcomes": [{"name": name, "point": spread}]})
    markets.append({"key": "h2h", "outcomes": [{"name": name, "price": -140}, {"name": "Atlanta Braves", "price": 120}]})
    return {"id": gid, "home_team": name, "away_team": "Atlanta Braves", "commence_time": "t", "bookmakers": [{"key": "b1", "markets": markets}]}


@pytest.mark.parametrize("total,spread,want", [
    (8.5, -1.5, (5.0, 3.5)), (8.0, None, (4.0, 4.0)), (9.0, 4.0, (4.5, 4.5)), (19.0, 0.0, (9.0, 9.0)), (3.0, 0.0, (2.0, 2.0)),
])
def test_implied_totals(spark, total, spread, want):
    out = P.flatten_odds(doc(spark, [game(total, spread)], fetched_at="now")).collect()
    by = {r["team"]: r for r in out}
    assert (by["LAD"]["implied_total"], by["ATL"]["implied_total"]) == want
    assert by["LAD"]["is_home"] and by["ATL"]["moneyline"] == 120.0 and by["ATL"]["opposing_implied"] == want[0]


def test_odds_without_total_or_books_are_skipped(spark):
    empty = {**game(), "bookmakers": []}
    assert P.flatten_odds(doc(spark, [game(total=None), empty], fetched_at="now")).count() == 0


def test_odds_first_book_or_mean(spark):
    g = game(8.0, 0.0)
    g["bookmakers"].append({"key": "b2", "markets": [{"key": "totals", "outcomes": [{"name": "Over", "point": 10.0}]}]})
    d = doc(spark, [g], fetched_at="now")
    assert {r["implied_total"] for r in SL.team_totals(P.flatten_odds(d)).collect()} == {4.0}
    assert {r["implied_total"] for r in SL.team_totals(P.flatten_odds(d, books="all"), how="mean").collect()} == {4.5}


def test_team_codes(spark):
    names = ["Oakland Athletics", "Athletics", "St. Louis Cardinals", "Seoul Heroes", "", "Arizona Diamondbacks"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.team_code("n").alias("c"))
    assert dict(map(tuple, df.collect())) == dict(zip(names, ["ATH", "ATH", "STL", "SEO", "", "ARI"]))


def test_schedule_lineups(spark):
    d = {"dates": [{"date": "2026-05-08", "games": [
        {"gamePk": 7, "teams": {"home": {"team": {"id": 119}}, "away": {"team": {"id": 999}}},
         "lineups": {"homePlayers": [{"id": 1, "fullName": " A B "}, {"id": None}, {"id": 3, "fullName": "C"}], "awayPlayers": [{"id": 4, "fullName": "D"}]}},
        {"gamePk": 8, "teams": {"home": {"team": {"id": 119}}}},
    ]}]}
    out = rows(P.flatten_schedule_lineups(doc(spark, d)), "game_pk", "team", "mlbam_id", "batting_order", "player_name")
    assert out == [(7, "999", 4, 1, "D"), (7, "LAD", 1, 1, "A B"), (7, "LAD", 3, 3, "C")]


def test_probables(spark):
    side = lambda a, n: {"team": {"abbreviation": a}, **({"probablePitcher": {"fullName": n}} if n else {})}
    d = {"dates": [{"games": [{"teams": {"home": side("AZ", "X Y"), "away": side("OAK", "Z W")}}, {"teams": {"home": side("NYY", None), "away": side("", "Q")}}]}]}
    assert rows(P.flatten_probables(doc(spark, d)), "team", "pitcher_name") == [("ARI", "X Y"), ("ATH", "Z W")]


def test_roster_and_injuries_to_availability(spark):
    person = lambda i, n: {"person": {"id": i, "fullName": n}}
    roster = {"roster": [
        {**person(1, "Ann A"), "status": {"code": "D10", "description": "Injured 10-Day"}}, {**person(2, "Bob B"), "status": {"code": "A"}},
        {**person(3, "Cy C"), "status": "dtd"}, {**person(4, "Di D"), "status": {"code": "D180"}}, {"person": {}, "status": "D7"}, {**person(6, "Ed E"), "status": {"code": "DX"}},
    ]}
    inj = {"injuries": [{"playerId": 3, "status": "OUT", "description": "knee"}, {"id": 2, "injuryStatus": {"code": "DTD"}, "note": "rest"}, {"id": 1, "status": "OUT", "note": "x"}, {"status": "OUT"}]}
    r, i = P.flatten_roster_status(doc(spark, roster)), P.flatten_injuries(doc(spark, inj))
    assert rows(r, "player_id", "name_key", "code") == [(1, "ann a", "D10"), (2, "bob b", "A"), (3, "cy c", "DTD"), (4, "di d", "D180"), (6, "ed e", "DX")]
    got = {t[0]: t[1:] for t in rows(SL.availability(r, i), "player_id", "status", "reason")}
    assert got == {1: ("unavailable", "Injured 10-Day"), 2: ("dtd", "DTD (rest)"), 3: ("unavailable", "DTD — DTD"), 4: ("unavailable", "D180")}
    pool = spark.createDataFrame([("p1", " Ann A "), ("p2", "Nobody"), ("p3", "cy C")], "player_id string, name string")
    assert rows(SL.pool_status(pool, SL.availability(r, i), r), "player_id", "status") == [("p1", "unavailable"), ("p3", "unavailable")]


@pytest.mark.parametrize("payload", [
    {"teams": [{"playerId": 5, "status": "D7"}]}, {"teams": {"injuries": [{"playerId": 5, "status": "D7"}]}}, {"injuries": [], "teams": [{"id": "5", "status": "d7"}]},
])
def test_injury_layouts(spark, payload):
    assert rows(P.flatten_injuries(doc(spark, payload)), "player_id", "code") == [(5, "D7")]


def test_contests(spark):
    base = {"gameType": "Classic", "n": "MLB $50K Big", "a": 5, "m": 6000, "nt": 10, "po": 50000.5, "sd": "/Date(1778278200000)/", "dg": 77}
    d = {"Contests": [base, {**base, "m": 9000, "n": "MLB Huge", "nt": "x"}, {**base, "a": 0}, {**base, "a": 30}, {**base, "m": 100}, {**base, "gameType": "Showdown"}, {**base, "dg": None}, {**base, "n": "NBA"}, {**base, "sd": ""}]}
    flat = P.flatten_contests(doc(spark, d)).withColumn("contest_id", F.monotonically_increasing_id())
    out = SL.qualifying_slates(flat, F.lit("2026-05-08").cast("date")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["group_id"], r["contest_count"], r["max_entries"], r["total_entries"], r["name"]) == (77, 2, 9000, 10, "MLB Huge")
    assert r["lock_time_local"] == "06:10 PM ET"


def test_game_logs(spark):
    split = {"date": "2026-04-01", "game": {"gamePk": 9}, "stat": {"runs": 2, "homeRuns": 1, "inningsPitched": "6.1", "wins": 3, "outs": 19}}
    d = doc(spark, {"stats": [{"splits": [split]}, {"splits": [split, split]}]}, {"stats": []}, batter=1, pitcher=2)
    h = P.flatten_hitting_logs(d).collect()
    assert len(h) == 1 and (h[0]["runs"], h[0]["home_runs"], h[0]["rbi"], h[0]["game_pk"], str(h[0]["game_date"])) == (2, 1, 0, 9, "2026-04-01")
    p = P.flatten_pitching_logs(d).first()
    assert abs(p["innings_pitched"] - 19 / 3) < 1e-12 and p["wins"] == 1 and p["outs_pitched"] == 19 and p["strikeouts"] == 0
