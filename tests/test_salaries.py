import hashlib

import pytest
from pyspark.errors import AnalysisException

from rosterlab import schemas as S
from rosterlab.operators import slate as SL
from rosterlab.sources.salaries import parse_salaries

HEAD = ",".join(S.SALARY_COLUMNS)
GOOD = [
    'SP,Pat Example (101),Pat Example,101,P,10200,AAA@BBB 05/08/2026 10:10PM ET,BBB,22.21',
    'SP,Lee Sample (102),Lee Sample,102,P,"9,100",CCC@DDD 05/08/2026 07:05PM ET,CCC,',
    '1B/OF,Kim Person (103),Kim Person,103,OF/1B,4500,AAA@BBB 05/08/2026 10:10PM ET,AAA,0',
    'C,Ray Player (104),Ray Player,104,C,3000,CCC@DDD 05/08/2026 07:05PM  ET,DDD,7.5',
]


def write(tmp_path, lines, name="s.csv"):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_classic_file(spark, tmp_path):
    path = write(tmp_path, [HEAD, *GOOD])
    out = parse_salaries(spark, path)
    got = {r["player_id"]: r for r in out.players.collect()}
    assert len(got) == 4 and out.errors.count() == 0
    assert got["103"]["position_eligibility"] == ["OF", "1B"] and got["103"]["position"] == "1B/OF"
    assert got["101"]["is_pitcher"] and not got["104"]["is_pitcher"]
    assert got["102"]["salary"] == 9100 and got["102"]["avg_points_per_game"] == 0.0
    assert got["101"]["avg_points_per_game"] == 22.21 and got["103"]["avg_points_per_game"] == 0.0
    assert (got["101"]["away_team"], got["101"]["home_team"], str(got["101"]["game_date"])) == ("AAA", "BBB", "2026-05-08")
    assert got["104"]["game_time_et"] == "07:05PM ET"
    s = out.summary.first()
    digest = hashlib.sha256((tmp_path / "s.csv").read_bytes()).hexdigest()
    assert (s["raw_row_count"], s["parsed_row_count"], s["file_hash"], s["short_id"]) == (4, 4, digest, digest[:12])


def test_prefixed_file_keeps_line_numbers(spark, tmp_path):
    pre = "," * S.SALARY_PREFIX
    lines = ["P,P,C,1B,2B,3B,SS,OF,OF,OF,,Instructions", "x", pre + HEAD, *[pre + g for g in GOOD], pre + GOOD[0].replace("10200", "abc")]
    out = parse_salaries(spark, write(tmp_path, lines))
    assert sorted((r["player_id"], r["line"]) for r in out.players.collect()) == [("101", 4), ("102", 5), ("103", 6), ("104", 7)]
    e = out.errors.collect()
    assert [(r["row"], r["field"], r["severity"]) for r in e] == [(8, "Salary", "error")]


def test_bad_rows_are_collected(spark, tmp_path):
    bad = [GOOD[0].replace("10200", "lots"), GOOD[3].replace("CCC@DDD 05/08/2026 07:05PM  ET", "tonight"), GOOD[2].replace("OF/1B", "")]
    out = parse_salaries(spark, write(tmp_path, [HEAD, GOOD[1], *bad, GOOD[2].replace(",0", ",n/a"), GOOD[0].replace("05/08", "13/45")]))
    assert {r["player_id"] for r in out.players.collect()} == {"102", "103"}
    got = {(r["row"], r["field"], r["severity"]) for r in out.errors.collect()}
    assert got == {(3, "Salary", "error"), (4, "Game Info", "error"), (5, "Roster Position", "error"), (6, "AvgPointsPerGame", "warning"), (7, "Game Info", "error")}


def test_unknown_header_is_critical_but_parsed(spark, tmp_path):
    out = parse_salaries(spark, write(tmp_path, [HEAD.replace("TeamAbbrev", "Squad"), *GOOD]))
    assert out.players.count() == 4
    e = out.errors.first()
    assert (e["row"], e["field"], e["severity"]) == (1, "header", "critical")


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        parse_salaries(spark, str(tmp_path / "none.csv")).players.count()


def test_slate_summary_and_start(spark, tmp_path):
    p = parse_salaries(spark, write(tmp_path, [HEAD, *GOOD])).players
    s = SL.slate_summary(p).first()
    assert (str(s["slate_date"]), s["player_count"], s["pitcher_count"], s["hitter_count"]) == ("2026-05-08", 4, 2, 2)
    assert s["teams"] == ["AAA", "BBB", "CCC", "DDD"]
    first = SL.slate_start(p).first()
    assert (str(first["game_date"]), first["game_time_et"]) == ("2026-05-08", "07:05PM ET")
