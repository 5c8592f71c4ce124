import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from rosterlab.operators import batter as B
from rosterlab.operators import ordered as O
from rosterlab.operators import ownership as OW
from rosterlab.operators import pitcher as P
from rosterlab.operators import report as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    k = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 11 + 2)
    df = spark.range(900).select(k.cast("long").alias("k"), (F.xxhash64("id") % 50).alias("v"), "id")
    return df.withColumn("v", F.when(F.col("id") % 17 == 0, None).otherwise(F.col("v"))).repartition(5).cache()


def test_prefix_sums_both_routes(skewed, split, spark):
    by = lambda: rows(O.prefix_sums(skewed, ["k"], [F.col("v").desc_nulls_last(), F.col("id")], F.col("id"), out="s", total="t"), "k", "id", "s", "t")
    forced = by()
    spark.conf.set("rosterlab.groupBytes", str(1 << 40))
    assert forced == by()


def test_global_positions_split(skewed, split):
    got = O.prefix_sums(skewed, [], [F.col("v"), F.col("id")], out="p", total="n")
    want = skewed.withColumn("p", F.row_number().over(Window.orderBy("v", "id"))).withColumn("n", F.lit(900))
    assert rows(got, "id", "p", "n") == rows(want, "id", "p", "n")


@pytest.mark.parametrize("exclude", [False, True])
def test_rolling_means_split(skewed, split, spark, exclude):
    run = lambda: rows(B.rolling_means(skewed, {"v": "v"}, "k", ["v", "id"], (7, 30), exclude).select("id", F.round("v_7d", 9), F.round("v_30d", 9)))
    forced = run()
    spark.conf.set("rosterlab.groupBytes", str(1 << 40))
    assert forced == run()


def test_quantiles_split(skewed, split):
    got = O.exact_quantiles(skewed.withColumn("v", F.col("v").cast("double")), "v", {"a": 0.15, "b": 0.5, "c": 0.999}, ["k"])
    want = skewed.groupBy("k").agg(F.expr("percentile(v, array(0.15, 0.5, 0.999))").alias("q")).select("k", *[F.round(F.col("q")[i], 9) for i in range(3)])
    assert rows(got.select("k", *[F.round(c, 9) for c in "abc"])) == rows(want)


def logs(spark, n=400):
    rng = random.Random(3)
    data = [(1 if i % 3 == 0 else rng.randint(2, 6), i, f"2026-0{1 + i // 100}-{1 + i // 5 % 20:02d}", float(rng.randint(0, 9)), rng.randint(0, 4)) for i in range(n)]
    df = spark.createDataFrame(data, "pitcher long, game_pk long, game_date string, innings_pitched double, earned_runs int")
    return df.withColumn("game_date", F.col("game_date").cast("date"))


def test_pitcher_features_split(spark, split):
    run = lambda: rows(P.era_features(P.innings_features(logs(spark))).drop("game_date").select("pitcher", "game_pk", *[F.round(c, 9) for c in ("ip_per_start_7d", "ip_per_appearance_30d", "era_approx_30d", "is_starter")]))
    forced = run()
    spark.conf.set("rosterlab.groupBytes", str(1 << 40))
    assert forced == run()


def test_team_form_split(spark, split):
    games = logs(spark).select(F.concat(F.lit("T"), "pitcher").alias("team"), (F.col("game_pk") / 2).cast("long").alias("game_pk"), "game_date", F.col("innings_pitched").alias("runs_scored"))
    games = games.groupBy("team", "game_pk").agg(F.min("game_date").alias("game_date"), F.sum("runs_scored").alias("runs_scored"))
    run = lambda: rows(B.team_form(games).select("team", "game_pk", F.round("team_runs_per_game_30d", 9), F.round("opp_runs_allowed_30d", 9)))
    forced = run()
    spark.conf.set("rosterlab.groupBytes", str(1 << 40))
    assert forced == run()


def test_pool_ranks_split(skewed, split, spark):
    pool = skewed.select(F.lit("S").alias("slate_id"), F.col("id").alias("player_id"), F.lit("OF").alias("position"), (F.col("id") * 7 % 41 + 1).alias("salary"), F.col("v").alias("pts_q50"),
                         F.lit("T").alias("team"), F.lit(False).alias("is_pitcher"), F.lit(5.0).alias("team_total"))
    run = lambda: (rows(OW.salary_rank(pool), "player_id", "salary_rank"), rows(OW.stack_multiplier(pool), "player_id", "stack_multiplier"), rows(R.percentile_bands(pool), "player_id", "top_share", "band"),
                   rows(OW.recency(pool), "player_id", "recency"), rows(OW.value_zscore(pool).select("player_id", F.round("value_zscore", 9))))
    forced = run()
    spark.conf.set("rosterlab.groupBytes", str(1 << 40))
    assert forced == run()


def test_group_stats_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    assert rows(O.with_group_stats(df, ["g"], {"m": F.avg("x")})) == [("a", 5.0, 5.0), (None, 1.0, 2.0), (None, 3.0, 2.0)]
    assert {r["m"] for r in O.with_group_stats(df, [], {"m": F.avg("x")}).collect()} == {3.0}


def test_team_form_of_a_large_team_writes_its_games_once(spark, split, monkeypatch):
    """Both series come from one written table; games without an opponent lie in long runs, over several parts."""
    at = [(team, day * 7 + i) for team, every in (("A", 1), ("B", 60), (None, 9)) for day in range(60) for i in range(7) if (day * 7 + i) % every == 0]
    games = spark.createDataFrame([(t, g, f"2026-01-{1 + g // 14:02d}", float(g * g % 11)) for t, g in at], "team string, game_pk long, game_date string, runs_scored double")
    written = []
    monkeypatch.setattr(O, "stored", lambda df, label="rows", keep=O.stored: written.append(label) or keep(df, label))
    run = lambda: rows(B.team_form(games).select("team", "game_pk", F.round("team_runs_per_game_30d", 9), F.round("opp_runs_allowed_30d", 9)))
    forced = run()
    assert written == ["rows", "rows", "last"]  # the games, their parts and the rows before the parts
    spark.conf.set("rosterlab.groupBytes", str(1 << 40))
    assert forced == run()
