import pytest
from pyspark.sql import functions as F

from rosterlab.functions import columns as C
from rosterlab.functions import text as X
from rosterlab.functions.normal import hash_uniform, normal_cdf, normal_inverse
from rosterlab.functions.similarity import _lcs_length, _similarity


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_clip_keeps_null(spark):
    assert one(spark, C.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, C.clip(F.lit(7.0), 0.0, 1.0)) == 1.0


@pytest.mark.parametrize("text,want", [("6.1", 19 / 3), ("7", 7.0), ("0.2", 2 / 3), ("x", 0.0), ("", 0.0), (None, 0.0)])
def test_innings(spark, text, want):
    assert one(spark, C.innings_from_text(F.lit(text).cast("string"))) == pytest.approx(want)


@pytest.mark.parametrize("ip,outs", [(6 + 1 / 3, 19), (0.0, 0), (5.0, 15), (2 / 3, 2), (None, 0)])
def test_outs(spark, ip, outs):
    assert one(spark, C.outs_from_innings(F.lit(ip).cast("double"))) == outs


@pytest.mark.parametrize("text,want", [("10,200", 10200), (" 900 ", 900), ("abc", None), ("1.5", None), ("", None)])
def test_counts(spark, text, want):
    assert one(spark, C.parse_count(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("MLB $1.5M Max", 1.5e6), ("$50K Big", 5e4), ("$25 x", 25.0), ("none", 0.0)])
def test_prizes(spark, text, want):
    assert one(spark, C.prize_value(F.lit(text))) == want


def test_epoch_and_lock(spark):
    assert str(one(spark, C.epoch_millis(F.lit("/Date(1700000000000)/")))).startswith("2023-11-14 22:13:20")
    assert one(spark, C.epoch_millis(F.lit("none"))) is None
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, C.minutes_to_lock(ts("2026-01-01 10:10:30"), ts("2026-01-01 10:00:00"))) == 10
    assert one(spark, C.minutes_to_lock(ts("2026-01-01 09:00:00"), ts("2026-01-01 10:00:00"))) == 0
    assert one(spark, C.minutes_to_lock(F.lit(None).cast("timestamp"), ts("2026-01-01 10:00:00"))) is None
    assert one(spark, C.minutes_to_lock(ts("2026-01-01 10:10:30"), ts("2026-01-01 10:00:00"), F.lit(99))) == 99


@pytest.mark.parametrize("fn,text,want", [
    (X.fold_accents, "José Acuña", "jose acuna"), (X.fold_accents, "Zoë Łuk", "zoe luk"), (X.token_sort, " b  a c ", "a b c"), (X.last_token, "Ann de Vil ", "Vil"), (X.last_token, "", ""),
    (X.first_last, "Vil, Ann, Jr", "Ann, Jr Vil"), (X.first_last, " Ann Vil ", "Ann Vil"), (X.primary_position, "2B/SS", "2B"), (X.primary_position, " ", "UNK"),
    (X.squeeze, " a \t b ", "a b"), (X.slug_name, "/baseball/player/jose-ramirez-123?x=1", "Jose Ramirez"), (X.slug_name, "/team/x", None),
])
def test_text(spark, fn, text, want):
    assert one(spark, fn(F.lit(text))) == want


@pytest.mark.parametrize("text,ok", [
    ("ATL@LAD 05/08/2026 10:10PM ET", True), (" ATL @ LAD 5/8/2026 1:05 PM EST ", True), ("atl@LAD 05/08/2026 10:10PM ET", False), ("ATL@LAD 05/08/2026 10:10PM", False), ("", False),
])
def test_game_info(spark, text, ok):
    assert one(spark, X.game_info(F.lit(text)))["ok"] is ok


def test_similarity():
    assert _lcs_length("kitten", "sitting") == 4 and _similarity("", "") == 100.0 and _similarity("ab", "") == 0.0
    assert _similarity("small ring", "ringx small") == pytest.approx(_similarity("ringx small", "small ring"))
    long = "ab" * 80
    assert _lcs_length(long, "b" + long) == len(long)
    assert _similarity("abcd", "abce") == 75.0 and _similarity(None, "a") is None


def test_normal(spark):
    z = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "z double")
    got = z.select("z", normal_inverse(normal_cdf("z")).alias("back"), normal_cdf("z").alias("p")).collect()
    assert all(abs(r["back"] - r["z"]) < 5e-3 for r in got)
    assert abs([r["p"] for r in got if r["z"] == 1.0][0] - 0.8413447) < 1e-6
    u = spark.range(2000).select(hash_uniform("id", F.lit(3)).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.02 and u[1] > 0 and u[2] < 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from rosterlab.session import shared_dir

    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "/shared")) == "/shared"
