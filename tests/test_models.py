"""Quantile boosting: leaf quantiles, determinism, stored models and additive attributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlab.operators import boosting as B
from rosterlab.operators import evaluate as E
from rosterlab.operators import model as M

from conftest import rows


def data(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    x = [rng.integers(0, 20, n).astype(float), rng.normal(size=n), np.zeros(n)]
    return rng.integers(0, 1 << 63, n).astype(np.uint64), x[0] * 3 + np.abs(x[1]) * rng.exponential(2, n), x


CUTS = [np.arange(19.0), np.linspace(-2, 2, 60), np.array([])]


def test_leaf_quantiles_equal_sorted_ranks():
    rng = np.random.default_rng(2)
    leaf = rng.integers(0, 7, 3000).astype(np.int32)
    leaf[leaf == 3] = 2  # an empty leaf
    r = rng.normal(size=3000) * 100
    r[leaf == 5] = 4.5
    for level in (0.15, 0.5, 0.85, 1.0):
        value, rows_ = B.quantiles(r, leaf, 7, level)
        for k in range(7):
            own = np.sort(r[leaf == k])
            assert rows_[k] == len(own)
            if len(own):
                want = own[max(0, int(np.ceil(level * len(own))) - 1)]
                assert abs(value[k] - want) <= (own[-1] - own[0]) / 2**23
    assert value[3] == 0 and value[5] == 4.5


def test_fit_does_not_depend_on_the_order_of_rows():
    h, y, x = data()
    s = B.Settings((0.5,), trees=15, depth=4, step=0.2)
    order = np.random.default_rng(3).permutation(len(y))
    one = B.fit_level(h, y, x, CUTS, 0.5, s)
    assert sorted(one) == sorted(B.fit_level(h[order], y[order], [v[order] for v in x], CUTS, 0.5, s))
    assert {r[2] for r in one} == {-1, 0, 1}  # a constant feature is never split
    assert all(r[5] >= 1 for r in one if r[2] < 0)


@pytest.mark.parametrize("level", [0.15, 0.5, 0.85])
def test_forest_covers_its_quantile_and_adds_up(level):
    h, y, x = data()
    wide = np.column_stack(x)
    f = B.Forest(B.fit_level(h, y, x, CUTS, level, B.Settings((level,), trees=120, depth=4, step=0.1)), 4, 3)
    p = f.predict(wide)
    loss = lambda q: np.mean(np.maximum(level * (y - q), (level - 1) * (y - q)))
    assert abs(np.mean(y < p) - level) < 0.03 and loss(p) < 0.6 * loss(np.full(len(y), np.quantile(y, level)))
    shares = f.attribute(wide)
    assert np.allclose(shares.sum(axis=1) + f.mean(), p) and not shares[:, 2].any()
    assert np.abs(shares[:, 0]).mean() > np.abs(shares[:, 1]).mean()
    # row by row along the path
    for i in range(20):
        want = np.zeros(3)
        for t in range(len(f.feature)):
            at = 0
            while f.feature[t, at] >= 0:
                k = f.feature[t, at]
                child = 2 * at + 1 + int(wide[i, k] > f.cut[t, at])
                want[k] += f.value[t, child] - f.value[t, at]
                at = child
        assert np.allclose(want, shares[i])


def test_fit_takes_a_bounded_sample_and_odd_tables(spark):
    df = spark.range(6000).select((F.col("id") % 10).cast("double").alias("a"), (F.hash("id") % 5).cast("double").alias("noise"))
    df = df.withColumn("y", F.col("a") * 3 + F.col("noise"))
    m = M.train_quantiles(df, ["a", "b"], "y", trees=30, depth=3, step=0.3, fit_rows=1500)
    fitted = m.forests[1]
    assert 1000 < sum(r["cover"] for r in spark.read.parquet(f"{m.path}/nodes").where("model = 1 and tree = -1").collect()) < 2000
    p = m.predict(df.repartition(3), keep=["y"])
    cover = E.calibration(p, "y").first()
    assert p.where("q15 > q50 or q85 < q50").count() == 0 and 0.02 < cover["q15_coverage"] < 0.3 and 0.7 < cover["q85_coverage"] < 0.98
    assert len(fitted.feature) == 30 and (fitted.feature < 1).all()  # the missing column b is never split
    again = M.train_quantiles(df.repartition(7), ["a", "b"], "y", trees=30, depth=3, step=0.3, fit_rows=1500)
    assert rows(again.predict(df, keep=["y"])) == rows(p)
    nulls = spark.createDataFrame([(None, None, None), (float("nan"), 1.0, 2.0)], "a double, b double, y double")
    assert m.predict(nulls).count() == 2 and m.predict(df.limit(0)).count() == 0
    assert M.train_quantiles(df.limit(0), ["a"], "y", trees=2).predict(df.limit(3)).count() == 3


def nodes(spark, m):
    return sorted(rows(spark.read.parquet(f"{m.path}/nodes")))


@pytest.mark.parametrize("held", [1 << 17, 0])
def test_a_fit_over_parts_takes_all_rows_and_gives_the_model_of_one_task(spark, monkeypatch, held):
    """Bit for bit, whether cells are counted on the driver or level by level on Spark; also cells of one row and equal rows."""
    n = F.col("id")
    df = spark.range(3000).select((n % 10).cast("double").alias("a"), F.when(n % 3 == 0, F.rand(5)).otherwise(F.lit(None)).alias("b"), (F.hash("id") % 50 / 7).alias("noise"))
    df = df.withColumn("y", F.when(F.col("a") == 7, F.lit(None)).otherwise(F.col("a") * 3 + F.coalesce("b", F.lit(0.0)) + F.col("noise"))).drop("noise")
    df = spark.createDataFrame(df.union(df.limit(400)).collect(), df.schema)
    fit = lambda frame, **more: M.train_quantiles(frame, ["a", "b", "c"], "y", trees=5, depth=4, step=0.3, **more)
    want = nodes(spark, fit(df))
    monkeypatch.setattr(M, "TASK_ROWS", 500)
    monkeypatch.setattr(M, "PART_ROWS", 900)
    monkeypatch.setattr(B, "_HELD", held)
    monkeypatch.setattr(B, "_CUT", 2)
    monkeypatch.setattr(B, "fit_task", None)
    m = fit(df.repartition(5))
    assert nodes(spark, m) == want and len(m.forests[1].feature) == 5
    assert {r["cover"] for r in spark.read.parquet(f"{m.path}/nodes").where("tree = -1").collect()} == {3400}
    none = M.train_quantiles(df, [], "y", trees=2)
    assert none.forests[1].base == m.forests[1].base and len(none.forests[1].feature) == 0


def test_a_fit_takes_every_row_of_a_large_table(spark):
    df = spark.range(120_000).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    m = M.train_quantiles(df, ["a"], "y", trees=1, depth=1)
    assert {r["cover"] for r in spark.read.parquet(f"{m.path}/nodes").where("tree = -1").collect()} == {120_000}


def test_percentiles_from_counts_equal_the_aggregate(spark):
    df = spark.range(777).select((F.col("id") % 13 / 3).alias("a"), F.rand(3).alias("b"), F.lit(2.0).alias("c"))
    df = spark.createDataFrame(df.collect(), df.schema)
    shares = [i / 256 for i in range(1, 256)]
    want = df.agg(*[F.percentile(c, shares).alias(c) for c in df.columns]).first()
    assert [list(v) for v in M._percentiles(df, df.columns, 777, shares)] == [list(v) for v in want]
    assert M._percentiles(df, [], 777, shares) == []


@pytest.mark.parametrize("depth", [0, 3, 6, 7])
def test_trees_are_walked_by_masks_bit_for_bit(depth, monkeypatch):
    """Masks end where a walk from node to node ends, also at cuts, NaN and values outside of all cuts; they take a look a table, not one a level."""
    h, y, x = data(1500)
    f = B.Forest(B.fit_level(h, y, x, CUTS, 0.5, B.Settings((0.5,), trees=25, depth=depth, step=0.2)), depth, 3)
    wide = np.column_stack(x)
    wide[:40, 0], wide[40:80, 1], wide[80:90], wide[90:100] = np.nan, CUTS[1][:40], -np.inf, np.inf
    want, shares = np.full(len(wide), f.base), np.zeros(wide.shape)
    for t in range(len(f.feature)):
        at = f.leaves(wide, t)
        want += f.value[t, at]
        shares += f.steps()[t][at]
    if depth <= 6:
        monkeypatch.setattr(B.Forest, "leaves", None)
    assert (f.predict(wide) == want).all()
    predicted, found = f.explain(wide)
    assert (predicted == want).all() and (found == shares).all()
    monkeypatch.setattr(B, "_CELLS", 1)  # a table for each feature
    alone = B.Forest([], depth, 3)
    alone.base, alone.feature, alone.cut, alone.value = f.base, f.feature, f.cut, f.value
    if 0 < depth <= 6:
        assert len(alone.masks()) == 3 and len(f.masks()) < 3
    monkeypatch.undo()
    assert (alone.predict(wide) == want).all()
    assert (B.Forest([], depth, 3).predict(wide) == 0).all()
