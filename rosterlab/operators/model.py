"""Quantile models: three boosted quantiles fitted on Spark, stored as a table of nodes, with additive attributions."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_dir, shared_dir, stored
from .boosting import NODES, Forest, Settings, coded, fit_spread, fit_task, part
from .evaluate import monotone
from .frames import features
from .ordered import prefix_sums

LOW, MEDIAN, HIGH = 0.15, 0.5, 0.85
NAMES = ["q15", "q50", "q85"]
#: Rows up to which a quantile is fitted in one task. More rows are spread over parts of at most about ``PART_ROWS``; the model is the same.
TASK_ROWS, PART_ROWS = 100_000, 500_000
#: Bins of a feature in the histograms.
BINS = 256


@dataclass
class QuantileModel:
    columns: list[str]
    depth: int
    path: str
    forests: list[Forest] = field(default_factory=list)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Aligned features to q15, q50, q85 in order."""
        extra = [c for c in keep if c not in self.columns]
        rows = features(df, self.columns, keep=extra)
        shared, names, n = df.sparkSession.sparkContext.broadcast(self.forests), self.columns, len(NAMES)

        def run(batches):
            for b in batches:
                x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names])
                found = [pa.array(f.predict(x)) for f in shared.value]
                yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, *NAMES[:n]])

        out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in NAMES]]))
        return monotone(out).select(*keep, *NAMES)

    def attribute(self, df: DataFrame, keep: Sequence[str] = (), quantile: str = "q50") -> DataFrame:
        """One row a row of ``df``: ``keep``, ``base``, ``prediction`` of the quantile before triples are put in order, and ``shares``,
        an array in the order of the columns that sums up to ``prediction - base``."""
        extra = [c for c in keep if c not in self.columns]
        rows = features(df, self.columns, keep=extra)
        shared, names = df.sparkSession.sparkContext.broadcast(self.forests[NAMES.index(quantile)]), self.columns

        def run(batches):
            f = shared.value
            for b in batches:
                x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names])
                predicted, shares = f.explain(x)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(shares.ravel()), len(names)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(np.full(len(x), f.mean())), pa.array(predicted), flat], names=[*b.schema.names, "base", "prediction", "shares"]
                )

        more = [T.StructField("base", T.DoubleType()), T.StructField("prediction", T.DoubleType()), T.StructField("shares", T.ArrayType(T.DoubleType()))]
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more])).select(*keep, "base", "prediction", "shares")

    def importance(self, df: DataFrame, quantile: str = "q50") -> DataFrame:
        """(feature, importance): mean absolute attribution over the rows of ``df``, one row per model input."""
        shares = self.attribute(df, quantile=quantile)
        means = shares.agg(*[F.avg(F.abs(F.get("shares", F.lit(i)))).alias(f"m{i}") for i in range(len(self.columns))])
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(f"m{i}", F.lit(0.0)).alias("importance")) for i, c in enumerate(self.columns)])
        return means.select(F.inline(pairs))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.read.schema(NODES).parquet(f"{self.path}/nodes").write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"columns": self.columns, "depth": self.depth})
        spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> QuantileModel:
        meta = json.loads(SparkSession.active().read.text(f"{path}/meta").first()["value"])
        return _opened(path, meta["columns"], meta["depth"])


def _opened(path: str, columns: list[str], depth: int) -> QuantileModel:
    rows = SparkSession.active().read.schema(NODES).parquet(f"{path}/nodes").collect()  # trees x 2^depth rows, whatever the data
    forests = [Forest([tuple(r)[1:] for r in rows if r["model"] == m], depth, len(columns)) for m in range(len(NAMES))]
    return QuantileModel(columns, depth, path, forests)


def train_quantiles(
    train: DataFrame, columns: Sequence[str], label: str, trees: int = 500, depth: int = 6, step: float = 0.05,
    fit_rows: int | None = None, bins: int = BINS, seed: int = 42, path: str | None = None,
) -> QuantileModel:
    """Fit on ``train`` and store the model below ``path``; missing features and labels count as 0.

    All rows are fitted, unless the caller asks for about ``fit_rows`` of them, taken by a hash of their content. Features have up to
    ``bins`` bins by exact quantiles of the fitted rows. Up to ``TASK_ROWS`` rows each quantile is one task; more rows are counted by
    Spark jobs over parts of bounded size, so memory does not follow the table.
    """
    spark, columns = train.sparkSession, list(columns)
    rows = train.withColumn("_label", F.coalesce(F.col(label).cast("double"), F.lit(0.0)))
    rows = features(rows, columns, keep=["_label"])
    rows = rows.select(F.xxhash64("_label", *columns, F.lit(seed)).alias("_hash"), "_label", *columns)
    total = rows.count()
    if fit_rows is not None and total > fit_rows:
        rows = rows.filter(F.pmod("_hash", F.lit(1 << 30)) < int(fit_rows / total * (1 << 30)))
    held = new_dir(spark, "fit-rows")
    rows.write.parquet(held)
    rows = spark.read.schema(rows.schema).parquet(held)
    total = rows.count()
    shares = [i / bins for i in range(1, bins)]
    settings = Settings((LOW, MEDIAN, HIGH), trees, depth, step, seed=seed)
    path = path or new_dir(spark, "quantile-model")
    if total > TASK_ROWS:
        cuts = [np.unique(v) for v in _percentiles(rows, columns, total, shares)]
        nodes = spark.createDataFrame(_spread(rows, cuts, total, settings), NODES)
    else:
        found = rows.agg(*[F.percentile(c, shares).alias(c) for c in columns]).first() if columns else {}
        cuts = [np.unique(np.array(found[c] or [], dtype=np.float64)) for c in columns]
        each = rows.select(F.explode(F.array(*map(F.lit, range(len(NAMES))))).alias("model"), *rows.columns).repartitionByRange(len(NAMES), "model")
        nodes = each.mapInArrow(lambda batches: fit_task(batches, cuts, settings), NODES)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    return _opened(path, columns, depth)


def _percentiles(rows: DataFrame, columns: list[str], total: int, shares: list[float]) -> list[np.ndarray]:
    """``F.percentile`` of the columns at ``shares``, from counts of their values, so that no task holds all values of a column."""
    if not columns:
        return []
    values = rows.select(F.posexplode(F.array(*columns)).alias("column", "value")).groupBy("column", "value").agg(F.count("*").alias("n"))
    places = prefix_sums(stored(values, "fit-values"), ["column"], [F.col("value").asc()], F.col("n"), out="upto")
    at = [(total - 1) * share for share in shares]
    needed = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
    hits = places.where(F.exists(F.array(*map(F.lit, needed)), lambda x: (x < F.col("upto")) & (x >= F.col("upto") - F.col("n"))))
    found = {}
    for r in hits.collect():  # at most two values a share and column
        found |= {(r["column"], x): r["value"] for x in needed if r["upto"] - r["n"] <= x < r["upto"]}

    def between(column: int, x: float) -> float:
        low, high = math.floor(x), math.ceil(x)
        a, b = found[column, low], found[column, high]
        return a if a == b else (high - x) * a + (x - low) * b

    return [np.array([between(i, x) for x in at]) for i in range(len(columns))]


def _spread(rows: DataFrame, cuts: list[np.ndarray], total: int, settings: Settings) -> list[tuple]:
    """Nodes of the models of a large table ``(_hash, _label, features...)``."""
    spark = rows.sparkSession
    codes = rows.mapInArrow(lambda batches: coded(batches, cuts), "code binary, hash long, label double")
    # equal rows may lie in several parts, so none is larger than the others
    by = ["code", "hash", F.monotonically_increasing_id()]
    few = min(spark.sparkContext.defaultParallelism, 10 * total // PART_ROWS)
    codes = codes.repartitionByRange(max(2, few, -(-total // PART_ROWS)), *by).sortWithinPartitions("code", "label")
    parts = stored(codes.mapInArrow(part, "hashes binary, labels binary, starts binary, codes binary"), "fit-parts")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))

    def delete(path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return fit_spread(parts, cuts, settings, delete)


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)
