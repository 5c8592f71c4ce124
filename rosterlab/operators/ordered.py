"""Ordered operators that survive a hot key.

A window function sends every row of its partition key to one task. That is
fine for keys of ordinary size and the plan used whenever the input cannot
hold an oversized key. When it can, the keys are counted (one pruned scan with
map-side combine) and only the oversized ones take the second route: their rows
are range-partitioned on the order columns, the partition boundaries are
fixed by a checkpoint, and per-partition totals give each row its exact place.
Results are identical on both routes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, stored

# Below this many bytes of input no key can be too large for one task.
GROUP_BYTES = ("rosterlab.groupBytes", 256 * 1024 * 1024)
# A key with more rows than this is split; also the size of the pieces.
GROUP_ROWS = ("rosterlab.groupRows", 2_000_000)


def _setting(df: DataFrame, entry) -> int:
    return int(df.sparkSession.conf.get(entry[0], str(entry[1])))


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of everything a frame scans, from Catalyst's statistics; runs no job.

    Estimates of joins multiply their sides and say little about the key lookups used here.
    The scanned bytes bound the rows as long as nothing was exploded, which holds for all callers.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def may_hold_large_group(df: DataFrame) -> bool:
    return estimated_bytes(df) > _setting(df, GROUP_BYTES)


def split_large_groups(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of oversized keys or None)."""
    return _split(df, list(keys)) if may_hold_large_group(df) else (df, None)


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in names]


def _split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    if not keys:
        return df.limit(0), df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = checkpointed(sizes.filter(F.col("_n") > _setting(df, GROUP_ROWS)).select(*keys))
    if large.isEmpty():
        return df, None
    return df.join(large, _same(df, large, keys), "left_anti"), df.join(large, _same(df, large, keys), "left_semi")


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Range-partition on (keys, order) and keep the boundaries on reliable storage."""
    rows = df.count()
    parts = max(2, -(-rows // _setting(df, GROUP_ROWS)))
    by = [F.col(k) for k in keys] + list(order)
    return keep(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))


def _placed(df, keys, order, weight, out, total) -> DataFrame:
    """Prefix sums over range partitions: the part's offset plus the sum inside the part."""
    ranged = _ranged(df, keys, order)
    sizes = ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_here"))
    every = Window.partitionBy(*keys)
    sizes = sizes.select(
        *keys, "_part",
        F.coalesce(
            F.sum("_here").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_here").over(every).alias("_all"),
    )
    on = [ranged[k].eqNullSafe(sizes[k]) for k in [*keys, "_part"]]
    joined = ranged.join(sizes, on).drop(*[sizes[k] for k in [*keys, "_part"]])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn(out, F.col("_before") + F.sum(weight).over(inside))
    if total:
        joined = joined.withColumn(total, F.col("_all"))
    return joined.drop("_part", "_before", "_all")


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column | None = None,
    out: str = "pos", total: str | None = None,
) -> DataFrame:
    """Running total of ``weight`` (1 = the row number) per key; ``order`` must be total.

    ``total`` names an extra column with the sum over the whole key.
    """
    keys, order = list(keys), list(order)
    weight = F.lit(1) if weight is None else weight

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        cols = [F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias(out)]
        if total:
            cols.append(F.sum(weight).over(w).alias(total))
        return part.select("*", *cols)

    ordinary, large = split_large_groups(df, keys)
    if large is None:
        return plain(ordinary)
    placed = _placed(large, keys, order, weight, out, total)
    return placed if not keys else plain(ordinary).unionByName(placed)


def trailing(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], lookback: int,
    build: Callable[[DataFrame, list[str]], DataFrame], within: Sequence[str] = (), store: bool = False,
) -> DataFrame:
    """Run ``build(rows, partition_columns)`` where its frames reach back at most ``lookback`` rows.

    An oversized key is cut into range partitions of consecutive rows; each also gets the ``lookback`` rows
    before it, which are dropped again afterwards. ``order`` are plain ascending columns. ``within`` are columns that
    ``build`` adds to the partition columns for some of its frames. ``store`` writes the rows once before their keys
    are counted, for frames that cost more to compute than to read again.
    """
    keys, order = list(keys), list(order)
    if not may_hold_large_group(df):
        return build(df, keys)
    df = stored(df) if store else df
    ordinary, large = _split(df, keys)
    if large is None:
        return build(df, keys)
    ranged = _ranged(large, keys, order, stored)
    before = _reached(ranged, keys, order, lookback, list(within))
    blocks = ranged.withColumn("_own", F.lit(True)).unionByName(before.withColumn("_own", F.lit(False)))
    done = build(blocks, [*keys, "_part"]).filter("_own").drop("_own", "_part")
    return done if not keys else build(ordinary, keys).unionByName(done)


def _reached(ranged: DataFrame, keys: list[str], order: list[Column], lookback: int, within: list[str]) -> DataFrame:
    """The last ``lookback`` rows before each part of a key, of each value of ``within``; ``_part`` is the part they are for.

    They are among the last rows of all parts, which are few and are numbered; a part needs those up to the
    number that the parts before it have.
    """
    groups = [*keys, *within]
    last = stored(top_rows(ranged, [*groups, "_part"], [c.desc_nulls_last() for c in order], lookback), "last")
    named = lambda df, names, to: df.select(*[F.col(k).alias(f"{to}{i}") for i, k in enumerate(names)])
    meet = lambda left, right, n: [F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}")) for i in range(n)] or F.lit(True)
    values, parts = named(last, groups, "_v").distinct(), named(last, [*keys, "_part"], "_p").distinct()
    every = values.join(parts, meet("_v", "_p", len(keys))).withColumnRenamed(f"_p{len(keys)}", f"_v{len(groups)}")
    counts = named(last, [*groups, "_part"], "_c").groupBy(*[f"_c{i}" for i in range(len(groups) + 1)]).agg(F.count(F.lit(1)).alias("_n"))
    every = every.join(counts, meet("_v", "_c", len(groups) + 1), "left")
    group = [f"_v{i}" for i in range(len(groups))]
    ahead = Window.partitionBy(*group).orderBy(f"_v{len(groups)}").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_upto", F.sum("_n").over(ahead)).filter(F.col("_upto") > 0)
    places = F.sequence(F.greatest(F.lit(1), F.col("_upto") - lookback + 1), F.col("_upto"))
    needed = every.select(*group, F.col(f"_v{len(groups)}").alias("_for"), F.explode(places).alias("_at"))
    numbered = last.withColumn("_row", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(groups, group)]
    met = numbered.join(needed, [*same, F.col("_row") == F.col("_at")])
    return met.select(*[F.col("_for").alias(c) if c == "_part" else F.col(c) for c in ranged.columns])


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Attach aggregates of a group to its rows.

    Inputs too small to hold an oversized group use one unordered window. Otherwise the
    rows are written once, aggregated with map-side combine, and the aggregates joined back,
    so that no group has to fit one task.
    """
    keys = list(keys)
    named = [c.alias(n) for n, c in stats.items()]
    if not keys:  # one row: a scalar subquery, evaluated once
        one = df.agg(*named).select(F.struct(*stats).alias("_s")).scalar()
        return df.withColumn("_s", one).select("*", "_s.*").drop("_s")
    if not may_hold_large_group(df):
        w = Window.partitionBy(*keys)
        return df.select("*", *[c.over(w).alias(n) for n, c in stats.items()])
    df = checkpointed(df)
    renamed = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*named)
    on = [df[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(renamed, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each key before the shuffle (window group limit)."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (``drop_duplicates(keep="first")`` with a stated order)."""
    return top_rows(df, keys, order, 1)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles per key, without holding a group's values in one task.

    Values are counted first, then running totals locate the two order statistics each
    quantile needs.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = prefix_sums(counted, keys, [F.col(value).asc()], F.col("_c"), out="_hi", total="_n")
    v, lo, hi = F.col(value), F.col("_hi") - F.col("_c"), F.col("_hi")
    out = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        below = F.floor(at)
        frac = at - below
        left = F.max(F.when((lo <= below) & (below < hi), v))
        right = F.max(F.when((lo <= F.ceil(at)) & (F.ceil(at) < hi), v))
        share = F.max(frac)
        out.append((left + (right - left) * share).alias(name))
    return placed.groupBy(*keys).agg(*out)
