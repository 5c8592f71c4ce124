"""Data-quality operators: the relational constraints as queries that return the offending rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def domain_violations(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per broken rule; as in SQL, a rule with an unknown result is not broken."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(cond), F.lit(name)) for name, cond in rules]))
    return df.withColumn("rule", F.explode(broken))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls, rows) in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col("_rows") - F.col(c)).alias("nulls"), F.col("_rows").alias("rows")) for c in columns
    ]))
    return counts.select(each.alias("_e")).select("_e.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; NULL keys never collide."""
    known = df
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    keys = parent.select(F.col(key).alias("_parent_key"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent_key"), "left_anti")


def broken_constraints(
    df: DataFrame, checks: Sequence[tuple[str, str]] = (), required: Sequence[str] = (), unique: Sequence[Sequence[str]] = (),
    references: Mapping[str, DataFrame] | None = None, key: str = "id",
) -> DataFrame:
    """(constraint_type, rule, violations) of every constraint that some row breaks.

    All checks and not-null rules are counted in one aggregation over the table. A unique key is one aggregation by that key, a
    reference one anti-join with the parents' ``key``, for which Spark may filter the child by a Bloom filter of the parents.
    """
    counts = [(("check", name), F.count_if(~F.expr(cond))) for name, cond in checks]
    counts += [(("not_null", c), F.count_if(F.col(c).isNull())) for c in required]
    total = lambda rows, kind, rule: rows.agg(F.count("*").alias("violations")).select(F.lit(kind).alias("constraint_type"), F.lit(rule).alias("rule"), "violations")
    kinds = [total(duplicate_keys(df, keys), "unique", ",".join(keys)) for keys in unique]
    kinds += [total(orphans(df.select(column), column, parent, key), "reference", column) for column, parent in (references or {}).items()]
    if counts:
        once = df.agg(*[c.alias(f"c{i}") for i, (_, c) in enumerate(counts)])
        rows = [F.struct(F.lit(kind).alias("constraint_type"), F.lit(rule).alias("rule"), F.col(f"c{i}").alias("violations")) for i, ((kind, rule), _) in enumerate(counts)]
        kinds.insert(0, once.select(F.inline(F.array(*rows))))
    if not kinds:
        return df.sparkSession.createDataFrame([], "constraint_type string, rule string, violations long")
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.filter(F.col("violations") > 0)


def check_table(name: str, df: DataFrame, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All constraints of one relational table as (table_name, constraint_type, rule, violations); references to the parents given."""
    known = {c: parents[p] for c, p in S.REFERENCES.get(name, {}).items() if parents and p in parents}
    out = broken_constraints(df, S.CHECKS.get(name, ()), S.REQUIRED.get(name, ()), S.UNIQUE.get(name, ()), known)
    return out.select(F.lit(name).alias("table_name"), "constraint_type", "rule", "violations")
