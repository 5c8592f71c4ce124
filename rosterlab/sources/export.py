"""Lineup export in the upload layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.lineup import wide_lineups


def lineup_lines(lineups: DataFrame, columns: Sequence[str] = S.LINEUP_SLOTS) -> DataFrame:
    """CSV lines (slate_id, place, line): the header at place 0, then the lineups by id.

    The header repeats column names (P, P, …, OF, OF, OF), which a frame cannot, so it is a line of its own.
    """
    slates = lineups.select("slate_id", "lineup_id").distinct()
    wide = wide_lineups(lineups, columns)
    cells = [c for c in wide.columns if c != "lineup_id"]
    body = wide.select("lineup_id", F.to_csv(F.struct(*cells), {"emptyValue": ""}).alias("line")).join(slates, "lineup_id")
    head = slates.select("slate_id").distinct().select("slate_id", F.lit(None).cast("long").alias("lineup_id"), F.lit(",".join(columns)).alias("line"))
    both = head.unionByName(body.select("slate_id", F.col("lineup_id").cast("long").alias("lineup_id"), "line"))
    return both.withColumn("place", F.when(F.col("lineup_id").isNull(), 0).otherwise(1))


def write_lineup_csv(lineups: DataFrame, path: str, columns: Sequence[str] = S.LINEUP_SLOTS) -> None:
    """One text file per slate below ``path``, header first; slates are written in parallel."""
    lines = lineup_lines(lineups, columns).repartition("slate_id").sortWithinPartitions("slate_id", "place", "lineup_id")
    lines.select("slate_id", "line").write.mode("overwrite").partitionBy("slate_id").text(path)
