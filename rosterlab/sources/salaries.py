"""Salary files to players and parse errors.

Files are read whole (one row per file, a slate has some hundred lines), because only that
gives exact line numbers; all work after the split into lines is per line. Quoted line
breaks are not supported; the salary export has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import clean, parse_count
from ..functions.text import game_info, split_positions

_WIDTH = S.SALARY_PREFIX + len(S.SALARY_COLUMNS)


@dataclass
class ParsedSalaries:
    players: DataFrame  # path, line and the PLAYERS columns
    errors: DataFrame  # path, row, field, message, severity
    summary: DataFrame  # one row per file: hash, short id, counts


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content, file_hash, short_id); a missing path raises."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    digest = F.sha2("content", 256)
    return files.select("path", "content", digest.alias("file_hash"), F.substring(digest, 1, 12).alias("short_id"))


def _lines(files: DataFrame) -> DataFrame:
    """Non-empty lines with their cells: (path, pos, cells), pos counted from 0."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    rows = files.select("path", F.posexplode(F.split(text, "\r?\n")).alias("pos", "line")).filter(F.trim("line") != "")
    names = [f"c{i}" for i in range(_WIDTH)]
    parsed = F.from_csv("line", ", ".join(f"{n} string" for n in names))
    return rows.select("path", "pos", parsed.alias("r")).select("path", "pos", F.array(*[clean(F.col(f"r.{n}")) for n in names]).alias("cells"))


def _headers(lines: DataFrame) -> DataFrame:
    """Header per file: the first line when it is the classic one, else the first prefixed header in
    the file, else the first line with ``known`` false."""
    names = F.array(*[F.lit(c) for c in S.SALARY_COLUMNS])
    blank = F.array(*[F.lit("")] * S.SALARY_PREFIX)
    classic = F.slice("cells", 1, len(S.SALARY_COLUMNS)) == names
    classic = classic & (F.slice("cells", len(S.SALARY_COLUMNS) + 1, S.SALARY_PREFIX) == blank)
    prefixed = (F.slice("cells", 1, S.SALARY_PREFIX) == blank) & (F.slice("cells", S.SALARY_PREFIX + 1, len(S.SALARY_COLUMNS)) == names)
    at = lambda cond, rank: F.min(F.when(cond, F.struct(F.lit(rank).alias("rank"), "pos", "cells")))
    best = F.least(
        at((F.col("pos") == 0) & classic, 0), at(prefixed, 1), at(F.col("pos") == 0, 2),
    )
    found = lines.groupBy("path").agg(best.alias("h"))
    return found.select("path", F.col("h.pos").alias("_at"), F.col("h.cells").alias("_names"), (F.col("h.rank") < 2).alias("known"))


def _cell(name: str) -> Column:
    place = F.array_position("_names", name)
    return F.when(place > 0, F.coalesce(F.try_element_at("cells", place.cast("int")), F.lit(""))).otherwise("")


def parse_salaries(spark: SparkSession, path: str | list[str]) -> ParsedSalaries:
    """Typed players, and one error row per rejected line (its first failing check) or warning."""
    files = read_files(spark, path)
    lines = _lines(files)
    headers = _headers(lines)
    data = lines.join(headers, "path").filter(F.col("pos") > F.col("_at"))
    raw = data.select("path", (F.col("pos") + 1).alias("line"), *[_cell(c).alias(c) for c in S.SALARY_COLUMNS])
    g = game_info("Game Info")
    avg = F.col("AvgPointsPerGame").try_cast("double")
    rows = raw.withColumns({"_salary": parse_count("Salary"), "_slots": split_positions("Roster Position"), "_g": g})

    def bad(cond: Column, field: str, message: Column) -> Column:
        return F.when(cond, F.struct(F.lit(field).alias("field"), message.alias("message")))

    quoted = lambda text, c: F.concat(F.lit(f"{text}: '"), F.col(c), F.lit("'"))
    checks = F.coalesce(
        bad(F.col("ID") == "", "ID", F.lit("missing player id")),
        bad(F.col("Name") == "", "Name", F.lit("missing name")),
        bad(F.col("Roster Position") == "", "Roster Position", F.lit("missing roster position")),
        bad(F.col("Salary") == "", "Salary", F.lit("missing salary")),
        bad(F.col("_salary").isNull(), "Salary", quoted("non-integer salary", "Salary")),
        bad(F.size("_slots") == 0, "Roster Position", quoted("could not parse position eligibility", "Roster Position")),
        bad(F.col("Game Info") == "", "Game Info", F.lit("missing game info")),
        bad(~F.col("_g.ok"), "Game Info", quoted("unrecognized game info format", "Game Info")),
        bad(F.col("_g.game_date").isNull(), "Game Info", F.concat(F.lit("invalid date '"), F.col("_g.date_text"), F.lit("'"))),
    )
    rows = rows.withColumn("_bad", checks)
    players = rows.filter(F.col("_bad").isNull()).select(
        "path", "line", F.col("ID").alias("player_id"), F.col("Name").alias("name"), F.col("Position").alias("position"),
        F.col("_slots").alias("position_eligibility"), F.col("_salary").alias("salary"), F.col("Game Info").alias("game_info"),
        F.col("_g.away_team"), F.col("_g.home_team"), F.col("_g.game_date"), F.col("_g.game_time_et"), F.col("TeamAbbrev").alias("team"),
        F.coalesce(avg, F.lit(0.0)).alias("avg_points_per_game"), F.array_contains("_slots", "P").alias("is_pitcher"),
    )
    error = lambda df, line, field, message, severity: df.select("path", line.alias("row"), field.alias("field"), message.alias("message"), F.lit(severity).alias("severity"))
    rejected = error(rows.filter(F.col("_bad").isNotNull()), F.col("line"), F.col("_bad.field"), F.col("_bad.message"), "error")
    warned = error(
        rows.filter(F.col("_bad").isNull() & (F.col("AvgPointsPerGame") != "") & avg.isNull()), F.col("line"), F.lit("AvgPointsPerGame"),
        F.concat(quoted("non-numeric avg points", "AvgPointsPerGame"), F.lit(" (defaulting to 0.0)")), "warning",
    )
    layout = error(headers.filter(~F.col("known")), F.lit(1), F.lit("header"), F.concat(F.lit("Unexpected salary columns: "), F.array_join(F.filter("_names", lambda c: c != ""), ", ")), "critical")
    errors = rejected.unionByName(warned).unionByName(layout)
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("raw_row_count"), F.count_if(F.col("_bad").isNull()).alias("parsed_row_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = files.select("path", "file_hash", "short_id").join(counts, "path", "left").select("path", "file_hash", "short_id", zero("raw_row_count"), zero("parsed_row_count"))
    return ParsedSalaries(players, errors, summary)
