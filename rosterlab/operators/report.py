"""Derived tables of the user interface and the pre-slate report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import prefix_sums, top_rows, with_group_stats


LEAST_OWNERSHIP = 0.1
HOT, COLD = 5.0, 3.5


def position_filter(choice: str) -> Column:
    """ALL, HITTERS, SP, RP, or one eligible position."""
    if choice == "ALL":
        return F.lit(True)
    if choice == "HITTERS":
        return ~F.col("is_pitcher")
    if choice in ("SP", "RP"):
        return F.col("is_pitcher") & (F.upper("position") == choice)
    return F.array_contains("position_eligibility", choice)


def search_filter(text: str) -> Column:
    """Case-insensitive part of the name or the team."""
    q = text.strip().lower()
    return F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("team"), F.lit(q))


def sort_by(df: DataFrame, column: str, descending: bool = True, tie: str = "player_id") -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def percentile_bands(df: DataFrame, value: str = "pts_q50", keys: Sequence[str] = ()) -> DataFrame:
    """Share of the pool above a value (ties share the first place) with its colour band.

    Distinct values are counted first, so only one row per value is ordered.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = prefix_sums(counted, keys, [F.col(value).desc_nulls_last()], F.col("_c"), out="_hi", total="_n")
    place = placed.select(*keys, F.col(value).alias("_v"), ((F.col("_hi") - F.col("_c")) / F.col("_n")).alias("top_share"))
    on = [df[value].eqNullSafe(F.col("_v"))] + [df[k].eqNullSafe(place[k]) for k in keys]
    out = df.join(place, on, "left").drop("_v", *[place[k] for k in keys])
    band = F.when(F.col("top_share") < 0.2, "green").when(F.col("top_share") < 0.6, "amber").otherwise("red")
    return out.withColumn("band", band)


def pool_view(df: DataFrame, choice: str = "ALL", text: str = "", column: str = "pts_q50", descending: bool = True) -> DataFrame:
    """Banded pool, filtered and sorted as the projections page shows it."""
    out = percentile_bands(df).filter(position_filter(choice))
    return sort_by(out.filter(search_filter(text)) if text else out, column, descending)


def leverage_board(df: DataFrame, n: int = 10) -> DataFrame:
    ok = df.filter(~F.col("is_pitcher") & ~F.col("is_banned"))
    return ok.orderBy(F.col("leverage_score").desc(), "player_id").limit(n)


def ceiling_board(df: DataFrame, n: int = 8) -> DataFrame:
    """Largest gap between ceiling and median among available players, pitchers included."""
    gap = df.filter(~F.col("is_banned")).withColumn("ceiling_gap", F.col("pts_q85") - F.col("pts_q50"))
    return gap.orderBy(F.col("ceiling_gap").desc(), "player_id").limit(n)


def median_leverage_board(df: DataFrame, n: int = 10) -> DataFrame:
    """Largest median per point of ownership (0.1 at least), of all players."""
    board = df.withColumn("median_leverage", F.col("pts_q50") / F.greatest(F.col("ownership_proj"), F.lit(LEAST_OWNERSHIP)))
    return board.orderBy(F.col("median_leverage").desc(), "player_id").limit(n)


def leverage_scatter(df: DataFrame) -> DataFrame:
    """Points for the ownership/points chart with the pool means, the quadrant and the band of the leverage."""
    out = with_group_stats(df, [], {"mean_ownership": F.avg("ownership_proj"), "mean_points": F.avg("pts_q50")})
    high, popular = F.col("pts_q50") >= F.col("mean_points"), F.col("ownership_proj") >= F.col("mean_ownership")
    quadrant = F.when(high & ~popular, "leverage").when(high, "chalk").when(~popular, "punt").otherwise("trap")
    lev = F.col("leverage_score")
    return out.withColumns({"quadrant": quadrant, "dot": F.when(lev >= 1.3, "green").when(lev >= 0.8, "amber").otherwise("grey")})


def top_lists(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Best medians per list: hitters, starters and relievers."""
    sizes = sizes or {"hitters": 10, "starters": 10, "relievers": 5}
    role = F.when(~F.col("is_pitcher"), "hitters").when(F.startswith(F.upper("position"), F.lit("SP")), "starters").when(F.upper("position") == "RP", "relievers")
    rows = df.withColumn("list", role).filter(F.col("list").isNotNull())
    best = top_rows(rows, ["list"], [F.col("pts_q50").desc(), F.col("player_id")], max(sizes.values()), rank="place")
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col("list") == name) & (F.col("place") <= n))
    return best.filter(keep)


def top_totals(totals: DataFrame, n: int = 5) -> DataFrame:
    """Highest implied totals, one row per team."""
    best = totals.filter(F.col("implied_total").isNotNull()).groupBy("team").agg(F.max("implied_total").alias("implied_total"))
    return best.orderBy(F.col("implied_total").desc(), "team").limit(n)


def value_flags(df: DataFrame, limit: float = 25.0) -> DataFrame:
    """Players whose median looks inflated."""
    return df.withColumn("inflated", F.col("pts_q50") > limit)


def model_vs_average(df: DataFrame) -> DataFrame:
    """MODEL where the median moved away from the season average, else AVG, with the difference."""
    diff = F.col("pts_q50") - F.col("avg_points")
    return df.withColumns({"source": F.when(F.abs(diff) > 0.1, "MODEL").otherwise("AVG"), "diff": F.round(diff, 2)})


def market_board(totals: DataFrame) -> DataFrame:
    """Every team once with its highest implied total (0 without one) and whether it is hot or cold."""
    best = totals.groupBy("team").agg(F.max(F.coalesce(F.col("implied_total").cast("double"), F.lit(0.0))).alias("implied_total"))
    return best.withColumn("flag", F.when(F.col("implied_total") > HOT, "hot").when(F.col("implied_total") < COLD, "cold").otherwise(""))


def pre_slate_report(df: DataFrame, totals: DataFrame, starters: DataFrame | None = None, freshness: DataFrame | None = None) -> DataFrame:
    """Sections of the morning report as (section, label, value, flag) rows.

    ``starters`` (team, status) and ``freshness`` (dataset, day) add the sections of the same names; a day is shown as the
    number of days since 1970-01-01.
    """
    def row(d, section, label, value, flag=None):
        flag = F.col(flag) if flag else F.lit("")
        return d.select(F.lit(section).alias("section"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"), flag.alias("flag"))

    parts = [
        row(market_board(totals), "market", "team", "implied_total", "flag"),
        row(df.filter("is_banned"), "banned", "player_id", "pts_q50"),
        row(value_flags(df).filter("inflated"), "inflated", "player_id", "pts_q50"),
        row(df.orderBy(F.col("ownership_proj").desc(), "player_id").limit(10), "ownership", "player_id", "ownership_proj"),
        row(median_leverage_board(df), "leverage", "player_id", "median_leverage"),
    ]
    lists = top_lists(df)
    parts.append(lists.select(F.concat(F.lit("top "), F.col("list")).alias("section"), F.col("player_id").cast("string").alias("label"), F.col("pts_q50").alias("value"), F.lit("").alias("flag")))
    if starters is not None:
        parts.append(row(starters.withColumn("_v", F.lit(None).cast("double")), "starters", "team", "_v", "status"))
    if freshness is not None:
        parts.append(row(freshness.withColumn("_v", F.datediff("day", F.lit("1970-01-01").cast("date"))), "freshness", "dataset", "_v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
