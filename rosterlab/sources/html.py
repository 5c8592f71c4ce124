"""Landed HTML pages to rows, with built-in pattern functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import lookup
from ..functions.text import slug_name

# The markup of list links and of the posted-lineup page.
ITEM = r'<li[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
GAME = r'<div[^>]*class="[^"]*\blineup\b[^"]*\bis-mlb\b[^"]*"'
TEAM = r'class="[^"]*lineup__abbr[^"]*"[^>]*>\s*([^<\s]+)\s*<'
SIDE = r'(?s)<ul[^>]*class="[^"]*lineup__list[^"]*{side}[^"]*"[^>]*>(.*?)</ul>'
CONFIRMED = r'<li[^>]*class="[^"]*is-confirmed'
STARTER = r'(?s)<li[^>]*class="[^"]*lineup__player-highlight(?!-)[^"]*"[^>]*>.*?<a[^>]*href="([^"]*)"'
STARTER_TEXT = r'(?s)<li[^>]*class="[^"]*lineup__player-highlight(?!-)[^"]*"[^>]*>.*?<a[^>]*>([^<]*)</a>'
PLAYER = r'(?s)<li[^>]*class="(?:[^"]*\s)?lineup__player(?:\s[^"]*)?"[^>]*>(.*?)</li>'
TITLE = r'<a[^>]*title="([^"]+)"'
TEXT = r"<a[^>]*>([^<]*)</a>"


def page_items(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Links of list items in page order: (key, place, href, title)."""
    pat = F.lit(ITEM)
    both = F.arrays_zip(F.regexp_extract_all(html, pat, F.lit(1)).alias("href"), F.regexp_extract_all(html, pat, F.lit(2)).alias("title"))
    rows = df.select(key, F.posexplode(both).alias("pos", "item"))
    return rows.select(key, (F.col("pos") + 1).alias("place"), F.col("item.href").alias("href"), F.col("item.title").alias("title"))


def _alias(c: Column) -> Column:
    c = F.upper(F.trim(c))
    return F.coalesce(lookup(c, S.TEAM_ALIAS), c)


def posted_sides(df: DataFrame, html: str = "html") -> DataFrame:
    """Game blocks to sides: (team, confirmed, pitcher_name, players with their order)."""
    marked = F.regexp_replace(html, f"({GAME})", "\u0001$1")
    games = df.select(F.posexplode(F.split(marked, "\u0001")).alias("at", "game")).filter(F.col("at") > 0)
    teams = F.regexp_extract_all("game", F.lit(TEAM), F.lit(1))
    games = games.withColumn("teams", teams).filter(F.size("teams") >= 2)
    side = lambda cls, i: F.struct(F.get("teams", i).alias("team"), F.regexp_extract("game", SIDE.format(side=cls), 1).alias("body"))
    s = games.select(F.explode(F.array(side("is-visit", 0), side("is-home", 1))).alias("s")).select(_alias(F.col("s.team")).alias("team"), F.col("s.body").alias("body"))
    s = s.filter((F.col("team") != "") & (F.col("body") != ""))
    names = F.filter(
        F.transform(F.regexp_extract_all("body", F.lit(PLAYER), F.lit(1)), lambda li: F.trim(F.coalesce(
            F.nullif(F.regexp_extract(li, TITLE, 1), F.lit("")), F.regexp_extract(li, TEXT, 1)))),
        lambda n: n != "",
    )
    href = F.regexp_extract("body", STARTER, 1)
    starter = F.coalesce(slug_name(href, "/baseball/player/"), F.trim(F.regexp_extract("body", STARTER_TEXT, 1)))
    return s.select("team", F.col("body").rlike(CONFIRMED).alias("confirmed"), starter.alias("pitcher_name"), names.alias("players"))


def posted_lineups(df: DataFrame, html: str = "html") -> DataFrame:
    """Confirmed batting orders: (team, batting_order, name)."""
    sides = posted_sides(df, html).filter("confirmed")
    return sides.select("team", F.posexplode("players").alias("pos", "name")).select("team", (F.col("pos") + 1).alias("batting_order"), "name")


def posted_starters(df: DataFrame, html: str = "html") -> DataFrame:
    """Confirmed starting pitchers: (team, pitcher_name)."""
    return posted_sides(df, html).filter(F.col("confirmed") & (F.col("pitcher_name") != "")).select("team", "pitcher_name")
