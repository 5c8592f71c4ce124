"""Name and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col, clean

# Latin letters with marks and their bare forms, used to fold accents.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēėęěğģīįıķļłńņňōőřśşšţťūůűųźżž"
BARE = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeeggiiikllnnnoorsssttuuuuzzz"

# The text form of a game, "AWY@HOM MM/DD/YYYY hh:mmAM ET".
GAME_INFO = (
    r"^\s*([A-Z]{2,4})\s*@\s*([A-Z]{2,4})\s+(\d{1,2}/\d{1,2}/\d{4})\s+"
    r"(\d{1,2}:\d{2}\s*(?:AM|PM)\s*[A-Z]{2,3})\s*$"
)


def fold_accents(x) -> Column:
    """Lower case without combining marks."""
    return F.regexp_replace(F.translate(F.lower(clean(x)), ACCENTED, BARE), r"\p{Mn}+", "")


def tokens(x) -> Column:
    return F.filter(F.split(clean(x), r"\s+"), lambda t: t != "")


def token_sort(x) -> Column:
    """Words in alphabetical order, single spaces."""
    return F.array_join(F.array_sort(tokens(x)), " ")


def last_token(x) -> Column:
    return F.coalesce(F.try_element_at(tokens(x), F.lit(-1)), F.lit(""))


def first_last(x) -> Column:
    """``Last, First`` -> ``First Last``; other names unchanged."""
    x = F.trim(as_col(x))
    parts = F.split(x, ",", 2)
    return F.when(
        F.contains(x, F.lit(",")),
        F.concat_ws(" ", F.trim(F.get(parts, 1)), F.trim(F.get(parts, 0))),
    ).otherwise(x)


def slug_name(url, marker: str = "/player/") -> Column:
    """Name from a link such as ``…/player/pat-example-123``; NULL without the marker."""
    url = as_col(url)
    slug = F.trim(F.split_part(F.element_at(F.split(url, marker), -1), F.lit("?"), F.lit(1)), F.lit("/"))
    bare = F.regexp_replace(slug, r"-[^-]*$", "")
    name = F.initcap(F.replace(bare, F.lit("-"), F.lit(" ")))
    return F.when(F.contains(url, F.lit(marker)) & (bare != ""), name)


def split_positions(x) -> Column:
    """``"1B/OF"`` -> [1B, OF] without blanks."""
    return F.filter(F.transform(F.split(clean(x), "/"), lambda t: F.trim(t)), lambda t: t != "")


def primary_position(x) -> Column:
    first = F.trim(F.split_part(clean(x), F.lit("/"), F.lit(1)))
    return F.when(first == "", "UNK").otherwise(first)


def squeeze(x) -> Column:
    return F.regexp_replace(F.trim(as_col(x)), r"\s+", " ")


def game_info(x) -> Column:
    """Struct (ok, away_team, home_team, date_text, game_date, game_time_et) of a game text."""
    x = clean(x)
    part = lambda i: F.regexp_extract(x, GAME_INFO, i)
    return F.struct(
        x.rlike(GAME_INFO).alias("ok"),
        part(1).alias("away_team"),
        part(2).alias("home_team"),
        part(3).alias("date_text"),
        F.try_to_date(part(3), "M/d/yyyy").alias("game_date"),
        squeeze(part(4)).alias("game_time_et"),
    )
