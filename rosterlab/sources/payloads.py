"""Landed JSON documents to typed rows. The documents are text columns; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import clip, code, epoch_millis, innings_from_text, lookup

_HITTING = {
    "runs": "runs", "rbi": "rbi", "stolen_bases": "stolenBases", "hits": "hits", "doubles": "doubles", "triples": "triples",
    "home_runs": "homeRuns", "walks": "baseOnBalls", "hit_by_pitch": "hitByPitch", "at_bats": "atBats", "strike_outs": "strikeOuts",
}
_PITCHING = {
    "outs_pitched": "outs", "strikeouts": "strikeOuts", "earned_runs": "earnedRuns", "hits_allowed": "hits",
    "walks_allowed": "baseOnBalls", "hit_batsmen": "hitBatsmen", "complete_games": "completeGames", "shutouts": "shutouts",
    "no_hitters": "noHitters",
}


def _log_splits(df: DataFrame, payload: str, keep: str, stat: str) -> DataFrame:
    schema = f"stats array<struct<splits: array<struct<date: string, game: struct<gamePk: bigint>, stat: struct<{stat}>>>>>"
    first = F.get(F.from_json(F.col(payload), schema)["stats"], 0)["splits"]
    return df.select(keep, F.explode(first).alias("g"))


def _common(key: str) -> list[Column]:
    return [F.col(key), F.try_to_date(F.col("g.date"), "yyyy-MM-dd").alias("game_date"), F.col("g.game.gamePk").alias("game_pk")]


def flatten_hitting_logs(df: DataFrame, payload: str = "payload", key: str = "batter") -> DataFrame:
    """``stats[0].splits[]`` to one row per game; counters missing from a game are 0."""
    rows = _log_splits(df, payload, key, ", ".join(f"{c}: int" for c in _HITTING.values()))
    return rows.select(*_common(key), *[F.coalesce(F.col(f"g.stat.{c}"), F.lit(0)).alias(n) for n, c in _HITTING.items()])


def flatten_pitching_logs(df: DataFrame, payload: str = "payload", key: str = "pitcher") -> DataFrame:
    rows = _log_splits(df, payload, key, ", ".join(f"{c}: int" for c in _PITCHING.values()) + ", inningsPitched: string, wins: int")
    return rows.select(
        *_common(key), innings_from_text(F.coalesce(F.col("g.stat.inningsPitched"), F.lit("0.0"))).alias("innings_pitched"),
        *[F.coalesce(F.col(f"g.stat.{c}"), F.lit(0)).alias(n) for n, c in _PITCHING.items()],
        F.when(F.col("g.stat.wins") > 0, 1).otherwise(0).alias("wins"),
    )


def flatten_schedule_lineups(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Posted lineups of a schedule document; the batting order is the 1-based place in the side's list."""
    side = "struct<team: struct<id: int>>"
    player = "array<struct<id: bigint, fullName: string>>"
    schema = (
        f"dates array<struct<date: string, games: array<struct<gamePk: bigint, teams: struct<home: {side}, away: {side}>, "
        f"lineups: struct<homePlayers: {player}, awayPlayers: {player}>>>>>"
    )
    days = df.select(F.explode(F.from_json(F.col(payload), schema)["dates"]).alias("d"))
    games = days.select(F.col("d.date").alias("day"), F.explode("d.games").alias("g"))
    sides = games.select("day", "g.gamePk", F.explode(F.array(
        F.struct(F.col("g.teams.home.team.id").alias("id"), F.col("g.lineups.homePlayers").alias("players")),
        F.struct(F.col("g.teams.away.team.id").alias("id"), F.col("g.lineups.awayPlayers").alias("players")),
    )).alias("s"))
    rows = sides.select("day", "gamePk", F.coalesce(F.col("s.id"), F.lit(0)).alias("team_id"), F.posexplode("s.players").alias("pos", "p"))
    return rows.filter(F.col("p.id").isNotNull()).select(
        F.col("gamePk").alias("game_pk"), F.coalesce(lookup("team_id", S.TEAM_ID), F.col("team_id").cast("string")).alias("team"),
        F.col("p.id").alias("mlbam_id"), (F.col("pos") + 1).alias("batting_order"),
        F.trim(F.coalesce(F.col("p.fullName"), F.lit(""))).alias("player_name"), F.try_to_date("day", "yyyy-MM-dd").alias("game_date"),
    )


def flatten_probables(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(team, pitcher) per side with a probable pitcher; team codes are aliased."""
    side = "struct<team: struct<abbreviation: string>, probablePitcher: struct<fullName: string>>"
    schema = f"dates array<struct<games: array<struct<teams: struct<home: {side}, away: {side}>>>>"
    schema += ">"
    games = F.flatten(F.from_json(F.col(payload), schema)["dates"]["games"])
    sides = df.select(F.explode(games).alias("g")).select(F.explode(F.array("g.teams.home", "g.teams.away")).alias("s"))
    team = F.coalesce(F.col("s.team.abbreviation"), F.lit(""))
    rows = sides.select(
        F.coalesce(lookup(team, S.TEAM_ALIAS), team).alias("team"),
        F.coalesce(F.col("s.probablePitcher.fullName"), F.lit("")).alias("pitcher_name"),
    )
    return rows.filter((F.col("team") != "") & (F.col("pitcher_name") != ""))


def team_code(name) -> Column:
    """Code of a full team name: the table, else its first three letters; then the alias."""
    name = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    raw = F.coalesce(lookup(name, S.TEAM_NAME), F.upper(F.left(name, F.lit(3))))
    return F.coalesce(lookup(raw, S.TEAM_ALIAS), raw)


def implied_pair(total: Column, spread: Column, limit: float = 3.0) -> tuple[Column, Column]:
    """(home, away) implied totals: half the total shifted by the spread, clipped to 2..9.

    A missing spread, or one beyond ``limit``, counts as even.
    """
    s = F.when(F.abs(spread) > limit, 0.0).otherwise(F.coalesce(spread, F.lit(0.0)))
    return clip((total - s) / 2.0, 2.0, 9.0), clip((total + s) / 2.0, 2.0, 9.0)


_OUTCOMES = "array<struct<key: string, outcomes: array<struct<name: string, point: double, price: double>>>>"
ODDS_JSON = (
    "array<struct<id: string, home_team: string, away_team: string, commence_time: string, "
    f"bookmakers: array<struct<key: string, markets: {_OUTCOMES}>>>>"
)


def _outcomes(markets: Column, key: str) -> Column:
    """Outcomes of the last market with this key (later entries override)."""
    hits = F.filter(markets, lambda m: m["key"] == key)
    return F.try_element_at(hits, F.lit(-1))["outcomes"]


def _first(outcomes: Column, name) -> Column:
    return F.get(F.filter(outcomes, lambda o: o["name"] == name), 0)


def flatten_odds(df: DataFrame, payload: str = "payload", fetched_at: str = "fetched_at", books: str = "first") -> DataFrame:
    """Odds documents to one row per team and game (``books="all"``: per bookmaker too).

    Games without a total are skipped.
    """
    games = df.select(F.col(fetched_at), F.explode(F.from_json(F.col(payload), ODDS_JSON)).alias("g"))
    picked = F.col("g.bookmakers") if books == "all" else F.slice(F.coalesce(F.col("g.bookmakers"), F.array()), 1, 1)
    rows = games.select(fetched_at, "g", F.explode(picked).alias("b"))
    m = F.coalesce(F.col("b.markets"), F.array().cast(_OUTCOMES))
    h2h = _outcomes(m, "h2h")
    last = lambda name: F.try_element_at(F.filter(h2h, lambda o: o["name"] == name), F.lit(-1))["price"]
    flat = rows.select(
        fetched_at, F.coalesce(F.col("g.id"), F.lit("")).alias("game_id"), F.col("g.commence_time"), F.col("b.key").alias("bookmaker"),
        team_code(F.col("g.home_team")).alias("home_team"), team_code(F.col("g.away_team")).alias("away_team"),
        _first(_outcomes(m, "totals"), F.lit("Over"))["point"].alias("game_total"),
        _first(_outcomes(m, "spreads"), F.col("g.home_team"))["point"].alias("spread"),
        last(F.col("g.home_team")).alias("home_ml"), last(F.col("g.away_team")).alias("away_ml"),
    ).filter(F.col("game_total").isNotNull())
    return implied_rows(flat)


def implied_rows(games: DataFrame) -> DataFrame:
    """Games with ``game_total`` and ``spread`` to two team rows with their implied totals."""
    home, away = implied_pair(F.col("game_total"), F.col("spread"))
    side = lambda team, is_home, own, other, ml: F.struct(
        F.col(team).alias("team"), F.lit(is_home).alias("is_home"), F.col(own).alias("implied_total"),
        F.col(other).alias("opposing_implied"), F.col(ml).alias("moneyline"),
    )
    both = F.array(
        side("home_team", True, "home_implied", "away_implied", "home_ml"),
        side("away_team", False, "away_implied", "home_implied", "away_ml"),
    )
    out = games.withColumns({"home_implied": home, "away_implied": away}).withColumn("_side", F.explode(both))
    return out.select("*", "_side.*").drop("_side", "spread")


def flatten_roster_status(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Roster entries to (player_id, name_key, code, reason); the status is an object or plain text."""
    entries = df.select(F.explode(F.from_json(F.col(payload), "roster array<struct<person: struct<id: bigint, fullName: string>, status: string>>")["roster"]).alias("e"))
    # An object arrives here as its JSON text, plain text as itself.
    obj = F.from_json(F.col("e.status"), "code string, description string")
    is_obj = F.startswith(F.trim(F.col("e.status")), F.lit("{"))
    status = code(F.when(is_obj, obj["code"]).otherwise(F.col("e.status")))
    desc = F.trim(F.coalesce(F.when(is_obj, obj["description"]), F.lit("")))
    reason = F.when(desc != "", desc).when(status != "", status).otherwise("roster status")
    rows = entries.select(
        F.col("e.person.id").alias("player_id"), F.lower(F.trim(F.coalesce(F.col("e.person.fullName"), F.lit("")))).alias("name_key"),
        status.alias("code"), reason.alias("reason"),
    )
    return rows.filter(F.col("player_id").isNotNull())


def flatten_injuries(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Injury entries to (player_id, code, reason text); the list and the fields have alternative names."""
    item = "array<struct<playerId: string, id: string, description: string, note: string, status: string, injuryStatus: string>>"
    doc = F.from_json(F.col(payload), "injuries string, teams string")
    inner = F.from_json(doc["teams"], "injuries string")["injuries"]
    pick = lambda text: F.from_json(text, item)
    has = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    rows = F.when(has(pick(doc["injuries"])), pick(doc["injuries"])).when(
        F.startswith(F.trim(doc["teams"]), F.lit("[")), pick(doc["teams"])
    ).otherwise(pick(inner))
    text = lambda *cs: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs], F.lit(""))
    e = df.select(F.explode(rows).alias("e"))
    status = text("e.status", "e.injuryStatus")
    obj = F.from_json(status, "code string")["code"]
    out = e.select(
        F.coalesce(F.col("e.playerId"), F.col("e.id")).try_cast("bigint").alias("player_id"),
        code(F.when(F.startswith(status, F.lit("{")), obj).otherwise(status)).alias("code"),
        text("e.description", "e.note").alias("description"),
    )
    return out.filter(F.col("player_id").isNotNull())


def flatten_contests(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Contest list to typed rows; unreadable or zero numbers fall back to their defaults."""
    item = "gameType: string, n: string, a: string, m: string, nt: string, po: string, sd: string, dg: string"
    rows = df.select(F.explode(F.from_json(F.col(payload), f"Contests array<struct<{item}>>")["Contests"]).alias("c"))

    def number(c: str, kind: str, default):
        v = F.col(f"c.{c}").try_cast("double").cast(kind)
        return F.when(v != 0, v).otherwise(F.lit(default).cast(kind))

    return rows.select(
        F.col("c.dg").try_cast("bigint").alias("group_id"), F.col("c.gameType").alias("game_type"), F.coalesce(F.col("c.n"), F.lit("")).alias("name"),
        number("a", "int", 999).cast("double").alias("entry_fee"), number("m", "int", 0).alias("max_entries"), number("nt", "int", 0).alias("entries"),
        number("po", "double", 0.0).alias("prize_pool"), epoch_millis("c.sd").cast("timestamp_ntz").alias("start_utc"),
    )
