"""Slate preparation: market totals, availability, contests, recent usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import code, lookup
from ..functions.text import fold_accents, last_token, token_sort
from ..functions.similarity import indel_ratio
from .ordered import first_row, top_rows


def latest_usable(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Second-to-last row per player (the last when there is only one), so that no feature knows its own game.

    Two rows per player leave the first step, limited before the shuffle.
    """
    two = top_rows(df, [key], [F.col(c).desc() for c in order], 2, rank="_rn")
    rest = [c for c in df.columns if c != key]
    picked = two.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("_rn")).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)


def plate_appearances_30d(
    logs: DataFrame, today: Column, key: str = "batter", per_game: float = 3.8,
    fallback: DataFrame | None = None, players: DataFrame | None = None,
) -> DataFrame:
    """Plate appearances since ``today`` - 30 days; without counts, 3.8 per game.

    Players absent from the logs use their feature rows (``fallback``), then 0.
    """
    recent = F.col("game_date") >= F.date_sub(today, 30)
    parts = [c for c in ("at_bats", "walks", "hit_by_pitch", "sac_flies") if c in logs.columns]
    pa = sum((F.coalesce(F.col(c), F.lit(0)) for c in parts), F.lit(0))
    out = logs.filter(recent).groupBy(key).agg(F.sum(pa).cast("double").alias("_pa"), F.count(F.lit(1)).alias("_games"))
    out = out.select(key, F.when(F.col("_pa") > 0, F.col("_pa")).otherwise(F.col("_games") * per_game).cast("int").alias("pa_30d"))
    if fallback is not None:
        rows = fallback.filter(recent).groupBy(key).agg((F.count(F.lit(1)) * per_game).cast("int").alias("_est"))
        out = out.join(rows, key, "full_outer").select(key, F.coalesce("pa_30d", "_est").alias("pa_30d"))
    if players is not None:
        out = players.join(out, key, "left").select(key, F.coalesce("pa_30d", F.lit(0)).alias("pa_30d"))
    return out


# --- market


def team_totals(odds: DataFrame, how: str = "first", order: Sequence[Column] | None = None) -> DataFrame:
    """One implied total per team: the first row per team, or the mean over all books."""
    if how == "first":
        order = order or [F.col("fetched_at").desc(), F.col("game_id"), F.col("bookmaker")]
        odds = first_row(odds, ["team"], order)
    return (
        odds.filter((F.col("team") != "") & F.col("implied_total").isNotNull())
        .groupBy("team").agg(F.avg("implied_total").alias("implied_total"))
    )


def market_flags(totals: DataFrame, hot: float = 5.0, cold: float = 3.5) -> DataFrame:
    t = F.col("implied_total")
    return totals.withColumn("flag", F.when(t > hot, "HOT").when(t < cold, "COLD").otherwise(""))


# --- availability


def is_banned_code(c: Column) -> Column:
    return c.isin(S.BAN_CODES) | c.rlike("^D[0-9]+$")


def availability(roster: DataFrame, injuries: DataFrame) -> DataFrame:
    """Unavailable and day-to-day players with one reason.

    The roster's reason wins over the injury feed's; unavailable wins over day-to-day.
    """
    c = F.col("code")

    def worst(df: DataFrame, prefix: str, ban: Column, dtd: Column) -> DataFrame:
        kind = F.when(is_banned_code(c), 0).when(c.isin(S.DAY_TO_DAY_CODES), 1)
        rows = df.select("player_id", kind.alias("_kind"), F.when(is_banned_code(c), ban).otherwise(dtd).alias("_reason"))
        rows = rows.filter(F.col("_kind").isNotNull()).groupBy("player_id").agg(F.min(F.struct("_kind", "_reason")).alias("_w"))
        return rows.select("player_id", F.col("_w._kind").alias(f"{prefix}_kind"), F.col("_w._reason").alias(f"{prefix}_reason"))

    r = worst(roster, "r", F.col("reason"), F.concat(F.lit("DTD — "), F.col("reason")))
    text = F.when(F.col("description") != "", F.col("description")).otherwise(c)
    i = worst(injuries, "i", F.concat(F.lit("Injuries feed: "), text), F.concat(F.lit("DTD ("), text, F.lit(")")))
    kind = F.least("r_kind", "i_kind")  # skips NULL
    return r.join(i, "player_id", "full_outer").select(
        "player_id", F.when(kind == 0, "unavailable").otherwise("dtd").alias("status"),
        F.coalesce("r_reason", "i_reason").alias("reason"),
    )


def pool_status(pool: DataFrame, status: DataFrame, roster_names: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """Pool players with a status: by exact roster name (lower case), else by their resolved id."""
    names = roster_names.filter(F.col("name_key") != "").groupBy("name_key").agg(F.max("player_id").alias("_by_name"))
    out = pool.withColumn("_nk", F.lower(F.trim("name"))).join(names, F.col("_nk") == F.col("name_key"), "left")
    rid = F.col("_by_name")
    if matched is not None:
        out = out.join(matched.select("player_id", F.col("register_id").alias("_matched")), "player_id", "left")
        rid = F.coalesce(rid, F.col("_matched"))
    out = out.withColumn("_rid", rid)
    s = status.select(F.col("player_id").alias("_sid"), "status", "reason")
    return out.join(s, F.col("_rid") == F.col("_sid")).drop("_nk", "name_key", "_by_name", "_matched", "_rid", "_sid")


def scratches(pool: DataFrame, posted: DataFrame, threshold: float = 80.0, min_posted: int = 8) -> DataFrame:
    """Hitters whose best similarity to their team's posted lineup is below ``threshold``.

    Names are compared once per (team, name) and only with teams that posted a full lineup,
    so the pairs are names times the nine or so posted ones.
    """
    t = lambda df: df.withColumn("team", code("team"))
    names = t(posted).select("team", F.lower(F.trim("name")).alias("_posted")).distinct()
    full = t(posted).groupBy("team").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_posted).select("team")
    hitters = t(pool).filter(~F.col("is_pitcher"))
    mine = hitters.select("team", F.lower(F.trim("name")).alias("_mine")).distinct().join(full, "team", "left_semi")
    pairs = mine.join(names, "team").withColumn("_s", indel_ratio(token_sort("_mine"), token_sort("_posted")))
    best = pairs.groupBy("team", "_mine").agg(F.max("_s").alias("similarity")).filter(F.col("similarity") < threshold)
    return hitters.withColumn("_mine", F.lower(F.trim("name"))).join(best, ["team", "_mine"]).drop("_mine")


def confirmed_starters(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Starter per team: the primary source, gaps filled from the secondary, surname conflicts flagged."""
    p = primary.groupBy("team").agg(F.max("pitcher_name").alias("_p"))
    s = secondary.groupBy("team").agg(F.max("pitcher_name").alias("_s"))
    last = lambda c: fold_accents(last_token(c))
    return p.join(s, "team", "full_outer").select(
        "team", F.coalesce("_p", "_s").alias("pitcher_name"),
        F.when(F.col("_p").isNotNull(), "primary").otherwise("secondary").alias("source"),
        F.coalesce((last("_p") != "") & (last("_s") != "") & (last("_p") != last("_s")), F.lit(False)).alias("conflict"),
    )


def starter_check(pool: DataFrame, starters: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Starting pitchers of the pool as confirmed, unconfirmed or without a listing."""
    sps = pool.filter(F.col("is_pitcher") & (F.upper("position") == "SP")).withColumn("_team", code("team"))
    right = starters.select(code("team").alias("_t"), F.col("pitcher_name").alias("listed"))
    out = sps.join(right, F.col("_team") == F.col("_t"), "left")
    score = indel_ratio(token_sort(F.lower("name")), token_sort(F.lower("listed")))
    out = out.withColumn("similarity", score)
    verdict = F.when(F.col("listed").isNull() | (F.col("listed") == ""), "no listing").when(F.col("similarity") >= threshold, "confirmed").otherwise("unconfirmed")
    return out.withColumn("verdict", verdict).drop("_team", "_t")


# --- contests


def qualifying_contests(contests: DataFrame, today: Column, game_type: str = "Classic", word: str = "MLB", max_fee: float = 25.0, min_field: int = 5000, zone: str = "America/New_York") -> DataFrame:
    """Contests of one type starting on the given local date, cheap enough and large enough."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("start_utc"))
    return contests.withColumn("start_local", local).filter(
        (F.col("game_type") == game_type) & F.contains(F.col("name"), F.lit(word)) & (F.col("entry_fee") <= max_fee)
        & (F.col("max_entries") >= min_field) & (F.to_date("start_local") == today) & F.col("group_id").isNotNull()
    )


def contest_rollup(contests: DataFrame) -> DataFrame:
    """One row per group: counts, extremes and the name of the largest contest (lowest id on ties)."""
    largest = F.struct("max_entries", (-F.col("contest_id")).alias("i"))
    return contests.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("contest_count"), F.max("max_entries").alias("max_entries"), F.sum("entries").alias("total_entries"),
        F.max("prize_pool").alias("max_prize_pool"), F.min("start_utc").alias("lock_time"), F.max_by("name", largest).alias("name"),
    )


def qualifying_slates(contests: DataFrame, today: Column, min_field: int = 5000, **rules) -> DataFrame:
    zone = rules.get("zone", "America/New_York")
    out = contest_rollup(qualifying_contests(contests, today, min_field=min_field, **rules)).filter(F.col("max_entries") >= min_field)
    local = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("lock_time")), "hh:mm a")
    return out.withColumn("lock_time_local", F.concat(local, F.lit(" ET"))).orderBy(F.col("max_entries").desc(), "group_id")


# --- pool summaries and snapshots


def slate_summary(players: DataFrame) -> DataFrame:
    """Date, games, teams and head counts of a parsed slate (games and teams are bounded by the schedule)."""
    return players.agg(
        F.min("game_date").alias("slate_date"), F.array_sort(F.collect_set("game_info")).alias("games"),
        F.array_sort(F.collect_set("team")).alias("teams"), F.count(F.lit(1)).alias("player_count"),
        F.count_if(F.col("is_pitcher")).alias("pitcher_count"), F.count_if(~F.col("is_pitcher")).alias("hitter_count"),
    )


def slate_start(players: DataFrame) -> DataFrame:
    """Earliest date and local start text of a slate, from its game texts."""
    minutes = F.unix_seconds(F.try_to_timestamp(F.regexp_replace("game_time_et", r"\s*[A-Z]{2,3}$", ""), F.lit("hh:mma")))
    return players.agg(F.min(F.struct("game_date", minutes.alias("m"), "game_time_et")).alias("_s")).select("_s.game_date", "_s.game_time_et")


def team_ids(players: DataFrame) -> DataFrame:
    """Distinct team codes of a pool that have a numeric id."""
    ids = {v: k for k, v in S.TEAM_ID.items()}
    out = players.select(code("team").alias("team")).distinct().withColumn("team_id", lookup("team", ids))
    return out.filter(F.col("team_id").isNotNull())


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Added, removed and changed rows between two snapshots."""
    b = before.select(*keys, *[F.col(v).alias(f"before_{v}") for v in values], F.lit(True).alias("_b"))
    a = after.select(*keys, *[F.col(v).alias(f"after_{v}") for v in values], F.lit(True).alias("_a"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~same, "changed")
    out = b.join(a, list(keys), "full_outer").withColumn("change", kind)
    return out.filter(F.col("change").isNotNull()).drop("_a", "_b")


def map_signature(df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent fingerprint of a key/value table (of each group of ``by``), for change detection.

    Row digests are cut into four numbers that are summed, so the table is never gathered.
    """
    pair = F.concat_ws("\u0001", F.col(key).cast("string"), F.col(value).cast("string"))
    part = lambda i: F.conv(F.substring(F.md5(pair), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(i)).cast("string"), F.lit("0")) for i in range(4)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", *sums).alias("signature"))


def constraint_overlay(pool: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest user action per (slate, player) over the pool: a lock clears a ban and the reverse."""
    last = actions.groupBy("slate_id", "player_id").agg(
        F.max_by("action", "at").alias("_action"),
        F.max_by("max_exposure", F.when(F.col("max_exposure").isNotNull(), F.col("at"))).alias("_exp"),
    )
    out = pool.join(last, ["slate_id", "player_id"], "left")
    act = F.col("_action")
    return out.withColumns({
        "is_locked": F.when(act == "lock", True).when(act.isin("ban", "clear"), False).otherwise(F.col("is_locked")),
        "is_banned": F.when(act == "ban", True).when(act.isin("lock", "clear"), False).otherwise(F.col("is_banned")),
        "max_exposure": F.coalesce("_exp", "max_exposure") if "max_exposure" in pool.columns else F.col("_exp"),
    }).drop("_action", "_exp")


def anti_stack_summary(pool: DataFrame) -> DataFrame:
    """Pitchers with an opponent, and those whose opponent has hitters in the pool, per slate."""
    arms = pool.filter(F.col("is_pitcher") & F.col("opponent").isNotNull())
    bats = pool.filter(~F.col("is_pitcher")).select("slate_id", F.col("team").alias("opponent")).distinct().withColumn("_met", F.lit(1))
    out = arms.select("slate_id", "opponent").groupBy("slate_id", "opponent").agg(F.count(F.lit(1)).alias("_n")).join(bats, ["slate_id", "opponent"], "left")
    return out.groupBy("slate_id").agg(
        F.sum("_n").alias("pitchers"), F.coalesce(F.sum(F.when(F.col("_met") == 1, F.col("_n"))), F.lit(0)).alias("facing_hitters")
    )


def opponent(team: Column, home: Column, away: Column) -> Column:
    t, h, a = code(team), code(home), code(away)
    known = (t != "") & (h != "") & (a != "")
    return F.when(known & (t == h), a).when(known & (t == a), h)


def slot_index(pool: DataFrame) -> DataFrame:
    """Eligible (slot, player) rows; one row each instead of a list per slot, which would grow with the pool."""
    return pool.select("slate_id", F.explode("position_eligibility").alias("slot"), "player_id")


