"""Entity resolution between pool names and a player register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import code
from ..functions.similarity import indel_ratio
from ..functions.text import first_last, token_sort
from ..session import checkpointed
from .ordered import first_row, prefix_sums, top_rows

THRESHOLD = 82.0


def name_register(event_names: DataFrame, register: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """One id per name: (name, register_id, normal_name).

    ``event_names(name, register_id)`` come first in ``priority`` order when that column exists; a register
    entry with the same name overrides them. Only register rows of ``players(register_id)`` count.
    """
    rank = F.col("priority") if "priority" in event_names.columns else F.lit(0)
    ev = event_names.select(F.trim("name").alias("name"), "register_id", (rank + 1).alias("_p")).filter((F.col("name") != "") & F.col("register_id").isNotNull())
    full = F.concat_ws(" ", F.trim("name_first"), F.trim("name_last"))
    both = (F.trim("name_first") != "") & (F.trim("name_last") != "") & F.col("key_mlbam").isNotNull()
    reg = register.filter(both).select(full.alias("name"), F.col("key_mlbam").alias("register_id"), F.lit(0).alias("_p"))
    if players is not None:
        reg = reg.join(players.select("register_id").distinct(), "register_id", "left_semi").select("name", "register_id", "_p")
    names = first_row(ev.unionByName(reg), ["name"], [F.col("_p"), F.col("register_id")])
    return names.select("name", "register_id", first_last("name").alias("normal_name"), F.col("_p").alias("source_rank"))


def normal_names(register: DataFrame) -> DataFrame:
    """One id per normalised name; register entries win over event names."""
    return first_row(register, ["normal_name"], [F.col("source_rank"), F.col("register_id")]).select("normal_name", "register_id")


def _max_distance(threshold: float, length: Column) -> Column:
    """Largest indel distance a string of this length can have to any partner at the threshold."""
    share = 1.0 - threshold / 100.0
    longest = F.floor(length * (2.0 / (1.0 - share) - 1.0) + 1e-9)
    return F.floor((length + longest) * share + 1e-9)


def _short(threshold: float, length: Column) -> Column:
    """Whether a partner at the threshold may share none of the string's two-letter pieces."""
    return length - 1 <= _max_distance(threshold, length) * 2


def _grams(text: Column, threshold: float) -> Column:
    """Two-letter pieces numbered by occurrence, plus single letters for strings that are short at the threshold."""
    n = F.length(text)

    def pieces(size: int) -> Column:
        last = n - (size - 1)
        raw = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
        raw = F.when(last >= 1, raw).otherwise(F.array().cast("array<string>"))
        seen = lambda g, i: F.size(F.filter(F.slice(raw, 1, i + 1), lambda x: x == g)).cast("string")
        return F.transform(raw, lambda g, i: F.concat(g, F.lit(f"\u0001{size}\u0001"), seen(g, i)))

    single = F.when(_short(threshold, n), pieces(1)).otherwise(F.array().cast("array<string>"))
    return F.concat(pieces(2), single)


def similar_names(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of distinct strings with indel similarity of at least ``threshold``.

    Both frames have one column ``key``. Similar strings must share one of their rarest two-letter pieces: at
    distance d at most 2 d pieces differ, so comparing each string's 2 d + 1 rarest pieces loses no
    pair. Rarest-first keeps common pieces, and with them large join groups, out of the join. Where a string has
    no more than 2 d pieces, all of them and its single letters are compared, of which similar strings share one at
    any threshold above 0; a low threshold makes every string such a one.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be above 0 and at most 100")
    l, r = left.select("key").filter(F.col("key") != "").distinct(), right.select("key").filter(F.col("key") != "").distinct()
    gl, gr = (d.select("key", F.explode(_grams(F.col("key"), threshold)).alias("gram")) for d in (l, r))
    weight = gl.unionByName(gr).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def rarest(g: DataFrame, name: str) -> DataFrame:
        n = F.length("key")
        limit = F.when(_short(threshold, n), n * 2).otherwise(_max_distance(threshold, n) * 2 + 1)
        w = Window.partitionBy("key").orderBy("n", "gram")  # as many rows as the string has letters
        ranked = g.join(weight, "gram").withColumn("_r", F.row_number().over(w))
        return ranked.filter(F.col("_r") <= limit).select("gram", F.col("key").alias(name))

    a, b = F.length("_l"), F.length("_r")
    close = F.least(a, b) * 200.0 >= (a + b) * F.lit(float(threshold)) - 1e-9
    pairs = rarest(gl, "_l").join(rarest(gr, "_r"), "gram").filter(close).select("_l", "_r").distinct()
    scored = pairs.select(F.col("_l").alias("left_key"), F.col("_r").alias("right_key"), indel_ratio("_l", "_r").alias("score"))
    return scored.filter(F.col("score") >= threshold)


def exact_cascade(pool: DataFrame, register: DataFrame) -> DataFrame:
    """``register_id`` by exact name, else by exact normalised name, with ``how``; others NULL."""
    raw = register.select(F.col("name").alias("_raw"), F.col("register_id").alias("_id_raw"))
    norm = normal_names(register).select(F.col("normal_name").alias("_norm"), F.col("register_id").alias("_id_norm"))
    clean = F.trim("name")
    out = pool.join(raw, clean == F.col("_raw"), "left").join(norm, clean == F.col("_norm"), "left")
    return out.withColumns({
        "register_id": F.coalesce("_id_raw", "_id_norm"),
        "how": F.when(F.col("_id_raw").isNotNull(), "exact").when(F.col("_id_norm").isNotNull(), "normalised"),
    }).drop("_raw", "_id_raw", "_norm", "_id_norm")


def candidates(names: DataFrame, register: DataFrame, threshold: float = THRESHOLD, limit: int | None = 5) -> DataFrame:
    """Best ``limit`` register names per pool name (None: all): (name, candidate, register_id, score, place)."""
    mine = names.select(F.trim("name").alias("name")).distinct().withColumn("left_key", token_sort("name"))
    known = normal_names(register).withColumn("right_key", token_sort("normal_name"))
    pairs = similar_names(mine.select(F.col("left_key").alias("key")), known.select(F.col("right_key").alias("key")), threshold)
    rows = mine.join(pairs, "left_key").join(known, "right_key").select("name", F.col("normal_name").alias("candidate"), "register_id", "score")
    order = [F.col("score").desc(), F.col("candidate")]
    if limit is None:
        return prefix_sums(rows, ["name"], order, out="place")
    return top_rows(rows, ["name"], order, limit, rank="place")


def same_team(mine: Column, theirs: Column) -> Column:
    """Team codes match when either contains the other; empty codes never do."""
    return (mine != "") & (theirs != "") & (F.contains(theirs, mine) | F.contains(mine, theirs))


def pick_by_team(names: DataFrame, cands: DataFrame, teams: DataFrame) -> DataFrame:
    """One candidate per (name, team): the best one of the player's team, else the best one."""
    mine = names.select(F.trim("name").alias("name"), code("team").alias("team")).distinct()
    theirs = teams.select("register_id", code("team").alias("_their_team"))
    rows = mine.join(cands, "name").join(theirs, "register_id", "left").withColumn("_their_team", F.coalesce("_their_team", F.lit("")))
    match = same_team(F.col("team"), F.col("_their_team")).cast("int")
    return first_row(rows.withColumn("team_match", match), ["name", "team"], [F.col("team_match").desc(), F.col("place")]).drop("_their_team")


def resolve_players(pool: DataFrame, register: DataFrame, teams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pool rows with ``register_id`` (NULL when unmatched) and ``how`` (exact, normalised, similar).

    The similarity step sees each distinct unmatched name once, however many rows carry it.
    """
    register = checkpointed(register)  # read five times below; names only
    exact = exact_cascade(pool, register)
    open_ = exact.filter(F.col("register_id").isNull()).select("name", "team").distinct()
    chosen = pick_by_team(open_, candidates(open_, register, threshold), teams)
    chosen = chosen.select(F.col("name").alias("_n"), F.col("team").alias("_t"), F.col("register_id").alias("_id"))
    need = F.when(F.col("register_id").isNull(), F.trim("name"))
    out = exact.join(chosen, (need == F.col("_n")) & (code("team") == F.col("_t")), "left")
    return out.withColumns({
        "how": F.when(F.col("register_id").isNull() & F.col("_id").isNotNull(), "similar").otherwise(F.col("how")),
        "register_id": F.coalesce("register_id", "_id"),
    }).drop("_n", "_t", "_id")
