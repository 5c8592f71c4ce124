"""Merkle manifest of a document table with an inclusion proof for every row, by pointer jumping.

Every row is a leaf: the hash of its fields. Leaves of a group (source) ascend by id; every ``arity`` consecutive nodes become
their parent until one is left, the group's root. Group roots, ordered by group (null first, then bytewise), likewise give the
root of the table. ``H`` is the lowercase hex SHA-256 of the concatenated inputs, digests as hex text.

Positions come from one range sort and the counts of its runs. Each level is one grouping by parent, so no group, however
large, is one task. Proofs are found by pointer jumping: every node holds the siblings on its way to an ancestor; joining the
table with itself doubles the distance and appends the ancestor's own segment, until all reach the root. Ancestors that
stand over a thousandth or more of all leaves would be hot join keys; of these there are at most a thousand a level, so they are
broadcast, and all others are joined by shuffling. Tables of former rounds are deleted.

Null fields are ``-``, empty texts ``0:``; rows without an id come first in their group; rows equal in group and id are ordered by leaf and
repeated rows are leaves of their own. A group of one row has its leaf as root. An empty table gives an empty result. Texts
of any length are hashed whole and read once. Extra columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node over this share of all leaves, or more, is broadcast as a join key; at most ``HEAVY`` nodes of a level are.
HEAVY = 1000
_POWERS = 40
_ROW = (1 << 33) - 1


def leaf_hash(columns):
    """``H`` of the values, each as ``-`` if null, else its byte count, ``:`` and its text."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _height(n, arity: int):
    """Levels above ``n`` leaves: how many powers of the arity are below ``n``."""
    return F.size(F.filter(F.array(*[F.lit(arity**k) for k in range(_POWERS) if arity**k < 1 << 62]), lambda x: x < n))


def _placed(rows: DataFrame, store: Scratch, arity: int) -> tuple[DataFrame, int, int]:
    """Rows ``(known, name, id, leaf, fake)`` with group number ``t``, position ``p`` and ``height`` of the group; groups, rows."""
    order = ["known", "name", F.asc_nulls_first("id"), "leaf", "seq"]
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("seq").withColumn("at", F.monotonically_increasing_id())
    rows = store(rows, "merkle-rows").withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit(_ROW))})
    runs = store(rows.groupBy("part", "known", "name").agg(F.min("at").alias("start"), F.count("*").alias("n")), "merkle-runs")
    names = runs.groupBy("known", "name").agg(F.min("start").alias("start"), F.sum("n").alias("all"))
    names = names.withColumn("part", F.shiftright("start", 33))
    # group number: groups that begin in earlier parts, then the order within the part
    parts = names.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))  # a row per partition
    names = names.join(parts.select("part", "before"), "part")
    names = names.withColumn("t", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1)
    names = store(names.select("known", "name", "t", _height(F.col("all"), arity).alias("height")), "merkle-groups")
    earlier = F.sum("n").over(Window.partitionBy("known", "name").orderBy("part")) - F.col("n")
    runs = runs.withColumn("earlier", earlier).join(names, ["known", "name"])
    rows = rows.join(runs.select("part", "known", "name", "start", "earlier", "t", "height"), ["part", "known", "name"])
    rows = rows.withColumn("p", F.col("at") - F.col("start") + F.col("earlier"))
    groups, total = names.count(), runs.agg(F.sum("n")).first()[0] or 0
    return store(rows.select("id", "t", "p", "height", "leaf", "fake"), "merkle-leaves"), groups, total


def _levels(leaves: DataFrame, top: int, store: Scratch, arity: int) -> list[DataFrame]:
    """One table a level of ``(t, l, p, height, kids, h, w)``: nodes with their children and the leaves below them."""
    out, now = [], leaves
    for k in range(top):
        now = now.where(F.col("height") > k).groupBy("t", "height", F.expr(f"p div {arity}").alias("q")).agg(
            *[F.max(F.when(F.col("p") % arity == i, F.struct("h", "own"))).alias(f"c{i}") for i in range(arity)], F.sum("w").alias("w")
        )
        kids = F.array(*[f"c{i}" for i in range(arity)])
        now = now.select("t", F.lit(k + 1).alias("l"), F.col("q").alias("p"), "height", kids.alias("kids"), "w")
        now = now.withColumn("h", F.sha2(F.array_join(F.transform("kids", lambda x: x["h"]), ""), 256)).withColumn("own", F.lit(None).cast(leaves.schema["own"].dataType))
        now = store(now, "merkle-level")
        out.append(now)
    return out


def _steps(level: DataFrame, arity: int) -> DataFrame:
    """Children of a level's nodes as ``(own, t, l, p, w, at, path)``: one step up, with the siblings to the left and right."""
    digests = F.transform("kids", lambda x: x["h"])
    rows = level.select("t", "l", "p", "height", digests.alias("all"), F.posexplode("kids").alias("i", "kid")).where("kid is not null")
    # of a child of 3 the left ones are before its place, the right ones after it
    side = lambda first, size: F.array_join(F.slice("all", first, size), "")
    step = F.struct(side(F.lit(1), F.col("i")).alias("left"), side(F.col("i") + 2, F.lit(arity) - F.col("i") - 1).alias("right"))
    return rows.select(
        F.col("kid.own").alias("own"), "t", (F.col("l") - 1).alias("l"), (F.col("p") * arity + F.col("i")).alias("p"),
        _node(F.col("t"), F.col("l"), F.col("p"), F.col("height")).alias("at"), F.array(step).alias("path"),
    )


def _node(t, l, p, height):  # noqa: E741
    """Name of a node; the root of a group is a leaf of the tree of groups, number -1."""
    group_root = (t >= 0) & (l == height)
    return F.struct(
        F.when(group_root, F.lit(-1)).otherwise(t).cast("long").alias("t"), F.when(group_root, F.lit(0)).otherwise(l).cast("int").alias("l"),
        F.when(group_root, t).otherwise(p).cast("long").alias("p"),
    )


def _jump(rows: DataFrame, heavy: DataFrame, light: DataFrame, root) -> DataFrame:
    """Every row of ``rows`` that is not at the root moves on to where its ancestor points."""
    def moved(by):
        both = rows.where(F.col("at") != root).join(by, F.col("at") == F.col("target"))
        return both.select(*[c for c in rows.columns if c not in ("at", "path")], F.col("up").alias("at"), F.concat("path", "more").alias("path"))

    return rows.where(F.col("at") == root).unionByName(moved(F.broadcast(heavy))).unionByName(moved(light))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields=FIELDS, tampered: dict | None = None, arity: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, ``fake``, ``subroot``, ``root`` and ``path``, an array of ``(left, right)``
    texts of sibling digests from the leaf upwards. ``fake`` is the leaf with the columns of ``tampered`` (expressions by name) in place of the fields.
    """
    store = Scratch()
    columns = [F.col(c) for c in fields]
    fake = leaf_hash([(tampered or {}).get(c, F.col(c)) for c in fields])
    rows = docs.select(
        F.col(group_col).isNotNull().alias("known"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("name"), F.col(id_col).alias("id"),
        leaf_hash(columns).alias("leaf"), fake.alias("fake"),
    )
    leaves, groups, total = _placed(rows, store, arity)
    own = F.struct("id", "leaf", "fake", F.col("height").alias("levels"))
    leaves = leaves.select("t", F.lit(0).alias("l"), "p", "height", F.col("leaf").alias("h"), own.alias("own"), F.lit(1).cast("long").alias("w"))
    top = leaves.agg(F.max("height")).first()[0] or 0
    below = _levels(leaves, top, store, arity)
    roots = leaves.where("height = 0")
    for level in below:
        roots = roots.unionByName(level.where("l = height").drop("kids"))
    highest = next(k for k in range(_POWERS) if arity**k >= max(1, groups))
    none = F.lit(None).cast(leaves.schema["own"].dataType)
    roots = roots.select(F.lit(-1).cast("long").alias("t"), F.lit(0).alias("l"), F.col("t").alias("p"), F.lit(highest).alias("height"), "h", none.alias("own"), "w")
    roots = store(roots, "merkle-roots")
    above = _levels(roots, highest, store, arity)
    last = (above[-1] if above else roots).select("h").first()
    root = F.struct(F.lit(-1).cast("long").alias("t"), F.lit(highest).cast("int").alias("l"), F.lit(0).cast("long").alias("p"))

    # a group of one leaf: the leaf is the group's root, on the way no step has been taken yet
    alone = leaves.where("height = 0").select("own", _node(F.col("t"), F.col("l"), F.col("p"), F.col("height")).alias("at"))
    steps = [_steps(level, arity) for level in below + above]
    empty = F.array().cast("array<struct<left:string,right:string>>")
    proofs = alone.withColumn("path", empty)
    for s in steps[:1] if below else []:
        proofs = proofs.unionByName(s.select("own", "at", "path"))
    weights = roots.select("t", "l", "p", "w")
    for level in below + above:
        weights = weights.unionByName(level.select("t", "l", "p", "w"))
    nodes = None
    for s in steps[1:] if below else steps:
        nodes = s if nodes is None else nodes.unionByName(s)
    if nodes is None:  # one step at most
        nodes = proofs.limit(0).select(F.col("at.t").alias("t"), F.col("at.l").alias("l"), F.col("at.p").alias("p"), "at", "path")
    nodes = nodes.select("t", "l", "p", "at", "path").join(weights, ["t", "l", "p"])
    nodes = nodes.select(F.struct(F.col("t").cast("long").alias("t"), F.col("l").cast("int").alias("l"), F.col("p").cast("long").alias("p")).alias("node"), "w", "at", "path")
    proofs, nodes, old = store(proofs, "merkle-proofs"), store(nodes, "merkle-nodes"), []
    while proofs.where(F.col("at") != root).limit(1).count():
        fresh = Scratch()
        by = nodes.select(F.col("node").alias("target"), F.col("at").alias("up"), F.col("path").alias("more"), "w")
        heavy, light = by.where(F.col("w") * HEAVY >= total).drop("w"), by.where(F.col("w") * HEAVY < total).drop("w")
        proofs, nodes = fresh(_jump(proofs, heavy, light, root), "merkle-proofs"), fresh(_jump(nodes, heavy, light, root), "merkle-nodes")
        for s in old:
            s.clear()
        old = [fresh]
    up = lambda path: F.aggregate(path, F.col("own.leaf"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = proofs.select(
        F.col("own.id").alias(id_col), F.col("own.leaf").alias("leaf"), F.col("own.fake").alias("fake"),
        up(F.slice("path", F.lit(1), F.col("own.levels"))).alias("subroot"), F.lit(last[0] if last else None).cast("string").alias("root"), "path",
    )
    (old[0] if old else store).release(proofs)  # the result reads this table
    for s in [*old, store]:
        s.clear()
    return out


def folded(leaf: str, path: str = "path"):
    """The root to which a leaf and its siblings lead."""
    return F.aggregate(path, F.col(leaf), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(path: str = "path"):
    """``H`` of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
