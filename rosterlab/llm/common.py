"""Helpers shared by the text operators: written tables in the shared folder and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlab.session import new_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    return written_at(df, label, **options)[0]


def written_at(df: DataFrame, label: str, **options) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_dir(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # nothing reads the shuffle files once the table is written
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Written tables that go together once a result no longer reads them: ``scratch(df, label)``, then ``clear()``."""

    def __init__(self):
        self.tables: list[tuple] = []

    def __call__(self, df: DataFrame, label: str, **options) -> DataFrame:
        table, path = written_at(df, label, **options)
        self.tables.append((table, path))
        return table

    def release(self, table: DataFrame) -> None:
        """Take a table that is still read out of those that go."""
        self.tables = [t for t in self.tables if t[0] is not table]

    def hand_over(self, table: DataFrame, other: Scratch) -> None:
        """Let ``table`` go with those of ``other`` instead."""
        other.tables += [t for t in self.tables if t[0] is table]
        self.release(table)

    def clear(self) -> None:
        for table, path in self.tables:
            forget(table.sparkSession, path)
        self.tables.clear()


def forget(spark, path: str) -> None:
    """Delete a table of this run that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Most rows of a side that is broadcast after counting; larger ones are joined by shuffling.
SMALL = 1_000_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def heavy_join(rows: DataFrame, side: DataFrame, key: str, weight: str, parts: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``side``, one row a key, ``weight`` telling how many of ``rows`` it meets.

    Keys that meet a thousandth of all or more would be one task each; there are at most ``parts`` of them, so they are broadcast.
    """
    low = (side.agg(F.sum(weight)).first()[0] or 0) / parts
    heavy, light = F.broadcast(side.where(F.col(weight) >= low)), side.where(F.col(weight) < low)
    rest = rows.join(F.broadcast(side.where(F.col(weight) >= low).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key))


def as_text(column) -> F.Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))


EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """Connected components of the links ``(a, b)``: one row ``(node, root)`` per linked node, root the smallest node reached.

    Alternates large-star and small-star steps, so that the number of rounds grows with the logarithm of a component's
    size. Every round is a written table; the one before is deleted. Loops and repeated links are allowed; nulls are
    ignored. Only counts and a checksum reach the driver. More than ``limit`` rounds raise an error.
    """
    spark = edges.sparkSession
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    now, path = written_at(links, "links")
    seen = _state(now)
    for _ in range(limit):
        if seen[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), F.col("u").alias("y"), "m")
        small = small.select("m", F.explode(F.array("x", "y")).alias("u")).where("u <> m").select("u", F.col("m").alias("v")).distinct()
        after, fresh = written_at(small, "links")
        state = _state(after)
        if state == seen:
            forget(spark, fresh)
            break
        forget(spark, path)
        now, path, seen = after, fresh, state
    else:
        raise RuntimeError(f"components: no end after {limit} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def linked(rows: DataFrame, similarity: float, store: Scratch, verified, near: int = 15, full: int = 1000, apart=None, more: DataFrame | None = None, inside=None) -> DataFrame:
    """Links ``(a, b)`` that connect the keys of ``rows`` exactly as all pairs that share a block and that ``verified`` keeps would.

    ``rows`` is a written table ``(key, size, bits, blocks)``; ``verified`` takes pairs ``(a, b)`` and returns those that are links. First the rows
    near each other in a block meet (``meetings``). The links found tell which rows of a block are one group already; all others
    of the block then meet too, whatever its size (``others``). Pairs with sizes not within ``similarity``, or for which ``apart`` (of two structs
    of size and bits) holds, are left out in both. ``more`` are further pairs to verify. ``inside``, if given, is what ``verified`` does in a form
    that ``others`` applies while rows meet, so that its pairs are never written: a function from a table of keys to their columns to compare, and a
    test of two structs of these columns.
    """
    inner = Scratch()
    pairs, large = meetings(rows, similarity, inner, near, full, apart)
    if more is not None:
        pairs = inner(pairs.union(more.select("a", "b")).distinct(), "pairs")
    first = store(verified(pairs), "links-near")
    if not large.limit(1).count():
        inner.clear()
        return first
    roots = components(first)
    if inside is not None:
        found = others(large, roots, similarity, inner, full, apart, inside)
        links = store(first.unionByName(found), "links-found") if found.limit(1).count() else first
        inner.clear()
        return links
    rest = inner(others(large, roots, similarity, inner, full, apart).join(pairs, ["a", "b"], "left_anti"), "pairs-others")
    links = store(first.unionByName(verified(rest)), "links-found") if rest.limit(1).count() else first
    inner.clear()
    return links


def meetings(rows: DataFrame, similarity: float, store: Scratch, near: int = 15, full: int = 1000, apart=None) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``(a, b)`` of keys that share a block, near each other in it, and the rows of blocks with more pairs than these.

    In a block, ordered by size and ``bits`` (a sketch of the row, or null), each row meets the ``near`` rows before it, which is all of them in
    small blocks. A block of more than ``full`` rows is cut by bits of the sketch or key, others for each block, so that no block is one task.
    In blocks with more rows than a row has neighbours, every row also meets the one whose blocks hold most rows, the centre of a group
    whose members are less like each other. The other pairs of these blocks, whose rows ``(block, key, size, bits)`` are returned, are left to ``others``.
    """
    counts = store(rows.select(F.explode("blocks").alias("block")).groupBy("block").count().where("count > 1"), "block-counts")
    met = rows.select("key", F.explode("blocks").alias("block")).join(counts, "block").join(rows.select("key", "size", "bits"), "key")
    depth = F.when(F.col("count") > full, F.ceil(F.log2(F.col("count") / full)).cast("int")).otherwise(0)
    cut = F.when(depth > 0, _bits_of(F.coalesce("bits", "key"), F.col("block"), depth)).otherwise(F.lit(0).cast("long"))
    met = store(met.select("block", "count", cut.alias("cut"), "key", "size", "bits"), "meetings")
    row = F.struct("key", "size", "bits")
    order = Window.partitionBy("block", "cut").orderBy("size", "bits", "key")
    before = F.array(*[F.lag(row, k).over(order) for k in range(1, near + 1)])
    pairs = met.select(row.alias("x"), before.alias("near")).select("x", F.explode("near").alias("y"))
    large = met.where(F.col("count") > near + 1)
    if large.limit(1).count():
        weights = large.groupBy("key").agg(F.sum("count").alias("weight"))
        centres = large.join(weights, "key").groupBy("block").agg(F.max_by(row, F.struct("weight", "key")).alias("y"), F.count("*").alias("n"))
        pairs = pairs.unionByName(heavy_join(large, store(centres, "centres"), "block", "n").select(row.alias("x"), "y"))
    pairs = pairs.where(_alike(similarity, apart) & (F.col("x.key") != F.col("y.key")))
    return store(_pair(pairs).distinct(), "pairs"), large.select("block", "key", "size", "bits")


def others(large: DataFrame, roots: DataFrame, similarity: float, store: Scratch, full: int = 1000, apart=None, inside=None) -> DataFrame:
    """Distinct pairs ``(a, b)`` of all rows ``(block, key, size, bits)`` that share a block and are not in one group of ``roots`` yet.

    The rows of a block are dealt into groups of about ``full`` by a hash, and every two groups are one unit of work, so a block of any size is
    compared whole without being one task. Blocks whose rows are one group need nothing more. With ``inside`` (see ``linked``) only pairs that pass
    its test leave the join; it is asked once for a pair, in the least block that the two share.
    """
    known = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = store(known, "known")
    several = known.groupBy("block").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    several = store(several.select("block", F.ceil(F.col("n") / full).cast("int").alias("groups")), "several")
    dealt = known.join(small(several), "block").withColumn("group", F.pmod(F.xxhash64("key", "block"), F.col("groups")).cast("int"))
    columns, test = ["key", "size", "bits", "root"], F.lit(True)
    if inside is not None:
        dealt = store(dealt, "dealt")
        side = inside[0](dealt.select("key")).join(dealt.groupBy("key").agg(F.collect_set("block").alias("shared")), "key")
        columns += [c for c in side.columns if c != "key"]
        dealt = dealt.join(side, "key")
        least = F.array_min(F.array_intersect("x.shared", "y.shared")) == F.col("block")
        test = least & inside[1](F.col("x"), F.col("y"))
    row = F.struct(*columns)
    x = dealt.select("block", F.col("group").alias("g"), F.explode(F.sequence(F.lit(0), F.col("group"))).alias("h"), row.alias("x"))
    y = dealt.select("block", F.explode(F.sequence(F.col("group"), F.col("groups") - 1)).alias("g"), F.col("group").alias("h"), row.alias("y"))
    once = (F.col("g") > F.col("h")) | (F.col("x.key") > F.col("y.key"))
    pairs = x.join(y.hint("merge"), ["block", "g", "h"]).where(once & (F.col("x.root") != F.col("y.root")) & _alike(similarity, apart) & test)
    return store(_pair(pairs).distinct(), "pairs-all")


def _alike(similarity: float, apart) -> F.Column:
    """Whether the structs ``x`` and ``y`` have sizes within ``similarity`` and are not ``apart``."""
    alike = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * similarity - 1e-9
    return alike if apart is None else alike & ~F.coalesce(apart(F.col("x"), F.col("y")), F.lit(False))


def _pair(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b"))


def _bits_of(value, block, depth):
    """``depth`` bits of ``value``, other ones for each block."""
    out = F.lit(0).cast("long")
    for k in range(30):
        at = F.pmod(F.xxhash64(block, F.lit(k)), F.lit(64)).cast("int")
        out = out.bitwiseOR(F.when(depth > k, F.shiftleft(F.call_function("getbit", value, at).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return out


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
