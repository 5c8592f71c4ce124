"""Exact duplicates through an extendible-hash index kept in shared files.

Each text, without its white space, has a 64-bit hash; an index entry goes to the bucket named by the hash's leading
bits. The directory starts at one bucket. As long as a bucket holds more distinct hashes than ``capacity``, it is split
by one more bit, which doubles the directory where it has no such bit yet; equal hashes stay together and
form a chain. Splitting needs only the counts of hash prefixes. The entries are then written once, clustered by bucket, to
files in the shared folder. Owner tasks take ranges of buckets, chain the entries of one hash and compare the bytes of the
texts where a chain has more than one entry. Counts of a chain are combined before they are shuffled, so a third of all
rows in one chain is one partial row per task.

Null texts count as empty. Of equal texts the row with the most code points in its original text stays, then the one with
the smallest id (null ids last), so equal rows share one result. Extra columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, written

#: Distinct hashes of a bucket before it is split.
CAPACITY = 50_000
#: Bits of the hash by which buckets may be named.
MOST_BITS = 16
_SPACE = " \t\n\x0b\x0c\r"


def normalised(text):
    """The text without ASCII white space."""
    out = text
    for c in _SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def directory(hashes: DataFrame, column: str = "hash", capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Buckets as ``(local depth, prefix)``, in the order of their key ranges.

    Counts the distinct hashes under each prefix of ``most_bits`` bits (at most 2**most_bits rows reach the driver) and
    splits from the top. A prefix that is still too full at the last bit keeps one bucket of chains in several files.
    """
    prefix = F.shiftrightunsigned(F.col(column), 64 - most_bits)
    counts = {r["p"]: r["count"] for r in hashes.select(column).distinct().select(prefix.alias("p")).groupBy("p").count().collect()}
    totals = [counts]
    for _ in range(most_bits):  # totals[k]: by prefixes that are k bits shorter
        up: dict[int, int] = {}
        for p, n in totals[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        totals.append(up)
    open_, leaves = [(0, 0)], []
    while open_:
        depth, p = open_.pop()
        if totals[most_bits - depth].get(p, 0) > capacity and depth < most_bits:
            open_ += [(depth + 1, 2 * p), (depth + 1, 2 * p + 1)]
        else:
            leaves.append((depth, p))
    return sorted(leaves, key=lambda leaf: leaf[1] << (most_bits - leaf[0]))


def _bucket(column: str, leaves: list[tuple[int, int]], most_bits: int):
    """Number of the bucket of a hash: the leaves' lower ends are searched as a sorted array."""
    prefix = F.shiftrightunsigned(F.col(column), 64 - most_bits)
    lows = [p << (most_bits - depth) for depth, p in leaves]
    slots = [0] * (1 << max(d for d, _ in leaves))  # the directory proper: one entry per prefix of the global depth
    depth = max(d for d, _ in leaves)
    for i, low in enumerate(lows):
        end = lows[i + 1] if i + 1 < len(lows) else 1 << most_bits
        for s in range(low >> (most_bits - depth), end >> (most_bits - depth)):
            slots[s] = i
    at = F.shiftrightunsigned(prefix.cast("long"), most_bits - depth)
    return F.element_at(F.array(*[F.lit(x) for x in slots]), (at + 1).cast("int"))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> DataFrame:
    """The index entries ``(bucket, hash, id, n_chars, digest, body)``, written clustered by bucket and hash."""
    text = as_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n_chars"), normalised(text).alias("body"))
    rows = rows.withColumn("hash", F.xxhash64("body"))
    leaves = directory(rows, "hash", capacity, most_bits)
    rows = rows.select(_bucket("hash", leaves, most_bits).alias("bucket"), "hash", "id", "n_chars", F.sha2("body", 256).alias("digest"), "body")
    return written(rows.repartitionByRange("bucket", "hash", "id"), "hash-index")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of its class of equals."""
    entries = index(docs, id_col, text_col, capacity, most_bits)
    best = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("unknown"), F.col("id").alias("low"))
    chains = entries.groupBy("bucket", "hash", "digest").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
    # bytes are compared within chains of several entries: every body against the first of its digest
    several = chains.where("group_size > 1").select("hash", "digest")
    heads = entries.join(several, ["hash", "digest"], "left_semi").groupBy("hash", "digest").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    apart = heads.where("least <> most").select("hash", "digest")
    chains = chains.join(apart.withColumn("apart", F.lit(True)), ["hash", "digest"], "left")
    chains = chains.withColumn("group_size", F.when(F.col("apart"), F.raise_error("two texts share a SHA-256 digest")).otherwise(F.col("group_size")))
    keep = chains.select("hash", "digest", "group_size", F.col("best.low").alias("keep_id"))
    out = entries.select("hash", "digest", "id").join(keep, ["hash", "digest"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
