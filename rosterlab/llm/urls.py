"""URL rules by host suffix and path prefix, matched through hashed expressions.

A URL becomes expressions, each a suffix of its host at a dot joined with a prefix of its path that ends in a slash (or
is empty). A rule becomes one such expression, its host with its path up to the last slash. Both sides meet in an
equi-join on the first 32 bits of the expression's digest; then the full digest must agree, and the path must start with
the rule's whole path. Of the rules that fit, the longest wins (host and path together), then the longer host, then
block before allow, then the smaller path. Without a fitting rule a URL gets the default verdict.

The host stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path
runs from there to ``?``, ``#`` or the end. A null URL, or one without ``://``, has neither and fits only rules without a
host. Each distinct host and path is judged once, so a host or URL that many rows share costs one row. Extra columns
pass through; ``host``, ``path``, ``rule`` and ``verdict`` must not exist yet. Built of DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that make the join key: 32 bits.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple:
    """Columns of the host and the path of a URL column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(urls: DataFrame, labels: int, depth: int) -> DataFrame:
    """Rows ``(host, path, key, digest)``: the expressions of each distinct ``(host, path)``, with at most so many host labels and
    path parts, since longer ones match no rule: very long paths and hosts cost no more than their length."""
    names = F.split("host", r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.greatest(F.lit(1), F.size(names) - (labels - 1)), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    )
    parts = F.split("path", "/", depth + 1)  # what follows the last part that counts stays whole
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )
    rows = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    rows = rows.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    rows = rows.withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
    return rows.select("host", "path", F.substring("digest", 1, SHORT).alias("key"), "digest")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (its host and path, or null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (block or allow); null hosts and paths count as empty, and the letter
    case of a rule's host does not matter.
    """
    taken = {"host", "path", "rule", "verdict"} & set(pages.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    host, path = host_and_path(F.col(url_col))
    placed = pages.withColumns({"host": host, "path": path})
    rule = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).distinct()
    rule = rule.withColumn("r_digest", _digest(F.col("r_host"), F.regexp_extract("r_path", r"^(?s)(.*/)?", 0)))
    rule = rule.withColumn("key", F.substring("r_digest", 1, SHORT))
    rank = F.struct(
        F.length(F.concat("r_host", "r_path")).alias("long"), F.length("r_host").alias("longer_host"), (F.col("r_verdict") == "block").alias("block"), F.col("r_path").alias("p")
    )
    longest = rule.agg(F.max(F.size(F.split("r_host", r"\.", -1))), F.max(F.size(F.split("r_path", "/", -1)))).first()
    hits = expressions(placed.select("host", "path").distinct(), longest[0] or 1, max(0, (longest[1] or 1) - 1)).join(rule, "key")
    hits = hits.where((F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("hit"))
    out = placed.join(best, ["host", "path"], "left")
    return out.select(*pages.columns, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
