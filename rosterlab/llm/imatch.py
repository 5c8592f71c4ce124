"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency, ``log2(documents / documents with the term)``, lies in a
band. A text's distinct terms of the lexicon are sorted and hashed once for each of several random subsets of the
lexicon. Subsets come in levels: the ``SUBSETS`` subsets of a level keep one term in ``2**bits`` each, so texts of any length
have levels at which a subset meets about one of their terms. The likeness of two fingerprints is the greatest share
over levels of equal, non-empty hashes among the subsets that meet either text; it is 1 for equal fingerprints.

The lexicon does not grow with the number of documents: a term in the band occurs in at least ``2**-high`` of them, so
there are at most (distinct terms per document) * 2**high. It is broadcast only if its counted size is below
``LEXICON``, else joined by shuffling. A text without lexicon terms is hashed over all of its terms instead. Terms
are runs between ASCII white space and punctuation, lower-cased.

Nulls count as empty texts, with an empty fingerprint of their own. Extra columns are ignored. The id must be numeric;
rows without one come first. "The next document" follows in the order of id, then text; after the last comes the first,
and a single document is its own next. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, written

#: Band of inverse document frequencies in bits.
BAND = (3.0, 10.0)
#: Bits of each level, and subsets of a level.
LEVELS, SUBSETS = (1, 3, 5, 7, 9), 8
#: Most terms of a lexicon that is broadcast: 16 MB of hashes.
LEXICON = 2_000_000
#: Bytes of text in one range of ids.
RANGE = 8 << 20
_SPLIT = r"[\s\p{Punct}]+"


def terms(text):
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Term hashes ``t`` in the band, counted over all documents; a written table."""
    total = docs.count()
    df = docs.select(F.explode(terms(as_text(text_col))).alias("t")).groupBy("t").count()
    idf = F.log2(F.lit(float(max(total, 1))) / F.col("count"))
    return written(df.where(idf.between(*band)).select("t"), "lexicon")


def _within(mask: int, value: int):
    return lambda t: t.bitwiseAND(F.lit(mask)) == F.lit(value)


def _signatures(found):
    """Hashes of the sorted terms of every subset, 0 where a subset meets none. ``found`` is a sorted array of hashes."""
    out, at = [], 0
    for bits in LEVELS:
        for s in range(SUBSETS):
            # a window of the term's hash must show a pattern; windows differ between subsets and levels
            shift, pattern = (at * 7) % (64 - bits), (s * 5 + at) % (1 << bits)
            mask = ((1 << bits) - 1) << shift
            value = pattern << shift
            mask, value = (x - (1 << 64) if x >> 63 else x for x in (mask, value))
            own = F.filter(found, _within(mask, value))
            out.append(F.when(F.size(own) == 0, F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(F.array_join(own.cast("array<string>"), ",")), 32).cast("long").bitwiseOR(F.lit(1))))
            at += 1
    return F.array(*out)


def likeness(a, b):
    """Share of equal subsets at the best level, of two signature arrays; 1 for equal ones."""
    shares = []
    for i in range(len(LEVELS)):
        pair = F.arrays_zip(F.slice(a, i * SUBSETS + 1, SUBSETS).alias("x"), F.slice(b, i * SUBSETS + 1, SUBSETS).alias("y"))
        met = F.size(F.filter(pair, lambda p: (p["x"] != 0) | (p["y"] != 0)))
        same = F.size(F.filter(pair, lambda p: (p["x"] != 0) & (p["x"] == p["y"])))
        # at a level that meets few subsets, an equal one says little
        shares.append(F.when(met > 0, same / F.greatest(met, F.lit(SUBSETS // 2))).otherwise(F.lit(0.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*shares))


def as_hex(signatures):
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _ranges(docs: DataFrame, id_col: str, text_col: str) -> list:
    """Ascending lower ends of id ranges of about ``RANGE`` bytes of text; at most 1000 values reach the driver."""
    cuts = F.percentile_approx(id_col, [i / 1000 for i in range(1, 1000)], 10_000)
    got = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), cuts.alias("cuts")).first()
    n = min(1000, -(-(got["bytes"] or 0) // RANGE))
    return sorted({got["cuts"][1000 * i // n - 1] for i in range(1, n)}) if got["cuts"] and n > 1 else []


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(range, seq, guest, id, text, next_text)``, hash-partitioned by ``range`` and in order of ``seq``.

    Every range also holds a guest, the first row of the range after it (of the first range, after the last), so each
    row finds its successor inside its range; guests are to be dropped at the end. Only the smallest id of each range
    reaches the driver.
    """
    spark = docs.sparkSession
    cuts = _ranges(docs, id_col, text_col)
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    number = F.size(F.filter(bounds, lambda b: b <= F.col("id"))) if cuts else F.lit(0)
    rows = docs.select(F.col(id_col).alias("id"), as_text(text_col).alias("text")).withColumn("range", F.coalesce(F.when(F.col("id").isNotNull(), number), F.lit(-1)))
    lows = sorted((r["range"], r["low"]) for r in rows.groupBy("range").agg(F.min("id").alias("low")).collect())
    before = [(lows[i][0], lows[i - 1][0]) for i in range(len(lows))]  # the guest of the last range is the first row of all
    known = [low for _, low in lows if low is not None]
    firsts = rows.where(F.col("id").isNull() | F.col("id").isin(known)).groupBy("range").agg(F.min(F.struct("id", "text")).alias("row"))
    hosts = spark.createDataFrame(before, "range int, host int")
    guests = firsts.join(F.broadcast(hosts), "range").select("row.id", "row.text", F.col("host").alias("range"), F.lit(True).alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return both.withColumns({"seq": F.row_number().over(order), "next_text": F.coalesce(F.lead("text").over(order), F.lit(""))})


def edited(text, next_text):
    """``text`` with its last quarter of code points replaced by as many first ones of ``next_text`` (or all)."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - quarter), F.substr(next_text, F.lit(1), quarter))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Per document its own fingerprint, that of its edited text and the next document's, as arrays of signatures.

    Columns: ``id_col``, ``n_chars``, ``edited_sha256``, ``own``, ``changed``, ``following``.
    """
    words = lexicon(docs, text_col, band)
    mark = F.xxhash64(F.lit(""))  # no term; every row keeps one
    words = words.union(docs.sparkSession.range(1).select(mark.alias("t")))
    if words.count() <= LEXICON:
        words = F.broadcast(words)
    rows = with_next(docs, id_col, text_col)
    rows = rows.select("range", "seq", "guest", "id", "text", edited(F.col("text"), F.col("next_text")).alias("changed"))
    rows = rows.select(
        "range", "seq", "guest", "id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"),
        terms(F.col("text")).alias("a"), terms(F.col("changed")).alias("b"),
    )
    every = lambda c: F.when(F.size(c) > 0, F.xxhash64(F.array_join(F.sort_array(c).cast("array<string>"), ",")))
    rows = rows.withColumns({"n": F.size("a"), "whole_a": every(F.col("a")), "whole_b": every(F.col("b"))})
    keys = ["range", "seq", "guest", "id", "n_chars", "edited_sha256", "whole_a", "whole_b", "n"]
    rows = rows.select(*keys, F.posexplode(F.concat("a", "b", F.array(mark))).alias("at", "t")).join(words, "t")
    real = F.col("t") != mark
    rows = rows.groupBy("range", "seq").agg(
        *[F.first(c).alias(c) for c in keys[2:]],
        F.sort_array(F.collect_list(F.when(real & (F.col("at") < F.col("n")), F.col("t")))).alias("a"),
        F.sort_array(F.collect_list(F.when(real & (F.col("at") >= F.col("n")), F.col("t")))).alias("b"),
    )
    # without lexicon terms: one hash over all terms, as the only signature
    alone = lambda whole: F.concat(F.array(F.coalesce(F.shiftrightunsigned(whole, 32).cast("long").bitwiseOR(F.lit(1)), F.lit(0))), F.array_repeat(F.lit(0).cast("long"), len(LEVELS) * SUBSETS - 1))
    rows = rows.withColumns({
        "own": F.when(F.size("a") > 0, _signatures(F.col("a"))).otherwise(alone(F.col("whole_a"))),
        "changed": F.when(F.size("b") > 0, _signatures(F.col("b"))).otherwise(alone(F.col("whole_b"))),
    })
    following = F.lead("own").over(Window.partitionBy("range").orderBy("seq"))
    rows = rows.select("guest", F.col("id").alias(id_col), "n_chars", "edited_sha256", "own", "changed", following.alias("following"))
    return rows.where("not guest").drop("guest")
