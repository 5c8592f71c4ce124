"""How two tokenizers cut the same texts: each distinct text is encoded and aligned once, its counts weighted by its copies.

Texts are shuffled whole, so that equality is equality of texts. Both tokenizers' tokens are byte ranges of a space and the
text. Where tokens of both end at one offset, they cut the ranges into groups; an A and a B token are linked where their
ranges overlap. Each stretch between two neighbouring ends of either tokenizer belongs to exactly one linked pair of tokens, so the
links of a text are found by one merge of the ends and two binary searches, in linear memory.

The count of a pair of ids is the number of documents that hold it linked: every distinct text gives each of its pairs once, times
its copies. Pairs with high counts, ``HOT`` of them at most, are looked up by broadcast; all others are joined by shuffling,
where none of them is a hot key. Measures go back to the documents by the text's digest: texts with many copies (again a bounded
number) by broadcast, the rest by shuffling. Nothing is dropped either way.

Null and empty texts, and texts whose tokens do not give back a space and the text byte for byte, have no tokens: zeros and an
empty string. Rows with equal ids or texts all get their row. An empty table gives an empty result. Very long texts are aligned whole;
memory follows the longest text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, token_bytes
from .common import Scratch, heavy_join
from .common_py import slices, worker_state
from .pieces import MARK, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most pairs, and most texts, that are broadcast: those with the highest counts.
HOT = 500_000
_SHIFT = 32
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


class Aligner:
    """The tokenizers of both sides, with sizes in bytes and decimal texts of all ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe(a_path), pieces(b_path)
        # the mark of white space is a space, <0xHH> is a byte
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.b.text)]
        self.shown = token_bytes(a_path), b_bytes
        self.sizes = [np.array([len(x) for x in shown], dtype=np.int64) for shown in self.shown]
        digits = [[str(i).encode() for i in range(len(shown))] for shown in self.shown]
        # A within a group, A at its end, B within a group, B at its end
        self.digits = [d + end for ids, ends in zip(digits, (b",|", b",;")) for end in (ends[:1], ends[1:]) for d in ids]
        self.first_b = 2 * len(digits[0])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text, or None where either does not give back a space and the text."""
        out, cache = [], self.a.cache
        for text in texts:
            line = " " + text
            a = np.frombuffer(b"".join([cache[w] for w in self.a.parts(line)]), dtype="<u4").astype(np.int64)
            b = np.frombuffer(self.b.encode(text), dtype=np.int32).astype(np.int64)
            raw = line.encode("utf-8", "surrogatepass")
            sides = [b"".join([shown[i] for i in ids.tolist()]) for shown, ids in zip(self.shown, (a, b))]
            out.append((a, b) if text and sides[0] == raw == sides[1] else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, str]:
        """Number of groups, the links as ``a id << 32 | b id`` in text order, and the groups as text."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        both = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a  # the last ends are equal, so no place is behind all of B
        common = ends_a[both]
        ends = np.sort(np.concatenate([ends_a[~both], ends_b]))
        links = a[np.searchsorted(ends_a, ends)] << _SHIFT | b[np.searchsorted(ends_b, ends)]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = common[group_a] == ends_a, common[group_b] == ends_b
        codes = np.concatenate([a + last_a * (self.first_b // 2), b + last_b * len(self.shown[1]) + self.first_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        digits = self.digits
        return len(common), links, b"".join([digits[i] for i in codes[order].tolist()])[:-1].decode()


def aligner(a_path: str, b_path: str) -> Aligner:
    return worker_state(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


_SCHEMA = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_KINDS = [pa.binary(), *[pa.int64()] * 5, pa.string()]


def _aligned(batches, a_path: str, b_path: str):
    """Distinct texts ``(text, copies)`` to their measures and distinct linked id pairs, with the number of links of each."""
    both = aligner(a_path, b_path)
    for batch in slices(batches):
        texts, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, pairs, times, stops = [], [], [], [0]
        for text, n, ids in zip(texts, copies, both.encode(texts)):
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            if ids is None:
                rows.append((digest, n, 0, 0, 0, 0, ""))
            else:
                groups, links, shown = both.align(*ids)
                rows.append((digest, n, len(ids[0]), len(ids[1]), groups, len(links), hashlib.sha256(shown.encode()).hexdigest()))
                found, often = np.unique(links, return_counts=True)
                pairs.append(found)
                times.append(often)
            stops.append(stops[-1] + (len(found) if ids is not None else 0))
        lists = [pa.array(np.concatenate(x) if x else [], k) for x, k in ((pairs, pa.int64()), (times, pa.int32()))]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] + [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), x) for x in lists]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SCHEMA.split(", ")])


def hot_count(counted: DataFrame, column: str, most: int) -> int:
    """The least power of two so that at most ``most`` rows have that count or more; a row for each power reaches the driver."""
    powers = counted.groupBy(F.floor(F.log2(column)).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    held, low = 0, 1 << 62
    for r in powers:
        held += r["count"]
        if held > most:
            break
        low = 1 << r["power"]
    return low


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = "byte_bpe_50k.json", b_path: str = "piece_bpe_32k.model", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    store = Scratch()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = store(distinct.mapInArrow(lambda batches: _aligned(batches, a_path, b_path), _SCHEMA), "aligned-texts", compression="zstd")

    # map-side sums: a common pair is one partial row a task
    counts = texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count"))
    counts = store(counts, "pair-counts")
    best = F.broadcast(counts.groupBy(F.shiftright("pair", _SHIFT).alias("a")).agg(F.max("count").alias("top")))  # a row per id of the vocabulary
    pairs = counts.join(best, F.shiftright("pair", _SHIFT) == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    low = hot_count(counts, "count", hot)
    known = F.broadcast(pairs.where(F.col("count") >= low))

    links = texts.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("digest", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    found = links.join(known, "pair").groupBy("digest").agg(*sums)
    if counts.where(F.col("count") < low).limit(1).count():
        rare = links.join(known.select("pair"), "pair", "left_anti").join(pairs.where(F.col("count") < low), "pair").groupBy("digest").agg(*sums)
        found = found.unionByName(rare).groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = texts.drop("pairs", "times").join(found, "digest", "left")
    measures = store(measures.select("digest", "copies", *MEASURES, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"), "text-measures")

    keys = store(rows.select("id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("digest")), "text-keys")
    columns = [F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0)).alias(c) for c in [*MEASURES, "n_best", "count_sum"]], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")]
    none = [F.lit(0).cast("long").alias(c) for c in [*MEASURES, "n_best", "count_sum"]]
    blank = keys.where("digest is null").select(F.col("id").alias(id_col), *none, F.lit("").alias("groups_sha256"))
    found = heavy_join(keys.where("digest is not null"), measures, "digest", "copies").select(*columns)
    out = blank.unionByName(found)
    for t in (keys, measures):
        store.release(t)  # the result reads these
    store.clear()
    return out
