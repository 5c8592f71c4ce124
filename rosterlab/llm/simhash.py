"""SimHash near-duplicates: fingerprints of word shingles, linked through pigeonhole blocks.

Two fingerprints that differ in at most ``bits`` bits agree on at least ``blocks - bits`` of ``blocks`` blocks, so they
meet under the key made of those blocks. Rows with equal fingerprints are one node, so copies cost nothing. The rows of
a key are compared inside one sorted run; a run yields at most one link per member (a spanning forest of its links), so
a large group never becomes all its pairs and no component is lost.

Nulls and texts without words have fingerprint zero and link like any other. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EDGES, components, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
_STEP = 1 << 16


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """Hashes of the shingles of one text, repeats included; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(stops[:-1] + 1).tolist()]
    stops = stops.tolist()
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, stops[width - 1 :])), dtype="<u8", count=len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[lo : lo + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprint_udf(shingle: int = 4):
    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in text], dtype=np.uint64).view(np.int64))

    return run


def block_masks(bits: int = 4, blocks: int = 7) -> list[int]:
    """Masks of the block combinations of which two fingerprints within ``bits`` share at least one."""
    if not 0 <= bits < blocks <= 64:
        raise ValueError("blocks must exceed bits")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, bits: int):
    """Links of one run as a forest: a breadth-first walk that takes each member once."""
    left = fps
    while len(left) > 1:
        walk, left = [left[0]], left[1:]
        while walk and len(left):
            at = walk.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                for x in left[near]:
                    yield int(at), int(x)
                    walk.append(x)
                left = left[~near]


def _links(batches, bits: int):
    """Sorted rows (combo, key, fp) to links; holds one run at a time besides the batch."""
    parent: dict[int, int] = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    carry = None
    for batch in batches:
        got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            got = [np.concatenate(p) for p in zip(carry, got)]
        combo, key, fp = got
        if not len(fp):
            continue
        cut = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], cut])
        last = starts[-1]
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= bits]
        for a, b in zip(fp[two].tolist(), fp[two + 1].tolist()):
            join(a, b)
        for s, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for a, b in _forest(fp[s : s + n].view(np.uint64), bits):
                join(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b)
        carry = [x[last:].copy() for x in (combo, key, fp)]
    if carry is not None and len(carry[2]) > 1:
        for a, b in _forest(carry[2].view(np.uint64), bits):
            join(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b)
    pairs = [(n, find(n)) for n in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    if pairs:
        a, b = zip(*pairs)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def fingerprint_links(fps: DataFrame, column: str = "fp", bits: int = 4, blocks: int = 7) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints exactly as all links within ``bits`` would."""
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(bits, blocks))])
    rows = fps.select(F.col(column).alias("fp")).where("fp is not null").distinct().select("fp", F.explode(keys).alias("k"))
    rows = rows.select("k.combo", "k.key", "fp").repartition("combo", "key").sortWithinPartitions("combo", "key", "fp")
    return rows.mapInArrow(lambda batches: _links(batches, bits), EDGES)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, blocks: int = 7) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id reachable through links."""
    fps = written(docs.select(F.col(id_col).alias("id"), fingerprint_udf(shingle)(F.col(text_col)).alias("fp")), "fingerprints")
    roots = components(fingerprint_links(fps, "fp", bits, blocks))
    first = fps.groupBy("fp").agg(F.min("id").alias("low"))
    first = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = first.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = first.join(lowest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a number for each row, equal rows too, and the name of that column, which none had before."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def first_rows(rows: DataFrame, name: str, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the ``numbered`` rows one of each group ``(row, component_id)``: by id, nulls last, then text hash and number."""
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(name).alias("row"))
    kept = rows.select(place.alias("place"), F.col(name).alias("row")).join(groups.select("row", "component_id"), "row")
    kept = kept.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group stays, the one with the smallest id; repeated rows and rows without an id are no exception."""
    rows, name = numbered(docs)
    groups = near_duplicates(rows.select(F.col(name).alias("row"), F.col(text_col).alias("text")), "row", **how)
    return first_rows(rows, name, groups, id_col, text_col)
