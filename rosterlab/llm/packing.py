"""Packing token sequences as a cutting-stock problem.

Documents are cut into pieces of ``width`` ids and a rest. The lengths of all pieces form a histogram of at most ``width``
classes, which alone reaches the driver. Column generation solves the linear program "least padded length over patterns
of lengths that fit a sequence": a simplex basis gives the prices of the lengths, and a knapsack dynamic program over
the fill finds the pattern of the best reduced cost. A sequence whose fill is a power of two needs no padding and costs
its fill. Whole multiples of the patterns are taken; what rounding leaves, at most a few pieces per class, is packed by
subset sums. The patterns become slots, intervals of ranks of each length, and every piece finds its place by
its rank among the pieces of its length. Ranks are counted in salted parts, so a length that most pieces share is spread.

Null texts count as empty; a document always has at least its closing id. Equal rows get places of their own.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe
from .common import written
from .common_py import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 1024
#: Rows of one rank counter.
PART = 1_000_000


def _fill_cost(fill, width: int):
    fill = np.asarray(fill)
    return np.where((fill & (fill - 1)) == 0, fill, width) / width


def _price(values: np.ndarray, lengths: np.ndarray, width: int):
    """The pattern of the greatest value minus cost: copies of each length, by an unbounded knapsack over exact fills."""
    gain = np.full(width + 1, -np.inf)
    gain[lengths] = values
    best, last = np.full(width + 1, -np.inf), np.zeros(width + 1, dtype=int)
    best[0] = 0
    for c in range(1, width + 1):
        tried = best[c - 1 :: -1] + gain[1 : c + 1]
        last[c] = k = int(tried.argmax())
        best[c] = tried[k]
    fill = int((best[1:] - _fill_cost(np.arange(1, width + 1), width)).argmax()) + 1
    pattern, c = {}, fill
    while c > 0:
        size = int(last[c]) + 1
        pattern[size] = pattern.get(size, 0) + 1
        c -= size
    return pattern, fill, float(best[fill])


def _filled(head: int, left: dict, width: int, copies) -> dict[int, int]:
    """``head`` and a subset of the remaining lengths that fills its sequence best; ``copies(size)`` at most of each."""
    room, pattern = width - head, {head: 1}
    full, reach, last = (1 << (room + 1)) - 1, 1, {}
    for size in sorted((s for s in left if s <= room), reverse=True):
        for _ in range(min(copies(size) - (size == head), room // size)):
            fresh = (reach << size) & full & ~reach
            if not fresh:
                break
            reach |= fresh
            while fresh:
                low = fresh & -fresh
                last[low.bit_length() - 1] = size
                fresh ^= low
        if reach >> room & 1:
            break
    got = reach.bit_length() - 1
    while got:
        pattern[last[got]] = pattern.get(last[got], 0) + 1
        got -= last[got]
    return pattern


def _first_basis(lengths: np.ndarray, demand: np.ndarray, width: int) -> list[tuple[dict[int, int], float]]:
    """One pattern per length: the longest one left, filled up, as often as possible. Each uses up a length of its own."""
    left = {int(s): float(d) for s, d in zip(lengths, demand)}
    out = []
    while left:
        pattern = _filled(max(left), left, width, lambda size: 2)
        used = min(pattern, key=lambda s: left[s] / pattern[s])
        times = left[used] / pattern[used]
        for s, k in pattern.items():
            left[s] = max(left[s] - k * times, 0.0)
        del left[used]
        out.append((used, pattern, times))
    return out


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, width: int = WIDTH, gap: float = 5e-4, rounds: int = 1000):
    """Basic solution of the linear program: list of (pattern, multiple); multiples are fractions of a pattern."""
    first = _first_basis(lengths, demand, width)
    m, row = len(first), {used: i for i, (used, _, _) in enumerate(first)}
    x, basis = np.array([t for _, _, t in first]), [p for _, p, _ in first]
    inverse = np.eye(m)
    for i, (used, pattern, _) in enumerate(first):  # a pattern holds no length used up before it: a triangular matrix
        inverse[i] /= pattern[used]
        for size, k in pattern.items():
            if size != used:
                inverse[row[size]] -= k * inverse[i]
    costs = np.array([float(_fill_cost(sum(s * k for s, k in p.items()), width)) for p in basis])
    prices = (costs[:, None] * inverse).sum(axis=0)  # by length, in the order of ``row``
    order = np.array(list(row))
    least = float((lengths * demand).sum()) / width
    for _ in range(rounds):
        total = float((costs * x).sum())
        if total - least <= gap * least:
            break
        pattern, fill, value = _price(prices, order, width)
        price = float(_fill_cost(fill, width))
        if value - price <= 1e-9 or total * (1 - price / value) <= gap * least:  # the bound that the prices prove
            break
        column = np.zeros(m)
        for size, k in pattern.items():
            column += k * inverse[:, row[size]]
        able = column > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, column, 1), np.inf)
        out = int(ratio.argmin())
        step = float(ratio[out])
        x = np.maximum(x - step * column, 0)
        x[out] = step
        pivot = inverse[out] / column[out]
        rows = np.flatnonzero(np.abs(column) > 1e-12)
        inverse[rows] -= np.outer(column[rows], pivot)
        inverse[out] = pivot
        prices = prices - (value - price) * pivot
        basis[out], costs[out] = pattern, price
    return list(zip(basis, x.tolist()))


def _leftover_patterns(left: dict[int, int], width: int) -> list[dict[int, int]]:
    """Patterns for the pieces that rounding left: the longest first, the rest of its sequence by a subset sum."""
    out = []
    while left:
        pattern = _filled(max(left), left, width, left.get)
        for s, k in pattern.items():
            left[s] -= k
        left = {s: n for s, n in left.items() if n > 0}
        out.append(pattern)
    return out


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole multiples that hold every piece of the histogram exactly once."""
    chosen: list[tuple[dict[int, int], int]] = []
    if full := histogram.get(width, 0):
        chosen.append(({width: 1}, full))
    left = {s: n for s, n in histogram.items() if s < width and n > 0}
    if left:
        lengths = np.array(sorted(left))
        for pattern, times in solve_patterns(lengths, np.array([left[int(s)] for s in lengths], dtype=float), width):
            times = min(int(times + 1e-6), min(left[s] // k for s, k in pattern.items()))
            if times > 0:
                chosen.append((pattern, times))
                for s, k in pattern.items():
                    left[s] -= k * times
        chosen += [(p, 1) for p in _leftover_patterns({s: n for s, n in left.items() if n > 0}, width)]
    return chosen


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """Rows (length, lo, hi, per, sequence, offset): ranks lo to hi of a length lie ``per`` to a sequence from there on."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size, k in sorted(pattern.items(), reverse=True):
            lo = taken.get(size, 0)
            taken[size] = lo + k * times
            rows.append((size, lo, lo + k * times, k, sequence, offset))
            offset += size * k
        sequence += times
    return rows


def _cut(batches, path: str, width: int, end: int | None):
    coder = byte_bpe(path)
    close = b"" if end is None else np.array([end], dtype="<u4").tobytes()
    for batch in slices(batches):
        owner, start, length, crc, total = [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = coder.encode(text) + close
            n = len(ids) // 4
            for at in range(0, n, width):
                part = ids[4 * at : 4 * (at + width)]
                owner.append(row), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(n)
        longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *longs], names=["id", "start", "length", "ids_crc32", "doc_tokens"])


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = "byte_bpe_50k.json", width: int = WIDTH, end: int | None = 0) -> DataFrame:
    """Pieces ``(id, start, length, ids_crc32, doc_tokens)`` of each document's ids, closed by the id ``end``."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: _cut(batches, path, width, end), schema)


def place(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``width`` rows
    rows = slots(plan(histogram, width))
    found = spark.createDataFrame(rows, "length long, lo long, hi long, per long, first long, shift long")
    parts = max(16, sum(histogram.values()) // PART)
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("id", "start"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("own", F.row_number().over(order) - 1).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    # slots: a basis of at most ``width`` patterns of few lengths each, and the leftovers of rounding
    slot = F.broadcast(found)
    placed = ranked.join(slot, (ranked["length"] == slot["length"]) & (ranked["rank"] >= slot["lo"]) & (ranked["rank"] < slot["hi"])).drop(slot["length"])
    turn = F.col("rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first") + F.floor(turn / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("shift") + (turn % F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = "byte_bpe_50k.json", width: int = WIDTH, end: int | None = 0) -> DataFrame:
    """One row per piece: the document's id, where the piece starts and how long it is, its crc, its sequence and offset."""
    return place(written(cut(docs, id_col, text_col, path, width, end), "pieces"), width).withColumnRenamed("id", id_col)
