"""Quantile boosting: pinball loss, histogram trees, exact leaf quantiles, over all rows.

Up to ``model.TASK_ROWS`` rows fit one task, and the quantiles are fitted side by side (``fit_task``). More rows are spread over parts and
counted by Spark jobs (``fit_spread``), which give the same model bit for bit.
For every level of a tree the rows and the rows below their prediction are counted by node, feature and bin, and every node
takes the split with the largest gain. The values of the leaves are quantiles of the residuals, found by counting digits of their
position between the leaf's least and greatest residual. All sums are sums of integers, so the model does not depend on the
order of rows, and a repeated task gives the same model.

A part holds rows sorted by cell, the bins of all features, and by label. Rows of a cell go the same way in every tree, so a prediction is kept
for each cell of a part, rows below it are the first ones of the cell, and trees grow from counts of cells. Where cells are as many as
rows this is a count of rows. A tree takes one pass over the rows for these counts and one for the leaf values.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.serializers import BatchedSerializer, CPickleSerializer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = "model int, tree int, node int, feature int, cut double, value double, cover long"
_DIGITS, _BITS = 3, 8
_BASE = 1 << _BITS
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Most codes of a table of masks that features share.
_CELLS = 1024
#: Most cells of all parts whose counts the driver takes to grow a tree itself; with more of them each level is a job.
_HELD = 1 << 17
#: Trees after which the state of the parts is written, which cuts its lineage.
_CUT = 20


@dataclass(frozen=True)
class Settings:
    """Size of a fit; the defaults are those of the reference models."""

    levels: tuple[float, ...]
    trees: int = 500
    depth: int = 6
    step: float = 0.05
    least: int = 10
    ridge: float = 1.0
    rows_share: float = 0.8
    columns_share: float = 0.8
    seed: int = 42


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * _ODD
        x = (x ^ (x >> np.uint64(29))) * _ODD
        return x ^ (x >> np.uint64(32))


def quantiles(residuals: np.ndarray, leaf: np.ndarray, leaves: int, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``level`` quantile of the residuals of each leaf and the leaf's rows."""
    low, high = np.full(leaves, np.inf), np.full(leaves, -np.inf)
    order = np.argsort(leaf, kind="stable")
    starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    if len(order):
        here = leaf[order][starts]
        low[here], high[here] = np.minimum.reduceat(residuals[order], starts), np.maximum.reduceat(residuals[order], starts)
    width = np.where(high > low, high - low, 1.0)
    place = _place(residuals, low[leaf], width[leaf])
    rows = np.arange(len(leaf))
    picked = None
    for k in range(_DIGITS):
        digit = place[rows] // _BASE ** (_DIGITS - 1 - k) % _BASE
        picked = _picked(np.bincount(leaf[rows] * _BASE + digit, minlength=leaves * _BASE).astype(np.int64), level, picked)
        rows = rows[digit == picked[1][leaf[rows]] % _BASE]
    return _value(low, high, width, picked)


def _place(residuals, low, width) -> np.ndarray:
    """Positions between the least and the greatest residual of a leaf, as whole numbers of ``_DIGITS`` digits; they rise with the residual."""
    cells = _BASE**_DIGITS
    return np.minimum(((residuals - low) / width * cells).astype(np.int32), cells - 1)


def _picked(counts: np.ndarray, level: float, before=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rank, found, total)`` of each leaf with one digit more, from the counts of the rows that have the digits ``before``."""
    sums = np.cumsum(counts.reshape(-1, _BASE), axis=1)
    if before is None:
        before = np.clip(np.ceil(level * sums[:, -1]).astype(np.int64), 1, None), np.zeros(len(sums), dtype=np.int64), sums[:, -1]
    rank, found, total = before
    pick = np.minimum((sums < rank[:, None]).sum(axis=1), _BASE - 1)
    return rank - np.where(pick > 0, sums[np.arange(len(sums)), pick - 1], 0), found * _BASE + pick, total


def _value(low, high, width, picked) -> tuple[np.ndarray, np.ndarray]:
    _, found, total = picked
    value = np.where(high > low, low + (found + 0.5) / _BASE**_DIGITS * width, low)
    return np.where(total > 0, value, 0.0), total


def _split(rows: np.ndarray, below: np.ndarray, level: float, allowed: np.ndarray, s: Settings):
    """Best ``(feature, bin)`` of each node, -1 where none is worth it; counts are (node, feature, bin)."""
    left_n, left_g = rows.cumsum(axis=2), (below - level * rows).cumsum(axis=2)
    n, g = left_n[:, :, -1:], left_g[:, :, -1:]
    worth = left_g**2 / (left_n + s.ridge) + (g - left_g) ** 2 / (n - left_n + s.ridge) - g**2 / (n + s.ridge)
    worth = np.where((left_n >= s.least) & (n - left_n >= s.least) & allowed[None, :, None], worth, -1.0)
    best = worth.reshape(len(worth), -1).argmax(axis=1)
    good = worth.reshape(len(worth), -1)[np.arange(len(worth)), best] > 1e-6
    bins = rows.shape[2]
    return np.where(good, best // bins, -1), best % bins


def _counts(at, codes, use, below, nodes: int, bins: int, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and rows below their prediction, by (node, feature, bin), of the rows ``use`` in the nodes ``at``."""
    out = [np.zeros((nodes, len(codes), bins)) for _ in range(2)]
    low, first = below[use], at * bins
    for f in np.flatnonzero(allowed):
        cell = first + codes[f, use]
        for counts, cells in zip(out, (cell, cell[low])):
            counts[:, f] = np.bincount(cells, minlength=nodes * bins).reshape(-1, bins)
    return out[0], out[1]


def _siblings(parent: np.ndarray, small: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Counts of both children of each parent in turn, ``side`` telling which of the two is ``small``."""
    out = np.empty((2 * len(small), *small.shape[1:]))
    pair = 2 * np.arange(len(small))
    out[pair + side], out[pair + 1 - side] = small, parent - small
    return out


def fit_level(hashes: np.ndarray, y: np.ndarray, x: list[np.ndarray], cuts: list[np.ndarray], level: float, s: Settings) -> list[tuple]:
    """Nodes ``(tree, node, feature, cut, value, cover)`` of the trees of one quantile; tree -1 is the base value."""
    wide, full = len(cuts), 2 ** (s.depth + 1)
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x)]).astype(np.int32) if wide else np.zeros((0, len(y)), np.int32)
    bins = max([len(c) for c in cuts], default=0) + 1
    everyone = np.arange(len(y))
    base, total = quantiles(y, np.zeros(len(y), dtype=np.int32), 1, level)
    out, predicted = [(-1, 0, -1, 0.0, float(base[0]), int(total[0]))], np.full(len(y), base[0])
    for t in range(s.trees if wide else 0):
        taken, allowed = _taken(hashes, t, s), _allowed(wide, t, s)
        node, below = np.zeros(len(y), dtype=np.int32), predicted > y
        splits: dict[int, tuple[int, int]] = {}
        open_, above = np.array([0]), None
        for _ in range(s.depth):
            if not len(open_):
                break
            lookup = np.full(full, -1, dtype=np.int32)
            lookup[open_] = np.arange(len(open_))
            at = lookup[node]
            use = np.flatnonzero(taken & (at >= 0))
            at = at[use]
            if above is None:
                rows, lower = _counts(at, codes, use, below, 1, bins, allowed)
            else:  # of two siblings the smaller one is counted, the other is what is left of their parent
                small = np.bincount(at, minlength=len(open_)).reshape(-1, 2).argmin(axis=1)
                mine = small[at // 2] == at % 2
                part = _counts(at[mine] // 2, codes, use[mine], below, len(small), bins, allowed)
                rows, lower = (_siblings(p, q, small) for p, q in zip(above, part))
            feature, cut = _split(rows, lower, level, allowed, s)
            kept = feature >= 0
            splits |= {n: (f, c) for n, f, c in zip(open_[kept].tolist(), feature[kept].tolist(), cut[kept].tolist())}
            by = np.full((2, full), -1, dtype=np.int32)
            by[0, open_], by[1, open_] = feature, cut
            above = rows[kept], lower[kept]
            own = by[0][node]
            node = np.where(own >= 0, 2 * node + 1 + (codes[own, everyone] > by[1][node]), node).astype(np.int32)
            open_ = np.stack([2 * open_[kept] + 1, 2 * open_[kept] + 2], axis=1).ravel()
        # all rows of a leaf count for its value, those left out of the splits too
        values, cover = quantiles(y - predicted, node, full, level)
        predicted += s.step * values[node]
        out += _nodes(t, splits, cuts, values, cover, s)
    return out


def _taken(hashes: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Whether a row counts for the splits of a tree."""
    return _mixed(hashes, s.seed * 1_000_003 + tree) >> np.uint64(11) < np.uint64(s.rows_share * 2**53)


def _allowed(wide: int, tree: int, s: Settings) -> np.ndarray:
    """Whether a feature may split in a tree."""
    allowed = np.zeros(wide, dtype=bool)
    allowed[_mixed(np.arange(wide, dtype=np.uint64), s.seed * 7_919 + tree).argsort()[: max(1, int(np.ceil(s.columns_share * wide)))]] = True
    return allowed


def _nodes(tree: int, splits: dict[int, tuple[int, int]], cuts, values, cover, s: Settings) -> list[tuple]:
    leaves = [c for n in splits for c in (2 * n + 1, 2 * n + 2) if c not in splits] if splits else [0]
    out = [(tree, n, f, float(cuts[f][c]), 0.0, 0) for n, (f, c) in splits.items()]
    return out + [(tree, n, -1, 0.0, float(s.step * values[n]), int(cover[n])) for n in leaves]


def fit_task(batches, cuts: list[np.ndarray], s: Settings):
    """Rows ``(model, hash, label, features...)`` to the nodes of the models among them."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not held:
        return
    model, hashes, y, *x = (np.concatenate(c) for c in zip(*held))
    for m in np.unique(model).tolist():
        own = model == m
        out = fit_level(hashes[own].astype(np.int64).view(np.uint64), y[own].astype(np.float64), [v[own] for v in x], cuts, s.levels[m], s)
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.float64(), pa.int64()]
        columns = [pa.array([m] * len(out), pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in NODES.split(", ")])


def code_type(cuts: list[np.ndarray]):
    return np.uint8 if max([len(c) for c in cuts], default=0) < 256 else np.int32


def coded(batches, cuts: list[np.ndarray]):
    """Rows ``(hash, label, features...)`` to ``(code, hash, label)``, the code being the bytes of the bins of all features."""
    kind = code_type(cuts)
    for b in batches:
        hashes, label, *x = b.columns
        codes = np.zeros((b.num_rows, len(cuts)), kind)
        for f, (c, v) in enumerate(zip(cuts, x)):
            codes[:, f] = np.searchsorted(c, v.to_numpy(zero_copy_only=False), side="left")
        ends = np.arange(b.num_rows + 1, dtype=np.int32) * (codes.itemsize * len(cuts))
        code = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
        yield pa.RecordBatch.from_arrays([code, hashes, label], names=["code", "hash", "label"])


def part(batches):
    """The rows ``(code, hash, label)`` of a partition, sorted by code and label, to one row: hashes, labels, first rows of cells, codes of cells."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    code = table.column("code").cast(pa.binary()).combine_chunks()
    code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
    wide = len(code[0].as_py())
    ends = np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + len(code) + 1]
    # a code of no features has no bytes and is one cell
    codes = np.frombuffer(code.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(code), wide) if wide else np.zeros((len(code), 0), np.uint8)
    starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1)))
    columns = [table.column("hash").to_numpy().astype(np.int64), table.column("label").to_numpy().astype(np.float64), starts.astype(np.int64), codes[starts]]
    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["hashes", "labels", "starts", "codes"])


def _first(starts: np.ndarray, ends: np.ndarray, before) -> np.ndarray:
    """For each cell its first row that is not ``before``; rows of a cell that are come first. ``before`` takes one row of each cell."""
    low, high = starts, ends
    while (low < high).any():
        at = (low + high) // 2
        more, less = (low < high) & before(np.minimum(at, ends - 1)), low < high
        low, high = np.where(more, at + 1, low), np.where(less & ~more, at, high)
    return low


def _blocks(a: np.ndarray, b: np.ndarray, size: int = 1 << 15):
    """``(cell, row)`` of the rows from ``a`` to ``b`` of each cell, about ``size`` rows at a time."""
    sums = np.append(0, np.cumsum(b - a))
    for low in range(0, int(sums[-1]), size):
        high = min(low + size, int(sums[-1]))
        first, last = np.searchsorted(sums, low, side="right") - 1, np.searchsorted(sums, high, side="left")
        n = np.minimum(sums[first + 1 : last + 1], high) - np.maximum(sums[first:last], low)
        cell = np.repeat(np.arange(first, last), n)
        yield cell, np.arange(low, high) + (a - sums[:-1])[cell]


def _leaves(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each cell in the tree so far."""
    node, cells = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    for _ in range(depth):
        own = feature[node]
        if codes.shape[1]:
            node = np.where(own >= 0, 2 * node + 1 + (codes[cells, own] > cut[node]), node)
    return node


def _opened(row, wide: int, kind) -> tuple:
    """``(labels, starts, ends, codes)`` of a stored part."""
    y, starts = np.frombuffer(row["labels"], np.float64), np.frombuffer(row["starts"], np.int64)
    return y, starts, np.append(starts[1:], len(y)), np.frombuffer(row["codes"], kind).reshape(len(starts), wide)


def _begun(part: tuple, models: int) -> tuple:
    """State of a part: codes, least and greatest label of its cells, and predictions, rows and rows below the prediction by model."""
    y, starts, _, codes = part
    none = np.zeros((models, len(starts)))
    return codes, np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts), none, none[0], none


def _moved(hashes: np.ndarray, part: tuple, state: tuple, values, tree: int, s: Settings) -> tuple:
    """The state with the values of the last trees added, ``(feature, cut, value)`` by model, and the counts of the next one."""
    y, starts, ends, _ = part
    codes, low, high, predicted, _, _ = state
    predicted = np.stack([p + value[_leaves(codes, feature, cut, s.depth)] for p, (feature, cut, value) in zip(predicted, values)])
    sums = np.zeros(len(y) + 1, dtype=np.int64)
    for k in range(0, len(y), 1 << 16):
        taken = _taken(hashes[k : k + (1 << 16)], tree, s)
        np.cumsum(taken, out=sums[k + 1 : k + 1 + len(taken)])
        sums[k + 1 : k + 1 + len(taken)] += sums[k]
    below = np.stack([sums[_first(starts, ends, lambda at: y[at] < p)] for p in predicted])  # noqa: B023
    return codes, low, high, predicted, sums[ends] - sums[starts], below - sums[starts]


def _level_counts(state: tuple, trees, open_, allowed, bins: int) -> list[np.ndarray]:
    """For each model ``(rows or rows below, open node, feature, bin)``."""
    codes, _, _, _, rows, below = state
    out = []
    for (feature, cut), nodes, lower in zip(trees, open_, below):
        counts = np.zeros((2, len(nodes), codes.shape[1], bins))
        lookup = np.full(len(feature), -1)
        lookup[nodes] = np.arange(len(nodes))
        at = lookup[_leaves(codes, feature, cut, len(feature).bit_length())]
        use = np.flatnonzero(at >= 0)
        for f in np.flatnonzero(allowed) if len(nodes) else ():
            cell = at[use] * bins + codes[use, f]
            for k, weight in enumerate((rows, lower)):
                counts[k, :, f] = np.bincount(cell, weight[use], len(nodes) * bins).reshape(-1, bins)
        out.append(counts)
    return out


def _ranges(state: tuple, trees, depth: int) -> list[np.ndarray]:
    """For each model the least residuals of its leaves and the greatest ones with the sign changed."""
    codes, low, high, predicted, _, _ = state
    out = []
    for (feature, cut), p in zip(trees, predicted):
        leaf, both = _leaves(codes, feature, cut, depth), np.full((2, len(feature)), np.inf)
        np.minimum.at(both[0], leaf, low - p)
        np.minimum.at(both[1], leaf, -(high - p))
        out.append(both)
    return out


def _digit_counts(part: tuple, state: tuple, trees, spans, founds, k: int, depth: int) -> list[np.ndarray]:
    """For each model rows by leaf and digit ``k``, of those that have the digits found before."""
    y, starts, ends, codes = part
    out = []
    for (feature, cut), p, (low, width), found in zip(trees, state[3], spans, founds):
        leaf = _leaves(codes, feature, cut, depth)
        least, wide = low[leaf], width[leaf]
        a, b = starts, ends
        if k:
            size = _BASE ** (_DIGITS - k)
            a, b = (_first(starts, ends, lambda at, to=found[leaf] * size + more: _place(y[at] - p, least, wide) < to) for more in (0, size))  # noqa: B023
        counts = np.zeros(len(feature) * _BASE, dtype=np.int64)
        for cell, at in _blocks(a, b):
            place = _place(y[at] - p[cell], least[cell], wide[cell])
            place >>= _BITS * (_DIGITS - 1 - k)
            place &= _BASE - 1
            place += (leaf * _BASE).astype(np.int32)[cell]
            counts += np.bincount(place, minlength=len(counts))
        out.append(counts)
    return out


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def _least(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [np.minimum(x, y) for x, y in zip(a, b)]


class Spread:
    """Parts of a table (rows of ``part``) and the state of their cells, on Spark."""

    def __init__(self, parts, cuts: list[np.ndarray], s: Settings, delete):
        wide, kind, models = len(cuts), code_type(cuts), len(s.levels)
        self.s, self.delete, self.file = s, delete, None
        rows = parts.rdd
        self.hashes = self._kept(rows.map(lambda row: np.frombuffer(row["hashes"], np.uint64)), StorageLevel.DISK_ONLY)
        self.parts = self._kept(rows.map(lambda row: _opened(row, wide, kind)), StorageLevel.DISK_ONLY)
        self.state = self._kept(self.parts.map(lambda p: _begun(p, models)))
        # few cells are counted on the driver, or none
        self.local = self._together() if self.state.map(lambda x: len(x[0])).sum() <= _HELD else None

    @staticmethod
    def _kept(rdd, level=StorageLevel.MEMORY_AND_DISK):
        # parts and states are paired one by one, without passing Python for it
        return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(level)

    def _together(self) -> tuple:
        codes, low, high, predicted, rows, below = zip(*self.state.collect())
        return *map(np.concatenate, (codes, low, high)), np.concatenate(predicted, axis=1), np.concatenate(rows), np.concatenate(below, axis=1)

    def move(self, values, tree: int) -> None:
        """Add the last trees and count for the next."""
        s, old = self.s, self.state
        self.state = self._kept(self.hashes.zip(self.parts).zip(old).map(lambda x: _moved(*x[0], x[1], values, tree, s)))
        if tree % _CUT == _CUT - 1:
            self.state.checkpoint()
        if self.local is None:
            self.state.foreach(lambda x: None)
        else:
            self.local = self._together()
        old.unpersist()
        if self.state.isCheckpointed():
            last, self.file = self.file, self.state.getCheckpointFile()
            if last:
                self.delete(last)

    def cells(self, count, add):
        """``count`` of the states of all parts."""
        return count(self.local) if self.local is not None else self.state.map(count).reduce(add)

    def rows(self, count, add):
        """``count`` of all parts and their states."""
        return self.parts.zip(self.state).map(lambda x: count(*x)).reduce(add)

    def grown(self, allowed: np.ndarray, bins: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The splits of the next trees as ``(feature, bin)`` by node, -1 in leaves."""
        s, full = self.s, 2 ** (self.s.depth + 1)
        trees = [(np.full(full, -1), np.full(full, -1)) for _ in s.levels]
        open_ = [np.array([0])] * len(trees)
        for _ in range(s.depth):
            if not any(map(len, open_)):
                break
            counts = self.cells(functools.partial(_level_counts, trees=trees, open_=open_, allowed=allowed, bins=bins), _added)
            for m, (rows, below) in enumerate(counts):
                if len(open_[m]):
                    feature, cut = _split(rows, below, s.levels[m], allowed, s)
                    trees[m][0][open_[m]], trees[m][1][open_[m]] = feature, cut
                    kept = open_[m][feature >= 0]
                    open_[m] = np.stack([2 * kept + 1, 2 * kept + 2], axis=1).ravel()
        return trees

    def valued(self, trees) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(value, rows)`` of the leaves of the trees, as ``quantiles`` gives them."""
        depth, picked, spans = self.s.depth, [None] * len(trees), []
        ranges = [(low, -high) for low, high in self.cells(functools.partial(_ranges, trees=trees, depth=depth), _least)]
        for low, high in ranges:
            spans.append((low, np.where(high > low, high - low, 1.0)))
        for k in range(_DIGITS):
            founds = [p and p[1] for p in picked]
            counts = self.rows(functools.partial(_digit_counts, trees=trees, spans=spans, founds=founds, k=k, depth=depth), _added)
            picked = [_picked(c, level, p) for c, level, p in zip(counts, self.s.levels, picked)]
        return [_value(low, high, width, p) for (low, high), (_, width), p in zip(ranges, spans, picked)]

    def clear(self) -> None:
        self.state.unpersist()
        self.parts.unpersist()
        self.hashes.unpersist()
        if self.file:
            self.delete(self.file)


def fit_spread(parts, cuts: list[np.ndarray], s: Settings, delete) -> list[tuple]:
    """Nodes ``(model, tree, node, feature, cut, value, cover)`` of all quantiles, those that ``fit_level`` gives for the rows of all parts.

    ``parts`` is a stored table of ``part``; ``delete`` takes the path of a checkpoint that is no longer read.
    """
    wide, bins, full = len(cuts), max([len(c) for c in cuts], default=0) + 1, 2 ** (s.depth + 1)
    spread = Spread(parts, cuts, s, delete)
    trees = [(np.full(full, -1), np.full(full, -1)) for _ in s.levels]
    found = spread.valued(trees)
    values, out = [value for value, _ in found], [[(-1, 0, -1, 0.0, float(value[0]), int(cover[0]))] for value, cover in found]
    for t in range(s.trees if wide else 0):
        spread.move([(*tree, value) for tree, value in zip(trees, values)], t)
        trees = spread.grown(_allowed(wide, t, s), bins)
        found = spread.valued(trees)
        values = [s.step * value for value, _ in found]
        for m, ((feature, cut), (value, cover)) in enumerate(zip(trees, found)):
            splits = {n: (int(feature[n]), int(cut[n])) for n in np.flatnonzero(feature >= 0).tolist()}
            out[m] += _nodes(t, splits, cuts, value, cover, s)
    spread.clear()
    return [(m, *node) for m, nodes in enumerate(out) for node in nodes]


class Forest:
    """The trees of one quantile as arrays over (tree, node of a full binary tree)."""

    def __init__(self, rows: list[tuple], depth: int, features: int):
        """``rows`` are ``(tree, node, feature, cut, value, cover)``; tree -1 is the base value."""
        size = 2 ** (depth + 1) - 1
        trees = 1 + max((r[0] for r in rows), default=-1)
        self.depth, self.features = depth, features
        self.base = float(sum(r[4] for r in rows if r[0] < 0))
        self.feature = np.full((trees, size), -1, dtype=np.int32)
        self.cut, self.value, cover = np.zeros((trees, size)), np.zeros((trees, size)), np.zeros((trees, size))
        for t, x, f, c, v, n in rows:
            if t >= 0:
                self.feature[t, x], self.cut[t, x], self.value[t, x], cover[t, x] = f, c, v, n
        # the value of an inner node is the mean of its leaves, weighted by their rows
        for x in range(size // 2 - 1, -1, -1):
            inner = self.feature[:, x] >= 0
            n = cover[:, 2 * x + 1] + cover[:, 2 * x + 2]
            mean = (cover[:, 2 * x + 1] * self.value[:, 2 * x + 1] + cover[:, 2 * x + 2] * self.value[:, 2 * x + 2]) / np.maximum(n, 1)
            self.value[:, x], cover[:, x] = np.where(inner, mean, self.value[:, x]), np.where(inner, n, cover[:, x])
        self.tables = self.changes = None  # made by the task that reads them

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Leaf of each row of ``x`` (rows, features) in one tree."""
        at = np.zeros(len(x), dtype=np.int64)
        rows, feature, cut = np.arange(len(x)), self.feature[tree], self.cut[tree]
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] > cut[at]), at)
        return at

    def _walk(self, x: np.ndarray):
        """Leaf of each row of ``x`` by tree, as places among the ``2 ** depth`` leaves of a full tree, and the places' nodes."""
        nodes = self.places()
        if self.depth > 6:  # more leaves than bits of a mask
            back = np.zeros((len(nodes), self.feature.shape[1]), dtype=np.intp)
            np.put_along_axis(back, nodes, np.broadcast_to(np.arange(nodes.shape[1]), nodes.shape), axis=1)
            for t in range(len(nodes)):
                yield back[t, self.leaves(x, t)]
            return
        tables, codes = self.masks(), self.codes(x)
        mask, more, one = np.empty(len(x), np.uint64), np.empty(len(x), np.uint64), np.uint64(1)
        for t in range(len(nodes)):
            mask.fill(np.uint64(2**64 - 1))
            for table, code, used in zip(tables, codes, self.used):
                if used[t]:
                    np.take(table[t], code, out=more, mode="clip")
                    np.bitwise_and(mask, more, out=mask)
            # the leaf is the lowest bit left
            np.subtract(mask, one, out=more)
            np.bitwise_and(np.invert(mask, out=mask), more, out=mask)
            yield np.bitwise_count(mask).astype(np.intp)

    def places(self) -> np.ndarray:
        """(tree, place): the node where the rows of a place among the leaves of a full tree end."""
        nodes = np.zeros((len(self.feature), 1), dtype=np.intp)
        for _ in range(self.depth):
            split = np.take_along_axis(self.feature, nodes, axis=1) >= 0
            nodes = np.stack([np.where(split, 2 * nodes + 1, nodes), np.where(split, 2 * nodes + 2, nodes)], axis=2).reshape(len(nodes), -1)
        return nodes

    def masks(self) -> list[np.ndarray]:
        """For each group of features a table (tree, code) of the places that a row with this code can still reach.

        A split that sends a row to the right takes away the places on its left, so the row's leaf is the first place in the masks of
        all its features. Neighbouring features share a table while it has at most ``_CELLS`` codes.
        """
        if self.tables is None:
            self.cuts, alone = [], []
            for f in range(self.features):
                cuts = np.unique(self.cut[self.feature == f])
                table = np.full((len(self.feature), len(cuts) + 1), 2**64 - 1, dtype=np.uint64)
                for node in range(self.feature.shape[1] // 2):
                    level = (node + 1).bit_length() - 1
                    width = 2 ** (self.depth - level)
                    left = ((1 << width // 2) - 1) << (node + 1 - 2**level) * width
                    trees = np.flatnonzero(self.feature[:, node] == f)
                    over = np.arange(len(cuts) + 1) > np.searchsorted(cuts, self.cut[trees, node])[:, None]
                    table[trees] &= np.where(over, np.uint64(2**64 - 1 - left), np.uint64(2**64 - 1))
                self.cuts.append(cuts)
                alone.append(table)
            groups: list[list[int]] = []
            for f in range(self.features):
                if groups and np.prod([alone[g].shape[1] for g in [*groups[-1], f]]) <= _CELLS:
                    groups[-1].append(f)
                else:
                    groups.append([f])
            tables = []
            for group in groups:
                joint = alone[group[0]]
                for f in group[1:]:
                    joint = (joint[:, :, None] & alone[f][:, None, :]).reshape(len(joint), -1)
                tables.append(np.ascontiguousarray(joint))
            self.groups, self.tables = groups, tables
            self.used = [np.isin(self.feature, g).any(axis=1) for g in groups]
        return self.tables

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """The code of each row in each table: the cuts its values exceed; NaN exceeds none."""
        out = []
        for group in self.groups:
            joint = np.zeros(len(x), dtype=np.intp)
            for f in group:
                code = np.searchsorted(self.cuts[f], x[:, f], side="left")
                joint = joint * (len(self.cuts[f]) + 1) + np.where(np.isnan(x[:, f]), 0, code)
            out.append(joint)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(self.value):
            values = np.take_along_axis(self.value, self.places(), axis=1)
            for value, at in zip(values, self._walk(x)):
                out += value[at]
        return out

    def mean(self) -> float:
        """The base value with the mean of every tree: what a row's attributions start from."""
        return self.base + float(self.value[:, 0].sum()) if len(self.value) else self.base

    def steps(self) -> np.ndarray:
        """(tree, node, feature): changes of value on the way from the root, by the feature of the split taken."""
        if self.changes is None:
            out, trees = np.zeros((*self.feature.shape, self.features)), np.arange(len(self.feature))
            for x in range(self.feature.shape[1] // 2):
                inner = trees[self.feature[:, x] >= 0]
                for child in (2 * x + 1, 2 * x + 2):
                    out[inner, child] = out[inner, x]
                    out[inner, child, self.feature[inner, x]] += self.value[inner, child] - self.value[inner, x]
            self.changes = out
        return self.changes

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``predict(x)`` and ``attribute(x)``, the trees walked once."""
        shares, predicted = np.zeros((len(x), self.features)), np.full(len(x), self.base)
        if len(self.value):
            nodes = self.places()
            values, steps = np.take_along_axis(self.value, nodes, axis=1), np.take_along_axis(self.steps(), nodes[:, :, None], axis=1)
            for value, step, at in zip(values, steps, self._walk(x)):
                predicted += value[at]
                shares += np.take(step, at, axis=0)
        return predicted, shares

    def attribute(self, x: np.ndarray) -> np.ndarray:
        """(row, feature): additive shares of the features in the prediction minus ``mean()``."""
        return self.explain(x)[1]
