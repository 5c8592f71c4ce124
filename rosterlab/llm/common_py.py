"""Helpers that run inside Python tasks: state kept by a worker between tasks, and Arrow batches in small slices."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows handled at once in a Python task, so that memory follows the longest texts of few rows.
SLICE = 256
#: Entries of a word cache, about 200 bytes each.
CACHE = 600_000


def worker_state(key, make):
    """``make()`` once per worker process; functions sent by value would otherwise forget it after each task."""
    store = sys.modules.setdefault("rosterlab_worker_state", types.ModuleType("rosterlab_worker_state")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def slices(batches, rows: int = SLICE):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def with_columns(batch: pa.RecordBatch, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def tokenizer_file(path: str) -> str:
    """``path`` itself, or the place of a public tokenizer file where only its name is given; looked up in the task."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class WordCache(dict):
    """Values by word, computed on a miss by ``fill(word)``.

    Holds two generations of half the limit each: when the newer one is full, it becomes the older one, and words found
    there move up again, so frequent words stay.
    """

    def __init__(self, fill, limit: int = CACHE):
        super().__init__()
        self.fill, self.half, self.older = fill, max(1, limit // 2), {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.fill(word)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value
