"""Chat formatting with a token mask: conversations are rendered whole, encoded once, and turn spans meet token spans.

A turn is ``mark role newline mark text mark newline``. The mark is a special token of the tokenizer, so a token never
reaches over it and a span always begins and ends with tokens. In roles and texts every backslash is doubled and every mark gets a backslash
after its first character; ``unescape`` takes both back. The spans of the turns are sorted by construction; each token
finds its span by binary search, and is under the loss mask if it lies inside a span of a role that is learned.

Rows are shuffled once, by conversation, and stream through their task in the order of turns. Conversations with turns outside
``0 .. TURNS - 1`` are cut by the number of the turn, and any run longer than ``CHARS`` is cut between turns, so that a hot
conversation is spread over tasks and never held whole: a mark begins each turn, so the ids of the parts, joined, are
those of the whole text. Only the digests of cut conversations are folded in one pass, text by text.

Null roles and texts count as empty. Rows of one turn are ordered by role and text (nulls first) and repeated rows all stay. Rows
without a conversation are one conversation. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import byte_bpe, token_bytes
from .common import small, written
from .common_py import worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of a part of a conversation that has other turns than the first so many.
TURNS = 64
#: Characters after which a part is cut before its next turn.
CHARS = 1 << 20
_ROWS = 256
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, mark: str) -> str:
    return text.replace("\\", "\\\\").replace(mark, f"{mark[0]}\\{mark[1:]}")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]], mark: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted text of ``(role, text)`` turns, and ``(start, end, role)`` of each text in bytes, ascending."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{mark}{escape(role, mark)}\n{mark}", escape(text, mark)
        start = at + len(head.encode())
        end = start + len(body.encode())
        spans.append((start, end, role))
        out += [head, body, mark, "\n"]
        at = end + len(mark.encode()) + 1
    return "".join(out), spans


def loss_mask(sizes: np.ndarray, spans: list[tuple[int, int, str]], learned) -> np.ndarray:
    """Whether each token, given by its size in bytes, lies inside a span of a learned role."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    lows = np.array([s for s, _, _ in spans], dtype=np.int64)
    highs = np.array([e if role in learned else -1 for _, e, role in spans], dtype=np.int64)
    if not len(lows):
        return np.zeros(len(sizes), dtype=bool)
    at = np.searchsorted(lows, starts, side="right") - 1
    return (at >= 0) & (ends <= highs[at])


def parse(text: str, mark: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    parts = text.split(mark)
    return [(unescape(parts[i])[:-1], unescape(parts[i + 1])) for i in range(1, len(parts) - 2, 3)]


def _tokens(path: str):
    def make():
        shown = token_bytes(path)
        return shown, np.array([len(b) for b in shown], dtype=np.int64)

    return worker_state(("token_bytes", path), make)


def _formatted(batches, path: str, mark: str, learned):
    """Sorted rows ``(id, part, whole, role, text)`` to one row for each run of an id and part, or piece of a long one."""
    model, (_, sizes) = byte_bpe(path), _tokens(path)
    if mark not in model.special:
        raise ValueError(f"{mark!r} is no special token of {path}")
    out, held = [], 0

    def close(key, turns, piece, open_):
        text, spans = render(turns, mark)
        ids = np.frombuffer(model.encode(text), dtype="<u4").astype(np.int32)
        return {
            "id": key[0], "part": key[1], "piece": piece, "whole": key[2] and piece == 0 and not open_, "n_turns": len(turns), "formatted": text,
            "ids": ids, "loss": loss_mask(sizes[ids], spans, learned),
        }

    def flushed():
        names = ["id", "part", "piece", "whole", "n_turns", "formatted", "ids", "loss"]
        kinds = [id_type, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)

    key, turns, chars, piece = None, [], 0, 0
    for batch in batches:
        id_type = batch.column(0).type
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for i, part, whole, role, text in zip(*columns):
            if key != (i, part, whole) or chars >= CHARS:
                same = key == (i, part, whole)
                if turns:
                    out.append(close(key, turns, piece, same))
                    held += chars
                key, piece, turns, chars = (i, part, whole), piece + 1 if same else 0, [], 0
                if held >= CHARS or len(out) >= _ROWS:
                    yield flushed()
                    out.clear()
                    held = 0
            turns.append((role, text))
            chars += len(role) + len(text)
    if turns:
        out.append(close(key, turns, piece, False))
    if out:
        yield flushed()


def format_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    path: str = "byte_bpe_50k.json", mark: str = "<|endoftext|>", learned=("assistant",), turns: int = TURNS,
) -> DataFrame:
    """Rows ``(id, part, piece, whole, n_turns, formatted, ids, loss)``: the formatted text, its ids and their loss mask.

    A conversation that is ``whole`` has one row; of any other, the rows in the order of ``part`` and ``piece`` make it up.
    """
    turn, text = F.col(turn_col), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    far = rows.where(turn.isNull() | (turn < 0) | (turn >= turns)).select(F.col(id_col).alias("long_id")).distinct()
    far = small(written(far, "long-conversations")).withColumn("long", F.lit(True))
    cut = rows.join(far, F.col(id_col).eqNullSafe(F.col("long_id")), "left")
    part = F.when(F.col("long"), F.floor(turn / turns)).otherwise(F.lit(0)).cast("long")
    cut = cut.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit(-(1 << 62))).alias("part"), F.col("long").isNull().alias("whole"), turn.alias("turn"), F.col(role_col).alias("raw_role"), F.col(text_col).alias("raw_text"))
    order = ["id", "part", F.asc_nulls_first("turn"), F.asc_nulls_first("raw_role"), F.asc_nulls_first("raw_text")]
    cut = cut.repartition("id", "part").sortWithinPartitions(*order).select("id", "part", "whole", text("raw_role").alias("role"), text("raw_text").alias("text"))
    kind = cut.schema["id"]
    schema = T.StructType([kind]).add("part", "long").add("piece", "long").add("whole", "boolean").add("n_turns", "long").add("formatted", "string")
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("loss", T.ArrayType(T.BooleanType()))
    learned = frozenset(learned)
    return cut.mapInArrow(lambda batches: _formatted(batches, path, mark, learned), schema)


_READ = ["n_turns", "formatted_chars", "loss_chars", "turns_sha256", "loss_sha256", "turns", "learned"]


def _read(batches, path: str, mark: str):
    """Turns and learned texts of formatted rows: digests where a row is a whole conversation, else the texts themselves."""
    shown, _ = _tokens(path)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        at = batch.schema.get_field_index
        out = {n: [] for n in _READ}
        whole = batch.column(at("whole")).to_pylist()
        for i, text in enumerate(batch.column(at("formatted")).to_pylist()):
            turns = parse(text, mark)
            said = "".join([f"{role}\n{body}\n" for role, body in turns])
            ids = batch.column(at("ids"))[i].values.to_numpy()
            mask = batch.column(at("loss"))[i].values.to_numpy(zero_copy_only=False)
            learned = unescape(b"".join([shown[k] for k in ids[mask].tolist()]).decode())
            values = [len(turns), len(text), len(learned), *((digest(said), digest(learned), None, None) if whole[i] else (None, None, said, learned))]
            for n, v in zip(_READ, values):
                out[n].append(v)
        kinds = [pa.int64()] * 3 + [pa.string()] * 4
        keys = [batch.column(at(n)) for n in ("id", "part", "piece")]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(out[n], k) for n, k in zip(_READ, kinds))], names=["id", "part", "piece", *_READ])


def _fold(batches):
    """Rows of ``_read`` in order to one row a conversation; the texts of cut ones go through their digests one by one."""
    names = ["id", *_READ[:5]]
    key, sums, hashes = None, None, None

    def done():
        return [key[0], *sums, *(h.hexdigest() for h in hashes)]

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["turns_sha256"] is not None:
                out.append([r[n] for n in names])
                continue
            if key != (r["id"],):
                if key:
                    out.append(done())
                key, sums, hashes = (r["id"],), [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
            sums = [a + r[n] for a, n in zip(sums, _READ[:3])]
            for h, n in zip(hashes, ("turns", "learned")):
                h.update(r[n].encode())
        kinds = [batch.schema.field("id").type, *[pa.int64()] * 3, *[pa.string()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds)], names=names)


def read_back(formatted: DataFrame, path: str = "byte_bpe_50k.json", mark: str = "<|endoftext|>") -> DataFrame:
    """One row a conversation, from formatted rows alone: ``id``, ``n_turns``, ``formatted_chars``, ``loss_chars``,
    ``turns_sha256`` (of role, newline, text, newline for each turn) and ``loss_sha256`` (of the text under the mask)."""
    kind = formatted.schema["id"]
    numbers, texts = [T.StructField(n, T.LongType()) for n in _READ[:3]], [T.StructField(n, T.StringType()) for n in _READ[3:]]
    place = [kind, T.StructField("part", T.LongType()), T.StructField("piece", T.LongType())]
    rows = formatted.select("id", "part", "piece", "whole", "formatted", "ids", "loss")
    rows = rows.mapInArrow(lambda batches: _read(batches, path, mark), T.StructType([*place, *numbers, *texts]))
    rows = rows.repartition("id").sortWithinPartitions("id", "part", "piece")
    return rows.mapInArrow(_fold, T.StructType([kind, *numbers, *texts[:2]]))
