"""Exact encoding and decoding with a SentencePiece model of the merge type.

The encoder walks a word from the left. An Aho-Corasick automaton names the pieces that start at each position; the
longest is tried first. A piece may follow another only if merging their joined text from its characters gives exactly
these two pieces again (checked once per pair). Where no piece fits, the position is marked in a bitfield of failed
positions and the walk steps back. Words are cut before runs of the white-space mark and at characters of no piece,
across which no merge reaches; such characters become their UTF-8 bytes.

Nulls count as empty texts. Extra columns pass through; the added columns must not exist yet.
"""

from __future__ import annotations

import re
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common_py import WordCache, slices, tokenizer_file, with_columns, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
PAIRS = 1_000_000


class Pieces:
    """Pieces of one model; reads the model file, encodes by itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(path))
        self.size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_id, plain, self.shown = {}, {}, [b""] * self.size
        for i, p in enumerate(text):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.shown[i] = bytes([int(p[3:5], 16)])
            elif model.is_unknown(i):
                self.unknown, self.shown[i] = i, " ⁇ ".encode()
            elif not model.is_control(i):
                plain[p] = i
                self.shown[i] = p.replace(MARK, " ").encode()
        self.is_byte = np.zeros(self.size, dtype=bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.id, self.text = plain, text
        self.rank = {p: -model.get_score(i) for p, i in plain.items()}
        self.alphabet = frozenset("".join(plain))
        self.loose = frozenset(c for c in self.alphabet if c not in plain)
        self.automaton = ahocorasick.Automaton()
        for p, i in plain.items():
            if self.merge(p) == [p]:  # others are never the result of merging
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs = WordCache(self._fits, PAIRS)
        self.words, self.spaced = WordCache(self._word), WordCache(self._spaced)
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def merge(self, text: str) -> list[str]:
        """Merging from characters: always the best-ranked adjacent pair, the leftmost among equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair) -> bool:
        a, b = self.text[pair[0]], self.text[pair[1]]
        return self.merge(a + b) == [a, b]

    def backtrack(self, word: str) -> list[int]:
        """Ids of a word all of whose characters are pieces."""
        fits, out = self.pairs, []
        for _, found in self.automaton.iter_long(word):  # no step back where the longest pieces fit one another
            if out and not fits[out[-1], found[1]]:
                break
            out.append(found[1])
        else:
            return out
        n, starts = len(word), [[] for _ in word]
        for end, found in self.automaton.iter(word):  # for one start the shorter piece comes first
            starts[end + 1 - found[0]].append(found)
        open_ = (1 << (n + 1)) - 1
        out, at, k = [], [0], [len(starts[0]) - 1]  # chosen ids, their starts, next choice at the last start
        while at[-1] < n:
            pos, choice, last = at[-1], k[-1], out[-1] if out else None
            options = starts[pos]
            while choice >= 0:
                size, i = options[choice]
                if open_ >> (pos + size) & 1 and (last is None or fits[last, i]):
                    break
                choice -= 1
            if choice >= 0:
                k[-1] = choice
                out.append(i)
                at.append(pos + size)
                k.append(len(starts[pos + size]) - 1 if pos + size < n else 0)
            else:
                open_ &= ~(1 << pos)
                if not out:
                    return self._merged(word)
                out.pop(), at.pop(), k.pop()
                k[-1] -= 1
        return out

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_id.get(x, self.unknown) for x in text.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]

    def _merged(self, word: str) -> list[int]:
        return [i for p in self.merge(word) for i in ([self.id[p]] if p in self.id else self._bytes(p))]

    def _word(self, word: str) -> bytes:
        """Ids of a run of marks and what follows it, or of any other part of a text."""
        return array("i", self._ids(word)).tobytes()

    def _ids(self, word: str) -> list[int]:
        if self.alphabet.issuperset(word):
            return self.backtrack(word) if self.loose.isdisjoint(word) else self._merged(word)
        ids, at = [], 0
        for i, c in enumerate(word):
            if c not in self.alphabet:
                if i > at:
                    ids += self._ids(word[at:i])
                ids += self._bytes(c)
                at = i + 1
        return ids + self._ids(word[at:]) if at < len(word) else ids

    def _spaced(self, word: str) -> bytes:
        """Ids of a word with one space before it; line ends inside it are cut off first."""
        if "\n" in word:
            return b"".join([self.words[w] for w in self.split.findall(MARK + word)])
        return self._word(MARK + word)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit integers."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or MARK in text:
            words = self.words
            return b"".join([words[w] for w in self.split.findall(MARK + text.replace(" ", MARK))])
        words = self.spaced
        return b"".join([words[w] for w in text.split(" ")])

    def decode(self, ids) -> str:
        """Text of the ids: bytes are joined, invalid ones become U+FFFD one by one, one leading space goes."""
        ids = np.asarray(ids, dtype=np.int64)
        shown = self.shown
        whole = b"".join([shown[i] for i in ids.tolist()])
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = self._repaired(ids)
        lead = len(ids) and not self.is_byte[ids[0]] and shown[ids[0]].startswith(b" ") and ids[0] != self.unknown
        return text[1:] if lead else text

    def _repaired(self, ids: np.ndarray) -> str:
        out, raw = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                raw += self.shown[i]
                continue
            while raw:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[:n].decode())
                        raw = raw[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    raw = raw[1:]
            if i is not None:
                out.append(self.shown[i].decode())
        return "".join(out)


def pieces(path: str) -> Pieces:
    return worker_state(("pieces", path), lambda: Pieces(path))


def _encode_batches(batches, path: str, at: int, decode: bool):
    model = pieces(path)
    for batch in slices(batches):
        coded = [model.encode(t) for t in batch.column(at).to_pylist()]
        stops = np.cumsum([0, *(len(c) // 4 for c in coded)])
        flat = np.frombuffer(b"".join(coded), dtype=np.int32)
        more = {"ids": pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat, pa.int32()))}
        if decode:
            more["decoded"] = pa.array([model.decode(flat[a:b]) for a, b in zip(stops, stops[1:])], pa.string())
        yield with_columns(batch, more)


def encode(docs: DataFrame, text_col: str = "text", path: str = "piece_bpe_32k.model", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if asked, ``decoded``, the text those ids stand for."""
    taken = {"ids", "decoded"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decode:
        schema = schema.add("decoded", T.StringType())
    return docs.mapInArrow(lambda batches: _encode_batches(batches, path, at, decode), schema)


def _decode_batches(batches, path: str, at: int):
    model = pieces(path)
    for batch in slices(batches):
        yield with_columns(batch, {"decoded": pa.array([None if x is None else model.decode(x) for x in batch.column(at).to_pylist()], pa.string())})


def decode(rows: DataFrame, ids_col: str = "ids", path: str = "piece_bpe_32k.model") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids; null ids give null."""
    at = rows.columns.index(ids_col)
    return rows.mapInArrow(lambda batches: _decode_batches(batches, path, at), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
