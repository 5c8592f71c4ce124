"""Byte-level BPE ids by pre-token, with a cache of whole pre-tokens; equal to what the tokenizers library returns."""

from __future__ import annotations

import re
import sys

import numpy as np
import regex
from pyspark import cloudpickle

from .common_py import WordCache, tokenizer_file, worker_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pattern by which this kind of tokenizer cuts a text, and the same for texts of Latin-1 characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Characters whose class is the same in every Unicode version and library, besides Latin-1.
_UNSURE = re.compile("[^\x00-\xffĀ-ɏΑ-ΡΣ-Ωα-ωА-яЁё一-龥ぁ-んァ-ヶ–—‘’“”•…€]")
_GENERAL = regex.compile(PATTERN)


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file(path))
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.marks = re.compile("|".join(re.escape(s) for s in self.special)) if self.special else None
        self.cache = WordCache(self._fill)
        self.sizes = WordCache(lambda word: len(self.cache[word]) // 4)

    def _fill(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def parts(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        try:
            text.encode("latin-1")
            return LATIN.findall(text)
        except UnicodeEncodeError:
            if not _UNSURE.search(text):
                return _GENERAL.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a whole text; the string of a special token is one of them."""
        if not self.special or not any(s in text for s in self.special):
            return self.parts(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.parts(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.parts(text[at:])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        cache = self.cache
        return b"".join([cache[w] for w in self.pretokens(text or "")])


def byte_bpe(path: str) -> ByteBpe:
    return worker_state(("byte_bpe", path), lambda: ByteBpe(path))


def token_bytes(path: str) -> list[bytes]:
    """The bytes each id stands for; ids of special tokens stand for their strings."""
    model = byte_bpe(path)
    # printable characters stand for their own byte, the other bytes are numbered from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    vocabulary = model.library.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() if token in model.special else bytes(shown[c] for c in token)
    return out
