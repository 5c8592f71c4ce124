"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A document is cut into pre-tokens once. Leaves are blocks of consecutive pre-tokens with their characters and tokens;
every inner node holds the sums of its two children. An edit replaces a span of code points: the tree is descended to the
leaves it touches, the text from some pre-tokens before the span is cut and encoded again until a cut
falls on an old one well behind the span, and the sums on the way up are corrected. All other pre-tokens keep
their counts. The total of the root is the token count of the edited text, equal to encoding it anew.

Where a cut can depend on what follows: the pattern looks ahead by one character only, after white space, and a
contraction or a run of one kind starts anew after any character of another kind. So a cut between two pre-tokens
stands if the text around it, from the start of the pre-token before it to the first character behind it, is unchanged
and its scan began at a true cut. Texts that hold or come to hold the string of a special token are counted anew.

Nulls count as empty texts; null edits as none. Spans are cut to the text. Equal rows get equal results; extra columns
pass through.
"""

from __future__ import annotations

import sys
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import ByteBpe, byte_bpe
from .common_py import slices, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pre-tokens of a leaf, and pre-tokens before an edit that are cut again with it.
LEAF, BEFORE = 64, 3
#: Characters behind an edit that are cut again at first; doubled until the cuts meet.
BEHIND = 64
EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("replacement", T.StringType())])


class CountTree:
    """The text of a document as leaves of pre-tokens under a tree of sums."""

    def __init__(self, text: str, coder: ByteBpe):
        self.coder, self.encoded = coder, 0
        self._build(text)

    def _build(self, text: str) -> None:
        parts = self.coder.pretokens(text)
        self.encoded += len(parts)
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self._measure(i, leaf)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _measure(self, i: int, leaf: list[str]) -> None:
        sizes = self.coder.sizes
        self.chars[self.width + i] = sum(map(len, leaf))
        self.tokens[self.width + i] = sum([sizes[w] for w in leaf])

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last one for the end) and the characters before that leaf."""
        i, before = 1, 0
        while i < self.width:
            left = self.chars[2 * i]
            if at - before < left or not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                before += left
                i = 2 * i + 1
        return i - self.width, before

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = max(0, min(start, self.length))
        stop = max(start, min(start + max(length, 0), self.length))
        special = self.coder.special
        if special and (self.length < 4096 or any(s[0] in replacement for s in special)):
            whole = self.text()
            fresh = whole[:start] + replacement + whole[stop:]
            if any(s in whole or s in fresh for s in special):
                self._build(fresh)
                return
        first, before = self._find(start)
        behind = BEHIND
        while True:
            # the region: leaves from ``first`` (one more to the left if the edit is near its start) to ``last``
            lo = first
            at = before
            while lo > 0 and self._cuts_before(lo, at, start) < BEFORE:
                lo -= 1
                at -= self.chars[self.width + lo]
            last, last_before = self._find(min(stop + behind, self.length))
            old = [w for leaf in self.leaves[lo : last + 1] for w in leaf]
            ends = list(accumulate(map(len, old), initial=0))
            k = 0
            while k < len(old) and at + ends[k + 1] <= start:
                k += 1
            k = max(0, k - BEFORE) if lo or k > BEFORE else 0
            region = "".join(old[k:])
            shift = at + ends[k]
            text = region[: start - shift] + replacement + region[stop - shift :]
            if special and any(s in text for s in special):
                whole = self.text()
                self._build(whole[:start] + replacement + whole[stop:])
                return
            fresh = self.coder.parts(text)
            self.encoded += len(fresh)
            if last_before + self.chars[self.width + last] >= self.length:  # up to the end of the text
                kept_new, kept_old = len(fresh), len(old)
                break
            # meet: a new cut on an old one, at least a whole pre-token behind the edit and before the region's end
            moved = len(replacement) - (stop - start)
            cuts = {shift + e: i for i, e in enumerate(accumulate(map(len, fresh), initial=0))}
            met = None
            for j in range(k + 1, len(old) - 1):
                place = at + ends[j]
                if place > stop + 1 and at + ends[j - 1] > stop and place + moved in cuts and at + ends[j - 1] + moved in cuts:
                    met = (cuts[place + moved], j)
                    break
            if met:
                kept_new, kept_old = met
                break
            behind *= 4
        self._replace(lo, last, old[:k] + fresh[:kept_new] + old[kept_old:])

    def _cuts_before(self, leaf: int, at: int, start: int) -> int:
        n = 0
        for w in self.leaves[leaf]:
            at += len(w)
            if at > start:
                break
            n += 1
        return n

    def _replace(self, lo: int, last: int, parts: list[str]) -> None:
        """New pre-tokens for the leaves ``lo`` to ``last``; only their sums and those above them change."""
        n = last - lo + 1
        share = -(-len(parts) // n) if parts else 0
        if share > 4 * LEAF:  # much was inserted: the leaves are laid out anew, counts of the words are known
            leaves = [w for leaf in [*self.leaves[:lo], parts, *self.leaves[last + 1 :]] for w in leaf]
            self.leaves = [leaves[i : i + LEAF] for i in range(0, len(leaves), LEAF)] or [[]]
            self.width = 1 << (len(self.leaves) - 1).bit_length()
            self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
            for i, leaf in enumerate(self.leaves):
                self._measure(i, leaf)
            for i in range(self.width - 1, 0, -1):
                self._sum(i)
            return
        above = set()
        for j in range(n):
            self.leaves[lo + j] = leaf = parts[j * share : (j + 1) * share]
            self._measure(lo + j, leaf)
            above.add((self.width + lo + j) // 2)
        while above:
            for i in above:
                if i:
                    self._sum(i)
            above = {i // 2 for i in above if i > 1}


def _counted(batches, path: str, text_at: int, edits_at: int):
    coder = byte_bpe(path)
    for batch in slices(batches):
        before, after, chars, again = [], [], [], []
        for text, edits in zip(batch.column(text_at).to_pylist(), batch.column(edits_at).to_pylist()):
            tree = CountTree(text or "", coder)
            before.append(tree.total)
            tree.encoded = 0
            for e in edits or []:
                if e is not None:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            after.append(tree.total), chars.append(tree.length), again.append(tree.encoded)
        yield with_columns(batch, {k: pa.array(v, pa.int64()) for k, v in (("n_tokens", before), ("edited_tokens", after), ("edited_chars", chars), ("reencoded", again))})


def count_edited(docs: DataFrame, text_col: str = "text", edits_col: str = "edits", path: str = "byte_bpe_50k.json") -> DataFrame:
    """``docs`` with the token counts of each text and of the text after its edits.

    ``edits_col`` is an array of ``(start, length, replacement)`` in code points, applied one after the other, each to the
    text as the ones before left it. Adds ``n_tokens``, ``edited_tokens``, ``edited_chars`` and ``reencoded``, the number of
    pre-tokens that the edits caused to be cut and encoded again.
    """
    new = ["n_tokens", "edited_tokens", "edited_chars", "reencoded"]
    taken = set(new) & set(docs.columns)
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    at = docs.columns.index(text_col), docs.columns.index(edits_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in new)])
    return docs.mapInArrow(lambda batches: _counted(batches, path, *at), schema)


def gather_edits(edits: DataFrame, id_col: str = "doc_id", order_col: str = "seq") -> DataFrame:
    """A table of edits (id, order, start, length, replacement) as one array per document, in order."""
    one = F.struct(F.col(order_col).alias("o"), F.struct("start", "length", "replacement").alias("e"))
    return edits.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["e"]).alias("edits"))


def sample_edits(text_col: str = "text"):
    """Three edits that depend on the text only: a deletion, an insertion of its own start, and a new ending."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    head = F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 20)
    edit = lambda start, length, text: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), text.alias("replacement"))
    return F.array(
        edit(F.floor(n / 3), 10, F.lit("")),
        edit(F.floor(n / 2), 0, head),
        edit(F.greatest(n - 5, F.lit(0)), 5, F.lit(" - edited, 2nd draft.\n")),
    )
