"""Token counts that follow edits: a segment tree over the pre-tokens of each text.

The leaves of a text's tree are the tokenizer's own pre-tokens with their characters and tokens, inner
nodes hold sums. Pre-tokens are found from left to right, and each is settled by its own characters
and at most two behind it. So an edit finds its leaves from the sums, takes in the leaves that look
at a changed character, encodes that region with a few leaves behind it as context, and widens it only
until a pre-token begins where one began before: from there on nothing can differ. The sums on the way up
are updated; nothing else is encoded again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.bpe import default_path, encoder
from tablewise.llm.common import map_texts, text_slices

#: What the query's edits mask: addresses with an at sign, and runs of four digits or more.
MASKED = r"[^\s@]{1,64}@[^\s@]{1,190}|[0-9]{4,}"
MASK = "<masked>"
#: Leaves behind a region that are encoded with it: a run of blanks is two of them at most, and what follows decides.
CONTEXT = 3
EDITS = "array<struct<start:int,stop:int,put:string>>"


class TokenTree:
    """Sums of characters and tokens over the pre-tokens of one text; positions are code points."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        chars, tokens = chars or [0], tokens or [0]  # an empty text is an empty leaf
        self.text, self.leaves = text, len(chars)
        self.size = 1 << max(0, (max(1, len(chars)) - 1).bit_length())
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)
        self.begin = np.concatenate([[0], np.cumsum(chars)]).tolist()
        self.changed: dict[int, str] = {}
        self.encoded = 0

    def _sums(self, values: list[int]) -> list[int]:
        out = [0] * self.size + list(values) + [0] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            out[i] = out[2 * i] + out[2 * i + 1]
        return out

    @property
    def total(self) -> int:
        return self.tokens[1]

    def piece(self, leaf: int) -> str:
        return self.changed[leaf] if leaf in self.changed else self.text[self.begin[leaf]:self.begin[leaf + 1]]

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds a character, and the leaf's first place; the end falls into the last filled leaf."""
        place = min(place, max(0, self.chars[1] - 1))
        node, before = 1, 0
        while node < self.size:
            left = self.chars[2 * node]
            node *= 2
            if place >= before + left:
                before, node = before + left, node + 1
        return node - self.size, before

    def _set(self, leaf: int, piece: str, tokens: int) -> None:
        self.changed[leaf] = piece
        node = self.size + leaf
        self.chars[node], self.tokens[node] = len(piece), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _after(self, leaf: int, how_many: int) -> list[int]:
        """The next leaves that are not empty."""
        out = []
        while len(out) < how_many and leaf + 1 < self.leaves:
            leaf += 1
            if self.chars[self.size + leaf]:
                out.append(leaf)
        return out

    def edit(self, start: int, stop: int, put: str, prefix) -> None:
        """Replace ``[start, stop)``; ``prefix(text, length)`` tells whether a pre-token begins at that length, the
        tokens before it and all tokens."""
        start = min(max(0, start), self.chars[1])
        stop = min(max(start, stop), self.chars[1])
        first, at = self.find(start)
        last = max(first, self.find(stop - 1)[0] if stop > start else first)
        # A pre-token may look at two characters behind its end.
        while first > 0 and (at > start - 2 or not self.chars[self.size + first]):
            first -= 1
            at -= self.chars[self.size + first]
        old = "".join(self.piece(i) for i in range(first, last + 1))
        new, more = old[:start - at] + put + old[stop - at:], 1
        while True:
            behind = self._after(last, CONTEXT)
            fits, tokens, encoded = prefix(new + "".join(map(self.piece, behind)), len(new)) if new or behind else (True, 0, 0)
            self.encoded += encoded
            if fits:
                break
            taken = self._after(last, more)
            new, last, more = new + "".join(map(self.piece, taken)), taken[-1], 2 * more
        for i in range(first + 1, last + 1):
            if self.chars[self.size + i]:
                self._set(i, "", 0)
        self._set(first, new, tokens)

    def current(self) -> str:
        return "".join(self.piece(i) for i in range(self.leaves))


def apply_edits(tree: TokenTree, edits, prefix) -> None:
    """Edits of one text, given by places in the text as it was; they must not overlap."""
    for start, stop, put in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        tree.edit(start, stop, put, prefix)


def edited_counts(docs: DataFrame, path: str | None = None, pattern: str = MASKED, put: str = MASK) -> DataFrame:
    """All columns of ``docs`` with ``n_tokens``, ``n_edits``, ``n_tokens_after``, ``n_encoded_again``, ``text_after``.

    Edits come from a column ``edits`` of that name if there is one (null: none), else every match
    of ``pattern`` is replaced. Null and empty texts have 0 tokens; repeated rows count alike; older
    columns of these names are replaced.
    """
    path, given = path or default_path(), "edits" in docs.columns
    added = "n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_encoded_again bigint, text_after string"
    source = docs.withColumn("text", F.col("text").cast("string"))
    if given:
        source = source.withColumn("_both", F.struct(F.coalesce("text", F.lit("")).alias("t"), F.col("edits").cast(EDITS).alias("e")))

    def work():
        enc, masked = encoder(path), re.compile(pattern)

        def run(column):
            texts = column.field("t") if given else column
            lists = column.field("e").to_pylist() if given else None
            out: list[list] = [[], [], [], [], []]
            for low, high, _, _ in text_slices(texts, 1 << 22):
                part = texts.slice(low, high - low)
                _, totals = enc.encode(part)
                for i, text in enumerate(part.to_pylist()):
                    text = text or ""
                    edits = [(e["start"], e["stop"], e["put"] or "") for e in lists[low + i] or ()] if given else [
                        (*m.span(), put) for m in masked.finditer(text)]
                    n = int(totals[i])
                    if edits:
                        tree = TokenTree(text, *enc.pretokens(text))
                        apply_edits(tree, edits, enc.prefix)
                        row = n, len(edits), tree.total, tree.encoded, tree.current()
                    else:
                        row = n, 0, n, 0, text
                    for held, v in zip(out, row):
                        held.append(v)
            return out
        return run

    if given:
        return map_texts(source, added, work, "_both").drop("_both")
    return map_texts(source, added, work)
