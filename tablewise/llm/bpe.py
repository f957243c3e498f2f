"""Token ids of whole texts with the tokenizers library, words encoded once.

The byte-level pre-tokenizer never joins across a space that is followed by a visible character.
So texts are cut there, each distinct piece is encoded once per batch (and remembered between
batches), and the ids of a text are the pieces' ids in order: the same ids as encoding it whole.
Texts with other blanks around a space are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablewise.llm.common import flat

#: Pieces that a worker remembers and bytes of text that it cuts at once: speed against memory, never results.
REMEMBER, PART_BYTES = 600_000, 1 << 23
#: Pieces that begin with a blank of any kind, or with nothing.
_UNSAFE = re.compile("[\x00-\x20\x7f-\xa0 ᠎ -⁯　﻿]|$")
#: Letters whose class no Unicode version disputes, with a stop or comma behind them or not.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,]?$"

_ENCODERS: dict[tuple, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, remember: int = REMEMBER, part_bytes: int = PART_BYTES) -> "Encoder":
    """One encoder per Python worker and vocabulary, kept between tasks."""
    key = path, remember, part_bytes
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class Encoder:
    """Strings of special tokens in a text are ordinary text."""

    def __reduce__(self):
        # Made anew where it is sent: the library's pickles lose that special tokens are ordinary text.
        return Encoder, (self.path, self.remember, self.part_bytes)

    def __init__(self, path: str, remember: int = REMEMBER, part_bytes: int = PART_BYTES):
        self.path, self.remember, self.part_bytes = path, remember, part_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)  # pieces come once
        # For strings of letters and single spaces, cutting before the spaces is all there is to do.
        self.lettered = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.usual = self.tokenizer.pre_tokenizer
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes behind each id
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.marks = {c: vocab[c] for c in ".,"}
        self.place: dict[str, int] = {}  # piece to its entry in bounds
        self._reset()

    def _reset(self) -> None:
        self.place.clear()
        self.parts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.total, self.known = 0, 0

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pretokens(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and ids of each of the tokenizer's own pre-tokens."""
        spans = [b - a for _, (a, b) in self.usual.pre_tokenize_str(text)]
        words = self.tokenizer.encode(text, add_special_tokens=False).word_ids
        return spans, np.bincount(np.array(words, np.int64), minlength=len(spans)).tolist()

    def prefix(self, text: str, length: int) -> tuple[bool, int, int]:
        """Whether a pre-token begins at ``length``, the ids before it, and all ids."""
        starts = {a for _, (a, _) in self.usual.pre_tokenize_str(text)}
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return length in starts or length == len(text), sum(a < length for a, _ in found.offsets), len(found.ids)

    def _unsafe(self, dictionary: pa.Array, pieces: list[str]) -> np.ndarray:
        data, bounds = flat(dictionary)
        lead = np.append(data, 0)[np.minimum(bounds[:-1], len(data))]
        lead[bounds[:-1] == bounds[1:]] = 0
        out = np.ones(len(pieces), bool)
        out[((lead > 0x20) & (lead < 0x7F)) | ((lead >= 0xC3) & (lead <= 0xCC))] = False
        for i in np.flatnonzero(out):
            out[i] = _UNSAFE.match(pieces[i]) is not None
        return out

    def _add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append(ids)
        self.ends.append(self.total + np.cumsum(counts))
        self.place.update(zip(names, range(self.known, self.known + len(names))))
        self.total += len(ids)
        self.known += len(names)

    def _join(self) -> tuple[np.ndarray, np.ndarray]:
        pool = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        ends = np.concatenate(self.ends)
        self.parts, self.ends = [pool], [ends]
        return pool, ends

    def _copy(self, at: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces, one after the other with room for ``more`` behind each, and their counts."""
        pool, ends = self._join()
        n = ends[at + 1] - ends[at] + more
        take = np.arange(n.sum()) + np.repeat(ends[at] - (np.cumsum(n) - n), n)
        return pool[np.minimum(take, len(pool) - 1)], n

    def _forget(self, pieces: list[str], at: np.ndarray) -> None:
        """Only pieces that the batch at hand uses again are remembered; their new entries replace those in ``at``."""
        kept = np.flatnonzero(at >= 0)
        ids, n = self._copy(at[kept])
        self._reset()
        self._add([pieces[i] for i in kept], ids, n)
        at[kept] = np.arange(len(kept))

    def _encode_pieces(self, cutter, names: list[str]) -> None:
        """Pieces behind a space each, joined into long strings; the bytes behind the ids part them again."""
        if not names:
            return
        joined = [" " + " ".join(names[i:i + 1000]) for i in range(0, len(names), 1000)]
        self.tokenizer.pre_tokenizer = cutter
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        self.tokenizer.pre_tokenizer = self.usual
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.cumsum(pc.binary_length(pa.array(names, pa.string())).to_numpy().astype(np.int64) + 1)
        self._add(names, ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1, prepend=0))

    def _learn(self, pieces: list[str]) -> None:
        """Letters are one pre-token with the space before them; a stop or comma behind them is one of its own."""
        words = pc.match_substring_regex(pa.array(pieces, pa.string()), _LETTERS).to_numpy(zero_copy_only=False).tolist()
        marked = [p for p, w in zip(pieces, words) if w and p[-1] in ".,"]
        plain = dict.fromkeys(p for p, w in zip(pieces, words) if w and p[-1] not in ".,")
        plain |= dict.fromkeys(p[:-1] for p in marked if p[:-1] not in self.place)
        self._encode_pieces(self.lettered, list(plain))
        self._encode_pieces(self.usual, [p for p, w in zip(pieces, words) if not w])
        if marked:
            ids, n = self._copy(np.fromiter((self.place[p[:-1]] for p in marked), np.int64, len(marked)), 1)
            ids[np.cumsum(n) - 1] = [self.marks[p[-1]] for p in marked]
            self._add(marked, ids, n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after the other, and the number of ids of each."""
        parts = list(self._parts(texts))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces per text, then code points and ids of every piece; a text that is not cut is one piece."""
        parts = list(self._parts(texts, True))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))

    def _parts(self, texts: pa.Array, spans: bool = False):
        low = 0
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        while low < len(texts):
            base = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, base + self.part_bytes, "right")))
            yield self._encode(texts.slice(low, high - low), spans)
            low = high

    def _encode(self, texts: pa.Array, spans: bool) -> tuple[np.ndarray, ...]:
        cut = pc.split_pattern(texts, " ")
        bounds = np.asarray(cut.offsets, np.int64)
        bounds = bounds - bounds[0]
        coded = cut.flatten().dictionary_encode()
        code, pieces = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        unsafe = self._unsafe(coded.dictionary, pieces)
        # A text's first piece has no space in front and is encoded by itself, as are unsafe texts.
        heads = bounds[:-1]
        odd = unsafe[code]
        odd[heads] = False
        whole = np.add.reduceat(odd, heads) > 0 if len(heads) else np.zeros(0, bool)
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        if self.known > self.remember:
            self._forget(pieces, at)
        new = np.flatnonzero((at < 0) & ~unsafe)
        if len(new):
            unknown = [pieces[i] for i in new]
            self._learn(unknown)
            at[new] = np.fromiter(map(self.place.__getitem__, unknown), np.int64, len(new))
        pool, ends = self._join()
        alone = [t if w else h for t, w, h in zip(
            texts.to_pylist() if whole.any() else [""] * len(heads), whole, [pieces[c] for c in code[heads]])]
        single = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        own = np.concatenate(single) if single else np.zeros(0, np.uint32)
        own_n = np.fromiter(map(len, single), np.int64, len(single))
        source = np.concatenate([pool, own])
        # Unknown pieces, at -1, stand at heads or in unsafe texts only: both are set below.
        begin, length = ends[at].astype(np.int32)[code], (ends[at + 1] - ends[at]).astype(np.int32)[code]
        if whole.any():
            length[np.repeat(whole, np.diff(bounds))] = 0
        begin[heads], length[heads] = len(pool) + np.cumsum(own_n) - own_n, own_n
        total = np.add.reduceat(length, heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)
        take = np.repeat(begin - (np.cumsum(length, dtype=np.int32) - length), length)
        take += np.arange(len(take), dtype=np.int32)
        ids = source[take]
        if not spans:
            return ids, total
        wide = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)[code].astype(np.int64) + 1
        wide[heads] -= 1
        n = np.diff(bounds)
        if whole.any():
            inside = np.repeat(whole, n)
            wide = np.where(inside, 0, wide)
            wide[heads[whole]] = pc.utf8_length(texts).to_numpy(zero_copy_only=False)[whole]
        return ids, total, n, wide, length.astype(np.int64)
