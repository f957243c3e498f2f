"""Toxicity: a learned lexicon as a trie, Levenshtein automata for misspellings, context windows.

The lexicon holds words that occur in labelled toxic texts far more than chance allows. The union
of the Levenshtein automata of its terms is intersected with the trie by following sets of
(trie node, edits) pairs; the sets are made once and remembered, so a word costs one dictionary
step per letter and most words die after a few. Hits are read in their context: windows of words
around a hit say how dense abuse is, and whether the hit stands in quotation marks or next to a
word of reporting. A logistic model weighs exact, misspelled and quoted hits.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import crc_bucket, map_texts, text_slices
from tablewise.session import materialize

#: The classifier is fitted on at most so many labelled rows, the lowest by a hash of the id.
SAMPLE_ROWS = 20_000
#: Terms of the lexicon at most, the strongest first; its size bounds what is broadcast.
LEXICON_TERMS = 3_000
#: Least log-likelihood ratio of a term (toxic against other texts).
EVIDENCE = 24.0
WINDOW = 6
STATES = 50_000
_SLICE_BYTES = 1 << 22
#: A run without blanks from its first letter or digit to its last one.
_TOKEN = re.compile(r"[^\W_](?:\S*[^\W_])?")
#: Scripts written without blanks (kana, Han, Thai, Lao, Burmese, Khmer): their words are pieces of 2 to 4 signs.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
PIECES = (4, 3, 2)
_WORD = re.compile(rf"[^\W\d_{UNSPACED}]+")
_UNSPACED = re.compile(f"[{UNSPACED}]+")
_RUN = re.compile(rf"[{UNSPACED}]+|{_WORD.pattern}")
_CHUNK = re.compile(r"\S+")
#: Chunks between blanks whose words are remembered, and the longest of them.
KNOWN_CHUNKS, KNOWN_LENGTH = 50_000, 40
#: Words next to a hit that mark it as reported speech. Fixed values.
REPORTING = frozenset((
    "said says quoted quote called wrote word term insult slur means sagte nannte wort zitat "
    "dit mot cita dijo palabra"
).split())


def _pairs(state: bytes) -> list[tuple[int, int]]:
    return [(x >> 2, x & 3) for x in array("I", state)]  # two edits at most


class LexiconAutomaton:
    """Trie of terms walked by all their Levenshtein automata at once; transitions are remembered."""

    def __init__(self, terms: dict[str, float], near: bool = True):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = t
        self.weight, self.near = terms, near
        self._mark(terms)
        self._reset()

    @staticmethod
    def edits(length: int) -> int:
        """Edits allowed to a term: none below 4 letters, one below 10, else two."""
        return 0 if length < 4 else 1 if length < 10 else 2

    def _mark(self, terms) -> None:
        """Most edits that any term below a node allows."""
        self.allowed = [0] * len(self.children)
        for t in terms:
            k, node = self.edits(len(t)) if self.near else 0, 0
            self.allowed[0] = max(self.allowed[0], k)
            for c in t:
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], k)

    def _reset(self) -> None:
        first = self._close({0: 0})
        self.ids = {first: 0}
        self.states = [first]
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list = [self._accept(first)]

    def _close(self, pairs: dict[int, int]) -> bytes:
        """Add letters of the trie that the word leaves out; a state is four bytes a pair, in order."""
        todo = list(pairs)
        while todo:
            node = todo.pop()
            e = pairs[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < pairs.get(child, 9):
                    pairs[child] = e
                    todo.append(child)
        return array("I", sorted(node << 2 | e for node, e in pairs.items())).tobytes()

    def _accept(self, state: bytes):
        found = [(e, -self.weight[self.term[n]], self.term[n]) for n, e in _pairs(state)
                 if self.term[n] is not None and (e == 0 or self.near and e <= self.edits(len(self.term[n])))]
        return min(found, default=None)

    def _step(self, state: int, letter: str) -> int:
        pairs: dict[int, int] = {}

        def put(node, e):
            if e <= self.allowed[node] and e < pairs.get(node, 9):
                pairs[node] = e

        for node, e in _pairs(self.states[state]):
            for c, child in self.children[node].items():
                put(child, e + (c != letter))  # the letter, or another one in its place
            put(node, e + 1)  # a letter too many
        closed = self._close(pairs)
        if not closed:
            return -1
        if closed not in self.ids:
            self.ids[closed] = len(self.states)
            self.states.append(closed)
            self.steps.append({})
            self.ends.append(self._accept(closed))
        return self.ids[closed]

    def match(self, word: str):
        """``(edits, term)`` of the nearest term, the stronger one of equals; None if there is none."""
        if len(self.states) > STATES:  # memory is bounded, results do not change
            self._reset()
        state = 0
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self._step(state, c)
            if to < 0:
                return None
            state = to
        end = self.ends[state]
        return end and (end[0], end[2])


#: Opening marks by the mark that closes them; marks used the other way round (»so«, ”so”) stand for themselves.
_OPENERS = {"”": "“„”", "“": "„", "»": "«", "«": "»", "’": "‘", "」": "「", "』": "『", '"': '"'}
_MARKS = re.compile("[\"“”„«»‘’「」『』]")


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches between an opening and its closing quotation mark of the same kind, of any length, merged.

    An apostrophe between letters is none. A mark that opens at the start of a line goes on with a
    quotation that is still open, as in quotations of several paragraphs. A mark without its partner
    quotes nothing.
    """
    held: dict[str, list[int]] = {}
    spans = []
    for m in _MARKS.finditer(text):
        mark, i = m.group(), m.start()
        before, after = text[i - 1:i], text[i + 1:i + 2]
        leaves, enters = bool(before.strip()), bool(after.strip())
        inner = before.isalpha() and after.isalpha()
        if mark == "’" and inner:
            continue
        opener = next((o for o in _OPENERS.get(mark, "") if held.get(o)), None)
        # A straight or reversed mark before a word does not close what is open.
        if opener and (leaves or not enters):
            spans.append((held[opener].pop(), i + 1))
            continue
        if mark == "’" or mark in "」』" or mark in '"”»' and (before.isalnum() and not inner or not enters and leaves):
            continue
        if held.get(mark):
            j = i
            while j and text[j - 1] in " \t":
                j -= 1
            if j and text[j - 1] == "\n":
                continue
        if mark == '"':
            held[mark] = []  # the older one has no partner
        held.setdefault(mark, []).append(i)
    merged: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if merged and low < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


FEATURES = ("exact", "near", "quoted", "dense", "share", "strong")


def _pieces(run: str, at: int, lookup):
    """Words of a run of an unspaced script: at each sign the longest piece that is a term, else the sign alone."""
    k = 0
    while k < len(run):
        for size in PIECES:
            found = lookup(run[k:k + size]) if k + size <= len(run) else None
            if found and found[0] == 0:
                yield run[k:k + size], at + k, found
                k += size
                break
        else:
            yield run[k], at + k, None
            k += 1


def _plain(chunk: str) -> str | None:
    """The word of a chunk that is one run of letters between punctuation, else None."""
    bare = chunk.strip(string.punctuation)
    return bare.lower() if bare.isalpha() and (bare.isascii() or not _UNSPACED.search(bare)) else None


def _chunk_words(chunk: str, lookup) -> list[tuple]:
    if (word := _plain(chunk)) is not None:
        return [(word, len(chunk) - len(chunk.lstrip(string.punctuation)), lookup(word))]
    token = _TOKEN.search(chunk)
    if not token:
        return []
    whole, at = token.group(), token.start()
    words = []
    for m in _RUN.finditer(whole):
        if _WORD.match(m.group()):
            words.append((m.group().lower(), at + m.start(), lookup(m.group().lower())))
        else:
            words.extend(_pieces(m.group(), at + m.start(), lookup))
    if words and not any(found for _, _, found in words):
        words[0] = (*words[0][:2], lookup(whole.lower()))
    return words


def found_words(text: str, lookup, known: dict | None = None):
    """``(word, place, match)`` of every run of letters.

    A token that has other signs inside (m0ron, st*pid) and no run that matches is looked up as a whole;
    its match stands at its first run. ``known`` remembers the words of chunks.
    """
    known = {} if known is None else known
    for m in _CHUNK.finditer(text):
        chunk = m.group()
        words = known.get(chunk)
        if words is None:
            words = _chunk_words(chunk, lookup)
            if len(chunk) <= KNOWN_LENGTH:
                if len(known) >= KNOWN_CHUNKS:
                    known.clear()
                known[chunk] = words
        at = m.start()
        for word, place, found in words:
            yield word, at + place, found


def context_features(text: str, lookup, known: dict | None = None) -> list[float]:
    """Features of a text that has a hit."""
    words = list(found_words(text, lookup, known))
    spans = quoted_spans(text)
    opened = [low for low, _ in spans]
    hits = []
    for i, (_, at, found) in enumerate(words):
        if found:
            around = [x for x, _, _ in words[max(0, i - 3):i + 4]]
            k = bisect_right(opened, at) - 1
            held = k >= 0 and at < spans[k][1] or any(x in REPORTING for x in around)
            hits.append((i, found[0], found[2], held))
    own = [h for h in hits if not h[3]]
    places = [h[0] for h in own]
    dense = 0
    low = 0
    for k, p in enumerate(places):
        while p - places[low] > 2 * WINDOW:
            low += 1
        dense = max(dense, k - low + 1)
    exact, near = sum(h[1] == 0 for h in own), sum(h[1] > 0 for h in own)
    return [math.log1p(exact), math.log1p(near), math.log1p(len(hits) - len(own)), math.log1p(dense),
            math.log1p(100 * len(own) / max(1, len(words))), max((h[2] for h in own if h[1] == 0), default=0.0) / 10]


@dataclass
class Model:
    """Lexicon with weights, and the logistic weights of ``FEATURES`` with the constant last."""

    terms: dict[str, float]
    weights: list[float]
    _automaton: LexiconAutomaton | None = field(default=None, repr=False, compare=False)
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "_automaton": None, "_known": {}}

    def lookup(self, word: str):
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.terms)
        found = self._automaton.match(word)
        return found and (found[0], found[1], self.terms[found[1]])

    def score(self, text: str) -> float:
        z = self.weights[-1] + sum(w * x for w, x in zip(self.weights, context_features(text, self.lookup, self._known)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _suspects(texts: pa.Array, hit) -> np.ndarray:
    """Texts with a hit; each distinct chunk between spaces is looked at once per slice of a batch."""
    found = [np.zeros(0, bool)]
    for low, high, _, _ in text_slices(texts, _SLICE_BYTES):
        cut = pc.split_pattern(pc.fill_null(texts.slice(low, high - low), ""), " ")
        bounds = np.asarray(cut.offsets, np.int64)
        coded = cut.flatten().dictionary_encode()
        marks = np.fromiter(map(hit, coded.dictionary.to_pylist()), bool, len(coded.dictionary))
        total = np.concatenate([[0], np.cumsum(marks[np.asarray(coded.indices)], dtype=np.int32)])
        bounds = bounds - bounds[0]
        found.append(total[bounds[1:]] > total[bounds[:-1]])
    return np.concatenate(found)


def _chunk_test(model: Model):
    def hit(chunk: str) -> bool:
        word = _plain(chunk)
        if word is not None:
            return model.lookup(word) is not None
        return any(found for _, _, found in found_words(chunk, model.lookup, model._known))
    return hit


def _featured(docs: DataFrame, model: Model) -> DataFrame:
    def work():
        hit = _chunk_test(model)

        def run(texts):
            found, rows = _suspects(texts, hit), []
            for i, some in enumerate(found):
                rows.append(context_features(texts[i].as_py(), model.lookup, model._known) if some else [0.0] * len(FEATURES))
            return [pa.array(rows, pa.list_(pa.float64()))]
        return run
    return map_texts(docs, "features array<double>", work)


def lexicon(sample: DataFrame, evidence: float = EVIDENCE, limit: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms with their log-odds, from documents' distinct words counted by label."""
    taken = [r"(\p{L}+)", *[f"(?=([{UNSPACED}]{{{size}}}))" for size in PIECES]]
    words = F.array_distinct(F.concat(*[F.regexp_extract_all(F.lower("text"), F.lit(t), 1) for t in taken]))
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, fine = totals.get(1, 0), totals.get(0, 0)
    if not bad or not fine:
        return {}
    counts = sample.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(
        F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (fine + 1))
    n = F.col("t") + F.col("c")
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0)
    ratio = 2 * (part(F.col("t"), bad / (bad + fine)) + part(F.col("c"), fine / (bad + fine)))
    best = counts.withColumns({"odds": odds, "ratio": ratio}).filter(
        (F.col("ratio") >= evidence) & (F.col("odds") > 2)).orderBy(F.desc("ratio"), "word").limit(limit)
    return {r["word"]: round(r["odds"], 6) for r in best.collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> list[float]:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = np.append(np.full(x.shape[1] - 1, ridge * len(x) / 100), 1e-6)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(h, x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, held_out: int = 5) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod ``held_out`` is not 0.

    Rows labelled twice count as toxic if one label says so. The lexicon is learned from all of the
    sample; the weights from terms learned on one half and texts of the other, so that words seen
    in training do not look better than they are. Without labels of both kinds every score is low.
    """
    ids = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        (crc_bucket(F.col("_id"), held_out) != 0) & F.col("toxic").isin(0, 1)).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialize(own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"), "labelled")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    terms = lexicon(sample)
    seen, weights = lexicon(sample.filter(half)), None
    if terms and seen:
        rows = _featured(sample.filter(~half), Model(seen, [])).select("features", "toxic", "doc_id").orderBy("doc_id").collect()
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        if 0 < y.sum() < len(y):
            weights = fit_logistic(x, y)
    if weights is None:
        weights = [2.0, 1.0, 0.2, 1.0, 1.0, 1.0, -3.0]
    return Model(terms, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5); older columns of
    these names are replaced.

    Null and empty texts and texts without a hit get the model's constant. Repeated rows score alike.
    """
    none = model.weights[-1]
    quiet = 1 / (1 + math.exp(-max(-30.0, min(30.0, none))))

    def work():
        hit = _chunk_test(model)

        def run(texts):
            found = _suspects(texts, hit)
            out = np.full(len(texts), quiet)
            for i in np.flatnonzero(found):
                out[i] = model.score(texts[int(i)].as_py())
            out = np.round(out, 9)
            return [out, (out >= 0.5).astype(np.int32)]
        return run
    return map_texts(docs, "score double, predicted int", work)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    model = train(docs, labels, sample_rows)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(own, model).select("doc_id", out.alias("held_out"), "score", "predicted")
