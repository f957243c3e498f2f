"""Language-model scores: a gated recurrent network over words with a class-factored softmax.

Words are counted over all documents that are learned from. The most frequent ones are the head:
symbols of the network, dealt in order of frequency into classes of equal size. Every other word,
known or not, belongs to a tail class, which its length and its last two bytes name, so no table
is needed to find it. The probability of a word is

    P(class | state) * P(word | class, state)            for a word of the head
    P(class | state) * (c + 0.5) / (N + 0.5 * (V + 1))   for the tail; N, V over the words of its class

where the last slot of a class stands for its unknown words. So all words and one unknown word a
class share exactly 1.

Training is truncated backpropagation in numpy: windows of ``STEPS`` tokens, the state carried from
window to window and set back at the start of a document. One trainer warms up on a bounded sample;
then every document that is learned from is seen once, in rounds that grow: each task trains on its
part from the shared weights, and the weights of all tasks are averaged by the tokens they saw. The
driver holds one set of weights, whose size the parameters fix. Whole documents are scored, the
state being carried across windows.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    LOWER, crc_bucket, documents, find_words, inner_index, list_array, new_folder, release, span_hashes, text_slices,
)
from tablewise.session import materialize

FOLDS, HELD_OUT = 5, 1
#: Symbols of the head: classes and words of each. The end of a text is one of them.
CLASSES, CLASS_WORDS = 32, 64
HEAD = CLASSES * CLASS_WORDS
#: Tail classes: bands of length times hashed endings.
BANDS, ENDINGS = 2, 16
TAIL = BANDS * ENDINGS
WIDTH, HIDDEN = 16, 16
#: Lanes of documents that run side by side and tokens of a window, in training and for scores.
LANES, STEPS, SCORE_LANES, SCORE_STEPS = 256, 32, 256, 32
#: Tokens of the warm-up sample, about, and how often a smaller corpus is gone through.
WARM_TOKENS, WARM_PASSES = 600_000, 4
#: Parts of the corpus in 64ths, one round of averaging after each.
ROUNDS = (2, 2, 4, 8, 16, 32)
RATE = 0.1
#: At most so many of the most frequent words are looked up in every task; the others are joined.
KNOWN_WORDS = 1 << 18
#: Tokens that are laid out in lanes at once.
SLICE_TOKENS = 1 << 21
_BLOCKS = 16
_CACHED = 1024
END_HASH = 0  # no word has it: see word_rows
_LOG10 = np.log(10.0)


def word_rows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class of every word, and the words of each row; the ASCII letters are lower-cased."""
    lower = LOWER[data]
    start, end, first = find_words(lower, bounds)
    keys = span_hashes(lower, start, end).view(np.int64)
    keys[keys == END_HASH] = 1
    last = lower[end - 1].astype(np.int64)
    before = np.where(end - start > 1, lower[np.maximum(end - 2, 0)], 0)
    band = np.minimum((end - start - 1) // 8, BANDS - 1)
    return keys, band * ENDINGS + (last * 31 + before * 17) % 127 % ENDINGS, first


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, class, c)`` over all texts, ends of texts included, summed per task before the shuffle."""
    def run(batches):
        held = []

        def summed():
            keys, kinds, n = (np.concatenate(x) for x in zip(*held))
            keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
            return keys, kinds[at], np.bincount(back, n, len(keys)).astype(np.int64)

        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                keys, kinds, first = word_rows(data, bounds)
                found, at, n = np.unique(keys, return_index=True, return_counts=True)
                held.append((found, kinds[at], n))
                held.append((np.array([END_HASH]), np.array([-1]), np.array([len(first) - 1])))
                if len(held) >= 64:
                    held[:] = [summed()]
                    if len(held[0][0]) > 1 << 20:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], ["word", "class", "c"])
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed())], ["word", "class", "c"])
        release()

    return docs.select("text").mapInArrow(run, "word bigint, class bigint, c bigint").groupBy("word").agg(
        F.max("class").alias("class"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Words looked up in tasks, in order of their hashes, and sums of all others."""

    words: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray  # of the head, or -1
    head_counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    distinct: int
    threshold: int  # words counted less often than this are joined

    @property
    def base(self) -> float:
        return np.log10(self.tokens + 0.5 * (self.distinct + 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of a word in the table, or -1."""
        if not len(self.words):
            return np.full(len(keys), -1)
        keys, back = np.unique(keys, return_inverse=True)  # in order, the search stays in the cache
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, at, -1)[back]


def vocabulary(counted: DataFrame, known: int = KNOWN_WORDS) -> Vocabulary:
    """From the stored counts; at most ``known`` rows reach the driver."""
    # Exact up to 4,096, then in steps of 1/64: few rows, and a threshold that is one of the counts' bounds.
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("c")) - 6, F.lit(0)))
    step = F.when(F.col("c") < 4096, F.col("c")).otherwise((F.floor(F.col("c") / unit) * unit).cast("bigint"))
    threshold, held = 1 << 62, 0
    for low, n in counted.groupBy(step.alias("s")).agg(F.count(F.lit(1))).orderBy(F.desc("s")).collect():
        if held + n > known:
            break
        threshold, held = low, held + n
    top = counted.filter((F.col("c") >= threshold) | (F.col("word") == END_HASH)).toPandas()
    top = top.sort_values(["c", "word"], ascending=[False, True])
    words, counts, kinds = (top[c].to_numpy(np.int64) for c in ("word", "c", "class"))
    symbol = np.full(len(words), -1)
    end = np.flatnonzero(words == END_HASH)
    chosen = np.union1d(np.arange(min(len(words), HEAD)), end)
    if len(chosen) > HEAD:  # the end is none of the most frequent words
        chosen = np.concatenate([np.arange(HEAD - 1), end])
    symbol[chosen] = np.arange(len(chosen))
    head_counts = np.zeros(HEAD, np.int64)
    head_counts[symbol[chosen]] = counts[chosen]
    if not len(words):
        head_counts[0] = 1  # without a text to learn from only the end is expected
    sums = counted.groupBy("class").agg(F.sum("c"), F.count(F.lit(1))).collect()
    tokens, distinct = sum(r[1] for r in sums), sum(r[2] for r in sums)
    tail_tokens, tail_words = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for kind, c, n in sums:
        if kind >= 0:
            tail_tokens[kind], tail_words[kind] = c, n
    inside = chosen[kinds[chosen] >= 0]
    np.subtract.at(tail_tokens, kinds[inside], counts[inside])
    np.subtract.at(tail_words, kinds[inside], 1)
    order = np.argsort(words)
    return Vocabulary(words[order], counts[order], symbol[order], head_counts, tail_tokens, tail_words, tokens, distinct, int(threshold))


def code(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Symbols of every text with sums over the words looked up; words that are not in the table stay as hashes.

    The sums are of log10(c + 0.5): ``base`` over all these words, ``tail`` over those outside the head.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocab))  # plain values: workers read them before this package
    schema = ("doc_id bigint, held_out boolean, round int, ids array<smallint>, n_tokens bigint, n_known bigint, base double, "
              "tail double, rare array<bigint>, times array<bigint>")

    def run(batches):
        v = Vocabulary(**shared.value)
        lone = np.log10(v.counts + 0.5)
        share = np.log10(v.tail_tokens + 0.5 * (v.tail_words + 1))
        end = int(v.symbol[v.find(np.array([END_HASH]))[0]]) if len(v.words) else 0
        end_log = float(lone[v.find(np.array([END_HASH]))[0]]) if len(v.words) else np.log10(0.5)
        for batch in batches:
            for low, high, data, bounds in text_slices(batch.column(3)):
                keys, kinds, first = word_rows(data, bounds)
                rows, n = high - low, np.diff(first)
                row = np.repeat(np.arange(rows), n)
                at = v.find(keys)
                known = at >= 0
                symbol = np.where(known, v.symbol[at], -1) if len(v.words) else np.full(len(keys), -1)
                outer = symbol < 0
                each = np.where(known, lone[at], 0.0) if len(v.words) else np.zeros(len(keys))
                base = np.bincount(row, each, rows) + end_log
                tail = np.bincount(row, np.where(outer, each - share[kinds], 0.0), rows)
                ids = np.full(len(keys) + rows, end, np.int16)
                ids[np.arange(len(keys)) + row] = np.where(outer, HEAD + kinds, symbol)
                # Rare words once a text, with how often they come.
                r, k = row[~known], keys[~known]
                order = np.lexsort((k, r))
                r, k = r[order], k[order]
                lead = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])) if len(r) else np.zeros(0, np.int64)
                times = np.diff(np.append(lead, len(r)))
                per = np.bincount(r[lead], minlength=rows)
                cut = [batch.column(i).slice(low, rows) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*cut, list_array(ids, n + 1, pa.int16()), pa.array(n + 1), pa.array(np.bincount(row, known, rows).astype(np.int64) + (v.tokens > 0)),
                     pa.array(base), pa.array(tail), list_array(k[lead], per, pa.int64()), list_array(times, per, pa.int64())],
                    ["doc_id", "held_out", "round", "ids", "n_tokens", "n_known", "base", "tail", "rare", "times"])
        release()

    return docs.select("doc_id", "held_out", "round", "text").mapInArrow(run, schema)


class Network:
    """Weights by name, all float32; the input symbol of a text's first token is its end symbol."""

    SHAPES = {
        "embed": (HEAD + TAIL, WIDTH), "input": (WIDTH, 3 * HIDDEN), "state": (HIDDEN, 3 * HIDDEN), "gate": (3 * HIDDEN,), "inner": (HIDDEN,),
        "kind": (HIDDEN, CLASSES + TAIL), "kind0": (CLASSES + TAIL,), "word": (HEAD, HIDDEN), "word0": (HEAD,),
    }

    def __init__(self, weights: dict[str, np.ndarray], squares: dict[str, np.ndarray]):
        self.w, self.g2 = weights, squares

    @classmethod
    def fresh(cls, vocab: Vocabulary, seed: int = 5) -> "Network":
        """Small random weights; the biases give each class and word its share of the corpus."""
        draw = np.random.default_rng(seed)
        w = {k: draw.normal(0, 0.5 / np.sqrt(s[0] if k in ("input", "state") else WIDTH), s).astype(np.float32) for k, s in cls.SHAPES.items()}
        for k in ("gate", "inner"):
            w[k][:] = 0
        w["gate"][:HIDDEN] = 1  # a state is kept at first
        w["kind"] *= 0.1
        w["word"] *= 0.1
        classes = np.concatenate([vocab.head_counts.reshape(CLASSES, -1).sum(axis=1), vocab.tail_tokens])
        w["kind0"] = np.log(classes + 0.5).astype(np.float32)
        held = vocab.head_counts > 0
        w["word0"] = np.where(held, np.log(np.maximum(vocab.head_counts, 1)), -60.0).astype(np.float32)
        w["kind0"][:CLASSES][~held.reshape(CLASSES, -1).any(axis=1)] = -60.0  # classes and places without a word
        return cls(w, {k: np.full(s, 1e-4, np.float32) for k, s in cls.SHAPES.items()})

    def pack(self) -> np.ndarray:
        return np.concatenate([x[k].ravel() for x in (self.w, self.g2) for k in self.SHAPES])

    @classmethod
    def unpack(cls, flat: np.ndarray) -> "Network":
        sets, at = [{}, {}], 0
        for x in sets:
            for k, shape in cls.SHAPES.items():
                n = int(np.prod(shape))
                x[k] = flat[at:at + n].astype(np.float32).reshape(shape)
                at += n
        return cls(*sets)

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States (steps by units by lanes) around a window ``x`` (steps by lanes), and what the way back needs.

        Units come before lanes, so that every gate is one contiguous block.
        """
        w = self.w
        steps, lanes = x.shape
        seen = w["embed"][x]
        out = np.empty((steps + 1, HIDDEN, lanes), np.float32)
        gates = np.empty((steps, 3 * HIDDEN, lanes), np.float32) if keep else None
        inner = np.empty((steps, HIDDEN, lanes), np.float32) if keep else None
        starts = np.empty((steps, HIDDEN, lanes), np.float32) if keep else None
        into, state, gate, more = np.ascontiguousarray(w["input"].T), np.ascontiguousarray(w["state"].T), w["gate"][:, None], w["inner"][:, None]
        some = fresh.any(axis=1)
        out[0] = h
        for t in range(steps):
            h = out[t]
            if some[t]:
                h = np.where(fresh[t], np.float32(0), h)
            d = into @ seen[t].T
            d += gate
            r = state @ h
            zr = d[:2 * HIDDEN]
            zr += r[:2 * HIDDEN]
            np.negative(zr, out=zr)
            np.minimum(zr, 60, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            a = r[2 * HIDDEN:]
            a += more
            n = d[2 * HIDDEN:]
            n += zr[HIDDEN:] * a
            np.clip(n, -20, 20, out=n)  # tanh, from the cheaper exponential
            n *= -2
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            now = out[t + 1]
            np.subtract(h, n, out=now)
            now *= zr[:HIDDEN]
            now += n
            if keep:
                gates[t], inner[t], starts[t] = d, a, h
        return out, (seen, gates, inner, starts)

    def choices(self, h: np.ndarray, y: np.ndarray, back: bool = False):
        """Natural log probability of each symbol ``y`` after state ``h``; with ``back`` gradients too."""
        w = self.w
        small, small_word = _small(w["kind"].T, w["kind0"], 1)[0], _small(w["word"], w["word0"], CLASSES)
        kind = np.where(y < HEAD, y // CLASS_WORDS, y - HEAD + CLASSES)
        score, grads, dh = np.empty(len(y)), {}, None
        if back:
            grads = {k: np.zeros_like(w[k]) for k in ("kind", "kind0", "word", "word0")}
            dh = np.empty_like(h)
        for low in range(0, len(y), _CACHED):  # so many rows at once stay in the cache
            hc, place = h[low:low + _CACHED], kind[low:low + _CACHED]
            p = hc @ w["kind"]
            p += w["kind0"]
            score[low:low + _CACHED] = _softmax(p, place) if back else _log_share(p, place, small)
            if back:
                p[np.arange(len(place)), place] -= 1
                grads["kind"] += hc.T @ p
                grads["kind0"] += p.sum(axis=0)
                np.matmul(p, w["kind"].T, out=dh[low:low + _CACHED])
        inside = np.flatnonzero(y < HEAD)
        order = inside[np.argsort(kind[inside], kind="stable")]
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = order[edges[c]:edges[c + 1]]
            if not len(at):
                continue
            span = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
            hc, place = h[at], y[at] - c * CLASS_WORDS
            q = hc @ w["word"][span].T
            q += w["word0"][span]
            score[at] += _softmax(q, place) if back else _log_share(q, place, small_word[c])
            if back:
                q[np.arange(len(at)), place] -= 1
                grads["word"][span], grads["word0"][span] = q.T @ hc, q.sum(axis=0)
                dh[at] += q @ w["word"][span]
        return score, grads, dh

    def learn(self, x, y, fresh, h) -> tuple[np.ndarray, float]:
        """One step of training on a window; places with ``y`` < 0 are empty."""
        w = self.w
        out, (seen, gates, inner, starts) = self.forward(x, fresh, h, True)
        steps, lanes = x.shape
        used = np.flatnonzero(y.ravel() >= 0)
        score, grads, dh = self.choices(rows_of(out[1:])[used], y.ravel()[used], True)
        top = np.zeros((steps * lanes, HIDDEN), np.float32)
        top[used] = dh
        top = top.reshape(steps, lanes, HIDDEN)
        dgate = np.empty_like(gates)
        dinner = np.empty_like(inner)
        carry = np.zeros((HIDDEN, lanes), np.float32)
        dstate = np.zeros((3 * HIDDEN, HIDDEN), np.float32)
        dr = np.empty((3 * HIDDEN, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            carry += top[t].T
            z, r, n = gates[t, :HIDDEN], gates[t, HIDDEN:2 * HIDDEN], gates[t, 2 * HIDDEN:]
            keep = carry * z
            dn = carry - keep
            dz = np.subtract(starts[t], n)
            dz *= dn
            dz *= z
            square = n * n
            np.subtract(1, square, out=square)
            dn *= square
            own = dr[HIDDEN:2 * HIDDEN]
            np.subtract(1, r, out=own)
            own *= r
            own *= inner[t]
            own *= dn
            dr[:HIDDEN] = dz
            np.multiply(dn, r, out=dr[2 * HIDDEN:])
            dgate[t, :2 * HIDDEN], dgate[t, 2 * HIDDEN:], dinner[t] = dr[:2 * HIDDEN], dn, dr[2 * HIDDEN:]
            dstate += dr @ starts[t].T
            carry = w["state"] @ dr
            carry += keep
            if fresh[t].any():
                carry[:, fresh[t]] = 0
        flat, seen = rows_of(dgate), seen.reshape(-1, WIDTH)
        grads["input"], grads["gate"] = seen.T @ flat, flat.sum(axis=0)
        grads["state"], grads["inner"] = dstate.T, dinner.sum(axis=(0, 2))
        dseen, ids = (flat @ w["input"].T)[used], x.ravel()[used]
        order = np.argsort(ids, kind="stable")
        lead = np.flatnonzero(np.diff(ids[order], prepend=-1))
        grads["embed"] = np.zeros_like(w["embed"])
        if len(lead):
            grads["embed"][ids[order][lead]] = np.add.reduceat(dseen[order], lead)
        size = np.float32(1 / np.sqrt(max(len(used), 1)))
        for k, g in grads.items():
            g = g * size
            np.clip(g, -5, 5, out=g)
            self.g2[k] += g * g
            g /= np.sqrt(self.g2[k])
            g *= np.float32(RATE)
            w[k] -= g
        return out[-1], float(score.sum())


def _small(weights: np.ndarray, biases: np.ndarray, groups: int) -> np.ndarray:
    """Of each group of choices, whether no state, whose units lie within 1 of 0, can take their exponentials out of range."""
    reach = np.abs(weights).sum(axis=1)
    high, low = (x.reshape(groups, -1).max(axis=1) for x in (biases + reach, biases - reach))
    return (high < 80) & (low > -80)


def _softmax(p: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log probability of a place in each row; the rows become probabilities."""
    p -= p.max(axis=1, keepdims=True)
    own = p[np.arange(len(place)), place].astype(np.float64)
    np.exp(p, out=p)
    total = p.sum(axis=1, keepdims=True)
    p /= total
    return own - np.log(total[:, 0])


def _log_share(p: np.ndarray, place: np.ndarray, small: bool) -> np.ndarray:
    """The same log probability where no gradients follow: values that are ``small`` stay as they are; the rows are used up."""
    if not small:
        p -= p.max(axis=1, keepdims=True)
    own = p[np.arange(len(place)), place].astype(np.float64)
    np.exp(p, out=p)
    return own - np.log(p @ np.ones(p.shape[1], np.float32))


def rows_of(units: np.ndarray) -> np.ndarray:
    """From steps by units by lanes to a row for each step and lane."""
    return np.ascontiguousarray(units.transpose(0, 2, 1)).reshape(-1, units.shape[1])


def lanes_of(ids: np.ndarray, n: np.ndarray, lanes: int):
    """Texts in lanes, longest lanes first: input, target (-1: none), start of a text, and text of each place.

    Texts go, longest first, to the lane that is shortest so far.
    """
    import heapq

    heap = [(0, i) for i in range(min(lanes, len(n)))]
    lane, begin = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for k in np.argsort(-n, kind="stable").tolist():
        at, i = heap[0]
        lane[k], begin[k] = i, at
        heapq.heapreplace(heap, (at + int(n[k]), i))
    length = np.zeros(len(heap), np.int64)
    for at, i in heap:
        length[i] = at
    order = np.argsort(-length, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    length = length[order]
    text = np.repeat(np.arange(len(n)), n)
    inner = inner_index(n)
    y = np.full((length[0], len(order)), -1, np.int16)
    x = np.zeros_like(y)
    fresh = np.zeros(y.shape, bool)
    owner = np.zeros(y.shape, np.int32)
    step, column = begin[text] + inner, place[lane[text]]
    y[step, column] = ids
    x[step, column] = np.where(inner == 0, ids[np.cumsum(n) - 1][text], np.concatenate([[0], ids[:-1]]))
    fresh[step, column] = inner == 0
    owner[step, column] = text
    return x, y, fresh, owner, length


def windows_of(ids: np.ndarray, n: np.ndarray, lanes: int, steps: int):
    """Windows over the lanes that still run."""
    x, y, fresh, owner, length = lanes_of(ids, n, lanes)
    for t in range(0, len(x), steps):
        k = int(np.searchsorted(-length, -t))  # lanes longer than t
        yield x[t:t + steps, :k], y[t:t + steps, :k], fresh[t:t + steps, :k], owner[t:t + steps, :k]


def score_texts(net: Network, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural log probability of each text's symbols; no text is cut, states go from window to window."""
    out = np.zeros(len(n))
    h = np.zeros((HIDDEN, min(SCORE_LANES, len(n))), np.float32)
    for x, y, fresh, owner in windows_of(ids, n, SCORE_LANES, SCORE_STEPS):
        states, _ = net.forward(x, fresh, h[:, :x.shape[1]])
        h = states[-1]
        used = np.flatnonzero(y.ravel() >= 0)
        score, _, _ = net.choices(rows_of(states[1:])[used], y.ravel()[used].astype(np.int64))
        out += np.bincount(owner.ravel()[used], score, len(n))
    return out


def learn_texts(net: Network, ids: np.ndarray, n: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> None:
    h = np.zeros((HIDDEN, min(lanes, len(n))), np.float32)
    for x, y, fresh, _ in windows_of(ids, n, lanes, steps):
        h, _ = net.learn(x, y.astype(np.int64), fresh, h[:, :x.shape[1]])


def _symbols(column) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(lists.offsets, np.int64))


def _gathered(batches, column: str):
    """Batches put together up to a number of tokens."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(batch.schema.names.index(column)).flatten())
        if size >= SLICE_TOKENS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _averaged(parts: DataFrame) -> np.ndarray:
    """Mean of the weights by tokens: blocks of them are summed in two steps, one row a block reaches the driver."""
    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for block, tokens, values in zip(batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3)):
                v = values.values.to_numpy(zero_copy_only=False)
                if block in sums:
                    sums[block][0] += tokens
                    sums[block][1] += v
                else:
                    sums[block] = [tokens, v.copy()]
        for block, (tokens, v) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([0]), pa.array([tokens]), list_array(v, np.array([len(v)]), pa.float64())],
                ["block", "trainer", "tokens", "v"])

    schema = "block bigint, trainer bigint, tokens bigint, v array<double>"
    some = parts.repartition("block", F.col("trainer") % 64).sortWithinPartitions("block", "trainer").mapInArrow(add, schema)
    rows = some.repartition("block").sortWithinPartitions("block", "trainer", "tokens").mapInArrow(add, schema).collect()
    if not rows:
        return np.zeros(0, np.float32)
    return np.concatenate([np.array(r["v"]) / r["tokens"] for r in sorted(rows)]).astype(np.float32)


def train(coded: DataFrame, vocab: Vocabulary, warm_tokens: int = WARM_TOKENS) -> np.ndarray:
    """Packed weights, after the warm-up and a round over each part of all texts that are learned from."""
    sc = coded.sparkSession.sparkContext
    start = Network.fresh(vocab).pack()
    learned = coded.filter(~F.col("held_out")).select("ids", "round", "n_tokens", "doc_id")
    if not vocab.tokens:
        return start
    # The sample is the share of documents that holds about so many tokens; it is one task's work.
    share = min(1.0, warm_tokens / vocab.tokens)
    passes = max(1, min(WARM_PASSES, warm_tokens // vocab.tokens))
    picked = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))

    def warm(batches):
        net = Network.unpack(start)
        for table in _gathered(batches, "ids"):
            ids, n = _symbols(table["ids"])
            for _ in range(passes):
                learn_texts(net, ids, n, 32, 16)
        out = io.BytesIO()
        np.save(out, net.pack())
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["weights"])

    first = learned.filter(picked if share < 1 else F.lit(True)).select("ids").repartition(1).mapInArrow(warm, "weights binary").collect()
    now = np.load(io.BytesIO(first[0][0])) if first else start
    for number in range(len(ROUNDS)):
        shared = sc.broadcast(now)

        def trained(batches, shared=shared):
            from pyspark import TaskContext

            net, tokens = Network.unpack(shared.value), 0
            for table in _gathered(batches, "ids"):
                ids, n = _symbols(table["ids"])
                learn_texts(net, ids, n)
                tokens += len(ids)
            if tokens:
                trainer = TaskContext.get().partitionId()
                for block, v in enumerate(np.array_split(net.pack(), _BLOCKS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([trainer]), pa.array([tokens]),
                         list_array(v.astype(np.float64) * tokens, np.array([len(v)]), pa.float64())], ["block", "trainer", "tokens", "v"])
            release()

        part = learned.filter(F.col("round") == number).select("ids")
        found = _averaged(part.mapInArrow(trained, "block bigint, trainer bigint, tokens bigint, v array<double>"))
        now = found if len(found) else now
        shared.unpersist()
    return now


def log_likelihood(docs: DataFrame, known: int = KNOWN_WORDS, warm_tokens: int = WARM_TOKENS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Null texts are empty and have one token, the end. Rows without a doc_id are learned from and scored;
    repeated rows count as often as they come and get equal scores. Without a row to learn from all words
    are unknown. Other columns are ignored; an empty table gives no rows.
    """
    held = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    lots = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(sum(ROUNDS))).cast("int")
    bounds, number = np.cumsum(ROUNDS).tolist(), F.lit(0)
    for b in bounds[:-1]:
        number = number + (lots >= b).cast("int")
    rows = documents(docs).select("doc_id", "text", held.alias("held_out"), number.cast("int").alias("round"))
    counted = materialize(count_words(rows.filter(~F.col("held_out"))), "words")
    vocab = vocabulary(counted, known)
    folder = new_folder(docs.sparkSession, "coded")
    made = code(rows, vocab)
    made.write.partitionBy("round").parquet(folder)  # a round of training reads its part alone
    coded = docs.sparkSession.read.schema(made.schema).parquet(folder)
    weights = docs.sparkSession.sparkContext.broadcast(train(coded, vocab, warm_tokens))

    def run(batches):
        net = Network.unpack(weights.value)
        for table in _gathered(batches, "ids"):
            ids, n = _symbols(table["ids"])
            yield from table.drop_columns(["ids"]).append_column("net", pa.array(score_texts(net, ids, n) / _LOG10)).to_batches()
        release()

    light = ["doc_id", "held_out", "n_tokens", "n_known", "base", "tail", "rare", "times"]
    kinds = coded.select(*light).schema
    scored = coded.select("ids", *light).mapInArrow(run, kinds.add("net", "double")).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    # Words that no task looked up: their counts, and the size of their class, come by a join on the word.
    pairs = scored.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select(
        "row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rare = counted.filter((F.col("c") < vocab.threshold) & (F.col("word") != END_HASH)).select("word", "c")
    sums = pairs.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"))
    whole = scored.drop("rare", "times").join(sums, "row", "left").fillna({"more": 0, "logs": 0.0})
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(float(vocab.base))).alias("base_score"),
        (F.col("net") + F.col("tail") + F.col("logs")).alias("score"))
