"""Alignment of two tokenizers over distinct texts.

Texts are shuffled whole, so each distinct text is cut by both tokenizers once, with the number of
its documents. Places where tokens of both end cut a text into groups; every token of the one and
every token of the other in a group are linked. A pair of ids counts the documents that hold it, so
its distinct texts are weighted by their documents. Counts of frequent pairs are looked up in every
task, the others are joined, and the measures of a text are joined back to its documents.

Tokens come as flat arrays of ids with the bytes behind them, so no step walks through tokens one
by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm import bpe
from tablewise.llm.common import documents, flat, inner_index, list_array, release
from tablewise.session import materialize

#: At most so many of the most frequent id pairs are looked up in every task; the others are joined.
KNOWN_PAIRS = 1 << 19
#: Bytes of text that are aligned at once, pairs of one group that are made at once.
SLICE_BYTES, GROUP_PAIRS = 1 << 20, 1 << 20
#: A text with more than this share of all documents, one in so many, is joined apart.
HOT_SHARE = 1000
_STEP = 1 << 32  # a pair of ids is a * _STEP + b
MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Bytes behind the ids of a vocabulary, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.width = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.width) - self.width

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.width[ids]
        return self.data[np.repeat(self.begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def byte_tokens(path: str) -> Tokens:
    """Entries of a byte-level vocabulary: each of its signs stands for one byte."""
    from tokenizers import Tokenizer

    # Printable bytes stand for themselves, the others for the signs from 256 on, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocab = Tokenizer.from_file(path).get_vocab()
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
    return Tokens(pieces)


def piece_tokens(model) -> Tokens:
    """Pieces in UTF-8, the mark of a blank as a space, byte pieces as their byte."""
    def spelled(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Tokens([spelled(i) for i in range(model.get_piece_size())])


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, byte_path: str, model_path: str):
        import sentencepiece

        # Few words are remembered: texts come once.
        self.first = bpe.Encoder(byte_path, 200_000, SLICE_BYTES)
        self.second = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a, self.b = byte_tokens(byte_path), piece_tokens(self.second)
        self.special = any(not p for p in self.a.width)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both for these texts, and how many each has; both are empty where their bytes are not the text's."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        ids_a, n_a = self.first.encode(spaced)
        cut = self.second.encode(texts.to_pylist(), num_threads=1)
        n_b = np.fromiter(map(len, cut), np.int64, len(cut))
        ids_b = np.fromiter((i for x in cut for i in x), np.int64, int(n_b.sum()))
        data, bounds = flat(spaced)
        same = (self._same(self.a, ids_a, n_a, data, bounds) & self._same(self.b, ids_b, n_b, data, bounds)
                & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if not same.all():
            ids_a, ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
            n_a, n_b = n_a * same, n_b * same
        return ids_a.astype(np.int64), n_a, ids_b, n_b

    @staticmethod
    def _same(tokens: Tokens, ids: np.ndarray, n: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Texts whose tokens' bytes, joined, are their own."""
        size = np.diff(bounds)
        width = tokens.width[ids]
        ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(np.concatenate([[0], n]))]
        out = np.diff(ends) == size
        joined = tokens.bytes_of(ids)
        if out.all():
            odd = np.flatnonzero(joined != data)
            out[np.searchsorted(bounds, odd, "right") - 1] = False
        else:
            for i in np.flatnonzero(out):
                out[i] = np.array_equal(joined[ends[i]:ends[i + 1]], data[bounds[i]:bounds[i + 1]])
        return out


def groups_of(width_a: np.ndarray, width_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token: tokens up to a byte where tokens of both end. The ends of texts are such places."""
    end_a, end_b = np.cumsum(width_a), np.cumsum(width_b)
    seen = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
    seen[end_a] = True
    shared = np.unique(end_b[seen[end_b]])
    return np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)


def spell(ids_a, group_a, ids_b, group_b, groups: int, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all groups as bytes, and the end of each group; the last one of a text has no ``;``."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + (before_a + n_a)[group_b]
    ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    ends = np.cumsum(n_a + n_b) - 1
    mark[ends - n_b] = ord("|")
    mark[ends] = ord(";")
    last = np.append(text_of[1:] != text_of[:-1], True) if groups else np.zeros(0, bool)
    digits = np.ones(len(ids), np.int64)
    for k in (10, 100, 1000, 10_000, 100_000, 1_000_000):
        digits += ids >= k
    size = digits + 1
    size[ends[last]] -= 1
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    begin = stop - size
    marked = np.ones(len(ids), bool)
    marked[ends[last]] = False
    out[(begin + digits)[marked]] = mark[marked]
    left = ids.copy()
    for k in range(int(digits.max()) if len(ids) else 0):
        at = np.flatnonzero(digits > k)
        out[(begin + digits - 1 - k)[at]] = 48 + left[at] % 10
        left //= 10
    return out, stop[ends] if groups else np.zeros(0, np.int64)


def linked_pairs(ids_a, group_a, ids_b, group_b, groups: int, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct id pairs of every text with the number of their links: text, pair, times, in that order.

    Groups are expanded in slices of bounded size; a large one is first reduced to distinct ids.
    """
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    found = []

    def add(text, pair, times):
        order = np.lexsort((pair, text))
        text, pair, times = text[order], pair[order], times[order]
        lead = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])) if len(text) else np.zeros(0, np.int64)
        found.append((text[lead], pair[lead], np.add.reduceat(times, lead) if len(lead) else times))

    links = n_a * n_b
    large = links > GROUP_PAIRS
    total = np.cumsum(np.where(large, 0, links))
    low = 0
    while low < groups:
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + 2 * GROUP_PAIRS, "right")))
        some = np.arange(low, high)[~large[low:high]]
        n = links[some]
        g = np.repeat(some, n)
        k = inner_index(n)
        pair = ids_a[start_a[g] + k // n_b[g]] * _STEP + ids_b[start_b[g] + k % n_b[g]]
        add(text_of[g], pair, np.ones(len(g), np.int64))
        low = high
    for g in np.flatnonzero(large):
        a, times_a = np.unique(ids_a[start_a[g]:start_a[g] + n_a[g]], return_counts=True)
        b, times_b = np.unique(ids_b[start_b[g]:start_b[g] + n_b[g]], return_counts=True)
        step = max(1, GROUP_PAIRS // len(b))
        for k in range(0, len(a), step):
            pair = (a[k:k + step, None] * _STEP + b).ravel()
            add(np.full(len(pair), text_of[g]), pair, (times_a[k:k + step, None] * times_b).ravel())
    if len(found) == 1:
        return found[0]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    parts = [np.concatenate(x) for x in zip(*found)]
    found.clear()
    add(*parts)
    return found[0]


def _distinct(docs: DataFrame) -> DataFrame:
    """``(key, text, copies)`` of the texts that are not empty, shuffled by the full text."""
    texts = documents(docs).filter("text is not null and text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(_key(F.col("text")), "text", "copies")


def _key(text):
    """Stands for a text where only its identity is needed."""
    return F.unhex(F.sha2(text.cast("binary"), 256)).alias("key")


def _align(texts: DataFrame, byte_path: str, model_path: str) -> DataFrame:
    def run(batches):
        aligner = Aligner(byte_path, model_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE_BYTES, "right")))
                part = batch.slice(low, high - low)
                low, rows = high, part.num_rows
                ids_a, n_a, ids_b, n_b = aligner.encode(part.column(1))
                group_a, group_b = groups_of(aligner.a.width[ids_a], aligner.b.width[ids_b])
                groups = int(group_a[-1]) + 1 if len(group_a) else 0
                text_of = np.zeros(groups, np.int64)
                text_of[group_a] = np.repeat(np.arange(rows), n_a)
                spelled, ends = spell(ids_a, group_a, ids_b, group_b, groups, text_of)
                n_groups = np.bincount(text_of, minlength=rows)
                stop = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], n_groups]))]
                whole = memoryview(spelled)
                digest = [hashlib.sha256(whole[i:j]).hexdigest() if j > i else "" for i, j in zip(stop.tolist(), stop[1:].tolist())]
                links = np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups)
                n_links = np.zeros(rows, np.int64)
                np.add.at(n_links, text_of, links)
                text, pair, times = linked_pairs(ids_a, group_a, ids_b, group_b, groups, text_of)
                per = np.bincount(text, minlength=rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links), pa.array(digest, pa.string()),
                     list_array(pair, per, pa.int64()), list_array(times, per, pa.int64())],
                    ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
        release()

    return texts.select("key", "text", "copies").mapInArrow(
        run, f"key binary, copies bigint, {MEASURES}, pairs array<bigint>, times array<bigint>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets, np.int64))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, count, best)``: documents that hold the pair, and whether no pair of the same first id has more."""
    def run(batches):
        held, size = [], 0

        def summed():
            pairs, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            # Whole numbers, which a weighted bincount of doubles holds exactly up to 2**53.
            return pairs, np.bincount(back, np.concatenate([h[1] for h in held]), len(pairs)).astype(np.int64)

        for batch in batches:
            pairs, n = _lists(batch.column(1))
            held.append((pairs, np.repeat(batch.column(0).to_numpy(), n)))
            size += len(pairs)
            if size > 1 << 21:
                held = [summed()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], ["pair", "n"])
                    size = 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed())], ["pair", "n"])
        release()

    counts = materialize(aligned.select("copies", "pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(
        F.sum("n").alias("count")), "pair-counts")
    first = F.floor(F.col("pair") / _STEP)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, first == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _known(counts: DataFrame, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count looked up in tasks, and the pairs that reach it: at most ``limit`` rows."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("count")) - 6, F.lit(0)))
    step = (F.floor(F.col("count") / unit) * unit).cast("bigint")
    least, held = 1 << 62, 0
    for low, n in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1))).orderBy(F.desc("s")).collect():  # 64 steps a power of two
        if held + n > limit:
            break
        least, held = low, held + n
    found = counts.filter(F.col("count") >= least).orderBy("pair").toPandas()
    return int(least), found["pair"].to_numpy(np.int64), found["count"].to_numpy(np.int64), found["best"].to_numpy(bool)


def _measured(aligned: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """``n_best`` and ``count_sum`` of every text: frequent pairs in place, the others by a join on the pair."""
    spark = aligned.sparkSession
    least, *known = _known(counts, limit)
    shared = spark.sparkContext.broadcast(tuple(known))
    names = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        pairs, count, best = shared.value
        for batch in batches:
            rows = batch.num_rows
            code, n = _lists(batch.column(7))
            times, _ = _lists(batch.column(8))
            row = np.repeat(np.arange(rows), n)
            at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            there = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
            worth = np.where(there, count[at] * times, 0) if len(pairs) else np.zeros(len(code), np.int64)
            top = np.where(there & best[at], times, 0) if len(pairs) else np.zeros(len(code), np.int64)
            ends = np.cumsum(n)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (top, worth)]
            per = np.bincount(row[~there], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], *[pa.array(s[ends] - s[ends - n]) for s in sums], list_array(code[~there], per, pa.int64()),
                 list_array(times[~there], per, pa.int64())], [*names, "n_best", "count_sum", "pairs", "times"])
        release()

    found = materialize(aligned.mapInArrow(
        run, f"key binary, copies bigint, {MEASURES}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"), "measured")
    rest = found.filter(F.size("pairs") > 0).select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "key", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = rest.join(counts.filter(F.col("count") < least), "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_sum"))
    return materialize(found.drop("pairs", "times").join(sums, "key", "left").fillna({"more_best": 0, "more_sum": 0}).select(
        *names, (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum")), "texts")


def align(docs: DataFrame, byte_path: str = "", model_path: str = "", known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros
    and an empty digest. Rows that repeat, also without a doc_id, are documents of their own and count as such.
    Other columns are ignored; an empty table gives no rows.
    """
    byte_path, model_path = byte_path or bpe.default_path(), model_path or piece_path()
    aligned = materialize(_align(_distinct(docs), byte_path, model_path), "aligned")
    counts = materialize(pair_counts(aligned), "pairs")
    texts = _measured(aligned, counts, known_pairs)
    own = documents(docs)
    keyed = own.select("doc_id", F.when(F.length("text") > 0, _key(F.col("text"))).alias("key"))
    total = texts.agg(F.sum("copies")).first()[0] or 0
    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # Fewer than HOT_SHARE texts can have more than that share of the documents, so they may be broadcast.
    hot = F.col("copies") * HOT_SHARE > total
    often = F.broadcast(texts.filter(hot).select("key", *measures))
    there = keyed.filter("key is not null").join(often, "key", "left")
    plain = there.filter("n_a is not null").select("doc_id", *measures)
    other = there.filter("n_a is null").select("doc_id", "key").join(texts.filter(~hot).select("key", *measures), "key").select("doc_id", *measures)
    none = keyed.filter("key is null").select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in measures[:-1]], F.lit("").alias(measures[-1]))
    return plain.union(other).union(none)
