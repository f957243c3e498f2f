"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams (single words, word pairs, and three bytes in a row) are
counted: one over trusted texts (labelled good), one over the whole raw corpus. A document's
score is the mean of log p_trusted - log p_raw over its n-grams, so length does not count. The
threshold is the place that best parts labelled good from labelled bad documents; every document
is judged by it, nothing is drawn at random.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    SPACE, combine, documents, find_words, map_texts, mix, release, span_hashes, text_slices, windows,
)
from tablewise.session import materialize

BUCKETS = 1 << 14
#: Up to so many labels are broadcast; more are joined by a shuffle. Results do not depend on it.
BROADCAST_ROWS = 1 << 20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _count(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of values that occur again in their row, and of those that are not the first."""
    order = np.lexsort((keys, row))
    r, k = row[order], keys[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    again, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order] = same[:-1] | same[1:]
    later[order] = same[:-1]  # the sort is stable: the first in the text comes first
    return again, later


def base_counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The columns of ``BASE``; lines and windows are compared by 64-bit hashes."""
    rows = len(bounds) - 1
    start, end, first = find_words(data, bounds)
    n_words = np.diff(first)
    chars = _count((~SPACE[data]) & ((data & 0xC0) != 0x80), bounds)
    symbols = _count(_SYMBOL[data], bounds)
    # Lines: cut at line feeds and between rows; only those with a word count.
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([bounds[:-1], feeds + 1]))
    begin = begin[begin < len(data)]
    row_of = np.searchsorted(bounds, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(data)), bounds[row_of + 1]) if len(begin) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if len(begin) else stop
    worded = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, row_of = begin[worded], stop[worded], row_of[worded]
    dup = np.bincount(row_of[repeated(row_of, span_hashes(data, begin, stop))[1]], minlength=rows)
    words = span_hashes(data, start, end)
    at, row = windows(first, 3)
    again, _ = repeated(row, combine(words, at, 3))
    covered = np.zeros(len(start) + 3, bool)
    for k in range(3):
        covered[at[again] + k] = True
    repeat = _count(covered[:len(start)], first)
    return [n_words, chars, symbols, dup, repeat, (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words)]


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram."""
    start, end, first = find_words(data, bounds)
    words = span_hashes(data, start, end)
    pair, pair_row = windows(first, 2)
    triple, triple_row = windows(bounds, 3)
    code = data.astype(np.uint64)
    grams = mix(code[triple] | code[triple + 1] << np.uint64(8) | code[triple + 2] << np.uint64(16) | np.uint64(1 << 32))
    row = np.concatenate([np.repeat(np.arange(len(bounds) - 1), np.diff(first)), pair_row, triple_row])
    keys = np.concatenate([words, combine(words, pair, 2), grams])
    return row, (keys & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float


def _counts(flagged: DataFrame) -> DataFrame:
    """``(bucket, raw, trusted)`` summed per task before the shuffle."""
    def run(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags = pc.fill_null(batch.column(1), False).to_numpy(zero_copy_only=False)
            for low, high, data, bounds in text_slices(batch.column(0)):
                row, key = features(data, bounds)
                raw += np.bincount(key, minlength=BUCKETS)
                good += np.bincount(key[flags[low:high][row]], minlength=BUCKETS)
        release()
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "trusted"])

    return flagged.select("text", "trusted").mapInArrow(run, "bucket bigint, raw bigint, trusted bigint").groupBy(
        "bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def _trusted(labels: DataFrame) -> DataFrame:
    """``(_id, trusted)`` of every labelled id: true for good, false for bad; bad if one of its labels says so."""
    return labels.select(F.col("doc_id").cast("bigint").alias("_id"), (F.col("quality") == 1).alias("trusted")).filter(
        "_id is not null and trusted is not null").groupBy("_id").agg(F.min("trusted").alias("trusted"))


def _flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``trusted`` beside every row, null without a label; rows without a doc_id are not shuffled."""
    match = F.col("doc_id") == F.col("_id")
    if ids.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), match, "left").drop("_id")
    named = docs.filter("doc_id is not null").join(ids.hint("shuffle_hash"), match, "left").drop("_id")
    return named.union(docs.filter("doc_id is null").withColumn("trusted", F.lit(None).cast("boolean")))


def choose_threshold(grid: list[tuple[int, int, int]]) -> float:
    """Least error, as shares of the good below and the bad above; the middle of equally good places.

    ``grid`` has ``(thousandths, good, bad)`` in rising order. Without bad ones it lies a whole unit
    below the lowest good score, without good ones nowhere.
    """
    good, bad = sum(g for _, g, _ in grid), sum(b for _, _, b in grid)
    if not good:
        return float("-inf")
    if not bad:
        return next(s for s, g, _ in grid if g) / 1000 - 1
    places, best, low, high = [grid[0][0], *(s + 1 for s, _, _ in grid)], None, 0, bad
    for k, place in enumerate(places):
        if k:
            low, high = low + grid[k - 1][1], high - grid[k - 1][2]
        until = grid[k][0] if k < len(grid) else place
        error = low / good + high / bad
        if best is None or error < best[0]:
            best = (error, place, until)
    return (best[1] + best[2]) / 2000


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, n_words, ..., base_failed, score, kept)`` of every row.

    Both models count whole tables, and the threshold looks at every labelled document.

    Null and empty texts have no words, fail the base rules and are not kept; their score is 0.
    Without trusted labels the two models agree, all scores are 0 and the base rules decide.
    Repeated rows are judged alike; a null doc_id has no label.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      *[c for c in keep if c not in ("doc_id", "text")])
    ids = materialize(_trusted(labels), "trusted")
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in _counts(_flagged(own.select("doc_id", "text"), ids)).collect():  # at most BUCKETS rows
        raw[b], good[b] = r, g
    ratio = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    if not good.sum():
        ratio[:] = 0

    def work():
        def run(texts):
            parts, scores = [], []
            for low, high, data, bounds in text_slices(texts):
                parts.append(base_counts(data, bounds))
                row, key = features(data, bounds)
                n = np.bincount(row, minlength=high - low)
                scores.append(np.bincount(row, ratio[key], minlength=high - low) / np.maximum(n, 1))
            return [*map(np.concatenate, zip(*parts)), np.round(np.concatenate(scores), 6)]
        return run

    scored = map_texts(own, f"{BASE}, score double", work)
    if "text" not in keep:
        scored = scored.drop("text")
    scored = materialize(scored, "quality")
    step = F.floor(F.col("score") * 1000)
    light = _flagged(scored.filter("not base_failed").select("doc_id", "score"), ids)
    grid = light.filter("trusted is not null").groupBy(step.alias("s")).agg(
        F.count_if("trusted"), F.count_if(~F.col("trusted"))).orderBy("s").collect()  # scores lie within 20 of 0
    threshold = choose_threshold([tuple(r) for r in grid])
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
