"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Best-fit decreasing looks only at lengths. So the plan is made on the histogram of piece lengths,
which has as many entries as a sequence has tokens: a segment tree over remaining capacities
finds the tightest open bin for a piece in logarithmic time, and pieces of one length that meet
bins of one capacity are placed as one run. The plan equals placing every piece of the corpus
one after the other, in one global order, and its size depends on the sequence length alone.
Pieces are then numbered within their length (inside each task, plus the counts of the tasks
before), and their number picks the run, the bin and the offset. Only the histogram reaches the
driver; no piece is moved for the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.bpe import PART_BYTES, REMEMBER, default_path, encoder
from tablewise.llm.common import batch_of, documents, release, text_slices
from tablewise.session import materialize

CAPACITY = 1024
END_ID = 2
PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, "
          "task int, local bigint")
_BATCH_PIECES = 2048


class CapacityTree:
    """Segment tree over remaining capacities 0..size: is any open bin left below a node."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += bins
            node >>= 1

    def tightest(self, need: int) -> int:
        """Least capacity of an open bin that is at least ``need``, or -1."""
        node = self.leaves + need
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node + (0 if self.open[2 * node] else 1)
                return node - self.leaves
            node >>= 1
        return -1


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first, last, bin, offset)``: pieces number first..last-1 of a length go to bins from ``bin`` on.

    Longest first, each piece into the tightest open bin, else a new one; bins that look alike are
    kept as ranges of bin numbers.
    """
    tree, ranges = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    runs, bins = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            ranges[left].append((first, count))
            tree.add(left, count)

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError("piece lengths lie between 1 and the capacity")
        number, count = 0, histogram[length]
        while number < count:
            left = tree.tightest(length)
            if left < 0:
                # A new bin is the tightest one for the next pieces of this length until it is full.
                each = capacity // length
                full, rest = divmod(count - number, each)
                for k in range(each):
                    if full:
                        runs.append((length, number + k * full, number + (k + 1) * full, bins, k * length))
                put(capacity - each * length, bins, full)
                number, bins = number + each * full, bins + full
                for k in range(rest):
                    runs.append((length, number + k, number + k + 1, bins, k * length))
                if rest:
                    put(capacity - rest * length, bins, 1)
                    bins += 1
                break
            first, size = ranges[left].pop()
            tree.add(left, -size)
            each = left // length
            take = min(size, (count - number) // each)
            for k in range(each):
                if take:
                    runs.append((length, number + k * take, number + (k + 1) * take, first, capacity - left + k * length))
            put(left - each * length, first, take)
            number += each * take
            if take < size:
                some = count - number
                for k in range(some):
                    runs.append((length, number + k, number + k + 1, first + take, capacity - left + k * length))
                if some:
                    put(left - some * length, first + take, 1)
                    take += 1
                put(left, first + take, size - take)
                number = count
    return runs


def tokenize(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID,
             remember: int = REMEMBER, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and checksum.

    Each document's ids end with ``end_id``. A longer one is cut into pieces of ``capacity`` of
    which the first may be shorter. ``task`` and ``local`` number the pieces of a length.
    """
    path = path or default_path()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PIECES))

    def run(batches):
        enc, task = encoder(path, remember, part_bytes), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1)
            for low, high, _, _ in text_slices(texts, part_bytes):
                ids, counts = enc.encode(texts.slice(low, high - low))
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = counts - (pieces - 1) * capacity
                length = np.where(piece == 0, first[row], capacity)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                base = np.cumsum(counts) - counts
                begin = base[row] + start
                order = np.argsort(length, kind="stable")
                sizes, heads, n = np.unique(length[order], return_index=True, return_counts=True)
                local = np.empty(len(row), np.int64)
                local[order] = np.arange(len(row)) - np.repeat(heads, n) + np.repeat(seen[sizes], n)
                seen[sizes] += n
                view = memoryview(whole).cast("B")
                spans = [view[4 * b:4 * (b + k)] for b, k in zip(begin.tolist(), length.tolist())]
                crc = np.fromiter(map(zlib.crc32, spans), np.int64, len(spans))
                doc = batch.column(0).slice(low, high - low).take(pa.array(row))
                bounds = np.append(4 * begin, 4 * len(whole)).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(view)])
                out = batch_of(schema, doc, piece.astype(np.int32), start, length, crc, blob,
                               np.full(len(row), task, np.int32), local)
                for k in range(0, len(row), _BATCH_PIECES):
                    yield out.slice(k, _BATCH_PIECES)
        release()

    return documents(docs).mapInArrow(run, PIECES)


#: About 24 MB.
BROADCAST_ROWS = 1 << 20


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces.

    ``pieces`` must be a stored table (its ``task`` and ``local`` are read twice). The plan has at
    most a few thousand runs whatever the number of pieces, so it is broadcast. The counts ahead of each
    task have a row for each task and length: up to ``BROADCAST_ROWS`` are broadcast, more are merged.
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs = plan_bins(histogram, capacity)
    plan = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 0)], "length bigint, first bigint, last bigint, bin bigint, _offset bigint")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Runs of a length start at rising numbers; the range test picks one.
    way = "broadcast" if counts.count() <= BROADCAST_ROWS else "shuffle_merge"
    numbered = pieces.join(materialize(before, "before").hint(way), ["task", "length"]).withColumn("_number", F.col("before") + F.col("local"))
    return numbered.join(F.broadcast(plan), "length").filter("_number >= first and _number < last").select(
        *[c for c in pieces.columns if c not in ("task", "local")],
        (F.col("bin") + F.col("_number") - F.col("first")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID,
         remember: int = REMEMBER, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)`` of all documents.

    A null text is an empty one: a piece of the end id alone. Repeated rows and rows without a
    doc_id are packed like any other; an empty table gives no rows.
    """
    return place(materialize(tokenize(docs, capacity, path, end_id, remember, part_bytes), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The filled sequences ``(sequence_id, n_tokens, ids)``; at most ``capacity`` tokens meet in a group."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("_parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
