"""Token ids in files: static asymmetric numeral coding of independent interleaved blocks.

A file holds segments. The ids of a segment are counted into one static frequency table that all of
its blocks share; each block interleaves 64 lanes of 64-bit states and is coded on its own. The
segment keeps every block's starting states, place and checksum: decoding can begin at any block,
and the blocks of a segment are decoded side by side. Files are written in ascending doc_id order,
one file per sorted partition; the manifest is a table, so readers need no folder listing.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.bpe import PART_BYTES, default_path, encoder
from tablewise.llm.common import documents, filesystem, new_folder, parallelism, text_slices
from tablewise.session import materialize

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 64
BLOCK_IDS = 1 << 14
SEGMENT_IDS = 1 << 21
END_ID = 0
MAGIC = b"TWRANS1\n"
MANIFEST = "part int, number int, file string, position bigint, size bigint, before bigint, n_tokens bigint, n_docs bigint"


def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Whole frequencies that add up to ``2**bits``, none of them 0."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    out = np.maximum(1, (counts.astype(float) / counts.sum() * total).astype(np.int64))
    over = int(out.sum()) - total
    if over < 0:
        out[np.argmax(out)] -= over
    while over > 0:  # taken from the most frequent ones, in proportion
        spare = out - 1
        cut = np.minimum(spare, np.ceil(spare * (over / spare.sum())).astype(np.int64))
        rank = np.argsort(-spare, kind="stable")
        within = np.cumsum(cut[rank]) - cut[rank]
        out[rank] -= np.clip(over - within, 0, cut[rank])
        over = int(out.sum()) - total
    return out


def encode_segment(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray, lanes: int = LANES,
                   block_ids: int = BLOCK_IDS) -> bytes:
    """One segment: header, table, document index, block checkpoints, words."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    rank = np.zeros(len(counts), np.int64)
    rank[symbols] = np.arange(len(symbols))
    place, counts = rank[ids], counts[symbols]
    freq = frequencies(counts) if len(ids) else np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    blocks = -(-len(ids) // block_ids)
    steps = block_ids // lanes
    padded = np.full(blocks * block_ids, np.argmax(freq) if len(ids) else 0, np.int64)  # the cheapest symbol fills up
    padded[:len(ids)] = place
    grid = np.ascontiguousarray(padded.reshape(blocks, steps, lanes).transpose(1, 0, 2))
    state = np.full((blocks, lanes), LOW, np.uint64)
    words, sent = np.zeros((steps, blocks, lanes), np.uint32), np.zeros((steps, blocks, lanes), bool)
    freq64, start64 = freq.astype(np.uint64), start.astype(np.uint64)
    total, room = np.uint64(1 << SCALE_BITS), np.uint64(63 - SCALE_BITS)
    for s in range(steps - 1, -1, -1) if blocks else ():
        f = freq64[grid[s]]
        out = state >= (f << room)
        words[s], sent[s] = state.astype(np.uint32), out
        np.right_shift(state, np.uint64(32), out=state, where=out)
        q = state // f
        state += start64[grid[s]] + q * (total - f)  # q * 2**bits + the rest + start
    stream = words.transpose(1, 0, 2)[sent.transpose(1, 0, 2)]
    n_words = sent.sum(axis=(0, 2)) if blocks else np.zeros(0, np.int64)
    raw = ids.astype("<u4")
    checks = [zlib.crc32(raw[b * block_ids:(b + 1) * block_ids].tobytes()) for b in range(blocks)]
    body = [
        zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 4),
        zlib.compress(np.array([0 if d is None else d for d in docs], "<i8").tobytes()
                      + np.array([d is None for d in docs], "u1").tobytes() + np.asarray(lengths, "<i8").tobytes(), 4),
        state.astype("<u8").tobytes(), np.asarray(n_words, "<u4").tobytes(), np.array(checks, "<u4").tobytes(),
        stream.astype("<u4").tobytes(),
    ]
    head = json.dumps({"n": len(ids), "symbols": len(symbols), "docs": len(docs), "lanes": lanes, "block": block_ids,
                       "parts": [len(p) for p in body]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


def decode_segment(data: bytes, only: range | None = None) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """``(ids, docs, lengths)``; ``only`` decodes some blocks alone. A wrong checksum raises."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment")
    size = struct.unpack_from("<I", data, 8)[0]
    head = json.loads(data[12:12 + size])
    at, parts = 12 + size, []
    for n in head["parts"]:
        parts.append(data[at:at + n])
        at += n
    table = np.frombuffer(zlib.decompress(parts[0]), "<u4")
    symbols, freq = table[:head["symbols"]], table[head["symbols"]:].astype(np.int64)
    index = zlib.decompress(parts[1])
    n_docs = head["docs"]
    ids_of = np.frombuffer(index, "<i8", n_docs)
    nulls = np.frombuffer(index, "u1", n_docs, 8 * n_docs)
    lengths = np.frombuffer(index, "<i8", n_docs, 9 * n_docs)
    docs = [None if z else int(d) for d, z in zip(ids_of, nulls)]
    lanes, block = head["lanes"], head["block"]
    blocks = -(-head["n"] // block)
    chosen = np.arange(blocks)[only.start:only.stop] if only is not None else np.arange(blocks)
    state = np.frombuffer(parts[2], "<u8").reshape(blocks, lanes)[chosen].astype(np.uint64)
    n_words = np.frombuffer(parts[3], "<u4").astype(np.int64)
    checks, stream = np.frombuffer(parts[4], "<u4"), np.append(np.frombuffer(parts[5], "<u4"), np.uint32(0))
    pointer = (np.cumsum(n_words) - n_words)[chosen]
    steps = block // lanes
    start = np.cumsum(freq) - freq
    slot_symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    within = (np.arange(len(slot_symbol)) - np.repeat(start, freq)).astype(np.uint32)
    freq64 = freq.astype(np.uint64)
    left = np.minimum(head["n"] - chosen * block, block)
    out = np.empty((steps, len(chosen), lanes), np.int32)
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for s in range(steps) if len(chosen) else ():
        slot = (state & mask).astype(np.int64)
        sym = out[s] = slot_symbol[slot]
        state >>= bits
        state *= freq64[sym]
        state += within[slot]
        more = state < LOW
        lanes_in = np.flatnonzero(more)
        n = np.count_nonzero(more, axis=1)
        # The words of a block's lanes lie one behind the other.
        at = np.arange(len(lanes_in)) + np.repeat(pointer - (np.cumsum(n) - n), n)
        state.ravel()[lanes_in] = (state.ravel()[lanes_in] << np.uint64(32)) | stream[np.minimum(at, len(stream) - 1)]
        pointer = pointer + n
    flat = out.transpose(1, 0, 2).reshape(len(chosen), block)
    ids = symbols[np.concatenate([flat[i, :k] for i, k in enumerate(left)])] if len(chosen) else np.zeros(0, np.uint32)
    ids = ids.astype("<u4")
    ends = np.cumsum(left)
    for i, b in enumerate(chosen):
        # Coding started from the lowest state, so decoding has to end there.
        if (state[i] != LOW).any() or zlib.crc32(ids[ends[i] - left[i]:ends[i]].tobytes()) != checks[b]:
            raise ValueError(f"block {b} does not match its checksum")
    return ids, docs, lengths


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts (null: empty) and write files in ascending doc_id order, null ids first.

    Returns the stored manifest. A failed attempt leaves a file that the manifest does not name.
    Repeated rows are written one after the other; an empty table gives an empty manifest.
    """
    path = path or default_path()
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = documents(docs).repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        system, base = filesystem(folder)
        rows, stream, position, before = [], None, 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size, file = 0, f"{part:05d}-{uuid.uuid4().hex}.rans"

        def flush():
            nonlocal stream, position, before, names, held, lengths, size
            if stream is None:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(f"{base}/{file}")
            data = encode_segment(np.concatenate(held), names, np.concatenate(lengths))
            stream.write(data)
            rows.append((part, len(rows), file, position, len(data), before, size, len(names)))
            position, before = position + len(data), before + size
            names, held, lengths, size = [], [], [], 0

        for batch in batches:
            texts = batch.column(1)
            for low, high, _, _ in text_slices(texts, PART_BYTES):
                ids, counts = enc.encode(texts.slice(low, high - low))
                held.append(np.insert(ids, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
                names += batch.column(0).slice(low, high - low).to_pylist()
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    flush()
        if names:
            flush()
        if stream is not None:
            stream.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)], _names(MANIFEST))

    return materialize(ranged.mapInArrow(run, MANIFEST), "manifest")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of the documents in the files of a manifest."""
    offsets, total = [], 0
    for part, n in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        offsets.append((part, total))  # one row for each file
        total += n
    firsts = spark.createDataFrame(offsets or [(-1, 0)], "part int, first bigint")
    # Every file starts where the files before it end.
    jobs = manifest.join(F.broadcast(firsts), "part").select(
        "file", "position", "size", (F.col("first") + F.col("before")).alias("start"))
    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def run(batches):
        system, base = filesystem(folder)
        for batch in batches:
            for file, position, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(f"{base}/{file}") as source:
                    source.seek(position)
                    ids, docs, lengths = decode_segment(source.read(size))
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                for k in range(0, len(docs), 2048):
                    few = slice(k, k + 2048)
                    spans = [view[4 * (e - n):4 * e] for e, n in zip(ends[few].tolist(), lengths[few].tolist())]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[few], pa.int64()), pa.array(begin + ends[few] - lengths[few]), pa.array(lengths[few]),
                        pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                        *([pa.array([bytes(s) for s in spans], pa.binary())] if with_ids else []),
                    ], _names(out))

    return jobs.repartition(parallelism(spark), "file", "position").mapInArrow(run, out)


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, folder: str | None = None,
                with_ids: bool = True) -> DataFrame:
    """Write the files and read them back; the folder defaults to a new one in the shared folder."""
    folder = folder or new_folder(docs.sparkSession, "ids")
    return read_ids(docs.sparkSession, write_ids(docs, folder, path, end_id), folder, with_ids)
