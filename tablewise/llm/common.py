"""Helpers of the operators: text buffers as arrays, word hashes, sorted groups, remote files.

Texts reach Python as Arrow batches. They are handled as flat byte arrays in slices of bounded
size, so memory does not depend on the number of rows in a batch; one text is never cut.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POW: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of a table; extra columns never reach an operator."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id as text, by which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column, null as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "") if array.null_count else array
    array = array.cast(pa.large_binary()) if pa.types.is_binary(array.type) else array.cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    whole = array.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[bounds[0]:bounds[-1]] if whole is not None and whole.size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, high
        low = high


def text_slices(array: pa.Array, limit: int = SLICE_BYTES):
    """``(low, high, data, bounds)`` of the rows of a column, slice by slice."""
    data, bounds = flat(array)
    for low, high in slices(bounds, limit):
        yield low, high, data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POW.get("up", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        base = 0xD6E8FEB86659FD93
        for name, b in (("up", base), ("down", pow(base, -1, 2**64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POW[name] = np.multiply.accumulate(steps)
    return _POW["up"][:n], _POW["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, all from one running sum."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def find_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words (runs without blanks) and the first word of each row, with the total last."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = bounds[1:] > bounds[:-1]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    first[heads], last[tails] = word[heads], word[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, bounds)


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and row of every window of so many words inside one row."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return np.arange(count.sum()) - begin[row] + first[:-1][row], row


def combine(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of the windows that start at these words."""
    out = np.full(len(at), size * int(_ODD) % 2**64, np.uint64)
    for k in range(size):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += words[at + k]
    return mix(out)


def repeat_rows(counts: np.ndarray) -> np.ndarray:
    """Row number of each element of lists of these lengths."""
    return np.repeat(np.arange(len(counts)), counts)


def inner_index(counts: np.ndarray) -> np.ndarray:
    """Place of each element inside its list."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def map_texts(df: DataFrame, added: str, work: Callable, column: str = "text") -> DataFrame:
    """Append columns made from one text column, batch by batch; columns of these names are replaced.

    ``work`` is called once per task and returns a function from a text array to the new columns.
    """
    new = T._parse_datatype_string(added)
    kept = df.select(*[c for c in df.columns if c not in new.names])
    schema = T.StructType([*kept.schema.fields, *new.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        make = work()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [pa.array(v, k) if not isinstance(v, pa.Array) else v
                      for v, k in zip(make(batch.column(batch.schema.names.index(column))), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], names=[*batch.schema.names, *new.names])
        make = batch = values = None  # what the task remembered is freed before memory is given back
        release()

    return kept.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back at the end of a task: the worker process stays for other tasks."""
    import ctypes
    import gc

    _POW.clear()  # as long as the longest text so far
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def whole_groups(batches, key: str) -> Iterator[pa.Table]:
    """Regroup a stream sorted by ``key`` so that no group is cut between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and keys[0] != held[-1].column(batch.schema.names.index(key))[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def filesystem(uri: str):
    """File system and path of a folder Spark names by URI or plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), uri[5:].replace("///", "/", 1) if uri.startswith("file:///") else uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    from tablewise.session import work_folder

    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
