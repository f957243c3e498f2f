"""Whitening of embeddings from exact cross-products, counted on bit planes.

An entry c becomes the whole number x = floor(1024 * c) + 100000. Less the smallest x, every entry
has a fixed number of bits. For a block of rows, bit a of dimension i is packed across the rows into
words; the products of two dimensions then sum to the counts of bits that two planes share, weighted
by 2**(a + b). Sums and products are whole numbers to the end: they are centred as n * Q - S * S'
before anything is divided, and only this matrix, whose size is the dimension's square, reaches the
driver for ``eigh``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import list_array, release
from tablewise.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows packed at once, a multiple of 64.
BLOCK_ROWS = 1 << 15
#: Entries beyond it have no exact whole number in a long.
_LARGEST = float(1 << 52)


def planes(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of a block (rows by dimensions, not negative): dimension, bit, words of 64 rows."""
    rows, dims = u.shape
    words = -(-rows // 64)
    out = np.empty((dims, bits, words), np.uint64)
    padded = np.zeros((dims, words * 64), np.uint64)
    padded[:, :rows] = u.T
    for a in range(bits):
        bit = ((padded >> np.uint64(a)) & np.uint64(1)).astype(np.uint8)
        out[:, a] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64)
    return out


def products(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of each dimension, and of the products of each pair i <= j (0 below), from bit planes."""
    dims, bits, words = p.shape
    # Short numbers fit a long; wide ones are summed as Python's whole numbers.
    kind = np.int64 if 2 * bits + int(words * 64).bit_length() < 62 else object
    weight = np.array([1 << a for a in range(bits)], dtype=kind)
    single = np.bitwise_count(p).sum(axis=2, dtype=np.int64)
    sums = (single.astype(kind) * weight).sum(axis=1)
    found = np.zeros((dims, dims), kind)
    for i in range(dims):
        for a in range(bits):
            shared = np.bitwise_count(p[i:] & p[i, a]).sum(axis=2, dtype=np.int64)
            found[i, i:] += (shared.astype(kind) * weight).sum(axis=1) << a if kind is np.int64 else (
                shared.astype(kind) * weight).sum(axis=1) * (1 << a)
    return sums, found


def _rows_of(column, dims: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _whole(values: np.ndarray, lowest: int) -> np.ndarray:
    return np.floor(values * SCALE).astype(np.int64) + (SHIFT - lowest)


def _scatter(fit: DataFrame, dims: int, lowest: int, bits: int) -> tuple[list[int], list[list[int]]]:
    """Exact S and Q of the shifted numbers; the tasks' sums are added up before they reach the driver."""
    def run(batches):
        sums, found = np.zeros(dims, object), np.zeros((dims, dims), object)
        held, size = [], 0

        def count():
            s, q = products(planes(np.concatenate(held), bits))
            return sums + s, found + q

        for batch in batches:
            u = _whole(_rows_of(batch.column(0), dims), lowest).astype(np.uint64)
            for low in range(0, len(u), BLOCK_ROWS):
                held.append(u[low:low + BLOCK_ROWS])
                size += len(held[-1])
                if size >= BLOCK_ROWS:
                    sums, found = count()
                    held, size = [], 0
        if held:
            sums, found = count()
        i, j = np.triu_indices(dims)
        import decimal

        with decimal.localcontext(prec=38):
            values = [decimal.Decimal(int(v)) for v in [*sums, *found[i, j]]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(dims, -1), i])), pa.array(np.concatenate([np.arange(dims), j])),
             pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])
        release()

    rows = fit.select("x").mapInArrow(run, "i bigint, j bigint, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    sums, found = [0] * dims, [[0] * dims for _ in range(dims)]
    for i, j, v in rows:
        if i < 0:
            sums[j] = int(v)
        else:
            found[i][j] = found[j][i] = int(v)
    return sums, found


def components_of(n: int, sums: list[int], found: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, unit eigenvectors as rows, and the trace of the covariance."""
    dims = len(sums)
    v = np.array([[(n * found[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    e, vectors = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")
    return e[order], vectors.T[order], float(np.trace(v))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_full)``, a row for each
    remaining vector and component.

    Left out are vectors that are null, hold null or non-finite entries or entries of 2**52 and more (they
    have no exact whole number), and those of another length than most (the longer one of a tie). Repeated
    rows, and rows without a vec_id, are vectors of their own. A deviation that no long can hold is null;
    ``deviation_full`` holds it. A component without variance, as when all vectors are equal or fewer than
    dimensions, has a null ``whitened`` and explains 0. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    own = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    # A null entry makes forall null, which a filter does not let through.
    good = own.filter(F.forall("x", lambda c: ~F.isnan(c) & (F.abs(c) < _LARGEST)) & (F.size("x") > 0))
    lengths = good.groupBy(F.size("x").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    out = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, "
           "deviation_full decimal(38,0)")
    if most is None:
        return spark.createDataFrame([], out)
    dims, n = most["d"], most["n"]
    lowest = int(np.floor(most["low"] * SCALE)) + SHIFT
    bits = max(1, (int(np.floor(most["high"] * SCALE)) + SHIFT - lowest).bit_length())
    fit = good.filter(F.size("x") == dims)
    sums, found = _scatter(fit, dims, lowest, bits)
    e, vectors, trace = components_of(n, sums, found)
    shown = min(components, dims)
    real = e[:shown] > max(e[0], 0) * dims * 2.0**-50
    scale = np.where(real, 1 / np.sqrt(np.where(real, e[:shown], 1)), 0)
    axes = (vectors[:shown] * scale[:, None]).T
    # The largest n * x - S tells which arithmetic is exact.
    wide = n * (1 << bits)
    small = dims * wide * wide < 1 << 62
    centre = np.array(sums, dtype=np.int64 if wide < 1 << 62 else object)

    def run(batches):
        import decimal

        for batch in batches:
            if not batch.num_rows:
                continue
            u = _whole(_rows_of(batch.column(1), dims), lowest)
            y = n * (u if wide < 1 << 62 else u.astype(object)) - centre
            if small:
                total = (y * y).sum(axis=1).tolist()
            else:
                total = [sum(map(int.__mul__, r, r)) for r in y.tolist()]
            w = (y / n).astype(np.float64) @ axes
            with decimal.localcontext(prec=60):
                full = [decimal.Decimal(t) if t < 10**38 else None for t in total]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t if t < 1 << 63 else None for t in total], pa.int64()), pa.array(full, pa.decimal128(38, 0)),
                 list_array(w.ravel(), np.full(len(w), shown), pa.float64())], ["vec_id", "deviation", "deviation_full", "w"])
        release()

    white = materialize(fit.select("vec_id", "x").mapInArrow(
        run, "vec_id bigint, deviation bigint, deviation_full decimal(38,0), w array<double>"), "whitened")
    kept = np.flatnonzero(real).tolist()
    means = white.agg(F.lit(0), *[F.sum(F.col("w")[k]) / n for k in kept]).first()[1:]
    pairs = [(a, b) for a in range(len(kept)) for b in range(a, len(kept))]
    shared = white.agg(F.lit(0), *[
        F.sum((F.col("w")[kept[a]] - means[a]) * (F.col("w")[kept[b]] - means[b])) / n for a, b in pairs]).first()[1:]
    error = max((abs(v - (a == b)) for (a, b), v in zip(pairs, shared, strict=True)), default=0.0)
    facts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(bool(real[k])).alias("real"),
                               F.lit(float(max(e[k], 0) / trace) if trace > 0 else 0.0).alias("explained")) for k in range(shown)])
    rows = white.select("vec_id", "deviation", "deviation_full", F.explode(F.arrays_zip("w", facts.alias("f"))).alias("p"))
    return rows.select(
        "vec_id", F.col("p.f.component").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(F.col("p.f.real"), F.col("p.w")).alias("whitened"), F.col("p.f.explained").alias("explained"),
        F.lit(float(error)).alias("identity_error"), "deviation_full")
