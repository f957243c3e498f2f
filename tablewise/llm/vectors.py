"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A vector is turned three times by random signs and a Hadamard transform; the place and sign of
its largest coordinate is the hash, two of them make a bucket of a table. Each vector is put into
its own bucket and into the next most likely one of every table. Pairs that meet are verified by
cosine in double precision. Equal vectors collapse first. A bucket is split into blocks of
bounded size and pairs of blocks are compared by matrix products; a pair is counted in the first
bucket the two share, so no pair is ever emitted: only link counts and spanning links leave a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import list_array, mix, parallelism, whole_groups
from tablewise.llm.graph import components
from tablewise.session import materialize

SIMILARITY = 0.95
TABLES, HASHES = 14, 2
BLOCK_ROWS = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = 5) -> np.ndarray:
    """Keys ``[rows, 2 * tables]``: the own bucket of each table and the probed one beside it."""
    rows, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    draw = np.random.default_rng([seed, dim])
    padded = np.zeros((rows, width))
    padded[:, :dim] = unit
    at, keys = np.arange(rows), []
    for t in range(tables):
        codes, second, gaps = [], [], []
        for _ in range(hashes):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * draw.choice([-1.0, 1.0], width))
            size = np.abs(turned)
            two = np.argpartition(size, width - 2, axis=1)[:, -2:]
            swap = size[at, two[:, 0]] > size[at, two[:, 1]]
            best, next_ = np.where(swap, two[:, 0], two[:, 1]), np.where(swap, two[:, 1], two[:, 0])
            codes.append(2 * best + (turned[at, best] < 0))
            second.append(2 * next_ + (turned[at, next_] < 0))
            gaps.append(size[at, best] - size[at, next_])
        probe = np.argmin(gaps, axis=0)
        own = np.zeros(rows, np.uint64)
        other = np.zeros(rows, np.uint64)
        for k in range(hashes):
            own = mix(own * np.uint64(31) + codes[k].astype(np.uint64) + np.uint64(1))
            other = mix(other * np.uint64(31) + np.where(probe == k, second[k], codes[k]).astype(np.uint64) + np.uint64(1))
        keys += [mix(v + np.uint64((t + 1) << 32 | dim)) for v in (own, other)]
    return np.stack(keys, axis=1).view(np.int64)


def _coded(tables: int, hashes: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            digest: list = [None] * len(n)
            keys = np.zeros((len(n), 2 * tables), np.int64)
            for dim in np.unique(n[n > 0]):
                rows = np.flatnonzero(n == dim)
                x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
                with np.errstate(all="ignore"):
                    scale = np.abs(x).max(axis=1)
                    good = np.isfinite(scale) & (scale > 0)
                    x, rows, scale = x[good] + 0.0, rows[good], scale[good]
                if not len(rows):
                    continue
                unit = x / scale[:, None]
                unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
                keys[rows] = bucket_keys(unit, tables, hashes)
                for i, v in zip(rows.tolist(), x):
                    digest[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            held = np.array([2 * tables if d else 0 for d in digest], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), lists,
                 list_array(keys[held > 0].ravel(), held, pa.int64())], ["vec_id", "digest", "vector", "keys"])
    return run


def _compare(similarity: float, slots: int):
    def run(batches):
        for rows in whole_groups(batches, "task"):
            ids, task, key = rows["x"].to_numpy(), rows["task"].to_numpy(), rows["key"].to_numpy()
            copies, side = rows["copies"].to_numpy(), rows["side"].to_numpy()
            same = rows["same"].to_numpy(zero_copy_only=False)
            lists = rows["vector"].combine_chunks()
            values, bounds = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets, np.int64)
            keys = rows["keys"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), slots)
            heads = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            out: list[list] = [[], [], []]
            for low, high in zip(heads, np.append(heads[1:], len(ids))):
                dim = bounds[low + 1] - bounds[low]
                x = values[bounds[low]:bounds[high]].reshape(high - low, dim)
                x = x / np.abs(x).max(axis=1)[:, None]
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                linked = unit @ unit.T >= similarity
                if same[low]:
                    linked = np.triu(linked, 1)
                else:
                    linked &= (side[low:high] == 0)[:, None] & (side[low:high] == 1)[None, :]
                a, b = np.nonzero(linked)
                if not len(a):
                    continue
                # Spanning links: labels fall to the least vector in reach.
                label = np.arange(high - low)
                while True:
                    least = label.copy()
                    np.minimum.at(least, a, label[b])
                    np.minimum.at(least, b, label[a])
                    least = least[least]
                    if (least == label).all():
                        break
                    label = least
                # A pair counts in its first shared key: none of the slots of its table before, no earlier table.
                first = np.ones(len(a), bool)
                table_of = int(np.flatnonzero(keys[low] == key[low])[0]) // 2
                k = keys[low:high]
                for t in range(table_of + 1):
                    for i in (2 * t, 2 * t + 1):
                        for j in (2 * t, 2 * t + 1):
                            hit = k[a, i] == k[b, j]
                            if t == table_of:
                                hit &= k[a, i] < key[low]
                            first &= ~hit
                gained = np.bincount(a[first], copies[low:high][b[first]], high - low) + np.bincount(
                    b[first], copies[low:high][a[first]], high - low)
                some = np.flatnonzero((gained > 0) | (label != np.arange(high - low)))
                out[0] += ids[low:high][some].tolist()
                out[1] += ids[low:high][label[some]].tolist()
                out[2] += gained[some].astype(np.int64).tolist()
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "b", "links"])
    return run


def near_vectors(embeddings: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, hashes: int = HASHES,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``embeddings (vec_id, embedding)``.

    Null, empty and zero vectors, those with null or non-finite components, and vectors of another
    length link with nothing. Repeated rows are vectors of their own: each links to its copies.
    Rows without a vec_id link with nothing, have a null component and are kept. An empty table
    gives no rows.
    """
    plain = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                              F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.when(~F.exists("vector", lambda v: v.isNull()), F.col("vector"))
    rows = materialize(plain.withColumn("vector", usable).mapInArrow(
        _coded(tables, hashes), "vec_id bigint, digest binary, vector array<double>, keys array<bigint>"), "vectors")
    named = rows.filter("digest is not null and vec_id is not null")
    copies = materialize(named.groupBy("digest").agg(F.min("vec_id").alias("x"), F.count(F.lit(1)).alias("copies")), "copies")
    texts = materialize(copies.join(named, (copies["digest"] == named["digest"]) & (copies["x"] == named["vec_id"]))
                        .select("x", copies["digest"], "copies", "vector", "keys").dropDuplicates(["digest"]), "classes")
    keyed = texts.select("x", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    placed = keyed.join(materialize(shared, "shared"), "key").withColumn(
        "block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = placed.select(
        "x", "key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"))
    full = spread.join(texts.drop("digest"), "x").repartition(parallelism(plain.sparkSession), "task").sortWithinPartitions("task", "x")
    found = materialize(full.mapInArrow(_compare(similarity, 2 * tables), "a bigint, b bigint, links bigint"), "found")
    gained = found.groupBy(F.col("a").alias("x")).agg(F.sum("links").alias("gained"))
    component = components(found.select("a", "b")).withColumnRenamed("node", "x")
    classes = copies.join(materialize(gained, "gained"), "x", "left").join(component, "x", "left").select(
        "digest", (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "x").alias("component_id"))
    keys = F.when(F.col("vec_id").isNotNull(), F.col("digest"))
    result = rows.select("vec_id", keys.alias("digest")).join(materialize(classes, "classes"), "digest", "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
