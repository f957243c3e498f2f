"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, connected components.

Shingles are mapped to a universe of 2**20 places. One permutation shuffles the places, a second
one is shifted circularly by k for the k-th coordinate of a signature: two permutations give all
coordinates. Bands of 5 coordinates, 32 of them, miss a pair of similarity 0.8 with a chance of
3 in a million, and every link is confirmed on the full sets.

Work stays near linear in the copies: documents with equal sets collapse first; then each text is
compared with the most central text of its buckets only, and what that links becomes one
component. Only buckets that still hold several components are compared further, only between
components, and each pair only in the first band the two share. Such a bucket is split into
blocks of bounded size, so no bucket has to fit a task. Groups of thousands of texts that are all
near but below the threshold remain quadratic in their size: their pairs must be looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    LOWER, batch_of, combine, documents, find_words, list_array, mix, parallelism, release, span_hashes, text_slices,
    whole_groups, windows,
)
from tablewise.llm.graph import components
from tablewise.session import discard, materialize

SHINGLE = 5
SIMILARITY = (8, 10)
BANDS, ROWS = 32, 5
UNIVERSE = 1 << 20
#: Shingles of a block of a bucket, which is split into so many blocks.
BLOCK_SHINGLES = 1 << 17
_SIGNED = "doc_id bigint, text_hash bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"
#: Most bits of the filter of wanted ids (16 MB), and bits that one id sets.
FILTER_BITS, _FILTER_HASHES = 1 << 27, 4
#: Parts of a component when its name is looked up.
_PARTS = 32


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row; a shorter text is one shingle."""
    lower = LOWER[data]
    start, end, first = find_words(lower, bounds)
    words = span_hashes(lower, start, end)
    at, row = windows(first, size)
    rows, keys = [row], [combine(words, at, size)]
    n_words = np.diff(first)
    for k in range(1, size):
        short = np.flatnonzero(n_words == k)
        rows.append(short)
        keys.append(combine(words, first[:-1][short], k))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[keep], key[keep]


class CirculantMinHash:
    """Signatures from two permutations of the universe, the second one shifted circularly."""

    def __init__(self, coordinates: int, universe: int = UNIVERSE, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mask = np.uint64(universe - 1)
        self.shuffle = draw.permutation(universe).astype(np.int32)
        ranks = draw.permutation(universe).astype(np.int32)
        self.ranks = np.concatenate([ranks, ranks[:coordinates]])
        self.universe, self.coordinates = universe, coordinates

    def signatures(self, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have shingles, and a line of coordinates for each."""
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        place = self.shuffle[(key & self.mask).astype(np.int64)].astype(np.intp)
        out = np.empty((self.coordinates, len(heads)), np.int32)
        for k in range(self.coordinates if len(heads) else 0):
            np.minimum.reduceat(self.ranks[k:k + self.universe].take(place), heads, out=out[k])
        return row[heads], out.T


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of every band, the band's number being part of it."""
    grouped = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), grouped.shape[:2]).copy()
    for k in range(rows):
        out = mix(out + grouped[:, :, k])
    return out.view(np.int64)


def _fingerprints(key: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two sums over the shingles of each row; with the count they stand for its set."""
    sums, ends = [], np.cumsum(n)
    for salt in (0x51ED270B, 0x2545F491):
        each = np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(salt)))])
        sums.append((each[ends] - each[ends - n]).view(np.int64))
    return sums


def _sign(docs: DataFrame, size: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_SIGNED))

    def run(batches):
        hasher = CirculantMinHash(BANDS * ROWS)
        for batch in batches:
            for low, high, data, bounds in text_slices(batch.column(1)):
                row, key = shingle_sets(data, bounds, size)
                rows = high - low
                n = np.bincount(row, minlength=rows)
                held, signatures = hasher.signatures(row, key)
                keys = band_keys(signatures, BANDS, ROWS)
                lengths = np.zeros(rows, np.int64)
                lengths[held] = BANDS
                yield batch_of(schema, batch.column(0).slice(low, rows), batch.column(2).slice(low, rows), n, *_fingerprints(key, n),
                               list_array(keys.ravel(), lengths, pa.int64()))
        release()

    return documents(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, _SIGNED)


def _seen_ids(wanted: DataFrame):
    """Bits that a wanted doc_id sets: a filter that lets all of them pass and few others.

    It has ten bits an id, ``FILTER_BITS`` at most: beyond that more others pass, and the join behind
    it, which is exact, has more to drop.
    """
    bits = min(FILTER_BITS, max(1 << 10, 1 << int(10 * wanted.count()).bit_length()))
    slot = F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(bits)) for k in range(_FILTER_HASHES)])).alias("slot")
    words = wanted.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
    found = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most FILTER_BITS / 64 rows
        found[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(found), bits


def _sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the texts whose ids pass the filter; no text is shuffled."""
    seen, bits = _seen_ids(wanted)
    slots = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(bits)) for k in range(_FILTER_HASHES)])

    def run(batches):
        words = seen.value
        for batch in batches:
            slot = batch.column(2).flatten().to_numpy()
            hit = (words[slot >> 6] >> (slot & 63) & 1).reshape(-1, _FILTER_HASHES).all(axis=1)
            batch = batch.filter(pa.array(hit))
            for low, high, data, bounds in text_slices(batch.column(1)):
                row, key = shingle_sets(data, bounds, size)
                n = np.bincount(row, minlength=high - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n), *map(pa.array, _fingerprints(key, n)),
                     list_array(key.view(np.int64), n, pa.int64())], ["doc_id", "n", "f1", "f2", "members"])
        release()

    return documents(docs).filter("doc_id is not null").withColumn("slots", slots).mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, members array<bigint>")


def _buckets(texts: DataFrame) -> DataFrame:
    """``(key, x, shared)`` of the band keys that several texts share."""
    keyed = texts.select(F.col("node").alias("x"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("shared")).filter("shared > 1")
    return keyed.join(materialize(shared, "shared"), "key")


def _enough(common, n_a, n_b, similarity):
    """``100 * intersection >= 80 * union`` in whole numbers."""
    top, bottom = similarity
    return bottom * common >= top * (n_a + n_b - common)


def _central_links(members: DataFrame, sets: DataFrame, similarity) -> DataFrame:
    """Each text against the one that meets most others, among the heads of its buckets."""
    weight = members.groupBy("x").agg(F.sum("shared").alias("w"))
    weighed = members.join(weight, "x")
    heads = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("x")).alias("m"))).alias("head"))
    best = weighed.join(heads, "key").groupBy("x").agg(F.max("head").alias("head")).select(
        "x", (-F.col("head.m")).alias("y")).filter("x != y")
    one = best.join(sets.select("x", F.col("members").alias("a")), "x")
    two = one.join(sets.select(F.col("x").alias("y"), F.col("members").alias("b")), "y")
    common = F.size(F.array_intersect("a", "b"))
    return two.filter(_enough(common, F.size("a"), F.size("b"), similarity)).select(
        F.col("x").alias("a"), F.col("y").alias("b"))


def _partners(ids, task, comp, side, key, same, n, bands, similarity):
    """``(x, y...)`` row numbers inside a task that are to be compared, row by row.

    Sizes must allow the similarity, components differ, and a pair is looked at in its first shared band
    alone. ``comp`` may change meanwhile: what is linked needs no further look.
    """
    top, bottom = similarity
    heads = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    for low, high in zip(heads, np.append(heads[1:], len(ids))):
        place = int(np.flatnonzero(bands[low] == key[low])[0])
        for x in range(low, high):
            if not same[low] and side[x]:
                continue
            y = np.arange(x + 1, high) if same[low] else low + np.flatnonzero(side[low:high] == 1)
            y = y[(comp[y] != comp[x]) & (bottom * np.minimum(n[y], n[x]) >= top * np.maximum(n[y], n[x]))]
            if len(y):
                y = y[~(bands[y, :place] == bands[x, :place]).any(axis=1)]
            if len(y):
                yield x, y, slice(low, high)


def _columns(rows: pa.Table):
    flat = [rows[c].to_numpy() for c in ("x", "task", "component", "side", "key")]
    flat[2] = flat[2].copy()
    bands = rows["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(flat[0]), BANDS)
    return [*flat, rows["same"].to_numpy(zero_copy_only=False), rows["n"].to_numpy(), bands]


def _find_partners(similarity):
    """Rows that have somebody to be compared with: only their sets are sent."""
    def run(batches):
        for rows in whole_groups(batches, "task"):
            columns = _columns(rows)
            hit = np.zeros(len(columns[0]), bool)
            for x, y, _ in _partners(*columns, similarity):
                hit[x] = True
                hit[y] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(columns[k][hit]) for k in (0, 1)], ["x", "task"])
        release()

    return run


def _compare_blocks(similarity):
    def run(batches):
        for rows in whole_groups(batches, "task"):
            columns = _columns(rows)
            ids, comp, n = columns[0], columns[2], columns[6]
            lists = rows["members"].combine_chunks()
            values, bounds = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(lists.offsets, np.int64)
            a, b = [], []
            for x, y, block in _partners(*columns, similarity):
                own = values[bounds[x]:bounds[x + 1]]
                take = np.arange(n[y].sum()) + np.repeat(bounds[y] - (np.cumsum(n[y]) - n[y]), n[y])
                other = values[take]
                spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = np.add.reduceat(own[spot] == other, np.cumsum(n[y]) - n[y], dtype=np.int64)
                for z in y[_enough(common, n[x], n[y], similarity)]:
                    if comp[z] != comp[x]:
                        a.append(ids[x])
                        b.append(ids[z])
                        group = comp[block]
                        group[group == comp[z]] = comp[x]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release()

    return run


def _block_links(members: DataFrame, component: DataFrame, sets: DataFrame, texts: DataFrame, similarity) -> DataFrame:
    """Links between components that still meet in a bucket."""
    known = members.join(component.withColumnRenamed("node", "x"), "x", "left").withColumn(
        "component", F.coalesce("component", "x"))
    sized = sets.select("x", F.size("members").cast("bigint").alias("n")).join(texts.select(F.col("node").alias("x"), "bands"), "x")
    open_keys = known.join(sized.select("x", "n"), "x").groupBy("key").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum("n").alias("n")).filter("c0 != c1").select(
        "key", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = known.join(materialize(open_keys, "open"), "key").withColumn(
        "block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("other", other).select(
        "x", "key", "component",
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"))
    # Both sides of a pair of blocks reach its task: the lower block as side 0, the higher as side 1.
    parts = parallelism(members.sparkSession)
    light = materialize(spread.join(sized, "x"), "blocks")
    paired = materialize(light.repartition(parts, "task").sortWithinPartitions("task", "x").mapInArrow(
        _find_partners(similarity), "x bigint, task bigint"), "paired")
    full = light.join(paired, ["task", "x"]).join(sets, "x").repartition(parts, "task").sortWithinPartitions("task", "x")
    found = materialize(full.mapInArrow(_compare_blocks(similarity), "a bigint, b bigint"), "between")
    discard(light, paired)
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY,
                    with_text: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row, ``with_text`` with ``text_hash`` (xxhash64) and ``chosen``.

    Words are lower-cased in ASCII; a text of fewer words is one shingle; texts without words have
    an empty set and link with nothing. A set of shingles is one node, so rows that share a doc_id
    share a component only if their texts are linked. A component is named by its least doc_id, and rows of
    that id are kept; one of their sets is ``chosen``, so that of a whole component one text stays. Rows without a doc_id link with nothing: their component is null
    and they are kept. An empty table gives no rows.
    """
    signed = materialize(_sign(docs, shingle), "signed")
    named = signed.filter("n > 0 and doc_id is not null")
    whole = ["doc_id", "f1", "f2", "n"]
    # Nodes are numbered in the order of their ids, so the least node of a component has its least id.
    copies = materialize(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")).orderBy("rep", "f1", "f2", "n")
                         .withColumn("node", F.monotonically_increasing_id()), "copies")
    nodes = copies.select("node", F.col("rep").alias("doc_id"), "f1", "f2", "n")
    # Equal sets have equal signatures, so any row of the id and set will do.
    texts = materialize(named.join(nodes, whole).dropDuplicates(whole).select("node", "bands"), "texts")
    members = materialize(_buckets(texts), "members")
    wanted = materialize(nodes.join(members.select(F.col("x").alias("node")), "node", "left_semi"), "wanted")
    found_sets = _sets(docs, shingle, wanted).join(wanted, whole).select(F.col("node").alias("x"), "members")
    # Repeated rows of an id give a set more than once.
    sets = materialize(found_sets.dropDuplicates(["x"]), "sets")
    links = materialize(_central_links(members, sets, similarity), "central")
    first = materialize(components(links), "components")
    more = _block_links(members, first, sets, texts, similarity)
    discard(texts, members, wanted, sets)
    component = materialize(components(links.union(more)), "components")
    discard(links, first, more)
    # A component may hold most nodes: its name is looked up in parts.
    names = component.filter("node = component").join(copies, "node").select(
        "component", F.col("rep").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"))
    called = component.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(_PARTS)).cast("int")).join(
        names, ["component", "part"]).select("node", "component", "name")
    named_copies = copies.join(called, "node", "left").select(
        "f1", "f2", "n", F.coalesce("name", "rep").alias("component_id"),
        (F.coalesce("component", "node") == F.col("node")).alias("head"))
    named_copies = materialize(named_copies, "named")
    discard(component, copies)
    found = signed.join(named_copies, ["f1", "f2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    # Of the texts that share the id of their component, one set stands for it.
    chosen = kept & F.when(F.col("doc_id").isNull(), True).otherwise(F.coalesce("head", F.lit(True)))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"),
                        *(["text_hash", chosen.alias("chosen")] if with_text else []))
