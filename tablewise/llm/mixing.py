"""Mixing sources to target weights by the cube method.

A source's target is a multiple of its words: the whole part is taken as copies of every document,
the fraction is each document's inclusion probability. The probabilities of a block move along
directions that keep both the number of documents and the number of words (the null space of the
two constraints) until they are 0 or 1; at most two stay between. What is left of all blocks meets
in new, far fewer blocks, until a source has one block: its last two documents are the landing.
Blocks have at most a few thousand documents however large the source is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm.common import parallelism
from tablewise.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_DOCS = 1024
#: Documents that join the last two of a source in the landing.
LANDING_DOCS = 12
WORD = r"[^\x20\x09-\x0D]+"
_STATE = "doc_id bigint, source string, size bigint, chance double, block bigint, salt bigint"


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``: words of each text, null as 0."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, source_size, n_docs, target)``; sources rank by code point, null last.

    The level at which weights are served rises until no source is above ``most`` times its size.
    Sources are ranked by sorted partitions and their counts; only sums come to the driver.
    """
    spark = sized.sparkSession
    order = F.col("source").asc_nulls_last()
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranged = materialize(totals.repartitionByRange(parallelism(spark), order).sortWithinPartitions(order)
                         .withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    firsts, before = [], 0
    for number, n in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        firsts.append((number, before))
        before += n
    places = spark.createDataFrame(firsts or [(-1, 0)], "_part bigint, _before bigint")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    choice = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    weighed = materialize(ranged.withColumn("_part", part).join(F.broadcast(places), "_part").select(
        "source", "source_size", "n_docs", choice.cast("bigint").alias("weight")), "weights")
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, limit = 0.0, most * F.col("source_size")
    while True:
        served = (F.lit(level) * F.col("weight")) > limit
        full, open_weight = weighed.agg(
            F.sum(F.when(served, limit).otherwise(0)), F.sum(F.when(served, 0).otherwise(F.col("weight")))).first()
        raised = (whole - (full or 0)) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return weighed.select("source", "source_size", "n_docs",
                          F.least(F.lit(level) * F.col("weight"), limit.cast("double")).alias("target"))


#: Equal rows are dealt in runs of so many (as a power of two).
_RUN_BITS = 12


def fly(chance: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase over one block: the probabilities after it, at most two of them between 0 and 1.

    Large documents are settled first, so that what stays is small. Counts and words are kept.
    """
    out = chance.astype(float).copy()
    draw = np.random.default_rng(seed)
    waiting = [int(i) for i in np.argsort(-size, kind="stable")[::-1] if 0 < out[i] < 1]
    random = iter(draw.random(3 * len(waiting) + 3).tolist())
    active, value = [], []
    weight = size.tolist()
    while True:
        while len(active) < 3 and waiting:
            i = waiting.pop()
            active.append(i)
            value.append(float(out[i]))
        if len(active) < 3:
            break
        a, b, c = (weight[i] for i in active)
        way = (float(b - c), float(c - a), float(a - b)) if not a == b == c else (1.0, -1.0, 0.0)
        up = min(((1 - v) / u if u > 0 else -v / u) for v, u in zip(value, way) if u)
        down = min((v / u if u > 0 else (v - 1) / u) for v, u in zip(value, way) if u)
        step = up if next(random) * (up + down) < down else -down
        moved = [v + step * u for v, u in zip(value, way)]
        # The one that set the step has arrived; rounding must not keep it between.
        if not any(v <= 1e-9 or v >= 1 - 1e-9 for v in moved):
            near = min(range(3), key=lambda k: min(moved[k], 1 - moved[k]))
            moved[near] = round(moved[near])
        kept = []
        for i, v in zip(active, moved):
            if v <= 1e-9 or v >= 1 - 1e-9:
                out[i] = 0.0 if v < 0.5 else 1.0
            else:
                kept.append((i, v))
        active, value = [i for i, _ in kept], [v for _, v in kept]
    for i, v in zip(active, value):
        out[i] = v
    return out


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the last few documents: the choice nearest in words, then in documents, to what they should give."""
    out = chance.copy()
    left = np.flatnonzero((out > 0) & (out < 1))
    if len(left):
        choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(choices @ size[left] - (out[left] * size[left]).sum())
        docs = np.abs(choices.sum(axis=1) - out[left].sum())
        out[left] = choices[np.lexsort((docs, np.round(words, 6)))[0]]
    return out


def _block(last: bool):
    """The flight of one block. A source's first block keeps documents of all sizes back, for the landing."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "salt", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size, chance = rows["size"].to_numpy(), rows["chance"].to_numpy().copy()
        between = np.flatnonzero((chance > 0) & (chance < 1) & (size > 0))
        first = rows["block"].iloc[0] == 0 and len(between) > LANDING_DOCS
        held = between[np.unique(np.linspace(len(between) // 5, len(between) - 1, LANDING_DOCS).astype(int))] if first else between[:0]
        flies = np.setdiff1d(np.arange(len(rows)), held)
        chance[flies] = fly(chance[flies], size[flies], int(rows["salt"].iloc[0]) & 0x7FFFFFFF)
        rows["chance"] = land(chance, size) if last else chance
        return rows
    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows, told apart by a ``number``: they are counted first, so no group of them meets in one task."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("times") - 1, _RUN_BITS))).alias("run")
    inside = F.least(F.col("times") - F.shiftleft("run", _RUN_BITS), F.lit(1 << _RUN_BITS))
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), inside - 1)).alias("inner")

    def spread(some):
        return some.select(*rows.columns, "run", number).select(*rows.columns, (F.shiftleft("run", _RUN_BITS) + F.col("inner")).alias("number"))

    few, many = (counted.filter(c).select(*rows.columns, "times", runs) for c in (F.col("times") <= 1 << _RUN_BITS, F.col("times") > 1 << _RUN_BITS))
    return spread(few).union(spread(many.repartition("doc_id", "size", "run")))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, block_docs: int = BLOCK_DOCS, seed: int = 7) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every row.

    Null and empty texts have size 0. Repeated rows are drawn one by one; rows without a doc_id too.
    The draw depends on ids, sizes and ``seed`` only, so reruns agree.
    """
    sized = materialize(sizes(docs), "sizes")
    targets = materialize(source_targets(sized, weights, most), "targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "n_docs", (
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)).alias("ratio"))
    rows = _numbered(rows)
    # Rows that repeat get salts, and so blocks, of their own.
    salt = F.when(F.col("number") == 0, F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed), "number"))
    blocks = F.ceil(F.col("n_docs") / block_docs)
    rows = rows.withColumns({"salt": salt, "chance": F.col("ratio") - F.floor("ratio")}).withColumn(
        "block", F.pmod(F.xxhash64("salt", "size"), blocks))
    columns = [c.split()[0] for c in _STATE.split(", ")]
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    settled, now, level_blocks = [], rows.select(*columns), -(-largest // block_docs)
    while True:
        last = level_blocks <= 1
        done = materialize(now.groupBy("source", "block").applyInPandas(_block(last), _STATE), "flight")
        settled.append(done.filter("chance <= 0 or chance >= 1"))
        if last:
            break
        # A block leaves two rows at most: half as many documents' worth of blocks hold them all.
        shrink = max(2, block_docs // 2)
        level_blocks = -(-level_blocks // shrink)
        now = done.filter("chance > 0 and chance < 1").withColumn("block", F.floor(F.col("block") / shrink)).select(*columns)
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.union(more)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    return drawn.join(targets, drawn["source"].eqNullSafe(targets["source"])).select(
        "doc_id", drawn["source"], "size", "source_size", "target",
        (whole + F.col("chance")).cast("int").alias("copies"),
        ((whole + F.col("chance")).cast("bigint") * F.col("size")).alias("taken"))
