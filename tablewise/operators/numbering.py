"""Row numbers, block keys and stride samples without one-task windows.

A table may hold a third of all rows, so nothing here sorts or joins a whole table in
one task. Rows are addressed by blocks of 65,536 row numbers; every window below sees
at most that many rows, and per-table facts are copied once per block before a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import vocab as V
from tablewise.session import materialize

TABLE = ("source_file", "sheet")
BLOCK_BITS = 16


def explode_cells(rows: DataFrame, *keep: str) -> DataFrame:
    """Long form ``(*keep, pos, value)`` of the cells.

    The outer variant keeps the optimizer from testing the size of the array first, which
    would compute every cell twice.
    """
    long = rows.select(*keep, F.posexplode_outer("cells").alias("pos", "value"))
    return long.filter(F.col("pos").isNotNull())


def block_of(row_no: Column, level: int = 1) -> Column:
    return F.shiftright(row_no, BLOCK_BITS * level)


def block_offsets(df: DataFrame, order: str = "row_no") -> DataFrame:
    """``(table, block, before, n, total)``: rows of the table ahead of each block."""
    counts = df.groupBy(*TABLE, block_of(F.col(order)).alias("block")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("upper", F.shiftright("block", BLOCK_BITS))
    upper = counts.groupBy(*TABLE, "upper").agg(F.sum("n").alias("upper_n"))
    by_table = Window.partitionBy(*TABLE).orderBy("upper")
    upper = upper.select(
        *TABLE, "upper",
        (F.sum("upper_n").over(by_table) - F.col("upper_n")).alias("upper_before"),
        F.sum("upper_n").over(Window.partitionBy(*TABLE)).alias("total"),
    )
    inside = Window.partitionBy(*TABLE, "upper").orderBy("block")
    return (
        counts.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
        .join(upper, [*TABLE, "upper"])
        .select(*TABLE, "block", (F.col("upper_before") + F.col("inside")).alias("before"),
                "n", "total")
    )


def number_rows(df: DataFrame, order: str = "row_no", into: str = "row_no") -> DataFrame:
    """Dense 0-based row numbers per table in the order of a unique non-negative column."""
    local = Window.partitionBy(*TABLE, "block").orderBy(order)
    ranked = df.withColumn("block", block_of(F.col(order))).withColumn(
        "_local", F.row_number().over(local) - 1
    )
    offsets = block_offsets(df, order).select(*TABLE, "block", "before")
    dense = ranked.join(offsets, [*TABLE, "block"]).withColumn(
        "_dense", F.col("before") + F.col("_local")
    )
    return dense.drop("block", "before", "_local", into).withColumnRenamed("_dense", into)


def stride_positions(size: int, every: bool = True) -> Column:
    """Sample positions that fall in a block, from its ``before``, ``n`` and ``total``.

    ``every`` lists all positions of tables no larger than the sample.
    """
    last = max(size - 1, 1)
    span = F.greatest(F.col("total") - 1, F.lit(1))
    low = F.floor(F.col("before") * last / span) - 1
    high = F.floor((F.col("before") + F.col("n")) * last / span) + 1
    steps = F.sequence(F.greatest(low, F.lit(0)), F.least(F.greatest(high, F.lit(0)), F.lit(size - 1)))
    exact = F.transform(
        steps, lambda i: F.rint((i * (F.col("total") - 1)).cast("double") / F.lit(float(last))).cast("bigint")
    )
    picks = F.array(F.lit(0).cast("bigint")) if size == 1 else exact
    if every:
        small = F.when(F.col("total") <= size, F.sequence(F.col("before"), F.col("before") + F.col("n") - 1))
        picks = F.coalesce(small, picks)
    inside = lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n"))
    return F.array_distinct(F.filter(picks, inside))


def stride_sample(rows: DataFrame, size: int = V.SAMPLE_ROWS, dense: bool = False) -> DataFrame:
    """All rows of small tables, else ``size`` evenly spaced rows with first and last.

    The block counts tell which blocks hold the wanted positions, so only those blocks
    are ranked and shuffled, not the tables. Where row numbers are known to run 0, 1, 2 ...
    without gaps, the positions are the row numbers and a join on them is all it takes.
    """
    if size < 1:
        raise ValueError("sample size must be at least 1")
    if dense:
        totals = rows.groupBy(*TABLE).agg((F.max("row_no") + 1).alias("n")).withColumns(
            {"total": F.col("n"), "before": F.lit(0).cast("bigint")})
        few = F.when(F.col("n") <= size, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(
            stride_positions(size, every=False))
        picks = materialize(totals.select(*TABLE, F.explode(few).alias("row_no")), "picks")
        return rows.join(picks, [*TABLE, "row_no"]).withColumn("position", F.col("row_no"))
    # Stored, the wanted positions have a known size: while small, they are broadcast and rows
    # outside the wanted blocks are never shuffled.
    wanted = materialize(
        block_offsets(rows)
        .select(*TABLE, "block", "before", stride_positions(size).alias("picks"))
        .filter(F.size("picks") > 0), "wanted")
    local = Window.partitionBy(*TABLE, "block").orderBy("row_no")
    return (
        rows.withColumn("block", block_of(F.col("row_no")))
        .join(wanted, [*TABLE, "block"])
        .withColumn("position", F.col("before") + F.row_number().over(local) - 1)
        .filter(F.array_contains("picks", F.col("position")))
        .drop("block", "before", "picks")
    )


def per_block(facts: DataFrame, last_row: str = "last_row") -> DataFrame:
    """One copy of each table's facts per block of its rows, for a join without hot keys."""
    blocks = F.sequence(F.lit(0).cast("bigint"), block_of(F.col(last_row)))
    return facts.withColumn("block", F.explode(blocks)).drop(last_row)


def with_table_facts(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with per-table facts; ``facts`` carries ``last_row`` of its table."""
    keyed = rows.withColumn("block", block_of(F.col("row_no")))
    return keyed.join(per_block(facts), [*TABLE, "block"], how).drop("block")
