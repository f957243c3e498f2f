"""Column and table statistics of many tables at once.

Everything exact rests on one table of value counts keyed by (table, column, value).
It is summed per task before its shuffle, so a value that fills a third of all cells
costs one row per task. All later statistics aggregate or rank-limit that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.session import materialize
from tablewise.operators.numbering import TABLE, explode_cells, number_rows, stride_sample

COLUMN = (*TABLE, "pos")


def value_counts(rows: DataFrame) -> DataFrame:
    """``(table, pos, value, n)`` with one row for the nulls of each column."""
    return explode_cells(rows, *TABLE).groupBy(*COLUMN, "value").agg(F.count(F.lit(1)).alias("n"))


def _profile_columns() -> list:
    filled = F.col("value").isNotNull()
    return [
        F.sum("n").alias("total_count"),
        F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.count_if(filled & (F.col("n") == 1)).alias("unique_value_count"),
    ]


_PROFILED = (*COLUMN, "total_count", "null_count", "distinct_count", "unique_value_count", "effective_distinct", "effective_filled")


def _effective_columns(real) -> list:
    return [
        F.count_if(real).alias("effective_distinct"),
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("effective_filled"),
    ]


def _ratios(base: DataFrame, *more: str) -> DataFrame:
    non_null = F.col("total_count") - F.col("null_count")
    ratio = lambda a, b: F.coalesce(F.bround(F.try_divide(a, b), 4), F.lit(0.0))
    return base.select(
        *COLUMN, "total_count", "null_count", non_null.alias("non_null_count"),
        ratio(F.col("null_count"), F.col("total_count")).alias("null_ratio"),
        "distinct_count", "unique_value_count",
        (non_null - F.col("unique_value_count")).alias("duplicate_cell_count"),
        ((non_null > 0) & (F.col("unique_value_count") == non_null)).alias("is_unique"),
        ratio(F.col("distinct_count"), non_null).alias("unique_ratio"), *more,
    )


def column_profiles(counts: DataFrame) -> DataFrame:
    """Null, distinct, unique and repeated counts with ratios, and the key flag."""
    return _ratios(counts.groupBy(*COLUMN).agg(*_profile_columns()))


def with_real(counts: DataFrame) -> DataFrame:
    """Value counts with ``real``, the value where it is no missing marker."""
    return counts.withColumn("real", F.when(~text.is_missing(F.col("value")), F.col("value")))


def effective_counts(counts: DataFrame) -> DataFrame:
    """Distinct and filled counts over all rows with missing markers left out."""
    return with_real(counts).groupBy(*COLUMN).agg(*_effective_columns(F.col("real").isNotNull()))


def column_facts(counts: DataFrame, more=()) -> DataFrame:
    """Profiles and marker-free counts in one pass over the value counts, with ``more`` aggregates of theirs."""
    base = with_real(counts).groupBy(*COLUMN).agg(
        *_profile_columns(), *_effective_columns(F.col("real").isNotNull()), *more)
    return _ratios(base, "effective_distinct", "effective_filled", *[c for c in base.columns if c not in _PROFILED])


def top_values(counts: DataFrame, n: int = V.TOP_VALUES) -> DataFrame:
    """Most frequent values per column, ties by value; the rank is cut per task first."""
    order = Window.partitionBy(*COLUMN).orderBy(F.col("n").desc(), "value")
    return (
        counts.filter(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        .select(*COLUMN, "rank", "value", F.col("n").alias("count"))
    )


def top_value_lists(counts: DataFrame, n: int = V.TOP_VALUES) -> DataFrame:
    ranked = top_values(counts, n).groupBy(*COLUMN).agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("t")
    )
    return ranked.select(*COLUMN, F.transform(
        "t", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))
    ).alias("top_values"))


def value_sets(counts: DataFrame, limit: int = V.ENUM_MAX_DISTINCT, facts: DataFrame | None = None) -> DataFrame:
    """Sorted marker-free values of columns holding at most ``limit`` of them.

    With ``facts (table, pos, effective_distinct)`` only the values of the columns named by them are looked
    at, and nothing is sorted across the others. Without, only the first ``limit + 1`` values of a column are
    ever gathered: one more than the limit is enough to know the column is too wide.
    """
    if facts is not None:
        # As one value, a table without a name still finds its columns.
        column = F.struct(*COLUMN).alias("_column")
        few = (F.col("effective_distinct") > 0) & (F.col("effective_distinct") <= limit)
        narrow = materialize(facts.filter(few).select(column), "narrow-columns")
        real = F.when(~text.is_missing(F.col("value")), F.col("value"))
        return counts.select(*COLUMN, "value", column).join(narrow, "_column").groupBy(*COLUMN).agg(
            F.sort_array(F.collect_list(real)).alias("values"))
    order = Window.partitionBy(*COLUMN).orderBy("value")
    return (
        counts.filter(~text.is_missing(F.col("value")))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit + 1)
        .groupBy(*COLUMN).agg(F.sort_array(F.collect_list("value")).alias("values"))
        .filter(F.size("values") <= limit)
    )


def presence(profiles: DataFrame) -> DataFrame:
    """Share of rows with a value and share of distinct among them, per column."""
    return profiles.select(
        *COLUMN,
        F.coalesce(F.try_divide("non_null_count", "total_count"), F.lit(0.0)).alias("present"),
        F.coalesce(F.try_divide("distinct_count", "non_null_count"), F.lit(0.0)).alias("distinct"),
    )


def row_digest(cells):
    """Null-safe digest of a row; only 64 characters per row are shuffled."""
    parts = F.transform(cells, lambda c: F.coalesce(
        F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~")
    ))
    return F.sha2(F.array_join(parts, ","), 256)


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """Rows and rows beyond the first copy, per table."""
    copies = rows.groupBy(*TABLE, row_digest(F.col("cells")).alias("d")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return copies.groupBy(*TABLE).agg(
        F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicate_row_count")
    )


def preview(rows: DataFrame, n: int = V.PREVIEW_ROWS, chars: int = V.PREVIEW_CHARS) -> DataFrame:
    """First rows of every table with long cells cut."""
    order = Window.partitionBy(*TABLE).orderBy("row_no")
    cut = lambda c: F.when(F.length(c) > chars, F.concat(F.left(c, F.lit(chars)), F.lit("…"))).otherwise(c)
    # Row numbers alone tell where a preview ends; cells are fetched for its rows only.
    firsts = rows.select(*TABLE, "row_no").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    ends = materialize(firsts.groupBy(*TABLE).agg(F.max("row_no").alias("_last")), "preview-ends")
    few = rows.join(ends, list(TABLE)).filter(F.col("row_no") <= F.col("_last"))
    return (
        few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        .select(*TABLE, (F.col("rank") - 1).alias("row_no"), F.transform("cells", cut).alias("cells"))
    )


def table_profiles(rows: DataFrame, size: int = V.SAMPLE_ROWS) -> DataFrame:
    """Row counts and sampling facts per table."""
    return duplicate_rows(rows).withColumn("sample_size_requested", F.lit(size)).withColumn(
        "sample_is_full", F.col("row_count") <= size
    )


__all__ = [
    "COLUMN", "column_facts", "column_profiles", "duplicate_rows", "effective_counts", "number_rows", "presence",
    "preview", "row_digest", "stride_sample", "table_profiles", "top_value_lists", "top_values",
    "value_counts", "value_sets", "with_real",
]
