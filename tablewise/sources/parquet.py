"""Parquet tables with the row numbers of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SPREAD_BYTES = 1 << 20


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Share out a scan that has too few splits to keep the cores busy.

    A Parquet row group is read by one task, so a table of one or two large row groups would
    leave all later per-cell work to one or two tasks. A scan with enough splits, or of little
    data, stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SPREAD_BYTES or scan.rdd.getNumPartitions() * 2 > cores:
        return scan
    return scan.repartition(cores, *keys)


def indexed_parquet(df: DataFrame) -> DataFrame:
    """A freshly read Parquet table with ``row_no``, 0, 1, 2 ... in file order, files in name order.

    The number comes from the position inside the file plus the rows of earlier files, so
    no row is sorted or shuffled; only one count per file is. The counts are broadcast: joined by
    a shuffle, all rows of a file would meet in one task.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return spread(placed, "_row").join(F.broadcast(starts), "_file").select(
        *df.columns, (F.col("_start") + F.col("_row")).alias("row_no"))
