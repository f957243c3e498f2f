"""Batches of row changes against a typed table: create, update, delete.

Keys compare as text. Changes may carry ``change_no``, their order in the batch, and
updates ``target_key``, the key of the row they are meant for. Every function gives the
new table and a rejects table ``(key, cause, rows)``; the old table is never modified.

The batch is reduced to one row per key and stored first: its size is then known, and a small
batch is broadcast to the table instead of the table being shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.operators.load import validate
from tablewise.operators.query import Entity
from tablewise.session import materialize
from tablewise.sources.records import SPARK_TYPES, conform

CONTROL = ("change_no", "target_key")


def _rejects(df: DataFrame, cause: Column) -> DataFrame:
    return df.select(F.col("_k").alias("key"), cause.alias("cause")).groupBy("key", "cause").agg(
        F.count(F.lit(1)).alias("rows"))


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_k", text.as_text(df, key) if key in df.columns else F.lit(None).cast("string"))


def check_rows(changes: DataFrame, entity: Entity) -> tuple[DataFrame, DataFrame]:
    """Sound rows as ``(_k, _row, control columns)`` and the rejects.

    A row must have its key, only known fields, and values of the declared types; fields it
    leaves out become null.
    """
    control = tuple(c for c in CONTROL if c in changes.columns)
    checked = _keyed(validate(changes, entity, control), entity.key_field)
    causes = F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["cause"]))
    bad = _rejects(checked.filter(F.size("errors") > 0), F.array_join(causes, "; "))
    sound = checked.filter(F.size("errors") == 0)
    have = set(changes.columns)
    row = F.struct(*[
        (F.col(f.key) if f.key in have else F.lit(None)).cast(SPARK_TYPES[f.type]).alias(f.key)
        for f in entity.fields
    ])
    return sound.select("_k", row.alias("_row"), *control), bad


def _order(df: DataFrame) -> Column:
    """Batch order; without one the row itself decides, so task order never does."""
    return F.struct("change_no", "_row") if "change_no" in df.columns else F.struct("_row")


def _hits(keyed: DataFrame, batch: DataFrame) -> DataFrame:
    """Keys of the batch that the table owns, found when they are read: who asks for the table alone pays no
    scan for the rejects.

    The batch stands on the side that can be broadcast: while it is small the table is scanned once
    and not shuffled, and what comes out is no larger than the batch.
    """
    return keyed.select("_k").join(batch.select("_k"), "_k", "left_semi").distinct()


def create_rows(table: DataFrame, new: DataFrame, entity: Entity) -> tuple[DataFrame, DataFrame]:
    """Append rows with a free key; a taken key, in the table or the batch, is a conflict."""
    sound, bad = check_rows(new, entity)
    first = materialize(sound.groupBy("_k").agg(
        F.min_by("_row", _order(sound)).alias("_row"), F.count(F.lit(1)).alias("n")), "creates")
    hits = _hits(_keyed(table, entity.key_field), first)
    fresh = first.join(hits, "_k", "left_anti")
    taken = first.join(hits, "_k", "left_semi")
    conflict = F.lit("key exists").alias("cause")
    rejects = (
        bad.unionAll(taken.select("_k", conflict, "n"))
        .unionAll(fresh.filter(F.col("n") > 1).select("_k", conflict, F.col("n") - 1))
    )
    return conform(table, entity).unionByName(fresh.select("_row.*")), rejects


def update_rows(table: DataFrame, changed: DataFrame, entity: Entity) -> tuple[DataFrame, DataFrame]:
    """Replace whole rows by key, the last change of a key winning; absent keys are rejected."""
    sound, bad = check_rows(changed, entity)
    rejects = bad
    if "target_key" in sound.columns:
        other = F.col("_k") != F.col("target_key")
        rejects = rejects.unionAll(_rejects(sound.filter(other), F.lit("key cannot change")))
        sound = sound.filter(~other)
    last = materialize(sound.groupBy("_k").agg(
        F.max_by("_row", _order(sound)).alias("_row"), F.count(F.lit(1)).alias("n")), "updates")
    current = _keyed(conform(table, entity), entity.key_field)
    names = [f.key for f in entity.fields]
    merged = current.join(last, "_k", "left").select(*[
        F.when(F.col("_row").isNotNull(), F.col(f"_row.{n}")).otherwise(F.col(n)).alias(n) for n in names
    ])
    absent = last.join(_hits(current, last), "_k", "left_anti")
    return merged, rejects.unionAll(absent.select("_k", F.lit("not found").alias("cause"), "n"))


def delete_rows(table: DataFrame, keys: DataFrame, entity: Entity) -> tuple[DataFrame, DataFrame]:
    """Remove rows by key (``keys`` has a ``key`` column); absent keys are rejected."""
    wanted = materialize(keys.select(text.as_text(keys, "key").alias("_k")).groupBy("_k").agg(
        F.count(F.lit(1)).alias("n")), "deletes")
    current = _keyed(table, entity.key_field)
    left = current.join(wanted, "_k", "left_anti").drop("_k")
    owned = _hits(current, wanted)
    absent = wanted.join(owned, "_k", "left_anti").select(
        F.col("_k").alias("key"), F.lit("not found").alias("cause"), F.col("n").alias("rows"))
    again = wanted.filter(F.col("n") > 1).join(owned, "_k", "left_semi").select(
        F.col("_k").alias("key"), F.lit("not found").alias("cause"), (F.col("n") - 1).alias("rows"))
    return left, absent.unionAll(again)
