"""Typed rows of an app as Parquet, one folder per entity."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.operators.query import Entity

SPARK_TYPES = {
    "string": "string", "phone": "string", "enum": "string",
    "number": "double", "money": "double", "date": "date",
}

#: A stored load has one column for each key and kind of value.
STORED = {"string": "text", "phone": "text", "enum": "text", "number": "number", "money": "number", "date": "date"}


def entity_schema(entity: Entity) -> str:
    return ", ".join(f"`{f.key}` {SPARK_TYPES[f.type]}" for f in entity.fields)


def records_path(root: str, app: str, entity: str, version: int | None = None) -> str:
    part = "" if version is None else f"/version={version}"
    return f"{root.rstrip('/')}/app={app}{part}/entity={entity}"


def write_records(df: DataFrame, root: str, app: str, entity: str, version: int | None = None) -> str:
    """Replace the stored rows of one entity."""
    path = records_path(root, app, entity, version)
    df.write.mode("overwrite").parquet(path)
    return path


def read_records(
    spark: SparkSession, root: str, app: str, entity: Entity, version: int | None = None
) -> DataFrame:
    """Stored rows under the catalog's schema; an entity without rows is an empty table."""
    schema = entity_schema(entity)
    try:
        return spark.read.schema(schema).parquet(records_path(root, app, entity.key, version))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def load_path(root: str, app: str, load: str) -> str:
    return f"{root.rstrip('/')}/app={app}/load={load}"


def read_load(spark: SparkSession, root: str, app: str, entity: Entity, load: str) -> DataFrame:
    """Good rows of one entity of a load; only its own columns are read."""
    names = [(f.key, f"{f.key}__{STORED[f.type]}", SPARK_TYPES[f.type]) for f in entity.fields]
    schema = ", ".join(f"`{stored}` {kind}" for _, stored, kind in names)
    try:
        rows = spark.read.schema(schema).parquet(f"{load_path(root, app, load)}/entity={entity.key}/state=good")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.select(*[F.col(f"`{stored}`").alias(key) for key, stored, _ in names])


def conform(df: DataFrame, entity: Entity) -> DataFrame:
    """Rows under a catalog version: known fields kept, missing ones null, the rest dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.key) if f.key in have else F.lit(None)).cast(SPARK_TYPES[f.type]).alias(f.key)
        for f in entity.fields
    ])
