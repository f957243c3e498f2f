"""Batches of creates, updates and deletes against the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators import changes
from tablewise.operators.query import Entity, Field
from tablewise.sources.records import conform
from tablewise.workloads import fixtures as fx
from tablewise.workloads.registry import query

ORDER = Entity("order", "order_id", (
    Field("order_id", "number", "identifier"), Field("order_status", "enum", "enum", values=("F", "O", "P")),
    Field("amount", "money", "measure"), Field("order_date", "date", "time")))
_TABLE = "t AS (SELECT CAST(o_orderkey AS DOUBLE) AS order_id, o_orderstatus AS order_status, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS order_date FROM orders)"


def table(spark, sf) -> DataFrame:
    return conform(fx.orders(spark, sf), ORDER)


def new_rows(spark, sf) -> DataFrame:
    """Every tenth order again, half of them far above the known keys, each key twice; some bad."""
    some = fx.orders(spark, sf).filter(F.col("order_id") % 10 == 0)
    key = F.when(F.col("order_id") % 20 == 0, F.col("order_id")).otherwise(F.col("order_id") + 10**9)
    status = F.when(F.col("order_id") % 50 == 30, "X").otherwise(F.col("order_status"))
    copies = F.explode(F.array(F.lit(1), F.lit(2)))
    return some.select(
        F.when(F.col("order_id") % 70 != 0, key).alias("order_id"), status.alias("order_status"), "amount", copies.alias("copy"),
        F.col("order_id").alias("k")).select(
        "order_id", "order_status", (F.col("amount") + F.col("copy")).alias("amount"), (F.col("k") * 2 + F.col("copy")).alias("change_no"))


_NEW = """c AS (SELECT CASE WHEN o_orderkey % 70 <> 0 THEN CAST(CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey ELSE o_orderkey + 1000000000 END AS DOUBLE) END AS order_id,
  CASE WHEN o_orderkey % 50 = 30 THEN 'X' ELSE o_orderstatus END AS order_status, o_totalprice + copy AS amount, copy FROM orders, (VALUES (1), (2)) v(copy) WHERE o_orderkey % 10 = 0)"""
_GOOD = "good AS (SELECT * FROM c WHERE order_id IS NOT NULL AND order_status <> 'X')"


@query("apply_creates", f"""WITH {_TABLE}, {_NEW}, {_GOOD} SELECT * FROM t UNION ALL
SELECT order_id, order_status, amount, NULL FROM good WHERE copy = 1 AND order_id NOT IN (SELECT order_id FROM t)""")
def apply_creates(spark, sf):
    return changes.create_rows(table(spark, sf), new_rows(spark, sf), ORDER)[0]


_KEY = "CAST(CAST(order_id AS BIGINT) AS VARCHAR)"


@query("create_rejects", f"""WITH {_TABLE}, {_NEW}, {_GOOD} SELECT {_KEY} AS key, 'key exists' AS cause, count(*) - CASE WHEN order_id IN (SELECT order_id FROM t) THEN 0 ELSE 1 END AS rows FROM good GROUP BY order_id
UNION ALL SELECT {_KEY}, concat_ws('; ', CASE WHEN order_status = 'X' THEN 'order_status: not a declared value' END, CASE WHEN order_id IS NULL THEN 'order_id: key is empty' END), count(*)
FROM c WHERE order_id IS NULL OR order_status = 'X' GROUP BY 1, 2""")
def create_rejects(spark, sf):
    return changes.create_rows(table(spark, sf), new_rows(spark, sf), ORDER)[1]


def changed_rows(spark, sf) -> DataFrame:
    """Every seventh order changed twice, the second time last; some absent, some with a moved key."""
    rows = fx.orders(spark, sf).filter(F.col("order_id") % 7 == 0)
    key = F.when(F.col("order_id") % 3 == 0, F.col("order_id") + 10**9).otherwise(F.col("order_id"))
    target = F.when(F.col("order_id") % 5 == 0, "1").otherwise(key.cast("string"))
    return rows.select(
        key.alias("order_id"), target.alias("target_key"), "order_status", "order_date", F.col("amount").alias("a"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("change_no"),
    ).withColumn("amount", F.col("a") * F.col("change_no")).drop("a")


_CHANGED = """c AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS k, o_orderkey % 5 = 0 AS moved, o_totalprice * 2 AS amount
  FROM orders WHERE o_orderkey % 7 = 0)"""


@query("apply_updates", f"""WITH {_TABLE}, {_CHANGED} SELECT order_id, order_status, coalesce(c.amount, t.amount) AS amount, order_date
FROM t LEFT JOIN c ON c.k = t.order_id AND NOT moved""")
def apply_updates(spark, sf):
    return changes.update_rows(table(spark, sf), changed_rows(spark, sf), ORDER)[0]


@query("update_rejects", f"""WITH {_TABLE}, {_CHANGED} SELECT CAST(k AS VARCHAR) AS key, 'key cannot change' AS cause, 2 AS rows FROM c WHERE moved
UNION ALL SELECT CAST(k AS VARCHAR), 'not found', 2 FROM c WHERE NOT moved AND k NOT IN (SELECT order_id FROM t)""")
def update_rejects(spark, sf):
    return changes.update_rows(table(spark, sf), changed_rows(spark, sf), ORDER)[1]


def deleted_keys(spark, sf) -> DataFrame:
    return fx.orders(spark, sf).filter(F.col("order_id") % 9 == 0).select(
        F.when(F.col("order_id") % 4 == 0, F.col("order_id") + 10**9).otherwise(F.col("order_id")).cast("string").alias("key"))


@query("apply_deletes", f"WITH {_TABLE} SELECT * FROM t WHERE NOT (order_id % 9 = 0 AND order_id % 4 <> 0)")
def apply_deletes(spark, sf):
    return changes.delete_rows(table(spark, sf), deleted_keys(spark, sf), ORDER)[0]


@query("delete_rejects", "SELECT CAST(o_orderkey + 1000000000 AS VARCHAR) AS key, 'not found' AS cause, 1 AS rows FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 4 = 0")
def delete_rejects(spark, sf):
    return changes.delete_rows(table(spark, sf), deleted_keys(spark, sf), ORDER)[1]


@query("conform_rows", "SELECT CAST(o_orderkey AS DOUBLE) AS order_id, NULL AS courier, CAST(o_totalprice AS DOUBLE) AS amount FROM orders")
def conform_rows(spark, sf):
    newer = Entity("order", "order_id", (Field("order_id", "number"), Field("courier", "string"), Field("amount", "money")))
    return conform(fx.orders(spark, sf), newer)
