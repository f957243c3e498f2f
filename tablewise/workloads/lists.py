"""List queries, facets, related rows, metrics, recent rows, trends, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.operators import query as q
from tablewise.workloads import fixtures as fx
from tablewise.workloads.registry import query

PAGE = q.ListQuery(
    search="5-low  F", search_keys=("priority_level", "order_status"),
    filters={"order_status": ["F", "O"]}, sorts=(("order_date", "desc"), ("amount", "asc")), page=3)


@query("list_page", f"""WITH {fx.ORDERS_SQL}, hits AS (
  SELECT * FROM orders_t WHERE (contains(lower(priority_level), '5-low') OR contains(lower(order_status), '5-low'))
    AND (contains(lower(priority_level), 'f') OR contains(lower(order_status), 'f'))
    AND order_status IN ('F', 'O'))
SELECT * FROM hits ORDER BY order_date DESC, amount, order_id LIMIT 10 OFFSET 20""")
def list_page(spark, sf):
    return q.run_list_query(fx.orders(spark, sf), PAGE, "order_id").rows


@query("list_last_page", f"""WITH {fx.ORDERS_SQL}, n AS (SELECT count(*) AS n FROM orders_t)
SELECT order_id, amount FROM orders_t ORDER BY amount, order_id
LIMIT 7 OFFSET (SELECT ((n - 1) // 7) * 7 FROM n)""")
def list_last_page(spark, sf):
    # A page far beyond the end is clamped to the last one.
    asked = q.ListQuery(sorts=(("amount", "asc"),), page=10**9, page_size=7)
    return q.run_list_query(fx.orders(spark, sf), asked, "order_id", ["order_id", "amount"]).rows


@query("list_deep_page", f"""WITH {fx.ORDERS_SQL}
SELECT order_id, order_date FROM orders_t ORDER BY order_date DESC, order_id
LIMIT 50 OFFSET (SELECT count(*) // 2 FROM orders)""")
def list_deep_page(spark, sf):
    df = fx.orders(spark, sf).select("order_id", "order_date")
    order = q.sort_columns(df, [("order_date", "desc")], "order_id")
    return q.page_rows(df, order, df.count() // 2, 50, deep=1000)


@query("list_totals", f"""WITH {fx.ORDERS_SQL}
SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 10.0)) AS BIGINT) AS page_count
FROM orders_t WHERE contains(lower(CAST(order_id AS VARCHAR)), '12') AND contains(lower(CAST(order_id AS VARCHAR)), '3')""")
def list_totals(spark, sf):
    asked = q.ListQuery(search="12 3", search_keys=("order_id",))
    df = q.search_rows(fx.orders(spark, sf), asked.search, asked.search_keys)
    pages = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(asked.page_size)))
    return df.agg(F.count(F.lit(1)).alias("total"), pages.cast("bigint").alias("page_count"))


@query("list_search", """SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment_type FROM customer
WHERE (contains(lower(c_name), '0011') OR contains(lower(c_mktsegment), '0011'))
  AND (contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build'))""")
def list_search(spark, sf):
    df = fx.customers(spark, sf).select("customer_id", "customer_name", "segment_type")
    return q.search_rows(df, "0011 BUILD", ["customer_name", "segment_type"])


_NOTES = f"SELECT o_orderkey AS order_id, o_orderstatus AS order_status, {fx.NOTE_TEXT} AS note FROM orders"


@query("list_filter_empty", f"SELECT * FROM ({_NOTES}) WHERE coalesce(nullif(note, ''), '__empty__') IN ('__empty__', '-') AND order_status IN ('P')")
def list_filter_empty(spark, sf):
    df = fx.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("order_status"), F.expr(fx.NOTE_TEXT).alias("note"))
    return q.filter_rows(df, {"note": ["__empty__", "-"], "order_status": ["P"], "order_id": []})


@query("list_sort_blanks_last", f"SELECT order_id, note FROM (SELECT * FROM ({_NOTES}) ORDER BY note DESC NULLS LAST, order_id) LIMIT 25 OFFSET (SELECT count(*) FILTER (note IS NOT NULL) - 10 FROM ({_NOTES}))")
def list_sort_blanks_last(spark, sf):
    # The page straddles the border between the last filled rows and the blanks.
    df = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.expr(fx.NOTE_TEXT).alias("note"))
    order = q.sort_columns(df, [("note", "desc")], "order_id", locale=None)
    filled = df.filter(F.col("note").isNotNull()).count()
    return q.page_rows(df, order, filled - 10, 25)


@query("facet_counts", f"""SELECT coalesce(nullif(note, ''), '__empty__') AS value,
  coalesce(nullif(note, ''), '（空）') AS label, count(*) AS count FROM ({_NOTES}) GROUP BY 1, 2""")
def facet_counts(spark, sf):
    df = fx.read(spark, sf, "orders").select(F.expr(fx.NOTE_TEXT).alias("note"))
    return q.facet_counts(df, "note")


@query("facet_numbers", "SELECT CAST(p_size AS VARCHAR) AS value, CAST(p_size AS VARCHAR) AS label, count(*) AS count FROM part GROUP BY p_size")
def facet_numbers(spark, sf):
    return q.facet_counts(fx.products(spark, sf), "size")


@query("detail_lookup", f"WITH {fx.ORDERS_SQL} SELECT * FROM orders_t WHERE CAST(order_id AS VARCHAR) = '1234'")
def detail_lookup(spark, sf):
    return q.lookup(fx.orders(spark, sf), "order_id", "1234")


@query("related_all", f"""WITH {fx.ORDERS_SQL}, {fx.CUSTOMERS_SQL}
SELECT o.order_id, c.customer_name, o.amount FROM orders_t o JOIN customers_t c USING (customer_id)""")
def related_all(spark, sf):
    joined = q.related_rows(
        fx.customers(spark, sf), fx.orders(spark, sf).select("order_id", "customer_id", "amount"),
        "customer_id", "customer_id", ["customer_name"])
    return joined.select("order_id", "customer_name", "amount")


@query("related_of_one", f"""WITH {fx.ORDERS_SQL}
SELECT order_id, order_date, amount FROM orders_t WHERE customer_id = 42 ORDER BY order_date DESC, order_id""")
def related_of_one(spark, sf):
    one = q.lookup(fx.customers(spark, sf), "customer_id", "42")
    own, other, _ = q.relation_sides("customer", {
        "from": "customer", "to": "order", "on_from": "customer_id", "on_to": "customer_id"})
    rows = q.related_of(one, fx.orders(spark, sf), own, other, [("order_date", "desc")], "order_id")
    return rows.select("order_id", "order_date", "amount")


@query("related_parent", f"""WITH {fx.ORDERS_SQL}, {fx.CUSTOMERS_SQL}
SELECT customer_name FROM customers_t WHERE customer_id = (SELECT customer_id FROM orders_t WHERE order_id = 77)""")
def related_parent(spark, sf):
    # The same link seen from its other side.
    own, other, _ = q.relation_sides("order", {
        "from": "customer", "to": "order", "on_from": "customer_id", "on_to": "customer_id"})
    one = q.lookup(fx.orders(spark, sf), "order_id", "77")
    return q.related_of(one, fx.customers(spark, sf), own, other).select("customer_name")


@query("related_top5", f"""WITH {fx.ORDERS_SQL}, r AS (SELECT customer_id, order_id, amount,
  row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id) AS rank,
  count(*) OVER (PARTITION BY customer_id) AS total FROM orders_t)
SELECT * FROM r WHERE rank <= 5 AND customer_id IN (SELECT c_custkey FROM customer)""")
def related_top5(spark, sf):
    top = q.related_top(
        fx.customers(spark, sf), fx.orders(spark, sf), "customer_id", "customer_id",
        [("order_date", "desc")], "order_id")
    return top.select("customer_id", "order_id", "amount", "rank", "total")


METRICS = (
    q.Metric("order_count", "count"), q.Metric("total_amount", "sum", "amount"), q.Metric("avg_amount", "avg", "amount"),
    q.Metric("min_amount", "min", "amount"), q.Metric("max_amount", "max", "amount"), q.Metric("no_number", "sum", "order_status"))


@query("metric_all_ops", """SELECT unnest(['order_count', 'total_amount', 'avg_amount', 'min_amount', 'max_amount', 'no_number']) AS metric,
  unnest([count(*)::DOUBLE, round(sum(o_totalprice), 2), round(avg(o_totalprice), 4), min(o_totalprice), max(o_totalprice), 0.0]) AS value FROM orders""")
def metric_all_ops(spark, sf):
    values = q.metric_values(fx.orders(spark, sf), METRICS)
    places = F.when(F.col("metric") == "avg_amount", F.round("value", 4)).otherwise(F.round("value", 2))
    return values.select("metric", places.alias("value"))


@query("recent_rows", f"WITH {fx.ORDERS_SQL} SELECT order_id, order_date, amount FROM orders_t ORDER BY order_date DESC, order_id LIMIT 5")
def recent_rows(spark, sf):
    entity, rows = q.recent_rows(fx.ENTITIES, fx.tables(spark, sf))
    return rows.select(entity.key_field, "order_date", "amount")


@query("trend_month", f"""WITH {fx.ORDERS_SQL}, m AS (SELECT strftime(order_date, '%Y-%m') AS label,
  round(sum(CASE WHEN order_id % 5 = 0 THEN 1.0 ELSE amount END), 2) AS value FROM orders_t GROUP BY 1)
SELECT * FROM m ORDER BY label DESC LIMIT 6""")
def trend_month(spark, sf):
    # Every fifth amount is taken out: such a row counts 1.
    tables = fx.tables(spark, sf)
    amount = F.when(F.col("order_id") % 5 != 0, F.col("amount"))
    tables["order"] = tables["order"].withColumn("amount", amount)
    _, points = q.trend(fx.ENTITIES, tables)
    return points.select("label", F.round("value", 2).alias("value"))


@query("trend_skip_nulls", f"""WITH {fx.ORDERS_SQL}, m AS (SELECT strftime(order_date, '%Y-%m') AS label,
  round(sum(CASE WHEN order_id % 5 = 0 THEN 0.0 ELSE amount END), 2) AS value FROM orders_t GROUP BY 1)
SELECT * FROM m ORDER BY label DESC LIMIT 6""")
def trend_skip_nulls(spark, sf):
    amount = F.when(F.col("order_id") % 5 != 0, F.col("amount"))
    df = fx.orders(spark, sf).withColumn("amount", amount)
    points = q.month_trend(df, "order_date", "amount", null_measure="skip")
    return points.select("label", F.round("value", 2).alias("value"))


@query("distribution_top6", """WITH c AS (
  SELECT 'customer' AS entity, 0 AS pos, 'segment_type' AS field, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 4
  UNION ALL SELECT 'order', 1, 'order_status', o_orderstatus, count(*) FROM orders GROUP BY 4
  UNION ALL SELECT 'order', 2, 'priority_level', o_orderpriority, count(*) FROM orders GROUP BY 4
  UNION ALL SELECT 'product', 3, 'product_type', p_type, count(*) FROM part GROUP BY 4
  UNION ALL SELECT 'event', 4, 'event_type', event_type, count(*) FROM events GROUP BY 4),
b AS (SELECT pos, sum(n) AS total FROM c WHERE label <> '' GROUP BY pos HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT entity, field, label, n AS count, CAST(total AS BIGINT) AS total,
  row_number() OVER (ORDER BY n DESC, label) AS rank FROM c JOIN b USING (pos) QUALIFY rank <= 6""")
def distribution_top6(spark, sf):
    return q.distribution(fx.ENTITIES, fx.tables(spark, sf))
