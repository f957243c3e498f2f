"""The catalog built from the inferred corpus, and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions import vocab as V
from tablewise.operators import catalog, infer
from tablewise.plans.understand import understand
from tablewise.workloads import fixtures as fx
from tablewise.workloads.inference import ENTITIES, inferred
from tablewise.workloads.linking import TAIL
from tablewise.workloads.registry import query

CATALOG = f"""{ENTITIES}, keys AS (SELECT sheet, key_pos AS pos FROM entities WHERE kind <> 'unknown' AND key_field IS NOT NULL),
{TAIL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {fx.POSITION_SQL}) AS nth FROM entities SEMI JOIN keys USING (sheet)),
plans AS (SELECT *, kind || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS entity FROM numbered),
fk AS (SELECT child AS sheet, pos, bool_or(same) AS same_name FROM final GROUP BY ALL),
fields AS (SELECT r.sheet, r.pos, r.col, entity, 'field_' || (r.pos + 1) AS field_key, r.type, r.role,
  CASE WHEN fk.sheet IS NOT NULL THEN 0.63 ELSE least(r.confidence, r.role_confidence) END AS confidence, r.labels, r.pos = p.key_pos AS is_key,
  fk.sheet IS NOT NULL AS linked FROM roled r JOIN plans p USING (sheet) LEFT JOIN fk ON fk.sheet = r.sheet AND fk.pos = r.pos),
metrics AS (SELECT entity || '_count' AS key, entity, 'count' AS op, '' AS field, 0.9::DOUBLE AS confidence FROM plans
  UNION ALL SELECT CASE WHEN row_number() OVER (PARTITION BY field_key ORDER BY {fx.POSITION_SQL}, pos) > 1 THEN entity || '_' ELSE '' END || 'total_' || field_key,
    entity, 'sum', field_key, 0.8::DOUBLE FROM fields WHERE type = 'money' AND role = 'measure' AND NOT {fx.sql_word('col', V.PRICE_NAMES)})"""


def corpus(spark, sf):
    return understand(fx.corpus_rows(spark, sf), fx.corpus_columns(spark, sf), positions=fx.corpus_positions(spark), dense=True)


@query("catalog_plans", f"WITH {CATALOG} SELECT sheet, entity, key_field, 'field_' || (key_pos + 1) AS key_field_key FROM plans")
def catalog_plans(spark, sf):
    fields, _, columns = inferred(spark, sf)
    plans = catalog.build_plans(infer.infer_entities(fields), fx.corpus_positions(spark))
    keys = catalog.field_keys(columns).select("source_file", "sheet", F.col("pos").alias("key_pos"), F.col("field_key").alias("key_field_key"))
    return plans.join(keys, ["source_file", "sheet", "key_pos"]).select("sheet", "entity", "key_field", "key_field_key")


@query("catalog_exclusions", f"""WITH {ENTITIES} SELECT sheet, CASE WHEN kind = 'unknown' THEN 'unknown kind' ELSE 'no key column' END AS reason
FROM entities WHERE kind = 'unknown' OR key_field IS NULL""")
def catalog_exclusions(spark, sf):
    fields, _, _ = inferred(spark, sf)
    return catalog.exclusions(infer.infer_entities(fields)).select("sheet", "reason")


@query("catalog_fields", f"""WITH {CATALOG} SELECT entity, field_key, col AS column, type, role, round(confidence, 6) AS confidence,
  linked OR confidence < 0.85 AS needs_review, linked, coalesce(CASE WHEN type = 'enum' THEN array_to_string(labels, '|') END, '') AS labels, is_key FROM fields""")
def catalog_fields(spark, sf):
    fields = corpus(spark, sf).catalog()["fields"]
    return fields.select("entity", "field_key", "column", "type", "role", F.round("confidence", 6).alias("confidence"), "needs_review",
                         F.col("review_reason").isNotNull().alias("linked"), F.coalesce(F.array_join("values", "|"), F.lit("")).alias("labels"), "is_key")


@query("catalog_links", f"""WITH {CATALOG} SELECT a.entity || '_to_' || b.entity AS key, a.entity AS from_entity, b.entity AS to_entity,
  'field_' || (ppos + 1) AS on_from, 'field_' || (f.pos + 1) AS on_to, capped::DOUBLE AS confidence FROM final f JOIN plans a ON a.sheet = parent JOIN plans b ON b.sheet = child""")
def catalog_links(spark, sf):
    found = corpus(spark, sf).catalog()["links"]
    return found.select("key", "from_entity", "to_entity", "on_from", "on_to", "confidence")


@query("catalog_metrics", f"WITH {CATALOG} SELECT *, confidence < 0.85 AS needs_review FROM metrics")
def catalog_metrics(spark, sf):
    found = corpus(spark, sf).catalog()["metrics"]
    return found.select("key", "entity", "op", F.coalesce("field", F.lit("")).alias("field"), "confidence", "needs_review")


_RANK = ("CASE WHEN is_key THEN -1 WHEN type = 'phone' THEN 4 WHEN role = 'time' THEN 0 WHEN role = 'measure' THEN 1 "
         "WHEN role = 'dimension' THEN 2 WHEN role = 'enum' THEN 3 WHEN role = 'identifier' THEN 4 ELSE 5 END")


@query("default_queries", f"""WITH {CATALOG} SELECT entity, array_to_string(list(field_key ORDER BY {_RANK}, pos)[1:6], '|') AS columns,
  array_to_string(list_concat(list(field_key) FILTER (is_key), coalesce(list(field_key ORDER BY pos) FILTER (type = 'phone'), [])), '|') AS search,
  coalesce(array_to_string((list(field_key ORDER BY pos) FILTER (NOT is_key AND (type = 'enum' OR role = 'dimension')))[1:4], '|'), '') AS filters,
  coalesce(first(field_key ORDER BY pos) FILTER (role = 'time'), '') AS sort_field FROM fields GROUP BY entity""")
def default_queries(spark, sf):
    found = corpus(spark, sf).catalog()["queries"]
    join = lambda c: F.array_join(c, "|").alias(c)
    return found.select("entity", join("columns"), join("search"), join("filters"), F.coalesce("sort_field", F.lit("")).alias("sort_field"))


@query("review_queue", f"""WITH {CATALOG}, open AS (SELECT 'entity:' || entity AS item, entity AS id FROM plans WHERE confidence < 0.85
  UNION ALL SELECT 'field:' || entity || '.' || field_key, entity || '.' || field_key FROM fields WHERE linked OR confidence < 0.85
  UNION ALL SELECT 'metric:' || key, 'metric:' || key FROM metrics WHERE confidence < 0.85)
SELECT item FROM open WHERE NOT (id LIKE '%.field_2' OR id LIKE 'metric:order%')
UNION ALL SELECT 'relation:' || a.entity || '_to_' || b.entity FROM final JOIN plans a ON a.sheet = parent JOIN plans b ON b.sheet = child WHERE parent <> 'nation'""")
def review_queue(spark, sf):
    cat = corpus(spark, sf).catalog()
    names = cat["fields"].select("source_file", F.concat_ws(".", "entity", "field_key").alias("id")).unionByName(
        cat["metrics"].select("source_file", F.concat(F.lit("metric:"), "key").alias("id")))
    acknowledged = names.filter(F.col("id").endswith(".field_2") | F.col("id").startswith("metric:order"))
    decided = cat["links"].filter(F.col("parent") == "nation").select("source_file", "key")
    return catalog.review_queue(
        cat["entities"], cat["fields"], cat["metrics"], cat["links"], acknowledged, decided).select("item")


# --- names -------------------------------------------------------------------

_NAMES = ("客户名称", "客户", " 金额 ", "总金额", "ID", "unheard of", "备注", "日期", "订单金额", "客户名", "数量", "电话", "手机", "区域")
_GLOSS = ("customer_name", "customer_name", "amount", "amount", "id", None, "remark", "date", "amount", "customer_name", "quantity", "phone", "phone", "region")


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query("field_keys", f"""WITH c AS (SELECT 's' || o_orderkey AS sheet, i AS pos, {_list(_NAMES)}[(o_orderkey * 5 + i * (1 + o_orderkey % 3)) % 14 + 1] AS name,
  {_list(_GLOSS)}[(o_orderkey * 5 + i * (1 + o_orderkey % 3)) % 14 + 1] AS known FROM orders, range(0, 8) t(i)),
n AS (SELECT *, coalesce(known, 'field_' || (pos + 1)) AS base FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY sheet, base ORDER BY pos) AS nth FROM n)
SELECT sheet, pos, base || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS field_key, known IS NOT NULL AND nth = 1 AS glossary_hit FROM r""")
def field_keys(spark, sf):
    names = "array(" + _list(_NAMES)[1:-1] + ")"
    columns = fx.read(spark, sf, "orders").select(
        F.lit("b").alias("source_file"), F.expr("concat('s', o_orderkey)").alias("sheet"), F.posexplode(F.expr(
            f"transform(sequence(0, 7), i -> element_at({names}, cast((o_orderkey * 5 + i * (1 + o_orderkey % 3)) % 14 + 1 as int)))")).alias("pos", "column"))
    return catalog.field_keys(columns).select("sheet", "pos", "field_key", "glossary_hit")


# --- definitions -------------------------------------------------------------

_DEFINITION = ("case o_orderkey % 5 when 0 then concat('orders of day ', cast(o_orderkey as {s})) when 1 then 'count of DISTINCT customers' "
               "when 2 then '  ' when 3 then '订单总数，不做去重' else repeat('long ', 40) end")


@query("metric_definitions", f"""WITH h AS (SELECT o_orderkey AS position, 'b' || (o_orderkey // 40) AS source_file, CASE WHEN o_orderkey % 2 = 0 THEN 'count' ELSE 'sum' END AS op,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE CASE WHEN o_orderkey % 6 = 1 THEN 'nothing' ELSE 'amount' END END AS col,
  trim({_DEFINITION.format(s='varchar')}) AS d FROM orders WHERE o_orderkey % 8 <> 7),
u AS (SELECT *, CASE WHEN length(d) > 120 THEN left(d, 120) || '…' ELSE d END AS definition FROM h
  WHERE d <> '' AND NOT regexp_matches(d, '(?i)distinct') AND col <> 'nothing')
SELECT source_file, op, CASE WHEN op = 'sum' THEN 'field_1' ELSE '' END AS field, first(definition ORDER BY position) AS definition FROM u GROUP BY 1, 2, 3""")
def metric_definitions(spark, sf):
    o = fx.read(spark, sf, "orders")
    book = F.expr("concat('b', o_orderkey div 40)").alias("source_file")
    hints = o.select(
        book, F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderkey") % 8 == 7, "elsewhere").otherwise(" sales ").alias("sheet"),
        F.when(F.col("o_orderkey") % 2 == 0, "COUNT").otherwise("sum").alias("op"),
        F.when(F.col("o_orderkey") % 6 == 1, "nothing").otherwise("amount").alias("field"),
        F.expr(_DEFINITION.format(s="string")).alias("definition"), F.lit(0.8).alias("confidence"))
    books = o.select(book).distinct().withColumn("sheet", F.lit("sales"))
    plans = books.withColumn("entity", F.lit("order"))
    keys = books.select("source_file", "sheet", F.lit("amount").alias("column"), F.lit("field_1").alias("field_key"))
    return catalog.metric_definitions(hints, plans, keys).select("source_file", "op", "field", "definition")


# --- broken catalogs ---------------------------------------------------------

_B = "concat('b', cast(o_orderkey {div} 60 as {s}))"
_E = "concat('e', cast(o_orderkey % 7 as {s}))"
_PARTS = {
    "ents": "SELECT DISTINCT {B} AS source_file, case when o_orderkey % 7 = 5 then concat('E', cast(o_orderkey % 7 as {s})) else {E} end AS entity, concat('f', cast(o_orderkey % 9 as {s})) AS key_field FROM orders WHERE o_orderkey % 60 < 12",
    "flds": "SELECT {B} AS source_file, {E} AS entity, case when o_orderkey % 60 = 33 then '9f' else concat('f', cast(o_orderkey % 60 {div} 7 as {s})) end AS field_key, case when o_orderkey % 4 = 0 then 'enum' else 'string' end AS type, o_orderkey % 8 = 0 OR o_orderkey % 59 = 1 AS valued FROM orders",
    "lnks": "SELECT {B} AS source_file, concat(case when o_orderkey % 15 = 0 then 'Bad' else 'l' end, cast(o_orderkey % 13 as {s})) AS key, {E} AS from_entity, concat('e', cast(o_orderkey % 11 as {s})) AS to_entity, 'f3' AS on_from, concat('f', cast(o_orderkey % 12 as {s})) AS on_to FROM orders WHERE o_orderkey % 5 = 0",
    "mets": "SELECT {B} AS source_file, concat('m', cast(o_orderkey % 17 as {s})) AS key, concat('e', cast(o_orderkey % 8 as {s})) AS entity, case when o_orderkey % 6 = 0 then 'count' else 'sum' end AS op, case when o_orderkey % 9 = 0 then null else concat('f', cast(o_orderkey % 10 as {s})) end AS field FROM orders WHERE o_orderkey % 4 = 1",
}


def _part(name: str, spark: bool) -> str:
    s, div = ("string", "div") if spark else ("varchar", "//")
    return _PARTS[name].format(B=_B.format(s=s, div=div), E=_E.format(s=s), s=s, div=div)


_CHECKS = """SELECT source_file, entity AS item, 'duplicate entity key' AS error FROM ents GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT source_file, entity || '.' || field_key, 'duplicate field key' FROM flds GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT source_file, key, 'duplicate link key' FROM lnks GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT source_file, key, 'duplicate metric key' FROM mets GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT source_file, entity, 'bad entity key' FROM ents WHERE NOT regexp_matches(entity, '^[a-z][a-z0-9_]*$')
UNION ALL SELECT source_file, entity || '.' || field_key, 'bad field key' FROM flds WHERE NOT regexp_matches(field_key, '^[a-z][a-z0-9_]*$')
UNION ALL SELECT source_file, key, 'bad link key' FROM lnks WHERE NOT regexp_matches(key, '^[a-z][a-z0-9_]*$')
UNION ALL SELECT source_file, entity, 'key field is not a field' FROM ents e WHERE NOT EXISTS (SELECT 1 FROM flds f WHERE f.source_file = e.source_file AND f.entity = e.entity AND f.field_key = e.key_field)
UNION ALL SELECT source_file, entity || '.' || field_key, 'enum without values' FROM flds WHERE type = 'enum' AND NOT valued
UNION ALL SELECT source_file, entity || '.' || field_key, 'values without enum' FROM flds WHERE type <> 'enum' AND valued
UNION ALL SELECT source_file, key, 'link from unknown entity' FROM lnks l WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.source_file = l.source_file AND e.entity = l.from_entity)
UNION ALL SELECT source_file, key, 'link to unknown entity' FROM lnks l WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.source_file = l.source_file AND e.entity = l.to_entity)
UNION ALL SELECT source_file, key, 'link from unknown field' FROM lnks l WHERE EXISTS (SELECT 1 FROM ents e WHERE e.source_file = l.source_file AND e.entity = l.from_entity)
  AND NOT EXISTS (SELECT 1 FROM flds f WHERE f.source_file = l.source_file AND f.entity = l.from_entity AND f.field_key = l.on_from)
UNION ALL SELECT source_file, key, 'link to unknown field' FROM lnks l WHERE EXISTS (SELECT 1 FROM ents e WHERE e.source_file = l.source_file AND e.entity = l.to_entity)
  AND NOT EXISTS (SELECT 1 FROM flds f WHERE f.source_file = l.source_file AND f.entity = l.to_entity AND f.field_key = l.on_to)
UNION ALL SELECT source_file, key, 'metric of unknown entity' FROM mets m WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.source_file = m.source_file AND e.entity = m.entity)
UNION ALL SELECT source_file, key, 'metric of unknown field' FROM mets m WHERE m.field IS NOT NULL AND EXISTS (SELECT 1 FROM ents e WHERE e.source_file = m.source_file AND e.entity = m.entity)
  AND NOT EXISTS (SELECT 1 FROM flds f WHERE f.source_file = m.source_file AND f.entity = m.entity AND f.field_key = m.field)
UNION ALL SELECT source_file, key, 'metric without field' FROM mets WHERE op <> 'count' AND field IS NULL"""


@query("catalog_errors", "WITH " + ", ".join(f"{n} AS ({_part(n, False)})" for n in _PARTS) + " " + _CHECKS)
def catalog_errors(spark, sf):
    def part(name: str) -> DataFrame:
        return spark.sql(_part(name, True).replace("FROM orders", "FROM {orders}"), orders=fx.read(spark, sf, "orders"))

    fields = part("flds").withColumn("values", F.when(F.col("valued"), F.array(F.lit("x")))).drop("valued")
    return catalog.catalog_errors(part("ents"), fields, part("lnks"), part("mets"))


