"""Text to typed rows: coercion, enum widening, validation, whole loads."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators import catalog, load, versions
from tablewise.operators.query import Entity, Field
from tablewise.plans.confirm import confirm, loaded_rows
from tablewise.plans.understand import understand
from tablewise.session import work_folder
from tablewise.sources import records
from tablewise.sources.grid import table_rows
from tablewise.workloads import fixtures as fx
from tablewise.workloads.registry import query

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_COLUMNS = ("record_no", "amount_text", "date_text", "status_text", "note_text", "contact_phone", "remark")
RECORD = Entity("record", "record_no", (
    Field("record_no", "number", "identifier"), Field("amount_text", "money", "measure"), Field("date_text", "date", "time"),
    Field("status_text", "enum", "dimension", values=PRIORITIES), Field("note_text", "string", "text"),
    Field("contact_phone", "phone", "text"), Field("remark", "string", "text")))
POSITIONS = {c: i for i, c in enumerate(_COLUMNS)}

_SQL = {n: d for s, _, _, cols in fx.SHEETS if s == "sales dirty" for n, _, d in cols}
# Broken cells: a key is empty on every 101st order, an amount unreadable on every 103rd.
_SQL["record_no"] = f"CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE {_SQL['record_no']} END"
_SQL["amount_text"] = f"CASE WHEN o_orderkey % 103 = 0 THEN 'abc' ELSE {_SQL['amount_text']} END"
_CELLS = "dirty AS (SELECT o_orderkey AS row_no, " + ", ".join(
    f"nullif(trim({_SQL[c]}), '') AS {c}" for c in _COLUMNS) + " FROM orders)"
_LABEL = "regexp_replace({c}, '\\s+', '', 'g')"
_ALLOWED = "[" + ", ".join(f"'{p}'" for p in PRIORITIES) + "]"
_ENUM = (f"CASE WHEN status_text IN (SELECT unnest({_ALLOWED})) THEN status_text ELSE coalesce(list_filter({_ALLOWED}, "
         f"lambda p: {_LABEL.format(c='p')} = {_LABEL.format(c='status_text')})[1], {_LABEL.format(c='status_text')}) END")
_gone = fx.sql_missing
CHECKED = f"""{_CELLS}, typed AS (SELECT row_no, {fx.sql_to_number('record_no')} AS record_no,
  CASE WHEN NOT {_gone('amount_text')} THEN {fx.sql_to_number('amount_text')} END AS amount_text, amount_text AS raw_amount,
  CASE WHEN NOT {_gone('date_text')} THEN {fx.sql_to_date('date_text')} END AS date_text,
  CASE WHEN NOT {_gone('status_text')} THEN {_ENUM} END AS status_text, status_text AS raw_status, note_text, contact_phone, remark FROM dirty),
errors AS (SELECT row_no, 'record_no' AS field, NULL AS value, 'key is empty' AS cause FROM typed WHERE record_no IS NULL
  UNION ALL SELECT row_no, 'amount_text', raw_amount, 'not a number' FROM typed WHERE amount_text IS NULL
  UNION ALL SELECT row_no, 'status_text', raw_status, 'not a declared value' FROM typed WHERE status_text IS NOT NULL AND NOT list_contains({_ALLOWED}, status_text))"""


def dirty_rows(spark, sf) -> DataFrame:
    wide = fx.sheet_wide(spark, sf, "sales dirty")
    wide = wide.withColumns({
        "record_no": F.when(F.col("row_no") % 101 == 0, "").otherwise(F.col("record_no").cast("string")),
        "amount_text": F.when(F.col("row_no") % 103 == 0, "abc").otherwise(F.col("amount_text"))})
    return table_rows(wide, fx.BOOK, "sales dirty", "row_no", list(_COLUMNS))


def _cell(name: str):
    return F.col("cells")[POSITIONS[name]]


@query("coerce_money", f"WITH {CHECKED} SELECT row_no, raw_amount AS cell, amount_text AS number FROM typed")
def coerce_money(spark, sf):
    field = RECORD.field("amount_text")
    return dirty_rows(spark, sf).select(
        "row_no", _cell("amount_text").alias("cell"), load.coerce(_cell("amount_text"), field).alias("number"))


@query("coerce_date", f"WITH {CHECKED} SELECT d.row_no, d.date_text AS cell, t.date_text AS day FROM dirty d JOIN typed t USING (row_no)")
def coerce_date(spark, sf):
    return dirty_rows(spark, sf).select(
        "row_no", _cell("date_text").alias("cell"), load.coerce(_cell("date_text"), RECORD.field("date_text")).alias("day"))


@query("coerce_enum", f"""WITH {CHECKED} SELECT d.status_text AS cell, CASE WHEN d.status_text = 'HELD' THEN 'HELD' ELSE t.status_text END AS label, count(*) AS rows
FROM dirty d JOIN typed t USING (row_no) GROUP BY 1, 2""")
def coerce_enum(spark, sf):
    label = load.coerce(_cell("status_text"), RECORD.field("status_text"))
    return dirty_rows(spark, sf).select(_cell("status_text").alias("cell"), label.alias("label")).groupBy(
        "cell", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("coerce_missing", f"""WITH {CHECKED} SELECT d.note_text AS cell, CASE WHEN NOT {_gone('d.note_text')} THEN d.note_text END AS as_phone, d.note_text AS as_text, count(*) AS rows
FROM dirty d GROUP BY ALL""")
def coerce_missing(spark, sf):
    c = _cell("note_text")
    return dirty_rows(spark, sf).select(
        c.alias("cell"), load.coerce(c, Field("n", "phone")).alias("as_phone"), load.coerce(c, Field("n", "string")).alias("as_text"),
    ).groupBy("cell", "as_phone", "as_text").agg(F.count(F.lit(1)).alias("rows"))


@query("widen_enums", f"""WITH o AS (SELECT 'e' || o_custkey % 40 AS entity, 'L' || (o_orderkey * 7 % (5 + o_custkey % 40)) AS label, o_orderkey AS first_row FROM orders),
fresh AS (SELECT entity, label, min(first_row) AS first_row FROM o WHERE label NOT IN ('L0', 'L1') GROUP BY ALL),
ents AS (SELECT DISTINCT entity FROM o),
merged AS (SELECT entity, 2 + count(label) AS label_count, concat_ws('|', 'L0|L1', string_agg(label, '|' ORDER BY first_row)) AS labels FROM ents LEFT JOIN fresh USING (entity) GROUP BY entity)
SELECT entity, CASE WHEN label_count > 20 THEN 'string' ELSE 'enum' END AS type, label_count,
  CASE WHEN label_count > 20 THEN '' ELSE labels END AS labels FROM merged""")
def widen_enums(spark, sf):
    observed = fx.read(spark, sf, "orders").select(
        F.expr("concat('e', o_custkey % 40)").alias("entity"), F.lit("f").alias("field"),
        F.expr("concat('L', o_orderkey * 7 % (5 + o_custkey % 40))").alias("label"), F.col("o_orderkey").alias("first_row"))
    declared = observed.select("entity", "field").distinct().select(
        "entity", "field", F.posexplode(F.array(F.lit("L0"), F.lit("L1"))).alias("ord", "label"))
    wide = load.widened_labels(declared, observed)
    return wide.select("entity", "type", "label_count",
                       F.coalesce(F.array_join("labels", "|"), F.lit("")).alias("labels"))


@query("widened_entity", f"WITH {CHECKED} SELECT '{'|'.join(PRIORITIES)}|HELD' AS labels, count(*) AS rows FROM dirty")
def widened_entity(spark, sf):
    rows = dirty_rows(spark, sf)
    entity = load.widen_enums(RECORD, rows, POSITIONS)
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("|".join(entity.field("status_text").values)).alias("labels"), "rows")


@query("validate_split", f"""WITH {CHECKED} SELECT row_no, 'good' AS outcome, CAST(amount_text AS VARCHAR) AS value, status_text AS cause FROM typed ANTI JOIN errors USING (row_no)
UNION ALL SELECT row_no, field, value, cause FROM errors""")
def validate_split(spark, sf):
    good, bad = load.split_rows(load.typed_rows(dirty_rows(spark, sf), RECORD, POSITIONS))
    return good.select("row_no", F.lit("good").alias("outcome"), F.col("amount_text").cast("string").alias("value"),
                       F.col("status_text").alias("cause")).unionAll(bad.select("row_no", "field", "value", "cause"))


@query("typed_rows", f"""WITH {CHECKED} SELECT row_no, record_no, amount_text, date_text, status_text, note_text, contact_phone, remark FROM typed ANTI JOIN errors USING (row_no)""")
def typed_rows(spark, sf):
    good, _ = load.split_rows(load.typed_rows(dirty_rows(spark, sf), RECORD, POSITIONS))
    return good


@query("typed_cells", f"""WITH {CHECKED} SELECT 'record_no' AS field_key, count(record_no) AS filled, 0 AS errors FROM typed
UNION ALL SELECT 'amount_text', count(amount_text), count(*) FILTER (amount_text IS NULL) FROM typed
UNION ALL SELECT 'date_text', count(date_text), 0 FROM typed
UNION ALL SELECT 'status_text', count(status_text), count(*) FILTER (status_text IS NOT NULL AND NOT list_contains({_ALLOWED}, status_text)) FROM typed
UNION ALL SELECT 'note_text', count(note_text), 0 FROM typed UNION ALL SELECT 'contact_phone', count(contact_phone), 0 FROM typed
UNION ALL SELECT 'remark', count(remark), 0 FROM typed""")
def typed_cells(spark, sf):
    fields = spark.createDataFrame(
        [(fx.BOOK, "sales dirty", POSITIONS[f.key], f.key, f.type, list(f.values)) for f in RECORD.fields],
        "source_file string, sheet string, pos int, field_key string, type string, values array<string>")
    cells = load.coerce_long(dirty_rows(spark, sf), fields)
    return cells.groupBy("field_key").agg(
        F.count(F.coalesce("text", F.col("number").cast("string"), F.col("date").cast("string"))).alias("filled"),
        F.count("error").alias("errors"))


@query("record_checks", """SELECT o_orderkey AS order_id, 'order_status: not a declared value' AS causes FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 17 <> 0
UNION ALL SELECT NULL, CASE WHEN o_orderstatus = 'P' THEN 'order_status: not a declared value; ' ELSE '' END || 'order_id: key is empty' FROM orders WHERE o_orderkey % 17 = 0""")
def record_checks(spark, sf):
    entity = Entity("order", "order_id", (Field("order_id", "number"), Field("order_status", "enum", values=("F", "O")), Field("order_date", "date")))
    df = fx.orders(spark, sf).select(
        F.when(F.col("order_id") % 17 != 0, F.col("order_id")).alias("order_id"), "order_status", F.col("order_date").cast("string").alias("order_date"))
    causes = F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["cause"]))
    checked = load.validate(df, entity).filter(F.size("errors") > 0)
    return checked.select("order_id", F.array_join(causes, "; ").alias("causes"))


@query("stored_records", "SELECT o_orderkey % 2 AS half, o_orderkey AS order_id, CAST(o_totalprice AS DOUBLE) AS amount, CAST(o_orderdate AS DATE) AS order_date FROM orders WHERE o_orderkey % 2 = 0")
def stored_records(spark, sf):
    # Written twice: the second write replaces the first. An entity never written reads as empty.
    root, app = f"{work_folder(spark)}/records-{uuid.uuid4().hex}", "shop"
    entity = Entity("order", "order_id", (Field("order_id", "number"), Field("amount", "money"), Field("order_date", "date")))
    df = records.conform(fx.orders(spark, sf), entity)
    records.write_records(df, root, app, "order")
    records.write_records(df.filter(F.col("order_id") % 2 == 0), root, app, "order")
    empty = records.read_records(spark, root, app, Entity("ghost", "order_id", entity.fields))
    stored = records.read_records(spark, root, app, entity).unionByName(empty)
    return stored.select((F.col("order_id") % 2).cast("int").alias("half"), F.col("order_id").cast("bigint").alias("order_id"), "amount", "order_date")


# Entity, table, and the field whose sum is compared, with its SQL.
_LOADED = (
    ("customer", "customer", "customer", "field_4", "c_acctbal"), ("order", "order", "orders", "field_4", "o_totalprice"),
    ("product", "line item", "lineitem", "field_6", "l_extendedprice"), ("product_2", "product", "part", "field_6", "p_retailprice"),
    ("customer_2", "nation", "nation", "field_1", "n_nationkey"), ("customer_3", "region", "region", "field_1", "r_regionkey"),
    ("customer_4", "supplier", "supplier", "field_3", "s_nationkey"), ("order_2", "sales dirty", "orders", "field_2", "o_totalprice"))


@query("confirm_load", " UNION ALL ".join(
    f"""SELECT '{e}' AS entity, '{name}' AS name, count(*) AS rows, 0 AS rejects, round(sum(CAST({c} AS DECIMAL(18,2))), 2) AS total,
    {f"'signed orders'" if e == "order" else "NULL"} AS definition FROM {t}""" for e, name, t, _, c in _LOADED))
def confirm_load(spark, sf):
    # The whole way: understand all sheets, accept everything, load, read back through the version. One sheet has no key.
    found = understand(fx.corpus_rows(spark, sf), fx.corpus_columns(spark, sf), dense=True)
    cat = found.catalog()
    decisions = cat["links"].select("source_file", "key", F.lit("accepted").alias("decision"),
                                    F.lit(None).cast("string").alias("on_from"), F.lit(None).cast("string").alias("on_to"))
    ids = catalog.review_queue(cat["entities"], cat["fields"], cat["metrics"], cat["links"]).select(
        "source_file", F.regexp_replace("item", "^(entity|field):", "").alias("id"))
    given = spark.createDataFrame([(fx.BOOK, 0, "order", "count", None, "signed orders", 0.95)],
                                  "source_file string, position int, sheet string, op string, field string, definition string, confidence double")
    root = f"{work_folder(spark)}/apps-{uuid.uuid4().hex}"
    loaded = confirm(found, fx.BOOK, "workspace", root, decisions, ids, definitions=given)
    snapshot = versions.current_versions(versions.read_versions(spark, f"{root}/model_versions", "workspace")).select(
        F.from_json("snapshot", versions.SNAPSHOT).alias("s"))
    parts = []
    for entity, _, _, field, _ in _LOADED:
        rows = loaded_rows(spark, root, "workspace", entity)
        parts.append(rows.agg(F.lit(entity).alias("entity"), F.count(F.lit(1)).alias("rows"), F.round(F.sum(field), 2).alias("total"),
                              F.lit(loaded.rejects[entity]).cast("bigint").alias("rejects")))
    names = snapshot.select(F.explode("s.entities").alias("e"), "s.metrics").select(
        F.col("e.key").alias("entity"), F.col("e.name").alias("name"), F.filter("metrics", lambda m: (m["entity"] == F.col("e.key")) & (
            m["op"] == "count") & ~m["business_definition"].startswith("rows of ")).alias("m")).select(
        "entity", "name", F.get("m", F.lit(0))["business_definition"].alias("definition"))
    return reduce(DataFrame.unionAll, parts).join(names, "entity")
