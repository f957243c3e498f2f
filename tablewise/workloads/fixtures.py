"""The star-schema tables under business names, as typed tables and as rows of text.

Each rule is written twice, as a Spark expression and as SQL, so that the two answers
are computed independently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewise.functions import vocab as V
from tablewise.operators.query import Entity, Field
from tablewise.sources.grid import table_rows
from tablewise.sources.parquet import indexed_parquet, spread

BOOK = "shop"


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; its schema is taken from the files once, as that costs a job each time."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


# --- typed tables ------------------------------------------------------------

def customers(spark, sf):
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_nationkey").alias("nation_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment_type"))


def orders(spark, sf):
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderpriority").alias("priority_level"))


def products(spark, sf):
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("product_type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("unit_price"))


def events(spark, sf):
    return read(spark, sf, "events").select(
        "event_id", F.col("ts").cast("date").alias("event_date"), "user_id", "event_type", "value")


CUSTOMER = Entity("customer", "customer_id", (
    Field("customer_id", "number", "identifier"), Field("customer_name", "string", "identifier"),
    Field("nation_id", "number", "measure"), Field("balance", "number", "measure"),
    Field("segment_type", "enum", "dimension")))
ORDER = Entity("order", "order_id", (
    Field("order_id", "number", "identifier"), Field("customer_id", "number", "measure"),
    Field("order_status", "enum", "enum", values=("F", "O", "P")), Field("amount", "money", "measure"),
    Field("order_date", "date", "time"), Field("priority_level", "enum", "dimension")))
PRODUCT = Entity("product", "part_id", (
    Field("part_id", "number", "identifier"), Field("product_name", "string"), Field("brand", "string"),
    Field("product_type", "enum", "dimension"), Field("size", "number", "measure"),
    Field("unit_price", "money", "measure")))
EVENT = Entity("event", "event_id", (
    Field("event_id", "number", "identifier"), Field("event_date", "date", "time"),
    Field("user_id", "number", "measure"), Field("event_type", "enum", "dimension"), Field("value", "number", "measure")))
ENTITIES = [CUSTOMER, ORDER, PRODUCT, EVENT]


def tables(spark, sf):
    return {"customer": customers(spark, sf), "order": orders(spark, sf),
            "product": products(spark, sf), "event": events(spark, sf)}


ORDERS_SQL = """orders_t AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
  o_totalprice AS amount, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS priority_level FROM orders)"""
CUSTOMERS_SQL = """customers_t AS (SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS nation_id,
  c_acctbal AS balance, c_mktsegment AS segment_type FROM customer)"""


# --- rows of text ------------------------------------------------------------
# (sheet, table, row number, [(column, Spark SQL, DuckDB SQL)]); one text serves both where it can.

def _c(name, expr, other=None):
    return name, expr, other or expr


_typed = lambda c: (c, f"cast({c} as string)")
_cents = lambda c: (f"cast({c} as decimal(18,2))", f"cast(cast({c} as decimal(18,2)) as string)")
_day = lambda c: (f"cast({c} as date)", f"strftime({c}, '%Y-%m-%d')")
_money = lambda c: f"cast(cast({c} as decimal(18,2)) as string)"

AMOUNT = (
    "case {k} % 5 when 0 then concat('¥', {n}) when 1 then concat({n}, '元') when 2 then {n} "
    "when 3 then {commas} else concat('  ', {n}, ' ') end"
)
_whole = "cast(cast(floor({v}) as bigint) as string)"
_thousands = r"regexp_replace({w}, '^([0-9]+)([0-9]{{3}})$', '{one},{two}')"


def amount_text(k: str, v: str) -> tuple[str, str]:
    w = _whole.format(v=v)
    cents = f"substr({_money(v)}, -3)"
    spark_n = f"concat({_thousands.format(w=w, one='$1', two='$2')}, {cents})"
    duck_n = f"concat({_thousands.format(w=w, one=chr(92) + '1', two=chr(92) + '2')}, {cents})"
    n = _money(v)
    return AMOUNT.format(k=k, n=n, commas=spark_n), AMOUNT.format(k=k, n=n, commas=duck_n)


DATE_FORMS = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/M/d", "%Y/%-m/%-d"), ("yyyy.MM.dd", "%Y.%m.%d"),
    ("yyyy年M月d日", "%Y年%-m月%-d日"), ("yyyy-MM", "%Y-%m"), ("yyyy", "%Y"),
)


def date_text(k: str, d: str) -> tuple[str, str]:
    spark = "case " + " ".join(f"when {k} % 6 = {i} then date_format({d}, '{s}')" for i, (s, _) in enumerate(DATE_FORMS)) + " end"
    duck = "case " + " ".join(f"when {k} % 6 = {i} then strftime({d}, '{f}')" for i, (_, f) in enumerate(DATE_FORMS)) + " end"
    return spark, duck


STATUS_TEXT = (
    "case when o_orderkey % 97 = 0 then 'HELD' when o_orderkey % 11 = 0 then 'N/A' "
    "when o_orderkey % 7 = 0 then concat(substr({p}, 1, 3), ' ', substr({p}, 4)) else {p} end"
).format(p="o_orderpriority")
NOTE_TEXT = (
    "case o_orderkey % 4 when 0 then null when 1 then 'missing: lost' when 2 then 'none of the above' else '-' end"
)
PHONE = "concat('138', lpad(cast(o_orderkey as string), 8, '0'))"
REMARK = "concat('shipped with order number ', cast(o_orderkey % 1000 as string))"

SHEETS = (
    ("customer", "customer", "c_custkey", (
        _c("customer_id", *_typed("c_custkey")), _c("customer_name", "c_name"), _c("nation_id", *_typed("c_nationkey")),
        _c("balance", *_cents("c_acctbal")), _c("segment_type", "c_mktsegment"))),
    ("order", "orders", "o_orderkey", (
        _c("order_id", *_typed("o_orderkey")), _c("customer_id", *_typed("o_custkey")), _c("order_status", "o_orderstatus"),
        _c("amount", *_cents("o_totalprice")), _c("order_date", *_day("o_orderdate")),
        _c("priority_level", "o_orderpriority"))),
    ("line item", "lineitem", None, (
        _c("line_id", *_typed("row_no")), _c("order_id", *_typed("l_orderkey")), _c("part_id", *_typed("l_partkey")),
        _c("supplier_id", *_typed("l_suppkey")), _c("quantity", *_typed("cast(l_quantity as bigint)")),
        _c("line_amount", *_cents("l_extendedprice")), _c("return_status", "l_returnflag"),
        _c("ship_date", *_day("l_shipdate")))),
    ("product", "part", "p_partkey", (
        _c("part_id", *_typed("p_partkey")), _c("product_name", "p_name"), _c("brand", "p_brand"),
        _c("product_type", "p_type"), _c("size", *_typed("p_size")), _c("unit_price", *_cents("p_retailprice")))),
    ("supplier", "supplier", "s_suppkey", (
        _c("supplier_id", *_typed("s_suppkey")), _c("supplier_name", "s_name"), _c("nation_id", *_typed("s_nationkey")))),
    ("nation", "nation", "n_nationkey", (
        _c("nation_id", *_typed("n_nationkey")), _c("nation_name", "n_name"), _c("region_id", *_typed("n_regionkey")))),
    ("region", "region", "r_regionkey", (
        _c("region_id", *_typed("r_regionkey")), _c("region_name", "r_name"))),
    ("sales dirty", "orders", "o_orderkey", (
        _c("record_no", *_typed("o_orderkey + 1")), _c("amount_text", *amount_text("o_orderkey", "o_totalprice")),
        _c("date_text", *date_text("o_orderkey", "o_orderdate")), _c("status_text", STATUS_TEXT),
        _c("note_text", NOTE_TEXT), _c("contact_phone", PHONE), _c("remark", REMARK),
        _c("customer", *_typed("o_custkey")), _c("flag", "case when o_orderkey % 3 = 0 then 'Y' else 'N' end"))),
    ("keyless lines", "lineitem", None, (
        _c("item_no", *_typed("l_orderkey")), _c("tag_no", *_typed("l_linenumber")))),
)


def sheet_wide(spark: SparkSession, sf: str, sheet: str) -> DataFrame:
    """One sheet as a wide table of text with its row number."""
    _, table, key, columns = next(s for s in SHEETS if s[0] == sheet)
    scan = read(spark, sf, table)
    df = indexed_parquet(scan) if key is None else spread(scan, key).withColumn("row_no", F.col(key))
    return df.select("row_no", *[F.expr(e).alias(n) for n, e, _ in columns])


def corpus_rows(spark: SparkSession, sf: str, sheets=None) -> DataFrame:
    parts = []
    for sheet, *_ in SHEETS:
        if sheets is None or sheet in sheets:
            wide = sheet_wide(spark, sf, sheet)
            parts.append(table_rows(wide, BOOK, sheet, "row_no", wide.columns[1:]))
    return reduce(DataFrame.unionAll, parts)


def corpus_columns(spark: SparkSession, sf: str, sheets=None) -> DataFrame:
    rows = [(BOOK, s, i, c[0]) for s, _, _, cols in SHEETS if sheets is None or s in sheets for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "source_file string, sheet string, pos int, column string")


def corpus_positions(spark: SparkSession) -> DataFrame:
    """Order of the sheets in the workbook, which is not that of their names."""
    return spark.createDataFrame([(BOOK, s[0], i) for i, s in enumerate(SHEETS)], "source_file string, sheet string, position int")


POSITION_SQL = "list_position([" + ", ".join(f"'{s[0]}'" for s in SHEETS) + "], sheet)"


def sql_rows(table: str, key: str | None) -> str:
    return f"(SELECT *, row_number() OVER () - 1 AS row_no FROM {table})" if key is None else f"(SELECT *, {key} AS row_no FROM {table})"


def corpus_sql(sheets=None) -> str:
    """CTE ``cells (sheet, pos, col, row_no, value)`` of the same corpus."""
    parts = []
    for sheet, table, key, columns in SHEETS:
        if sheets is not None and sheet not in sheets:
            continue
        listed = ", ".join(
            f"{{'pos': {i}, 'col': '{name}', 'value': nullif(trim({duck}), '')}}" for i, (name, _, duck) in enumerate(columns))
        parts.append(
            f"SELECT '{sheet}' AS sheet, row_no, unnest([{listed}]) AS c FROM {sql_rows(table, key)}")
    body = " UNION ALL ".join(parts)
    return f"cells AS (SELECT sheet, c.pos AS pos, c.col AS col, row_no, c.value AS value FROM ({body}))"


# --- the same predicates in SQL ----------------------------------------------

def _words(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _alternatives(words) -> str:
    import re
    return "|".join(re.escape(w).replace("'", "''") for w in words)


def sql_missing(v: str) -> str:
    words = sorted(V.MISSING_EN + V.MISSING_ZH, key=len, reverse=True)
    flat = f"regexp_replace(trim({v}), '\\s+', ' ', 'g')"
    return (
        f"({v} IS NULL OR trim({v}) = '' OR lower({flat}) IN ({_words(V.MISSING_EN + V.MISSING_ZH + V.MISSING_SYMBOLS)}) "
        f"OR regexp_matches({flat}, '^(?i:{_alternatives(words)})\\s*([:：].*|[(（].*[)）])\\s*$'))"
    )


def sql_number(v: str) -> str:
    return f"regexp_matches({v}, '^[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]+)?$')"


def sql_money(v: str) -> str:
    return (
        f"(regexp_matches({v}, '^[¥￥$€￠£]?\\s*[+-]?([0-9]{{1,3}}(,[0-9]{{3}})*|[0-9]+)(\\.[0-9]+)?\\s*[¥￥$€￠£元块]?$') "
        f"AND regexp_matches({v}, '[¥￥$€￠£]|[元块]$'))"
    )


def sql_phone(v: str) -> str:
    return f"regexp_matches(regexp_replace({v}, '[\\s\\-]', '', 'g'), '^((\\+?86)?1[3-9][0-9]{{9}}|0[0-9]{{2,3}}[0-9]{{7,8}})$')"


def sql_full_date(v: str) -> str:
    shape = "^[0-9]{4}(-[0-9]{1,2}-[0-9]{1,2}|/[0-9]{1,2}/[0-9]{1,2}|\\.[0-9]{1,2}\\.[0-9]{1,2}|年[0-9]{1,2}月[0-9]{1,2}日)$"
    flat = f"regexp_replace(replace(trim({v}), '日', ''), '[/.年月]', '-', 'g')"
    return f"(CASE WHEN regexp_matches(trim({v}), '{shape}') THEN CAST(try_strptime({flat}, '%Y-%m-%d') AS DATE) END)"


def sql_is_date(v: str) -> str:
    period = "^(19|20|21)[0-9]{2}([-/.][0-9]{1,2}|年[0-9]{1,2}月?)?$"
    return f"({sql_full_date(v)} IS NOT NULL OR regexp_matches(trim({v}), '{period}'))"


def sql_to_date(v: str) -> str:
    flat = f"regexp_replace(regexp_replace(trim({v}), '月|年$', '', 'g'), '[/.年]', '-', 'g')"
    return (
        f"coalesce({sql_full_date(v)}, CAST(try_strptime({flat}, '%Y-%m') AS DATE), "
        f"CASE WHEN regexp_matches({flat}, '^[0-9]{{4}}$') THEN CAST(try_strptime({flat}, '%Y') AS DATE) END)"
    )


def sql_to_number(v: str) -> str:
    flat = f"regexp_replace({v}, '[¥￥$€￠£,\\s元块]', '', 'g')"
    return f"(CASE WHEN regexp_matches({flat}, '^[+-]?[0-9]+(\\.[0-9]*)?$') THEN CAST({flat} AS DOUBLE) END)"


def sql_word(name: str, words) -> str:
    return f"regexp_matches(lower({name}), '{_alternatives(w.lower() for w in words)}')"
