"""Types, roles, table kinds and keys of the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.operators import infer, profile
from tablewise.operators.numbering import stride_sample
from tablewise.session import materialize
from tablewise.workloads import fixtures as fx
from tablewise.workloads.profiles import COUNTS, PICKED
from tablewise.workloads.registry import query

_W = fx.sql_word


def _signals(*pairs: str) -> str:
    return "concat_ws('|', " + ", ".join(pairs) + ")"


def _opt(signal: str, cond: str) -> str:
    return f"CASE WHEN {cond} THEN '{signal}' END"


def _band(r: str) -> str:
    return f"CASE WHEN {r} >= 0.98 THEN 0.98 WHEN {r} >= 0.95 THEN 0.95 WHEN {r} >= 0.9 THEN 0.9 WHEN {r} >= 0.8 THEN 0.75 ELSE 0.61 END"


_FEW = "(filled >= 3 AND distinct_real <= 20 AND distinct_real / filled <= 0.5)"
_RUNGS = (
    ("coalesce(n, 0) = 0 OR coalesce(filled, 0) = 0", "string", "0.0", "'no_non_null_values'"),
    ("r_date >= 0.6", "date", _band("r_date"),
     _signals("'calendar_validated'", _opt("name_keyword:date", _W("col", V.DATE_NAMES)), _opt("mixed_values", "r_date < 0.9"))),
    ("r_phone >= 0.6", "phone", _band("r_phone"),
     _signals("'phone_pattern'", _opt("name_keyword:phone", _W("col", V.PHONE_NAMES)), _opt("mixed_values", "r_phone < 0.9"))),
    (f"{_FEW} AND {_W('col', V.CATEGORY_NAMES)} AND NOT {_W('col', V.LONG_TEXT_NAMES)}", "enum",
     "CASE WHEN r_number < 0.5 THEN 0.88 ELSE 0.75 END", "'low_cardinality_distribution|name_keyword:category'"),
    ("r_money >= 0.6", "money", _band("r_money"), _signals("'currency_symbol'", _opt("mixed_values", "r_money < 0.9"))),
    (f"r_number >= 0.6 AND {_W('col', V.MONEY_NAMES)}", "money", f"least(0.98, ({_band('r_number')}) + 0.05)",
     _signals("'name_keyword:money'", _opt("mixed_values", "r_number < 0.9"))),
    ("r_number >= 0.6", "number", _band("r_number"), _signals("'numeric_format'", _opt("mixed_values", "r_number < 0.9"))),
    (f"{_FEW} AND r_number < 0.5 AND NOT {_W('col', V.LONG_TEXT_NAMES)} AND max_chars <= 16 AND avg_chars <= 8", "enum",
     "0.75", "'low_cardinality_distribution'"),
    ("greatest(r_date, r_phone, r_money, r_number) < 0.1", "string", "0.9", "'free_text'"),
    ("true", "string", "0.55", "'ambiguous'"),
)


def _ladder(column: int) -> str:
    fmt = (lambda v: f"'{v}'") if column == 1 else str
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {fmt(r[column])}" for r in _RUNGS) + " END"


_REAL = f"NOT {fx.sql_missing('value')}"
_avg = lambda t: f"avg(CASE WHEN {t('value')} THEN 1.0 ELSE 0 END) FILTER ({_REAL})"
_share = lambda t: f"coalesce(sum(n) FILTER ({_REAL} AND {t('value')}), 0) / sum(n) FILTER ({_REAL})"
#: Facts of the formats over all values, and over the sample.
RATIOS = f"""ratios AS (SELECT sheet, pos, coalesce(sum(n) FILTER ({_REAL}), 0) AS n, {_share(fx.sql_is_date)} AS r_date,
  {_share(fx.sql_phone)} AS r_phone, {_share(fx.sql_money)} AS r_money, {_share(fx.sql_number)} AS r_number,
  max(length(value)) FILTER ({_REAL}) AS max_chars, sum(length(value) * n) FILTER ({_REAL}) / sum(n) FILTER ({_REAL}) AS avg_chars,
  sum(length(value) * n) / sum(n) FILTER (value IS NOT NULL) AS raw_chars FROM vc GROUP BY sheet, pos)"""
SAMPLED_RATIOS = f"""{PICKED}, ratios AS (SELECT sheet, pos, count(*) FILTER ({_REAL}) AS n, {_avg(fx.sql_is_date)} AS r_date, {_avg(fx.sql_phone)} AS r_phone,
  {_avg(fx.sql_money)} AS r_money, {_avg(fx.sql_number)} AS r_number, max(length(value)) FILTER ({_REAL}) AS max_chars,
  avg(length(value)) FILTER ({_REAL}) AS avg_chars, avg(length(value)) AS raw_chars FROM sampled GROUP BY sheet, pos)"""


def _typed_sql(ratios: str) -> str:
    return f"""{COUNTS}, {ratios},
names AS (SELECT DISTINCT sheet, pos, col FROM cells),
stats AS (SELECT sheet, pos, coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS non_null, sum(n) AS total,
  coalesce(max(n) FILTER (value IS NOT NULL), 0) = 1 AS uniq,
  count(*) FILTER ({_REAL}) AS distinct_real, coalesce(sum(n) FILTER ({_REAL}), 0) AS filled,
  list(value ORDER BY value) FILTER ({_REAL}) AS labels FROM vc GROUP BY sheet, pos),
facts AS (SELECT * FROM names JOIN ratios USING (sheet, pos) JOIN stats USING (sheet, pos)),
typed AS (SELECT *, {_ladder(1)} AS type, CAST({_ladder(2)} AS DOUBLE) AS confidence, {_ladder(3)} AS signals FROM facts)"""


TYPED = _typed_sql(RATIOS)

_WORDY = ("list_filter(labels, lambda v: regexp_matches(v, '[\\x{4e00}-\\x{9fff}]') OR "
          "(length(v) >= 2 AND NOT regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9\\-_/]{0,5}$')))")
_ID = "uniq AND round_even((total - non_null) / total, 4) <= 0.05 AND type IN ('string', 'number')"
_ROLES = (
    ("non_null = 0", "text", "0.0", "no_non_null_values"),
    (f"{_ID} AND {_W('col', V.IDENTIFIER_NAMES)}", "identifier", "0.95", "unique_values|name_keyword:identifier"),
    (f"{_ID} AND type = 'string'", "identifier", "0.75", "unique_values"),
    (_ID, "measure", "0.75", "unique_numeric_without_key_name"),
    ("type = 'date'", "time", "confidence", "type:date"), ("type = 'money'", "measure", "confidence", "type:money"),
    ("type = 'number'", "measure", "confidence", "type:number"),
    (f"type = 'enum' AND len({_WORDY}) / len(labels) < 0.5", "enum", "0.75", "type:enum|code_like_values"),
    ("type = 'enum'", "dimension", "confidence", "type:enum|wordy_category_values"),
    ("type = 'phone'", "text", "confidence", "type:phone"),
    (_W("col", V.LONG_TEXT_NAMES), "text", "0.9", "name_keyword:long_text"),
    ("coalesce(raw_chars, 0) >= 12", "text", "0.7", "long_avg_length"), ("true", "dimension", "0.85", "short_categorical_text"),
)
_pick = lambda i, q="'": "CASE " + " ".join(f"WHEN {r[0]} THEN {q}{r[i]}{q}" for r in _ROLES) + " END"
ROLED = f"""{TYPED}, roled AS (SELECT *, {_pick(1)} AS role, CAST({_pick(2, '')} AS DOUBLE) AS role_confidence,
  {_pick(3)} AS role_signals FROM typed)"""

_b = lambda c: f"coalesce(bool_or({c}), false)"
ENTITIES = f"""{ROLED}, shape AS (SELECT sheet, {_b("role = 'identifier'")} AS has_id, {_b("role = 'time'")} AS has_time,
  {_b(f"type = 'phone' OR (role = 'text' AND {_W('col', V.CONTACT_NAMES)})")} AS contact, {_b(_W('col', V.PRODUCT_ATTRIBUTE_NAMES))} AS attr,
  {_b(f"type = 'money' AND {_W('col', V.PRICE_NAMES)}")} AS price, {_b(f"type = 'money' AND NOT {_W('col', V.PRICE_NAMES)}")} AS flow,
  {_b(f"type = 'number' AND role = 'measure' AND {_W('col', V.QUANTITY_NAMES)}")} AS qty,
  {_b(f"role = 'identifier' AND {_W('col', V.PARTY_ID_NAMES)}")} AS party,
  first(col ORDER BY role_confidence DESC, pos) FILTER (role = 'identifier') AS key_field,
  first(pos ORDER BY role_confidence DESC, pos) FILTER (role = 'identifier') AS key_pos FROM roled GROUP BY sheet),
kinds AS (SELECT *, CASE WHEN {_W('sheet', V.ORDER_TABLES)} THEN 'order' WHEN {_W('sheet', V.CUSTOMER_TABLES)} THEN 'customer'
    WHEN {_W('sheet', V.PRODUCT_TABLES)} THEN 'product' END AS named,
  CASE WHEN has_id AND has_time AND flow THEN 'order' WHEN has_id AND NOT has_time AND (price OR attr) THEN 'product'
    WHEN has_id AND NOT has_time AND NOT flow AND contact THEN 'customer' END AS strong FROM shape),
kinds2 AS (SELECT *, CASE WHEN strong IS NULL AND has_id THEN CASE WHEN has_time OR (flow AND qty) THEN 'order'
    WHEN NOT has_time AND NOT flow AND NOT price AND party THEN 'customer' END END AS weak FROM kinds),
entities AS (SELECT *, coalesce(named, strong, weak, 'unknown') AS kind, CAST(CASE
    WHEN named IS NOT NULL THEN least(CASE WHEN strong <> named THEN 0.61 ELSE 0.95 END, CASE WHEN key_field IS NULL THEN 0.75 ELSE 1 END)
    WHEN strong IS NOT NULL THEN 0.85 WHEN weak = 'order' THEN 0.75 WHEN weak IS NOT NULL THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence,
  concat_ws('|', 'name_keyword:' || named, CASE WHEN strong <> named THEN 'structure_suggests:' || strong || '|name_structure_conflict' END,
    CASE WHEN strong = named THEN 'structure_confirmed' END,
    CASE WHEN named IS NOT NULL AND strong IS NULL AND weak <> named THEN 'structure_hint:' || weak END,
    CASE WHEN named IS NOT NULL AND key_field IS NULL THEN 'no_identifier' END,
    CASE WHEN named IS NULL THEN coalesce('structure:' || strong || '_strong', 'structure:' || weak || '_weak', 'no_entity_evidence') END,
    {_opt('has_identifier', 'has_id')}, {_opt('has_time_field', 'has_time')}, {_opt('has_flow_money', 'flow')}, {_opt('has_price_field', 'price')},
    {_opt('has_contact_field', 'contact')}, {_opt('has_product_attribute', 'attr')}, {_opt('has_quantity_field', 'qty')},
    {_opt('partial_transaction_shape', "weak = 'order'")}, {_opt('party_name_only', "weak = 'customer'")}) AS signals FROM kinds2)"""


def inferred(spark, sf, sheets=None, sampled=False):
    """Fields of the corpus; the value counts are stored once."""
    rows, columns = fx.corpus_rows(spark, sf, sheets), fx.corpus_columns(spark, sf, sheets)
    counts = materialize(profile.value_counts(rows), "value_counts")
    return infer.infer_fields(columns, counts, stride_sample(rows, dense=True) if sampled else None), counts, columns


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


_TYPES = """SELECT sheet, pos, col AS column, type, round(confidence, 6) AS confidence, signals,
  CASE WHEN type = 'enum' THEN array_to_string(labels, '|') ELSE '' END AS enum_values, confidence < 0.85 AS needs_review FROM typed"""


def _types(fields):
    return fields.select("sheet", "pos", "column", "type", F.round("confidence", 6).alias("confidence"),
                         _joined("signals"), _joined("enum_values"), "needs_review")


@query("infer_types", f"WITH {TYPED} {_TYPES}")
def infer_types(spark, sf):
    return _types(inferred(spark, sf)[0])


@query("infer_types_sampled", f"WITH {_typed_sql(SAMPLED_RATIOS)} {_TYPES}")
def infer_types_sampled(spark, sf):
    return _types(inferred(spark, sf, sampled=True)[0])


@query("value_ratios", f"""WITH {COUNTS}, {RATIOS} SELECT sheet, pos, CAST(n AS BIGINT) AS filled, round(r_date, 9) AS r_date, round(r_phone, 9) AS r_phone,
  round(r_money, 9) AS r_money, round(r_number, 9) AS r_number, max_chars, round(avg_chars, 9) AS avg_chars FROM ratios WHERE n > 0""")
def value_ratios(spark, sf):
    ratios = infer.value_ratios(profile.value_counts(fx.corpus_rows(spark, sf))).filter(F.col("sample_values") > 0)
    return ratios.select("sheet", "pos", F.col("sample_values").alias("filled"), "max_chars", *[
        F.round(c, 9).alias(c) for c in ("r_date", "r_phone", "r_money", "r_number", "avg_chars")])


@query("infer_roles", f"""WITH {ROLED} SELECT sheet, pos, col AS column, role, round(role_confidence, 6) AS role_confidence, role_signals,
  CASE WHEN role_confidence >= 0.85 THEN 'high' WHEN role_confidence >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM roled""")
def infer_roles(spark, sf):
    fields, _, _ = inferred(spark, sf)
    return fields.select("sheet", "pos", "column", "role", F.round("role_confidence", 6).alias("role_confidence"),
                         _joined("role_signals"), text.confidence_level(F.col("role_confidence")).alias("level"))


@query("infer_entities", f"""WITH {ENTITIES} SELECT sheet, kind, sheet AS name, key_field, confidence, confidence < 0.85 AS needs_review,
  signals FROM entities""")
def infer_entities(spark, sf):
    fields, _, _ = inferred(spark, sf)
    found = infer.infer_entities(fields)
    return found.select("sheet", "kind", "name", "key_field", "confidence", "needs_review", _joined("signals"))


_STRUCTURE = "has_id, has_time, contact AS has_contact, attr AS has_attribute, price AS has_price, flow AS has_flow, qty AS has_quantity, party AS has_party_name"


@query("table_structure", f"WITH {ENTITIES} SELECT sheet, {_STRUCTURE} FROM entities")
def table_structure(spark, sf):
    fields, _, _ = inferred(spark, sf)
    return infer.structure(fields).select(
        "sheet", "has_id", "has_time", "has_contact", "has_attribute", "has_price", "has_flow", "has_quantity", "has_party_name")


_PICK = f"""{ROLED}, cand AS (SELECT *, non_null / total AS present, count_distinct / nullif(non_null, 0) AS dist,
  CASE WHEN role = 'identifier' THEN 1 ELSE 2 END AS rank FROM roled
  JOIN (SELECT sheet, pos, count(value) AS count_distinct FROM vc GROUP BY ALL) USING (sheet, pos))"""


@query("pick_keys", f"""WITH {_PICK} SELECT sheet, first(col ORDER BY rank, pos) AS key_field,
  first(dist ORDER BY rank, pos) < 0.95 AS key_repeats FROM cand WHERE present >= 0.95 GROUP BY sheet""")
def pick_keys(spark, sf):
    fields, _, _ = inferred(spark, sf)
    return infer.pick_keys(fields, fields).select("sheet", "key_field", "key_repeats")


# Proposals derived from the corpus itself: every column of the dirty sheet is called text,
# its status an enum of the labels seen, its keys the notes column, which is too often empty.
def field_hints(fields):
    dirty = fields.filter((F.col("sheet") == "sales dirty") & (F.col("column") != "flag"))
    status = F.col("column") == "status_text"
    return dirty.select(
        "source_file", "sheet", "column", F.when(status, "enum").when(F.col("column") == "remark", "enum").otherwise("text").alias("type"),
        F.when(status, "enum").otherwise("dimension").alias("role"), F.when(status, 0.9).otherwise(0.7).alias("confidence"),
        F.lit(False).alias("needs_review"), F.concat(F.lit("as seen in "), "column").alias("reason"),
        F.when(status, F.array(F.lit("1-URGENT"), F.lit("5-LOW"), F.lit("5-LOW"))).otherwise(F.array().cast("array<string>")).alias("enum_values"))


@query("merge_hints", f"""WITH {ROLED}, h AS (SELECT sheet AS hs, pos AS hp, col = 'status_text' AS st, col = 'remark' AS rm
  FROM roled WHERE sheet = 'sales dirty' AND col <> 'flag')
SELECT sheet, pos, CASE WHEN hs IS NULL THEN type WHEN st THEN 'enum' WHEN rm THEN 'string' ELSE type END AS type,
  CASE WHEN hs IS NULL THEN role WHEN st THEN 'enum' ELSE 'dimension' END AS role,
  round(CASE WHEN hs IS NULL THEN confidence WHEN st THEN 0.9 ELSE 0.7 END, 6) AS confidence,
  CASE WHEN hs IS NULL THEN signals || '|hint:column_fallback' ELSE 'hint|hint_reason:as seen in ' || col END AS signals,
  CASE WHEN hs IS NULL THEN CASE WHEN type = 'enum' THEN array_to_string(labels, '|') ELSE '' END WHEN st THEN '1-URGENT|5-LOW' ELSE '' END AS enum_values
FROM roled LEFT JOIN h ON sheet = hs AND pos = hp""")
def merge_hints(spark, sf):
    fields, _, _ = inferred(spark, sf)
    merged = infer.merge_field_hints(fields, field_hints(fields))
    return merged.select("sheet", "pos", "type", "role", F.round("confidence", 6).alias("confidence"),
                         _joined("signals"), _joined("enum_values"))


@query("entity_hints", f"""WITH {ENTITIES} SELECT sheet, CASE WHEN sheet IN ('sales dirty', 'keyless lines') THEN
    CASE WHEN sheet = 'keyless lines' THEN 'my_table' ELSE 'my_table_2' END ELSE kind END AS kind,
  CASE WHEN sheet = 'sales dirty' THEN 'record_no' WHEN sheet = 'keyless lines' THEN 'item_no' ELSE key_field END AS key_field,
  CASE WHEN sheet IN ('sales dirty', 'keyless lines') THEN 0.9 ELSE confidence END AS confidence,
  CASE WHEN sheet = 'sales dirty' THEN false WHEN sheet = 'keyless lines' THEN true ELSE confidence < 0.85 END AS needs_review FROM entities""")
def entity_hints(spark, sf):
    fields, _, _ = inferred(spark, sf)
    fields = materialize(fields, "fields")
    entities = infer.infer_entities(fields)
    # The proposed key of the dirty sheet is empty on a quarter of the rows.
    hints = entities.filter(F.col("sheet").isin("sales dirty", "keyless lines")).select(
        "source_file", "sheet", F.row_number().over(Window.partitionBy("source_file").orderBy("sheet")).alias("position"), F.lit(" My Table!").alias("key"),
        F.lit("Proposed").alias("name"), F.when(F.col("sheet") == "sales dirty", "note_text").alias("key_field"),
        F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_review"), F.lit("proposed").alias("reason"))
    _, out = infer.apply_entity_hints(fields, entities, hints)
    return out.select("sheet", "kind", "key_field", "confidence", "needs_review")
