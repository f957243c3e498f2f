"""Types, roles, table kinds and keys of every column and table of a corpus.

Evidence is one aggregated row per column; the ladders are conditional expressions over
that row, so the inference itself only touches catalog-sized data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.operators.catalog import unique_names
from tablewise.operators.numbering import TABLE, explode_cells
from tablewise.operators.profile import (
    COLUMN, column_facts, presence, value_sets, with_real,
)
from tablewise.session import materialize


def sample_ratios(sample: DataFrame) -> DataFrame:
    """Share of sampled values matching each format, markers left out, and lengths."""
    cells = explode_cells(sample, *TABLE)
    real = F.when(~text.is_missing(F.col("value")), F.col("value"))
    share = lambda test: F.avg(F.when(F.col("real").isNotNull(), F.when(test(F.col("real")), 1.0).otherwise(0.0)))
    return cells.withColumn("real", real).groupBy(*COLUMN).agg(
        F.count("real").alias("sample_values"),
        share(text.is_date).alias("r_date"), share(text.is_phone).alias("r_phone"),
        share(text.is_money).alias("r_money"), share(text.is_number).alias("r_number"),
        F.coalesce(F.max(F.length("real")), F.lit(0)).alias("max_chars"),
        F.coalesce(F.avg(F.length("real")), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.avg(F.length("value")), F.lit(0.0)).alias("raw_avg_chars"),
    )


def _ratio_columns() -> list:
    """Shares and lengths over value counts with a column ``real``: the value where it is no missing marker."""
    value, n = F.col("value"), F.col("n")
    real = F.col("real")
    filled = F.sum(F.when(real.isNotNull(), n))
    share = lambda test: F.coalesce(F.sum(F.when(real.isNotNull() & test(real), n)), F.lit(0)) / filled
    mean = lambda c: F.coalesce(
        F.sum(F.length(c) * n) / F.sum(F.when(c.isNotNull(), n)), F.lit(0.0))
    return [
        F.coalesce(filled, F.lit(0)).alias("sample_values"),
        share(text.is_date).alias("r_date"), share(text.is_phone).alias("r_phone"),
        share(text.is_money).alias("r_money"), share(text.is_number).alias("r_number"),
        F.coalesce(F.max(F.length("real")), F.lit(0)).alias("max_chars"),
        mean(real).alias("avg_chars"), mean(value).alias("raw_avg_chars"),
    ]


def value_ratios(counts: DataFrame) -> DataFrame:
    """The same facts as ``sample_ratios`` over all rows: each distinct value is tested once and weighed by its count."""
    return with_real(counts).groupBy(*COLUMN).agg(*_ratio_columns())


def _guess(kind: str, confidence: Column, *signals) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), confidence.cast("double").alias("confidence"),
        text.labels(*signals).alias("signals"),
    )


def type_ladder() -> Column:
    """Type, confidence and signals; the first rung that holds decides."""
    name = F.col("column")
    named = lambda words: text.has_word(name, words)
    date, phone, money, number = (F.col(f"r_{k}") for k in ("date", "phone", "money", "number"))
    mixed = lambda r: ("mixed_values", r < 0.90)
    few = (
        (F.col("effective_filled") >= V.ENUM_MIN_VALUES)
        & (F.col("effective_distinct") <= V.ENUM_MAX_DISTINCT)
        & (F.col("effective_distinct") <= V.ENUM_MAX_RATIO * F.col("effective_filled"))
    )
    prose = named(V.LONG_TEXT_NAMES)
    short = (F.col("max_chars") <= V.ENUM_LABEL_CHARS) & (F.col("avg_chars") <= V.ENUM_LABEL_AVG_CHARS)
    band = text.confidence_band
    ok = lambda r: r >= V.MIN_TYPE_RATIO
    free = F.greatest(date, phone, money, number) < 0.1
    return (
        F.when((F.col("sample_values") == 0) | (F.col("effective_filled") == 0),
               _guess("string", F.lit(0.0), "no_non_null_values"))
        .when(ok(date), _guess("date", band(date), "calendar_validated",
                               ("name_keyword:date", named(V.DATE_NAMES)), mixed(date)))
        .when(ok(phone), _guess("phone", band(phone), "phone_pattern",
                                ("name_keyword:phone", named(V.PHONE_NAMES)), mixed(phone)))
        .when(few & named(V.CATEGORY_NAMES) & ~prose,
              _guess("enum", F.when(number < 0.5, 0.88).otherwise(0.75),
                     "low_cardinality_distribution", "name_keyword:category"))
        .when(ok(money), _guess("money", band(money), "currency_symbol", mixed(money)))
        .when(ok(number) & named(V.MONEY_NAMES),
              _guess("money", F.least(F.lit(0.98), band(number) + 0.05), "name_keyword:money", mixed(number)))
        .when(ok(number), _guess("number", band(number), "numeric_format", mixed(number)))
        .when(few & (number < 0.5) & ~prose & short,
              _guess("enum", F.lit(0.75), "low_cardinality_distribution"))
        .when(free, _guess("string", F.lit(0.9), "free_text"))
        .otherwise(_guess("string", F.lit(0.55), "ambiguous"))
    )


def _role(role: str, confidence: Column, *signals: str) -> Column:
    return F.struct(
        F.lit(role).alias("role"), confidence.cast("double").alias("role_confidence"),
        F.array(*[F.lit(s) for s in signals]).alias("role_signals"),
    )


def role_ladder() -> Column:
    """Semantic role on top of the type; uniqueness is the raw one, markers included."""
    kind, conf, name = F.col("type"), F.col("confidence"), F.col("column")
    unique = F.col("is_unique") & (F.col("null_ratio") <= V.ID_MAX_NULL_RATIO)
    keyish = unique & kind.isin("string", "number")
    return (
        F.when(F.col("non_null_count") == 0, _role("text", F.lit(0.0), "no_non_null_values"))
        .when(keyish & text.has_word(name, V.IDENTIFIER_NAMES),
              _role("identifier", F.lit(0.95), "unique_values", "name_keyword:identifier"))
        .when(keyish & (kind == "string"), _role("identifier", F.lit(0.75), "unique_values"))
        .when(keyish, _role("measure", F.lit(0.75), "unique_numeric_without_key_name"))
        .when(kind == "date", _role("time", conf, "type:date"))
        .when(kind == "money", _role("measure", conf, "type:money"))
        .when(kind == "number", _role("measure", conf, "type:number"))
        .when((kind == "enum") & text.is_code_like(F.col("enum_values")),
              _role("enum", F.lit(0.75), "type:enum", "code_like_values"))
        .when(kind == "enum", _role("dimension", conf, "type:enum", "wordy_category_values"))
        .when(kind == "phone", _role("text", conf, "type:phone"))
        .when(text.has_word(name, V.LONG_TEXT_NAMES), _role("text", F.lit(0.9), "name_keyword:long_text"))
        .when(F.col("raw_avg_chars") >= V.LONG_TEXT_AVG_CHARS, _role("text", F.lit(0.7), "long_avg_length"))
        .otherwise(_role("dimension", F.lit(0.85), "short_categorical_text"))
    )


def _decide(df: DataFrame, verdict: Column) -> DataFrame:
    """Append the fields of a verdict. Going through a generator, the ladder is evaluated once
    and later filters on its outcome do not repeat it."""
    return df.select("*", F.inline_outer(F.array(verdict)))


def infer_fields(columns: DataFrame, counts: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """One row per column: statistics, type, role, confidences, signals, enum values.

    Formats are judged on all values, or on a sample of rows where one is given. All facts of the values
    come from one pass over the counts; they are stored, as the value sets are chosen by them.
    """
    key = list(COLUMN)
    found = materialize(column_facts(counts, () if sample is not None else _ratio_columns()), "column-facts")
    facts = columns.select(*COLUMN, "column").join(found, key, "left")
    if sample is not None:
        facts = facts.join(sample_ratios(sample), key, "left")
    facts = (
        facts.join(value_sets(counts, facts=found), key, "left")
        .fillna(0, ["total_count", "null_count", "non_null_count", "distinct_count", "sample_values",
                    "effective_distinct", "effective_filled"])
    )
    typed = _decide(facts, type_ladder()).withColumn(
        "enum_values",
        F.when((F.col("type") == "enum") & F.col("values").isNotNull(), F.col("values"))
        .otherwise(F.array().cast("array<string>")),
    ).drop("values")
    return (
        _decide(typed, role_ladder())
        .withColumn("needs_review", text.needs_review(F.col("confidence")))
        .withColumn("role_needs_review", text.needs_review(F.col("role_confidence")))
    )


def structure(fields: DataFrame) -> DataFrame:
    """What each table is composed of: key, time, money, contact and product evidence."""
    named = lambda words: text.has_word(F.col("column"), words)
    role, kind = F.col("role"), F.col("type")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return fields.groupBy(*TABLE).agg(
        any_(role == "identifier").alias("has_id"),
        any_(role == "time").alias("has_time"),
        any_((kind == "phone") | ((role == "text") & named(V.CONTACT_NAMES))).alias("has_contact"),
        any_(named(V.PRODUCT_ATTRIBUTE_NAMES)).alias("has_attribute"),
        any_((kind == "money") & named(V.PRICE_NAMES)).alias("has_price"),
        any_((kind == "money") & ~named(V.PRICE_NAMES)).alias("has_flow"),
        any_((kind == "number") & (role == "measure") & named(V.QUANTITY_NAMES)).alias("has_quantity"),
        any_((role == "identifier") & named(V.PARTY_ID_NAMES)).alias("has_party_name"),
        F.min_by("column", F.when(role == "identifier", F.struct(-F.col("role_confidence"), "pos"))).alias("key_field"),
        F.min_by("pos", F.when(role == "identifier", F.struct(-F.col("role_confidence"), "pos"))).alias("key_pos"),
    )


def table_name_kind(name: Column) -> Column:
    return (
        F.when(text.has_word(name, V.ORDER_TABLES), "order")
        .when(text.has_word(name, V.CUSTOMER_TABLES), "customer")
        .when(text.has_word(name, V.PRODUCT_TABLES), "product")
    )


def display_name(sheet: Column, kind: Column) -> Column:
    name = text.strip(sheet)
    label = F.create_map(*[F.lit(x) for pair in V.KIND_LABELS.items() for x in pair])[kind]
    return (
        F.when((name == "") | name.rlike(V.DEFAULT_TABLE_NAME), label)
        .when((F.length(name) > 1) & F.endswith(name, F.lit("表")), F.left(name, F.length(name) - 1))
        .otherwise(name)
    )


def infer_entities(fields: DataFrame) -> DataFrame:
    """Kind, key, confidence and signals of every table with columns."""
    c = F.col
    has_id, time, contact = c("has_id"), c("has_time"), c("has_contact")
    attribute, price, flow, quantity = c("has_attribute"), c("has_price"), c("has_flow"), c("has_quantity")
    strong = F.when(
        has_id,
        F.when(time & flow, "order").when(~time & (price | attribute), "product")
        .when(~time & ~flow & contact, "customer"),
    )
    part = has_id & (time | (flow & quantity))
    party = has_id & ~time & ~flow & ~price & c("has_party_name")
    weak = F.when(c("strong").isNull(), F.when(part, "order").when(party, "customer"))
    named, kind = c("name_kind"), F.coalesce("name_kind", "strong", "weak", F.lit("unknown"))
    conflict = named.isNotNull() & c("strong").isNotNull() & (c("strong") != named)
    by_name = F.when(conflict, 0.61).otherwise(0.95)
    confidence = (
        F.when(named.isNotNull(), F.when(c("key_field").isNull(), F.least(by_name, F.lit(0.75))).otherwise(by_name))
        .when(c("strong").isNotNull(), 0.85)
        .when(c("weak") == "order", 0.75).when(c("weak").isNotNull(), 0.70).otherwise(0.5)
    )
    no = lambda x: F.coalesce(x, F.lit(False))
    by_shape = named.isNull()
    signals = F.array_compact(F.array(
        F.concat(F.lit("name_keyword:"), named),
        F.when(no(conflict), F.concat(F.lit("structure_suggests:"), c("strong"))),
        F.when(no(conflict), F.lit("name_structure_conflict")),
        F.when(no(c("strong") == named), F.lit("structure_confirmed")),
        F.when(no(~by_shape & c("strong").isNull() & (c("weak") != named)),
               F.concat(F.lit("structure_hint:"), c("weak"))),
        F.when(~by_shape & c("key_field").isNull(), F.lit("no_identifier")),
        F.when(by_shape, F.concat(F.lit("structure:"), c("strong"), F.lit("_strong"))),
        F.when(by_shape, F.concat(F.lit("structure:"), c("weak"), F.lit("_weak"))),
        F.when(by_shape & c("strong").isNull() & c("weak").isNull(), F.lit("no_entity_evidence")),
        F.when(has_id, F.lit("has_identifier")),
        F.when(time, F.lit("has_time_field")),
        F.when(flow, F.lit("has_flow_money")),
        F.when(price, F.lit("has_price_field")),
        F.when(contact, F.lit("has_contact_field")),
        F.when(attribute, F.lit("has_product_attribute")),
        F.when(quantity, F.lit("has_quantity_field")),
        F.when(no(c("weak") == "order"), F.lit("partial_transaction_shape")),
        F.when(no(c("weak") == "customer"), F.lit("party_name_only")),
    ))
    return (
        structure(fields)
        .withColumn("name_kind", table_name_kind(text.strip(c("sheet"))))
        .withColumn("strong", strong).withColumn("weak", weak)
        .select(
            *TABLE, kind.alias("kind"), display_name(c("sheet"), kind).alias("name"),
            "key_field", "key_pos", confidence.alias("confidence"),
            text.needs_review(confidence).alias("needs_review"), signals.alias("signals"),
        )
    )


# --- hints -------------------------------------------------------------------

def merge_field_hints(fields: DataFrame, hints: DataFrame) -> DataFrame:
    """Proposed type and role per column over the inferred ones.

    ``hints``: ``(source_file, sheet, column, type, role, confidence, needs_review, reason,
    enum_values)``. Unknown types and roles fall back to the inferred ones, an enum needs
    1 to 20 values, and a column without a hint keeps its inference with a marker.
    """
    h = hints.select(
        "source_file", F.col("sheet").alias("sheet"), text.strip(F.col("column")).alias("_c"),
        F.col("type").alias("h_type"), F.col("role").alias("h_role"),
        F.col("confidence").alias("h_confidence"), F.col("needs_review").alias("h_review"),
        F.col("reason").alias("h_reason"), F.col("enum_values").alias("h_values"),
    ).dropDuplicates(["source_file", "sheet", "_c"])
    joined = fields.withColumn("_c", text.strip(F.col("column"))).join(
        h, ["source_file", "sheet", "_c"], "left"
    )
    given = F.col("h_confidence").isNotNull()
    values = F.coalesce("h_values", F.array().cast("array<string>"))
    real = F.array_distinct(F.filter(F.transform(values, text.strip), lambda v: v != ""))
    viable = (F.size(real) > 0) & (F.size(real) <= V.ENUM_MAX_DISTINCT)
    asked = F.when(F.col("h_type").isin(*V.FIELD_TYPES), F.col("h_type")).otherwise(F.col("type"))
    role = F.when(F.col("h_role").isin(*V.FIELD_ROLES), F.col("h_role")).otherwise(F.col("role"))
    weak_enum = (asked == "enum") & ~viable
    kind = F.when(weak_enum, "string").otherwise(asked)
    role = F.when(weak_enum & (role == "enum"), "dimension").otherwise(role)
    review = F.coalesce("h_review", F.lit(False)) | text.needs_review(F.col("h_confidence"))
    reason = F.when(F.length("h_reason") > 0, F.concat(F.lit("hint_reason:"), F.left("h_reason", F.lit(80))))
    pick = lambda new, old: F.when(given, new).otherwise(F.col(old)).alias(old)
    merged = {
        "type": pick(kind, "type"),
        "role": pick(role, "role"),
        "confidence": pick(F.col("h_confidence"), "confidence"),
        "role_confidence": pick(F.col("h_confidence"), "role_confidence"),
        "needs_review": pick(review, "needs_review"),
        "role_needs_review": pick(review, "role_needs_review"),
        "signals": F.when(given, F.array_compact(F.array(F.lit("hint"), reason))).otherwise(
            F.concat("signals", F.array(F.lit("hint:column_fallback")))).alias("signals"),
        "role_signals": pick(F.array(F.lit("hint")), "role_signals"),
        "enum_values": F.when(given, F.when(
            kind == "enum", F.slice(F.array_distinct(values), 1, V.ENUM_MAX_DISTINCT)
        ).otherwise(F.array().cast("array<string>"))).otherwise(F.col("enum_values")).alias("enum_values"),
    }
    return joined.select(*[merged.get(c, F.col(c)) for c in fields.columns])


def pick_keys(fields: DataFrame, counts_or_profiles: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Key column by data: the first candidate present on at least 95 % of the rows.

    Candidates are the proposed column, then identifiers, then all columns in order.
    ``hints``: ``(source_file, sheet, key_field)``.
    """
    proposed = fields.withColumn("proposed", F.lit(None).cast("string"))
    if hints is not None:
        proposed = fields.join(
            hints.select("source_file", "sheet", text.strip(F.col("key_field")).alias("proposed")),
            list(TABLE), "left",
        )
    marked = F.col("role") == "identifier"
    if hints is not None:
        marked = marked & F.array_contains("role_signals", "hint")
    rank = (
        F.when(F.coalesce(F.col("column") == F.col("proposed"), F.lit(False)), 0)
        .when(marked, 1).otherwise(2)
    )
    have = proposed.select(*COLUMN, "column", "proposed", rank.alias("rank")).join(
        presence(counts_or_profiles), list(COLUMN)
    )
    fits = F.col("present") >= V.KEY_MIN_PRESENT
    order = F.when(fits, F.struct("rank", "pos"))
    picked = have.groupBy(*TABLE).agg(
        F.min_by("column", order).alias("key_field"), F.min_by("pos", order).alias("key_pos"),
        F.min_by("distinct", order).alias("distinct"), F.first("proposed").alias("proposed"),
    )
    repeats = F.coalesce(F.col("distinct") < V.KEY_MIN_DISTINCT, F.lit(False))
    return picked.select(
        *TABLE, "key_field", "key_pos", repeats.alias("key_repeats"),
        (F.col("key_field").isNull() | repeats).alias("key_needs_review"),
        F.coalesce((F.col("proposed") != F.col("key_field")) | (
            F.col("proposed").isNotNull() & F.col("key_field").isNull()), F.lit(False)
        ).alias("proposal_replaced"),
    )


def apply_entity_hints(fields: DataFrame, entities: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities as proposed, with keys verified by data and their field made identifier.

    ``hints``: ``(source_file, sheet, position, key, name, key_field, confidence,
    needs_review, reason)``. Returns ``(fields, entities)``.
    """
    keys = pick_keys(fields, fields, hints)
    norm = F.btrim(F.regexp_replace(F.lower(text.strip(F.col("key"))), "[^a-z0-9]+", "_"), F.lit("_"))
    norm = (
        F.when(norm == "", "entity").when(norm.rlike("^[0-9]"), F.concat(F.lit("entity_"), norm)).otherwise(norm)
    )
    named = unique_names(
        hints.withColumn("base", norm), ["source_file"], "position", "base", "final_key"
    ).select(
        "source_file", "sheet", "final_key", F.col("name").alias("h_name"),
        F.col("confidence").alias("h_confidence"), F.col("needs_review").alias("h_review"),
        F.col("reason").alias("h_reason"),
    )
    given = F.col("final_key").isNotNull()
    review = (
        F.coalesce("h_review", F.lit(False)) | text.needs_review(F.col("h_confidence"))
        | F.col("key_needs_review")
    )
    reason = F.when(F.length("h_reason") > 0, F.concat(F.lit("hint_reason:"), F.left("h_reason", F.lit(80))))
    no_key = F.when(F.col("k_field").isNull(), F.lit("no_identifier"))
    joined = entities.join(named, list(TABLE), "left").join(
        keys.withColumnsRenamed({"key_field": "k_field", "key_pos": "k_pos"}), list(TABLE), "left"
    )
    pick = lambda new, old: F.when(given, new).otherwise(F.col(old)).alias(old)
    out = joined.select(
        *TABLE, pick(F.col("final_key"), "kind"),
        pick(F.coalesce(F.nullif(text.strip(F.col("h_name")), F.lit("")), "sheet"), "name"),
        pick(F.col("k_field"), "key_field"), pick(F.col("k_pos"), "key_pos"),
        pick(F.col("h_confidence"), "confidence"), pick(review, "needs_review"),
        pick(F.array_compact(F.array(F.lit("hint"), reason, no_key)), "signals"),
    )
    promote = out.join(named.select(*TABLE), list(TABLE), "left_semi").join(
        keys.select(*TABLE, "key_repeats"), list(TABLE)
    ).select(*TABLE, F.col("key_pos").alias("pos"), "key_repeats")
    hit = F.col("key_repeats").isNotNull()
    moved = hit & (F.col("role") != "identifier")
    repeated = F.coalesce("key_repeats", F.lit(False))
    new = {
        "role": F.when(hit, "identifier").otherwise(F.col("role")).alias("role"),
        "role_signals": F.when(moved, F.array(F.lit("hint:promoted_from_key_field")))
        .otherwise(F.col("role_signals")).alias("role_signals"),
        "needs_review": (F.col("needs_review") | repeated).alias("needs_review"),
        "role_needs_review": (F.col("role_needs_review") | repeated).alias("role_needs_review"),
    }
    promoted = fields.join(promote, list(COLUMN), "left")
    return promoted.select(*[new.get(c, F.col(c)) for c in fields.columns]), out
