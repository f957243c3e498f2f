"""The catalog of a corpus: entities, fields, links, metrics, default queries and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.operators.numbering import TABLE
from tablewise.operators.profile import COLUMN

KEY_PATTERN = r"^[a-z][a-z0-9_]*$"
ENTITY = ("source_file", "entity")
ROLE_ORDER = ("time", "measure", "dimension", "enum", "identifier", "text")  # fixed value


def unique_names(df: DataFrame, scope: list[str], order: str, base: str, into: str) -> DataFrame:
    """Suffix repeated names ``_2``, ``_3`` ... in order, never reusing a taken name.

    Repeats are ranked. Only where a name is spelled like the numbered form of another, repeated one can
    two meet; the names of such a family are then dealt one after the other.
    """
    place = F.row_number().over(Window.partitionBy(*scope, base).orderBy(order))
    ranked = df.withColumn("_place", place).withColumn(
        into, F.when(F.col("_place") > 1, F.concat_ws("_", F.col(base), F.col("_place").cast("string"))).otherwise(F.col(base)))
    root = F.regexp_replace(F.col(base), r"(_[0-9]+)+$", "")
    rooted = ranked.withColumn("_root", root)
    # A family can have a collision if one of its names repeats and another has a number.
    risky = rooted.groupBy(*scope, "_root").agg(F.max("_place").alias("m"), F.bool_or(F.col(base) != F.col("_root")).alias("numbered")).filter(
        (F.col("m") > 1) & F.col("numbered")).select(*scope, "_root")
    marked = rooted.join(risky.withColumn("_risky", F.lit(True)), [*scope, "_root"], "left")
    columns = [*df.columns, into]
    family = marked.filter("_risky").select(*scope, "_root", order, base)
    kind = family.schema[order].dataType.simpleString()
    dealt = family.groupBy(*scope, "_root").applyInPandas(
        _dealt(scope, order, base), ", ".join(f"{c} string" for c in scope) + f", _order {kind}, _name string")
    renamed = marked.filter("_risky").join(dealt.withColumnRenamed("_order", order), [*scope, order])
    return marked.filter("_risky is null").select(*columns).unionByName(
        renamed.drop(into).withColumnRenamed("_name", into).select(*columns))


def _dealt(scope: list[str], order: str, base: str):
    def run(rows):
        rows = rows.sort_values(order)
        used, next_place, names = set(), {}, []
        for name in rows[base]:
            chosen = name
            if name in used:
                n = next_place.get(name, 2)
                while f"{name}_{n}" in used:
                    n += 1
                chosen, next_place[name] = f"{name}_{n}", n + 1
            used.add(chosen)
            names.append(chosen)
        return rows[scope].assign(_order=rows[order], _name=names)

    return run


def field_keys(columns: DataFrame) -> DataFrame:
    """Stable key of every column: glossary name, else ``field_<n>``, unique per table."""
    name = text.strip(F.col("column"))
    words = F.create_map(*[F.lit(x) for pair in V.FIELD_KEYS.items() for x in pair])
    known = F.coalesce(F.try_element_at(words, name), F.try_element_at(words, F.lower(name)))
    based = columns.select(*COLUMN, "column").withColumn(
        "base", F.coalesce(known, F.concat(F.lit("field_"), (F.col("pos") + 1).cast("string")))
    ).withColumn("known", known.isNotNull())
    keyed = unique_names(based, list(TABLE), "pos", "base", "field_key")
    return keyed.select(
        *COLUMN, "column", "field_key",
        (F.col("known") & (F.col("field_key") == F.col("base"))).alias("glossary_hit"),
    )


def exclusions(entities: DataFrame) -> DataFrame:
    """Tables left out of the catalog, with the reason."""
    reason = (
        F.when(F.col("kind") == "unknown", "unknown kind").when(F.col("key_field").isNull(), "no key column")
    )
    return entities.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*TABLE, "reason")


def build_plans(entities: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Eligible tables with a unique entity key per workbook.

    ``positions (source_file, sheet, position)`` gives the order of the tables in their workbook; those that
    are not listed come last, by name.
    """
    fit = entities.filter((F.col("kind") != "unknown") & F.col("key_field").isNotNull())
    place = F.lit(None).cast("bigint")
    if positions is not None:
        fit = fit.join(positions.select(*TABLE, F.col("position").cast("bigint").alias("_at")), list(TABLE), "left")
        place = F.col("_at")
    fit = fit.withColumn("position", F.struct(place.isNull().alias("unlisted"), place.alias("at"), F.col("sheet").alias("sheet")))
    fit = fit.withColumn("position", F.row_number().over(Window.partitionBy("source_file").orderBy("position"))).drop("_at")
    return unique_names(fit, ["source_file"], "position", "kind", "entity")


def build_fields(plans: DataFrame, fields: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """Catalog fields: joint confidence, enum fallback, link columns always under review."""
    children = links.groupBy("source_file", F.col("child").alias("sheet"), "pos").agg(
        F.max(F.array_contains("signals", "same_field_name")).alias("same_name")
    )
    fk = F.col("same_name").isNotNull()
    bare = (F.col("type") == "enum") & (F.size("enum_values") == 0)
    kind = F.when(bare, "string").otherwise(F.col("type"))
    joint = F.least("confidence", "role_confidence")
    confidence = F.when(fk, F.lit(V.FOREIGN_KEY_CONFIDENCE)).otherwise(joint)
    return (
        fields.join(plans.select(*TABLE, "entity", "key_pos"), list(TABLE))
        .join(keys.select(*COLUMN, "field_key"), list(COLUMN))
        .join(children, list(COLUMN), "left")
        .select(
            *COLUMN, "entity", "field_key", "column", kind.alias("type"), "role",
            confidence.alias("confidence"), (fk | text.needs_review(confidence)).alias("needs_review"),
            F.when(F.col("same_name"), "same name, no foreign key in the source")
            .when(fk, "matches the parent table, no foreign key in the source").alias("review_reason"),
            F.when(kind == "enum", F.col("enum_values")).alias("values"),
            (F.col("pos") == F.col("key_pos")).alias("is_key"),
        )
    )


def build_entities(plans: DataFrame, fields: DataFrame) -> DataFrame:
    key = fields.filter("is_key").select(*TABLE, F.col("field_key").alias("key_field_key"))
    return plans.join(key, list(TABLE)).select(
        *TABLE, "entity", "name", "kind", "key_field_key", "key_pos", "confidence", "needs_review", "signals"
    )


def build_links(links: DataFrame, plans: DataFrame, keys: DataFrame) -> DataFrame:
    """Links by entity and field keys."""
    e = plans.select(*TABLE, "entity")
    k = keys.select(*COLUMN, "field_key")
    side = lambda df, sheet, pos, ent, fld: df.join(
        e.withColumnsRenamed({"sheet": sheet, "entity": ent}), ["source_file", sheet]
    ).join(k.withColumnsRenamed({"sheet": sheet, "pos": pos, "field_key": fld}), ["source_file", sheet, pos])
    both = side(links.drop("on_from", "on_to"), "parent", "parent_pos", "from_entity", "on_from")
    both = side(both, "child", "pos", "to_entity", "on_to")
    return both.withColumn("key", F.concat_ws("_to_", "from_entity", "to_entity")).withColumn(
        "type", F.lit("one_to_many")
    )


def metric_definitions(hints: DataFrame, plans: DataFrame, keys: DataFrame) -> DataFrame:
    """Usable proposed definitions, the first per metric.

    ``hints``: ``(source_file, position, sheet, op, field, definition, confidence)``. A
    definition that claims to count distinct values is refused, as no metric does.
    """
    body = text.strip(F.col("definition"))
    honest = F.regexp_replace(body, "不(?:做|进行|需|用|会)?去重|不重复计数", "")
    claims = honest.rlike(r"(?i)去重|唯一值?计数|count\s+distinct|distinct")
    op = F.lower(text.strip(F.col("op")))
    usable = hints.select(
        "source_file", "position", text.strip(F.col("sheet")).alias("_s"), op.alias("op"),
        F.when(op == "sum", text.strip(F.col("field"))).alias("column"),
        F.when(F.length(body) > V.DEFINITION_CHARS, F.concat(F.left(body, F.lit(V.DEFINITION_CHARS)), F.lit("…")))
        .otherwise(body).alias("definition"),
        F.col("confidence").alias("definition_confidence"), claims.alias("claims"),
    ).filter(F.col("op").isin("count", "sum") & (F.length("definition") > 0) & ~F.col("claims"))
    placed = usable.join(
        plans.select(*TABLE, "entity", text.strip(F.col("sheet")).alias("_s")), ["source_file", "_s"]
    ).join(keys.select(*TABLE, F.col("column"), "field_key"), [*TABLE, "column"], "left").filter(
        (F.col("op") == "count") | F.col("field_key").isNotNull()
    )
    best = placed.groupBy(*ENTITY, "op", F.coalesce("field_key", F.lit("")).alias("field")).agg(
        F.min_by(F.struct("definition", "definition_confidence"), "position").alias("d")
    )
    return best.select(*ENTITY, "op", "field", "d.definition", "d.definition_confidence")


def build_metrics(plans: DataFrame, fields: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """A count per entity and a sum per money measure that is not a price."""
    names = plans.select(*TABLE, "entity", "name", "position")
    counts = names.select(
        *ENTITY, "position", F.lit(-1).alias("pos"), F.lit("count").alias("op"), F.lit("").alias("field"),
        F.concat_ws("_", "entity", F.lit("count")).alias("base"), F.col("name").alias("subject"),
        F.concat("name", F.lit("总数")).alias("name"),
    )
    summed = fields.filter(
        (F.col("type") == "money") & (F.col("role") == "measure") & ~text.has_word(F.col("column"), V.PRICE_NAMES)
    ).join(names, [*TABLE, "entity"]).select(
        *ENTITY, "position", "pos", F.lit("sum").alias("op"), F.col("field_key").alias("field"),
        F.concat_ws("_", F.lit("total"), "field_key").alias("base"), F.col("column").alias("subject"),
        F.concat("column", F.lit("合计")).alias("name"),
    )
    both = counts.unionByName(summed)
    # A repeated key takes its entity in front; the tables' order in the workbook decides.
    order = Window.partitionBy("source_file", "base").orderBy("position", "pos")
    both = both.withColumn("repeat", F.row_number().over(order) > 1).withColumn(
        "key", F.when(F.col("repeat") & (F.col("op") == "count"), F.concat_ws("_", "entity", F.lit("record_count")))
        .when(F.col("repeat"), F.concat_ws("_", "entity", "base")).otherwise(F.col("base"))
    )
    if definitions is None:
        both = both.withColumns({"definition": F.lit(None).cast("string"),
                                 "definition_confidence": F.lit(None).cast("double")})
    else:
        both = both.join(definitions, [*ENTITY, "op", "field"], "left")
    own = F.when(F.col("op") == "count", F.concat(F.lit("rows of "), "subject")).otherwise(
        F.concat(F.lit("sum of "), "subject"))
    given = F.col("definition").isNotNull()
    confidence = F.coalesce("definition_confidence", F.when(
        F.col("op") == "count", V.COUNT_METRIC_CONFIDENCE).otherwise(V.SUM_METRIC_CONFIDENCE))
    return both.select(
        *ENTITY, "key", "name", "op", F.nullif(F.col("field"), F.lit("")).alias("field"),
        F.coalesce("definition", own).alias("business_definition"), confidence.alias("confidence"),
        text.needs_review(confidence).alias("needs_review"),
        F.when(given & text.needs_review(confidence), "proposed definition")
        .when(~given & (F.col("op") == "sum"), "definition derived from the column name").alias("review_reason"),
    )


def default_queries(fields: DataFrame) -> DataFrame:
    """Columns, search, filters and sort of each entity's first list."""
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(ROLE_ORDER) for x in (r, i)])
    rank = F.when(F.col("is_key"), -1).when(F.col("type") == "phone", 4).otherwise(
        F.coalesce(F.try_element_at(ranks, F.col("role")), F.lit(5)))
    pick = lambda cond, o: F.transform(F.array_sort(F.collect_list(F.when(
        cond, F.struct(o, F.col("field_key").alias("k"))))), lambda s: s["k"])
    phone = F.col("type") == "phone"
    filtered = ~F.col("is_key") & ((F.col("type") == "enum") | (F.col("role") == "dimension"))
    at = F.struct(F.when(F.col("is_key"), -1).otherwise(F.col("pos")).alias("a"))
    return fields.groupBy(*TABLE, "entity").agg(
        F.slice(pick(F.lit(True), F.struct(rank.alias("a"), F.col("pos").alias("b"))), 1, V.MAX_LIST_COLUMNS).alias("columns"),
        pick(F.col("is_key"), at).alias("_key"), pick(phone, F.struct(F.col("pos").alias("a"))).alias("_phones"),
        F.slice(pick(filtered, F.struct(F.col("pos").alias("a"))), 1, V.MAX_FILTERS).alias("filters"),
        F.min_by("field_key", F.when(F.col("role") == "time", F.col("pos"))).alias("sort_field"),
    ).select(
        *TABLE, "entity", "columns", F.concat("_key", "_phones").alias("search"), "filters", "sort_field",
        F.when(F.col("sort_field").isNotNull(), "desc").alias("sort_dir"),
    )


# --- checks ------------------------------------------------------------------

def catalog_errors(entities: DataFrame, fields: DataFrame, links: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every broken rule as ``(source_file, item, error)``; empty for a sound catalog.

    ``entities (source_file, entity, key_field)``, ``fields (source_file, entity, field_key, type,
    values)``, ``links (source_file, key, from_entity, to_entity, on_from, on_to)``,
    ``metrics (source_file, key, entity, op, field)``.
    """
    def out(df: DataFrame, item: Column, error: str) -> DataFrame:
        return df.select("source_file", item.alias("item"), F.lit(error).alias("error"))

    def repeated(df: DataFrame, keys: list[str], error: str) -> DataFrame:
        many = df.groupBy("source_file", *keys).count().filter(F.col("count") > 1)
        return out(many, F.concat_ws(".", *keys), error)

    ents = entities.select("source_file", "entity").distinct()
    cols = fields.select("source_file", "entity", "field_key").distinct()

    def unknown_entity(df: DataFrame, entity: str, error: str) -> DataFrame:
        return out(df.join(ents.withColumnRenamed("entity", entity), ["source_file", entity], "left_anti"),
                   F.col("key"), error)

    def unknown_field(df: DataFrame, entity: str, name: str, error: str) -> DataFrame:
        owned = df.join(ents.withColumnRenamed("entity", entity), ["source_file", entity], "left_semi")
        right = cols.withColumnsRenamed({"entity": entity, "field_key": name})
        return out(owned.filter(F.col(name).isNotNull()).join(right, ["source_file", entity, name], "left_anti"),
                   F.col("key"), error)

    bad = lambda c: ~F.coalesce(F.col(c).rlike(KEY_PATTERN), F.lit(False))
    named = fields.withColumn("item", F.concat_ws(".", "entity", "field_key"))
    declared = F.coalesce(F.size("values") > 0, F.lit(False))
    own_key = entities.join(
        cols.withColumnRenamed("field_key", "key_field"), ["source_file", "entity", "key_field"], "left_anti")
    checks = [
        repeated(entities, ["entity"], "duplicate entity key"),
        repeated(fields, ["entity", "field_key"], "duplicate field key"),
        repeated(links, ["key"], "duplicate link key"),
        repeated(metrics, ["key"], "duplicate metric key"),
        out(entities.filter(bad("entity")), F.col("entity"), "bad entity key"),
        out(named.filter(bad("field_key")), F.col("item"), "bad field key"),
        out(links.filter(bad("key")), F.col("key"), "bad link key"),
        out(metrics.filter(bad("key")), F.col("key"), "bad metric key"),
        out(own_key, F.col("entity"), "key field is not a field"),
        out(named.filter((F.col("type") == "enum") & ~declared), F.col("item"), "enum without values"),
        out(named.filter((F.col("type") != "enum") & F.col("values").isNotNull()), F.col("item"), "values without enum"),
        unknown_entity(links, "from_entity", "link from unknown entity"),
        unknown_entity(links, "to_entity", "link to unknown entity"),
        unknown_field(links, "from_entity", "on_from", "link from unknown field"),
        unknown_field(links, "to_entity", "on_to", "link to unknown field"),
        unknown_entity(metrics, "entity", "metric of unknown entity"),
        unknown_field(metrics, "entity", "field", "metric of unknown field"),
        out(metrics.filter((F.col("op") != "count") & F.col("field").isNull()), F.col("key"), "metric without field"),
    ]
    found = checks[0]
    for check in checks[1:]:
        found = found.unionByName(check)
    return found


def review_queue(
    entities: DataFrame, fields: DataFrame, metrics: DataFrame, links: DataFrame,
    acknowledged: DataFrame | None = None, decided: DataFrame | None = None,
) -> DataFrame:
    """Everything still waiting for a decision as ``(source_file, item)``."""
    flagged = lambda df: df.filter("needs_review")
    pick = lambda df, kind, ack: flagged(df).select(
        "source_file", F.concat(F.lit(f"{kind}:"), ack).alias("item"),
        (F.concat(F.lit("metric:"), ack) if kind == "metric" else ack).alias("id"))
    open_items = (
        pick(entities, "entity", F.col("entity"))
        .unionByName(pick(fields, "field", F.concat_ws(".", "entity", "field_key")))
        .unionByName(pick(metrics, "metric", F.col("key")))
    )
    if acknowledged is not None:
        open_items = open_items.join(acknowledged.select("source_file", "id"), ["source_file", "id"], "left_anti")
    relations = links if decided is None else links.join(decided, ["source_file", "key"], "left_anti")
    return open_items.select("source_file", "item").unionByName(
        relations.select("source_file", F.concat(F.lit("relation:"), "key").alias("item"))
    )
