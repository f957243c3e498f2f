"""Text cells to typed rows: coercion, enum widening, validation with rejects.

One wide projection per entity, built from its catalog fields. What does not fit never
stops a load: it goes to a rejects table with row, column, value and cause.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.operators.numbering import TABLE, explode_cells
from tablewise.operators.query import Entity, Field
from tablewise.sources.records import SPARK_TYPES, STORED

REJECT = "struct<field:string,value:string,cause:string>"


def enum_value(c: Column, allowed) -> Column:
    """Exact label, else the only label equal without any whitespace, else the cell."""
    if not allowed:
        return c
    return F.when(c.isin(*allowed), c).otherwise(F.coalesce(_only_match(text.compact(c), allowed), c))


def coerce(c: Column, field: Field) -> Column:
    """Typed value of a cell; null for blanks and, in typed columns, for missing markers."""
    cell = text.null_blank(c)
    if field.type == "string":
        return cell
    real = F.when(~text.is_missing(cell), cell)
    if field.type == "phone":
        return real
    if field.type == "enum":
        return enum_value(real, field.values)
    return text.to_date(real) if field.type == "date" else text.to_number(real)


def _staged(rows: DataFrame, fields, positions: dict[str, int]) -> DataFrame:
    """``row_no`` with, per field, the cell (``c_``), its text free of markers (``r_``) and the
    typed value (``v_``). The steps are separate projections so that none is computed twice.
    """
    named = lambda f, p: F.col(f"{p}_{f.key}")
    cells = rows.select("row_no", *[text.null_blank(_cell(positions, f)).alias(f"c_{f.key}") for f in fields])
    real = cells.select("*", *[
        (named(f, "c") if f.type == "string" else F.when(~text.is_missing(named(f, "c")), named(f, "c"))).alias(f"r_{f.key}")
        for f in fields])
    spelled = {"date": text.date_text, "number": text.bare_number, "money": text.bare_number, "enum": text.compact}
    ready = real.select("*", *[
        spelled[f.type](named(f, "r")).alias(f"n_{f.key}") for f in fields if f.type in spelled])

    def value(f: Field) -> Column:
        if f.type == "date":
            return text.parse_date(named(f, "n"))
        if f.type in ("number", "money"):
            return text.parse_number(named(f, "n"))
        return _label(named(f, "r"), named(f, "n"), f.values) if f.type == "enum" else named(f, "r")

    return ready.select("row_no", *[c for f in fields for c in (
        named(f, "c"), named(f, "r"), value(f).alias(f"v_{f.key}"))])


def _label(real: Column, compact: Column, allowed) -> Column:
    """Declared label of a cell, else the cell without its layout whitespace."""
    if not allowed:
        return compact
    return F.when(real.isin(*allowed), real).otherwise(F.coalesce(_only_match(compact, allowed), compact))


def _only_match(compact: Column, allowed) -> Column:
    """The one label equal to a text without whitespace; labels that collapse to the same text
    are ambiguous and match nothing."""
    squeezed = ["".join(v.split()) for v in allowed]
    unique = {s: v for s, v in zip(squeezed, allowed) if squeezed.count(s) == 1}
    if not unique:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in unique.items() for x in p]), compact)


def unseen_labels(rows: DataFrame, entity: Entity, positions: dict[str, int]) -> DataFrame:
    """Labels outside each declared enum, without whitespace, with their first row.

    Only the first 21 unseen labels of a field are kept: with more the field turns into
    text anyway.
    """
    enums = [f for f in entity.fields if f.type == "enum"]
    if not enums:
        return rows.sparkSession.createDataFrame([], "field string, label string, first_row bigint")
    staged = _staged(rows, enums, positions)
    extras = []
    for f in enums:
        c = F.col(f"v_{f.key}")
        known = c.isin(*f.values) if f.values else F.lit(False)
        extras.append(F.struct(F.lit(f.key).alias("field"), F.when(~known, c).alias("label")))
    order = Window.partitionBy("field").orderBy("first_row")
    return (
        staged.select("row_no", F.inline_outer(F.array(*extras))).filter(F.length("label") > 0)
        .groupBy("field", "label").agg(F.min("row_no").alias("first_row"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= V.ENUM_MAX_DISTINCT + 1)
        .drop("rank")
    )


def widen_enums(entity: Entity, rows: DataFrame, positions: dict[str, int]) -> Entity:
    """Entity whose enums include the labels found in the data, in first-seen order.

    An enum that would exceed 20 values becomes text.
    """
    seen: dict[str, list[str]] = {}
    for r in sorted(unseen_labels(rows, entity, positions).collect(), key=lambda r: r["first_row"]):
        seen.setdefault(r["field"], []).append(r["label"])
    return replace(entity, fields=tuple(_widened(f, seen.get(f.key, [])) for f in entity.fields))


# --- all tables of a workbook in one pass ----------------------------------------

def stored_name(key: str, kind: str) -> str:
    """Column of a stored load that holds a field; fields of one key and kind share it over all entities."""
    return f"{key}__{STORED[kind]}"


def typing_spec(spark, placed: list[tuple[str, Entity, dict[str, int]]]) -> tuple[DataFrame, list[str]]:
    """One row per table of ``(sheet, entity, positions)``: its fields, and the slot of every stored column.

    The catalog of one workbook, which the driver holds anyway.
    """
    columns = sorted({stored_name(f.key, f.type) for _, e, _ in placed for f in e.fields})
    rows = []
    for sheet, entity, positions in placed:
        fields = []
        for f in entity.fields:
            squeezed = ["".join(v.split()) for v in f.values]
            only = [s if squeezed.count(s) == 1 else None for s in squeezed]  # labels alike without blanks match nothing
            fields.append((positions[f.key], f.key, f.type, list(f.values), only, f.key == entity.key_field))
        at = {stored_name(f.key, f.type): k for k, f in enumerate(entity.fields)}
        rows.append((sheet, entity.key, fields, [at.get(c) for c in columns]))
    kind = "array<struct<pos:int,key:string,type:string,values:array<string>,only:array<string>,is_key:boolean>>"
    return spark.createDataFrame(rows, f"sheet string, entity string, spec {kind}, slots array<int>"), columns


def _typed_cells() -> Column:
    """Per field of ``spec``: cell, text, number, date and the cause of a reject."""
    kind = lambda x: x["s"]["type"]
    numeric = lambda x: kind(x).isin("number", "money")
    cell = F.transform("spec", lambda s: F.struct(s.alias("s"), text.null_blank(F.get("cells", s["pos"])).alias("cell")))
    real = F.transform(cell, lambda x: F.struct(
        x["s"].alias("s"), x["cell"].alias("cell"),
        F.when((kind(x) == "string") | ~text.is_missing(x["cell"]), x["cell"]).alias("real")))
    ready = F.transform(real, lambda x: F.struct(
        x["s"].alias("s"), x["cell"].alias("cell"), x["real"].alias("real"),
        F.when(numeric(x), text.bare_number(x["real"])).when(kind(x) == "date", text.date_text(x["real"]))
        .when(kind(x) == "enum", text.compact(x["real"])).alias("plain")))

    def label(x):
        near = F.array_position(x["s"]["only"], x["plain"])
        return F.when(F.array_contains(x["s"]["values"], x["real"]), x["real"]).when(
            near > 0, F.get(x["s"]["values"], (near - 1).cast("int"))).otherwise(x["plain"])

    value = F.transform(ready, lambda x: F.struct(
        x["s"].alias("s"), x["cell"].alias("cell"), x["real"].alias("real"),
        F.when(kind(x) == "enum", label(x)).when(kind(x).isin("string", "phone"), x["real"]).alias("text"),
        F.when(numeric(x), text.parse_number(x["plain"])).alias("number"),
        F.when(kind(x) == "date", text.parse_date(x["plain"])).alias("date")))
    return F.transform(value, lambda x: F.struct(
        x["s"]["key"].alias("key"), x["cell"].alias("cell"), x["text"].alias("text"), x["number"].alias("number"), x["date"].alias("date"),
        F.when(numeric(x) & x["real"].isNotNull() & x["number"].isNull(), "not a number")
        .when((kind(x) == "date") & x["real"].isNotNull() & x["date"].isNull(), "not a date")
        .when((kind(x) == "enum") & x["text"].isNotNull() & ~F.array_contains(x["s"]["values"], x["text"]), "not a declared value").alias("cause"),
        F.when(x["s"]["is_key"] & x["real"].isNull(), "key is empty").alias("no_key")))


def typed_tables(rows: DataFrame, placed: list[tuple[str, Entity, dict[str, int]]]) -> DataFrame:
    """Typed rows of all tables of one workbook from one scan: ``(entity, state, row_no, <stored columns>, errors)``.

    The rows are not taken apart: the cells of a row are typed side by side by the fields of its table. ``state``
    is ``good``, or ``bad`` for a row with errors; blank rows are dropped. The same values and causes as
    ``typed_rows`` gives for each table.
    """
    spec, columns = typing_spec(rows.sparkSession, placed)
    typed = rows.join(F.broadcast(spec), "sheet").select("entity", "row_no", "slots", _typed_cells().alias("typed"))
    errors = F.flatten(F.transform("typed", lambda x: F.array_compact(F.array(
        F.when(x["cause"].isNotNull(), F.struct(x["key"].alias("field"), x["cell"].alias("value"), x["cause"].alias("cause"))),
        F.when(x["no_key"].isNotNull(), F.struct(x["key"].alias("field"), x["cell"].alias("value"), x["no_key"].alias("cause")))))))
    # Most rows are sound, and only the others have their errors gathered.
    broken = F.exists("typed", lambda x: x["cause"].isNotNull() | x["no_key"].isNotNull())
    filled = F.exists("typed", lambda x: x["cell"].isNotNull())
    row = F.struct("entity", "row_no", "slots", "typed", F.when(broken, errors).otherwise(
        F.array().cast(f"array<{REJECT}>")).alias("errors"))
    # Through a generator, so that later projections do not type the cells again.
    made = typed.select(F.inline_outer(F.array(F.when(filled, row)))).filter(F.col("row_no").isNotNull())
    return made.select(
        "entity", F.when(F.size("errors") == 0, "good").otherwise("bad").alias("state"), "row_no",
        *[F.get("typed", F.get("slots", F.lit(k)))[c.rsplit("__", 1)[1]].alias(c) for k, c in enumerate(columns)], "errors")


def _distinct_cells(rows: DataFrame, spec: DataFrame, width: int) -> DataFrame:
    """``(entity, row_no, cells, spec)`` with one field each: every distinct cell and the first row that has it."""
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.get("cells", F.get("spec", F.lit(k))["pos"]).alias("cell"))
                      for k in range(width)])
    cells = rows.join(F.broadcast(spec), "sheet").select("sheet", "row_no", F.inline(slots)).filter(
        F.col("cell").isNotNull()).groupBy("sheet", "slot", "cell").agg(F.min("row_no").alias("row_no"))
    return cells.join(F.broadcast(spec), "sheet").select(
        "entity", "row_no", F.array("cell").alias("cells"),
        F.array(F.get("spec", F.col("slot")).withField("pos", F.lit(0))).alias("spec"))


def widen_tables(rows: DataFrame, placed: list[tuple[str, Entity, dict[str, int]]]) -> list[tuple[str, Entity, dict[str, int]]]:
    """``widen_enums`` for all tables of a workbook from one scan; at most 21 labels of a field reach the driver.

    Equal cells of a field are one before they are compared with its labels.
    """
    narrow = [(s, replace(e, fields=tuple(f for f in e.fields if f.type == "enum")), p) for s, e, p in placed]
    narrow = [x for x in narrow if x[1].fields]
    if not narrow:
        return placed
    spec, _ = typing_spec(rows.sparkSession, narrow)
    typed = _distinct_cells(rows, spec, max(len(e.fields) for _, e, _ in narrow)).select("entity", "row_no", F.inline(F.filter(
        _typed_cells(), lambda x: x["cause"].isNotNull() & (F.length(x["text"]) > 0))))
    order = Window.partitionBy("entity", "key").orderBy("first_row", "text")
    fresh = typed.groupBy("entity", "key", "text").agg(F.min("row_no").alias("first_row")).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= V.ENUM_MAX_DISTINCT + 1)
    seen: dict[tuple[str, str], list[str]] = {}
    for r in fresh.orderBy("entity", "key", "rank").collect():
        seen.setdefault((r["entity"], r["key"]), []).append(r["text"])
    return [(s, replace(e, fields=tuple(_widened(f, seen.get((e.key, f.key), [])) for f in e.fields)), p) for s, e, p in placed]


def _widened(f: Field, fresh: list[str]) -> Field:
    merged = tuple(dict.fromkeys([*f.values, *fresh]))
    if f.type != "enum" or merged == f.values:
        return f
    if len(merged) <= V.ENUM_MAX_DISTINCT:
        return replace(f, values=merged)
    return replace(f, type="string", role="dimension" if f.role == "enum" else f.role, values=())


def widened_labels(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """The same widening for any number of fields at once, as tables.

    ``declared (entity, field, ord, label)``; ``observed (entity, field, label, first_row)``.
    Gives ``(entity, field, type, label_count, labels)``.
    """
    key = ["entity", "field"]
    fresh = observed.join(declared.select(*key, "label"), [*key, "label"], "left_anti").groupBy(
        *key, "label").agg(F.min("first_row").alias("at"))
    order = Window.partitionBy(*key).orderBy("at", "label")
    counts = declared.select(*key).union(fresh.select(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("label_count"))
    fresh = fresh.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= V.ENUM_MAX_DISTINCT + 1)
    both = declared.select(*key, F.lit(0).alias("late"), F.col("ord").cast("bigint").alias("at"), "label").unionByName(
        fresh.select(*key, F.lit(1).alias("late"), F.col("rank").cast("bigint").alias("at"), "label"))
    merged = both.groupBy(*key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("late", "at", "label"))), lambda s: s["label"]).alias("labels")).join(counts, key)
    wide = F.col("label_count") > V.ENUM_MAX_DISTINCT
    return merged.select(
        *key, F.when(wide, "string").otherwise("enum").alias("type"), "label_count",
        F.when(~wide, F.col("labels")).alias("labels"))


def _cell(positions: dict[str, int], field: Field) -> Column:
    return F.get("cells", F.lit(positions[field.key]))


def typed_rows(rows: DataFrame, entity: Entity, positions: dict[str, int]) -> DataFrame:
    """Wide typed rows with their errors: ``(row_no, <fields>, errors)``.

    ``positions`` maps field keys to cell positions. Blank rows are dropped.
    """
    staged = _staged(rows, entity.fields, positions)
    filled = text.any_of(F.col(f"c_{f.key}").isNotNull() for f in entity.fields)
    errors = []
    for f in entity.fields:
        cell, real, value = (F.col(f"{p}_{f.key}") for p in "crv")
        cause = None
        if f.type in ("number", "money", "date"):
            kind = "date" if f.type == "date" else "number"
            cause = F.when(real.isNotNull() & value.isNull(), f"not a {kind}")
        elif f.type == "enum":
            known = value.isin(*f.values) if f.values else F.lit(False)
            cause = F.when(value.isNotNull() & ~known, "not a declared value")
        if cause is not None:
            errors.append(_error(f.key, cell, cause))
        if f.key == entity.key_field:
            errors.append(_error(f.key, cell, F.when(real.isNull(), "key is empty")))
    row = F.struct(
        "row_no", *[F.col(f"v_{f.key}").alias(f.key) for f in entity.fields],
        F.array_compact(F.array(*errors)).alias("errors"))
    # Rows leave through a generator: later filters on values or errors then stay above it,
    # where a plain projection would let them sink and repeat every conversion inside them.
    return staged.select(F.inline_outer(F.array(F.when(filled, row)))).filter(F.col("row_no").isNotNull())


def _error(key: str, value: Column, cause: Column) -> Column:
    return F.when(cause.isNotNull(), F.struct(
        F.lit(key).alias("field"), value.cast("string").alias("value"), cause.alias("cause")))


def split_rows(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and one reject per broken cell of the others."""
    good = checked.filter(F.size("errors") == 0).drop("errors")
    rejects = checked.select("row_no", F.explode("errors").alias("e")).select("row_no", "e.*")
    return good, rejects


def validate(df: DataFrame, entity: Entity, control: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows with an ``errors`` array: key present, enum membership, known types, no
    unknown fields. ``control`` names columns that are not part of the row."""
    errors = []
    known = {f.key for f in entity.fields}
    for name in df.columns:
        if name not in known and name not in control:
            errors.append(_error(name, text.as_text(df, name), F.lit("unknown field")))
    for f in entity.fields:
        if f.key not in df.columns:
            continue
        c, shown = F.col(f.key), text.as_text(df, f.key)
        have, want = df.schema[f.key].dataType.simpleString(), SPARK_TYPES[f.type]
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
        fits = have == want or (want == "double" and (have in numeric or have.startswith("decimal")))
        if not fits:
            iso = want == "date" and have == "string"
            bad = c.try_cast("date").isNull() | ~c.rlike(r"^\d{4}-\d{2}-\d{2}$") if iso else F.lit(True)
            errors.append(_error(f.key, shown, F.when(c.isNotNull() & bad, f"not a {f.type}")))
        if f.type == "enum" and fits:
            ok = c.isin(*f.values) if f.values else F.lit(False)
            errors.append(_error(f.key, shown, F.when(c.isNotNull() & ~ok, "not a declared value")))
    if entity.key_field in df.columns:
        blank = text.is_blank(text.as_text(df, entity.key_field))
        errors.append(_error(entity.key_field, F.lit(None).cast("string"), F.when(blank, "key is empty")))
    else:
        errors.append(_error(entity.key_field, F.lit(None).cast("string"), F.lit("key is empty")))
    return df.withColumn("errors", F.array_compact(F.array(*errors)))


def coerce_long(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Typed cells of all tables in one job: ``(table, row_no, field_key, type, text, number,
    date, error)``. ``fields`` carry ``(table, pos, field_key, type, values)``."""
    cells = explode_cells(rows, *TABLE, "row_no").join(
        fields.select(*TABLE, "pos", "field_key", "type", "values"), [*TABLE, "pos"])
    cell = text.null_blank(F.col("value"))
    real = F.when((F.col("type") == "string") | ~text.is_missing(cell), cell)
    kind = F.col("type")
    same = F.filter("values", lambda v: text.compact(v) == text.compact(F.col("real")))
    label = F.when(F.array_contains("values", F.col("real")), F.col("real")).when(
        F.size(same) == 1, F.get(same, F.lit(0))).otherwise(text.compact(F.col("real")))
    return (
        cells.withColumn("real", real)
        .withColumn("text", F.when(kind == "enum", label).when(kind.isin("string", "phone"), F.col("real")))
        .withColumn("number", F.when(kind.isin("number", "money"), text.to_number(F.col("real"))))
        .withColumn("date", F.when(kind == "date", text.to_date(F.col("real"))))
        .withColumn("error", F.when(kind.isin("number", "money") & F.col("real").isNotNull() & F.col("number").isNull(), "not a number")
                    .when((kind == "date") & F.col("real").isNotNull() & F.col("date").isNull(), "not a date")
                    .when((kind == "enum") & F.col("real").isNotNull()
                          & ~F.coalesce(F.array_contains("values", F.col("text")), F.lit(False)), "not a declared value"))
        .select(*TABLE, "row_no", "field_key", "type", "text", "number", "date", "error")
    )
