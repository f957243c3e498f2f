"""The whole typed load of a workbook: decisions, catalog, rows, one commit point.

All tables are typed in one pass and written to a folder of the load, whose id no other load has.
The version row, which names the load, is appended last. Readers reach rows only through a version
row, so a load that fails midway leaves nothing visible, and two loads at a time cannot mix.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators import catalog, links, load, versions
from tablewise.operators.query import Entity, Field
from tablewise.plans.understand import Corpus
from tablewise.session import materialize
from tablewise.sources import records


class ConfirmError(ValueError):
    def __init__(self, message: str, unresolved: list[str] | None = None) -> None:
        super().__init__(message)
        self.unresolved = unresolved or []


@dataclass(frozen=True)
class Loaded:
    version: int
    load: str
    entities: list[Entity]
    counts: dict[str, int]
    rejects: dict[str, int]


def _items(df: DataFrame, column: str) -> list[str]:
    """All items of one workbook's list."""
    return [r[0] for r in df.select(column).orderBy(column).collect()]


def catalog_entities(cat: dict[str, DataFrame]) -> list[tuple[str, Entity, dict[str, int]]]:
    """Catalog rows of one workbook as ``(sheet, entity, cell positions)``."""
    keys = {r["entity"]: (r["sheet"], r["key_field_key"]) for r in cat["entities"].collect()}
    fields: dict[str, list] = {}
    for r in cat["fields"].orderBy("entity", "pos").collect():
        fields.setdefault(r["entity"], []).append(r)
    out = []
    for name, (sheet, key) in sorted(keys.items()):
        listed = tuple(Field(r["field_key"], r["type"], r["role"], r["column"], tuple(r["values"] or ())) for r in fields[name])
        out.append((sheet, Entity(name, key, listed), {r["field_key"]: r["pos"] for r in fields[name]}))
    return out


def snapshot(spark, entities: list[Entity], names: dict[str, str], cat: dict[str, DataFrame], app: str, source: str, load_id: str) -> DataFrame:
    """One snapshot row ``(app_key, snapshot, ...)`` built from the catalog."""
    ents = [
        (e.key, names.get(e.key, e.key), e.key_field, [(f.key, f.name, f.type, f.role, list(f.values) or None) for f in e.fields])
        for e in entities
    ]
    kind = f"key string, name string, key_field string, fields array<{versions.FIELD}>"
    ents = spark.createDataFrame(ents, kind).agg(F.collect_list(F.struct("*")).alias("entities"))
    ls = cat["links"].agg(F.collect_list(F.struct(
        "key", F.col("from_entity").alias("from"), F.col("to_entity").alias("to"), "on_from", "on_to")).alias("links"))
    ms = cat["metrics"].agg(F.collect_list(F.struct(
        "key", "name", "entity", "op", "field", "business_definition")).alias("metrics"))
    # Three one-row tables side by side.
    one = lambda df: df.withColumn("one", F.lit(1))
    row = one(ents).join(one(ls), "one").join(one(ms), "one").withColumn("load", F.lit(load_id))
    return row.select(
        F.lit(app).alias("app_key"), F.to_json(F.struct("entities", "links", "metrics", "load")).alias("snapshot"),
        F.lit(None).cast("string").alias("patch"), F.lit("confirm").alias("operator"), F.lit(source).alias("source_request"))


def loaded_rows(spark, root: str, app: str, entity: str, version: int | None = None) -> DataFrame:
    """Rows of an entity as a version, the current one by default, has them; reached through its row alone."""
    stored = versions.read_versions(spark, f"{root.rstrip('/')}/model_versions", app)
    row = (versions.current_versions(stored) if version is None else versions.version_of(stored, app, version)).first()
    if row is None:
        raise ConfirmError("no such version")
    found = next((e for e in versions.snapshot_entities(row["snapshot"], spark) if e.key == entity), None)
    if found is None:
        raise ConfirmError(f"no entity {entity} in the version")
    return records.read_load(spark, root, app, found, versions.snapshot_load(row["snapshot"], spark))


def confirm(
    corpus: Corpus, source_file: str, app: str, root: str, decisions: DataFrame,
    acknowledged: DataFrame | None = None, allow_rejects: bool = False, definitions: DataFrame | None = None,
) -> Loaded:
    """Load one workbook as the next version of an app.

    ``decisions (source_file, key, decision, on_from, on_to)`` must cover every link, and
    ``acknowledged (source_file, id)`` every item under review. Rejected rows block the load
    unless ``allow_rejects``, in which case they are stored beside it. ``definitions`` are proposed metric
    definitions, as for ``catalog.metric_definitions``.
    """
    spark = corpus.rows.sparkSession
    book = F.col("source_file") == source_file
    decisions = decisions.filter(book)
    # Catalog-sized tables that several checks read are stored once.
    keep = lambda df, name: materialize(df, name)
    plans, keys = corpus.plans.filter(book), keep(corpus.keys.filter(book), "keys")
    named = keep(catalog.build_links(corpus.links.filter(book), plans, keys), "named")
    decided = links.apply_decisions(named, decisions)
    if missing := _items(decided["missing"], "key"):
        raise ConfirmError("links without a decision", [f"relation:{k}" for k in missing])
    if unknown := _items(decided["unknown"], "key"):
        raise ConfirmError("decisions on unknown links", unknown)
    if invalid := _items(decided["invalid"], "key"):
        raise ConfirmError("decisions that are neither accepted nor rejected", invalid)
    # Column overrides are given as field keys; the catalog is rebuilt around the kept links.
    pos = keys.select("source_file", F.col("sheet").alias("child"), F.col("field_key").alias("on_to"),
                            F.col("pos").alias("new_pos"))
    kept = keep(decided["kept"].join(pos, ["source_file", "child", "on_to"], "left").withColumn(
        "pos", F.coalesce("new_pos", "pos")).drop("new_pos"), "kept")
    fields = keep(catalog.build_fields(plans, corpus.fields.filter(book), keys, kept), "catalog_fields")
    cat = {
        "fields": fields, "links": kept,
        "entities": keep(catalog.build_entities(plans, fields), "catalog_entities"),
        "metrics": keep(catalog.build_metrics(plans, fields, None if definitions is None else catalog.metric_definitions(
            definitions.filter(book), plans, keys)), "catalog_metrics"),
    }
    errors = catalog.catalog_errors(
        cat["entities"].withColumnRenamed("key_field_key", "key_field"), fields, kept, cat["metrics"])
    if broken := [f"{r['item']}: {r['error']}" for r in errors.collect()]:
        raise ConfirmError("the catalog is not sound", broken)
    queue = catalog.review_queue(
        cat["entities"], fields, cat["metrics"], kept, acknowledged, kept.select("source_file", "key"))
    if waiting := _items(queue, "item"):
        raise ConfirmError("items under review", waiting)

    placed = catalog_entities(cat)
    if not placed:
        raise ConfirmError("no table of the file can be loaded")
    # One scan finds the labels that no enum declares, one types and writes the rows of all tables.
    rows = corpus.rows.filter(book)
    placed = load.widen_tables(rows, placed)
    load_id = uuid.uuid4().hex
    folder = records.load_path(root, app, load_id)
    load.typed_tables(rows, placed).write.partitionBy("entity", "state").parquet(folder)
    tallied = "entity string, state string, row_no bigint, errors array<struct<field:string,value:string,cause:string>>"
    written = spark.read.schema(tallied).parquet(folder)
    counts, rejected = {e.key: 0 for _, e, _ in placed}, {e.key: 0 for _, e, _ in placed}
    for r in written.groupBy("entity", "state").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["state"] == "good":
            counts[r["entity"]] = r["n"]
    bad = written.filter("state = 'bad'")
    for r in bad.groupBy("entity").agg(F.sum(F.size("errors")).alias("n")).collect():
        rejected[r["entity"]] = r["n"]
    if any(rejected.values()) and not allow_rejects:
        first = bad.orderBy("entity", "row_no").first()
        sheet = next(s for s, e, _ in placed if e.key == first["entity"])
        error = first["errors"][0]
        raise ConfirmError(f"{sheet}: row {first['row_no']}, {error['field']}: {error['cause']}")
    path = f"{root.rstrip('/')}/model_versions"
    known = versions.read_versions(spark, path, app)
    version, final = (known.agg(F.max("version")).first()[0] or 0) + 1, [e for _, e, _ in placed]
    names = {r["entity"]: r["name"] for r in cat["entities"].collect()}
    new = versions.next_versions(known, snapshot(spark, final, names, cat, app, source_file, load_id))
    versions.append_versions(path, new)
    return Loaded(version, load_id, final, counts, rejected)


def loaded_rejects(spark, root: str, app: str, load_id: str) -> DataFrame:
    """``(entity, row_no, field, value, cause)`` of the broken cells of a load."""
    kind = "entity string, state string, row_no bigint, errors array<struct<field:string,value:string,cause:string>>"
    rows = spark.read.schema(kind).parquet(records.load_path(root, app, load_id)).filter("state = 'bad'")
    return rows.select("entity", "row_no", F.inline("errors"))
