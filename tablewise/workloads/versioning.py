"""Versioned catalogs: one app per customer with up to three versions each."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators import versions as v
from tablewise.session import work_folder
from tablewise.sources.records import conform
from tablewise.workloads import fixtures as fx
from tablewise.workloads.registry import query


def _field(key, kind, role, name=None):
    return F.struct(F.lit(key).alias("key"), F.lit(name or key).alias("name"), kind.alias("type"), role.alias("role"),
                    F.lit(None).cast("array<string>").alias("values"))


def model_versions(spark, sf) -> DataFrame:
    """Three snapshots per app; by the app's number, later ones remove, retype or redefine parts."""
    apps = fx.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("a"), F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("version"))
    a, n = F.col("a"), F.col("version")
    when = lambda version, k: (n >= version) & (a % k == 0)
    lit = F.lit
    fields = F.array_compact(F.array(
        _field("id", F.when(when(2, 4), "string").otherwise("number"), F.when(when(3, 7), "text").otherwise("identifier")),
        F.when(~when(3, 5), _field("name", lit("string"), lit("text"))),
        _field("code", lit("string"), F.when(when(2, 11), "identifier").otherwise("dimension"))))
    entity = lambda key, key_field, fs: F.struct(
        lit(key).alias("key"), lit(key).alias("name"), key_field.alias("key_field"), fs.alias("fields"))
    entities = F.array_compact(F.array(
        entity("customer", F.when(when(3, 13), "code").otherwise("id"), fields),
        F.when(~when(2, 6), entity("note", lit("id"), F.array(_field("id", lit("number"), lit("identifier")))))))
    link = lambda to: F.struct(lit(f"customer_to_{to}").alias("key"), lit("customer").alias("from"), lit(to).alias("to"),
                               lit("id").alias("on_from"), lit("id").alias("on_to"))
    links = F.array_compact(F.array(F.when(~when(2, 6), link("note"))))
    metric = lambda key, text: F.struct(lit(key).alias("key"), lit(key).alias("name"), lit("customer").alias("entity"),
                                        lit("count").alias("op"), lit(None).cast("string").alias("field"), text.alias("business_definition"))
    metrics = F.array_compact(F.array(
        metric("customer_count", F.when(when(2, 8), "active customers").otherwise("rows of customer")),
        F.when(~when(3, 9), metric("spare", lit("spare")))))
    return apps.select(
        F.concat(lit("app_"), a.cast("string")).alias("app_key"), n.cast("bigint").alias("version"),
        F.to_json(F.struct(entities.alias("entities"), links.alias("links"), metrics.alias("metrics"))).alias("snapshot"),
        lit(None).cast("string").alias("patch"), F.when(n == 1, "import").otherwise("patch").alias("operator"),
        lit(None).cast("string").alias("source_request"), lit("passed").alias("validation_status"),
        F.to_timestamp(lit("2024-01-01")).alias("created_at"))


_V = "v AS (SELECT c_custkey AS a, 'app_' || c_custkey AS app_key, unnest(range(1, c_custkey % 3 + 2)) AS version FROM customer)"


@query("current_version", f"WITH {_V} SELECT app_key, max(version) AS version, CASE WHEN max(version) = 1 THEN 'import' ELSE 'patch' END AS operator FROM v GROUP BY app_key")
def current_version(spark, sf):
    return v.current_versions(model_versions(spark, sf)).select("app_key", "version", "operator")


@query("version_history", f"WITH {_V} SELECT app_key, version FROM v WHERE app_key = 'app_38'")
def version_history(spark, sf):
    return v.history(model_versions(spark, sf), "app_38").select("app_key", "version")


@query("past_version", f"WITH {_V} SELECT app_key, version FROM v WHERE app_key = 'app_38' AND version = 2")
def past_version(spark, sf):
    return v.version_of(model_versions(spark, sf), "app_38", 2).select("app_key", "version")


@query("append_version", f"""WITH {_V} SELECT app_key, version FROM v UNION ALL SELECT app_key, max(version) + 1 FROM v WHERE a % 2 = 0 GROUP BY app_key
UNION ALL SELECT 'new_' || a, 1 FROM v WHERE version = 1 AND a % 10 = 0""")
def append_version(spark, sf):
    path = f"{work_folder(spark)}/model_versions-{uuid.uuid4().hex}"
    stored = model_versions(spark, sf)
    v.append_versions(path, stored)
    known = v.read_versions(spark, path)
    number = F.regexp_extract("app_key", r"(\d+)$", 1).cast("bigint")
    again = v.current_versions(known).filter(number % 2 == 0)
    fresh = again.filter(number % 10 == 0).withColumn("app_key", F.regexp_replace("app_key", "^app", "new"))
    v.append_versions(path, v.next_versions(known, again.unionByName(fresh).select(
        "app_key", "snapshot", "patch", "operator", "source_request")))
    return v.read_versions(spark, path).select("app_key", "version")


@query("version_conflicts", f"WITH {_V} SELECT app_key, version, 2 AS copies FROM v WHERE a % 50 = 1")
def version_conflicts(spark, sf):
    all_ = model_versions(spark, sf)
    twice = all_.filter(F.regexp_extract("app_key", r"(\d+)$", 1).cast("bigint") % 50 == 1)
    return v.version_conflicts(all_.unionByName(twice))


_RESTORE = f"""{_V}, t AS (SELECT a, app_key, max(version) AS now, CASE WHEN a % 5 = 0 THEN NULL WHEN a % 5 = 1 THEN 1 WHEN a % 5 = 2 THEN max(version) ELSE 9 END AS target_version
  FROM v GROUP BY a, app_key), r AS (SELECT *, CASE WHEN target_version IS NULL AND now <= 1 THEN 'nothing to undo' WHEN target_version = now THEN 'already current'
  WHEN target_version > now THEN 'version not found' END AS cause, coalesce(target_version, now - 1) AS wanted FROM t)"""


def _targets(versions: DataFrame) -> DataFrame:
    now = versions.groupBy("app_key").agg(F.max("version").alias("now"))
    a = F.regexp_extract("app_key", r"(\d+)$", 1).cast("bigint") % 5
    return now.select("app_key", F.when(a == 1, F.lit(1)).when(a == 2, F.col("now")).when(a > 2, F.lit(9)).cast("bigint").alias("target_version"))


@query("restore_version", f"WITH {_RESTORE} SELECT app_key, now + 1 AS version, 'restored from version ' || wanted AS source_request, true AS same FROM r WHERE cause IS NULL")
def restore_version(spark, sf):
    all_ = model_versions(spark, sf)
    rows, _ = v.restore(all_, _targets(all_))
    old = all_.select("app_key", F.concat(F.lit("restored from version "), F.col("version").cast("string")).alias("source_request"),
                      F.col("snapshot").alias("old"))
    return rows.join(old.hint("merge"), ["app_key", "source_request"]).select(
        "app_key", "version", "source_request", (F.col("snapshot") == F.col("old")).alias("same"))


@query("restore_refused", f"WITH {_RESTORE} SELECT app_key, cause FROM r WHERE cause IS NOT NULL")
def restore_refused(spark, sf):
    all_ = model_versions(spark, sf)
    return v.restore(all_, _targets(all_))[1].select("app_key", "cause")


@query("version_risks", f"""WITH {_V}, s AS (SELECT * FROM v WHERE version > 1)
SELECT app_key, version, 'entity_removed' AS category, 'note' AS item FROM s WHERE version = 2 AND a % 6 = 0
UNION ALL SELECT app_key, version, 'link_removed', 'customer.note' FROM s WHERE version = 2 AND a % 6 = 0
UNION ALL SELECT app_key, version, 'key_field_type_changed', 'customer' FROM s WHERE version = 2 AND a % 4 = 0
UNION ALL SELECT app_key, version, 'identifier_conflict', 'customer' FROM s WHERE version = 2 AND a % 11 = 0
UNION ALL SELECT app_key, version, 'metric_definition_changed', 'customer_count' FROM s WHERE version = 2 AND a % 8 = 0
UNION ALL SELECT app_key, version, 'field_removed', 'customer.name' FROM s WHERE version = 3 AND a % 5 = 0
UNION ALL SELECT app_key, version, 'metric_removed', 'spare' FROM s WHERE version = 3 AND a % 9 = 0
UNION ALL SELECT app_key, version, 'identifier_changed', 'customer' FROM s WHERE version = 3 AND a % 13 = 0
UNION ALL SELECT app_key, version, 'key_field_type_changed', 'customer' FROM s WHERE version = 3 AND a % 13 = 0 AND a % 4 <> 0
UNION ALL SELECT app_key, version, 'identifier_demoted', 'customer' FROM s WHERE version = 3 AND a % 7 = 0 AND a % 13 <> 0""")
def version_risks(spark, sf):
    return v.version_risks(model_versions(spark, sf))


def publications(spark, sf) -> DataFrame:
    a = F.col("c_custkey")
    return fx.read(spark, sf, "customer").filter(a % 4 == 0).select(
        F.concat(F.lit("app_"), a.cast("string")).alias("app_key"), F.concat(F.lit("shop-"), a.cast("string")).alias("slug"),
        F.lit(1).cast("bigint").alias("model_version"), F.when(a % 8 == 0, "published").otherwise("unpublished").alias("status"))


@query("published_versions", "SELECT 'shop-' || c_custkey AS slug, 'app_' || c_custkey AS app_key, 1 AS version FROM customer WHERE c_custkey % 8 = 0")
def published_versions(spark, sf):
    return v.published_versions(publications(spark, sf), model_versions(spark, sf)).select("slug", "app_key", "version")


@query("published_rows", "SELECT CAST(c_custkey AS DOUBLE) AS id, c_name AS name, NULL AS code FROM customer")
def published_rows(spark, sf):
    # The pinned version decides which fields of the live rows are shown.
    live = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("extra"))
    pinned = v.published(publications(spark, sf), model_versions(spark, sf), " Shop-40 ").first()
    entity = next(e for e in v.snapshot_entities(pinned["snapshot"], spark) if e.key == "customer")
    return conform(live, entity)


@query("publish_changes", """SELECT 'app_' || c_custkey AS app_key, CASE WHEN c_custkey % 4 = 0 THEN 'shop-' ELSE 'new-' END || c_custkey AS slug,
  CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 3 + 1 ELSE 1 END AS model_version,
  CASE WHEN c_custkey % 6 = 0 THEN 'published' WHEN c_custkey % 10 = 0 THEN 'unpublished' WHEN c_custkey % 8 = 0 THEN 'published' ELSE 'unpublished' END AS status
FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 0""")
def publish_changes(spark, sf):
    a = F.col("c_custkey")
    changes = fx.read(spark, sf, "customer").filter((a % 6 == 0) | ((a % 10 == 0) & (a % 4 == 0))).select(
        F.concat(F.lit("app_"), a.cast("string")).alias("app_key"),
        F.when(a % 4 != 0, F.concat(F.lit("new-"), a.cast("string"))).alias("slug"),
        F.when(a % 12 == 0, "republish").when(a % 6 == 0, "publish").otherwise("unpublish").alias("action"))
    return v.publish_update(publications(spark, sf), changes, model_versions(spark, sf))


@query("publish_rejects", """WITH c AS (SELECT c_custkey AS a, 'app_' || c_custkey AS app_key FROM customer),
shared AS (SELECT app_key, row_number() OVER (PARTITION BY a % 3 ORDER BY a) AS place FROM c WHERE a % 20 = 6)
SELECT 'ghost_' || a AS app_key, 'unknown app' AS cause, 1 AS requests FROM c WHERE a % 50 = 1
UNION ALL SELECT app_key, 'already published', 1 FROM c WHERE a % 8 = 0
UNION ALL SELECT app_key, 'slug taken', 1 FROM c WHERE a % 36 = 9
UNION ALL SELECT app_key, 'not published', 1 FROM c WHERE a % 20 = 10
UNION ALL SELECT app_key, 'repeated request', 1 FROM c WHERE a % 28 = 7
UNION ALL SELECT app_key, 'slug taken', 1 FROM shared WHERE place > 1""")
def publish_rejects(spark, sf):
    a = F.col("c_custkey")
    base, app = fx.read(spark, sf, "customer"), F.concat(F.lit("app_"), a.cast("string"))

    def ask(picked, action, slug, key=app, no=0):
        return base.filter(picked).select(
            key.alias("app_key"), F.expr(slug).alias("slug"), F.lit(action).alias("action"), (a * 2 + no).alias("change_no"))

    wanted = (
        (a % 50 == 1, "publish", "concat('g-', c_custkey)", F.concat(F.lit("ghost_"), a.cast("string"))),
        (a % 8 == 0, "publish", "concat('again-', c_custkey)"),
        (a % 36 == 9, "publish", "concat(' SHOP-', c_custkey - 1)"),
        (a % 20 == 10, "unpublish", "string(null)"),
        (a % 28 == 7, "publish", "concat('p-', c_custkey)"), (a % 28 == 7, "publish", "concat('q-', c_custkey)", app, 1),
        (a % 20 == 6, "publish", "concat('shared-', c_custkey % 3)"),
    )
    changes = reduce(DataFrame.unionAll, [ask(*w) for w in wanted])
    _, rejects = v.judge_requests(publications(spark, sf), changes, model_versions(spark, sf))
    return rejects
