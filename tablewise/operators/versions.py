"""Versioned catalogs: current and past versions, append, restore, risk audit, publications.

``model_versions (app_key, version, snapshot, patch, operator, source_request,
validation_status, created_at)`` is append-only; the snapshot is a JSON document.
Stored in folders by a hash of the app key: the history of one app reads one folder, and
the number of folders does not grow with the number of apps.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.operators.query import Entity, Field
from tablewise.session import materialize

VERSIONS = (
    "app_key string, version bigint, snapshot string, patch string, operator string, "
    "source_request string, validation_status string, created_at timestamp"
)
FIELD = "struct<key:string,name:string,type:string,role:string,values:array<string>>"
SNAPSHOT = (
    f"struct<entities:array<struct<key:string,name:string,key_field:string,fields:array<{FIELD}>>>,"
    "links:array<struct<key:string,from:string,to:string,on_from:string,on_to:string>>,"
    "metrics:array<struct<key:string,name:string,entity:string,op:string,field:string,business_definition:string>>,"
    "load:string>"
)
APP_KEY = r"^[a-z0-9][a-z0-9_-]{0,63}$"


BUCKETS = 64


def bucket_of(app) -> Column:
    return F.pmod(F.xxhash64(app), F.lit(BUCKETS)).cast("int")


def read_versions(spark: SparkSession, path: str, app: str | None = None) -> DataFrame:
    """Stored versions, of all apps or from the folder of one; empty when nothing is stored."""
    try:
        stored = spark.read.schema(VERSIONS + ", bucket int").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], VERSIONS)
    if app is not None:
        stored = stored.filter((F.col("bucket") == bucket_of(F.lit(app))) & (F.col("app_key") == app))
    return stored.drop("bucket")


def current_versions(versions: DataFrame) -> DataFrame:
    """Highest version of each app."""
    rest = [c for c in versions.columns if c != "app_key"]
    return versions.groupBy("app_key").agg(F.max_by(F.struct(*rest), "version").alias("v")).select(
        *[F.col("v." + c).alias(c) if c != "app_key" else F.col(c) for c in versions.columns])


def history(versions: DataFrame, app: str) -> DataFrame:
    return versions.filter(F.col("app_key") == app).orderBy("version")


def version_of(versions: DataFrame, app: str, version: int) -> DataFrame:
    return versions.filter((F.col("app_key") == app) & (F.col("version") == version))


def next_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshots numbered after the current version of their app.

    ``new (app_key, snapshot, patch, operator, source_request)``; a malformed app key raises
    when the rows are read. Several snapshots of an app get numbers one after the other, in the
    order of their request and patch.
    """
    last = versions.groupBy("app_key").agg(F.max("version").alias("last"))
    key = F.when(F.col("app_key").rlike(APP_KEY), F.col("app_key")).otherwise(
        F.raise_error(F.concat(F.lit("bad app key: "), F.coalesce("app_key", F.lit("null")))))
    place = Window.partitionBy("app_key").orderBy("source_request", F.col("patch").cast("string"))
    return new.join(last, "app_key", "left").select(
        key.alias("app_key"), (F.coalesce("last", F.lit(0)) + F.row_number().over(place)).cast("bigint").alias("version"),
        "snapshot", "patch", "operator", "source_request",
        F.lit("passed").alias("validation_status"), F.current_timestamp().alias("created_at"))


def append_versions(versions_path: str, rows: DataFrame) -> None:
    placed = rows.withColumn("bucket", bucket_of(F.col("app_key")))
    spread = F.pmod(F.xxhash64("app_key", "version"), F.lit(16))  # an app with most versions is not one task
    placed.repartition("bucket", spread).write.mode("append").partitionBy("bucket").parquet(versions_path)


def version_conflicts(versions: DataFrame) -> DataFrame:
    """Versions written more than once: Parquet has no unique constraint, so they are audited."""
    return versions.groupBy("app_key", "version").agg(F.count(F.lit(1)).alias("copies")).filter(
        F.col("copies") > 1)


def restore(versions: DataFrame, targets: DataFrame, operator: str = "local") -> tuple[DataFrame, DataFrame]:
    """Copies of old snapshots as next versions, and the refused targets with the cause.

    ``targets (app_key, target_version)``; a null target undoes the latest change. The versions are merged,
    never broadcast: a planner that guesses the length of made text would gather all snapshots on the driver.
    """
    now = versions.groupBy("app_key").agg(F.max("version").alias("now"))
    asked = targets.join(now.hint("merge"), "app_key", "left").withColumn("undo", F.col("target_version").isNull())
    asked = asked.withColumn("wanted", F.coalesce("target_version", F.col("now") - 1))
    old = versions.select("app_key", F.col("version").alias("wanted"), "snapshot").dropDuplicates(["app_key", "wanted"])
    placed = asked.join(old.withColumn("found", F.lit(True)).hint("merge"), ["app_key", "wanted"], "left").withColumn(
        "cause", F.when(F.col("now").isNull(), "app not found")
        .when(F.col("undo") & (F.col("now") <= 1), "nothing to undo")
        .when(F.col("wanted") == F.col("now"), "already current")
        .when(F.col("found").isNull(), "version not found"))
    rows = placed.filter(F.col("cause").isNull()).select(
        "app_key", (F.col("now") + F.row_number().over(Window.partitionBy("app_key").orderBy("wanted"))).alias("version"), "snapshot", F.lit(None).cast("string").alias("patch"),
        F.lit(operator).alias("operator"),
        F.concat(F.lit("restored from version "), F.col("wanted").cast("string")).alias("source_request"),
        F.lit("passed").alias("validation_status"), F.current_timestamp().alias("created_at"))
    return rows, placed.filter(F.col("cause").isNotNull()).select("app_key", "target_version", "cause")


def _risks(before: Column, after: Column) -> Column:
    """Array of ``(category, item)`` for two neighbouring snapshots."""
    def tell(items: Column, category: str, name) -> Column:
        return F.transform(items, lambda m: F.struct(F.lit(category).alias("category"), name(m).alias("item")))

    def own(items: Column, key: Column) -> Column:
        return F.get(F.filter(items, lambda x: x["key"] == key), F.lit(0))

    def pairs(a: Column, b: Column) -> Column:
        return F.transform(a, lambda x: F.struct(x.alias("old"), own(b, x["key"]).alias("new")))

    def lost(m: Column) -> Column:
        gone = F.filter(m["old"]["fields"], lambda f: ~F.exists(m["new"]["fields"], lambda g: g["key"] == f["key"]))
        return F.transform(gone, lambda f: F.concat_ws(".", m["old"]["key"], f["key"]))

    def ids(e: Column) -> Column:
        return F.size(F.filter(e["fields"], lambda f: f["role"] == "identifier"))

    def key_of(e: Column) -> Column:
        return own(e["fields"], e["key_field"])

    yes = lambda c: F.coalesce(c, F.lit(False))
    name = lambda m: m["old"]["key"]
    entities = pairs(before["entities"], after["entities"])
    kept = F.filter(entities, lambda m: m["new"].isNotNull())
    metrics = pairs(before["metrics"], after["metrics"])
    same_key = lambda m: m["old"]["key_field"] == m["new"]["key_field"]
    ends = lambda items: F.array_distinct(F.transform(items, lambda x: F.struct(
        x["from"].alias("from"), x["to"].alias("to"), x["on_from"].alias("on_from"), x["on_to"].alias("on_to"))))
    return F.flatten(F.array(
        tell(F.filter(entities, lambda m: m["new"].isNull()), "entity_removed", name),
        tell(F.flatten(F.transform(kept, lost)), "field_removed", lambda item: item),
        tell(F.filter(kept, lambda m: (ids(m["new"]) > 1) & (ids(m["new"]) > ids(m["old"]))), "identifier_conflict", name),
        tell(F.filter(kept, lambda m: ~same_key(m)), "identifier_changed", name),
        tell(F.filter(kept, lambda m: same_key(m) & yes(key_of(m["old"])["role"] == "identifier")
                      & yes(key_of(m["new"])["role"] != "identifier")), "identifier_demoted", name),
        tell(F.filter(kept, lambda m: yes(key_of(m["old"])["type"] != key_of(m["new"])["type"])), "key_field_type_changed", name),
        tell(F.filter(metrics, lambda m: m["new"].isNull()), "metric_removed", name),
        tell(F.filter(metrics, lambda m: yes(m["old"]["business_definition"] != m["new"]["business_definition"])),
             "metric_definition_changed", name),
        tell(F.array_except(ends(before["links"]), ends(after["links"])), "link_removed",
             lambda x: F.concat_ws(".", x["from"], x["to"])),
    ))


def version_risks(versions: DataFrame) -> DataFrame:
    """Risky changes between each version and the one before, for all apps at once.

    Gives ``(app_key, version, category, item)``. Neighbouring snapshots meet in one join on
    (app, version), so even an app owning a third of all versions is spread over the tasks.
    """
    at = ["app_key", "version"]
    parsed = versions.select(*at, F.from_json("snapshot", SNAPSHOT).alias("after"))
    earlier = versions.select(
        "app_key", (F.col("version") + 1).alias("version"), F.from_json("snapshot", SNAPSHOT).alias("before"))
    found = parsed.join(earlier, at).select(*at, F.explode_outer(_risks(F.col("before"), F.col("after"))).alias("r"))
    return found.filter(F.col("r").isNotNull()).select(*at, "r.category", "r.item")


# --- publications ------------------------------------------------------------

def published_versions(publications: DataFrame, versions: DataFrame) -> DataFrame:
    """Published apps with the snapshot they pin: ``(slug, app_key, version, snapshot)``."""
    live = publications.filter(F.col("status") == "published").select(
        "slug", "app_key", F.col("model_version").alias("version"))
    return live.join(versions.select("app_key", "version", "snapshot"), ["app_key", "version"])


def published(publications: DataFrame, versions: DataFrame, slug: str) -> DataFrame:
    wanted = publications.filter(F.col("slug") == slug.strip().lower())
    return published_versions(wanted, versions)


def snapshot_entities(row_snapshot: str, spark: SparkSession) -> list[Entity]:
    """Entities of one snapshot, to read that version's rows."""
    found = spark.createDataFrame([(row_snapshot,)], "s string").select(
        F.from_json("s", SNAPSHOT).alias("s")).first()["s"]
    return [
        Entity(e["key"], e["key_field"], tuple(
            Field(f["key"], f["type"], f["role"], f["name"] or "", tuple(f["values"] or ())) for f in e["fields"]))
        for e in found["entities"]
    ]


def snapshot_load(row_snapshot: str, spark: SparkSession) -> str | None:
    """Load whose folder holds the rows of a snapshot."""
    found = spark.createDataFrame([(row_snapshot,)], "s string").select(F.from_json("s", SNAPSHOT)["load"].alias("load"))
    return found.first()["load"]


def judge_requests(publications: DataFrame, changes: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be carried out, and rejects ``(app_key, cause, requests)``.

    ``changes (app_key, slug, action[, change_no])`` with the actions publish, republish and
    unpublish. An app's first request of a batch counts, by ``change_no``, else by the row itself;
    so does the first of several apps that ask for one slug. Slugs owned before the batch stay
    taken during it. The batch is stored first, so a small one is broadcast to the tables.
    """
    order = [c for c in ("change_no", "action", "slug") if c in changes.columns]
    slug = F.when(F.coalesce(F.col("action") != "unpublish", F.lit(True)), F.nullif(F.lower(F.trim("slug")), F.lit("")))
    first = materialize(changes.withColumn("slug", slug).groupBy("app_key").agg(
        F.min(F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("n")).select("app_key", "r.*", "n"), "requests")
    apps = first.select("app_key")
    now = versions.join(apps, "app_key", "left_semi").groupBy("app_key").agg(F.max("version").alias("now"))
    own = publications.join(apps, "app_key", "left_semi").select("app_key", F.lit(True).alias("listed"))
    slugs = first.filter(F.col("slug").isNotNull()).select("slug").distinct()
    owners = publications.join(slugs, "slug", "left_semi").groupBy("slug").agg(F.min("app_key").alias("owner"))
    action, on = F.col("action"), F.col("action").isin("publish", "republish")
    known = F.coalesce(on | (action == "unpublish"), F.lit(False))
    cause = (
        F.when(~known, "unknown action")
        .when(on & F.col("now").isNull(), "unknown app")
        .when((action == "publish") & F.col("listed"), "already published")
        .when((action != "publish") & F.col("listed").isNull(), "not published")
        .when((action == "publish") & F.col("slug").isNull(), "no slug")
        .when(F.col("owner") != F.col("app_key"), "slug taken")
    )
    judged = materialize(
        first.join(now, "app_key", "left").join(own, "app_key", "left").join(owners, "slug", "left")
        .withColumn("cause", cause), "judged")
    fit = judged.filter(F.col("cause").isNull())
    winners = fit.filter(F.col("slug").isNotNull()).groupBy("slug").agg(
        F.min(F.struct(*order, "app_key"))["app_key"].alias("winner"))
    fit = fit.join(winners, "slug", "left")
    beaten = F.col("winner") != F.col("app_key")
    rejects = (
        judged.filter(F.col("cause").isNotNull()).select("app_key", "cause", F.lit(1).cast("bigint").alias("requests"))
        .unionAll(fit.filter(beaten).select("app_key", F.lit("slug taken"), F.lit(1).cast("bigint")))
        .unionAll(first.filter(F.col("n") > 1).select("app_key", F.lit("repeated request"), F.col("n") - 1))
    )
    return fit.filter(~F.coalesce(beaten, F.lit(False))).select("app_key", "slug", "action", "now"), rejects


def publish_update(publications: DataFrame, changes: DataFrame, versions: DataFrame) -> DataFrame:
    """Publication table after a batch of publish, republish and unpublish requests.

    Publishing pins the current version; requests that ``judge_requests`` rejects change nothing.
    """
    asked = judge_requests(publications, changes, versions)[0].withColumnRenamed("slug", "new_slug")
    on = F.col("action").isin("publish", "republish")
    both = publications.join(asked, "app_key", "full_outer")
    return both.select(
        "app_key", F.coalesce("new_slug", "slug").alias("slug"),
        F.when(on, F.col("now")).otherwise(F.col("model_version")).alias("model_version"),
        F.when(on, "published").when(F.col("action") == "unpublish", "unpublished")
        .otherwise(F.col("status")).alias("status"),
    )
