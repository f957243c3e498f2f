"""Typed load, queries, changes, versions and whole loads on small tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablewise.operators import catalog, changes, load, query as q, versions
from tablewise.operators.query import Entity, Field, ListQuery
from tablewise.plans.confirm import ConfirmError, confirm, loaded_rejects, loaded_rows
from tablewise.plans.understand import understand
from tablewise.sources import records
from test_tables import _ledger

ORDER = Entity("order", "no", (
    Field("no", "string", "identifier"), Field("amount", "money", "measure"), Field("day", "date", "time"),
    Field("state", "enum", "enum", values=("new", "on hold", "done"))))
AT = {"no": 0, "amount": 1, "day": 2, "state": 3}


def cells(spark, rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "row_no bigint, cells array<string>")


def test_good_and_rejected_rows(spark):
    rows = cells(spark, [["A1", "¥12,800.00", "2022", "new"], ["A2", "abc", "2022-13", "on\nhold"], [None, "1", "N/A", "lost"], [None, " ", "", None],
                         ["A3", "missing: x", None, "-"]])
    good, bad = load.split_rows(load.typed_rows(rows, ORDER, AT))
    got = {r["no"]: (r["amount"], str(r["day"]), r["state"]) for r in good.collect()}
    assert got == {"A1": (12800.0, "2022-01-01", "new"), "A3": (None, "None", None)}
    assert sorted((r["row_no"], r["field"], r["cause"]) for r in bad.collect()) == [
        (1, "amount", "not a number"), (1, "day", "not a date"), (2, "no", "key is empty"), (2, "state", "not a declared value")]


def test_enum_widening_in_first_seen_order(spark):
    rows = cells(spark, [["k", None, None, v] for v in ("zeta 1", "on  hold", "alpha", "zeta 1", None, "无")])
    assert load.widen_enums(ORDER, rows, AT).field("state").values == ("new", "on hold", "done", "zeta1", "alpha")
    many = cells(spark, [["k", None, None, f"v{i}"] for i in range(18)])
    wide = load.widen_enums(ORDER, many, AT).field("state")
    assert (wide.type, wide.role, wide.values) == ("string", "dimension", ())


def test_ambiguous_enum_labels(spark):
    df = spark.createDataFrame([("A B",), ("AB",), ("A  B",), ("C D",), ("CD",)], "v string")
    got = [r[0] for r in df.select(load.enum_value(F.col("v"), ("A B", "AB", "C D"))).collect()]
    assert got == ["A B", "AB", "A  B", "C D", "C D"]


def list_rows(spark):
    data = [("SO3", "北京 科技", "华东", 30.0, "2026-03-01", None), ("SO1", "上海", "", 10.0, "2026-01-01", "x"),
            ("SO2", "Acme Tech", None, None, None, ""), ("SO4", "acme", "华南", 20.0, "2026-02-01", "y")]
    df = spark.createDataFrame(data, "no string, name string, region string, amount double, day string, note string")
    return df.withColumn("day", F.to_date("day"))


def numbers(df):
    return [r["no"] for r in df.collect()]


def test_search_and_filters(spark):
    df = list_rows(spark)
    assert sorted(numbers(q.search_rows(df, " ACME  tech ", ["no", "name"]))) == ["SO2"]
    assert sorted(numbers(q.search_rows(df, "科", ["name"]))) == ["SO3"]
    assert sorted(numbers(q.search_rows(df, "  ", ["name"]))) == ["SO1", "SO2", "SO3", "SO4"]
    assert sorted(numbers(q.filter_rows(df, {"region": ["__empty__"]}))) == ["SO1", "SO2"]
    assert sorted(numbers(q.filter_rows(df, {"region": ["__empty__", "华南"], "amount": ["10", "20"]}))) == ["SO1", "SO4"]


def test_sort_and_page(spark):
    df = list_rows(spark)
    for direction, want in (("asc", ["SO1", "SO4", "SO3", "SO2"]), ("desc", ["SO3", "SO4", "SO1", "SO2"])):
        assert numbers(q.run_list_query(df, ListQuery(sorts=(("amount", direction),)), "no").rows) == want
    got = q.run_list_query(df, ListQuery(page=99, page_size=3, sorts=(("no", "asc"),)), "no")
    assert (got.page, got.page_count, got.total, numbers(got.rows)) == (2, 2, 4, ["SO4"])
    none = q.run_list_query(df, ListQuery(search="zzz", search_keys=("name",)), "no")
    assert (none.total, none.page, none.page_count) == (0, 1, 1)


@pytest.mark.parametrize("offset", [0, 1, 499, 500, 990, 2000])
def test_deep_pages_equal_plain_ones(spark, offset):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 13).alias("v"))
    order = q.sort_columns(df, [("v", "desc")], "k")
    deep = [tuple(r) for r in q.page_rows(df.repartition(16), order, offset, 20, deep=0).collect()]
    want = sorted(((k, k * 7919 % 13) for k in range(1000)), key=lambda r: (-r[1], r[0]))[offset:offset + 20]
    assert deep == want


def test_related_rows_ignore_blanks_and_types(spark):
    parent = spark.createDataFrame([("1", "a"), ("", "b"), (None, "c")], "id string, name string")
    child = spark.createDataFrame([(1, 10), (None, 11), (2, 12)], "pid bigint, no int")
    assert [(r["no"], r["name"]) for r in q.related_rows(parent, child, "id", "pid", ["name"]).collect()] == [(10, "a")]


def test_related_rows_keep_both_columns(spark):
    parent = spark.createDataFrame([("1", 5)], "id string, amount int")
    child = spark.createDataFrame([(1, 77)], "pid bigint, amount int")
    row = q.related_rows(parent, child, "id", "pid").first()
    assert (row["amount"], row["parent_amount"], row["id"]) == (77, 5, "1")


def test_snapshots_of_one_batch_get_following_numbers(spark):
    old = spark.createDataFrame([("a", 3)], "app_key string, version bigint").select(
        "app_key", "version", F.lit("s").alias("snapshot"))
    new = spark.createDataFrame([("a", "x", None, "o", "r2"), ("a", "y", None, "o", "r1"), ("b", "z", None, "o", "r")],
                                "app_key string, snapshot string, patch string, operator string, source_request string")
    got = {(r["app_key"], r["version"], r["snapshot"]) for r in versions.next_versions(old, new).collect()}
    assert got == {("a", 4, "y"), ("a", 5, "x"), ("b", 1, "z")}


def test_metrics_without_numbers(spark):
    df = spark.createDataFrame([(None, "x"), (float("nan"), "y")], "amount double, name string")
    values = {r["metric"]: r["value"] for r in q.metric_values(df, [q.Metric("n", "count"), q.Metric("s", "sum", "amount"), q.Metric("m", "max", "amount")]).collect()}
    assert values == {"n": 2.0, "s": 0.0, "m": 0.0}


def test_dashboard(spark):
    df = spark.createDataFrame([("1", "2026-01-05", 100.0), ("2", "2026-02-05", 200.0), ("3", "2026-03-05", 300.0), ("4", None, 5.0)], "no string, day string, amount double").withColumn("day", F.to_date("day"))
    area = spark.createDataFrame([("a", "华东"), ("b", "华北"), ("c", "华东"), ("d", None)], "name string, region string")
    entities = [Entity("customer", "name", (Field("name", "string"), Field("region", "enum"))), ORDER]
    tables = {"customer": area, "order": df.withColumn("state", F.lit("new"))}
    _, points = q.trend(entities, tables)
    assert [tuple(r) for r in points.collect()] == [("2026-01", 100.0), ("2026-02", 200.0), ("2026-03", 300.0)]
    entity, recent = q.recent_rows(entities, tables, 2)
    assert entity.key == "order" and numbers(recent) == ["3", "2"]
    shares = q.distribution(entities, tables).orderBy("rank").collect()
    assert [(r["label"], r["count"], r["total"]) for r in shares] == [("华东", 2, 3), ("华北", 1, 3)]


def test_changes(spark):
    table = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "no string, amount double")
    entity = Entity("order", "no", ORDER.fields[:2])
    new, rejects = changes.create_rows(table, spark.createDataFrame([("2", 9.0), ("3", 3.0), ("", 1.0)], "no string, amount double"), entity)
    assert sorted(map(tuple, new.collect())) == [("1", 1.0), ("2", 2.0), ("3", 3.0)]
    assert sorted((r["key"], r["cause"]) for r in rejects.collect()) == [("", "no: key is empty"), ("2", "key exists")]
    _, rejects = changes.create_rows(table, spark.createDataFrame([("7", "x", 1)], "no string, amount string, ghost int"), entity)
    assert rejects.first()["cause"] == "ghost: unknown field; amount: not a money"
    left, rejects = changes.delete_rows(table, spark.createDataFrame([("1",), ("9",)], "key string"), entity)
    assert numbers(left) == ["2"] and [r["key"] for r in rejects.collect()] == ["9"]
    kept, rejects = changes.update_rows(table, spark.createDataFrame([("1",)], "no string"), entity)
    assert sorted(map(tuple, kept.collect()), key=str) == [("1", None), ("2", 2.0)] and rejects.count() == 0


def test_restore_appends_a_copy(spark):
    rows = spark.createDataFrame([("a", v, f"s{v}", None, "x", None, "passed", None) for v in (1, 2, 3)], versions.VERSIONS)
    new, refused = versions.restore(rows, spark.createDataFrame([("a", 1)], "app_key string, target_version bigint"))
    assert [(r["version"], r["snapshot"]) for r in new.collect()] == [(4, "s1")] and refused.count() == 0
    _, refused = versions.restore(rows, spark.createDataFrame([("a", 3), ("b", 1)], "app_key string, target_version bigint"))
    assert sorted(r["cause"] for r in refused.collect()) == ["already current", "app not found"]


def test_bad_app_key_is_refused(spark):
    new = spark.createDataFrame([("Bad Key", "s", None, "x", None)], "app_key string, snapshot string, patch string, operator string, source_request string")
    with pytest.raises(Exception, match="bad app key"):
        versions.next_versions(spark.createDataFrame([], versions.VERSIONS), new).collect()


def _decide(corpus, decision="accepted"):
    cat = corpus.catalog()
    none = F.lit(None).cast("string")
    decisions = cat["links"].select("source_file", "key", F.lit(decision).alias("decision"), none.alias("on_from"), none.alias("on_to"))
    items = catalog.review_queue(cat["entities"], cat["fields"], cat["metrics"], cat["links"])
    return decisions, items.select("source_file", F.regexp_replace("item", "^(entity|field):", "").alias("id"))


def test_confirm(spark, tmp_path):
    corpus = understand(*_ledger(spark), dense=True)
    decisions, acknowledged = _decide(corpus)
    root = str(tmp_path)
    with pytest.raises(ConfirmError, match="links without a decision"):
        confirm(corpus, "b", "shop", root, decisions.limit(1), acknowledged)
    with pytest.raises(ConfirmError, match="under review"):
        confirm(corpus, "b", "shop", root, decisions, acknowledged.limit(0))
    assert versions.read_versions(spark, f"{root}/model_versions").count() == 0
    first = confirm(corpus, "b", "shop", root, decisions, acknowledged)
    assert (first.version, first.counts) == (1, {"customer": 12, "order": 40, "product": 8})
    assert confirm(corpus, "b", "shop", root, decisions, acknowledged).version == 2
    snapshot = versions.current_versions(versions.read_versions(spark, f"{root}/model_versions", "shop")).first()["snapshot"]
    order = next(e for e in versions.snapshot_entities(snapshot, spark) if e.key == "order")
    rows = loaded_rows(spark, root, "shop", "order", 2)
    assert rows.columns == [f.key for f in order.fields]
    assert rows.agg(F.sum("amount")).first()[0] == sum(i * 100 + 1 for i in range(40))


def test_all_tables_are_typed_like_one(spark):
    """One scan for all tables gives what typing each table alone gives, widened labels included."""
    other = Entity("note", "id", (Field("id", "number"), Field("phone", "phone"), Field("state", "enum", values=("A B", "AB", "ok")),
                                  Field("day", "date"), Field("tag", "enum", values=("t",)), Field("amount", "number")))
    at = {"id": 0, "phone": 2, "state": 1, "day": 3, "tag": 4, "amount": 9}
    one = [["A1", "¥12,800.00", "2022", "new"], ["A2", "abc", "2022-13", "on\nhold"], [None, "1", "N/A", "lost"], [None, " ", "", None], ["A3", "missing: x", None, "-"],
           ["A4", "２", "2020年5月", "fresh one"]]
    two = [["1", "A  B", "-", "20200102", "t"], ["x", "AB", "138 0013 8000", "?", " t "], ["3", "o k", None, "2020", "u"], [], [None, None, None, None, "w 1"]]
    rows = spark.createDataFrame([("b", s, i, r) for s, rs in (("s1", one), ("s2", two)) for i, r in enumerate(rs)],
                                 "source_file string, sheet string, row_no bigint, cells array<string>")
    placed = [("s1", ORDER, AT), ("s2", other, at)]
    wide = load.widen_tables(rows, placed)
    assert [e for _, e, _ in wide] == [load.widen_enums(e, rows.filter(F.col("sheet") == s), p) for s, e, p in placed]
    for some in (placed, wide):
        typed = load.typed_tables(rows, some)
        assert typed._jdf.queryExecution().executedPlan().toString().count("Scan") == 2  # the rows and the fields
        for sheet, entity, positions in some:
            good, bad = load.split_rows(load.typed_rows(rows.filter(F.col("sheet") == sheet), entity, positions))
            own = typed.filter(F.col("entity") == entity.key)
            got = own.filter("state = 'good'").select("row_no", *[F.col(load.stored_name(f.key, f.type)) for f in entity.fields])
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, good.collect()), key=str)
            broken = own.filter("state = 'bad'").select("row_no", F.inline("errors"))
            assert sorted(map(tuple, broken.collect()), key=str) == sorted(map(tuple, bad.collect()), key=str)


def test_rejects_block_a_load_and_loads_do_not_mix(spark, tmp_path):
    rows, columns = _ledger(spark)
    corpus = understand(rows, columns, dense=True)
    decisions, acknowledged = _decide(corpus)
    broken = replace(corpus, rows=rows.withColumn("cells", F.when(F.col("row_no") == 3, F.transform(
        "cells", lambda c, i: F.when(i > 0, c))).otherwise(F.col("cells"))))
    root = str(tmp_path)
    with pytest.raises(ConfirmError, match="row 3, .*: key is empty"):
        confirm(broken, "b", "shop", root, decisions, acknowledged)
    assert versions.read_versions(spark, f"{root}/model_versions").count() == 0
    first = confirm(broken, "b", "shop", root, decisions, acknowledged, allow_rejects=True)
    hints = spark.createDataFrame([("b", 0, next(r["sheet"] for r in corpus.plans.collect() if r["entity"] == "order"), "count", None, "orders as signed", 0.95)],
                                  "source_file string, position int, sheet string, op string, field string, definition string, confidence double")
    second = confirm(corpus, "b", "shop", root, decisions, acknowledged, definitions=hints)
    assert (first.version, second.version) == (1, 2) and first.load != second.load
    for entity in ("order", "customer", "product"):
        old, new = (loaded_rows(spark, root, "shop", entity, v).count() for v in (1, 2))
        assert (old, new) == (first.counts[entity], second.counts[entity]) and old + first.rejects[entity] == new
    assert {r["cause"] for r in loaded_rejects(spark, root, "shop", first.load).collect()} == {"key is empty"}
    snapshot = versions.current_versions(versions.read_versions(spark, f"{root}/model_versions", "shop")).first()["snapshot"]
    assert "orders as signed" in snapshot
    names = {r["entity"]: r["name"] for r in corpus.plans.collect()}
    assert all(f'"key":"{k}","name":"{n}"' in snapshot for k, n in names.items())


def test_publication_requests(spark):
    made = spark.createDataFrame([("a", "one", 1, "published"), ("b", "two", 1, "unpublished")],
                                 "app_key string, slug string, model_version bigint, status string")
    known = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3), ("d", 1)], "app_key string, version bigint")
    asked = spark.createDataFrame(
        [("a", None, "republish", 1), ("b", "ONE ", "republish", 2), ("c", "new", "publish", 3), ("d", "new", "publish", 4),
         ("c", "other", "publish", 5), ("x", "x", "publish", 6), (None, "y", "publish", 7), ("d2", None, None, 8)],
        "app_key string, slug string, action string, change_no int")
    _, rejects = versions.judge_requests(made, asked, known)
    assert {tuple(r) for r in rejects.collect()} == {
        ("b", "slug taken", 1), ("d", "slug taken", 1), ("c", "repeated request", 1), ("x", "unknown app", 1),
        (None, "unknown app", 1), ("d2", "unknown action", 1)}
    after = {r["app_key"]: (r["slug"], r["model_version"], r["status"]) for r in versions.publish_update(made, asked, known).collect()}
    assert after == {"a": ("one", 2, "published"), "b": ("two", 1, "unpublished"), "c": ("new", 3, "published")}
    none = asked.limit(0)
    assert versions.publish_update(made, none, known).count() == 2


def test_equal_cells_are_compared_with_labels_once(spark):
    rows = spark.createDataFrame([("b", "s", i, ["x", "new" if i % 3 else "old"]) for i in range(3, 60)] + [("b", "s", 1, [None, None])],
                                 "source_file string, sheet string, row_no bigint, cells array<string>")
    placed = [("s", Entity("e", "id", (Field("state", "enum", values=("old",)),)), {"state": 1})]
    spec, _ = load.typing_spec(spark, placed)
    cells = load._distinct_cells(rows, spec, 1).select("entity", "row_no", "cells", F.col("spec")[0]["pos"].alias("pos"))
    assert sorted(map(tuple, cells.collect())) == [("e", 3, ["old"], 0), ("e", 4, ["new"], 0)]
    assert load.widen_tables(rows, placed)[0][1].field("state").values == ("old", "new")
