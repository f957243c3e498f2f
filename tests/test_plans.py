"""The shape of the plans: what must hold on large data."""

import pytest
from pyspark.sql import functions as F

from tablewise.operators import infer, profile, query as q
from tablewise.operators.numbering import number_rows
from tablewise.session import materialize
from tablewise.sources.parquet import indexed_parquet
from tablewise.workloads import fixtures as fx
from tablewise.workloads import all_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = q.filter_rows(fx.orders(spark, sf_dir), {"order_status": ["F"]}).select("order_id")
    text = plan(df)
    assert "PushedFilters: [In(o_orderstatus" in text or "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_ranks_are_cut_before_their_shuffle(spark, sf_dir):
    counts = profile.value_counts(fx.corpus_rows(spark, sf_dir, {"order"}))
    for df in (profile.top_values(counts), profile.value_sets(counts), profile.preview(fx.corpus_rows(spark, sf_dir, {"order", "customer"}))):
        assert "WindowGroupLimit" in plan(df)
    top = q.related_top(fx.customers(spark, sf_dir), fx.orders(spark, sf_dir), "customer_id", "customer_id", [("order_date", "desc")], "order_id")
    assert "WindowGroupLimit" in plan(top)


def test_bytes_of_files_do_not_reach_the_join(spark):
    from tablewise.sources import grid

    files = spark.createDataFrame([(f"/x/{i}", 1, bytearray(b"x" * i)) for i in range(5)], "path string, length bigint, content binary")
    seen = files.limit(2).select(grid.file_hash(F.col("content"), "v").alias("content_hash"))
    fresh = grid.new_files(files, seen, "v")
    assert fresh.columns == ["path", "length", "content_hash"] and fresh.count() == 3
    join = fresh._jdf.queryExecution().optimizedPlan()
    assert all("content#" not in str(c.output()) for c in [join.children().head()])


def test_cells_are_built_once(spark, sf_dir):
    counts = profile.value_counts(fx.corpus_rows(spark, sf_dir, {"order"}))
    assert "size(array" not in plan(counts)


def test_page_near_the_front_is_a_top_k(spark, sf_dir):
    rows = q.run_list_query(fx.orders(spark, sf_dir), q.ListQuery(sorts=(("amount", "asc"),)), "order_id").rows
    assert "TakeOrderedAndProject" in plan(rows)


def test_windows_never_span_a_table(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("source_file"), (F.col("id") % 2).cast("string").alias("sheet"), "id")
    text = plan(number_rows(df, "id"))
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", [
    "related_all", "profile_columns", "link_scores", "clean_rows", "validate_split", "apply_updates", "version_risks", "catalog_errors"])
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(all_queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_small_batches_do_not_shuffle_the_table(spark):
    from tablewise.operators import changes
    from tablewise.operators.query import Entity, Field

    entity = Entity("e", "k", (Field("k", "string", "identifier"), Field("v", "string", "label")))
    big = spark.range(200_000).selectExpr("cast(id as string) k", "repeat('v', 60) v")
    few = spark.createDataFrame([("7", "x"), ("new", "y")], "k string, v string")
    frames = [*changes.create_rows(big, few, entity), *changes.update_rows(big, few, entity),
              *changes.delete_rows(big, few.select(F.col("k").alias("key")), entity)]
    for df in frames:
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [df.count() for df in frames] == [200_001, 1, 200_000, 1, 199_999, 1]


def test_row_numbers_of_files_need_no_shuffle_of_rows(spark, sf_dir):
    """Joined by a shuffle on the file, all rows of a file met in one task."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(indexed_parquet(fx.read(spark, sf_dir, "lineitem")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_versions_are_not_broadcast(spark, sf_dir):
    """Made snapshots look small to the planner; all of them came to the driver."""
    text = plan(all_queries()["restore_version"](spark, sf_dir))
    assert "BroadcastExchange" not in text


def test_value_counts_are_read_once_for_the_facts(spark, sf_dir):
    """One pass gives profiles and formats, one more the values of narrow columns, neither sorts the values."""
    counts = materialize(profile.value_counts(fx.corpus_rows(spark, sf_dir, {"order"})), "counts")
    fields = infer.infer_fields(fx.corpus_columns(spark, sf_dir, {"order"}), counts)
    text = plan(fields)
    assert text.count(counts._stored_at.rsplit("/", 1)[1]) <= 1 and "Window" not in text


def test_profiles_of_linked_tables_are_stored(spark, sf_dir):
    from tablewise.workloads.linking import profiled

    _, _, profiles, counts = profiled(spark, sf_dir)
    assert "_stored_at" in vars(profiles) and "_stored_at" in vars(counts)
