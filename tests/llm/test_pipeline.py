"""The pipeline's stages on a small corpus, and the registered queries over whole tables."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tablewise.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("score", F.lit(1))
    docs = docs.union(docs.filter("doc_id = 1")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    last = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        now = docs.count()
        assert now > 0 and (name.startswith("mixing") or now < last)
        last = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == last


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.select(*corpus_pipeline.COLUMNS) if "text" in docs.columns else docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()])
def test_query_covers_its_table(spark, name):
    source = {"op7_warc": "pages", "op10_near_vectors": "embeddings", "op12_whitening": "embeddings"}.get(name, "documents")
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001")
    key = rows.columns[0]
    assert rows.select(key).distinct().count() == table(spark, "/root/testdata/sf0.001", source).count()


def test_pipeline_query(spark):
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
