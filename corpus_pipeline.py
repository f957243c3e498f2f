"""From raw documents to packed sequences: drop toxic and poor texts and near copies, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm import mixing, neardup, packing, quality, toxicity
from tablewise.llm.common import new_folder, table
from tablewise.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL cannot express learned scores, sampling or tokenizers; a test runs a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood threshold stay; null and empty texts fail."""
    return quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=tuple(COLUMNS)).filter("kept").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and one row of rows equal in id and text; rows without an id stay."""
    docs = docs.select(*COLUMNS)
    kept = materialize(neardup.near_duplicates(docs, with_text=True).filter("chosen and doc_id is not null").groupBy(
        "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows")), "kept")
    hashed = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    return _once(hashed.join(_sent(kept), ["doc_id", "text_hash"])).select(*COLUMNS).union(docs.filter("doc_id is null"))


def _sent(light: DataFrame) -> DataFrame:
    """Ids and counts beside the texts: up to ``BROADCAST_ROWS`` of them are broadcast, so texts stay put."""
    return F.broadcast(light) if light.count() <= packing.BROADCAST_ROWS else light


def _once(named: DataFrame) -> DataFrame:
    """One row of rows equal in id and text; only those that are known to repeat are shuffled for it."""
    return named.filter("_rows = 1").union(named.filter("_rows > 1").dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in id and text share their draws, rows without an
    id are taken once."""
    docs = docs.select(*COLUMNS)
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    drawn = mixing.mix(docs.withColumn("doc_id", key)).filter("doc_id is not null").groupBy("doc_id").agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    drawn = materialize(drawn.filter("_copies > 0").withColumnRenamed("doc_id", "_key"), "drawn")
    named = _once(docs.withColumn("_key", key).join(_sent(drawn), "_key"))
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_time")
    return named.select(*COLUMNS, times).drop("_time").union(docs.filter("doc_id is null"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset."""
    # Workers still hold what earlier stages left, so this stage remembers fewer words.
    return packing.pack(docs, remember=60_000, part_bytes=1 << 21)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("MinHash near-dedup", drop_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
