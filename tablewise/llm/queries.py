"""Registered queries of the operators, and SQL for those that it can express.

Learned scores, sampling, tokenizers, eigenvectors and archives in their own format have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewise.llm import alignment, counting, language, mixing, neardup, packing, quality, rans, recurrent, toxicity, vectors, warc, whitening
from tablewise.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after masking addresses and long numbers."""
    return counting.edited_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, similarity=(80, 100))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_report(warc.archive(table(spark, sf_dir, "pages")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(table(spark, sf_dir, "documents"), with_ids=False)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under the recurrent model, beside that of single words."""
    return recurrent.log_likelihood(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every text."""
    return alignment.align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_mixing, op3_packing, op4_quality, op5_counting, op6_near_duplicates, op7_warc,
             op8_language, op9_token_files, op10_near_vectors, op11_recurrent, op12_whitening, op13_alignment)
    return {f.__name__: f for f in found}


_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)"""

OP6_SQL = f"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, len(w) AS words, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM worded),
shingled AS (SELECT doc_id, words, i, concat_ws(' ', x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p) AS x
    FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, x FROM shingled WHERE i = 1 OR i <= words - 3),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
each AS (SELECT * FROM sets JOIN sizes USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
{_COMPONENTS},
least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id"""

# Five hexadecimal digits make four signs of base 32.
OP7_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

OP10_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
{_COMPONENTS},
least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_duplicates": OP6_SQL, "op7_warc": OP7_SQL, "op10_near_vectors": OP10_SQL}
