"""Profiling and format predicates over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.operators import infer, profile
from tablewise.operators.numbering import stride_sample
from tablewise.session import materialize
from tablewise.sources.grid import table_rows
from tablewise.workloads import fixtures as fx
from tablewise.workloads.registry import query

CELLS = fx.corpus_sql()
COUNTS = f"{CELLS}, vc AS (SELECT sheet, pos, value, count(*) AS n FROM cells GROUP BY ALL)"


@query("profile_columns", f"""WITH {COUNTS} SELECT sheet, pos, CAST(sum(n) AS BIGINT) AS total_count,
  CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS null_count,
  CAST(coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS non_null_count,
  round_even(coalesce(sum(n) FILTER (value IS NULL), 0) / sum(n), 4) AS null_ratio,
  count(value) AS distinct_count, count(*) FILTER (value IS NOT NULL AND n = 1) AS unique_value_count,
  CAST(coalesce(sum(n) FILTER (value IS NOT NULL AND n > 1), 0) AS BIGINT) AS duplicate_cell_count,
  round_even(count(value) / sum(n) FILTER (value IS NOT NULL), 4) AS unique_ratio
FROM vc GROUP BY sheet, pos""")
def profile_columns(spark, sf):
    counts = profile.value_counts(fx.corpus_rows(spark, sf))
    return profile.column_profiles(counts).drop("source_file", "is_unique")


@query("profile_key_flags", f"""WITH {COUNTS} SELECT sheet, pos, coalesce(max(n) FILTER (value IS NOT NULL), 0) = 1 AS is_unique
FROM vc GROUP BY sheet, pos""")
def profile_key_flags(spark, sf):
    counts = profile.value_counts(fx.corpus_rows(spark, sf))
    return profile.column_profiles(counts).select("sheet", "pos", "is_unique")


@query("profile_top_values", f"""WITH {COUNTS}, r AS (SELECT sheet, pos, value, n AS count,
  row_number() OVER (PARTITION BY sheet, pos ORDER BY n DESC, value) AS rank FROM vc WHERE value IS NOT NULL)
SELECT * FROM r WHERE rank <= 5""")
def profile_top_values(spark, sf):
    return profile.top_values(profile.value_counts(fx.corpus_rows(spark, sf))).drop("source_file")


@query("profile_presence", f"""WITH {COUNTS} SELECT sheet, pos,
  round(coalesce(sum(n) FILTER (value IS NOT NULL), 0) / sum(n), 9) AS present,
  round(coalesce(count(value) / sum(n) FILTER (value IS NOT NULL), 0), 9) AS distinct FROM vc GROUP BY sheet, pos""")
def profile_presence(spark, sf):
    counts = profile.value_counts(fx.corpus_rows(spark, sf))
    return profile.presence(profile.column_profiles(counts)).select(
        "sheet", "pos", F.round("present", 9).alias("present"), F.round("distinct", 9).alias("distinct"))


@query("profile_duplicate_rows", f"""WITH {CELLS}, r AS (SELECT sheet, row_no, list(value ORDER BY pos) AS body FROM cells GROUP BY ALL),
c AS (SELECT sheet, body, count(*) AS n FROM r GROUP BY ALL)
SELECT sheet, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_row_count FROM c GROUP BY sheet""")
def profile_duplicate_rows(spark, sf):
    return profile.duplicate_rows(fx.corpus_rows(spark, sf)).drop("source_file")


@query("profile_tables", f"""WITH {CELLS} SELECT sheet, count(*) AS row_count, 100 AS sample_size_requested, count(*) <= 100 AS sample_is_full
FROM cells WHERE pos = 0 GROUP BY sheet""")
def profile_tables(spark, sf):
    return profile.table_profiles(fx.corpus_rows(spark, sf)).select("sheet", "row_count", "sample_size_requested", "sample_is_full")


PICKED = """sizes AS (SELECT sheet, max(row_no) + 1 AS total FROM cells GROUP BY sheet),
picks AS (SELECT sheet, unnest(CASE WHEN total <= 100 THEN range(0, total)
  ELSE list_transform(range(0, 100), lambda i: CAST(round_even(i * (total - 1) / 99.0::DOUBLE, 0) AS BIGINT)) END) AS row_no FROM sizes),
sampled AS (SELECT cells.* FROM cells SEMI JOIN picks USING (sheet, row_no))"""
SAMPLE = f"{CELLS}, {PICKED}"


@query("stride_sample", f"WITH {SAMPLE} SELECT sheet, row_no AS position, pos, value FROM sampled")
def sample(spark, sf):
    rows = stride_sample(fx.corpus_rows(spark, sf), dense=True)
    return rows.select("sheet", "position", F.posexplode("cells").alias("pos", "value"))


_CUT = "CASE WHEN length(value) > 80 THEN concat(left(value, 80), '…') ELSE coalesce(value, '~') END"


@query("head_preview", f"""WITH {fx.corpus_sql()}, d AS (SELECT 'documents' AS sheet, 0 AS pos, doc_id AS row_no, CAST(doc_id AS VARCHAR) AS value FROM documents
  UNION ALL SELECT 'documents', 1, doc_id, nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') FROM documents),
a AS (SELECT sheet, pos, row_no, value FROM cells UNION ALL SELECT * FROM d),
r AS (SELECT *, dense_rank() OVER (PARTITION BY sheet ORDER BY row_no) - 1 AS place FROM a)
SELECT sheet, place AS row_no, array_to_string(list({_CUT} ORDER BY pos), '|') AS body FROM r WHERE place < 20 GROUP BY sheet, place""")
def head_preview(spark, sf):
    docs = fx.read(spark, sf, "documents").select("doc_id", "text")
    rows = fx.corpus_rows(spark, sf).unionByName(table_rows(docs, fx.BOOK, "documents", "doc_id"))
    return profile.preview(rows).select("sheet", "row_no", F.array_join("cells", "|", "~").alias("body"))


@query("missing_markers", f"""WITH {CELLS} SELECT sheet, pos, count(*) FILTER ({fx.sql_missing('value')}) AS missing,
  count(DISTINCT value) FILTER ({fx.sql_missing('value')}) AS markers FROM cells GROUP BY sheet, pos""")
def missing_markers(spark, sf):
    counts = profile.value_counts(fx.corpus_rows(spark, sf))
    gone = text.is_missing(F.col("value"))
    return counts.groupBy("sheet", "pos").agg(
        F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("missing"),
        F.count(F.when(gone, F.col("value"))).alias("markers"))


@query("effective_counts", f"""WITH {COUNTS} SELECT sheet, pos, count(*) FILTER (NOT {fx.sql_missing('value')}) AS effective_distinct,
  CAST(coalesce(sum(n) FILTER (NOT {fx.sql_missing('value')}), 0) AS BIGINT) AS effective_filled FROM vc GROUP BY sheet, pos""")
def effective(spark, sf):
    return profile.effective_counts(profile.value_counts(fx.corpus_rows(spark, sf))).drop("source_file")


@query("enum_value_sets", f"""WITH {COUNTS} SELECT sheet, pos, string_agg(value, '|' ORDER BY value) AS labels FROM vc
WHERE NOT {fx.sql_missing('value')} GROUP BY sheet, pos HAVING count(*) <= 20""")
def enum_value_sets(spark, sf):
    counts = materialize(profile.value_counts(fx.corpus_rows(spark, sf)), "value_counts")
    sets = profile.value_sets(counts, facts=profile.effective_counts(counts))
    return sets.select("sheet", "pos", F.array_join("values", "|").alias("labels"))


def _kinds(v: str) -> str:
    tests = {"is_date": fx.sql_is_date, "is_phone": fx.sql_phone, "is_money": fx.sql_money, "is_number": fx.sql_number}
    return ", ".join(f"count(*) FILTER ({f(v)}) AS {k}" for k, f in tests.items())


@query("format_predicates", f"WITH {CELLS} SELECT sheet, pos, {_kinds('value')} FROM cells GROUP BY sheet, pos")
def format_predicates(spark, sf):
    # Each distinct value is tested once; the counts weigh the outcome.
    counts, v = profile.value_counts(fx.corpus_rows(spark, sf)), F.col("value")
    tests = {"is_date": text.is_date, "is_phone": text.is_phone, "is_money": text.is_money, "is_number": text.is_number}
    return counts.groupBy("sheet", "pos").agg(*[
        F.coalesce(F.sum(F.when(f(v), F.col("n"))), F.lit(0)).alias(k) for k, f in tests.items()])


@query("type_ratios", f"""WITH {SAMPLE}, real AS (SELECT * FROM sampled WHERE NOT {fx.sql_missing('value')})
SELECT sheet, pos, count(*) AS sample_values, round(avg(CASE WHEN {fx.sql_is_date('value')} THEN 1.0 ELSE 0 END), 9) AS r_date,
  round(avg(CASE WHEN {fx.sql_phone('value')} THEN 1.0 ELSE 0 END), 9) AS r_phone,
  round(avg(CASE WHEN {fx.sql_money('value')} THEN 1.0 ELSE 0 END), 9) AS r_money,
  round(avg(CASE WHEN {fx.sql_number('value')} THEN 1.0 ELSE 0 END), 9) AS r_number,
  max(length(value)) AS max_chars, round(avg(length(value)), 9) AS avg_chars FROM real GROUP BY sheet, pos""")
def type_ratios(spark, sf):
    ratios = infer.sample_ratios(stride_sample(fx.corpus_rows(spark, sf), dense=True))
    kept = ratios.filter(F.col("sample_values") > 0)
    r9 = [F.round(c, 9).alias(c) for c in ("r_date", "r_phone", "r_money", "r_number", "avg_chars")]
    return kept.select("sheet", "pos", "sample_values", "max_chars", *r9)
