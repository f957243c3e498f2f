"""Links between the tables of the workbook."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewise.functions import vocab as V
from tablewise.operators import links, profile
from tablewise.session import materialize
from tablewise.workloads import fixtures as fx
from tablewise.workloads.profiles import COUNTS
from tablewise.workloads.registry import query

# Key columns as the tables were designed: the links are judged apart from the inference.
KEYS = {
    "customer": 0, "order": 0, "line item": 0, "product": 0, "supplier": 0, "nation": 0, "region": 0, "sales dirty": 0,
}
_KEYS_SQL = ", ".join(f"('{s}', {p})" for s, p in KEYS.items())
_PARTY = fx.sql_word("c.col", V.CUSTOMER_TABLES + V.PRODUCT_TABLES)


def profiled(spark, sf):
    """Plans, columns, profiles and value counts of the corpus with the designed keys; both are stored, as several steps read them."""
    sheets = set(KEYS)
    columns = fx.corpus_columns(spark, sf, sheets)
    counts = materialize(profile.value_counts(fx.corpus_rows(spark, sf, sheets)), "value_counts")
    keys = spark.createDataFrame([(fx.BOOK, s, p, s.replace(" ", "_")) for s, p in KEYS.items()],
                                 "source_file string, sheet string, key_pos int, entity string")
    plans = keys.join(
        columns.select("source_file", "sheet", F.col("pos").alias("key_pos"), F.col("column").alias("key_field")),
        ["source_file", "sheet", "key_pos"])
    return plans, columns, materialize(profile.column_profiles(counts), "profiles"), counts


TAIL = f"""st AS (SELECT sheet, pos, count(value) AS d, coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS filled FROM vc GROUP BY ALL),
p AS (SELECT k.sheet AS parent, k.pos AS ppos, n.col AS pcol, s.d AS pd FROM keys k JOIN names n USING (sheet, pos) JOIN st s USING (sheet, pos)),
c AS (SELECT n.sheet AS child, n.pos, n.col, s.d AS cd FROM names n JOIN st s USING (sheet, pos)
  WHERE s.d < s.filled AND n.sheet IN (SELECT sheet FROM keys) AND (n.sheet, n.pos) NOT IN (SELECT (sheet, pos) FROM keys)),
ov AS (SELECT a.sheet AS parent, b.sheet AS child, b.pos, count(*) AS overlap FROM vc a JOIN keys k ON a.sheet = k.sheet AND a.pos = k.pos
  JOIN vc b ON a.value = b.value AND a.sheet <> b.sheet GROUP BY ALL),
pairs AS (SELECT p.*, c.*, coalesce(overlap, 0) AS overlap, coalesce(overlap, 0) / pd AS recall, coalesce(overlap, 0) / cd AS precision,
  pcol = col AS same FROM p JOIN c ON parent <> child LEFT JOIN ov USING (parent, child, pos)),
scored AS (SELECT *, CASE WHEN same AND recall >= 0.8 THEN 0.88 WHEN same AND recall >= 0.5 THEN 0.75
  WHEN NOT same AND recall >= 0.9 AND precision >= 0.5 AND {_PARTY.replace('c.col', 'col')} THEN 0.75
  WHEN same AND {fx.sql_word('col', V.IDENTIFIER_NAMES)} THEN 0.63 END AS confidence FROM pairs),
good AS (SELECT * FROM scored WHERE confidence IS NOT NULL),
best AS (SELECT parent, child, ppos, pcol, pos, col, confidence::DOUBLE AS confidence, round_even(recall, 4) AS recall, round_even(precision, 4) AS precision, same FROM good
  QUALIFY row_number() OVER (PARTITION BY parent, child ORDER BY confidence DESC, good.recall DESC, pos) = 1),
mutual AS (SELECT a.* FROM best a LEFT JOIN best b ON a.parent = b.child AND a.child = b.parent
  WHERE b.parent IS NULL OR (a.confidence, a.recall, a.precision) > (b.confidence, b.recall, b.precision)),
rownos AS (SELECT k.sheet FROM keys k JOIN vc USING (sheet, pos) WHERE value IS NOT NULL GROUP BY k.sheet
  HAVING count(*) >= 2 AND bool_and(regexp_matches(value, '^[+-]?[0-9]+$')) AND min(try_cast(value AS BIGINT)) = 1
    AND max(try_cast(value AS BIGINT)) = count(*)),
final AS (SELECT *, CASE WHEN parent IN (SELECT sheet FROM rownos) AND recall > 0 THEN least(confidence, 0.5) ELSE confidence END AS capped FROM mutual)"""
_stored = lambda df: materialize(df, "candidates")
LINKS = f"{COUNTS}, keys(sheet, pos) AS (VALUES {_KEYS_SQL}), names AS (SELECT DISTINCT sheet, pos, col FROM cells), {TAIL}"


@query("link_overlap", f"""WITH {LINKS} SELECT parent, child, pos, overlap, CAST(pd AS BIGINT) AS parent_distinct, CAST(cd AS BIGINT) AS child_distinct
FROM pairs WHERE same OR ({_PARTY.replace('c.col', 'col')} AND cd >= 0.9 * pd - 1 AND cd <= 2 * pd + 1)""")
def link_overlap(spark, sf):
    plans, columns, profiles, counts = profiled(spark, sf)
    pairs = _stored(links.candidates(plans, columns, profiles))
    key = ["source_file", "parent", "parent_pos", "child", "pos"]
    found = pairs.join(links.value_overlap(pairs, counts), key, "left").fillna(0, ["overlap"])
    return found.select("parent", "child", "pos", "overlap", "parent_distinct", "child_distinct")


@query("link_scores", f"""WITH {LINKS} SELECT parent, child, pcol AS parent_key, col AS column, round(recall, 6) AS recall,
  round(precision, 6) AS precision, confidence::DOUBLE AS confidence FROM good""")
def link_scores(spark, sf):
    plans, columns, profiles, counts = profiled(spark, sf)
    scored = links.score(_stored(links.candidates(plans, columns, profiles)), counts)
    return scored.select("parent", "child", "parent_key", "column", F.round("recall", 6).alias("recall"),
                         F.round("precision", 6).alias("precision"), "confidence")


_BEST = "parent, child, pcol AS on_from, col AS on_to, confidence, recall, precision"


@query("link_best", f"WITH {LINKS} SELECT {_BEST} FROM best")
def link_best(spark, sf):
    plans, columns, profiles, counts = profiled(spark, sf)
    scored = links.score(_stored(links.candidates(plans, columns, profiles)), counts)
    return links.best_per_pair(scored).select("parent", "child", "on_from", "on_to", "confidence", "recall", "precision")


@query("link_mutual", f"""WITH {LINKS}, opposed AS (SELECT * FROM best UNION ALL
  SELECT child, parent, pos, col, ppos, pcol, CASE WHEN child = 'order' THEN confidence ELSE 0.5 END, recall, precision, same FROM best),
kept AS (SELECT a.* FROM opposed a LEFT JOIN opposed b ON a.parent = b.child AND a.child = b.parent
  WHERE b.parent IS NULL OR (a.confidence, a.recall, a.precision) > (b.confidence, b.recall, b.precision))
SELECT parent, child, pcol AS on_from, col AS on_to, confidence::DOUBLE AS confidence FROM kept""")
def link_mutual(spark, sf):
    # Every link gets an opposite one; those of the order table tie and vanish both.
    plans, columns, profiles, counts = profiled(spark, sf)
    best = links.best_per_pair(links.score(_stored(links.candidates(plans, columns, profiles)), counts))
    confidence = F.when(F.col("child") == "order", F.col("confidence")).otherwise(0.5)
    mirrored = best.select(
        "source_file", F.col("child").alias("parent"), F.col("parent").alias("child"), F.col("pos").alias("parent_pos"),
        F.col("on_to").alias("on_from"), F.col("parent_pos").alias("pos"), F.col("on_from").alias("on_to"),
        confidence.alias("confidence"), "recall", "precision", "needs_review", "review_reason", "signals")
    kept = links.resolve_mutual(best.unionByName(mirrored))
    return kept.select("parent", "child", "on_from", "on_to", "confidence")


@query("link_positional", f"WITH {LINKS} SELECT sheet FROM rownos")
def link_positional(spark, sf):
    plans, _, profiles, counts = profiled(spark, sf)
    return links.positional_keys(plans, links.value_index(links.key_columns(plans, profiles), counts)).select("sheet")


@query("links_final", f"""WITH {LINKS} SELECT parent, child, pcol AS on_from, col AS on_to, capped::DOUBLE AS confidence, recall, precision,
  capped < confidence AS positional FROM final""")
def links_final(spark, sf):
    found, _ = links.discover_links(*profiled(spark, sf))
    return found.select("parent", "child", "on_from", "on_to", "confidence", "recall", "precision",
                        F.array_contains("signals", "low_discrimination_key").alias("positional"))


# Given links: one per non-key column of the line items towards two parents, by sheet or
# entity name, plus some that cannot be resolved.
def link_hints(columns):
    lines = columns.filter(F.col("sheet").isin("line item", "sales dirty"))
    to = F.when(F.col("sheet") == "line item", "line_item").otherwise("sales dirty")
    one = lambda parent, key: lines.select(
        "source_file", F.lit(parent).alias("from_entity"), to.alias("to_entity"), F.lit(key).alias("on_from"),
        F.col("column").alias("on_to"), F.lit(0.9).alias("confidence"))
    return one("order", "order_id").unionByName(one("customer", "customer_id")).unionByName(
        one("customer", "no_such")).unionByName(one("ghost", "order_id"))


_HINTS = """hints AS (SELECT n.sheet AS child, n.pos, n.col AS on_to, h.* FROM names n, (VALUES ('order', 'order_id'),
  ('customer', 'customer_id'), ('customer', 'no_such'), ('ghost', 'order_id')) h(parent, on_from) WHERE n.sheet IN ('line item', 'sales dirty'))"""
GIVEN = f"""{LINKS}, {_HINTS}, ov2 AS (SELECT h.parent, h.child, h.pos, count(*) AS overlap FROM hints h JOIN vc a ON a.sheet = h.parent AND a.pos = 0
    JOIN vc b ON b.sheet = h.child AND b.pos = h.pos AND a.value = b.value WHERE h.on_from <> 'no_such' GROUP BY 1, 2, 3),
given AS (SELECT h.parent, h.child, on_from, on_to, h.pos, least(0.9, CASE WHEN coalesce(overlap, 0) > 0 THEN 0.8 ELSE 0.6 END)::DOUBLE AS confidence,
  round_even(coalesce(overlap, 0) / a.d, 4) AS recall, round_even(coalesce(overlap, 0) / b.d, 4) AS precision FROM hints h
  JOIN st a ON a.sheet = h.parent AND a.pos = 0 JOIN st b ON b.sheet = h.child AND b.pos = h.pos LEFT JOIN ov2 o ON o.parent = h.parent AND o.child = h.child AND o.pos = h.pos
  WHERE h.pos <> 0 AND on_from <> 'no_such')"""


@query("verify_links", f"WITH {GIVEN} SELECT parent, child, on_from, on_to, confidence, recall, precision FROM given")
def verify_links(spark, sf):
    plans, columns, profiles, counts = profiled(spark, sf)
    found, _ = links.verify_links(link_hints(columns), plans, columns, profiles, counts)
    return found.select("parent", "child", "on_from", "on_to", "confidence", "recall", "precision")


@query("verify_rejects", f"""WITH {GIVEN} SELECT parent AS from_entity, replace(child, 'line item', 'line_item') AS to_entity, on_from, on_to,
  CASE WHEN parent = 'ghost' THEN 'unknown entity' WHEN on_from = 'no_such' THEN 'parent column does not exist'
    ELSE 'child column is its own key' END AS cause FROM hints WHERE parent = 'ghost' OR on_from = 'no_such' OR pos = 0""")
def verify_rejects(spark, sf):
    plans, columns, profiles, counts = profiled(spark, sf)
    _, rejects = links.verify_links(link_hints(columns), plans, columns, profiles, counts)
    return rejects.select("from_entity", "to_entity", "on_from", "on_to", "cause")


@query("merge_links", f"""WITH {GIVEN}, f AS (SELECT parent, child, pcol AS on_from, col AS on_to, pos, capped::DOUBLE AS confidence, recall, precision FROM final),
u AS (SELECT * FROM f UNION ALL SELECT g.parent, g.child, g.on_from, g.on_to, g.pos, g.confidence, g.recall, g.precision FROM given g
  ANTI JOIN f ON f.parent = g.parent AND f.child = g.child AND f.pos = g.pos),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY parent, child ORDER BY confidence DESC, recall DESC, precision DESC) = 1),
m AS (SELECT a.* FROM o a LEFT JOIN o b ON a.parent = b.child AND a.child = b.parent
  WHERE b.parent IS NULL OR (a.confidence, a.recall, a.precision) > (b.confidence, b.recall, b.precision))
SELECT parent, child, CASE WHEN parent IN (SELECT sheet FROM rownos) AND recall > 0 THEN least(confidence, 0.5) ELSE confidence END AS confidence,
  recall, precision FROM m""")
def merge_links(spark, sf):
    plans, columns, profiles, counts = profiled(spark, sf)
    found, positional = links.discover_links(plans, columns, profiles, counts)
    given, _ = links.verify_links(link_hints(columns), plans, columns, profiles, counts)
    merged = links.merge_links(found, given, positional)
    return merged.select("parent", "child", "confidence", "recall", "precision")


@query("link_decisions", f"""WITH {LINKS} SELECT parent || '_to_' || replace(child, ' ', '_') AS key, col AS on_to,
  CASE WHEN parent = 'nation' THEN 'rejected' WHEN parent = 'region' THEN 'missing' ELSE 'kept' END AS outcome FROM final""")
def link_decisions(spark, sf):
    plans, columns, profiles, counts = profiled(spark, sf)
    found = materialize(links.discover_links(plans, columns, profiles, counts)[0], "links")
    entity = plans.select("source_file", F.col("sheet").alias("child"), F.col("entity").alias("to_entity"))
    named = found.join(entity, ["source_file", "child"]).withColumn(
        "key", F.concat_ws("_to_", "parent", "to_entity"))
    # Links of one parent are rejected, those of another left open, the rest accepted.
    decisions = named.filter(F.col("parent") != "region").select(
        "source_file", "key", F.when(F.col("parent") == "nation", "rejected").otherwise("accepted").alias("decision"),
        F.lit(None).cast("string").alias("on_from"), F.lit("").alias("on_to"))
    done = links.apply_decisions(named, decisions)
    on_to = named.select("key", "on_to")
    out = done["kept"].select("key", "on_to", F.lit("kept").alias("outcome"))
    for part in ("rejected", "missing", "unknown"):
        out = out.unionByName(done[part].join(on_to, "key").select("key", "on_to", F.lit(part).alias("outcome")))
    return out


