"""One-to-many links between the tables of a workbook.

Candidates are chosen on the catalog first: a child column either shares the parent
key's name, or has a party or product word in its name and a distinct count that can
still reach the needed overlap. The values of those columns, and of all keys, then meet once, on
(workbook, value): an index tells which columns hold a value, and is counted by sets of columns.
Overlaps and row-number keys are sums over these sets. No group holds more rows than the workbook
has columns, whatever the values look like.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.operators.numbering import TABLE
from tablewise.operators.profile import COLUMN
from tablewise.session import materialize

# Overlap thresholds and confidences of the link ladder.
STRONG_RECALL, MEDIUM_RECALL = 0.80, 0.50
OTHER_NAME_RECALL, OTHER_NAME_PRECISION = 0.90, 0.50
SAME_STRONG, SAME_MEDIUM, OTHER_NAME, SAME_UNVERIFIED = 0.88, 0.75, 0.75, 0.63
HINT_OVERLAP, HINT_NO_OVERLAP = 0.8, 0.6

PAIR = ("source_file", "parent", "child", "pos")
PARTY_WORDS = V.CUSTOMER_TABLES + V.PRODUCT_TABLES


def parent_keys(plans: DataFrame, profiles: DataFrame) -> DataFrame:
    """Key column of every eligible table with its distinct count."""
    sizes = profiles.select(*COLUMN, F.col("distinct_count").alias("parent_distinct"))
    return plans.select(
        *TABLE, F.col("key_pos").alias("pos"), F.col("key_field").alias("parent_key")
    ).join(sizes, list(COLUMN)).filter(F.col("parent_distinct") > 0).select(
        "source_file", F.col("sheet").alias("parent"), F.col("pos").alias("parent_pos"),
        "parent_key", "parent_distinct",
    )


def child_columns(plans: DataFrame, columns: DataFrame, profiles: DataFrame) -> DataFrame:
    """Non-key columns of eligible tables whose values repeat (the "many" side)."""
    sizes = profiles.filter(F.col("distinct_count") < F.col("non_null_count")).select(
        *COLUMN, F.col("distinct_count").alias("child_distinct")
    )
    return (
        columns.select(*COLUMN, "column").join(plans.select(*TABLE, "key_pos"), list(TABLE))
        .filter(F.col("pos") != F.col("key_pos")).join(sizes, list(COLUMN))
        .select("source_file", F.col("sheet").alias("child"), "pos", "column", "child_distinct")
    )


def candidates(plans: DataFrame, columns: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs of parent key and child column that any rung of the ladder could accept."""
    parents, children = parent_keys(plans, profiles), child_columns(plans, columns, profiles)
    other = F.col("parent") != F.col("child")
    name = lambda c: text.strip(F.col(c))
    same = (
        parents.withColumn("_n", name("parent_key")).join(
            children.withColumn("_n", name("column")), ["source_file", "_n"])
        .filter(other).drop("_n").withColumn("same_name", F.lit(True))
    )
    # Recall >= .9 and precision >= .5 bound the child's distinct count by .9 and 2 times the
    # parent's, so whole-number logarithms differ by at most one.
    size = lambda c: F.floor(F.log2(F.col(c))).cast("int")
    near = F.explode(F.sequence(size("parent_distinct") - 1, size("parent_distinct") + 1))
    differ = (
        parents.withColumn("_b", near).join(
            children.filter(text.has_word(F.col("column"), PARTY_WORDS)).withColumn("_b", size("child_distinct")),
            ["source_file", "_b"])
        .filter(other & (name("parent_key") != name("column"))
                & (F.col("child_distinct") >= OTHER_NAME_RECALL * F.col("parent_distinct") - 1)
                & (F.col("child_distinct") <= F.col("parent_distinct") / OTHER_NAME_PRECISION + 1))
        .drop("_b").withColumn("same_name", F.lit(False))
    )
    return same.unionByName(differ)


#: Parts of a column at least, and values of a part at most.
SALTS, SALT_VALUES = 32, 4_000_000


def column_values(values: DataFrame, catalog: DataFrame, key: list[str], salts: int = SALTS) -> DataFrame:
    """Values of the columns a catalog table names.

    The values of one column may be a third of all, so a shuffled join splits them by a salt,
    with the catalog row copied once per salt.
    """
    salt = F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int")
    copies = catalog.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return values.withColumn("_salt", salt).join(copies, [*key, "_salt"]).drop("_salt")


#: Columns whose bits share one whole number.
MASK_BITS = 62


@dataclass(frozen=True)
class ValueIndex:
    """Which columns of a workbook hold a value, counted by the set of columns.

    ``ids (source_file, sheet, pos, id)`` numbers the columns of a workbook from 0. ``patterns (source_file,
    masks, n, whole, low, high)`` has one row per set of columns, as bits: how many values exactly these
    columns hold, whether all are whole numbers, and the least and largest.
    """

    ids: DataFrame
    patterns: DataFrame

    def holds(self, number: Column) -> Column:
        """Whether the set of a pattern has a column."""
        mask = F.get("masks", (number / MASK_BITS).cast("int"))
        return mask.bitwiseAND(_bit(number)) != 0


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(MASK_BITS)).cast("int"))


def value_index(used: DataFrame, counts: DataFrame) -> ValueIndex:
    """Index of the values of the columns ``used (source_file, sheet, pos, distinct_count)``.

    The values meet in one exchange, on (workbook, value), where each holds as many rows as columns have it;
    only bits are kept of them. Everything else is read from the patterns.
    """
    order = Window.partitionBy("source_file").orderBy("sheet", "pos")
    ids = materialize(used.groupBy(*COLUMN).agg(F.max("distinct_count").alias("distinct_count")).withColumn(
        "id", F.row_number().over(order) - 1), "column-ids")
    most, last = ids.agg(F.max("distinct_count"), F.max("id")).first()
    salts = max(SALTS, -(-(most or 0) // SALT_VALUES))
    held = column_values(counts.filter(F.col("value").isNotNull()).select(*COLUMN, "value"), ids.select(*COLUMN, "id"), list(COLUMN), salts)
    slot = (F.col("id") / MASK_BITS).cast("int")
    names = [f"_m{k}" for k in range((last or 0) // MASK_BITS + 1)]
    bits = [F.bit_or(F.when(slot == k, _bit(F.col("id"))).otherwise(F.lit(0).cast("bigint"))).alias(m) for k, m in enumerate(names)]
    number = F.col("value").try_cast("decimal(38,0)")
    sets = held.groupBy("source_file", "value").agg(*bits)
    patterns = sets.groupBy("source_file", *names).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value").rlike(r"(?U)^[+-]?\d+$")).alias("whole"),
        F.min(number).alias("low"), F.max(number).alias("high"))
    return ValueIndex(ids, materialize(patterns.select("source_file", F.array(*names).alias("masks"), "n", "whole", "low", "high"), "value-sets"))


def used_columns(pairs: DataFrame, *more: DataFrame) -> DataFrame:
    """Columns on both sides of the pairs, with their distinct counts, and others."""
    sides = [pairs.select("source_file", F.col(sheet).alias("sheet"), F.col(pos).alias("pos"), F.col(size).alias("distinct_count"))
             for sheet, pos, size in (("parent", "parent_pos", "parent_distinct"), ("child", "pos", "child_distinct"))]
    return reduce(DataFrame.unionByName, [*sides, *more])


def value_overlap(pairs: DataFrame, counts: DataFrame, index: ValueIndex | None = None) -> DataFrame:
    """Shared distinct values of every pair ``(source_file, parent, parent_pos, child, pos)``.

    The pairs carry ``parent_distinct`` and ``child_distinct``. A pair sums the patterns that have both columns;
    they meet on the parent's number, so a pattern is copied once for each parent key in it.
    """
    index = index or value_index(used_columns(pairs), counts)
    numbered = pairs.join(index.ids.select("source_file", F.col("sheet").alias("parent"), F.col("pos").alias("parent_pos"), F.col("id").alias("parent_id")),
                          ["source_file", "parent", "parent_pos"]).join(
        index.ids.select("source_file", F.col("sheet").alias("child"), "pos", F.col("id").alias("child_id")), ["source_file", "child", "pos"])
    parents = numbered.select("source_file", "parent_id").distinct()
    several = index.patterns.filter(F.aggregate("masks", F.lit(0), lambda a, m: a + F.bit_count(m)) > 1)
    places = F.filter(F.sequence(F.lit(0), F.size("masks") * MASK_BITS - 1), lambda k: index.holds(k))
    placed = several.select("source_file", "masks", "n", F.explode(places).alias("parent_id")).join(parents, ["source_file", "parent_id"], "left_semi")
    shared = numbered.join(placed, ["source_file", "parent_id"]).filter(index.holds(F.col("child_id")))
    return shared.groupBy("source_file", "parent", "parent_pos", "child", "pos").agg(F.sum("n").alias("overlap"))


def score(pairs: DataFrame, counts: DataFrame, index: ValueIndex | None = None) -> DataFrame:
    """Recall, precision and the ladder's verdict for every candidate that passes it."""
    key = ["source_file", "parent", "parent_pos", "child", "pos"]
    scored = pairs.join(value_overlap(pairs, counts, index), key, "left").fillna(0, ["overlap"])
    scored = scored.withColumn("recall", F.col("overlap") / F.col("parent_distinct")).withColumn(
        "precision", F.col("overlap") / F.col("child_distinct")
    )
    judged = scored.select("*", F.inline_outer(F.array(link_ladder())))
    return judged.filter(F.col("confidence").isNotNull())


def _verdict(confidence: float, reason: str, *signals: str) -> Column:
    return F.struct(
        F.lit(confidence).alias("confidence"), F.lit(reason).alias("review_reason"),
        F.array(*[F.lit(s) for s in signals]).alias("signals"),
    )


def link_ladder() -> Column:
    same, recall, precision, name = F.col("same_name"), F.col("recall"), F.col("precision"), F.col("column")
    return (
        F.when(same & (recall >= STRONG_RECALL), _verdict(
            SAME_STRONG, "same name, values overlap strongly, no foreign key in the source",
            "same_field_name", "value_set_overlap", "parent_unique"))
        .when(same & (recall >= MEDIUM_RECALL), _verdict(
            SAME_MEDIUM, "same name, values overlap in part",
            "same_field_name", "partial_value_overlap"))
        .when(~same & (recall >= OTHER_NAME_RECALL) & (precision >= OTHER_NAME_PRECISION)
              & text.has_word(name, PARTY_WORDS), _verdict(
            OTHER_NAME, "names differ, values overlap strongly",
            "value_set_overlap", "semantic_column_name"))
        .when(same & (recall < MEDIUM_RECALL) & text.has_word(name, V.IDENTIFIER_NAMES), _verdict(
            SAME_UNVERIFIED, "same name, overlap not verified",
            "same_field_name", "value_set_not_verified"))
    )


def best_per_pair(scored: DataFrame) -> DataFrame:
    """Best child column per pair of tables by (confidence, recall), earlier column on ties."""
    row = F.struct("parent_pos", "parent_key", "pos", "column", "confidence", "recall",
                   "precision", "signals", "review_reason")
    best = scored.groupBy("source_file", "parent", "child").agg(F.max_by(
        row, F.struct("confidence", "recall", -F.col("pos"))
    ).alias("b"))
    return best.select("source_file", "parent", "child", "b.*").select(
        "source_file", "parent", "child", "parent_pos", F.col("parent_key").alias("on_from"),
        "pos", F.col("column").alias("on_to"), "confidence",
        F.bround("recall", 4).alias("recall"), F.bround("precision", 4).alias("precision"),
        F.lit(True).alias("needs_review"), "review_reason", "signals",
    )


def _evidence(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("confidence", "recall", "precision")])


def resolve_mutual(links: DataFrame) -> DataFrame:
    """One link per direction, and of two opposite ones the stronger; neither on a tie."""
    rest = [c for c in links.columns if c not in ("source_file", "parent", "child")]
    one = links.groupBy("source_file", "parent", "child").agg(
        F.max_by(F.struct(*rest), F.struct("confidence", "recall", "precision")).alias("l")
    ).select("source_file", "parent", "child", "l.*")
    other = one.select(
        "source_file", F.col("child").alias("parent"), F.col("parent").alias("child"),
        _evidence().alias("other"),
    )
    joined = one.join(other, ["source_file", "parent", "child"], "left")
    return joined.filter(F.col("other").isNull() | (_evidence() > F.col("other"))).select(*links.columns)


def key_columns(plans: DataFrame, profiles: DataFrame) -> DataFrame:
    return plans.select(*TABLE, F.col("key_pos").alias("pos")).join(profiles.select(*COLUMN, "distinct_count"), list(COLUMN))


def positional_keys(plans: DataFrame, index: ValueIndex) -> DataFrame:
    """Tables whose key is the run 1, 2, 3 ... of a spreadsheet row number, from the patterns that hold it."""
    keys = plans.select(*TABLE, F.col("key_pos").alias("pos")).join(index.ids, list(COLUMN)).select(*TABLE, "id")
    places = F.filter(F.sequence(F.lit(0), F.size("masks") * MASK_BITS - 1), lambda k: index.holds(k))
    return (
        index.patterns.select("source_file", "n", "whole", "low", "high", F.explode(places).alias("id"))
        .join(keys, ["source_file", "id"]).groupBy(*TABLE)
        .agg(F.sum("n").alias("n"), F.bool_and("whole").alias("whole"), F.min("low").alias("low"), F.max("high").alias("high"))
        .filter((F.col("n") >= 2) & F.col("whole") & (F.col("low") == 1)
                & (F.col("high") - F.col("low") + 1 == F.col("n")))
        .select(*TABLE)
    )


def label_positional(links: DataFrame, positional: DataFrame) -> DataFrame:
    """Cap and label links that rest on a row-number key."""
    marks = positional.select("source_file", F.col("sheet").alias("parent"), F.lit(True).alias("_pos"))
    hit = F.coalesce("_pos", F.lit(False)) & ((F.col("recall") > 0) | (F.col("precision") > 0))
    new = {
        "confidence": F.when(hit, F.least("confidence", F.lit(V.POSITIONAL_KEY_CONFIDENCE)))
        .otherwise(F.col("confidence")).alias("confidence"),
        "review_reason": F.when(hit, "overlap rests on row numbers 1, 2, 3 only")
        .otherwise(F.col("review_reason")).alias("review_reason"),
        "signals": F.when(hit, F.array_distinct(F.array_append("signals", "low_discrimination_key")))
        .otherwise(F.col("signals")).alias("signals"),
    }
    joined = links.join(marks, ["source_file", "parent"], "left")
    return joined.select(*[new.get(c, F.col(c)) for c in links.columns])


def normalize_links(links: DataFrame, positional: DataFrame) -> DataFrame:
    return label_positional(resolve_mutual(links), positional)


def link_index(pairs: DataFrame, plans: DataFrame, profiles: DataFrame, counts: DataFrame) -> ValueIndex:
    """One index for the overlaps of the pairs and for the row-number keys."""
    return value_index(used_columns(pairs, key_columns(plans, profiles)), counts)


def discover_links(
    plans: DataFrame, columns: DataFrame, profiles: DataFrame, counts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """All inferred links of a corpus, normalised, and the tables whose key is a row number."""
    # Stored, the candidates have a known size: while small, they are broadcast and the value
    # counts are not shuffled by column at all.
    pairs = materialize(candidates(plans, columns, profiles), "candidates")
    index = link_index(pairs, plans, profiles, counts)
    positional = positional_keys(plans, index)
    return normalize_links(best_per_pair(score(pairs, counts, index)), positional), positional


# --- given links -------------------------------------------------------------

def verify_links(
    hints: DataFrame, plans: DataFrame, columns: DataFrame, profiles: DataFrame, counts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Given links checked against the data: ``(links, rejects)``.

    ``hints``: ``(source_file, from_entity, to_entity, on_from, on_to, confidence)`` where an
    entity is named by its key or its sheet.
    """
    hinted = hints.withColumn("hint_id", F.xxhash64(
        "source_file", "from_entity", "to_entity", "on_from", "on_to"))
    names = plans.select("source_file", "sheet", F.explode(F.array_distinct(F.array(
        F.struct(F.lit(0).alias("rank"), F.col("entity").alias("name")),
        F.struct(F.lit(1).alias("rank"), text.strip(F.col("sheet")).alias("name")),
    ))).alias("n")).groupBy("source_file", F.col("n.name").alias("name")).agg(
        F.min_by("sheet", F.struct("n.rank", "sheet")).alias("sheet"))
    cols = columns.groupBy(*TABLE, text.strip(F.col("column")).alias("name")).agg(F.min("pos").alias("pos"))

    def side(df: DataFrame, entity: str, into: str) -> DataFrame:
        return df.withColumn("name", text.strip(F.col(entity))).join(
            names.withColumnRenamed("sheet", into), ["source_file", "name"], "left").drop("name")

    def column(df: DataFrame, sheet: str, name: str, into: str) -> DataFrame:
        right = cols.withColumnsRenamed({"sheet": sheet, "pos": into})
        return df.withColumn("name", text.strip(F.col(name))).join(
            right, ["source_file", sheet, "name"], "left").drop("name")

    placed = side(side(hinted, "from_entity", "parent"), "to_entity", "child")
    placed = column(column(placed, "parent", "on_from", "parent_pos"), "child", "on_to", "pos")
    keys = plans.select("source_file", F.col("sheet").alias("child"), F.col("key_pos").alias("child_key"))
    placed = placed.join(keys, ["source_file", "child"], "left")
    placed = placed.withColumn("cause", (
        F.when(F.col("parent").isNull() | F.col("child").isNull() | (F.col("parent") == F.col("child")),
               "unknown entity")
        .when(F.col("parent_pos").isNull(), "parent column does not exist")
        .when(F.col("pos").isNull(), "child column does not exist")
        .when(F.col("pos") == F.col("child_key"), "child column is its own key")
    ))
    good = placed.filter(F.col("cause").isNull())
    size = profiles.select(*COLUMN, "distinct_count")
    good = good.join(
        size.withColumnsRenamed({"sheet": "parent", "pos": "parent_pos", "distinct_count": "parent_distinct"}),
        ["source_file", "parent", "parent_pos"]
    ).join(size.withColumnsRenamed({"sheet": "child", "distinct_count": "child_distinct"}),
           ["source_file", "child", "pos"])
    good = materialize(good, "given_links")
    key = ["source_file", "parent", "parent_pos", "child", "pos"]
    seen = good.join(value_overlap(good.select(*key, "parent_distinct", "child_distinct").distinct(), counts), key, "left").fillna(0, ["overlap"])
    overlaps = F.col("overlap") > 0
    share = lambda d: F.bround(F.coalesce(F.try_divide("overlap", d), F.lit(0.0)), 4)
    links = seen.select(
        "source_file", "parent", "child", "parent_pos", text.strip(F.col("on_from")).alias("on_from"),
        "pos", text.strip(F.col("on_to")).alias("on_to"),
        F.least("confidence", F.when(overlaps, HINT_OVERLAP).otherwise(HINT_NO_OVERLAP)).alias("confidence"),
        share("parent_distinct").alias("recall"), share("child_distinct").alias("precision"),
        F.lit(True).alias("needs_review"),
        F.when(overlaps, "given link, no foreign key in the source")
        .otherwise("given link, values not verified").alias("review_reason"),
        F.array(F.lit("hint"), F.when(overlaps, "value_set_overlap").otherwise("value_set_not_verified")).alias("signals"),
    )
    rejects = placed.filter(F.col("cause").isNotNull()).select(*hints.columns, "cause")
    return links, rejects


def merge_links(found: DataFrame, given: DataFrame, positional: DataFrame) -> DataFrame:
    """Discovered links win over given ones on the same pair and child column."""
    extra = given.join(found, ["source_file", "parent", "child", "pos"], "left_anti")
    return normalize_links(found.unionByName(extra.select(*found.columns)), positional)


# --- decisions ---------------------------------------------------------------

def link_key() -> Column:
    return F.concat_ws("_to_", "from_entity", "to_entity")


def apply_decisions(links: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Accept, reject or correct links; open, unknown and invalid decisions are listed.

    Only ``accepted`` and ``rejected`` are decisions; anything else, null too, is invalid.

    ``links`` carry ``(source_file, key, on_from, on_to)``; ``decisions`` carry
    ``(source_file, key, decision, on_from, on_to)``.
    """
    key = ["source_file", "key"]
    d = decisions.select(*key, "decision", F.col("on_from").alias("d_from"), F.col("on_to").alias("d_to"))
    joined = links.join(d, key)
    kept = joined.filter(F.col("decision") == "accepted")
    valid = F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False))
    new = {
        "on_from": F.coalesce(F.nullif(F.col("d_from"), F.lit("")), "on_from").alias("on_from"),
        "on_to": F.coalesce(F.nullif(F.col("d_to"), F.lit("")), "on_to").alias("on_to"),
    }
    return {
        "kept": kept.select(*[new.get(c, F.col(c)) for c in links.columns]),
        "rejected": joined.filter(F.col("decision") == "rejected").select(*key),
        "missing": links.join(decisions, key, "left_anti").select(*key),
        "unknown": decisions.join(links, key, "left_anti").select(*key),
        "invalid": joined.filter(~valid).select(*key, "decision"),
    }
