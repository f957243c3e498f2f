"""Raw grids to aligned tables: header search, merges, totals, notes and blanks.

Grids of many sheets are handled at once. Header facts come from the first 30 rows of
each sheet; data rows are judged by expressions over their own cells and meet the
facts of their sheet in a join keyed by row blocks (see ``numbering``).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.operators.numbering import TABLE, with_table_facts
from tablewise.session import materialize

_INTEGER = r"(?U)^[+-]?\d+(?:\.0+)?$"


# --- per-row expressions -----------------------------------------------------

def clean_cells(cells: Column) -> Column:
    return F.transform(cells, text.null_blank)


def row_width(cells: Column) -> Column:
    """Position of the rightmost filled cell, counted from 1; 0 for an empty row."""
    marks = F.transform(cells, lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(marks), F.lit(0))


def is_filled(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.isNotNull())


# The row tests look at all cells as one text, joined by a mark no cell contains: one pattern
# over it is compiled code, where a test per array element would be interpreted.
MARK = "\x00\x1f\x00"


def row_text(cells: Column) -> Column:
    return F.array_join(cells, MARK)


def is_blank_row(joined: Column) -> Column:
    """No letter, digit or ideograph anywhere in the row."""
    return ~text.has_content(joined)


def is_total_row(joined: Column) -> Column:
    """Some cell, without blanks and colons around it, is a total word."""
    words = text.any_word(V.TOTAL_WORDS)
    return joined.rlike(
        rf"(?iU)(?:^|\x00\x1f\x00)\s*[:：]*\s*{words}\s*[:：]*\s*(?:\x00\x1f\x00|\z)")


def is_note_row(joined: Column) -> Column:
    """Exactly one filled cell, which opens with an emoji or a note word."""
    opens = joined.rlike(V.EMOJI) | joined.rlike("^" + text.any_word(V.NOTE_PREFIXES))
    return opens & ~F.contains(joined, F.lit(MARK))


def align(cells: Column, width: Column) -> Column:
    pad = F.array_repeat(F.lit(None).cast("string"), F.greatest(width - F.size(cells), F.lit(0)))
    return F.when(F.size(cells) == width, cells).otherwise(F.slice(F.concat(cells, pad), F.lit(1), width))


# --- merged cells and formulas -----------------------------------------------

#: Merges are cut into aligned runs of so many rows (as powers of two), the largest first.
MERGE_BITS = (16, 8, 0)


def _aligned_runs(spans: DataFrame, bits: tuple[int, ...] = MERGE_BITS) -> DataFrame:
    """``(.., bits, block)``: every span ``low .. high`` as runs that fill whole blocks.

    What the blocks of one size leave at both ends is cut by the next smaller size, so a span of n rows
    has n / 65,536 large runs and at most 510 of each smaller size.
    """
    kept = [c for c in spans.columns if c not in ("low", "high")]
    runs, left = None, spans
    for b in bits:
        first, behind = F.expr(f"shiftright(low + {(1 << b) - 1}L, {b})"), F.expr(f"shiftright(high + 1L, {b})")
        placed = left.withColumns({"first": first, "behind": behind})
        own = placed.filter("behind > first").select(*kept, F.lit(b).alias("bits"), F.explode(F.sequence("first", F.col("behind") - 1)).alias("block"))
        runs = own if runs is None else runs.unionAll(own)
        ends = F.when(F.col("behind") > F.col("first"), F.array(
            F.struct("low", (F.col("first") * (1 << b) - 1).alias("high")), F.struct((F.col("behind") * (1 << b)).alias("low"), "high"),
        )).otherwise(F.array(F.struct("low", "high")))
        left = placed.select(*kept, F.explode(ends).alias("s")).select(*kept, "s.low", "s.high").filter("low <= high")
    return runs


def fill_merges(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """Copy the anchor of each vertical merge into the empty cells it covers.

    ``merges``: ``(source_file, sheet, min_row, max_row, col)``, all counted from 0.
    Line breaks inside the anchor are dropped, on the anchor itself as well. Where merges overlap,
    the one that starts first fills the cell; rows behind the sheet's last one do not count. Rows meet
    the merges that cover them on aligned blocks of at most 65,536 rows, however long a merge is.
    """
    at = [*TABLE, "row_no"]
    ends = materialize(grid.groupBy(*TABLE).agg(F.max("row_no").alias("end")), "ends")
    anchors = (
        merges.filter(F.col("max_row") > F.col("min_row")).join(ends, list(TABLE))
        .withColumn("max_row", F.least("max_row", "end"))
        .withColumn("row_no", F.col("min_row").cast("bigint")).join(grid, at)
        .withColumn("raw", F.get("cells", F.col("col").cast("int")))
        .withColumn("label", text.strip(F.regexp_replace("raw", r"(?U)\s*[\r\n]+\s*", "")))
        .filter(F.length("label") > 0)
    )
    runs = _aligned_runs(anchors.select(
        *TABLE, F.col("col").cast("int").alias("col"), "label", F.col("row_no").alias("first_row"),
        F.col("row_no").alias("low"), F.col("max_row").cast("bigint").alias("high")))
    each = runs.groupBy(*TABLE, "bits", "block", "col").agg(F.min(F.struct("first_row", "label")).alias("m"))
    # Stored, the fills have a known size: few of them are broadcast, and the grid stays put.
    fills = materialize(each.groupBy(*TABLE, "bits", "block").agg(
        F.collect_list(F.struct("col", "m.first_row", "m.label")).alias("fills")), "fills")
    joined = grid
    for b in (r[0] for r in fills.select("bits").distinct().orderBy("bits").collect()):
        some = fills.filter(F.col("bits") == b).select(*TABLE, F.col("block").alias(f"_block{b}"), F.col("fills").alias(f"_fills{b}"))
        joined = joined.withColumn(f"_block{b}", F.shiftright("row_no", b)).join(some, [*TABLE, f"_block{b}"], "left")
    found = [F.coalesce(F.col(c), F.lit([])) for c in joined.columns if c.startswith("_fills")]
    if not found:
        return grid
    held = joined.select(*TABLE, "row_no", "cells", (F.concat(*found) if len(found) > 1 else found[0]).alias("found"))
    padded = align(F.col("cells"), F.greatest(F.size("cells"), F.array_max(F.transform("found", lambda f: f["col"])) + 1))

    def filled(c, i):
        own = F.array_min(F.transform(F.filter("found", lambda f: f["col"] == i), lambda f: F.struct(f["first_row"], f["label"])))
        return F.when(c.isNull() | (own["first_row"] == F.col("row_no")), F.coalesce(own["label"], c)).otherwise(c)

    return held.select(
        *TABLE, "row_no", F.when(F.size("found") == 0, F.col("cells")).otherwise(F.transform(padded, filled)).alias("cells"))


def missing_formulas(grid: DataFrame, formulas: DataFrame) -> DataFrame:
    """Formula cells that read as empty, per sheet; coordinates outside the grid do not count."""
    at = [*TABLE, "row_no"]
    found = formulas.withColumn("row_no", F.col("row").cast("bigint")).join(grid, at)
    inside = F.col("col") < F.size("cells")
    empty = F.get("cells", F.col("col").cast("int")).isNull()
    return found.groupBy(*TABLE).agg(F.count_if(inside & empty).alias("formula_missing"))


# --- header ------------------------------------------------------------------

def sheet_widths(grid: DataFrame) -> DataFrame:
    """Used width, rows and last row number per sheet, in one partial aggregation."""
    return grid.groupBy(*TABLE).agg(
        F.max(row_width(F.col("cells"))).cast("int").alias("width"),
        F.max("row_no").alias("last_row"), F.count(F.lit(1)).alias("grid_rows"),
    )


def score_headers(grid: DataFrame, widths: DataFrame) -> DataFrame:
    """Score of each of the first ten rows as a header row."""
    near = grid.filter(F.col("row_no") < V.HEADER_SCAN_ROWS + V.FILL_WINDOW_ROWS)
    below = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(1, V.FILL_WINDOW_ROWS)
    share = F.avg(F.when(F.col("filled"), 1.0).otherwise(0.0)).over(below)
    values = F.filter("cells", lambda c: c.isNotNull())
    seen = near.withColumn("filled", is_filled(F.col("cells"))).withColumn(
        "fill_below", F.coalesce(share, F.lit(0.0))
    )
    n = F.size("values")
    numeric = F.size(F.filter("values", text.looks_numeric))
    return (
        seen.filter((F.col("row_no") < V.HEADER_SCAN_ROWS) & F.col("filled"))
        .withColumn("values", values).join(widths.select(*TABLE, "width"), list(TABLE))
        .withColumn("score", 0.4 * (n / F.col("width")) + 0.2 * (F.size(F.array_distinct("values")) / n)
                    + 0.2 * ((n - numeric) / n) + 0.2 * F.col("fill_below"))
        .select(*TABLE, "row_no", "cells", "width", "score", "fill_below")
    )


def detect_headers(grid: DataFrame, widths: DataFrame) -> DataFrame:
    """The header row of each sheet that has one, with score and confidence."""
    scored = score_headers(grid, widths)
    best = scored.groupBy(*TABLE, "width").agg(F.max_by(
        F.struct("row_no", "cells", "score"),
        F.struct(F.col("fill_below") > 0, "score", -F.col("row_no")),
    ).alias("h"))
    return best.select(
        *TABLE, "width", F.col("h.row_no").alias("header_row"), F.col("h.cells").alias("header"),
        F.bround("h.score", 4).alias("score"),
        F.when(F.col("h.score") >= V.HEADER_LOW_SCORE, "high").otherwise("low").alias("confidence"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def compatible_form(names: pd.Series) -> pd.Series:
    """NFKC and trim; only ever run on header rows, as Spark has no such function."""
    fix = lambda v: None if v is None else unicodedata.normalize("NFKC", v).strip()
    return names.map(lambda row: None if row is None else [fix(v) for v in row])


def header_columns(headers: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``(table, pos, column)``; nameless columns become ``column_<n>``.

    ``spans`` are horizontal merges ``(source_file, sheet, row_no, min_col, max_col, label)``
    counted from 0. Two or more of them right above the header prefix their group name.
    """
    named = headers.select(
        *TABLE, "header_row",
        F.posexplode(compatible_form(align(F.col("header"), F.col("width")))).alias("pos", "raw"),
    ).withColumn("unnamed", F.coalesce(F.col("raw") == "", F.lit(True)))
    named = named.withColumn(
        "column", F.when(F.col("unnamed"), F.concat(F.lit("column_"), F.col("pos") + 1))
        .otherwise(F.col("raw"))
    ).drop("raw")
    if spans is None:
        return named
    above = spans.join(headers.select(*TABLE, "header_row"), list(TABLE)).filter(
        F.col("row_no") == F.col("header_row") - 1
    )
    groups = (
        above.groupBy(*TABLE).agg(F.collect_list(F.struct("min_col", "max_col", "label")).alias("s"))
        .filter(F.size("s") >= 2).select(*TABLE, F.explode("s").alias("s"))
        .withColumn("group", F.get(compatible_form(F.array("s.label")), F.lit(0)))
        .filter(F.length("group") > 0)
        .select(*TABLE, "group", F.explode(F.sequence(
            F.col("s.min_col").cast("int"), F.col("s.max_col").cast("int"))).alias("pos"))
    )
    prefixed = F.when(
        F.col("group").isNotNull() & ~F.startswith("column", F.lit("column_")),
        F.concat_ws("_", "group", "column"),
    ).otherwise(F.col("column"))
    return named.join(groups, [*TABLE, "pos"], "left").withColumn("column", prefixed).drop("group")


def duplicate_headers(columns: DataFrame) -> DataFrame:
    """Sorted column names used more than once, per sheet."""
    repeated = columns.groupBy(*TABLE, "column").count().filter(F.col("count") > 1)
    return repeated.groupBy(*TABLE).agg(F.sort_array(F.collect_list("column")).alias("duplicates"))


# --- rows --------------------------------------------------------------------

def judge_rows(grid: DataFrame, headers: DataFrame, widths: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows below the header with the cause each is dropped for (null for records)."""
    first_name = columns.filter(F.col("pos") == 0).select(*TABLE, F.col("column").alias("first_column"))
    facts = headers.select(*TABLE, "width", "header_row").join(
        widths.select(*TABLE, "last_row"), list(TABLE)
    ).join(first_name, list(TABLE)).withColumn(
        "numbered", F.lower(text.strip(F.col("first_column"))).isin(*V.SEQUENCE_HEADERS)
    )
    # Stored, the facts have a known size: while small, they are broadcast and the grid is not
    # shuffled; beyond that the join is by row blocks.
    facts = materialize(facts, "sheet_facts")
    first = F.get("cells", F.lit(0))
    joined = F.col("joined")
    below = with_table_facts(grid, facts).filter(F.col("row_no") > F.col("header_row")).withColumn(
        "joined", row_text(F.col("cells")))
    order = Window.partitionBy(*TABLE).orderBy("row_no")
    counted = with_table_facts(grid, facts.filter("numbered")).filter(
        (F.col("row_no") > F.col("header_row")) & first.isNotNull()
        & ~is_blank_row(row_text(F.col("cells"))) & ~is_total_row(row_text(F.col("cells")))
    )
    opening = (
        counted
        .select(*TABLE, "row_no", text.strip(first).rlike(_INTEGER).alias("integer"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= V.SEQUENCE_MIN_RUN)
        .groupBy(*TABLE).agg(F.count_if("integer").alias("run"))
    )
    sequences = materialize(facts.select(*TABLE, "last_row").join(opening, list(TABLE)).select(
        *TABLE, "last_row", (F.col("run") >= V.SEQUENCE_MIN_RUN).alias("sequence")
    ), "sequences")
    breaks = F.col("sequence") & first.isNotNull() & ~text.strip(first).rlike(_INTEGER)
    judged = with_table_facts(below, sequences, "left").withColumn(
        "sequence", F.coalesce("sequence", F.lit(False))
    )
    return judged.withColumn("cells", align(F.col("cells"), F.col("width"))).withColumn(
        "cause", F.when(is_blank_row(joined), "blank").when(is_total_row(joined), "total")
        .when(F.coalesce(breaks, F.lit(False)) | is_note_row(joined), "note")
    ).select(*TABLE, "row_no", "cells", "cause", "sequence", "first_column")


def records_of(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("cause").isNull()).select(*TABLE, "row_no", "cells")


def clean_report(
    judged: DataFrame, widths: DataFrame, headers: DataFrame, columns: DataFrame,
    formulas: DataFrame | None = None,
) -> DataFrame:
    """One row per sheet: kept and dropped rows by cause, two note samples, warnings."""
    counts = judged.groupBy(*TABLE).agg(
        F.count_if(F.col("cause").isNull()).alias("data_rows"),
        F.count_if(F.col("cause") == "blank").alias("blank_rows"),
        F.count_if(F.col("cause") == "total").alias("total_rows"),
        F.count_if(F.col("cause") == "note").alias("note_rows"),
        F.coalesce(F.bool_or("sequence"), F.lit(False)).alias("sequence"),
    )
    order = Window.partitionBy(*TABLE).orderBy("row_no")
    samples = (
        judged.filter(F.col("cause") == "note")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2)
        .withColumn("sample", F.left(F.get(F.array_compact("cells"), F.lit(0)), F.lit(20)))
        .groupBy(*TABLE).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda s: s["sample"]
        ).alias("note_samples"))
    )
    names = columns.groupBy(*TABLE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "column"))), lambda s: s["column"]).alias("columns"),
        F.count_if("unnamed").alias("unnamed"),
    )
    key = list(TABLE)
    report = (
        widths.join(headers.select(*TABLE, "header_row", "score", "confidence"), key, "left")
        .join(names, key, "left").join(counts, key, "left").join(samples, key, "left")
        .join(duplicate_headers(columns), key, "left")
    )
    report = report.join(formulas, key, "left") if formulas is not None else report.withColumn(
        "formula_missing", F.lit(0).cast("bigint")
    )
    zero = {c: 0 for c in ("data_rows", "blank_rows", "total_rows", "note_rows", "formula_missing", "unnamed")}
    report = report.fillna(zero).withColumn("is_empty", F.col("header_row").isNull()).withColumn(
        "sequence", F.coalesce("sequence", F.lit(False))
    )
    n = lambda c: F.col(c).cast("string")
    filled = ~F.col("is_empty")
    warnings = F.array_compact(F.array(
        F.when(filled & (F.col("formula_missing") > 0),
               F.concat(n("formula_missing"), F.lit(" formula cells without a stored result read as empty"))),
        F.when(F.col("confidence") == "low",
               F.concat(F.lit("header row "), (F.col("header_row") + 1).cast("string"), F.lit(" has low confidence"))),
        F.when(F.col("unnamed") > 0, F.concat(n("unnamed"), F.lit(" unnamed columns"))),
        F.when(F.col("duplicates").isNotNull(),
               F.concat(F.lit("duplicate header values: "), F.array_join("duplicates", ", "))),
        F.when(F.col("total_rows") > 0, F.concat(n("total_rows"), F.lit(" total rows ignored"))),
        F.when(F.col("note_rows") > 0, F.concat(
            n("note_rows"), F.when(F.col("sequence"), F.lit(" rows outside the running number ignored"))
            .otherwise(F.lit(" note rows ignored")))),
        F.when(filled & (F.col("data_rows") == 0), F.lit("header row without data rows")),
    ))
    return report.select(
        *TABLE, "is_empty", (F.col("header_row") + 1).alias("header_row_number"), "score", "confidence",
        "width", "columns", "data_rows", "blank_rows", "total_rows", "note_rows", "note_samples",
        "formula_missing", "sequence", warnings.alias("warnings"),
    )


def too_wide(widths: DataFrame, limit: int = V.MAX_COLUMNS) -> DataFrame:
    """Sheets refused for having too many columns."""
    return widths.filter(F.col("width") > limit).select(
        *TABLE, F.concat(F.col("width").cast("string"), F.lit(" columns")).alias("cause")
    )


def clean_grid(
    grid: DataFrame, merges: DataFrame | None = None, spans: DataFrame | None = None,
    formulas: DataFrame | None = None, column_limit: int | None = None,
) -> dict[str, DataFrame]:
    """Everything about a grid: records, columns and report.

    With ``column_limit`` the sheets above it are listed as refused; they are cleaned all the same.
    """
    grid = fill_merges(grid, merges) if merges is not None else grid
    widths = sheet_widths(grid)
    headers = detect_headers(grid, widths)
    columns = header_columns(headers, spans)
    judged = judge_rows(grid, headers, widths, columns)
    missing = missing_formulas(grid, formulas) if formulas is not None else None
    return {
        "judged": judged,
        "rows": records_of(judged),
        "columns": columns,
        "headers": headers,
        "report": clean_report(judged, widths, headers, columns, missing),
        "refused": too_wide(widths, column_limit) if column_limit else too_wide(widths).limit(0),
    }
