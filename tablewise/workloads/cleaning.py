"""Reading files and cleaning grids. The grids are messy sheets made of the orders table."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.operators import clean
from tablewise.operators.numbering import TABLE, number_rows
from tablewise.session import materialize, work_folder
from tablewise.sources import grid as g
from tablewise.sources import splits
from tablewise.sources.parquet import spread
from tablewise.workloads import fixtures as fx
from tablewise.workloads.registry import query

# One order gives one data row and, by its key, rows of other kinds. A third of all orders
# share one sheet. {v} is the way to spell a modulo-tested array entry in each dialect.
_FILE = "concat('book_', cast(o_orderkey % 2 as {s}))"
_SHEET = "case when o_orderkey % 3 = 0 then 'numbered hot' when o_orderkey % 3 = 1 then concat('numbered ', cast(o_orderkey % 5 as {s})) else concat('plain ', cast(o_orderkey % 7 as {s})) end"
_NOTE = "case o_orderkey % 4 when 0 then concat('late', chr(10), 'by ', cast(o_orderkey % 9 as {s})) when 1 then 'ok' end"
_CUST = "concat('Customer ', cast(o_custkey as {s}))"
_AMT = "cast(cast(o_totalprice as decimal(18,2)) as {s})"
_KINDS = (
    ("true", ("cast(o_orderkey + 1 as {s})", _CUST, _AMT, _NOTE, "o_orderstatus", "cast(o_custkey as {s})")),
    ("o_orderkey % 50 = 7", ("'-'", "null", "'.'", "'/'")),
    ("o_orderkey % 60 = 11", ("null", "case when o_orderkey % 2 = 0 then '合计：' else ' Grand Total :' end", _AMT)),
    ("o_orderkey % 70 = 13", ("concat('💡 hint number ', cast(o_orderkey as {s}), ' goes on')",)),
    ("o_orderkey % 80 = 17", ("null", "'备注: see below'")),
    ("o_orderkey % 90 = 19", ("'contact'", "'desk 7'", "'mornings'")),
    ("o_orderkey % 100 = 23", ()),
)


def _kinds(spark: bool) -> str:
    entries = []
    for j, (cond, cells) in enumerate(_KINDS):
        body = ", ".join(c.format(s="string" if spark else "varchar") for c in cells)
        if spark:
            entries.append(f"case when {cond} then named_struct('j', {j}, 'cells', cast(array({body}) as array<string>)) end")
        else:
            entries.append(f"CASE WHEN {cond} THEN {{'j': {j}, 'cells': CAST([{body}] AS VARCHAR[])}} END")
    return ", ".join(entries)


_NUMBERED = ("Ｎｏ．", "客户名称", " amount", "remark", "amount", "link")
_PLAIN = ("record", "客户名称", " amount", None, "ｓtate", "link")
_HEADS = {"plain": [("2024 orders",), ("by", None, "money", None, None), _PLAIN], "numbered": [_NUMBERED]}


def messy_grid(spark: SparkSession, sf: str) -> DataFrame:
    typed = lambda e: F.expr(e.format(s="string"))
    long = spread(fx.read(spark, sf, "orders"), "o_orderkey").select(
        typed(_FILE).alias("source_file"), typed(_SHEET).alias("sheet"), "o_orderkey",
        F.explode(F.expr(f"array_compact(array({_kinds(True)}))")).alias("r"),
    ).select("source_file", "sheet", (F.col("o_orderkey") * 8 + F.col("r.j")).alias("order"), "r.cells")
    body = number_rows(long, "order").drop("order")
    plain = F.startswith("sheet", F.lit("plain"))
    body = body.withColumn("row_no", F.col("row_no") + F.when(plain, 3).otherwise(1))
    heads = [(k, i, list(r)) for k, rows in _HEADS.items() for i, r in enumerate(rows)]
    kinds = spark.createDataFrame(heads, "kind string, row_no bigint, cells array<string>")
    sheets = long.select(*TABLE).distinct().withColumn("kind", F.split("sheet", " ")[0])
    top = sheets.join(kinds, "kind").select(*TABLE, "row_no", "cells")
    rows = body.select(*TABLE, "row_no", "cells").unionByName(top)
    return rows.withColumn("cells", clean.clean_cells(F.col("cells")))


def _sql_list(row) -> str:
    return "[" + ", ".join("NULL" if c is None else f"'{c.strip()}'" for c in row) + "]"


_TOP = " UNION ALL ".join(
    f"SELECT DISTINCT file, sheet, {i}, CAST({_sql_list(r)} AS VARCHAR[]) FROM long WHERE sheet LIKE '{k}%'"
    for k, rows in _HEADS.items() for i, r in enumerate(rows))
GRID = f"""long AS (SELECT {_FILE.format(s='varchar')} AS file, {_SHEET.format(s='varchar')} AS sheet, o_orderkey, unnest([{_kinds(False)}]) AS r FROM orders),
grid(file, sheet, row_no, cells) AS (SELECT file, sheet, row_number() OVER (PARTITION BY file, sheet ORDER BY o_orderkey, r.j) - 1
    + CASE WHEN sheet LIKE 'plain%' THEN 3 ELSE 1 END, list_transform(r.cells, lambda c: nullif(trim(c), '')) FROM long WHERE r IS NOT NULL
  UNION ALL {_TOP})"""

_FULL = "len(list_filter(cells, lambda c: c IS NOT NULL))"
_VALS = "list_filter(cells, lambda c: c IS NOT NULL)"
HEADER = f"""{GRID}, w AS (SELECT file, sheet, max(coalesce(list_max(list_transform(cells, lambda c, i: CASE WHEN c IS NOT NULL THEN i ELSE 0 END)), 0)) AS width,
    count(*) AS grid_rows FROM grid GROUP BY ALL),
near AS (SELECT *, coalesce(avg(CASE WHEN {_FULL} > 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY file, sheet ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), 0) AS fill FROM grid WHERE row_no < 30),
scores AS (SELECT file, sheet, row_no, cells, fill, width, 0.4 * ({_FULL} / width) + 0.2 * (len(list_distinct({_VALS})) / {_FULL})
  + 0.2 * (len(list_filter({_VALS}, lambda c: NOT {fx.sql_number('c')})) / {_FULL}) + 0.2 * fill AS score
  FROM near JOIN w USING (file, sheet) WHERE row_no < 10 AND {_FULL} > 0),
header AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY file, sheet ORDER BY fill > 0 DESC, score DESC, row_no) = 1)"""

_CONTENT = "len(list_filter(cells, lambda c: regexp_matches(c, '[0-9A-Za-z\\x{4e00}-\\x{9fff}]'))) > 0"
_TOTAL = "len(list_filter(cells, lambda c: lower(trim(trim(trim(c), ':：'))) IN ('合计','共计','总计','小计','累计','total','sum','grand total'))) > 0"
_INT = "regexp_matches(cells[1], '^[+-]?[0-9]+(\\.0+)?$')"
_LONE = (f"({_FULL} = 1 AND regexp_matches({_VALS}[1], '^([\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{2B00}}-\\x{{2BFF}}]"
         "|注：|注:|备注：|备注:|说明：|说明:|特别说明|温馨提示|小贴士|注意|※)'))")
JUDGED = f"""{HEADER}, body AS (SELECT g.*, h.width, h.row_no AS header_row, h.cells[1] = 'Ｎｏ．' AS numbered,
    CASE WHEN NOT {_CONTENT.replace('cells', 'g.cells')} THEN 'blank' WHEN {_TOTAL.replace('cells', 'g.cells')} THEN 'total' END AS cause0
  FROM grid g JOIN header h ON g.file = h.file AND g.sheet = h.sheet AND g.row_no > h.row_no),
seq AS (SELECT file, sheet, bool_and({_INT}) AND count(*) = 3 AS sequence FROM (SELECT * FROM body WHERE cause0 IS NULL AND numbered AND cells[1] IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file, sheet ORDER BY row_no) <= 3) GROUP BY ALL),
judged AS (SELECT body.*, coalesce(sequence, false) AS sequence, coalesce(cause0, CASE WHEN (coalesce(sequence, false) AND cells[1] IS NOT NULL AND NOT {_INT})
  OR {_LONE} THEN 'note' END) AS cause FROM body LEFT JOIN seq USING (file, sheet))"""


def _out(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("source_file", "file")


@query("header_scores", f"WITH {HEADER} SELECT file, sheet, row_no, round(score, 9) AS score FROM scores")
def header_scores(spark, sf):
    grid = messy_grid(spark, sf)
    scored = clean.score_headers(grid, clean.sheet_widths(grid))
    return _out(scored.select(*TABLE, "row_no", F.round("score", 9).alias("score")))


@query("header_row", f"""WITH {HEADER} SELECT file, sheet, width, row_no AS header_row, round_even(score, 4) AS score,
  CASE WHEN score >= 0.7 THEN 'high' ELSE 'low' END AS confidence FROM header""")
def header_row(spark, sf):
    grid = messy_grid(spark, sf)
    return _out(clean.detect_headers(grid, clean.sheet_widths(grid)).drop("header"))


@query("sheet_widths", f"WITH {HEADER} SELECT file, sheet, width, grid_rows FROM w")
def sheet_widths(spark, sf):
    return _out(clean.sheet_widths(messy_grid(spark, sf)).drop("last_row"))


_NAMES = ("CASE WHEN sheet LIKE 'plain%' THEN ['record', '客户名称', 'amount', 'column_4', 'state', 'link'] "
          "ELSE ['No.', '客户名称', 'amount', 'remark', 'amount', 'link'] END")


@query("header_columns", f"""WITH {HEADER} SELECT file, sheet, i - 1 AS pos, ({_NAMES})[i] AS "column",
  i = 4 AND sheet LIKE 'plain%' AS unnamed FROM header, range(1, 7) t(i)""")
def header_columns(spark, sf):
    grid = messy_grid(spark, sf)
    return _out(clean.header_columns(clean.detect_headers(grid, clean.sheet_widths(grid))).drop("header_row"))


def group_spans(grid: DataFrame) -> DataFrame:
    """Two horizontal merges above each plain sheet's header, one above no other."""
    sheets = grid.select(*TABLE).distinct()
    plain = F.startswith("sheet", F.lit("plain"))
    span = lambda a, b, label: F.struct(F.lit(a).alias("min_col"), F.lit(b).alias("max_col"), F.lit(label).alias("label"))
    spans = F.when(plain, F.array(span(0, 1, "by"), span(2, 4, " ｍoney"))).otherwise(F.array(span(0, 4, "all")))
    return sheets.select(*TABLE, F.lit(1).cast("bigint").alias("row_no"), F.inline(spans))


@query("group_headers", f"""WITH {HEADER} SELECT file, sheet, i - 1 AS pos, CASE WHEN sheet LIKE 'plain%' THEN
  ['by_record', 'by_客户名称', 'money_amount', 'column_4', 'money_state', 'link'][i] ELSE ({_NAMES})[i] END AS "column" FROM header, range(1, 7) t(i)""")
def group_headers(spark, sf):
    grid = messy_grid(spark, sf)
    headers = clean.detect_headers(grid, clean.sheet_widths(grid))
    return _out(clean.header_columns(headers, group_spans(grid)).select(*TABLE, "pos", "column"))


@query("duplicate_headers", f"WITH {HEADER} SELECT file, sheet, 'amount' AS duplicates FROM header WHERE sheet LIKE 'numbered%'")
def duplicate_headers(spark, sf):
    grid = messy_grid(spark, sf)
    columns = clean.header_columns(clean.detect_headers(grid, clean.sheet_widths(grid)))
    found = clean.duplicate_headers(columns)
    return _out(found.select(*TABLE, F.array_join("duplicates", ", ").alias("duplicates")))


_JOIN = "array_to_string(list_transform(range(1, width + 1), lambda i: coalesce(cells[i], '~')), '|')"


@query("clean_rows", f"WITH {JUDGED} SELECT file, sheet, row_no, {_JOIN} AS cells FROM judged WHERE cause IS NULL")
def clean_rows(spark, sf):
    rows = clean.clean_grid(materialize(messy_grid(spark, sf), "grid"))["rows"]
    return _out(rows.select(*TABLE, "row_no", F.array_join("cells", "|", "~").alias("cells")))


@query("dropped_rows", f"WITH {JUDGED} SELECT file, sheet, row_no, cause FROM judged WHERE cause IS NOT NULL")
def dropped_rows(spark, sf):
    judged = clean.clean_grid(materialize(messy_grid(spark, sf), "grid"))["judged"]
    return _out(judged.filter(F.col("cause").isNotNull()).select(*TABLE, "row_no", "cause"))


@query("clean_report", f"""WITH {JUDGED} SELECT file, sheet, any_value(header_row) + 1 AS header_row_number,
  count(*) FILTER (cause IS NULL) AS data_rows, count(*) FILTER (cause = 'blank') AS blank_rows, count(*) FILTER (cause = 'total') AS total_rows,
  count(*) FILTER (cause = 'note') AS note_rows, bool_or(sequence) AS sequence,
  coalesce(array_to_string(list(left({_VALS}[1], 20) ORDER BY row_no) FILTER (cause = 'note')[1:2], '|'), '') AS note_samples FROM judged GROUP BY file, sheet""")
def clean_report(spark, sf):
    report = clean.clean_grid(materialize(messy_grid(spark, sf), "grid"))["report"]
    samples = F.coalesce(F.array_join("note_samples", "|"), F.lit("")).alias("note_samples")
    return _out(report.select(*TABLE, "header_row_number", "data_rows", "blank_rows", "total_rows", "note_rows", "sequence", samples))


@query("empty_sheets", f"""WITH {HEADER}, hollow AS (SELECT file, sheet, row_no, CASE WHEN sheet = 'plain 3' THEN [] ELSE cells END AS cells FROM grid)
SELECT file, sheet, bool_and({_FULL} = 0) AS is_empty FROM hollow GROUP BY file, sheet""")
def empty_sheets(spark, sf):
    grid = messy_grid(spark, sf)
    hollow = F.when(F.col("sheet") == "plain 3", F.array().cast("array<string>")).otherwise(F.col("cells"))
    report = clean.clean_grid(materialize(grid.withColumn("cells", hollow), "grid"))["report"]
    return _out(report.select(*TABLE, "is_empty"))


def vertical_merges(grid: DataFrame) -> DataFrame:
    """Every fortieth row opens a merge over four rows of the notes column."""
    return grid.filter(F.col("row_no") % 40 == 5).select(
        *TABLE, F.col("row_no").alias("min_row"), (F.col("row_no") + 3).alias("max_row"), F.lit(3).alias("col"))


@query("merge_fill", f"""WITH {GRID}, anchors AS (SELECT file, sheet, row_no AS a, trim(regexp_replace(cells[4], '\\s*[\\r\\n]+\\s*', '', 'g')) AS label
  FROM grid WHERE row_no % 40 = 5 AND cells[4] IS NOT NULL),
covered AS (SELECT file, sheet, unnest([a, a + 1, a + 2, a + 3]) AS row_no, a, label FROM anchors)
SELECT g.file, g.sheet, g.row_no, CASE WHEN g.row_no = a THEN label ELSE coalesce(cells[4], label) END AS note FROM grid g
LEFT JOIN covered n ON g.file = n.file AND g.sheet = n.sheet AND g.row_no = n.row_no""")
def merge_fill(spark, sf):
    grid = materialize(messy_grid(spark, sf), "grid")
    filled = clean.fill_merges(grid, vertical_merges(grid))
    return _out(filled.select(*TABLE, "row_no", F.get("cells", F.lit(3)).alias("note")))


@query("missing_formulas", f"""WITH {GRID} SELECT file, sheet, count(*) FILTER (len(cells) > 3 AND cells[4] IS NULL) AS formula_missing
FROM grid WHERE row_no % 7 = 0 GROUP BY file, sheet""")
def missing_formulas(spark, sf):
    grid = materialize(messy_grid(spark, sf), "grid")
    coords = grid.filter(F.col("row_no") % 7 == 0).select(*TABLE, F.col("row_no").alias("row"), F.lit(3).alias("col"))
    outside = coords.withColumn("row", F.col("row") + 10**9)
    return _out(clean.missing_formulas(grid, coords.unionByName(outside)))


@query("too_wide", """SELECT concat('wide ', o_orderkey // 500) AS sheet, concat(150 + max(o_custkey % 100), ' columns') AS cause
FROM orders GROUP BY 1 HAVING max(o_custkey % 100) > 50""")
def too_wide(spark, sf):
    wide = fx.read(spark, sf, "orders").select(
        F.lit("book").alias("source_file"), F.expr("concat('wide ', o_orderkey div 500)").alias("sheet"),
        F.col("o_orderkey").alias("row_no"),
        F.array_repeat(F.lit("x"), (F.col("o_custkey") % 100 + 150).cast("int")).alias("cells"))
    return clean.too_wide(clean.sheet_widths(wide)).select("sheet", "cause")


# --- files -------------------------------------------------------------------

_CODECS = ("utf-8", "utf-8-sig", "utf-16", "gb18030")
FILE_ROWS = 200


def _encode(batches):
    for batch in batches:
        out = [("\n".join(lines)).encode(_CODECS[n % 4]) for n, lines in zip(batch["n"], batch["lines"])]
        out = [b"\xff\xff\x80" if n % 16 == 7 else c for n, c in zip(batch["n"], out)]
        yield pd.DataFrame({"path": [f"/in/orders_{n}.csv" for n in batch["n"]], "length": [len(c) for c in out], "content": out})


def order_files(spark, sf):
    """Two hundred orders per file, in four encodings and three delimiters; some files broken."""
    n = F.expr("o_orderkey div 200")
    quoted = F.concat(F.lit('"'), F.concat(F.lit("客户 "), F.col("o_custkey"), F.lit(', "'), F.lit('"the one"'), F.lit('"')), F.lit('"'))
    joined = F.expr(f"concat_ws(sep, cast(o_orderkey as string), quoted, {fx.NOTE_TEXT}, '  ', o_orderstatus)")
    line = F.when(F.col("o_orderkey") % 50 == 3, F.lit("")).otherwise(joined)
    named = fx.read(spark, sf, "orders").withColumns({"quoted": quoted, "sep": F.expr(
        "case o_orderkey div 200 % 3 when 0 then ',' when 1 then chr(9) else ';' end")})
    lines = named.select(n.alias("n"), "o_orderkey", line.alias("line")).groupBy("n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda s: s["line"]).alias("lines"))
    return lines.mapInPandas(_encode, "path string, length bigint, content binary")



@query("read_files", f"""WITH l AS (SELECT o_orderkey // 200 AS n, o_orderkey % 200 AS row_no, o_orderkey % 50 = 3 AS hollow, *, {fx.NOTE_TEXT} AS note FROM orders)
SELECT concat('orders_', n) AS sheet, row_no, CASE WHEN hollow THEN '' ELSE concat_ws('|', o_orderkey, concat('客户 ', o_custkey, ', "the one"'), note, '~', o_orderstatus) END AS cells
FROM l WHERE n % 16 <> 7""")
def read_files(spark, sf):
    rows = g.read_grid(order_files(spark, sf))
    return rows.select("sheet", "row_no", F.array_join("cells", "|", "~").alias("cells"))


@query("unreadable_files", "SELECT DISTINCT concat('/in/orders_', o_orderkey // 200, '.csv') AS source_file, 'neither UTF-8 nor GB18030' AS cause FROM orders WHERE (o_orderkey // 200) % 16 = 7")
def unreadable_files(spark, sf):
    return g.unreadable_files(order_files(spark, sf))


@query("new_files", """SELECT concat('/in/orders_', n, '.csv') AS path FROM (SELECT DISTINCT o_orderkey // 200 AS n FROM orders)
WHERE n % 2 = 1 AND n % 16 <> 7""")
def new_files(spark, sf):
    # Every even file was profiled before under the same version; a broken one under an old version.
    files = materialize(order_files(spark, sf), "files")
    number = F.regexp_extract("path", r"(\d+)\.csv", 1).cast("bigint")
    seen = files.filter((number % 2 == 0) | (number % 16 == 7)).select(g.file_hash(F.col("content"), "v1").alias("content_hash"))
    stale = files.select(g.file_hash(F.col("content"), "v0").alias("content_hash"))
    return g.new_files(files, seen.unionByName(stale), "v1").select("path")


# --- files of any size ---------------------------------------------------------

def large_files(spark, sf) -> str:
    """Four files of all orders: two in UTF-8 with semicolons, two in UTF-16 with commas.

    A cell holds quotes, delimiters and line breaks; some rows are blank and some have more cells.
    """
    cell = F.expr("""concat('"客户 ', o_custkey, '; ""one"",', chr(10), case when o_orderkey % 11 = 0 then chr(13) || chr(10) else '' end,
        o_orderpriority, '"')""")
    named = fx.read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 4).alias("part"), cell.alias("cell"), "o_orderstatus", F.expr(f"{fx.NOTE_TEXT}").alias("note"))
    sep = F.when(F.col("part") < 2, ";").otherwise(",")
    parts = F.concat(F.col("o_orderkey").cast("string"), sep, "cell", sep, F.coalesce("note", F.lit(" ")), sep, "o_orderstatus",
                     F.when(F.col("o_orderkey") % 7 == 0, F.concat(sep, F.lit("more"), sep, sep, F.lit("cells"))).otherwise(""))
    lines = named.select("part", "o_orderkey", F.when(F.col("o_orderkey") % 50 == 3, "").otherwise(parts).alias("value"))
    folder = f"{work_folder(spark)}/large-{uuid.uuid4().hex}"
    for name, some in (("utf8", F.col("part") < 2), ("utf16", F.col("part") >= 2)):
        own = lines.filter(some)
        if name == "utf16":
            firsts = own.groupBy("part").agg(F.min("o_orderkey").alias("first"))
            mark = F.when(F.col("o_orderkey") == F.col("first"), F.lit("\ufeff")).otherwise("")
            own = own.join(F.broadcast(firsts), "part").select(  # two rows
                "part", "o_orderkey", F.encode(F.concat(mark, "value"), "UTF-16LE").cast("string").alias("value"))
        own = own.repartition("part").sortWithinPartitions("part", "o_orderkey")
        own.select("part", "value").write.partitionBy("part").option("encoding", "UTF-16LE" if name == "utf16" else "UTF-8").option(
            "lineSep", "\n").text(f"{folder}/{name}")
    return folder


@query("read_split_files", f"""WITH l AS (SELECT *, o_orderkey % 4 AS part, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS row_no,
  {fx.NOTE_TEXT} AS note FROM orders)
SELECT part, row_no, CASE WHEN o_orderkey % 50 = 3 THEN '' ELSE concat_ws('|', o_orderkey, concat('客户 ', o_custkey, '; "one",', chr(10),
  CASE WHEN o_orderkey % 11 = 0 THEN chr(13) || chr(10) ELSE '' END, o_orderpriority), coalesce(note, '~'), o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN 'more|~|cells' END) END AS cells FROM l""")
def read_split_files(spark, sf):
    folder = large_files(spark, sf)
    largest = splits.list_splittable(spark, folder, "*.txt").agg(F.max("length")).first()[0] or 0
    rows = splits.read_split_grid(spark, folder, "*.txt", max(1024, min(splits.SPLIT_BYTES, largest // 20)))
    part = F.regexp_extract("source_file", r"part=(\d+)", 1).cast("bigint")
    return rows.select(part.alias("part"), "row_no", F.array_join("cells", "|", "~").alias("cells"))
