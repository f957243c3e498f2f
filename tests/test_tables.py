"""Cleaning, profiling, sampling, inference and links on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from tablewise.operators import catalog, clean, infer, links, profile
from tablewise.operators.numbering import block_offsets, number_rows, stride_sample
from tablewise.plans.understand import understand, understand_grid
from tablewise.sources import grid as g

ROWS = "source_file string, sheet string, row_no bigint, cells array<string>"


def rows_of(spark, sheets, start=0):
    data = [("b", s, i + start, list(r)) for s, rows in sheets.items() for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ROWS)


def columns_of(spark, names):
    data = [("b", s, i, c) for s, cols in names.items() for i, c in enumerate(cols)]
    return spark.createDataFrame(data, "source_file string, sheet string, pos int, column string")


def test_running_number_sheet(spark):
    grid = rows_of(spark, {"s": [
        ["2024 price list", None, None], [], ["序号", "版块", "服务"], ["1", "a", "x"], ["2", "b", "y"], [None, "b", "y2"], ["3", "c", "z"],
        ["合计：", None, "99"], ["-", ".", None], ["💡 note", None, None], ["contact", "us", "now"], [None, "备注：free", None]]})
    out = clean.clean_grid(grid)
    assert [r["cells"][2] for r in out["rows"].orderBy("row_no").collect()] == ["x", "y", "y2", "z"]
    report = out["report"].first()
    assert (report["header_row_number"], report["total_rows"], report["blank_rows"], report["note_rows"]) == (3, 1, 1, 3)
    assert report["note_samples"] == ["💡 note", "contact"] and report["sequence"]


def test_plain_sheet_keeps_text_after_codes(spark):
    grid = rows_of(spark, {"s": [["编号", "name"], ["A001", "x"], ["A002", "y"], ["note", "z"]]})
    assert clean.clean_grid(grid)["rows"].count() == 3


def test_header_only_and_empty_sheets(spark):
    grid = rows_of(spark, {"h": [["a", "b"]], "e": [[None], []]})
    found = {r["sheet"]: r for r in clean.clean_grid(grid)["report"].collect()}
    assert not found["h"]["is_empty"] and found["h"]["warnings"][-1] == "header row without data rows"
    assert found["e"]["is_empty"] and found["e"]["warnings"] == []


def test_clean_and_dropped_add_up(spark):
    grid = rows_of(spark, {"s": [["k", "v"]] + [[str(i) if i % 3 else "-", "total" if i % 5 == 0 else "x"] for i in range(200)]})
    judged = clean.clean_grid(grid)["judged"]
    assert judged.count() == 200
    assert judged.filter("cause is null").count() == sum(1 for i in range(200) if i % 5)


def test_vertical_merge_fill(spark):
    grid = rows_of(spark, {"s": [["h", "i"], ["AI\n dev", "1"], [None, "2"], ["own", "3"], [None], [None, "5"]]})
    merges = spark.createDataFrame([("b", "s", 1, 4, 0)], "source_file string, sheet string, min_row int, max_row int, col int")
    filled = {r["row_no"]: r["cells"] for r in clean.fill_merges(grid, merges).collect()}
    assert filled == {0: ["h", "i"], 1: ["AIdev", "1"], 2: ["AIdev", "2"], 3: ["own", "3"], 4: ["AIdev"], 5: [None, "5"]}


def test_read_files(spark):
    body = '编号;名称\r\n1;"a; ""b"""\r\n\r\n2;  \r\n'
    files = spark.createDataFrame(
        [(f"/x/{n}.csv", len(c), bytearray(c)) for n, c in {
            "gb": body.encode("gb18030"), "bom": body.encode("utf-8-sig"), "u16": body.encode("utf-16"), "bad": b"\xff\xff\x80", "none": b"",
        }.items()] + [("/x/z.xlsx", 4, bytearray(b"PK\x03\x04"))], "path string, length bigint, content binary")
    rows = g.read_grid(files).collect()
    for sheet in ("gb", "bom", "u16"):
        got = [r["cells"] for r in sorted(rows, key=lambda r: r["row_no"]) if r["sheet"] == sheet]
        assert got == [["编号", "名称"], ["1", 'a; "b"'], [], ["2", None]]
    causes = {r["source_file"]: r["cause"] for r in g.unreadable_files(files).collect()}
    assert set(causes) == {"/x/bad.csv", "/x/none.csv", "/x/z.xlsx"}


def test_delimiter_ties_go_to_the_earlier():
    assert g.delimiter("a,b\tc\n") == "," and g.delimiter("a;b;c\n1,2\n") == ";" and g.delimiter("abc") == ","
    assert g.delimiter("\n" * 70000 + "a;b\n") == ";"
    assert g.delimiter("\ta,b\t") == "," and g.delimiter("a\t\t\t\nb,c") == ","


def test_overlapping_and_overlong_merges(spark):
    grid = rows_of(spark, {"s": [["a", "x"], [None, "y"], ["b", None], [None, None]]})
    merges = spark.createDataFrame([("b", "s", 0, 2, 0), ("b", "s", 2, 10**12, 0)],
                                   "source_file string, sheet string, min_row bigint, max_row bigint, col int")
    filled = {r["row_no"]: r["cells"][0] for r in clean.fill_merges(grid, merges).collect()}
    assert filled == {0: "a", 1: "a", 2: "b", 3: "b"}


def test_only_two_words_are_decisions(spark):
    found = spark.createDataFrame([("b", k, "f", "t") for k in "abcd"], "source_file string, key string, on_from string, on_to string")
    decisions = spark.createDataFrame([("b", "a", "accepted"), ("b", "b", None), ("b", "c", "maybe"), ("b", "d", "rejected")],
                                      "source_file string, key string, decision string").withColumns(
        {"on_from": F.lit(""), "on_to": F.lit("")})
    done = links.apply_decisions(found, decisions)
    assert {n: sorted(r["key"] for r in df.collect()) for n, df in done.items()} == {
        "kept": ["a"], "rejected": ["d"], "missing": [], "unknown": [], "invalid": ["b", "c"]}


def test_profile_by_hand(spark):
    rows = rows_of(spark, {"s": [["1", "华东"], ["2", "华东"], ["3", "华南"], ["4", None]]})
    counts = profile.value_counts(rows)
    region = profile.column_profiles(counts).filter("pos = 1").first()
    assert (region["null_count"], region["null_ratio"], region["distinct_count"], region["duplicate_cell_count"], region["is_unique"]) == (1, 0.25, 2, 2, False)
    top = profile.top_value_lists(counts).filter("pos = 1").first()["top_values"]
    assert [(t["value"], t["count"]) for t in top] == [("华东", 2), ("华南", 1)]


def test_top_values_ties(spark):
    rows = rows_of(spark, {"s": [[c] for c in "bacdefg"]})
    assert [r["value"] for r in profile.top_values(profile.value_counts(rows)).orderBy("rank").collect()] == list("abcde")


def test_duplicate_rows_are_null_safe(spark):
    rows = rows_of(spark, {"s": [["1", "x"], ["2", None], ["1", "x"], ["1", "x"], ["2", None], ["2", "~"], ["1,1:x", None]]})
    assert profile.duplicate_rows(rows).first()["duplicate_row_count"] == 3


@pytest.mark.parametrize("n, size", [(250, 100), (100, 100), (99, 100), (7, 1), (1, 1), (1000, 7)])
@pytest.mark.parametrize("dense", [True, False])
def test_stride_sample_matches_the_formula(spark, n, size, dense):
    gaps = random.Random(n)
    numbers = list(range(n)) if dense else sorted(gaps.sample(range(300_000), n))
    rows = spark.createDataFrame([("b", "s", k, [str(i)]) for i, k in enumerate(numbers)], ROWS)
    got = sorted(int(r["cells"][0]) for r in stride_sample(rows, size, dense).collect())
    want = list(range(n)) if n <= size else [0] if size == 1 else [round(i * (n - 1) / (size - 1)) for i in range(size)]
    assert got == want


def test_dense_numbers_across_blocks(spark):
    keys = sorted(random.Random(3).sample(range(2**34), 2000)) + [2**34 + i for i in range(5)]
    df = spark.createDataFrame([("b", "s", k) for k in keys] + [("b", "t", 7)], "source_file string, sheet string, k bigint")
    got = {(r["sheet"], r["k"]): r["n"] for r in number_rows(df.withColumn("key", F.col("k")), "key", "n").collect()}
    assert got == {**{("s", k): i for i, k in enumerate(keys)}, ("t", 7): 0}
    assert block_offsets(df, "k").filter("sheet = 's'").agg(F.sum("n")).first()[0] == len(keys)


def _ledger(spark):
    customers = [[f"客户{i}", "华东" if i % 2 else "华南", f"1380013{i:04d}"] for i in range(12)]
    products = [[f"产品{i}", f"¥{i * 3 + 1}.50", f"规格{i}", str(i * 10)] for i in range(8)]
    orders = [[f"SO{i:03d}", f"客户{i % 12}", f"产品{i % 8}", f"{i * 100 + 1}.00", f"2026-0{i % 6 + 1}-10"] for i in range(40)]
    rows = rows_of(spark, {"客户": customers, "商品": products, "订单": orders, "参数": [["a", "1"], ["b", "2"]]})
    columns = columns_of(spark, {
        "客户": ["客户名称", "区域", "联系电话"], "商品": ["商品名称", "单价", "规格", "库存"],
        "订单": ["订单编号", "客户名称", "商品名称", "金额", "下单日期"], "参数": ["param", "value"]})
    return rows, columns


def test_ledger_end_to_end(spark):
    corpus = understand(*_ledger(spark))
    kinds = {r["sheet"]: (r["kind"], r["key_field"]) for r in corpus.entities.collect()}
    assert kinds["客户"] == ("customer", "客户名称") and kinds["订单"] == ("order", "订单编号")
    assert kinds["商品"][0] == "product" and kinds["参数"][0] == "unknown"
    found = {(r["parent"], r["child"], r["on_to"]): r["confidence"] for r in corpus.links.collect()}
    assert found == {("客户", "订单", "客户名称"): 0.88, ("商品", "订单", "商品名称"): 0.88}
    cat = corpus.catalog()
    assert {r["key"] for r in cat["metrics"].collect()} == {"customer_count", "product_count", "order_count", "total_amount"}
    assert {r["sheet"]: r["reason"] for r in cat["excluded"].collect()} == {"参数": "unknown kind"}
    query = cat["queries"].filter("entity = 'order'").first()
    assert query["columns"][0] == "order_no" and query["sort_field"] == "order_date" and query["search"] == ["order_no"]


def test_grid_to_corpus(spark):
    grid = rows_of(spark, {"订单": [["销售台账"], [], ["订单编号", "金额", "下单日期"]] + [[f"A{i}", f"{i}.5", "2026-01-02"] for i in range(30)] + [["合计", "9", None]]})
    corpus, cleaned = understand_grid(grid)
    assert cleaned["rows"].count() == 30
    types = {r["column"]: (r["type"], r["role"]) for r in corpus.fields.collect()}
    assert types == {"订单编号": ("string", "identifier"), "金额": ("money", "measure"), "下单日期": ("date", "time")}


def _links(spark, parent, child, key="code", column="code"):
    rows = rows_of(spark, {"p": [[v, "x"] for v in parent], "c": [[str(i + 500), v] for i, v in enumerate(child)]})
    columns = columns_of(spark, {"p": [key, "other"], "c": ["cid", column]})
    counts = profile.value_counts(rows)
    plans = spark.createDataFrame([("b", "p", "p", 0, key), ("b", "c", "c", 0, "cid")],
                                  "source_file string, sheet string, entity string, key_pos int, key_field string")
    return links.discover_links(plans, columns, profile.column_profiles(counts), counts)[0].collect()


def test_row_number_keys_are_labelled(spark):
    found = _links(spark, ["1", "2", "3"], ["1", "2", "3", "3"])
    assert (found[0]["confidence"], found[0]["signals"][-1]) == (0.5, "low_discrimination_key")
    assert _links(spark, ["1001", "1002", "1003"], ["1001", "1002", "1003", "1003"])[0]["confidence"] == 0.88


@pytest.mark.parametrize("parent, child, column, confidence", [
    (["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "d"], "code", 0.88),
    (["a", "b", "c", "d"], ["a", "b", "b"], "code", 0.75),
    (["a", "b", "c", "d"], ["a", "z", "z"], "code", 0.63),
    (["a", "b", "c", "d"], ["a", "b", "c", "d", "d", "x"], "customer", 0.75),
    (["a", "b", "c", "d"], ["a", "b", "c", "d", "d", "x"], "thing", None),
    (["a", "b", "c", "d"], ["a", "b", "c", "d"], "code", None),
])
def test_link_ladder(spark, parent, child, column, confidence):
    found = _links(spark, parent, child, column=column)
    assert [r["confidence"] for r in found] == ([] if confidence is None else [confidence])


def test_candidates_lose_nothing_against_brute_force(spark):
    rng = random.Random(5)
    names = ["k", "customer", "item", "zz"]
    data = {f"t{i}": [[f"{i}-{r}", *[str(rng.randrange(rng.choice([3, 8, 20]))) for _ in names]] for r in range(rng.randrange(5, 40))] for i in range(8)}
    for i, t in enumerate(data.values()):
        for r, row in enumerate(t):
            row[0] = str(r) if i % 2 else row[0]
    columns = {t: ["k", *names[1:], "z"][:5] for t in data}
    counts = profile.value_counts(rows_of(spark, data))
    plans = spark.createDataFrame([("b", t, t, 0, columns[t][0]) for t in data], "source_file string, sheet string, entity string, key_pos int, key_field string")
    prof = profile.column_profiles(counts)
    got = {(r["parent"], r["child"], r["pos"], r["confidence"]) for r in links.score(links.candidates(plans, columns_of(spark, columns), prof), counts).collect()}
    want = set()
    for p in data:
        keys = {r[0] for r in data[p]}
        for c in data:
            for pos in range(1, 5):
                vals, name = [r[pos] for r in data[c]], columns[c][pos]
                if p == c or len(set(vals)) == len(vals):
                    continue
                recall, precision = len(keys & set(vals)) / len(keys), len(keys & set(vals)) / len(set(vals))
                if name != "k" and recall >= 0.9 and precision >= 0.5 and name in ("customer", "item"):
                    want.add((p, c, pos, 0.75))
    assert got == want


def test_field_hints(spark):
    rows, columns = _ledger(spark)
    counts = profile.value_counts(rows)
    fields = infer.infer_fields(columns, counts, stride_sample(rows, dense=True))
    hints = spark.createDataFrame(
        [("b", "客户", " 区域 ", "enum", "enum", 0.9, False, "two areas", ["华东", "华南"]), ("b", "客户", "联系电话", "enum", "enum", 0.9, False, None, []),
         ("b", "客户", "客户名称", "madeup", "measure", 0.7, False, "", None)],
        "source_file string, sheet string, column string, type string, role string, confidence double, needs_review boolean, reason string, enum_values array<string>")
    merged = {r["column"]: r for r in infer.merge_field_hints(fields, hints).filter("sheet = '客户'").collect()}
    assert (merged["区域"]["type"], merged["区域"]["enum_values"]) == ("enum", ["华东", "华南"])
    assert (merged["联系电话"]["type"], merged["联系电话"]["role"]) == ("string", "dimension")
    assert (merged["客户名称"]["type"], merged["客户名称"]["role"], merged["客户名称"]["needs_review"]) == ("string", "measure", True)


def test_formats_are_judged_on_all_values(spark):
    rows = [("b", "s", i, [f"word {i}" if i % 10 or i == 0 else str(i)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "source_file string, sheet string, row_no bigint, cells array<string>")
    got = infer.value_ratios(profile.value_counts(df)).collect()[0]
    assert (got["sample_values"], got["r_number"], got["r_date"]) == (1000, 0.099, 0.0)
    assert got["avg_chars"] == sum(len(r[3][0]) for r in rows) / 1000
    empty = spark.createDataFrame([("b", "s", 0, [None]), ("b", "s", 1, ["N/A"])], df.schema)
    got = infer.value_ratios(profile.value_counts(empty)).collect()[0]
    assert (got["sample_values"], got["r_number"], got["max_chars"], got["raw_avg_chars"]) == (0, None, 0, 3.0)


def test_value_index_over_many_columns(spark):
    """More columns than one mask holds: overlaps equal sets, and the values are shuffled once by (workbook, value)."""
    import random

    draw = random.Random(5)
    held = {(b, "s", pos): set(map(str, draw.sample(range(60), draw.randint(1, 50)))) for b in "ab" for pos in range(70)}
    rows = [(b, s, p, v, 1) for (b, s, p), vs in held.items() for v in vs] + [("a", "s", 0, None, 3)]
    counts = spark.createDataFrame(rows, "source_file string, sheet string, pos int, value string, n bigint")
    pairs = spark.createDataFrame(
        [(b, "s", p, "s", c, len(held[b, "s", p]), len(held[b, "s", c])) for b in "ab" for p, c in draw.sample([(i, j) for i in range(70) for j in range(70)], 80)],
        "source_file string, parent string, parent_pos int, child string, pos int, parent_distinct bigint, child_distinct bigint").distinct()
    index = links.value_index(links.used_columns(pairs), counts)
    assert max(r[0] for r in index.patterns.select(F.size("masks")).collect()) == 2
    got = {tuple(r)[:5]: r["overlap"] for r in links.value_overlap(pairs, counts, index).collect()}
    want = {(b, "s", p, "s", c): len(held[b, "s", p] & held[b, "s", c]) for b, _, p, _, c, _, _ in pairs.collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_names_of_many_equal_columns(spark):
    """100,000 equal names are ranked; a name spelled like a numbered one is not taken twice."""
    many = spark.range(100_000).select(F.lit("a").alias("scope"), F.col("id").alias("at"), F.lit("name").alias("b"))
    odd = spark.createDataFrame([("b", i, n) for i, n in enumerate(["x", "x_2", "x", "x", "y", "x_2", "x_2_2", "y_7", "x_3", "y"])]
                                + [("c", 0, "x_2"), ("c", 1, "z")], "scope string, at bigint, b string")
    named = catalog.unique_names(many.union(odd), ["scope"], "at", "b", "n")
    got = {s: [r["n"] for r in named.filter(F.col("scope") == s).orderBy("at").collect()] for s in "abc"}
    assert got["a"] == ["name", *[f"name_{k}" for k in range(2, 100_001)]]
    assert got["b"] == ["x", "x_2", "x_3", "x_4", "y", "x_2_2", "x_2_2_2", "y_7", "x_3_2", "y_2"] and got["c"] == ["x_2", "z"]


def test_tables_are_named_in_the_order_of_their_workbook(spark):
    rows = [("f", s, "order", s, "no", 0, 0.9, False, ["x"]) for s in ("alpha", "beta", "gamma")]
    entities = spark.createDataFrame(rows, "source_file string, sheet string, kind string, name string, key_field string, key_pos int, confidence double, needs_review boolean, signals array<string>")
    places = spark.createDataFrame([("f", "gamma", 0), ("f", "alpha", 5)], "source_file string, sheet string, position int")
    named = {r["sheet"]: r["entity"] for r in catalog.build_plans(entities, places).collect()}
    assert named == {"gamma": "order", "alpha": "order_2", "beta": "order_3"}
    assert {r["sheet"]: r["entity"] for r in catalog.build_plans(entities).collect()} == {"alpha": "order", "beta": "order_2", "gamma": "order_3"}


def test_value_sets_by_facts(spark):
    """The distinct counts choose the columns; the values are those the ranks give."""
    values = {0: ["a", "b", None, "n/a", "-"], 1: [f"v{i}" for i in range(30)], 2: ["n/a", None], 3: [f"w{i}" for i in range(20)],
              4: [f"missing: {i}" for i in range(40)] + ["x"]}
    rows = [(t, "s", pos, v, 2) for t in ("b", None) for pos, vs in values.items() for v in vs]
    counts = spark.createDataFrame(rows, "source_file string, sheet string, pos int, value string, n bigint")
    got = profile.value_sets(counts, facts=profile.effective_counts(counts))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, profile.value_sets(counts).collect()), key=str)
    assert {(r["pos"], len(r["values"])) for r in got.collect()} == {(0, 2), (3, 20), (4, 1)}
