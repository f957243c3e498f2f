"""Predicates and conversions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewise.functions import text
from tablewise.functions import vocab as V

WORDS = V.MISSING_EN + V.MISSING_ZH
# Every marker as it is, in capitals and with blanks; every word with a reason behind a colon or in brackets.
MISSING = [form for w in WORDS + V.MISSING_SYMBOLS for form in (w, w.upper(), f"  {w}\t")] + ["", "\u3000", " \n"]
MISSING += [w + tail for w in WORDS for tail in (": shelf 4", "：第三批", " (row 7)", "（二）", " :")]
MISSING += ["not\t  recorded", "Restricted   Access (staff)"]
# A word in a longer text, a reason without its mark, a symbol with a reason, text behind the bracket.
REAL = [f"{w} plus four" for w in WORDS] + [f"seen {w}" for w in WORDS] + [f"{w}: shelf 4" for w in V.MISSING_SYMBOLS]
REAL += ["unknown (row 7) 12", "nullable", "naval", "无锡", "0", "-5"]


def check(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v")).alias("x")).collect())]


def test_missing(spark):
    assert check(spark, text.is_missing, MISSING + [None]) == [True] * (len(MISSING) + 1)
    assert check(spark, text.is_missing, REAL) == [False] * len(REAL)


@pytest.mark.parametrize("fn, yes, no", [
    (text.is_number, ["12", "-1.5", "1,234,567.8", "１２"], ["12,34", "1e3", "¥5", "", "1."]),
    (text.is_money, ["￥29.90", "99元", "$ 1,000", "5块", "-5€"], ["99", "元", "12,34元", "¥abc"]),
    (text.is_phone, ["13800138000", "+86 138-0013-8000", "010-12345678", "86 13800138000"], ["12800138000", "123", "0101234"]),
    (text.is_date, ["2026-01-03", "2026/1/3", "2026.1.3", "2026年1月3日", "2026-01-03T10:20:30", "2026-01-03T10:20:30.5", "2022", "2022-13", "2022年3月", " 2024-02-29 "],
     ["2026-02-30", "1001", "2026-01-03T25:00:00", "26-1-3", "20260103", "0000-01-01", "2022年", "2026-1/3"]),
    (text.looks_numeric, [" 1,000 ", "5"], ["a1", "1,00"]),
])
def test_formats(spark, fn, yes, no):
    assert check(spark, fn, yes) == [True] * len(yes)
    assert check(spark, fn, no) == [False] * len(no)


def test_numbers(spark):
    cells = ["¥12,800.00", "15,300.50", "abc", "1_000", "1e3", "inf", "nan", "1d", " 5 元", "", "+.5", "99块", "1__0"]
    assert check(spark, text.to_number, cells) == [12800.0, 15300.5, None, 1000.0, 1000.0, None, None, None, 5.0, None, 0.5, 99.0, None]


def test_dates(spark):
    cells = ["2022", "2022-03", "2022年3月", "2022年", "2022-13", "20260103", "2026-01-03 whatever", "2026-1-3", "1001", "2026-02-30", "x"]
    days = [dt.date(2022, 1, 1), dt.date(2022, 3, 1), dt.date(2022, 3, 1), dt.date(2022, 1, 1), None, dt.date(2026, 1, 3),
            dt.date(2026, 1, 3), dt.date(2026, 1, 3), dt.date(1001, 1, 1), None, None]
    assert check(spark, text.to_date, cells) == days


def test_keywords_are_substrings(spark):
    assert check(spark, lambda c: text.has_word(c, ["no"]), ["Note", "NO", "x"]) == [True, True, False]


def test_code_like(spark):
    df = spark.createDataFrame([(["0", "1"],), (["A-1", "B_2"],), (["北京", "上海"],), (["large box", "x"],), ([],)], "v array<string>")
    got = [r[0] for r in df.select(text.is_code_like(F.col("v"))).collect()]
    assert got == [True, True, False, False, True]


def test_number_text(spark):
    df = spark.createDataFrame([(5.0,), (0.5,), (12345678.25,), (0.0001,), (-3.0,), (None,)], "v double")
    assert [r[0] for r in df.select(text.as_text(df, "v")).collect()] == ["5", "0.5", "12345678.25", "0.0001", "-3", None]


def test_confidence(spark):
    df = spark.createDataFrame([(0.98,), (0.96,), (0.9,), (0.8,), (0.6,)], "v double")
    assert [r[0] for r in df.select(text.confidence_band(F.col("v"))).collect()] == [0.98, 0.95, 0.9, 0.75, 0.61]
    assert [r[0] for r in df.select(text.confidence_level(F.col("v"))).collect()] == ["high", "high", "high", "medium", "medium"]


def test_distinct_values_stay_distinct_as_text(spark):
    numbers = {1e-13: "0.0000000000001", -2.5e-13: "-0.00000000000025", 1.2345678912345e-4: "0.00012345678912345",
               12345678.12345679: "12345678.12345679", 1.5e16: "15000000000000000", -12345678.5: "-12345678.5", 0.25: "0.25"}
    rows = spark.createDataFrame([(k,) for k in numbers], "v double")
    assert {r[0]: r[1] for r in rows.select("v", text.as_text(rows, "v")).collect()} == numbers
    for kind in ("timestamp", "timestamp_ntz"):
        times = spark.sql(f"SELECT CAST(v AS {kind}) AS v FROM VALUES ('2024-01-02 03:04:05'), ('2024-01-02 03:04:05.12') AS t(v)")
        assert sorted(r[0] for r in times.select(text.as_text(times, "v")).collect()) == [
            "2024-01-02T03:04:05", "2024-01-02T03:04:05.120000"]


def test_shortcuts_change_nothing(spark):
    """Values the shortcuts pass by are those that the patterns alone refuse, odd signs and blanks included."""
    base = MISSING[:12] + REAL[:12] + ["12", "¥12", "12 元", "2020-1-2", "２０２０年1月2日", "1999", "13812345678", "010-1234567", "$", "元", "é", "😀5"]
    blanks = ["", " ", "\t", "\n", "\x85", " ", "　", "\x1c", "​"]
    cells = [a + v + b for v in base for a in blanks for b in blanks] + [None]
    one, both = F.translate(F.btrim("v", F.lit(text.WHITESPACE)), text.FULL_WIDTH_DIGITS, "0123456789"), F.btrim("v", F.lit(text.WHITESPACE))
    plain = {
        "strip": both, "date_text": one, "is_money": both.rlike(V.MONEY_MARK) & both.rlike(V.MONEY),
        "is_phone": F.regexp_replace("v", r"(?U)[\s\-]", "").rlike(V.PHONE),
        "is_date": one.rlike(V.PERIOD) | F.coalesce(text._full_date(one).isNotNull(), F.lit(False)),
        "bare_number": F.translate(F.regexp_replace("v", rf"(?U)[{V.CURRENCY},\s]|[元块]", ""), text.FULL_WIDTH_DIGITS, "0123456789"),
    }
    df = spark.createDataFrame([(v,) for v in cells], "v string")
    for name, want in plain.items():
        differ = df.filter(~getattr(text, name)(F.col("v")).eqNullSafe(want))
        assert [r["v"] for r in differ.collect()] == [], name
