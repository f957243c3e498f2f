"""Text predicates and conversions as native column expressions.

Patterns carry ``(?U)`` so that ``\\d`` and ``\\s`` cover all of Unicode, and blanks are
trimmed as a character set, which stays inside generated code and needs no regex.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import vocab as V

WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)
FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def escape(text: str) -> str:
    """Quote a word for a Java pattern."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#/-])", r"\\\1", text)


def any_word(words) -> str:
    return "(?:" + "|".join(escape(w) for w in words) + ")"


def strip(c: Column) -> Column:
    """Text without blanks around it; where the first and the last sign are printable ASCII there are none."""
    bare = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def null_blank(c: Column) -> Column:
    """Trimmed text, null when nothing is left (the cell rule)."""
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def plain_digits(c: Column) -> Column:
    """ASCII digits for full-width ones; a text of one byte a sign has none of these."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, FULL_WIDTH_DIGITS, "0123456789"))


def is_missing(c: Column) -> Column:
    """Null, blank, or a conventional marker for absent data.

    Most values are neither, and their first character tells; only the others are compared
    with the words. No marker begins with a digit, so numbers and dates need no pattern at all.
    """
    words = V.MISSING_EN + V.MISSING_ZH + V.MISSING_SYMBOLS
    initials = "".join(sorted({escape(w[0]) + escape(w[0].upper()) for w in words}))
    text = collapse(c)
    opener = any_word(sorted(V.MISSING_EN + V.MISSING_ZH, key=len, reverse=True))
    phrase = rf"(?i)^{opener}\s*(?:[:：].*|[(（].*[)）])\s*$"
    marker = F.lower(text).isin(*words, "") | text.rlike(phrase)
    possible = c.rlike(rf"(?U)^[\s\x1c-\x1f]*(?:$|[{initials}])")
    return c.isNull() | F.when(F.left(c, F.lit(1)).between("0", "9"), F.lit(False)).when(possible, marker).otherwise(F.lit(False))


def is_number(c: Column) -> Column:
    return c.rlike(V.NUMBER)


def is_money(c: Column) -> Column:
    """Amounts carry their mark first or last; values without one are not compared with the patterns."""
    text = strip(c)
    marked = F.left(text, F.lit(1)).isin(*V.CURRENCY) | F.right(text, F.lit(1)).isin(*V.CURRENCY, "元", "块")
    return F.when(~marked, F.lit(False)).otherwise(text.rlike(V.MONEY_MARK) & text.rlike(V.MONEY))


def is_phone(c: Column) -> Column:
    """The shortest number has ten digits; shorter values are not compared with the pattern."""
    return F.when(F.length(c) < 10, F.lit(False)).otherwise(F.regexp_replace(c, r"(?U)[\s\-]", "").rlike(V.PHONE))


def date_text(c: Column) -> Column:
    return plain_digits(strip(c))


def _full_date(text: Column) -> Column:
    day = F.regexp_replace(F.regexp_replace(text, r"T.*$|日", ""), "[/.年月]", "-")
    return F.when(text.rlike(V.FULL_DATE), day.try_cast("date"))


def full_date(c: Column) -> Column:
    """Calendar-checked date in one of the accepted spellings, else null."""
    return _full_date(date_text(c))


def is_date(c: Column) -> Column:
    """A year alone, or a year and a separator begin a date; other values are not compared with the patterns."""
    bare = strip(c)
    dated = (F.length(bare) == 4) | F.substring(bare, 5, 1).isin("-", "/", ".", "年")
    text = plain_digits(bare)
    return F.when(~dated, F.lit(False)).otherwise(text.rlike(V.PERIOD) | F.coalesce(_full_date(text).isNotNull(), F.lit(False)))


def parse_date(text: Column) -> Column:
    """Date of a ``date_text``; a bare year or year-month stands for its first day."""
    head = F.when(text.rlike("[T ]"), F.left(text, F.lit(10))).otherwise(text)
    iso = F.when(text.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2}(?:$|[T ])"), F.left(text, F.lit(10)).try_cast("date"))
    packed = F.when(
        head.rlike(r"^(?!0000)\d{8}$"),
        F.regexp_replace(head, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date"),
    )
    month = F.regexp_replace(F.regexp_replace(text, "月|年$", ""), "[/.年]", "-")
    first = F.when(text.rlike(V.ANY_PERIOD), month.try_cast("date"))
    return F.coalesce(iso, _full_date(text), first, packed)


def to_date(c: Column) -> Column:
    """Date of a cell, else null."""
    return parse_date(date_text(c))


def bare_number(c: Column) -> Column:
    """Text of a number without currency signs, commas and blanks; digits and points alone stay as they are."""
    rest = plain_digits(F.regexp_replace(c, rf"(?U)[{V.CURRENCY},\s]|[元块]", ""))
    return F.when(c.rlike(r"^[0-9.+-]+\z"), c).otherwise(rest)


def parse_number(text: Column) -> Column:
    """Number of a ``bare_number``. Infinity and NaN spellings are not numbers here: they go
    to the rejects."""
    return F.when(text.rlike(V.FLOAT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def to_number(c: Column) -> Column:
    """Number of a cell without currency signs, commas and blanks, else null."""
    return parse_number(bare_number(c))


def looks_numeric(c: Column) -> Column:
    return strip(c).rlike(V.NUMBER)


def has_word(name: Column, words) -> Column:
    """Case-insensitive substring test against a keyword list."""
    return F.lower(name).rlike(any_word(w.lower() for w in words))


def confidence_band(ratio: Column) -> Column:
    return (
        F.when(ratio >= 0.98, 0.98).when(ratio >= 0.95, 0.95).when(ratio >= 0.90, 0.90)
        .when(ratio >= 0.80, 0.75).otherwise(0.61)
    )


def confidence_level(c: Column) -> Column:
    return (
        F.when(c >= V.CONFIDENCE_HIGH, "high").when(c >= V.CONFIDENCE_MEDIUM, "medium")
        .otherwise("low")
    )


def needs_review(c: Column) -> Column:
    return c < V.CONFIDENCE_HIGH


def is_wordy(c: Column) -> Column:
    code = r"^[A-Za-z0-9][A-Za-z0-9\-_/]{0,5}$"
    return c.rlike(r"[一-鿿]") | ((F.length(c) >= 2) & ~c.rlike(code))


def is_code_like(values: Column) -> Column:
    """True when fewer than half of the labels are words rather than codes."""
    return F.size(F.filter(values, is_wordy)) * 2 < F.greatest(F.size(values), F.lit(1))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def has_content(c: Column) -> Column:
    return c.rlike(r"[0-9A-Za-z一-鿿]")


def number_text(c: Column) -> Column:
    """Plain decimal spelling of a double, all digits kept: no exponent, no trailing ``.0``."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    plain = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7)
    finite = ~F.isnan(c) & (F.abs(c) < 1e20)
    spelled = c.cast("string")
    part = lambda k: F.regexp_extract(spelled, r"^-?(\d)\.(\d+)E(-?\d+)$", k)
    lead, tail, power = part(1), F.rtrim(part(2), F.lit("0")), part(3).try_cast("int")
    places = F.length(tail)
    zeros = lambda n: F.repeat(F.lit("0"), n)
    expanded = (
        F.when(power < 0, F.concat(F.lit("0."), zeros(-power - 1), lead, tail))
        .when(power >= places, F.concat(lead, tail, zeros(power - places)))
        .otherwise(F.concat(lead, F.substring(tail, F.lit(1), power), F.lit("."), F.substring(tail, power + 1, places)))
    )
    return (
        F.when(whole, c.try_cast("bigint").cast("string"))
        .when(plain | ~finite, spelled)
        .otherwise(F.concat(F.when(c < 0, "-").otherwise(""), expanded))
    )


def as_text(df: DataFrame, name: str) -> Column:
    """A typed column as cell text: dates ISO, booleans TRUE/FALSE, numbers plain."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.upper(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        fraction = F.nullif(F.date_format(c, "SSSSSS"), F.lit("000000"))
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(F.concat(F.lit("."), fraction), F.lit("")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text(c.cast("double"))
    return c.cast("string")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def labels(*pairs) -> Column:
    """Array of the labels whose condition holds; a bare label always holds."""
    items = [F.lit(p) if isinstance(p, str) else F.when(p[1], F.lit(p[0])) for p in pairs]
    return F.array_compact(F.array(*items))
