"""List queries, facets, related rows, metrics, recent rows, trends and distributions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import text
from tablewise.functions import vocab as V
from tablewise.session import materialize

# A page starting beyond this row is located by range partitions instead of a top-k.
DEEP_PAGE_ROWS = 100_000


@dataclass(frozen=True)
class Field:
    key: str
    type: str
    role: str = "dimension"
    name: str = ""
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entity:
    """A typed table as the catalog describes it."""

    key: str
    key_field: str
    fields: tuple[Field, ...]

    def field(self, key: str) -> Field | None:
        return next((f for f in self.fields if f.key == key), None)

    def time_field(self) -> Field | None:
        by_role = next((f for f in self.fields if f.role == "time"), None)
        return by_role or next((f for f in self.fields if f.type == "date"), None)


@dataclass(frozen=True)
class ListQuery:
    search: str = ""
    search_keys: tuple[str, ...] = ()
    filters: dict[str, list[str]] = field(default_factory=dict)
    sorts: tuple[tuple[str, str], ...] = ()
    page: int = 1
    page_size: int = V.PAGE_SIZE


@dataclass(frozen=True)
class ListResult:
    rows: DataFrame
    total: int
    page: int
    page_count: int
    page_size: int


def search_tokens(query: str) -> list[str]:
    return query.lower().split()


def search_rows(df: DataFrame, query: str, keys) -> DataFrame:
    """Every token must occur, ignoring case, in at least one of the columns."""
    texts = [F.lower(text.as_text(df, k)) for k in keys]
    wanted = [text.any_of(F.contains(t, F.lit(tok)) for t in texts) for tok in search_tokens(query)]
    return df.filter(F.coalesce(text.all_of(wanted), F.lit(False))) if wanted else df


def facet_value(df: DataFrame, key: str) -> Column:
    return F.coalesce(F.nullif(text.as_text(df, key), F.lit("")), F.lit(V.EMPTY_FILTER))


def _filter_condition(df: DataFrame, key: str, chosen: list[str]) -> Column:
    """Membership by text; text columns compare bare so the test reaches the scan."""
    if not isinstance(df.schema[key].dataType, T.StringType):
        return facet_value(df, key).isin(*chosen)
    c, plain = F.col(key), [v for v in chosen if v != V.EMPTY_FILTER]
    parts = [c.isin(*plain)] if plain else []
    if V.EMPTY_FILTER in chosen:
        parts.append(c.isNull() | (c == "") | (c == V.EMPTY_FILTER))
    return text.any_of(parts)


def filter_rows(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """AND over columns, IN within a column; ``__empty__`` picks null and blank cells."""
    chosen = [_filter_condition(df, k, list(v)) for k, v in filters.items() if v]
    return df.filter(text.all_of(chosen)) if chosen else df


def sort_columns(df: DataFrame, sorts, key: str | None = None, locale: str | None = "zh"):
    """Typed sort keys: numbers and dates by value, text by locale, blanks always last."""
    keys = []
    for name, direction in sorts:
        c = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
            c = F.collate(c, locale) if locale else c
        keys.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
    if key is not None and key not in [s[0] for s in sorts]:
        keys.append(F.col(key).asc_nulls_last())
    return keys


def page_rows(df: DataFrame, order, offset: int, size: int, deep: int = DEEP_PAGE_ROWS) -> DataFrame:
    """Rows ``offset .. offset+size`` of the ordering.

    Near the front this is a top-k. A deep page would drag all earlier rows to one
    task, so there the sorted range partitions are written once, counted, and only
    the partitions that overlap the page are ranked.
    """
    if not order:
        return df.offset(offset).limit(size)
    if offset + size <= deep:
        return df.orderBy(*order).offset(offset).limit(size)
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "ranges")
    counts = sorted((r["_part"], r["count"]) for r in stored.groupBy("_part").count().collect())
    before, picks = 0, []
    for part, n in counts:
        if before + n > offset and before < offset + size:
            picks.append((part, before))
        before += n
    if not picks:
        return df.limit(0)
    start = F.create_map(*[F.lit(x) for pair in picks for x in pair])
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + start[F.col("_part")]
    return (
        stored.filter(F.col("_part").isin(*[p for p, _ in picks]))
        .withColumn("_rank", rank)
        .filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + size))
        .orderBy("_rank").drop("_part", "_rank")
    )


def clamp_page(page: int, pages: int) -> int:
    return min(max(1, page), pages) if pages > 0 else 1


def run_list_query(
    df: DataFrame, query: ListQuery, key: str, columns=None, locale: str | None = "zh"
) -> ListResult:
    """Search, filter, sort and page; the page is clamped to what the total allows."""
    hits = filter_rows(search_rows(df, query.search, query.search_keys), query.filters)
    total = hits.count()
    size = query.page_size if query.page_size > 0 else V.PAGE_SIZE
    pages = max(1, -(-total // size))
    page = clamp_page(query.page, pages)
    order = sort_columns(hits, query.sorts, key, locale)
    rows = page_rows(hits, order, (page - 1) * size, size)
    return ListResult(rows.select(*columns) if columns else rows, total, page, pages, size)


def facet_counts(df: DataFrame, key: str, locale: str | None = "zh") -> DataFrame:
    """Count per distinct value over all rows, blanks merged, in column order, blanks last."""
    c = F.col(key)
    if isinstance(df.schema[key].dataType, T.StringType):
        c = F.nullif(c, F.lit(""))
    counted = df.groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("count"))
    shown = text.as_text(counted, "_v")
    ordered = counted.orderBy(*sort_columns(counted, [("_v", "asc")], None, locale))
    return ordered.select(
        F.coalesce(shown, F.lit(V.EMPTY_FILTER)).alias("value"),
        F.coalesce(shown, F.lit(V.EMPTY_LABEL)).alias("label"),
        "count",
    )


def lookup(df: DataFrame, key_field: str, key: str) -> DataFrame:
    """First row whose key, as text, equals the given text."""
    kind = df.schema[key_field].dataType
    if isinstance(kind, (T.IntegerType, T.LongType)) and key.lstrip("-").isdigit() and str(int(key)) == key:
        return df.filter(F.col(key_field) == F.lit(int(key))).limit(1)
    return df.filter(text.as_text(df, key_field) == key).limit(1)


def relation_sides(entity: str, link: dict) -> tuple[str, str, str] | None:
    """(own field, other field, other entity) of a link seen from either of its sides."""
    if link["from"] == entity:
        return link["on_from"], link["on_to"], link["to"]
    if link["to"] == entity:
        return link["on_to"], link["on_from"], link["from"]
    return None


def _match_key(df: DataFrame, name: str, other: DataFrame, other_name: str) -> Column:
    """Typed key when both sides share the type, else its text; blank never matches."""
    same = df.schema[name].dataType == other.schema[other_name].dataType
    c = F.col(name) if same else text.as_text(df, name)
    blank_free = isinstance(df.schema[name].dataType, T.StringType) or not same
    return F.nullif(c, F.lit("")) if blank_free else c


def related_rows(
    parent: DataFrame, child: DataFrame, on_from: str, on_to: str, parent_columns=None
) -> DataFrame:
    """Every child row with the columns of its parent (equality as text).

    A parent's column that the child has as well comes as ``parent_<name>``.
    """
    keep = list(parent_columns or parent.columns)
    named = [F.col(c).alias(f"parent_{c}" if c in child.columns else c) for c in keep]
    left = parent.select(_match_key(parent, on_from, child, on_to).alias("_k"), *named)
    right = child.withColumn("_k", _match_key(child, on_to, parent, on_from))
    return right.filter(F.col("_k").isNotNull()).join(
        left.filter(F.col("_k").isNotNull()), "_k"
    ).drop("_k")


def related_of(
    parent_row: DataFrame, child: DataFrame, on_from: str, on_to: str, sorts=(), key=None,
    limit: int | None = None, locale: str | None = "zh",
) -> DataFrame:
    """Child rows of one parent row, sorted, optionally only the first ones."""
    one = parent_row.select(_match_key(parent_row, on_from, child, on_to).alias("_k")).limit(1)
    rows = child.withColumn("_k", _match_key(child, on_to, parent_row, on_from))
    found = rows.filter(F.col("_k").isNotNull()).join(one, "_k", "left_semi").drop("_k")
    order = sort_columns(found, sorts, key, locale)
    found = found.orderBy(*order) if order else found
    return found.limit(limit) if limit and limit > 0 else found


def related_top(
    parent: DataFrame, child: DataFrame, on_from: str, on_to: str, sorts, key: str,
    n: int = V.RELATED_ROWS, locale: str | None = "zh",
) -> DataFrame:
    """First ``n`` children of every parent with the total per parent.

    The rank filter is cut per task before its shuffle and the totals are summed per
    task, so a parent owning a third of all rows never lands whole in one task.
    """
    keyed = child.withColumn("_k", _match_key(child, on_to, parent, on_from)).filter(
        F.col("_k").isNotNull()
    )
    owners = parent.select(_match_key(parent, on_from, child, on_to).alias("_k")).filter(
        F.col("_k").isNotNull()
    )
    order = sort_columns(keyed, sorts, key, locale)
    top = keyed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("_k").orderBy(*order))
    ).filter(F.col("rank") <= n)
    totals = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("total"))
    return top.join(totals, "_k").join(owners, "_k", "left_semi").drop("_k")


@dataclass(frozen=True)
class Metric:
    key: str
    op: str
    field: str | None = None


def metric_column(df: DataFrame, metric: Metric) -> Column:
    """Aggregate of one metric: rows for count, finite numbers otherwise, 0 when none."""
    if metric.op == "count":
        return F.count(F.lit(1)).cast("double").alias(metric.key)
    kind = df.schema[metric.field].dataType
    if not isinstance(kind, T.NumericType):
        return F.max(F.lit(0.0)).alias(metric.key)
    c = F.col(metric.field).cast("double")
    finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    fold = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[metric.op]
    return F.coalesce(fold(finite), F.lit(0.0)).alias(metric.key)


def metric_values(df: DataFrame, metrics) -> DataFrame:
    """All metrics of a table in one aggregation, one row per metric."""
    wide = df.agg(*[metric_column(df, m) for m in metrics])
    return wide.unpivot([], [m.key for m in metrics], "metric", "value")


def _filled(df: DataFrame, key: str) -> Column:
    return ~text.is_blank(text.as_text(df, key))


def _date_counts(entities, tables) -> list[dict]:
    """Row count, dated rows and first date per table; one small row each."""
    found = []
    for pos, entity in enumerate(entities):
        df, when = tables[entity.key], entity.time_field()
        dated = F.count_if(_filled(df, when.key)) if when else F.lit(0)
        order = "row_no" if "row_no" in df.columns else entity.key_field
        first = (
            F.min_by(text.as_text(df, when.key), F.when(_filled(df, when.key), F.col(order)))
            if when else F.lit(None).cast("string")
        )
        found.append(df.agg(
            F.lit(pos).alias("pos"), F.count(F.lit(1)).alias("rows"),
            dated.alias("dated"), first.alias("first"),
        ))
    return [r.asDict() for r in reduce(DataFrame.unionAll, found).collect()] if found else []


def recent_rows(entities, tables, limit: int = V.RECENT_ROWS) -> tuple[Entity, DataFrame] | None:
    """Newest rows of the table with most dated rows (else simply most rows)."""
    facts = [r for r in _date_counts(entities, tables) if r["rows"] > 0]
    if not facts:
        return None
    dated = [r for r in facts if r["dated"] > 0]
    pool = sorted(dated or facts, key=lambda r: r["pos"])
    if dated:
        pool.sort(key=lambda r: r["first"] or "", reverse=True)
        pool.sort(key=lambda r: r["dated"], reverse=True)
    else:
        pool.sort(key=lambda r: r["rows"], reverse=True)
    entity = entities[pool[0]["pos"]]
    df, when = tables[entity.key], entity.time_field()
    if when is None:
        return entity, df.limit(limit)
    newest = df.filter(F.col(when.key).isNotNull())
    return entity, newest.orderBy(F.col(when.key).desc(), F.col(entity.key_field)).limit(limit)


def month_trend(
    df: DataFrame, date_field: str, measure: str | None, months: int = V.TREND_MONTHS,
    null_measure: str = "one",
) -> DataFrame:
    """Sum of the measure (or row count) per month, the last months in order.

    With ``null_measure="one"`` a row whose measure is absent adds 1, with ``"skip"``
    it adds nothing.
    """
    if isinstance(df.schema[date_field].dataType, T.StringType):
        label = F.left(F.col(date_field), F.lit(7))
    else:
        label = F.date_format(date_field, "yyyy-MM")
    value = F.lit(1.0)
    if measure is not None:
        c = F.col(measure).cast("double")
        finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        value = F.coalesce(finite, F.lit(1.0 if null_measure == "one" else 0.0))
    last = (
        df.select(label.alias("label"), value.alias("value"))
        .filter(F.col("label").rlike(r"^\d{4}-\d{2}$"))
        .groupBy("label").agg(F.sum("value").alias("value"))
        .orderBy(F.col("label").desc()).limit(months)
    )
    return last.orderBy("label")


def trend(entities, tables, **options) -> tuple[Entity, DataFrame] | None:
    """Month trend of the table with most dated rows."""
    facts = [r for r in _date_counts(entities, tables) if r["dated"] > 0]
    if not facts:
        return None
    best = max(facts, key=lambda r: (r["dated"], -r["pos"]))
    entity = entities[best["pos"]]
    measure = next((f.key for f in entity.fields if f.type == "money" and f.role == "measure"), None)
    return entity, month_trend(tables[entity.key], entity.time_field().key, measure, **options)


def distribution(entities, tables, items: int = V.DISTRIBUTION_ITEMS) -> DataFrame:
    """Top labels of the enum column with most filled rows (at least two labels)."""
    counted, order = [], 0
    for entity in entities:
        df = tables[entity.key]
        names = [f.key for f in entity.fields if f.type == "enum"]
        if not names:
            continue
        texts = df.select(*[text.as_text(df, n).alias(n) for n in names])
        ranks = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, order + i)])
        order += len(names)
        counted.append(
            texts.unpivot([], names, "field", "label")
            .filter(~text.is_blank(F.col("label")))
            .groupBy("field", "label").agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit(entity.key).alias("entity"), ranks[F.col("field")].alias("pos"),
                    "field", "label", "count")
        )
    if not counted:
        raise ValueError("no enum column in any table")
    counts = reduce(DataFrame.unionAll, counted)
    best = (
        counts.groupBy("pos").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("labels"))
        .filter(F.col("labels") >= 2)
        .agg(F.max_by(F.struct("pos", "total"), F.struct("total", -F.col("pos"))).alias("b"))
        .select("b.pos", "b.total")
    )
    rank = F.row_number().over(
        Window.partitionBy("pos").orderBy(F.col("count").desc(), F.col("label"))
    )
    return (
        counts.join(best, "pos").withColumn("rank", rank).filter(F.col("rank") <= items)
        .select("entity", "field", "label", "count", "total", "rank")
    )
