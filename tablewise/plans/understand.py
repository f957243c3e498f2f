"""From rows of cells to an understood corpus, one job graph for all tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators import catalog, infer, links, profile
from tablewise.operators.clean import clean_grid
from tablewise.operators.numbering import stride_sample
from tablewise.session import materialize


@dataclass(frozen=True)
class Corpus:
    """Everything learned about a set of tables; all attributes are DataFrames."""

    rows: DataFrame
    columns: DataFrame
    counts: DataFrame
    sample: DataFrame | None
    fields: DataFrame
    entities: DataFrame
    plans: DataFrame
    keys: DataFrame
    links: DataFrame
    link_rejects: DataFrame | None = None

    def catalog(self, definitions: DataFrame | None = None) -> dict[str, DataFrame]:
        fields = catalog.build_fields(self.plans, self.fields, self.keys, self.links)
        metrics = None
        if definitions is not None:
            metrics = catalog.metric_definitions(definitions, self.plans, self.keys)
        return {
            "fields": fields,
            "entities": catalog.build_entities(self.plans, fields),
            "links": catalog.build_links(self.links, self.plans, self.keys),
            "metrics": catalog.build_metrics(self.plans, fields, metrics),
            "queries": catalog.default_queries(fields),
            "excluded": catalog.exclusions(self.entities),
        }


def understand(
    rows: DataFrame, columns: DataFrame, *, sample_size: int | None = None,
    field_hints: DataFrame | None = None, entity_hints: DataFrame | None = None,
    link_hints: DataFrame | None = None, positions: DataFrame | None = None, store: bool = True, dense: bool = False,
) -> Corpus:
    """Profile, infer and link ``rows (table, row_no, cells)`` with ``columns (table, pos, column)``.

    The value counts feed profiles, inference and links. With ``store`` they and the
    per-column results are written to the work folder, so the cells are read once. With a
    ``sample_size`` the formats are judged on as many evenly spaced rows of each table instead of
    on all values; ``dense`` then says that row numbers run 0, 1, 2 ... without gaps. ``positions
    (source_file, sheet, position)`` is the order of tables in their workbook; without it their names are.
    """
    keep = materialize if store else (lambda df, name: df)
    counts = keep(profile.value_counts(rows), "value_counts")
    sample = None if sample_size is None else keep(stride_sample(rows, sample_size, dense), "sample")
    fields = infer.infer_fields(columns, counts, sample)
    if field_hints is not None:
        fields = infer.merge_field_hints(fields, field_hints)
    fields = keep(fields, "fields")
    entities = infer.infer_entities(fields)
    if entity_hints is not None:
        fields, entities = infer.apply_entity_hints(fields, entities, entity_hints)
    plans = keep(catalog.build_plans(entities, positions), "plans")
    keys = catalog.field_keys(columns)
    found, positional = links.discover_links(plans, columns, fields, counts)
    rejects = None
    if link_hints is not None:
        given, rejects = links.verify_links(link_hints, plans, columns, fields, counts)
        found = links.merge_links(found, given, positional)
    return Corpus(rows, columns, counts, sample, fields, entities, plans, keys, keep(found, "links"), rejects)


def understand_grid(grid: DataFrame, *, merges=None, spans=None, formulas=None, **options):
    """Clean a grid and understand its tables: ``(corpus, cleaned)``."""
    cleaned = clean_grid(grid, merges, spans, formulas)
    store = options.get("store", True)
    rows = materialize(cleaned["rows"], "rows") if store else cleaned["rows"]
    columns = cleaned["columns"].select("source_file", "sheet", "pos", "column")
    columns = materialize(columns, "columns") if store else columns
    return understand(rows, columns, **options), cleaned
