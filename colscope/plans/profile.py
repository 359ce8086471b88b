"""A whole dataset profile in one Spark application: clean, describe columns, describe pairs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.bivariate import MAX_CATEGORY_VALUES, BinnedColumn, all_pairs, correlations, mosaic
from ..operators.catalog import upsert, upsert_pairs, without_columns
from ..operators.clean import clean, update_columns
from ..operators.infer import detect_new_types
from ..operators.univariate import DEFAULT_BINS, DEFAULT_ENDS, histograms, summarize
from ..session import on_driver
from ..specs import AUTO_DETECT, CATEGORY, ColumnSpec


@dataclass
class Profile:
    """The cleaned rows and its summaries: all but the rows are of metadata size."""

    rows: DataFrame
    specs: list[ColumnSpec]
    summary: DataFrame
    histograms: DataFrame
    correlations: DataFrame | None
    contingency: DataFrame | None


def _binned_columns(specs: list[ColumnSpec], bars: DataFrame) -> dict[str, BinnedColumn]:
    """Columns fit for contingency tables with the labels of their histogram bins."""
    labels: dict[str, list[str]] = {}
    for r in bars.orderBy("column", "bin").select("column", "label").collect():
        labels.setdefault(r["column"], []).append(r["label"])
    usable = {}
    for s in specs:
        bins = tuple(labels.get(s.name, ()))
        if bins and (s.numeric or (s.datatype == CATEGORY and len(bins) < MAX_CATEGORY_VALUES)):
            usable[s.name] = BinnedColumn(s.name, bins, s.numeric)
    return usable


def _describe(rows: DataFrame, specs: list[ColumnSpec], changed: list[str] | None, bins: int,
              ends: tuple[float, float], exact: bool, old_bars: DataFrame | None = None,
              edges: dict[str, list[float]] | None = None):
    """(summary, histograms, correlations, contingency) of the changed columns and the pairs they touch."""
    own = [s for s in specs if changed is None or s.name in changed]
    summary = on_driver(summarize(rows, own, exact))
    bars = on_driver(histograms(rows, own, bins, ends, edges, exact=exact))
    known = bars if old_bars is None else on_driver(upsert(old_bars, bars, ["column"]))
    numeric = [s.name for s in specs if s.numeric]
    number_pairs = all_pairs(numeric, changed)
    links = on_driver(correlations(rows, number_pairs)) if number_pairs else None
    binned = _binned_columns(specs, known)
    cell_pairs = [(binned[a], binned[b]) for a, b in all_pairs(list(binned), changed)]
    cells = on_driver(mosaic(rows, cell_pairs)) if cell_pairs else None
    return summary, bars, links, cells


def profile(df: DataFrame, specs: list[ColumnSpec], bins: int = DEFAULT_BINS,
            ends: tuple[float, float] = DEFAULT_ENDS, exact: bool = False,
            edges: dict[str, list[float]] | None = None) -> Profile:
    """Clean ``df`` and describe its columns and column pairs; the cleaned rows are read from cache.

    ``edges`` gives the histogram of a column its own buckets.
    """
    kept = [replace(s, position=i) for i, s in enumerate(s for s in specs if not s.ignored)]
    rows = clean(df, specs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Profile(rows, kept, *_describe(rows, kept, None, bins, ends, exact, None, edges))
    finally:
        rows.unpersist()


def _detected(rows: DataFrame, specs: list[ColumnSpec]) -> list[ColumnSpec]:
    """``specs`` with the types of new ``AutoDetect`` columns."""
    if not any(s.status == "new" and s.datatype == AUTO_DETECT for s in specs):
        return specs
    found = {r["column"]: r for r in detect_new_types(update_columns(rows, specs), specs).collect()}
    return [replace(s, datatype=found[s.final_name]["datatype"], format=found[s.final_name]["format"],
                    decimal=found[s.final_name]["decimal"]) if s.status == "new" and s.final_name in found else s for s in specs]


def _merge(old: DataFrame | None, new: DataFrame | None, dropped: list[str], pairs: bool) -> DataFrame | None:
    columns = ("c1", "c2") if pairs else ("column",)
    if old is None:
        return new
    kept = without_columns(old, dropped, columns) if dropped else old
    if new is None:
        return on_driver(kept)
    return on_driver(upsert_pairs(kept, new) if pairs else upsert(kept, new, ["column"]))


def reprofile(before: Profile, specs: list[ColumnSpec], bins: int = DEFAULT_BINS,
              ends: tuple[float, float] = DEFAULT_ENDS, exact: bool = False,
              edges: dict[str, list[float]] | None = None) -> Profile:
    """Apply a column update and describe only what it changed; other summaries are carried over.

    A renamed column counts as a dropped and a new one.  New columns of type ``AutoDetect`` are typed by their values
    first, and columns with ``edges`` count as changed.
    """
    specs = _detected(before.rows, specs)
    remaining = [s for s in specs if s.status != "deleted"]
    rows = update_columns(before.rows, specs).persist(StorageLevel.MEMORY_AND_DISK)
    after = [replace(s, name=s.final_name, new_name=None, status="unmodified", position=i) for i, s in enumerate(remaining)]
    changed = [s.final_name for s in remaining if s.status in ("new", "modified") or s.final_name != s.name
               or s.final_name in (edges or {})]
    dropped = [s.name for s in specs if s.status == "deleted" or s.final_name != s.name]
    try:
        bars_kept = without_columns(before.histograms, [*dropped, *changed])
        summary, bars, links, cells = _describe(rows, after, changed, bins, ends, exact, bars_kept, edges)
        old_links = without_columns(before.correlations, changed, ("c1", "c2")) if before.correlations is not None else None
        old_cells = without_columns(before.contingency, changed, ("c1", "c2")) if before.contingency is not None else None
        places = {s.name: s.position for s in after}
        merged = _merge(before.summary, summary, dropped, False)
        position = F.create_map(*[F.lit(v) for item in places.items() for v in item])
        return Profile(rows, after, merged.withColumn("position", position[F.col("column")]),
                       _merge(before.histograms, bars, dropped, False), _merge(old_links, links, dropped, True),
                       _merge(old_cells, cells, dropped, True))
    finally:
        rows.unpersist()
