"""Reports for people: a drawing's figures, a mined library's and a template library's, as Markdown and as a workbook.

What is shown is small: counters, and the most frequent rows of a table.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.sinks.documents import cell, markdown_table, write_workbook

#: Rows of a table that a report shows.
TOP_PATTERNS, TOP_FAMILIES = 30, 20


def _section(title: str, header: list[str], rows: list[list[Any]]) -> str:
    return f"## {title}\n\n{markdown_table(header, rows)}"


def drawing_report(stats: DataFrame, drawing: Any) -> str:
    """The counters of one row of recognise.statistics(), then its equipment types."""
    row = stats.where(F.col("drawing") == F.lit(drawing)).first().asDict()
    counters = [[name.removesuffix("_count").replace("_", " "), n] for name, n in row.items() if name.endswith("_count")]
    types = [entry.rsplit(":", 1) for entry in row["equipment_type_counts"].split(",") if entry]
    notes = "Labels of people took no part in the recognition. Only layers that are visible and plotted are read.\n"
    return "\n".join([f"# {drawing}\n", notes, _section("Counters", ["what", "count"], counters), _section("Equipment", ["type", "count"], types)])


def mining_report(title: str, tables: dict[str, DataFrame], most: int = TOP_PATTERNS) -> str:
    """Of each mined table, how many rows it has and its most frequent ones."""
    parts = [f"# {title}\n"]
    for name, table in tables.items():
        columns = table.columns
        top = table.orderBy(F.col("occurrences").desc(), *(c for c in columns if c != "occurrences")).limit(most).collect()
        parts.append(_section(f"{name}: {table.count()}", columns, [list(r) for r in top]))
    return "\n".join(parts)


def library_summary(library: DataFrame, errors: DataFrame, files: dict[str, int]) -> list[list[Any]]:
    """Lines of what was scanned and what came of it. files: how many of each kind were read."""
    known = F.col("is_equipment_template")
    row = library.agg(
        F.coalesce(F.sum("definition_occurrences"), F.lit(0)).alias("symbol definitions"), F.countDistinct("symbol_id").alias("symbols"), F.count("*").alias("geometry variants"),
        F.coalesce(F.sum(known.cast("long")), F.lit(0)).alias("equipment templates"), F.coalesce(F.sum("usage_count"), F.lit(0)).alias("uses"),
        F.countDistinct(F.when(known, F.col("family"))).alias("families"),
    ).first()
    return [["what", "count"], *([k, v] for k, v in files.items()), *([k, row[k]] for k in row.asDict()), ["files that could not be read", errors.count()]]


#: Columns of the workbook's list of templates.
TEMPLATE_COLUMNS = [
    "template_key", "symbol_id", "family", "name", "state", "terminal_count", "primitive_counts", "xml_semantic_classes", "xml_semantic_names",
    "definition_occurrences", "usage_count", "is_equipment_template", "semantic_status",
]


def template_workbook(path: str | Path, library: DataFrame, errors: DataFrame, files: dict[str, int]) -> None:
    """Four sheets: the summary, all templates, families by size, and files (file, error) that could not be read."""
    from meshwright.plans.templates import family_summary

    rows = [[cell(v) for v in r] for r in library.select(*TEMPLATE_COLUMNS).orderBy("template_key").collect()]
    families = [list(r) for r in family_summary(library).collect()]
    faults = [list(r) for r in errors.select("file", "error").orderBy("file").collect()]
    write_workbook(path, {
        "summary": library_summary(library, errors, files), "templates": [TEMPLATE_COLUMNS, *rows],
        "families": [["family", "variants"], *families], "faults": [["file", "error"], *(faults or [["", "none"]])],
    })


def library_report(library: DataFrame, errors: DataFrame, files: dict[str, int], most: int = TOP_FAMILIES) -> str:
    from meshwright.plans.templates import family_summary

    summary = library_summary(library, errors, files)
    families = [list(r) for r in family_summary(library).limit(most).collect()]
    return "\n".join(["# Template library\n", _section("Summary", summary[0], summary[1:]), _section("Families", ["family", "variants"], families)])
