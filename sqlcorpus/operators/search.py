"""Looking into a catalogue: preview columns, text search, top datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much of a column a table view shows.
SHOWN = {"description": 80, "sql": 100, "labels": 50}
CELL = 100


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def counted() -> Column:
    """The parameters as the tool table shows them."""
    n = F.coalesce(F.size("parameters"), F.lit(0))
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" param(s)"))).otherwise(F.lit("No params"))


def preview(viewer: DataFrame) -> DataFrame:
    """The six columns of the tool table, as shown."""

    def shown(name: str) -> Column:
        return shortened(F.coalesce(F.col(name), F.lit("")), SHOWN[name]).alias(name)

    return viewer.select(
        "tool_key",
        shown("description"),
        shown("sql"),
        counted().alias("parameters"),
        F.col("quality_score").cast("string").alias("quality_score"),
        shown("labels"),
    )


def search_catalogue(viewer: DataFrame, text: str) -> DataFrame:
    """Preview rows of the tools in which any of the six columns contains the text, whatever the case.

    Key, description, statement and labels are searched whole, the preview alone is cut;
    parameters and score are searched as they are shown.
    """
    hit = F.lit(False)
    for c in (*map(F.col, ("tool_key", "description", "sql", "labels")), counted(), F.col("quality_score").cast("string")):
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return preview(viewer.filter(hit))


def record_preview(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Raw records as the dataset table shows them: every cell as text of at most 100 characters."""
    columns = columns or [c for c in records.columns if c != "ord"]
    cells = [shortened(F.coalesce(F.col(c).cast("string"), F.lit("")), CELL).alias(c) for c in columns]
    kept = [c for c in ("ord",) if c in records.columns]
    return records.select(*kept, *cells)


def parameter_lines(params: Column) -> Column:
    """Parameters as the detail view lists them."""

    def line(p: Column) -> Column:
        head = F.concat(F.lit("  - "), p["name"], F.lit(" ("), p["type"], F.lit(")"))
        return F.when(p["description"] == "", head).otherwise(F.concat(head, F.lit(": "), p["description"]))

    return F.when(F.size(params) > 0, F.array_join(F.transform(params, line), "\n")).otherwise(F.lit("No parameters"))


def tool_details(viewer: DataFrame) -> DataFrame:
    """The full text of the detail view per tool."""
    text = F.concat(
        F.lit("Description:\n"), F.col("description"),
        F.lit("\n\nSQL Query:\n"), F.col("sql"),
        F.lit("\n\nQuality Score: "), F.col("quality_score").cast("string"),
        F.lit("\nLabels: "), F.col("labels"),
        F.lit("\nDatabase ID: "), F.col("db_id"),
        F.lit("\nSource: "), F.col("source"),
        F.lit("\n\nParameters:\n"), parameter_lines(F.col("parameters")), F.lit("\n"),
    )
    return viewer.select("tool_key", text.alias("details"))


def search_datasets(metadata: DataFrame, text: str = "sql", k: int = 20) -> DataFrame:
    """The k most downloaded datasets whose name contains the text (top-k per task, then merged)."""
    return (
        metadata.filter(F.lower("name").contains(text.lower()))
        .orderBy(F.desc("downloads"), "name")
        .limit(k)
    )
