"""Writing corpora, catalogues, exports and run summaries.

Sinks write folders of part files, so the work stays with the tasks. Ordered
sinks sort by range, and their part files read in name order give the order.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CurationConfig, dialect_of
from ..operators.catalogue import POSITION, as_export_rows, display_keys, in_order

# The layout of a text summary; (line, setting, default).
SUMMARY = """Processing Results:
========================

Input File: {input_file}
Items Processed: {items_processed}
Tools Created: {tools_created}
Processing Time: {processing_time}

Configuration:
- Output File: {output_file}
- Tool Name: {tool_name}
- Description: {description}
- Author: {author}
- Version: {version}
- License: {license}

Processing Options:
- Quality Scoring: {use_quality_scoring}
- Parameterization: {use_parameterization}
- Labeling: {use_labeling}
- Min Quality Score: {min_quality_score}
"""
_NUMBERS = {"items_processed": "0", "tools_created": "0", "min_quality_score": "50"}
_FLAGS = ["use_quality_scoring", "use_parameterization", "use_labeling"]


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one object per record; text outside ASCII stays as it is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_dialects(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Converted templates, one sub-folder per dialect."""
    df.write.mode(mode).partitionBy("dialect").parquet(path)


def rewrite_dialects(df: DataFrame, path: str) -> None:
    """Replace the sub-folders of the dialects that ``df`` has rows of; the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dialect").parquet(path)


def read_dialect(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """The templates of one dialect; only its sub-folder is read."""
    return spark.read.parquet(path).filter(F.col("dialect") == dialect_of(dialect))


def dialect_path(base: str, dialect: str) -> str:
    """The output of one dialect: ``tools.yaml`` becomes ``tools_postgres.yaml``; mysql keeps the name."""
    name = dialect_of(dialect)
    if name == "mysql":
        return base
    stem, dot, ext = base.rpartition(".")
    return f"{stem}_{name}.{ext}" if dot and "/" not in ext else f"{base}_{name}"


# --- exports ---------------------------------------------------------------------


def _json_scalar(c: Column) -> Column:
    """A JSON string, which is a valid YAML scalar too."""
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.substring(quoted, 6, F.length(quoted) - 6)


def yaml_block(fields: list[tuple[str, Column]], params_name: str, params: Column) -> Column:
    """One tool as YAML text, two levels below ``tools:``."""
    lines = [F.concat(F.lit("  "), _json_scalar(F.col("tool_key")), F.lit(":"))]
    lines += [F.concat(F.lit(f"    {n}: "), c) for n, c in fields]

    def item(p: Column) -> Column:
        keys = [(F.lit("    - name: "), "name"), (F.lit("      type: "), "type"), (F.lit("      description: "), "description")]
        return F.array_join(F.array(*[F.concat(k, _json_scalar(p[f])) for k, f in keys]), "\n")

    some = F.concat(F.lit(f"    {params_name}:\n"), F.array_join(F.transform(params, item), "\n"))
    none = F.lit(f"    {params_name}: []")
    lines.append(F.when(F.size(params) > 0, some).otherwise(none))
    return F.array_join(F.array(*lines), "\n")


def catalogue_yaml(catalogue: DataFrame, *position: Column) -> DataFrame:
    """A text column with one YAML block per tool, in catalogue order, and what else is asked for."""
    names = catalogue.columns
    params = "templateParameters" if "templateParameters" in names else "parameters"
    order = ["kind", "source", "statement", "description", "sql"] if params == "templateParameters" else ["description", "sql"]
    fields = [(n, _json_scalar(F.col(n))) for n in order if n in names]
    if params == "parameters":
        fields += [("quality_score", F.col("quality_score").cast("string"))]
        fields += [(n, _json_scalar(F.col(n))) for n in ("labels", "db_id", "source") if n in names]
    block = yaml_block(fields, params, F.col(params))
    return in_order(display_keys(catalogue)).select(block.alias("value"), *position)


def write_catalogue_yaml(catalogue: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """YAML part files: the first holds the ``tools:`` line; all of them, in name order, are one file.

    An empty catalogue gives one part with an empty mapping.
    """
    if catalogue.isEmpty():
        spark = catalogue.sparkSession
        spark.createDataFrame([("tools: {}",)], "value string").coalesce(1).write.mode(mode).text(path)
        return
    # the first tool carries the heading, in whichever part the sort puts it
    place = F.struct(*POSITION, "tool_key")
    start = display_keys(catalogue).agg(F.min(place).alias("p")).first().p
    first = reduce(and_, [F.col(c) == F.lit(v) for c, v in zip((*POSITION, "tool_key"), start, strict=True)])
    head = F.when(F.col("first"), F.concat(F.lit("tools:\n"), F.col("value"))).otherwise(F.col("value"))
    catalogue_yaml(catalogue, first.alias("first")).select(head.alias("value")).write.mode(mode).text(path)


def write_catalogue_json(catalogue: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One tool per line, in catalogue order; numbers that keep the order are left out."""
    rows = in_order(display_keys(catalogue))
    rows.drop("tool_id", "first_run", "first_ord", "last_run").write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_catalogue_csv(viewer: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Eight columns with a header in every part; an empty catalogue still gets the header."""
    rows = as_export_rows(in_order(viewer) if "first_run" in viewer.columns else viewer)
    if viewer.isEmpty():
        rows = rows.coalesce(1)
    rows.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def summary_text(results: DataFrame, settings: dict | None = None) -> DataFrame:
    """The text summary of a one-row result, settings filled in where the row has none."""
    names = re.findall(r"\{(\w+)\}", SUMMARY)
    text: Column = F.lit(SUMMARY)
    for n in names:
        default = _NUMBERS.get(n, "False" if n in _FLAGS else "N/A")
        if n in results.columns:
            value = F.coalesce(F.col(n).cast("string"), F.lit(default))
        else:
            value = F.lit(str((settings or {}).get(n, default)))
        text = F.replace(text, F.lit("{" + n + "}"), value)
    return results.select(text.alias("value"))


def settings_of(cfg: CurationConfig) -> dict:
    return {
        "use_quality_scoring": cfg.use_quality_scoring,
        "use_parameterization": cfg.use_parameterization,
        "use_labeling": cfg.use_labeling,
        "min_quality_score": cfg.min_quality_score,
    }


def write_run_summary(results: DataFrame, path: str, fmt: str = "txt", settings: dict | None = None) -> None:
    """The one-row result of a run joined with its settings, as text or JSON."""
    if fmt == "txt":
        summary_text(results, settings).write.mode("overwrite").text(path)
        return
    extra = [F.lit(v).alias(k) for k, v in (settings or {}).items() if k not in results.columns]
    results.select("*", *extra).write.mode("overwrite").json(path)
