"""The catalogue: one tool per identity, the last value wins, the first position stays.

A catalogue row carries ``first_run``/``first_ord`` (its position) and ``last_run``, so rows
of any runs merge in one aggregate, in any order and however often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = ["first_run", "first_ord"]
_BOOKKEEPING = [*POSITION, "last_run"]


def last_per_key(tools: DataFrame, key: str = "tool_id") -> DataFrame:
    """The last row (by ``ord``) of every key, with the key's first ``ord`` as ``first_ord``.

    One aggregate, combined on the map side, so a key that holds a third of all rows is a few
    rows in the shuffle. Rows of one key and one ``ord`` are told apart by a hash, so there is
    one row per key whatever the order is worth.
    """
    values = [c for c in tools.columns if c not in (key, "ord")]
    last = F.max_by(F.struct("ord", *values), F.struct("ord", F.xxhash64(*values)))
    ends = tools.groupBy(key).agg(last.alias("last"), F.min("ord").alias("first_ord"))
    return ends.select(key, "last.*", "first_ord")


def new_tools(tools: DataFrame, run: int) -> DataFrame:
    """The tools of a run as catalogue rows, one for each identity (``tool_key`` where there is no ``tool_id``)."""
    new = last_per_key(tools, _key(tools)).drop("ord").withColumn("last_run", F.lit(run)).withColumn("first_run", F.lit(run))
    return new.select(*_columns(new))


def merged(rows: DataFrame) -> DataFrame:
    """Catalogue rows of several runs as one catalogue: the value of the last run, the first position."""
    key = _key(rows)
    values = [c for c in rows.columns if c not in (key, *_BOOKKEEPING)]
    one = rows.groupBy(key).agg(
        F.max_by(F.struct(*values), "last_run").alias("v"), F.min(F.struct(*POSITION)).alias("p"), F.max("last_run").alias("last_run")
    )
    return one.select(key, "v.*", "p.*", "last_run").select(*_columns(rows))


def merge_catalogue(existing: DataFrame | None, tools: DataFrame, run: int) -> DataFrame:
    """Existing catalogue with the tools of a run put in (their columns must agree)."""
    new = new_tools(tools, run)
    return new if existing is None else merged(existing.select(*new.columns).unionByName(new))


def _key(rows: DataFrame) -> str:
    return "tool_id" if "tool_id" in rows.columns else "tool_key"


def _columns(new: DataFrame) -> list[str]:
    return [c for c in new.columns if c not in _BOOKKEEPING] + _BOOKKEEPING


def display_keys(catalogue: DataFrame) -> DataFrame:
    """The catalogue with ``tool_key`` lengthened by part of the identity where several tools share it."""
    if "tool_id" not in catalogue.columns:
        return catalogue
    shared = catalogue.groupBy("tool_key").agg(F.count("*").alias("__same")).filter("__same > 1")
    longer = F.when(F.col("__same").isNotNull(), F.concat("tool_key", F.lit("_"), F.substring("tool_id", 1, 16))).otherwise(F.col("tool_key"))
    return catalogue.join(shared, "tool_key", "left").withColumn("tool_key", longer).drop("__same")


def in_order(catalogue: DataFrame) -> DataFrame:
    """Rows in catalogue order (a range-partitioned sort)."""
    return catalogue.orderBy(*POSITION, "tool_key")


def as_export_rows(viewer: DataFrame) -> DataFrame:
    """The eight columns of a table export; missing values become '' or 0."""

    def text(c: str):
        return F.coalesce(F.col(c), F.lit(""))

    return viewer.select(
        F.col("tool_key").alias("tool_name"),
        text("description").alias("description"),
        text("sql").alias("sql"),
        F.coalesce(F.size("parameters"), F.lit(0)).alias("param_count"),
        F.coalesce(F.col("quality_score"), F.lit(0.0)).alias("quality_score"),
        text("labels").alias("labels"),
        text("db_id").alias("db_id"),
        text("source").alias("source"),
    )
