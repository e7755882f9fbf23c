"""Raw records to the four-field form: question, sql, db_id, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Accepted field names, in order of precedence.
QUESTION_FIELDS = ["question", "prompt", "nl", "instruction"]
SQL_FIELDS = ["sql", "query", "gold_sql", "gold", "pred_sql"]
DB_FIELDS = ["db_id", "db", "schema"]
SOURCE_FIELDS = ["source", "origin"]
KNOWN_FIELDS = QUESTION_FIELDS + SQL_FIELDS + DB_FIELDS + SOURCE_FIELDS

# Field names of well-known datasets, and the source they are given.
PROFILES = {
    "spider": {"question": ["question"], "sql": ["query"], "db_id": ["db_id"]},
    "gretelai/synthetic_text_to_sql": {"question": ["sql_prompt"], "sql": ["sql"], "db_id": ["domain"]},
}
IMPORT_SOURCE = "huggingface"
# Fields tried for the question where none was detected.
IMPORT_QUESTION_FIELDS = ["question", "query", "nl", "instruction", "text"]


def first_of(df: DataFrame, names: list[str], default: str = "") -> Column:
    """The first of the fields that is neither null nor empty; absent columns are skipped."""
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(default))


def normalize(df: DataFrame, *keep: str) -> DataFrame:
    """Pick question, statement, database and source by field precedence."""
    kept = [c for c in ("ord", "bad_type", *keep) if c in df.columns]
    return df.select(
        *kept,
        strip(first_of(df, QUESTION_FIELDS)).alias("question"),
        strip(first_of(df, SQL_FIELDS)).alias("sql"),
        first_of(df, DB_FIELDS).alias("db_id"),
        first_of(df, SOURCE_FIELDS, "unknown").alias("source"),
    )


def profile_for(dataset: str, clean: bool = False) -> dict[str, list[str]] | None:
    """Field profile of a dataset name: exact, else the first that contains it or is contained.

    Clean mode compares whole ``/``-separated segments instead of substrings.
    """
    if not dataset or dataset == "auto":
        return None
    if dataset in PROFILES:
        return PROFILES[dataset]
    for name, profile in PROFILES.items():
        if clean:
            if set(name.split("/")) & set(dataset.split("/")):
                return profile
        elif name in dataset or dataset in name:
            return profile
    return None


def _imported(df: DataFrame, question: Column, sql: Column, db_id: Column) -> DataFrame:
    kept = [c for c in ("ord",) if c in df.columns]
    out = df.select(*kept, question.alias("question"), sql.alias("sql"), db_id.alias("db_id"))
    out = out.filter((F.col("question") != "") & (F.col("sql") != ""))
    return out.select(
        *kept,
        strip(F.col("question")).alias("question"),
        strip(F.col("sql")).alias("sql"),
        "db_id",
        F.lit(IMPORT_SOURCE).alias("source"),
    )


def normalize_with_profile(df: DataFrame, profile: dict[str, list[str]]) -> DataFrame:
    """Normalise by a field profile; records lacking question or statement are left out."""
    return _imported(
        df, *[first_of(df, profile.get(f, [])) for f in ("question", "sql", "db_id")]
    )


def normalize_detected(df: DataFrame, question_field: str | None, sql_field: str | None) -> DataFrame:
    """Normalise by detected fields; a record that lacks one, or has null in it, is read by the usual names."""

    def chosen(field: str | None, names: list[str]) -> Column:
        usual = first_of(df, names)
        return F.coalesce(F.col(field).cast("string"), usual) if field and field in df.columns else usual

    return _imported(
        df,
        chosen(question_field, IMPORT_QUESTION_FIELDS),
        chosen(sql_field, SQL_FIELDS),
        first_of(df, DB_FIELDS),
    )


def clean_dataset_id(ref: Column) -> Column:
    """``org/repo`` or ``repo`` from a dataset reference or hub URL; null for a URL without one."""
    name = strip(ref)
    part = "[a-zA-Z0-9_-]+"
    from_url = F.nullif(
        F.regexp_extract(name, rf"huggingface\.co/datasets/({part}/{part}|{part})", 1), F.lit("")
    )
    name = F.when(name.contains("huggingface.co"), from_url).otherwise(name)
    name = strip(F.btrim(F.btrim(name, F.lit("/")), F.lit(".")))
    name = F.substring_index(F.substring_index(name, "?", 1), "#", 1)
    return F.regexp_replace(name, r"[./-]+\z", "")


def file_safe(dataset_id: Column) -> Column:
    return F.translate(dataset_id, "/.", "__")


def datasets_clean(df: DataFrame, ref: str) -> DataFrame:
    """Add ``dataset_id`` and ``file_name`` for a column of dataset references."""
    df = df.withColumn("dataset_id", clean_dataset_id(F.col(ref)))
    return df.withColumn("file_name", file_safe(F.col("dataset_id")))
