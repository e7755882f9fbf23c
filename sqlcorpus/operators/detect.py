"""Which field holds the statement, and which the question?

Each string field of each record is scored by its name and its text; the corpus
form sums the scores per field in one aggregation (partial sums on the map side,
a handful of groups) and takes the field with the best sum. ``first`` looks at
the first record only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import count_of, has, strip

# Words and weights of the field scores.
SQL_WORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "WITH",
    "FROM", "WHERE", "JOIN", "GROUP", "ORDER", "HAVING", "UNION",
]
SQL_OPERATORS = ["COUNT", "SUM", "AVG", "MAX", "MIN", "DISTINCT", "AS", "ON", "IN", "LIKE"]
SCHEMA_WORDS = ["TABLE", "COLUMN", "INDEX", "VIEW"]
QUESTION_WORDS = [
    "what", "how", "which", "who", "when", "where", "why", "can", "could", "should", "would",
]
OPENERS = ["what", "how", "which", "who", "when", "where", "why"]
IMPERATIVES = [
    "list", "show", "tell", "find", "get", "give", "display", "return", "retrieve", "fetch", "extract",
]
PHRASES = ["i want", "i need", "give me", "show me"]
QUESTION_NAMES = [
    (["question"], 15), (["prompt"], 12), (["instruction"], 12), (["text"], 5), (["nl", "natural"], 8),
    (["user", "input", "query", "request"], 6),
]


def _weight(test: Column, n: int) -> Column:
    return F.when(test, n).otherwise(0)


def sql_field_score(name: Column, value: Column) -> Column:
    """How much a field looks like SQL."""
    n, u = F.lower(name), F.upper(value)
    words = count_of([u.contains(w) for w in SQL_WORDS])
    operators = count_of([u.contains(w) for w in SQL_OPERATORS])
    return (
        _weight(has(n, "sql"), 20)
        + words * 3
        + F.when(words >= 3, 15).when(words == 2, 8).otherwise(0)
        + operators * 2
        + _weight(has(u, "FROM") & has(u, "SELECT"), 10)
        + _weight(has(u, "JOIN"), 5)
        + _weight(has(u, "WHERE"), 5)
        + _weight(has(u, "GROUP BY", "ORDER BY"), 5)
        + _weight((has(n, "query") & ~has(n, "sql")) | has(n, "statement"), 8)
        + _weight(has(u, *SCHEMA_WORDS), 5)
    )


def question_field_score(name: Column, value: Column) -> Column:
    """How much a field looks like a question; never negative."""
    n, low, u = F.lower(name), F.lower(value), F.upper(value)
    words = count_of([low.contains(w) for w in QUESTION_WORDS])
    orders = count_of([low.contains(w) for w in IMPERATIVES])
    stripped = strip(low)
    opens = F.lit(False)
    for w in OPENERS:
        opens = opens | stripped.startswith(w)
    by_name = F.lit(0)
    for names, n_points in reversed(QUESTION_NAMES):
        by_name = F.when(has(n, *names), n_points).otherwise(by_name)
    total = (
        _weight(has(value, "?"), 20)
        + words * 3
        + F.when(words >= 2, 10).when(words == 1, 5).otherwise(0)
        + orders * 2
        + _weight(orders >= 2, 8)
        + _weight(opens, 10)
        + _weight(has(low, " please ") | has(stripped, "please "), 5)
        + _weight(has(low, *PHRASES), 5)
        + by_name
        - _weight(has(u, "SELECT", "FROM", "WHERE", "JOIN"), 10)
        - _weight(has(u, "CREATE TABLE", "INSERT INTO"), 10)
    )
    return F.greatest(total, F.lit(0))


def text_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def field_scores(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Long form: one row per record and present string field, with both scores."""
    fields = fields or text_fields(df)
    cells = [
        F.struct(F.lit(f).alias("field"), F.lit(i).alias("pos"), F.col(f).alias("value"))
        for i, f in enumerate(fields)
    ]
    kept = [c for c in ("ord",) if c in df.columns]
    long = df.select(*kept, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    name, value = F.col("field"), F.col("value")
    return long.select(
        *kept,
        "field",
        "pos",
        sql_field_score(name, value).alias("sql_score"),
        question_field_score(name, value).alias("question_score"),
    )


def field_table(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per field with the sums of its scores over all records."""
    return (
        field_scores(df, fields)
        .groupBy("field", "pos")
        .agg(
            F.count("*").alias("records"),
            F.sum("sql_score").alias("sql_score"),
            F.sum("question_score").alias("question_score"),
        )
    )


def best_fields(table: DataFrame) -> DataFrame:
    """One row: the field of the best mean score for each role, null if every score is 0; ties go to the first."""

    def best(score: str) -> Column:
        top = F.max_by("field", F.struct(F.col(score) / F.col("records"), -F.col("pos")))
        return F.when(F.max(score) > 0, top)

    return table.agg(best("sql_score").alias("sql_field"), best("question_score").alias("question_field"))


def detect_fields(df: DataFrame, fields: list[str] | None = None, sample: str = "all") -> DataFrame:
    """``sample='all'`` scores every record; ``'first'`` only the one with the lowest ``ord``."""
    if sample == "first":
        df = df.orderBy("ord").limit(1)
    return best_fields(field_table(df, fields))
