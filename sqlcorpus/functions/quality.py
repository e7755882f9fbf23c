"""Quality scores of a template: parameters, complexity, description, reusability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CurationConfig
from .labels import without_placeholders
from .text import D, NOT_AFTER_WORD, NOT_BEFORE_WORD, S, W, count_of, has, occurrences, points

# Name parts that put a parameter into a category, first hit wins.
CATEGORIES = [
    ("table", ["table"]),
    ("column", ["col"]),
    ("value", ["value", "threshold"]),
    ("pagination", ["limit", "offset"]),
    ("sorting", ["order", "sort"]),
    ("filter", ["where", "filter", "join", "group"]),
]

# Words that make a question informative.
QUESTION_WORDS = [
    "how many", "what", "which", "list", "show", "return", "find",
    "calculate", "count", "average", "maximum", "minimum", "total",
]

PARTS = ["parameters", "complexity", "description", "reusability"]


def _category(p: Column) -> Column:
    name = F.lower(p["name"])
    out = F.lit(None).cast("string")
    for category, words in reversed(CATEGORIES):
        out = F.when(has(name, *words), F.lit(category)).otherwise(out)
    return out


def parameter_score(params: Column) -> Column:
    """0-40 points: how many parameters, how many categories, how many types."""
    n = F.size(params)
    amount = F.when(n >= 5, 15.0).when(n >= 3, 10.0).when(n >= 1, 5.0).otherwise(0.0)
    categories = F.size(F.array_distinct(F.array_compact(F.transform(params, _category))))
    types = F.size(F.array_distinct(params["type"]))
    total = amount + F.least(categories * 3, F.lit(15)) + F.least(types * 5, F.lit(10))
    return F.least(total, F.lit(40.0))


def complexity_score(sql: Column, cfg: CurationConfig = CurationConfig()) -> Column:
    """0-30 points for the clauses a statement has."""
    text = without_placeholders(sql) if cfg.clean else sql
    u = F.upper(text)
    joins = F.least(occurrences(u, "JOIN") - 1, F.lit(2)) * 2
    total = (
        points(has(u, "SELECT"), 5)
        + F.when(has(u, "JOIN"), joins + 8.0).otherwise(0.0)
        + points(has(u, "GROUP BY"), 7)
        + points(has(u, "COUNT(", "SUM(", "AVG(", "MAX(", "MIN("), 5)
        + points(has(u, "WHERE"), 2)
        + points(has(u, "HAVING"), 3)
        + points(occurrences(text, "SELECT") > 1, 5)
        + points(has(u, "DISTINCT"), 2)
    )
    return F.least(total, F.lit(30.0))


def description_score(question: Column) -> Column:
    """0-20 points for the length of the question and its informative words."""
    n = F.length(question)
    lower = F.lower(question)
    length = F.when(n >= 100, 10.0).when(n >= 50, 7.0).when(n >= 20, 4.0).otherwise(2.0)
    words = count_of([lower.contains(w) for w in QUESTION_WORDS])
    total = F.least(length + F.least(words * 2, F.lit(10)), F.lit(20.0))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(total)


def reusability_score(sql: Column) -> Column:
    """10 points, less for what is still written into the statement."""
    quoted = sql.rlike("'[^']{2,}'") | sql.rlike('"[^"]{2,}"')
    bare = F.regexp_replace(sql, rf"\{{\{{\.[{W}]+\}}\}}", "")
    number = bare.rlike(rf"(?={D}){NOT_AFTER_WORD}{D}{{2,}}{NOT_BEFORE_WORD}")
    table = ~sql.contains("{{.table") & sql.rlike(rf"(?=F){NOT_AFTER_WORD}FROM{S}+[a-zA-Z_][{W}]+(?!{S}*\()")
    return F.greatest(10.0 - points(quoted, 3) - points(number, 2) - points(table, 2), F.lit(0.0))


def score_breakdown(sql: Column, params: Column, question: Column, cfg: CurationConfig = CurationConfig()) -> Column:
    """The four partial scores as one struct."""
    return F.struct(
        parameter_score(params).alias("parameters"),
        complexity_score(sql, cfg).alias("complexity"),
        description_score(question).alias("description"),
        reusability_score(sql).alias("reusability"),
    )


def total_score(breakdown: Column) -> Column:
    return breakdown["parameters"] + breakdown["complexity"] + breakdown["description"] + breakdown["reusability"]
