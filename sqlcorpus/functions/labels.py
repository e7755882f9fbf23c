"""Labels, names, keys and generated descriptions, all as ``Column`` builders.

Keyword tests are plain substring tests on the upper-cased statement, as scores and
labels have to agree with each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CurationConfig
from .text import NOT_AFTER_WORD, NOT_BEFORE_WORD, S, has, occurrences, starts, strip, words_if, words_of

# First words that name the operation.
OPERATIONS = ["select", "insert", "update", "delete", "create", "alter", "drop"]

# The order in which features enter a tool name, and how many do.
NAME_FEATURES = 3
NAME_LENGTH = 50
DESCRIPTION_LENGTH = 500


def without_placeholders(sql: Column) -> Column:
    """The statement with the names inside placeholders blanked (clean mode only)."""
    return F.regexp_replace(sql, r"\{\{\.[^}]*\}\}", "{{}}")


def operation(sql: Column) -> Column:
    """The operation word a statement starts with, or null."""
    start = strip(F.upper(sql))
    out = F.lit(None).cast("string")
    for word in reversed(OPERATIONS):
        out = F.when(start.startswith(word.upper()), F.lit(word)).otherwise(out)
    return out


def _call(u: Column, *names: str) -> Column:
    initials = "".join({n[0] for n in names})
    return has(u, *names) & u.rlike(rf"(?=[{initials}]){NOT_AFTER_WORD}(?:{'|'.join(names)}){S}*\(")


def label_array(sql: Column) -> Column:
    """Operation label, then structure labels in their fixed order."""
    u = F.upper(sql)
    structure = [
        (has(u, "JOIN"), "join"),
        (has(u, "LEFT JOIN"), "left_join"),
        (has(u, "RIGHT JOIN"), "right_join"),
        (_call(u, "COUNT"), "count"),
        (_call(u, "SUM"), "sum"),
        (_call(u, "AVG"), "avg"),
        (_call(u, "MAX", "MIN"), "minmax"),
        (has(u, "GROUP BY"), "grouped"),
        (has(u, "ORDER BY"), "sorted"),
        (has(u, "HAVING"), "having"),
        (has(u, "WHERE"), "filtered"),
        (has(u, "DISTINCT"), "distinct"),
        (has(u, "LIMIT"), "limited"),
        (has(u, "OFFSET"), "offset"),
        (occurrences(u, "SELECT") > 1, "subquery"),
    ]
    return words_of([operation(sql), *[F.when(test, F.lit(word)) for test, word in structure]])


def labels_text(labels: Column) -> Column:
    return F.array_join(labels, ", ")


def tool_name(sql: Column, cfg: CurationConfig = CurationConfig()) -> Column:
    """Operation and the three leading structural features, joined by ``_``."""

    u = F.upper(sql)

    def word(first: str, rest: str = "") -> Column:
        # the substring test spares most texts the regular expression
        return has(u, first) & sql.rlike(rf"{starts(first[0])}{first}{rest}{NOT_BEFORE_WORD}")

    def call(*names: str) -> Column:
        initials = "".join(sorted({n[0] for n in names}))
        return has(u, *names) & sql.rlike(rf"{starts(initials)}(?:{'|'.join(names)}){S}*\(")

    count, total = call("COUNT"), call("SUM")
    join, left, right = word("JOIN"), word("LEFT", rf"{S}+JOIN"), word("RIGHT", rf"{S}+JOIN")
    if cfg.clean:
        joins = [(join & ~left & ~right, "joined"), (left, "left_joined"), (right & ~left, "right_joined")]
    else:
        joins = [(join, "joined")]
    features = words_if(
        [
            (count, "count"),
            (~count & total, "sum"),
            (~count & ~total & call("AVG", "MAX", "MIN"), "aggregate"),
            (word("GROUP", rf"{S}+BY"), "grouped"),
            *joins,
            (word("WHERE"), "filtered"),
            (word("ORDER", rf"{S}+BY"), "sorted"),
            (word("LIMIT"), "limited"),
            (word("DISTINCT"), "distinct"),
            (word("HAVING"), "having"),
            (word("OFFSET"), "offset"),
        ]
    )
    name = F.concat_ws("_", F.coalesce(operation(sql), F.lit("query")), F.slice(features, 1, NAME_FEATURES))
    return F.rtrim(F.substring(name, 1, NAME_LENGTH), F.lit("_"))


def short_hash(text: Column, digits: int = 8) -> Column:
    """The first digits of the SHA-1 of the text."""
    return F.substring(F.sha1(text.cast("binary")), 1, digits)


def tool_key(name: Column, sql: Column, question: Column, digits: int) -> Column:
    return F.concat(name, F.lit("_"), short_hash(F.concat(sql, question), digits))


def tool_id(name: Column, sql: Column, question: Column) -> Column:
    """What a tool is: the SHA-1 of its name, statement and question, which nothing shortens."""
    return F.sha1(F.concat_ws("\0", name, sql, question).cast("binary"))


def slug(text: Column, prefix: str = "tool") -> Column:
    """An identifier of at most 60 lower-case letters, digits and ``_`` that starts with a letter."""
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+", "_"), F.lit("_"))
    s = F.regexp_replace(s, "_+", "_")
    named = F.when(s == "", F.lit(prefix)).when(s.rlike("^[a-z]"), s).otherwise(F.concat(F.lit(prefix + "_"), s))
    return F.substring(named, 1, 60)


def structure_sentence(sql: Column) -> Column:
    """What a SELECT does, in words; null for other statements."""
    u = F.upper(sql)
    aggregate = (
        F.when(has(u, "COUNT("), F.lit("counts records"))
        .when(has(u, "SUM("), F.lit("calculates sum"))
        .when(has(u, "AVG("), F.lit("calculates average"))
        .when(has(u, "MAX(", "MIN("), F.lit("finds extremes"))
    )
    phrases = [
        ("JOIN", "by joining multiple tables"),
        ("GROUP BY", "grouped by criteria"),
        ("WHERE", "with filtering conditions"),
        ("ORDER BY", "sorted by specified column"),
        ("LIMIT", "limited to top results"),
    ]
    said = F.concat_ws(" ", F.lit("Retrieves data"), aggregate, *[F.when(has(u, w), F.lit(p)) for w, p in phrases])
    return F.when(has(u, "SELECT"), said)


def parameter_sentence(params: Column) -> Column:
    """How many parameters of each sort there are; null without parameters."""

    def is_table(p: Column) -> Column:
        return F.lower(p["name"]).contains("table")

    def is_column(p: Column) -> Column:
        return F.lower(p["name"]).contains("col")

    def counted(test, words: str) -> Column:
        n = F.nullif(F.size(F.filter(params, test)), F.lit(0))
        return F.concat(F.lit(words + " ("), n.cast("string"), F.lit(")"))

    said = F.concat_ws(
        ", ",
        counted(is_table, "customizable tables"),
        counted(is_column, "flexible column selection"),
        counted(
            lambda p: p["name"].isin("value", "threshold", "limit_n", "offset_n"), "adjustable filters and limits"
        ),
        counted(lambda p: (p["type"] == "string") & ~is_table(p) & ~is_column(p), "string pattern matching"),
    )
    return F.concat(F.lit("Parameters: "), F.nullif(said, F.lit("")))


def semantic_description(sql: Column, params: Column) -> Column:
    """Structure and parameter sentences, cut at 500 characters."""
    said = F.concat_ws(". ", structure_sentence(sql), parameter_sentence(params))
    return F.substring(said, 1, DESCRIPTION_LENGTH)


def with_labels(description: Column, labels: Column) -> Column:
    text = F.concat(F.lit(" [Labels: "), F.nullif(labels_text(labels), F.lit("")), F.lit("]"))
    return F.concat(description, F.coalesce(text, F.lit("")))
