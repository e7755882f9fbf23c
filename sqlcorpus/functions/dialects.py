"""Rewriting templates for other SQL dialects.

Conversion is one narrow projection; ``fan_out`` multiplies the rows by the
(fixed, four at most) dialects first, so one job writes all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DIALECTS, CurationConfig
from .spots import let
from .text import CLOSE, D, I, NOT_BEFORE_WORD, OPEN, S, W, mentions, sql_text, starts

_PLACEHOLDER = rf"\{{\{{\.([{W}]+)\}}\}}"

# Units of DATE_ADD that have a counterpart; any other becomes day.
DATE_PARTS = ["DAY", "MONTH", "YEAR", "HOUR", "MINUTE", "SECOND"]

# The calls that are rewritten.
DATE_CALLS = ["NOW(", "CURDATE(", "CURTIME(", "DATE_ADD("]


def _numbered(sql: str) -> str:
    """``$k`` placeholders; a repeated name keeps the number of its first use."""
    names = f"array_distinct(regexp_extract_all({sql}, {sql_text(_PLACEHOLDER)}, 1))"
    step = "(t, n) -> struct(replace(t.s, concat('{{.', n, '}}'), concat('$', t.k)) AS s, t.k + 1 AS k)"
    return f"aggregate({names}, struct({sql} AS s, 1 AS k), {step}, t -> t.s)"


def _parameters(sql: str, dialect: str) -> Column:
    if dialect == "postgres":
        return F.when(F.col(sql).contains("{{."), F.expr(_numbered(sql))).otherwise(F.col(sql))
    new = F.regexp_replace(sql, _PLACEHOLDER, "@$1" if dialect == "sql_server" else "?")
    return F.when(F.col(sql).contains("{{."), new).otherwise(F.col(sql))


def _paging(name: str, cfg: CurationConfig) -> Column:
    """``LIMIT n [OFFSET m]`` for SQL Server."""
    sql = F.col(name)
    if cfg.clean:
        n = rf"([0-9]+|@[{W}]+)(?![{W}])"
        for rx, to in (
            (rf"{starts('L')}LIMIT{S}+{n}{S}+OFFSET{S}+{n}", "OFFSET $2 ROWS FETCH NEXT $1 ROWS ONLY"),
            (rf"{starts('O')}OFFSET{S}+{n}{S}+LIMIT{S}+{n}", "OFFSET $1 ROWS FETCH NEXT $2 ROWS ONLY"),
            (rf"{starts('L')}LIMIT{S}+{n}", "OFFSET 0 ROWS FETCH NEXT $1 ROWS ONLY"),
            (rf"{starts('O')}OFFSET{S}+{n}(?!{S}+ROWS)", "OFFSET $1 ROWS"),
        ):
            sql = F.regexp_replace(sql, rx, to)
        return sql
    # Each LIMIT takes the first offset found from 30 characters before it to 30 behind it.
    marked = f"split(regexp_replace({name}, {sql_text(rf'{starts("L")}LIMIT{S}+({D}+)')}, '{OPEN}$0{CLOSE}'), '{OPEN}')"
    match, gap = f"substring_index(s, '{CLOSE}', 1)", f"substring_index(s, '{CLOSE}', -1)"
    window = f"substring({name}, greatest(t.pos - 30, 0) + 1, least(t.pos, 30) + length({match}) + 30)"
    offset = f"coalesce(nullif(regexp_extract({window}, {sql_text(rf'{I}OFFSET{S}+({D}+)')}, 1), ''), '0')"
    step = (
        f"(t, s) -> struct(concat(t.done, 'OFFSET ', {offset}, ' ROWS FETCH NEXT ', "
        f"regexp_extract({match}, {sql_text(rf'({D}+)')}, 1), ' ROWS ONLY', {gap}) AS done, "
        f"t.pos + length({match}) + length({gap}) AS pos)"
    )
    folded = let(
        marked,
        "p",
        "aggregate(slice(p, 2, size(p)), struct(get(p, 0) AS done, length(get(p, 0)) AS pos), " + step + ", t -> t.done)",
    )
    limited = F.when(F.upper(sql).contains("LIMIT"), F.expr(folded)).otherwise(sql)
    return F.regexp_replace(limited, rf"{starts('O')}OFFSET{S}+({D}+)(?!{S}+ROWS)", "OFFSET $1 ROWS")


def _call(sql: Column, name: str, to: str) -> Column:
    return F.regexp_replace(sql, rf"{starts(name[0])}{name}\(\)", to)


def _dates(sql: Column, dialect: str, cfg: CurationConfig) -> Column:
    add = rf"(?=[Dd]){I}DATE_ADD\(([^,]+),{S}*INTERVAL{S}+({D}+){S}+"
    if dialect == "sql_server":
        for name, to in (
            ("NOW", "GETDATE()"),
            ("CURDATE", "CAST(GETDATE() AS DATE)"),
            ("CURTIME", "CAST(GETDATE() AS TIME)"),
        ):
            sql = _call(sql, name, to)
        # one pass over the calls, then the marked units
        sql = F.regexp_replace(sql, rf"{add}([{W}]+)\)", f"DATEADD({OPEN}$3{CLOSE}, $2, $1)")
        for part in DATE_PARTS:
            sql = F.regexp_replace(sql, rf"{OPEN}{I}{part}{CLOSE}", part.lower())
        return F.regexp_replace(sql, f"{OPEN}[^{CLOSE}]*{CLOSE}", "day")
    if dialect == "postgres":
        return _call(_call(sql, "CURDATE", "CURRENT_DATE"), "CURTIME", "CURRENT_TIME")
    if dialect == "sqlite":
        for name, to in (("NOW", "datetime('now')"), ("CURDATE", "date('now')"), ("CURTIME", "time('now')")):
            sql = _call(sql, name, to)
        days = "$2" if cfg.clean else r"\\2"  # compat keeps the backslash that slipped into the text
        return F.regexp_replace(sql, rf"{add}DAY\)", f"date($1, '+{days} days')")
    return sql


def _types(sql: Column, dialect: str) -> Column:
    """Column types, in statements that define a schema."""

    def word(c: Column, name: str, to: str) -> Column:
        return F.regexp_replace(c, rf"{starts(name[0])}{name}{NOT_BEFORE_WORD}", to)

    out = sql
    if dialect == "sql_server":
        out = word(word(out, "BOOLEAN", "BIT"), "AUTO_INCREMENT", "IDENTITY(1,1)")
        out = F.regexp_replace(out, rf"{starts('T')}TINYINT\({D}+\)", "TINYINT")
    elif dialect == "postgres":
        out = F.regexp_replace(out, rf"{I}{S}+AUTO_INCREMENT", " SERIAL")
    elif dialect == "sqlite":
        out = word(word(out, "BOOLEAN", "INTEGER"), "AUTO_INCREMENT", "AUTOINCREMENT")
    schema = sql.rlike(rf"{starts('CA')}(?:CREATE|ALTER){NOT_BEFORE_WORD}")
    return F.when(schema, out).otherwise(sql)


def convert(
    df: DataFrame, dialect: str, cfg: CurationConfig = CurationConfig(), out: str = "statement"
) -> DataFrame:
    """Put the converted ``statement`` into column ``out``, one projection per step."""
    df = df.withColumn(out, _parameters("statement", dialect))

    def step(df: DataFrame, new: Column, *words: str) -> DataFrame:
        # the substring test spares most texts the regular expressions
        return df.withColumn(out, F.when(mentions(F.col(out), *words), new).otherwise(F.col(out)))

    if dialect == "sql_server":
        df = step(df, _paging(out, cfg), "LIMIT", "OFFSET")
    if dialect != "mysql":
        df = step(df, _dates(F.col(out), dialect, cfg), *DATE_CALLS)
    if dialect == "sql_server":
        df = step(df, F.regexp_replace(out, rf"{starts('L')}LENGTH\(", "LEN("), "LENGTH(")
    return step(df, _types(F.col(out), dialect), "CREATE", "ALTER") if dialect != "mysql" else df


def named_parameters(params: Column) -> Column:
    """Parameters with their SQL Server name."""
    return F.transform(
        params,
        lambda p: F.struct(
            p["name"],
            p["type"],
            p["description"],
            F.concat(F.lit("@"), p["name"]).alias("_sql_server_name"),
        ),
    )


def fan_out(df: DataFrame, dialects: tuple[str, ...] = DIALECTS, cfg: CurationConfig = CurationConfig()) -> DataFrame:
    """One row per template and dialect, with the converted ``statement``.

    The conversions are columns next to each other, so the templates are computed
    once, and one ``inline`` turns them into rows. Write it partitioned by ``dialect``.
    """
    columns = {d: f"__sql_{d}" for d in dialects}
    for d, c in columns.items():
        df = convert(df, d, cfg, c)
    rows = F.array(*[F.struct(F.lit(d).alias("dialect"), F.col(c).alias("statement")) for d, c in columns.items()])
    kept = [c for c in df.columns if c != "statement" and c not in columns.values()]
    return df.select(*kept, F.inline(rows))
