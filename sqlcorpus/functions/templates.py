"""Template extraction: literals, tables and columns become ``{{.name}}`` placeholders.

Eight passes run in a fixed order and the parameter list follows that order. All
of it is Catalyst expressions over one statement column; there is no shuffle and
no Python in the row path. What a statement usually has, one or two spots to a pass,
is spelled out in plain expressions, which Spark compiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import CurationConfig
from .spots import MANY, Rewriter, cut, entry, field, gap, let, payload, placeholder, reg
from .text import (
    CLOSE,
    D,
    ESC,
    I,
    IDENT,
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    OPEN,
    S,
    SEP,
    SPACE,
    W,
    shield_sql,
    shielded_sql,
    sql_text,
    starts,
    strip_sql,
    unshield_sql,
)

# Literals that stay in the statement, bases that get another name,
# how far back a number looks, how long a literal's name may be.
KEPT_LITERALS = ["ASC", "DESC", "YES", "NO"]
RENAMED = {"limit": "limit_n", "offset": "offset_n"}
LOOK_BACK = 40
NAME_LENGTH = 20
AGGREGATES = ["COUNT", "SUM", "AVG", "MAX", "MIN", "GROUP_CONCAT", "DISTINCT"]
# What a parameter stands for (its description), and our kind for it.
PATTERN, LITERAL, NUMBER = "String pattern for LIKE", "String value", "Numeric value"
TABLE, SELECTED, FILTERED, JOINED = "Table name", "Column to select", "Column to filter on", "Column to join on"
GROUPED, ORDERED, DIRECTION = "Column to group by", "Column to order by", "Sort direction (ASC/DESC)"
LIMIT, OFFSET = "Maximum number of rows", "Number of rows to skip"
KINDS = {
    PATTERN: "literal",
    LITERAL: "literal",
    NUMBER: "number",
    TABLE: "table",
    SELECTED: "column",
    FILTERED: "column",
    JOINED: "column",
    GROUPED: "column",
    ORDERED: "column",
    DIRECTION: "direction",
    LIMIT: "paging",
    OFFSET: "paging",
}
COMPARISONS = ["=", "!=", "<>", ">=", "<=", ">", "<"]
WORD_OPERATORS = ["IN", rf"NOT{S}+IN", "LIKE", rf"NOT{S}+LIKE", "IS", rf"IS{S}+NOT"]


def _mark(*fields: str) -> str:
    return OPEN + SEP.join(fields) + CLOSE


def _about(what: str) -> str:
    return f"'{SEP}{KINDS[what]}{SEP}{what} (e.g., '"


# --- T1 string literals ------------------------------------------------------


def _literal_rules(cfg: CurationConfig) -> list[str]:
    """Per quote: group 1 is a literal that stays, group 2 the text of one that goes."""
    kept = "|".join(KEPT_LITERALS)
    double = rf'(?=")(?:{I}("(?:[^"]|{kept})")|"([^"]+)")'
    if not cfg.clean:
        return [double, rf"(?=')(?:{I}('(?:[^']|{kept})')|'([^']+)')"]
    # a doubled quote belongs to the literal; an empty literal is skipped whole
    single = rf"(?=')(?:{I}('(?:[^']|{kept})?'(?!'))|'((?:[^']|'')[^']*+(?:''[^']*+)*+)')"
    return [double, single] if cfg.double_quotes == "literal" else [single]


def string_literals(rw: Rewriter, cfg: CurationConfig) -> None:
    renamed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items())

    def slug(v: str) -> str:
        return f"substring(btrim(regexp_replace(lower(replace({v}, '%', '')), '[^a-z0-9]+', '_'), '_'), 1, {NAME_LENGTH})"

    def base(s: str, v: str) -> str:
        named = f"if({s} RLIKE '^[0-9]', concat('v_', {s}), {s})" if cfg.clean else s
        return f"CASE {s} {renamed} WHEN '' THEN if(contains({v}, '%'), 'pattern', 'str_value') ELSE {named} END"

    def bases(add, payloads: list[str]) -> list[str]:
        if add is None:
            return [let(slug(v), "s", base("s", v)) for v in payloads]
        return add(*[base(s, v) for s, v in zip(add(*map(slug, payloads)), payloads, strict=True)])

    for rx in _literal_rules(cfg):
        quote = "'\"'" if rx.startswith('(?=")') else '"\'"'
        rw.replace(
            f"contains({rw.text}, {quote})",
            rw.marked(rx, _mark("$2") + "$1", (_mark(), "")),
            lambda v: f"if(contains({v}, '%'), {_about(PATTERN)}, {_about(LITERAL)})",
            bases=bases,
        )


# --- T2 numeric literals -----------------------------------------------------


def numeric_literals(rw: Rewriter, cfg: CurationConfig) -> None:
    """A number counts if the 40 characters before it speak of a condition and not of paging."""

    def within(*words: str) -> str:
        return "|".join(
            rf"(?=[{w[0]}{w[0].lower()}]){w}(?s:.{{0,{LOOK_BACK - len(w)}}})" for w in words
        )

    def bases(add, payloads: list[str]) -> list[str]:
        names = [f"if(contains({v}, '.'), 'threshold', 'value')" for v in payloads]
        return names if add is None else add(*names)

    condition = rf"[<>=](?s:.{{0,{LOOK_BACK - 1}}})|" + within("WHERE", "HAVING", "BETWEEN")
    before = rf"(?<!{within('LIMIT', 'OFFSET')})(?<={condition})"
    number = rf"{D}+(?:\.{D}+)?"
    rx = rf"(?={D}){NOT_AFTER_WORD}{I}(?:{before}({number})|({number})){NOT_BEFORE_WORD}"
    rw.replace(
        rw.mentions("WHERE", "HAVING", "BETWEEN", "<", "=", ">") + f" AND {rw.text} RLIKE {sql_text(D)}",
        rw.marked(rx, _mark("$1") + "$2", (_mark(), "")),
        lambda v: _about(NUMBER),
        bases=bases,
    )


# --- T3 table names ----------------------------------------------------------


def table_names(rw: Rewriter, cfg: CurationConfig) -> None:
    name = rf"{IDENT}(?:\.{IDENT})*" if cfg.clean else IDENT
    rx = (
        rf"{starts('FJIU')}(FROM|JOIN|INTO|UPDATE)"
        rf"(?:({S}+(?:SELECT|VALUES){NOT_BEFORE_WORD})|{S}+({name}))"
    )

    mark = "$1$2" + SPACE + _mark("$3")
    rw.replace(
        rw.mentions("FROM", "JOIN", "INTO", "UPDATE"),
        rw.marked(rx, mark, (SPACE + _mark(), "")),
        lambda v: _about(TABLE),
        base="table",
    )


# --- T4 select list, T7 group list -------------------------------------------

_SIMPLE = sql_text(rf"\A{IDENT}\z")


def _item_mark(base: str, column: str) -> str:
    """Mark of the i-th item ``c`` of a list; the first one carries no number."""
    return f"concat('{OPEN}{base}', if(i = 0, '', concat('_', i + 1)), '{SEP}', {column}, '{CLOSE}')"


def _listed(columns: str, item: str) -> str:
    """A comma list with white space normalised and each item ``c`` (number ``i``) rewritten."""
    items = f"transform(split({columns}, ','), c -> {strip_sql('c')})"
    return f"array_join(transform({items}, (c, i) -> {item}), ', ')"


def _replace_list(rw: Rewriter, guard: str, marked: str, kept, part, base: str, what: str, last: str) -> None:
    """Rewrite each marked list: its items' columns become placeholders, named after their place in the list.

    The fields of a mark are the whole clause, its word, its list and, if any, the word behind.
    ``kept`` tests whether a list stays as it is; ``part`` gives what an item has in front of its column,
    and the column or null.
    """
    m, bits = rw.spots(guard, marked)
    # one list of one or two items
    (f,) = rw.add(f"if(size({bits}) = 2, split({payload(bits, 1)}, '{SEP}'), NULL)")
    stays, items = rw.add(kept(f"get({f}, 2)"), f"split(get({f}, 2), ',')")
    c = rw.add(f"if({stays}, NULL, {strip_sql(f'get({items}, 0)')})", f"if({stays}, NULL, {strip_sql(f'get({items}, 1)')})")
    (h1, x1), (h2, x2) = map(part, c)
    x1, x2 = rw.add(x1, x2)
    n1, n2 = f"'{base}'", f"'{base}_2'"
    (fast,) = rw.add(
        f"CASE WHEN {bits} IS NULL OR {stays} THEN 0 WHEN {f} IS NULL OR size({items}) > 2 THEN {MANY} "
        f"WHEN {x1} IS NOT NULL AND {rw.used(n1)} OR {x2} IS NOT NULL AND {rw.used(n2)} THEN {MANY} ELSE size({items}) END"
    )
    first, second = (f"if({x} IS NULL, {i}, concat({h}, {placeholder(n)}))" for i, h, x, n in ((c[0], h1, x1, n1), (c[1], h2, x2, n2)))
    start, end = f"get({bits}, 0), get({f}, 1), ' '", last.format(f=f) + gap(bits, 1)
    text = f"CASE {fast} WHEN 1 THEN concat({start}, {first}, {end}) WHEN 2 THEN concat({start}, {first}, ', ', {second}, {end}) ELSE {rw.text} END"
    new = ", ".join(f"if({x} IS NULL, '', {entry(n, _about(what), x)})" for x, n in ((x1, n1), (x2, n2)))
    log = f"if({fast} IN (1, 2), concat({rw.log}, {new}), {rw.log})"

    head, column = part("c")
    item = let(column, "d", f"if(d IS NULL, c, concat({head}, {_item_mark(base, 'd')}))")

    def render(bit: str) -> str:
        columns, behind = field(bit, 2), last.format(f=f"{bit}.f")
        clause = f"concat({field(bit, 1)}, ' ', {_listed(columns, item)}, {behind}'')"
        return f"concat(if({kept(columns)}, {field(bit, 0)}, {clause}), {bit}.gap)"

    def many() -> str:
        names = rw._names(f"transform(x, e -> substring_index(e, '{SEP}', 1))")
        some = rw.named("l", lambda v: _about(what), names, lambda v: f"substring_index({v}, '{SEP}', -1)")
        none = f"named_struct('text', l, 'log', {rw.log})"
        listed = let("concat(o.head, array_join(o.items, ''))", "l", f"if(contains(l, '{OPEN}'), {some}, {none})")
        return let(cut("m", render), "o", listed)

    rw.put(fast, text, log, m, many)


def select_columns(rw: Rewriter, cfg: CurationConfig) -> None:
    rx = rf"{starts('S')}(?s)(SELECT){S}+(.*?){S}+(FROM){NOT_BEFORE_WORD}"
    aggregate = sql_text(rf"{I}{NOT_AFTER_WORD}(?:{'|'.join(AGGREGATES)}){S}*\(")

    def kept(columns: str) -> str:
        return f"({strip_sql(columns)} = '*' OR {columns} RLIKE {aggregate})"

    def part(c: str) -> tuple[str, str]:
        return "''", f"if(contains(upper({c}), ' AS ') OR contains({c}, '.') OR NOT {c} RLIKE {_SIMPLE}, NULL, {c})"

    guard = rw.mentions("SELECT") + " AND " + rw.mentions("FROM")
    marked = rw.marked(rx, _mark("$0", "$1", "$2", "$3"))
    _replace_list(rw, guard, marked, kept, part, "select_col", SELECTED, "' ', get({f}, 3), ")


def group_columns(rw: Rewriter, cfg: CurationConfig) -> None:
    if cfg.clean:
        # the list may hold calls; it ends before a clause word, a bracket, ';' or the end
        items = r"[^;()]*?(?:\([^()]*\)[^;()]*?)*?"
        ends = rf"(?={S}+(?:ORDER|HAVING|LIMIT|OFFSET){NOT_BEFORE_WORD}|{S}*(?:[;)]|\z))"
    else:
        items = r"[^;]+?"
        ends = rf"(?={S}+(?:ORDER|HAVING|LIMIT|;|\z))"
    rx = rf"{starts('G')}(GROUP{S}+BY){S}+({items}){ends}"

    def kept(columns: str) -> str:
        return f"contains({columns}, '{{{{.')"

    def part(c: str) -> tuple[str, str]:
        dots = f"length({c}) - length(replace({c}, '.', ''))"
        column = (
            f"CASE WHEN contains({c}, '(') OR {dots} > 1 THEN NULL WHEN {dots} = 1 THEN substring_index({c}, '.', -1) "
            f"WHEN {c} RLIKE {_SIMPLE} THEN {c} END"
        )
        return f"if(contains({c}, '.'), concat(substring_index({c}, '.', 1), '.'), '')", column

    _replace_list(rw, rw.mentions("GROUP"), rw.marked(rx, _mark("$0", "$1", "$2")), kept, part, "group_col", GROUPED, "")


# --- T5 first WHERE column, T6 first ON condition ----------------------------


def where_columns(rw: Rewriter, cfg: CurationConfig) -> None:
    words, signs = "|".join(WORD_OPERATORS), "|".join(COMPARISONS)
    if cfg.clean:
        op = rf"(?:{signs}|(?:{words}){NOT_BEFORE_WORD})"
        gap = rf"(?:{S}+|(?=[=!<>]))"
    else:
        # a sign counts only when a word is glued to it
        op = rf"(?:(?:{signs})(?=[{W}])|(?:{words}){NOT_BEFORE_WORD})"
        gap = rf"{S}+"
    rx = (
        rf"{starts('W')}(?:(WHERE){S}+(?:({IDENT}\.)([{W}]*)|({IDENT})){gap}({op})"
        rf"|(WHERE{S}+[a-zA-Z_][{W}.]*{gap}{op}))"
    )

    mark = "$6$1" + SPACE + "$2" + _mark("$3$4") + SPACE + "$5"
    rw.replace(
        rw.mentions("WHERE"),
        rw.marked(rx, mark, (SPACE + _mark() + SPACE, "")),
        lambda v: _about(FILTERED),
        base="where_col",
    )


def join_columns(rw: Rewriter, cfg: CurationConfig) -> None:
    whole = rf"(?![{W}.])"
    side = rf"(?:({IDENT}\.)([{W}]*){whole}|([a-zA-Z_][{W}]+){whole}|([a-zA-Z_][{W}.]+))"
    rx = rf"{starts('O')}(ON){S}+{side}{S}*({'|'.join(COMPARISONS)}){S}*{side}"
    left, right = (f"${g}" + _mark(f"${g + 1}${g + 2}") + f"${g + 3}" for g in (2, 7))
    rw.replace(
        rw.mentions("ON"),
        rw.marked(rx, f"$1 {left} $6 {right}", (" " + _mark(), " ")),
        lambda v: _about(JOINED),
        base="join_col",
    )


# --- T8 LIMIT, OFFSET, ORDER BY ----------------------------------------------


def page_sizes(rw: Rewriter, cfg: CurationConfig) -> None:
    """All LIMIT values share one parameter, and all OFFSET values another."""
    for word, name, what in (("LIMIT", "limit_n", LIMIT), ("OFFSET", "offset_n", OFFSET)):
        rx = sql_text(rf"{starts(word[0])}{word}{S}+({D}+)")
        guard = rw.mentions(word)
        text, first = rw.add(
            f"if({guard}, regexp_replace({rw.text}, {rx}, '{word} {{{{.{name}}}}}'), {rw.text})",
            f"if({guard}, regexp_extract({rw.text}, {rx}, 1), '')",
        )
        name = f"'{name}'"
        (log,) = rw.add(f"if({first} = '' OR {rw.used(name)}, {rw.log}, concat({rw.log}, {entry(name, _about(what), first)}))")
        rw.text, rw.log = text, log


def order_keys(rw: Rewriter, cfg: CurationConfig) -> None:
    path = rf"[a-zA-Z_][{W}.]*"
    # clean: white space is taken only together with a direction word
    way = rf"(?:{S}+(ASC|DESC){NOT_BEFORE_WORD})?" if cfg.clean else rf"{S}*(ASC|DESC)?"
    rx = rf"{starts('O')}ORDER{S}+BY{S}+(?:({path}\([^)]*\)){way}|({path}){way})"

    def parts(f) -> tuple[str, str, str]:
        """The clause with placeholders, or as it is; and the examples of key and direction."""
        whole, call, call_way, key, key_way = map(f, range(5))
        kept = f"{call} <> '' AND (contains({call}, '{{{{.') OR {call_way} = '')"
        by = f"if({call} <> '', {call}, {placeholder("'order_col'")})"
        way = f"if(concat({call_way}, {key_way}) = '', '', concat(' ', {placeholder("'order_dir'")}))"
        text = f"if({kept}, {whole}, concat('ORDER BY ', {by}, {way}))"
        return text, f"if({kept}, '', {key})", f"if({kept}, '', concat({call_way}, {key_way}))"

    def make(bit: str) -> str:
        text, key, way = parts(lambda i: field(bit, i))
        regs = f"{reg('order_col', _about(ORDERED), key)}, {reg('order_dir', _about(DIRECTION), way)}"
        return f"named_struct('text', concat({text}, {bit}.gap), 'regs', filter(array({regs}), r -> r.example <> ''))"

    m, bits = rw.spots(rw.mentions("ORDER"), rw.marked(rx, _mark("$0", "$1", "$2", "$3", "$4")))
    (f,) = rw.add(f"if(size({bits}) = 2, split({payload(bits, 1)}, '{SEP}'), NULL)")
    clause, key, way = rw.add(*parts(lambda i: f"get({f}, {i})"))
    (fast,) = rw.add(f"CASE WHEN {bits} IS NULL THEN 0 WHEN {f} IS NULL THEN {MANY} ELSE 1 END")
    new = ", ".join(
        f"if({example} = '' OR {rw.used(name)}, '', {entry(name, _about(what), example)})"
        for name, what, example in (("'order_col'", ORDERED, key), ("'order_dir'", DIRECTION, way))
    )
    rw.put(
        fast,
        f"if({fast} = 1, concat(get({bits}, 0), {clause}, {gap(bits, 1)}), {rw.text})",
        f"if({fast} = 1, concat({rw.log}, {new}), {rw.log})",
        m,
        lambda: let(cut("m", make), "c", rw.with_new("concat(c.head, array_join(c.items.text, ''))", "flatten(c.items.regs)")),
    )


# --- the whole stage ---------------------------------------------------------


def passes_for(cfg: CurationConfig) -> list:
    steps = [string_literals, numeric_literals]
    if cfg.parameterize_tables:
        steps.append(table_names)
    if cfg.parameterize_columns:
        steps += [select_columns, where_columns, join_columns]
    return steps + [group_columns, page_sizes, order_keys]


def extract_templates(
    df: DataFrame, cfg: CurationConfig = CurationConfig(), sql: str = "sql", passes: list | None = None
) -> DataFrame:
    """Add ``statement`` and ``params`` to rows with a statement column.

    ``passes`` restricts the stage to some of the passes, in the given order.
    """
    rw = Rewriter(df, sql, f"if({shielded_sql(sql)}, {shield_sql(sql)}, {sql})")
    for step in passes or passes_for(cfg):
        step(rw, cfg)
    (params,) = rw.add(rw.params())
    plain = (
        "named_struct('name', p.name, 'type', p.type, "
        f"'description', {unshield_sql('p.description')}, 'kind', p.kind, 'example', {unshield_sql('p.example')})"
    )
    return rw.done(
        statement=f"if(contains({rw.text}, '{ESC}'), {unshield_sql(rw.text)}, {rw.text})",
        params=f"if(contains({rw.log}, '{ESC}'), transform({params}, p -> {plain}), {params})",
    )
