"""Expected results of the registered queries as DuckDB SQL.

The corpora are composed from known statement shapes, so templates and parameters
are stated by hand per shape, with no regular expression shared with the
implementation; scores, labels, names and statistics are computed from them by
plain SQL arithmetic.
"""

from __future__ import annotations

from .corpora import BROKEN_LINE, EVENT_SHAPES, ODD_LINES, ORDER_SHAPES
from .queries import BATCH, SHARES, TOP

# --- expected templates, per shape ------------------------------------------------
# (compat statement, names; clean statement, names); None means as in compat.

_EV0 = (
    "SELECT {{.select_col}} FROM {{.table}} WHERE event_type = {{.<T>}}",
    "<T>,table,select_col",
    "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} = {{.<T>}}",
    "<T>,table,select_col,where_col",
)
EVENTS = {
    0: _EV0,
    1: (
        "SELECT event_type, COUNT(*) FROM {{.table}} WHERE value >= {{.threshold}} GROUP BY {{.group_col}} ORDER BY COUNT(*) {{.order_dir}} LIMIT {{.limit_n}}",
        "threshold,table,group_col,limit_n,order_dir",
        "SELECT event_type, COUNT(*) FROM {{.table}} WHERE {{.where_col}} >= {{.threshold}} GROUP BY {{.group_col}} ORDER BY COUNT(*) {{.order_dir}} LIMIT {{.limit_n}}",
        "threshold,table,where_col,group_col,limit_n,order_dir",
    ),
    2: (
        "SELECT u.c_name FROM {{.table}} u JOIN {{.table_1}} e ON u.{{.join_col}} = e.{{.join_col_1}} WHERE e.{{.where_col}} IN ({{.<T>}},{{.zz}})",
        "<T>,zz,table,table_1,where_col,join_col,join_col_1",
        None,
        None,
    ),
    3: (
        "SELECT {{.select_col}} FROM {{.table}} GROUP BY user_id",
        "table,select_col",
        "SELECT {{.select_col}} FROM {{.table}} GROUP BY {{.group_col}}",
        "table,select_col,group_col",
    ),
    4: (
        "SELECT {{.select_col}}, {{.select_col_2}} FROM {{.table}} ORDER BY {{.order_col}}LIMIT {{.limit_n}}",
        "table,select_col,select_col_2,limit_n,order_col",
        "SELECT {{.select_col}}, {{.select_col_2}} FROM {{.table}} ORDER BY {{.order_col}} LIMIT {{.limit_n}}",
        "table,select_col,select_col_2,limit_n,order_col",
    ),
    5: ("", "", None, None),
    6: ("SELECT * FROM {{.table}}", "table", None, None),
    7: _EV0,
    9: (
        "UPDATE {{.table}} SET event_type = {{.archived}} WHERE value < {{.threshold}}",
        "archived,threshold,table",
        "UPDATE {{.table}} SET event_type = {{.archived}} WHERE {{.where_col}} < {{.threshold}}",
        "archived,threshold,table,where_col",
    ),
}

# compat: (statement, [(name, what, example)]); <p> and <d> are <P> and <D> as names
PAT, LIT, NUM, TAB = "String pattern for LIKE", "String value", "Numeric value", "Table name"
SEL, WHE, JOI, GRO = "Column to select", "Column to filter on", "Column to join on", "Column to group by"
ORD, DIR = "Column to order by", "Sort direction (ASC/DESC)"
LIM, OFF = "Maximum number of rows", "Number of rows to skip"
ORDERS = {
    0: ("SELECT {{.select_col}} FROM {{.table}}", [("table", TAB, "customer"), ("select_col", SEL, "c_name")]),
    1: ("SELECT * FROM {{.table}} WHERE total > {{.threshold}}", [("threshold", NUM, "<A>"), ("table", TAB, "orders")]),
    2: (
        "SELECT c.city, COUNT(*) FROM {{.table}} o JOIN {{.table_1}} c ON o.{{.join_col}} = c.{{.join_col_1}} WHERE c.segment = {{.active}} "
        "AND o.total >= {{.threshold}} GROUP BY c.{{.group_col}} HAVING COUNT(*) > {{.value}} ORDER BY COUNT(*) {{.order_dir}} LIMIT {{.limit_n}}",
        [
            ("active", LIT, "active"), ("threshold", NUM, "<A>"), ("value", NUM, "<N>"), ("table", TAB, "orders"),
            ("table_1", TAB, "customers"), ("join_col", JOI, "cust_id"), ("join_col_1", JOI, "id"),
            ("group_col", GRO, "city"), ("limit_n", LIM, "5"), ("order_dir", DIR, "DESC"),
        ],
    ),
    3: (
        "SELECT {{.select_col}}, {{.select_col_2}} FROM {{.table}} WHERE {{.where_col}} LIKE {{.<p>}} ORDER BY {{.order_col}}LIMIT {{.limit_n}}",
        [
            ("<p>", PAT, "%<P>%"), ("table", TAB, "customer"), ("select_col", SEL, "name"), ("select_col_2", SEL, "age"),
            ("where_col", WHE, "priority"), ("limit_n", LIM, "3"), ("order_col", ORD, "age"),
        ],
    ),
    4: (
        "SELECT COUNT(*) FROM {{.table}} WHERE year = {{.{{.value}}}}",
        [("<Y>", LIT, "<Y>"), ("value", NUM, "<Y>"), ("table", TAB, "sales")],
    ),
    5: (
        "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} IN ({{.<d>}},{{.<d>_1}})",
        [
            ("<d>", LIT, "<D>"), ("<d>_1", LIT, "<D>"), ("table", TAB, "orders"), ("select_col", SEL, "o_key"),
            ("where_col", WHE, "o_date"),
        ],
    ),
    6: (
        "SELECT DISTINCT country FROM {{.table}} WHERE age BETWEEN {{.value}} AND {{.value_1}}",
        [("value", NUM, "<N>"), ("value_1", NUM, "<C>"), ("table", TAB, "customer")],
    ),
    7: (
        "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} NOT IN (SELECT {{.select_col_1}} FROM {{.table_1}})",
        [
            ("table", TAB, "customer"), ("table_1", TAB, "orders"), ("select_col", SEL, "name"),
            ("select_col_1", SEL, "cust_id"), ("where_col", WHE, "cust_id"),
        ],
    ),
    8: (
        "SELECT s.name FROM {{.table}} AS s LEFT JOIN {{.table_1}} AS e ON s.{{.join_col}} = e.{{.join_col_1}} ORDER BY {{.order_col}} {{.order_dir}}",
        [
            ("table", TAB, "customer"), ("table_1", TAB, "orders"), ("join_col", JOI, "id"), ("join_col_1", JOI, "cid"),
            ("order_col", ORD, "s.name"), ("order_dir", DIR, "DESC"),
        ],
    ),
    9: (
        "UPDATE {{.table}} SET status = {{.closed}} WHERE balance <= {{.value}}",
        [("closed", LIT, "closed"), ("value", NUM, "<C>"), ("table", TAB, "accounts")],
    ),
    10: (
        "SELECT {{.select_col}}, {{.select_col_2}}, {{.select_col_3}} FROM {{.table}} LIMIT {{.limit_n}} OFFSET {{.offset_n}}",
        [
            ("table", TAB, "part"), ("select_col", SEL, "a"), ("select_col_2", SEL, "b"), ("select_col_3", SEL, "c"),
            ("limit_n", LIM, "10"), ("offset_n", OFF, "<N>"),
        ],
    ),
    11: ("INSERT INTO {{.table}} (o_key, o_prio) VALUES (<C>, {{.<p>}})", [("<p>", LIT, "<P>"), ("table", TAB, "orders")]),
    12: ("DELETE FROM {{.table}} WHERE o_date < {{.<d>}} AND flag = '<S>'", [("<d>", LIT, "<D>"), ("table", TAB, "orders")]),
    13: ("CREATE TABLE log (id INT AUTO_INCREMENT, ok BOOLEAN, n TINYINT(1))", []),
    14: ("DROP TABLE log", []),
    15: (
        "SELECT status, AVG(total), MAX(total), SUM(total) FROM {{.table}} WHERE {{.where_col}} LIKE {{.x}} "
        "GROUP BY {{.group_col}}, YEAR(o_date), o.{{.group_col_3}} ORDER BY {{.order_col}} {{.order_dir}}",
        [
            ("x", PAT, "x%"), ("table", TAB, "orders"), ("where_col", WHE, "note"), ("group_col", GRO, "status"),
            ("group_col_3", GRO, "kind"), ("order_col", ORD, "status"), ("order_dir", DIR, "ASC"),
        ],
    ),
    16: (
        "SELECT {{.select_col}}, LENGTH(note) FROM {{.table}} WHERE o_date > DATE_ADD(CURDATE(), INTERVAL {{.value}} DAY) AND made < NOW()",
        [("value", NUM, "<N>"), ("table", TAB, "orders"), ("select_col", SEL, "o_key")],
    ),
    17: (
        "WITH t AS (SELECT {{.select_col}} FROM {{.table}}) SELECT {{.select_col_1}} FROM {{.table_1}} RIGHT JOIN {{.table_2}} ON {{.join_col}} = customer.{{.join_col_1}}",
        [
            ("table", TAB, "orders"), ("table_1", TAB, "t"), ("table_2", TAB, "customer"), ("select_col", SEL, "cid"),
            ("select_col_1", SEL, "cid"), ("join_col", JOI, "cid"), ("join_col_1", JOI, "id"),
        ],
    ),
}
KIND = {
    PAT: "literal", LIT: "literal", NUM: "number", TAB: "table", SEL: "column", WHE: "column", JOI: "column",
    GRO: "column", ORD: "column", DIR: "direction", LIM: "paging", OFF: "paging",
}

ORDERS_CLEAN = {
    1: ("SELECT * FROM {{.table}} WHERE {{.where_col}} > {{.threshold}}", "threshold,table,where_col"),
    2: (
        ORDERS[2][0].replace("c.segment =", "c.{{.where_col}} ="),
        "active,threshold,value,table,table_1,where_col,join_col,join_col_1,group_col,limit_n,order_dir",
    ),
    3: (
        "SELECT {{.select_col}}, {{.select_col_2}} FROM {{.table}} WHERE {{.where_col}} LIKE {{.v_<p>}} ORDER BY {{.order_col}} LIMIT {{.limit_n}}",
        "v_<p>,table,select_col,select_col_2,where_col,limit_n,order_col",
    ),
    4: ("SELECT COUNT(*) FROM {{.table}} WHERE {{.where_col}} = {{.v_<Y>}}", "v_<Y>,table,where_col"),
    5: (
        "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} IN ({{.v_<d>}},{{.v_<d>_1}})",
        "v_<d>,v_<d>_1,table,select_col,where_col",
    ),
    9: ("UPDATE {{.table}} SET status = {{.closed}} WHERE {{.where_col}} <= {{.value}}", "closed,value,table,where_col"),
    11: ("INSERT INTO {{.table}} (o_key, o_prio) VALUES (<C>, {{.v_<p>}})", "v_<p>,table"),
    12: ("DELETE FROM {{.table}} WHERE {{.where_col}} < {{.v_<d>}} AND flag = '<S>'", "v_<d>,table,where_col"),
    16: (
        "SELECT {{.select_col}}, LENGTH(note) FROM {{.table}} WHERE {{.where_col}} > DATE_ADD(CURDATE(), INTERVAL {{.value}} DAY) AND made < NOW()",
        "value,table,select_col,where_col",
    ),
}

# Single passes over the order statements: edits of the statement, and names.
PASSES = {
    "template_strings": {
        2: ("active", "'active'", "{{.active}}"),
        3: ("<p>", "'%<P>%'", "{{.<p>}}"),
        4: ("<Y>", "'<Y>'", "{{.<Y>}}"),
        5: ("<d>,<d>_1", "('<D>','<D>')", "({{.<d>}},{{.<d>_1}})"),
        9: ("closed", "'closed'", "{{.closed}}"),
        11: ("<p>", "'<P>'", "{{.<p>}}"),
        12: ("<d>", "'<D>'", "{{.<d>}}"),
        15: ("x", "'x%'", "{{.x}}"),
    },
    "template_numbers": {
        1: ("threshold", "> <A>", "> {{.threshold}}"),
        2: ("threshold,value", ">= <A>", ">= {{.threshold}}", "> <N>", "> {{.value}}"),
        3: ("value", "<P>", "{{.value}}<P2>"),
        4: ("value", "<Y>", "{{.value}}"),
        5: (
            "value,value_1,value_2,value_3,value_4,value_5",
            "('<D>','<D>')",
            "('{{.value}}-{{.value_1}}-{{.value_2}}','{{.value_3}}-{{.value_4}}-{{.value_5}}')",
        ),
        6: ("value,value_1", "<N> AND <C>", "{{.value}} AND {{.value_1}}"),
        9: ("value", "<C>", "{{.value}}"),
        12: ("value,value_1,value_2", "<D>", "{{.value}}-{{.value_1}}-{{.value_2}}"),
        16: ("value", "<N>", "{{.value}}"),
    },
    "template_tables": {
        0: ("table", "FROM customer", "FROM {{.table}}"),
        1: ("table", "FROM orders", "FROM {{.table}}"),
        2: ("table,table_1", "FROM orders", "FROM {{.table}}", "JOIN customers", "JOIN {{.table_1}}"),
        3: ("table", "FROM customer", "FROM {{.table}}"),
        4: ("table", "FROM sales", "FROM {{.table}}"),
        5: ("table", "FROM orders", "FROM {{.table}}"),
        6: ("table", "FROM customer", "FROM {{.table}}"),
        7: ("table,table_1", "FROM customer", "FROM {{.table}}", "FROM orders", "FROM {{.table_1}}"),
        8: ("table,table_1", "FROM customer", "FROM {{.table}}", "JOIN orders", "JOIN {{.table_1}}"),
        9: ("table", "UPDATE accounts", "UPDATE {{.table}}"),
        10: ("table", "FROM part", "FROM {{.table}}"),
        11: ("table", "INTO orders", "INTO {{.table}}"),
        12: ("table", "FROM orders", "FROM {{.table}}"),
        15: ("table", "FROM orders", "FROM {{.table}}"),
        16: ("table", "FROM orders", "FROM {{.table}}"),
        17: (
            "table,table_1,table_2",
            "FROM orders", "FROM {{.table}}", "FROM t", "FROM {{.table_1}}", "JOIN customer", "JOIN {{.table_2}}",
        ),
    },
    "template_select": {
        0: ("select_col", "c_name", "{{.select_col}}"),
        3: ("select_col,select_col_2", "name, age", "{{.select_col}}, {{.select_col_2}}"),
        5: ("select_col", "o_key", "{{.select_col}}"),
        7: ("select_col,select_col_1", "SELECT name", "SELECT {{.select_col}}", "SELECT cust_id", "SELECT {{.select_col_1}}"),
        10: ("select_col,select_col_2,select_col_3", "a, b, c", "{{.select_col}}, {{.select_col_2}}, {{.select_col_3}}"),
        16: ("select_col", "o_key", "{{.select_col}}"),
        17: ("select_col,select_col_1", "(SELECT cid", "(SELECT {{.select_col}}", ") SELECT cid", ") SELECT {{.select_col_1}}"),
    },
    "template_where": {
        3: ("where_col", "WHERE priority", "WHERE {{.where_col}}"),
        5: ("where_col", "WHERE o_date", "WHERE {{.where_col}}"),
        7: ("where_col", "WHERE cust_id", "WHERE {{.where_col}}"),
        15: ("where_col", "WHERE note", "WHERE {{.where_col}}"),
    },
    "template_join": {
        2: ("join_col,join_col_1", "o.cust_id = c.id", "o.{{.join_col}} = c.{{.join_col_1}}"),
        8: ("join_col,join_col_1", "s.id=e.cid", "s.{{.join_col}} = e.{{.join_col_1}}"),
        17: ("join_col,join_col_1", "ON cid = customer.id", "ON {{.join_col}} = customer.{{.join_col_1}}"),
    },
    "template_group": {
        2: ("group_col", "BY c.city", "BY c.{{.group_col}}"),
        15: ("group_col,group_col_3", "status, YEAR(o_date), o.kind", "{{.group_col}}, YEAR(o_date), o.{{.group_col_3}}"),
    },
    "template_paging": {
        2: ("limit_n", "LIMIT 5", "LIMIT {{.limit_n}}"),
        3: ("limit_n", "LIMIT 3", "LIMIT {{.limit_n}}"),
        10: ("limit_n,offset_n", "LIMIT 10 OFFSET <N>", "LIMIT {{.limit_n}} OFFSET {{.offset_n}}"),
    },
    "template_order": {
        2: ("order_dir", "COUNT(*) DESC", "COUNT(*) {{.order_dir}}"),
        3: ("order_col", "BY age ", "BY {{.order_col}}"),
        8: ("order_col,order_dir", "BY s.name DESC", "BY {{.order_col}} {{.order_dir}}"),
        15: ("order_col,order_dir", "BY status ASC", "BY {{.order_col}} {{.order_dir}}"),
    },
}


# --- building blocks --------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(texts: dict[int, str], default: str = "''") -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {q(t)}" for k, t in texts.items()) + f" ELSE {default} END"


def filled(expr: str, values: dict[str, str]) -> str:
    for mark, column in values.items():
        expr = f"replace({expr}, '{mark}', {column})"
    return expr


_EV_VALUES = {"<T>": "t", "<V>": "v", "<N>": "n"}
_OR_VALUES = {
    "<P>": "p", "<P2>": "substr(p, 2)", "<A>": "a", "<D>": "d", "<Y>": "substr(d, 1, 4)", "<C>": "c", "<S>": "s", "<N>": "n",
    "<p>": "lower(replace(replace(p, '-', '_'), ' ', '_'))", "<d>": "replace(d, '-', '_')",
}


def _first(fields: dict[str, str], names: list[str], default: str = "") -> str:
    return next((fields[n] for n in names if fields.get(n)), default)


def _ev(texts: dict[int, str]) -> str:
    return filled(case(texts), _EV_VALUES)


def _or(texts: dict[int, str], default: str = "''") -> str:
    return filled(case(texts, default), _OR_VALUES)


_QF = ["question", "prompt", "nl", "instruction"]
_SF = ["sql", "query", "gold_sql", "gold", "pred_sql"]
_DF = ["db_id", "db", "schema"]


def _shape_texts(shapes, names: list[str], default: str = "") -> dict[int, str]:
    return {k: _first(s.fields, names, default) for k, s in enumerate(shapes)}


EV_BASE = (
    "ev0 AS (SELECT event_id AS ord, event_id % 10 AS k, event_type AS t, ts, "
    "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS v, CAST(event_id % 90 + 10 AS VARCHAR) AS n FROM events), "
    f"ev AS (SELECT *, {_ev(_shape_texts(EVENT_SHAPES, _QF))} AS question, {_ev(_shape_texts(EVENT_SHAPES, _SF))} AS sql, "
    f"{_ev(_shape_texts(EVENT_SHAPES, _DF))} AS db_id, {_ev(_shape_texts(EVENT_SHAPES, ['source', 'origin'], 'unknown'))} AS source, "
    f"{_ev({k: e[0] for k, e in EVENTS.items()})} AS st, {_ev({k: e[1] for k, e in EVENTS.items()})} AS names, "
    f"{_ev({k: e[0] if e[2] is None else e[2] for k, e in EVENTS.items()})} AS st_clean, "
    f"{_ev({k: e[1] if e[3] is None else e[3] for k, e in EVENTS.items()})} AS names_clean FROM ev0 WHERE k <> 8)"
)

_OR_CLEAN = {k: ORDERS_CLEAN.get(k, (e[0], ",".join(n for n, _, _ in e[1]))) for k, e in ORDERS.items()}
OR_BASE = (
    f"or0 AS (SELECT o_orderkey AS ord, o_orderkey % {len(ORDER_SHAPES)} AS k, o_orderpriority AS p, o_orderstatus AS s, "
    "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS a, strftime(o_orderdate, '%Y-%m-%d') AS d, "
    "CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS n, lower(c_mktsegment) AS db_id, 'orders' AS source "
    "FROM orders LEFT JOIN customer ON c_custkey = o_custkey), "
    f"od AS (SELECT *, {_or(_shape_texts(ORDER_SHAPES, ['question']))} AS question, {_or(_shape_texts(ORDER_SHAPES, ['sql']))} AS sql, "
    f"{_or({k: e[0] for k, e in ORDERS.items()})} AS st, "
    f"{_or({k: ','.join(n for n, _, _ in e[1]) for k, e in ORDERS.items()})} AS names, "
    f"{_or({k: e[0] for k, e in _OR_CLEAN.items()})} AS st_clean, {_or({k: e[1] for k, e in _OR_CLEAN.items()})} AS names_clean FROM or0)"
)


def times(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def pts(test: str, n: int) -> str:
    return f"(CASE WHEN {test} THEN {n} ELSE 0 END)"


def blanked(st: str) -> str:
    return f"regexp_replace({st}, '\\{{\\{{\\.[^}}]*\\}}\\}}', '{{{{}}}}', 'g')"


def name_list(names: str) -> str:
    return f"(CASE WHEN {names} = '' THEN []::VARCHAR[] ELSE string_split({names}, ',') END)"


def parameters_sql(names: str) -> str:
    nn = name_list(names)
    cat = (
        "CASE WHEN contains(x, 'table') THEN 1 WHEN contains(x, 'col') THEN 2 WHEN contains(x, 'value') OR contains(x, 'threshold') THEN 3 "
        "WHEN contains(x, 'limit') OR contains(x, 'offset') THEN 4 WHEN contains(x, 'order') OR contains(x, 'sort') THEN 5 "
        "WHEN contains(x, 'where') OR contains(x, 'filter') OR contains(x, 'join') OR contains(x, 'group') THEN 6 ELSE 0 END"
    )
    cats = f"len(list_distinct(list_filter(list_transform({nn}, lambda x: {cat}), lambda y: y > 0)))"
    return (
        f"CAST((CASE WHEN len({nn}) >= 5 THEN 15 WHEN len({nn}) >= 3 THEN 10 WHEN len({nn}) >= 1 THEN 5 ELSE 0 END) "
        f"+ least(3 * {cats}, 15) + (CASE WHEN len({nn}) > 0 THEN 5 ELSE 0 END) AS DOUBLE)"
    )


def complexity_sql(st: str) -> str:
    u = f"upper({st})"
    return (
        f"CAST(least({pts(any_of(u, ['SELECT']), 5)} + (CASE WHEN contains({u}, 'JOIN') THEN 8 + 2 * least({times(u, 'JOIN')} - 1, 2) ELSE 0 END) "
        f"+ {pts(any_of(u, ['GROUP BY']), 7)} + {pts(any_of(u, ['COUNT(', 'SUM(', 'AVG(', 'MAX(', 'MIN(']), 5)} + {pts(any_of(u, ['WHERE']), 2)} "
        f"+ {pts(any_of(u, ['HAVING']), 3)} + {pts(times(st, 'SELECT') + ' > 1', 5)} + {pts(any_of(u, ['DISTINCT']), 2)}, 30) AS DOUBLE)"
    )


_USEFUL = ["how many", "what", "which", "list", "show", "return", "find", "calculate", "count", "average", "maximum", "minimum", "total"]


def description_sql(question: str) -> str:
    hits = " + ".join(pts(f"contains(lower({question}), '{w}')", 1) for w in _USEFUL)
    return (
        f"CAST(CASE WHEN {question} = '' THEN 0 ELSE least((CASE WHEN length({question}) >= 100 THEN 10 WHEN length({question}) >= 50 THEN 7 "
        f"WHEN length({question}) >= 20 THEN 4 ELSE 2 END) + least(2 * ({hits}), 10), 20) END AS DOUBLE)"
    )


def reusability_sql(st: str) -> str:
    bare = f"regexp_replace({st}, '\\{{\\{{\\.\\w+\\}}\\}}', '', 'g')"
    return (
        f"CAST(10 - {pts(f"regexp_matches({st}, '''[^'']{{2,}}''')", 3)} - {pts(f"regexp_matches({bare}, '\\b\\d{{2,}}\\b')", 2)} "
        f"- {pts(f"NOT contains({st}, '{{{{.table') AND regexp_matches({st}, '\\bFROM\\s+[a-zA-Z_]\\w+')", 2)} AS DOUBLE)"
    )


def scores(st: str, names: str, clean: bool) -> str:
    """The four partial scores as columns."""
    return (
        f"{parameters_sql(names)} AS parameters, {complexity_sql(blanked(st) if clean else st)} AS complexity, "
        f"{description_sql('question')} AS description, {reusability_sql(st)} AS reusability"
    )


def scored(base: str, clean: bool) -> str:
    """CTE ``sc``: base rows with ``tpl``, ``nam``, partial scores and their sum."""
    sfx = "_clean" if clean else ""
    return (
        f"sc0 AS (SELECT *, st{sfx} AS tpl, names{sfx} AS nam, {scores('st' + sfx, 'names' + sfx, clean)} FROM {base}), "
        "sc AS (SELECT *, parameters + complexity + description + reusability AS raw_score FROM sc0)"
    )


def statused(base: str, clean: bool, low: float = 50, high: float = 100, least: int = 1) -> str:
    """CTE ``vs``: scored rows with reason, score and status."""
    simple = "k = 6" if clean and base == "ev" else "FALSE"  # the one bare SELECT *
    low_text = (
        "printf('Quality score too low: %.1f/100 (parameters=%.1f, complexity=%.1f, description=%.1f, reusability=%.1f)', "
        "raw_score, parameters, complexity, description, reusability)"
    )
    return (
        scored(base, clean) + ", er AS (SELECT *, CASE WHEN sql = '' THEN 'Empty SQL' WHEN nam = '' THEN 'No parameters - not reusable' "
        f"WHEN {simple} THEN 'Too simple - just SELECT * FROM table' WHEN length(question) < 5 THEN 'No meaningful description' END AS early FROM sc), "
        f"rs AS (SELECT *, CASE WHEN early IS NULL THEN raw_score ELSE 0 END AS score, "
        f"coalesce(early, CASE WHEN raw_score < {low} THEN {low_text} END, '') AS reason FROM er), "
        f"vs AS (SELECT *, CASE WHEN sql = '' THEN 'empty_sql' WHEN len({name_list('nam')}) < {least} THEN 'low_score' "
        "WHEN starts_with(reason, 'Quality score too low') THEN 'low_score' WHEN reason <> '' THEN 'quality_issues' "
        f"WHEN score > {high} THEN 'high_score' ELSE 'success' END AS status FROM rs)"
    )


def labels_sql(sql: str) -> str:
    u = f"upper({sql})"
    ops = " ".join(f"WHEN starts_with(trim({u}), '{w.upper()}') THEN '{w}'" for w in ["select", "insert", "update", "delete", "create", "alter", "drop"])
    tests = [
        (f"contains({u}, 'JOIN')", "join"), (f"contains({u}, 'LEFT JOIN')", "left_join"), (f"contains({u}, 'RIGHT JOIN')", "right_join"),
        (f"regexp_matches({u}, '\\bCOUNT\\s*\\(')", "count"), (f"regexp_matches({u}, '\\bSUM\\s*\\(')", "sum"),
        (f"regexp_matches({u}, '\\bAVG\\s*\\(')", "avg"), (f"regexp_matches({u}, '\\b(MAX|MIN)\\s*\\(')", "minmax"),
        (f"contains({u}, 'GROUP BY')", "grouped"), (f"contains({u}, 'ORDER BY')", "sorted"), (f"contains({u}, 'HAVING')", "having"),
        (f"contains({u}, 'WHERE')", "filtered"), (f"contains({u}, 'DISTINCT')", "distinct"), (f"contains({u}, 'LIMIT')", "limited"),
        (f"contains({u}, 'OFFSET')", "offset"), (f"{times(u, 'SELECT')} > 1", "subquery"),
    ]
    return f"concat_ws(', ', CASE {ops} END, " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + ")"


def name_sql(st: str, clean: bool) -> str:
    def rx(p: str) -> str:
        return f"regexp_matches({st}, '(?i)\\b{p}')"

    ops = " ".join(f"WHEN starts_with(upper({st}), '{w.upper()}') THEN '{w}'" for w in ["select", "insert", "update", "delete", "create", "alter", "drop"])
    join, left, right = rx("JOIN\\b"), rx("LEFT\\s+JOIN\\b"), rx("RIGHT\\s+JOIN\\b")
    joins = [(f"{join} AND NOT {left} AND NOT {right}", "joined"), (left, "left_joined"), (f"{right} AND NOT {left}", "right_joined")] if clean else [(join, "joined")]
    features = [
        (rx("COUNT\\s*\\("), "count"), (f"{rx('SUM\\s*\\(')} AND NOT {rx('COUNT\\s*\\(')}", "sum"),
        (f"{rx('(AVG|MAX|MIN)\\s*\\(')} AND NOT {rx('(COUNT|SUM)\\s*\\(')}", "aggregate"), (rx("GROUP\\s+BY\\b"), "grouped"), *joins,
        (rx("WHERE\\b"), "filtered"), (rx("ORDER\\s+BY\\b"), "sorted"), (rx("LIMIT\\b"), "limited"), (rx("DISTINCT\\b"), "distinct"),
        (rx("HAVING\\b"), "having"), (rx("OFFSET\\b"), "offset"),
    ]
    listed = "[" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in features) + "]"
    top = f"list_slice(list_filter({listed}, lambda x: x IS NOT NULL), 1, 3)"
    return f"concat_ws('_', CASE {ops} ELSE 'query' END, nullif(array_to_string({top}, '_'), ''))"


def key_sql(digits: int) -> str:
    return f"tool_name || '_' || substr(sha1(sql || question), 1, {digits})"


def id_sql() -> str:
    return "sha1(tool_name || chr(0) || sql || chr(0) || question)"


def sentence_sql(st: str, names: str) -> str:
    u = f"upper({st})"
    agg = (
        f"CASE WHEN contains({u}, 'COUNT(') THEN 'counts records' WHEN contains({u}, 'SUM(') THEN 'calculates sum' "
        f"WHEN contains({u}, 'AVG(') THEN 'calculates average' WHEN {any_of(u, ['MAX(', 'MIN('])} THEN 'finds extremes' END"
    )
    more = ", ".join(
        f"CASE WHEN contains({u}, '{w}') THEN '{t}' END"
        for w, t in [
            ("JOIN", "by joining multiple tables"), ("GROUP BY", "grouped by criteria"), ("WHERE", "with filtering conditions"),
            ("ORDER BY", "sorted by specified column"), ("LIMIT", "limited to top results"),
        ]
    )
    structure = f"CASE WHEN contains({u}, 'SELECT') THEN concat_ws(' ', 'Retrieves data', {agg}, {more}) END"
    nn = name_list(names)

    def n_of(test: str, words: str) -> str:
        n = f"len(list_filter({nn}, lambda x: {test}))"
        return f"CASE WHEN {n} > 0 THEN '{words} (' || {n} || ')' END"

    table, column = "contains(x, 'table')", "contains(x, 'col')"
    params = (
        "concat_ws(', ', " + n_of(table, "customizable tables") + ", " + n_of(column, "flexible column selection") + ", "
        + n_of("x IN ('value', 'threshold', 'limit_n', 'offset_n')", "adjustable filters and limits") + ", "
        + n_of(f"NOT {table} AND NOT {column}", "string pattern matching") + ")"
    )
    said = f"substr(concat_ws('. ', {structure}, 'Parameters: ' || nullif({params}, '')), 1, 500)"
    lab = labels_sql("sql")
    return f"{said} || CASE WHEN {lab} = '' THEN '' ELSE ' [Labels: ' || {lab} || ']' END"


def dialect_sql(st: str, dialect: str) -> str:
    """Placeholders by name; every other rewrite is stated per shape."""
    if dialect in ("mysql", "sqlite"):
        out = f"regexp_replace({st}, '\\{{\\{{\\.\\w+\\}}\\}}', '?', 'g')"
    elif dialect == "sql_server":
        out = f"regexp_replace({st}, '\\{{\\{{\\.(\\w+)\\}}\\}}', '@\\1', 'g')"
    else:  # numbered already
        out = st
    edits = {
        "mysql": [],
        "postgres": [("CURDATE()", "CURRENT_DATE"), (" AUTO_INCREMENT", " SERIAL")],
        "sqlite": [("NOW()", "datetime('now')"), ("CURDATE()", "date('now')"), ("BOOLEAN", "INTEGER"), ("AUTO_INCREMENT", "AUTOINCREMENT")],
        "sql_server": [
            ("NOW()", "GETDATE()"), ("CURDATE()", "CAST(GETDATE() AS DATE)"), ("LENGTH(", "LEN("), ("BOOLEAN", "BIT"),
            ("AUTO_INCREMENT", "IDENTITY(1,1)"), ("TINYINT(1)", "TINYINT"),
        ],
    }
    for old, new in edits[dialect]:
        out = f"replace({out}, {q(old)}, {q(new)})"
    return out


def numbered_texts(texts: dict[int, str]) -> dict[int, str]:
    """Per shape: placeholders numbered by first use."""
    import re

    out = {}
    for k, text in texts.items():
        for i, name in enumerate(dict.fromkeys(re.findall(r"\{\{\.([\w<>]+)\}\}", text)), 1):
            text = text.replace("{{." + name + "}}", f"${i}")
        out[k] = text
    return out


def fan_out_sql(clean: bool) -> str:
    col, texts = ("st_clean", {k: e[0] for k, e in _OR_CLEAN.items()}) if clean else ("st", {k: e[0] for k, e in ORDERS.items()})
    postgres = dialect_sql(_or(numbered_texts(texts)), "postgres")
    server = dialect_sql(col, "sql_server")
    if clean:
        server = f"replace(replace({server}, 'LIMIT @limit_n OFFSET @offset_n', 'OFFSET @offset_n ROWS FETCH NEXT @limit_n ROWS ONLY'), 'LIMIT @limit_n', 'OFFSET 0 ROWS FETCH NEXT @limit_n ROWS ONLY')"
    parts = {"mysql": dialect_sql(col, "mysql"), "sqlite": dialect_sql(col, "sqlite"), "postgres": postgres, "sql_server": server}
    return "WITH " + OR_BASE + " " + " UNION ALL ".join(f"SELECT ord, '{d}' AS dialect, {e} AS statement FROM od" for d, e in parts.items())


def plain_dialects_sql() -> str:
    """Literal paging: the second OFFSET that is left over, and its cut digits, are part of the expectation."""
    server = dialect_sql("sql", "sql_server")
    server = (
        f"CASE k WHEN 10 THEN 'SELECT a, b, c FROM part OFFSET ' || substr(n, 1, 1) || ' ROWS' || substr(n, 2) || "
        f"' ROWS FETCH NEXT 10 ROWS ONLY OFFSET ' || n || ' ROWS' "
        f"WHEN 16 THEN 'SELECT o_key, LEN(note) FROM orders WHERE o_date > DATEADD(day, ' || n || ', CAST(GETDATE() AS DATE)) AND made < GETDATE()' "
        f"ELSE replace(replace({server}, 'LIMIT 5', 'OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY'), 'LIMIT 3', 'OFFSET 0 ROWS FETCH NEXT 3 ROWS ONLY') END"
    )
    lite = "CASE k WHEN 16 THEN 'SELECT o_key, LENGTH(note) FROM orders WHERE o_date > date(date(''now''), ''+\\2 days'') AND made < datetime(''now'')' ELSE " + dialect_sql("sql", "sqlite") + " END"
    parts = {"mysql": "sql", "sqlite": lite, "postgres": dialect_sql("sql", "postgres"), "sql_server": server}
    return "WITH " + OR_BASE + " " + " UNION ALL ".join(f"SELECT ord, '{d}' AS dialect, {e} AS statement FROM od" for d, e in parts.items())


def pass_sql(name: str) -> str:
    texts, names = {}, {}
    for k, shape in enumerate(ORDER_SHAPES):
        text = shape.fields["sql"]
        got, *edits = PASSES[name].get(k, ("",))
        for old, new in zip(edits[::2], edits[1::2]):
            assert old in text, (name, k, old)
            text = text.replace(old, new, 1)
        texts[k], names[k] = text, got
    return f"WITH {OR_BASE} SELECT ord, {_or(texts)} AS statement, {_or(names)} AS params FROM od"


def params_sql() -> str:
    rows = [
        f"SELECT {k} AS k, {i} AS pos, {q(n)} AS name, {q(w)} AS what, {q(x)} AS example, {q(KIND[w])} AS kind"
        for k, (_, params) in ORDERS.items()
        for i, (n, w, x) in enumerate(params)
    ]
    f_name, f_example = filled("x.name", _OR_VALUES), filled("x.example", _OR_VALUES)
    return (
        f"WITH {OR_BASE}, x AS ({' UNION ALL '.join(rows)}) SELECT ord, pos, {f_name} AS name, 'string' AS type, "
        f"what || ' (e.g., ' || {f_example} || ')' AS description, kind, {f_example} AS example FROM od JOIN x USING (k)"
    )


def pairs_sql() -> str:
    """Per order: name=description pairs of all parameters."""
    return _or({k: "; ".join(f"{n}={w} (e.g., {x})" for n, w, x in p) for k, (_, p) in ORDERS.items()})


def viewer_cte(st: str, names: str, clean: bool = False, where: str = "TRUE") -> str:
    labelled = blanked("st") if clean else "st"
    return (
        f"vw0 AS (SELECT ord, k, question, {st} AS st, {names} AS names, db_id, source FROM od), "
        f"vw1 AS (SELECT *, {scores('st', 'names', clean)} FROM vw0), "
        f"vw2 AS (SELECT *, parameters + complexity + description + reusability AS quality_score, {labels_sql(labelled)} AS labels FROM vw1), "
        f"vw AS (SELECT *, 'sql_tool_' || row_number() OVER (ORDER BY ord) AS tool_key FROM vw2 WHERE {where})"
    )


def cutoff(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


_PREVIEW = (
    f"tool_key, {cutoff('question', 80)} AS description, {cutoff('st', 100)} AS sql, "
    f"CASE WHEN names = '' THEN 'No params' ELSE len(string_split(names, ',')) || ' param(s)' END AS parameters, "
    f"printf('%.1f', quality_score) AS quality_score, {cutoff('labels', 50)} AS labels"
)

def search_sql(text: str) -> str:
    """Preview rows with the text in any of the six columns: four whole, parameters and score as shown."""
    whole = ["v.tool_key", "v.question", "v.st", "v.labels", "p.parameters", "p.quality_score"]
    hit = " OR ".join(f"contains(lower({c}), {q(text)})" for c in whole)
    return f"WITH {OR_BASE}, {viewer_cte('st', 'names')}, pv AS (SELECT {_PREVIEW} FROM vw) SELECT p.* FROM pv p JOIN vw v USING (tool_key) WHERE {hit}"


_WORDS = ["SELECT", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "HAVING", "UNION", "WITH"]


def profile_sql(base: str, text: str) -> str:
    def col(w: str) -> str:
        return "n_" + w.lower().replace(" ", "_")

    counts = ", ".join(f"count(*) FILTER (contains(upper({text}), '{w}')) AS {col(w)}" for w in _WORDS)
    features = " + ".join(pts(f"{col(w)} > total_records * 0.1", 1) for w in _WORDS)
    pct = ", ".join(f"{col(w)} * 100 // total_records AS {col(w).replace('n_', 'pct_')}" for w in ["WHERE", "JOIN", "GROUP BY", "ORDER BY"])
    return (
        f"WITH {base}, c AS (SELECT count(*) AS total_records, count(*) FILTER ({text} <> '') AS valid_sql, sum(length({text})) AS chars, {counts} "
        f"FROM {'ev' if 'ev AS' in base else 'od'}), i AS (SELECT *, least(100.0, 15 * ({features}) + valid_sql * CAST(100 AS DOUBLE) / total_records)::DOUBLE AS indicator FROM c) "
        f"SELECT total_records, valid_sql, CAST(chars // valid_sql AS BIGINT) AS avg_sql_length, {', '.join(col(w) for w in _WORDS)}, {pct}, indicator, "
        "CASE WHEN indicator > 70 THEN 'High' WHEN indicator > 40 THEN 'Medium' ELSE 'Low' END AS level FROM i"
    )


def statistics_sql(clean: bool, **limits) -> str:
    names = ["success", "empty_sql", "quality_issues", "low_score", "high_score", "error"]
    counts = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in names)
    return (
        f"WITH {EV_BASE}, {statused('ev', clean, **limits)} SELECT {counts}, count(*) AS total, "
        "CASE WHEN count(*) FILTER (status = 'success') > 0 THEN count(*) FILTER (status = 'success') * CAST(100 AS DOUBLE) / count(*) END AS acceptance_rate, "
        "CASE WHEN count(*) FILTER (status = 'success') > 0 THEN sum(CASE WHEN status = 'success' THEN score END) / count(*) FILTER (status = 'success') END AS average_quality FROM vs"
    )


# --- field detection ---------------------------------------------------------------

_SQLW = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "WITH", "FROM", "WHERE", "JOIN", "GROUP", "ORDER", "HAVING", "UNION"]
_SQLO = ["COUNT", "SUM", "AVG", "MAX", "MIN", "DISTINCT", "AS", "ON", "IN", "LIKE"]
_QW = ["what", "how", "which", "who", "when", "where", "why", "can", "could", "should", "would"]
_IW = ["list", "show", "tell", "find", "get", "give", "display", "return", "retrieve", "fetch", "extract"]


def field_points(name: str, value: str) -> tuple[str, str]:
    u, low = f"upper({value})", f"lower({value})"
    kw = "(" + " + ".join(pts(f"contains({u}, '{w}')", 1) for w in _SQLW) + ")"
    op = "(" + " + ".join(pts(f"contains({u}, '{w}')", 1) for w in _SQLO) + ")"
    sql = (
        f"{pts(any_of(name, ['sql']), 20)} + 3 * {kw} + (CASE WHEN {kw} >= 3 THEN 15 WHEN {kw} = 2 THEN 8 ELSE 0 END) + 2 * {op} "
        f"+ {pts(f"contains({u}, 'FROM') AND contains({u}, 'SELECT')", 10)} + {pts(any_of(u, ['JOIN']), 5)} + {pts(any_of(u, ['WHERE']), 5)} "
        f"+ {pts(any_of(u, ['GROUP BY', 'ORDER BY']), 5)} + {pts(f"(contains({name}, 'query') AND NOT contains({name}, 'sql')) OR contains({name}, 'statement')", 8)} "
        f"+ {pts(any_of(u, ['TABLE', 'COLUMN', 'INDEX', 'VIEW']), 5)}"
    )
    qw = "(" + " + ".join(pts(f"contains({low}, '{w}')", 1) for w in _QW) + ")"
    iw = "(" + " + ".join(pts(f"contains({low}, '{w}')", 1) for w in _IW) + ")"
    opens = " OR ".join(f"starts_with(ltrim({low}), '{w}')" for w in ["what", "how", "which", "who", "when", "where", "why"])
    by_name = (
        f"CASE WHEN contains({name}, 'question') THEN 15 WHEN contains({name}, 'prompt') THEN 12 WHEN contains({name}, 'instruction') THEN 12 "
        f"WHEN contains({name}, 'text') THEN 5 WHEN {any_of(name, ['nl', 'natural'])} THEN 8 WHEN {any_of(name, ['user', 'input', 'query', 'request'])} THEN 6 ELSE 0 END"
    )
    question = (
        f"greatest(0, {pts(f"contains({value}, '?')", 20)} + 3 * {qw} + (CASE WHEN {qw} >= 2 THEN 10 WHEN {qw} = 1 THEN 5 ELSE 0 END) + 2 * {iw} "
        f"+ {pts(f'{iw} >= 2', 8)} + {pts(opens, 10)} + {pts(f"contains({low}, ' please ') OR contains(trim({low}), 'please ')", 5)} "
        f"+ {pts(any_of(low, ['i want', 'i need', 'give me', 'show me']), 5)} + {by_name} "
        f"- {pts(any_of(u, ['SELECT', 'FROM', 'WHERE', 'JOIN']), 10)} - {pts(any_of(u, ['CREATE TABLE', 'INSERT INTO']), 10)})"
    )
    return sql, question


def raw_fields_cte() -> str:
    """CTE ``cell``: one row per event record and raw field."""
    names = list(dict.fromkeys(f for s in EVENT_SHAPES for f in s.fields))
    parts = []
    for i, f in enumerate(names):
        texts = {k: s.fields[f] for k, s in enumerate(EVENT_SHAPES) if f in s.fields}
        parts.append(f"SELECT ord, '{f}' AS field, {i} AS pos, {_ev(texts)} AS value FROM ev0 WHERE k IN ({', '.join(map(str, texts))})")
    return "cell AS (" + " UNION ALL ".join(parts) + ")"


def field_table_sql(where: str = "TRUE") -> str:
    s, qn = field_points("field", "value")
    return (
        f"ft AS (SELECT field, pos, count(*) AS records, CAST(sum({s}) AS BIGINT) AS sql_score, CAST(sum({qn}) AS BIGINT) AS question_score "
        f"FROM cell WHERE {where} GROUP BY field, pos)"
    )


def best_sql(cte: str) -> str:
    return (
        f"(SELECT field FROM {cte} WHERE sql_score > 0 ORDER BY sql_score / records DESC, pos LIMIT 1) AS sql_field, "
        f"(SELECT field FROM {cte} WHERE question_score > 0 ORDER BY question_score / records DESC, pos LIMIT 1) AS question_field"
    )


def detection_sql() -> str:
    s, qn = field_points("field", "value")
    return (
        f"WITH {EV_BASE}, {raw_fields_cte()}, {field_table_sql()}, f1 AS (SELECT field, pos, 1 AS records, {s} AS sql_score, {qn} AS question_score FROM cell WHERE ord = 0), "
        "talk AS (SELECT 'role' AS field, 0 AS pos, role AS value FROM conversations UNION ALL SELECT 'text', 1, text FROM conversations), "
        f"f2 AS (SELECT field, pos, count(*) AS records, sum({s}) AS sql_score, sum({qn}) AS question_score FROM talk GROUP BY field, pos) "
        f"SELECT 'events' AS corpus, {best_sql('ft')} UNION ALL SELECT 'first_event', {best_sql('f1')} UNION ALL SELECT 'conversations', {best_sql('f2')}"
    )


def chosen_sql(q_names: list[str], s_names: list[str], d_names: list[str]) -> str:
    """Imported event records with the given field precedence; incomplete ones left out."""
    qs, ss, ds = (_shape_texts(EVENT_SHAPES, n) for n in (q_names, s_names, d_names))
    keep = [k for k in range(len(EVENT_SHAPES)) if qs[k] and ss[k]]
    ks = ", ".join(map(str, keep)) or "-1"
    return (
        f"WITH {EV_BASE} SELECT ord, {_ev(qs)} AS question, {_ev(ss)} AS sql, {_ev(ds)} AS db_id, 'huggingface' AS source FROM ev0 WHERE k IN ({ks})"
    )


def odd_sql(clean: bool) -> str:
    """Per kind of line: status, question, statement."""
    simple = "SELECT a FROM t"
    rows = {
        0: ("low_score", "How many are there of <C>?", "SELECT a FROM t WHERE b = <C>"),
        1: ("low_score", "<C>1", simple) if clean else ("error", "<C>1", simple),
        2: ("error", "", ""),
        3: ("error", "", ""),
        4: ("rejected", "", ""),
        5: ("low_score", "last <C>", simple),
        6: ("low_score", "prompt <C>", "SELECT a FROM t LIMIT <C>"),
        7: ("low_score", "nl <C>", "SELECT b FROM t"),
        8: ("rejected", "", ""),
        9: ("low_score", "object <C>", '{"x":1}') if clean else ("error", "object <C>", '{"x":1}'),
        10: ("low_score", "padded <C>", simple),
        11: ("empty_sql", "unread <C>", ""),
        13: ("low_score", "zero <C>", simple),
        14: ("error", "", ""),
        15: ("rejected", "", ""),
    }
    # questions under five characters are no description
    short = "length(question) < 5 AND status = 'low_score' AND sql <> '{\"x\":1}'"
    status, question, sql = (filled(case({k: r[i] for k, r in rows.items()}), {"<C>": "CAST(c_custkey AS VARCHAR)"}) for i in range(3))
    return (
        f"WITH b AS (SELECT c_custkey AS ord, c_custkey % {len(ODD_LINES)} AS k, c_custkey FROM customer), "
        f"r AS (SELECT ord, {status} AS status, {question} AS question, {sql} AS sql FROM b WHERE k <> 12) "
        f"SELECT ord, CASE WHEN {short} THEN 'quality_issues' ELSE status END AS status, question, sql FROM r"
    )


def yaml_sql() -> str:
    """YAML blocks of the accepted order tools, duplicates merged."""
    def js(c: str) -> str:
        return f"to_json({c})"

    params = _or({
        k: "\n".join(
            f'    - name: "{n}"\n      type: "string"\n      description: "{w} (e.g., {x})"' for n, w, x in p
        )
        for k, (_, p) in ORDERS.items()
    })
    block = (
        f"'  ' || {js('tool_key')} || ':' || chr(10) || '    kind: \"mysql-sql\"' || chr(10) || '    source: \"mysql\"' || chr(10) || "
        f"'    statement: ' || {js('st')} || chr(10) || '    description: ' || {js('text')} || chr(10) || '    templateParameters:' || chr(10) || {params}"
    )
    return (
        f"WITH {OR_BASE}, {statused('od', False)}, nm AS (SELECT *, {name_sql('st', False)} AS tool_name, {sentence_sql('st', 'names')} AS text FROM vs WHERE status = 'success'), "
        # a tool is its name, statement and question; keys that several tools share are lengthened
        f"ky AS (SELECT *, {key_sql(4)} AS short_key, {id_sql()} AS tool_id, row_number() OVER (PARTITION BY tool_name, sql, question ORDER BY ord DESC) AS rn FROM nm), "
        "lst AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY short_key) > 1 THEN short_key || '_' || substr(tool_id, 1, 16) ELSE short_key END AS tool_key FROM ky WHERE rn = 1) "
        f"SELECT {block} AS value FROM lst"
    )


def catalogue_rows_sql(columns: str) -> str:
    """The accepted order tools, one for each name, statement and question, with lengthened keys."""
    same = "PARTITION BY tool_name, sql, question"
    return (
        f"WITH {OR_BASE}, {statused('od', False)}, nm AS (SELECT *, {name_sql('st', False)} AS tool_name, {sentence_sql('st', 'names')} AS text, {pairs_sql()} AS pairs FROM vs WHERE status = 'success'), "
        f"ky AS (SELECT *, {key_sql(4)} AS short_key, {id_sql()} AS tool_id, row_number() OVER ({same} ORDER BY ord DESC) AS rn, min(ord) OVER ({same}) AS first_ord FROM nm), "
        "lst AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY short_key) > 1 THEN short_key || '_' || substr(tool_id, 1, 16) ELSE short_key END AS tool_key FROM ky WHERE rn = 1), "
        "rw AS (SELECT tool_key, 'mysql-sql' AS kind, 'mysql' AS source, st AS statement, text AS description, pairs AS \"templateParameters\", first_ord FROM lst) "
        f"SELECT {columns.replace('*', '* EXCLUDE (first_ord)')} FROM rw"
    )


def both_runs_sql() -> str:
    def run(n: int, clean: bool) -> str:
        st = "st_clean" if clean else "st"
        cte = statused("ev", clean)
        return (
            f"(WITH {cte}, nm AS (SELECT *, {name_sql(st, clean)} AS tool_name FROM vs WHERE status = 'success') "
            f"SELECT {n} AS run, ord, {key_sql(4)} AS tool_key, {st} AS statement, tool_name, sql, question FROM nm)"
        )

    return f"{EV_BASE}, al AS ({run(1, False)} UNION ALL {run(2, True)})"


def merge_sql() -> str:
    one = "PARTITION BY tool_name, sql, question ORDER BY"  # a tool is its name, statement and question, unhashed
    return (
        f"WITH {both_runs_sql()}, "
        f"w AS (SELECT *, row_number() OVER ({one} run DESC, ord DESC) AS last, row_number() OVER ({one} run, ord) AS first FROM al) "
        "SELECT a.tool_key, a.statement, b.run AS first_run, b.ord AS first_ord, a.run AS last_run FROM w a "
        "JOIN w b ON a.tool_name = b.tool_name AND a.sql = b.sql AND a.question = b.question AND b.first = 1 WHERE a.last = 1"
    )


def identity_sql() -> str:
    return f"WITH {both_runs_sql()}, t AS (SELECT DISTINCT tool_name, sql, question FROM al) SELECT count(*) AS tools, count(*) AS identities FROM t"


def details_sql() -> str:
    lines = _or({
        k: "\n".join(f"  - {n} (string): {w} (e.g., {x})" for n, w, x in p) or "No parameters" for k, (_, p) in ORDERS.items()
    })
    return (
        f"WITH {OR_BASE}, {viewer_cte('st', 'names')}, z AS (SELECT ord, {lines} AS lines FROM od) "
        "SELECT tool_key, 'Description:' || chr(10) || question || chr(10) || chr(10) || 'SQL Query:' || chr(10) || st || chr(10) || chr(10) || "
        "'Quality Score: ' || printf('%.1f', quality_score) || chr(10) || 'Labels: ' || labels || chr(10) || 'Database ID: ' || db_id || chr(10) || "
        "'Source: ' || source || chr(10) || chr(10) || 'Parameters:' || chr(10) || lines || chr(10) AS details FROM vw JOIN z USING (ord)"
    )


def summary_sql() -> str:
    head = "Processing Results:\n========================\n\nInput File: events.jsonl\nItems Processed: "
    mid = "\nTools Created: "
    tail = (
        "\nProcessing Time: Real processing completed\n\nConfiguration:\n- Output File: tools.yaml\n- Tool Name: N/A\n- Description: N/A\n"
        "- Author: N/A\n- Version: N/A\n- License: N/A\n\nProcessing Options:\n- Quality Scoring: True\n- Parameterization: True\n"
        "- Labeling: True\n- Min Quality Score: 50.0\n"
    )
    return (
        f"WITH {EV_BASE} SELECT {q(head)} || count(*) || {q(mid)} || count(*) FILTER (sql <> '' AND question <> '') || {q(tail)} AS value FROM ev"
    )


def domains_sql() -> str:
    """Literals per template and parameter, most frequent first."""
    return (
        f"WITH od2 AS (WITH {OR_BASE} SELECT ord, st FROM od), pa AS ({params_sql()}), "
        "ct AS (SELECT st AS statement, pos, name, example, count(*) AS n FROM pa JOIN od2 USING (ord) GROUP BY ALL), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY statement, pos, name ORDER BY n DESC, example) AS r FROM ct) "
        "SELECT statement, CAST(pos AS INT) AS pos, name, CAST(sum(n) AS BIGINT) AS uses, count(*) AS literals, min(example) AS least, max(example) AS most, "
        "string_agg(example || ' x' || n, '; ' ORDER BY r) FILTER (r <= 3) AS frequent FROM rk GROUP BY statement, pos, name"
    )


def histogram_sql(clean: bool) -> str:
    return (
        f"WITH {OR_BASE}, {statused('od', clean)}, ba AS (SELECT CAST(floor(score / 10) * 10 AS BIGINT) AS bar, count(*) AS records, "
        "count(*) FILTER (status = 'success') AS accepted, CAST(min(score) AS DOUBLE) AS least, CAST(max(score) AS DOUBLE) AS most FROM vs GROUP BY 1) "
        "SELECT *, CAST(sum(records) OVER (ORDER BY bar) AS DOUBLE) * 100 / (SELECT CAST(count(*) AS DOUBLE) FROM vs) AS share_upto FROM ba"
    )


def retrieval_sql(tools: str, questions: str, key: str, tool: str, k: int = TOP) -> str:
    """Every tool scored for every question; ``tools`` gives (id, text), ``questions`` gives (key, text)."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return (
        f"tl AS (SELECT id, {words} AS w FROM ({tools})), sz AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS t FROM tl), "
        "us AS (SELECT id, len, word, count(*) AS uses FROM (SELECT id, len(w) AS len, unnest(w) AS word FROM tl) GROUP BY ALL), "
        "hv AS (SELECT word, count(*) AS tools FROM us GROUP BY word), "
        "rw AS (SELECT word, tools, greatest(1, CAST(floor(ln(1 + (n - tools + CAST(0.5 AS DOUBLE)) / (tools + CAST(0.5 AS DOUBLE))) * 1000) AS BIGINT)) AS rarity, n, t FROM hv, sz), "
        "po AS MATERIALIZED (SELECT word, id, greatest(1, (rarity * uses * 2200) // (1000 * uses + 300 + (len * n * 900) // t)) AS worth FROM us JOIN rw USING (word)), "
        f"qs AS (SELECT key, text FROM ({questions})), qw AS (SELECT text, unnest(list_distinct({words})) AS word FROM (SELECT DISTINCT text FROM qs)), "
        "sc AS (SELECT text, id, CAST(sum(worth) AS BIGINT) AS score FROM qw JOIN po USING (word) GROUP BY ALL), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= {k}) "
        f"SELECT key AS {key}, rank, id AS {tool}, score FROM qs JOIN rk USING (text)"
    )


def retrieve_topk_sql() -> str:
    tools = (
        f"WITH {OR_BASE}, {statused('od', False)}, nm AS (SELECT *, {sentence_sql('st', 'names')} AS described FROM vs WHERE status = 'success') "
        "SELECT ord AS id, question || ' ' || described AS text FROM nm"
    )
    return "WITH " + retrieval_sql(tools, f"WITH {EV_BASE} SELECT ord AS key, question AS text FROM ev", "ord", "tool_ord")


def oracle_sql() -> dict[str, str]:
    E, O = f"WITH {EV_BASE} ", f"WITH {OR_BASE} "
    pg = _or(numbered_texts({k: e[0] for k, e in ORDERS.items()}))
    pg = dialect_sql(pg, "postgres")
    vw = "ord, question AS description, st AS sql, names AS parameters, quality_score, labels, db_id, source FROM vw"
    out = {
        "corpus_normalize": E + "SELECT ord, question, sql, db_id, source FROM ev",
        "corpus_rejects": f"SELECT event_id AS ord, {q(BROKEN_LINE)} AS value FROM events WHERE event_id % 10 = 8",
        "odd_lines_status": odd_sql(False),
        "odd_lines_status_clean": odd_sql(True),
        "template_full": E + "SELECT ord, st AS statement, names AS params FROM ev",
        "template_full_clean": E + "SELECT ord, st_clean AS statement, names_clean AS params FROM ev",
        "template_orders": O + "SELECT ord, st AS statement, names AS params FROM od",
        "template_orders_clean": O + "SELECT ord, st_clean AS statement, names_clean AS params FROM od",
        "template_params": params_sql(),
        "labels": O + f"SELECT ord, {labels_sql('sql')} AS labels FROM od",
        "label_distribution": (
            O + f", {statused('od', False)}, su AS (SELECT {labels_sql('sql')} AS lab FROM vs WHERE status = 'success'), "
            "ex AS (SELECT unnest(string_split(lab, ', ')) AS label FROM su) "
            "SELECT label, count(*) AS tools, count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM su) AS share FROM ex GROUP BY label"
        ),
        "tool_names": O + f", nm AS (SELECT *, {name_sql('st', False)} AS tool_name FROM od) SELECT ord, tool_name, {key_sql(4)} AS tool_key FROM nm",
        "tool_names_clean": O + f", nm AS (SELECT *, {name_sql('st_clean', True)} AS tool_name FROM od) SELECT ord, tool_name, {key_sql(16)} AS tool_key FROM nm",
        "tool_description": O + f"SELECT ord, {sentence_sql('st', 'names')} AS description FROM od",
        "quality_scores": O + f", {scored('od', False)} SELECT ord, parameters, complexity, description, reusability, raw_score AS score FROM sc",
        "quality_scores_clean": O + f", {scored('od', True)} SELECT ord, parameters, complexity, description, reusability, raw_score AS score FROM sc",
        "question_scores": f"SELECT doc_id, {description_sql('text')} AS score FROM documents",
        "validation_status": E + f", {statused('ev', False)} SELECT ord, status, reason, score FROM vs",
        "validation_status_clean": E + f", {statused('ev', True)} SELECT ord, status, reason, score FROM vs",
        "run_statistics": statistics_sql(False),
        "run_statistics_clean": statistics_sql(True),
        "run_statistics_max_score": statistics_sql(False, low=40, high=60, least=3),
        "curate_catalogue": (
            O + f", {statused('od', False)}, nm AS (SELECT *, {name_sql('st', False)} AS tool_name, {sentence_sql('st', 'names')} AS text, {pairs_sql()} AS pairs "
            f"FROM vs WHERE status = 'success') SELECT {key_sql(4)} AS tool_key, ord, 'mysql-sql' AS kind, 'mysql' AS source, st AS statement, text AS description, "
            "pairs AS templateParameters FROM nm"
        ),
        "create_tools": (
            E + f", {statused('ev', False, high=1000, least=0)}, nm AS (SELECT *, {name_sql('st', False)} AS tool_name FROM vs WHERE status = 'success') "
            f"SELECT ord, {key_sql(4)} AS tool_key, 'mysql-sql' AS kind, 'mysql' AS source, st AS statement, CAST(len({name_list('names')}) AS INT) AS n_params FROM nm"
        ),
        "curate_viewer": O + f", {viewer_cte('st', 'names')} SELECT {vw}",
        "curate_viewer_postgres": O + f", {viewer_cte(pg, 'names')} SELECT {vw}",
        "curate_viewer_clean": O + f", {viewer_cte('st_clean', 'names_clean', True, 'quality_score >= 50')} SELECT {vw}",
        "curate_viewer_plain": O + "SELECT ord, question AS description, sql, '' AS parameters, CAST(100 AS DOUBLE) AS quality_score, '' AS labels, db_id, source FROM od",
        "sql_server_names": O + f"SELECT ord, array_to_string(list_transform({name_list('names')}, lambda x: '@' || x), ',') AS server_names FROM od",
        "numbered_tools": E + "SELECT ord, 'r1_sql_tool_' || row_number() OVER (ORDER BY ord) AS tool_key FROM ev WHERE sql <> '' AND question <> ''",
        "dataset_profile": profile_sql(EV_BASE, "(CASE WHEN k IN (0, 5, 6, 7, 9) THEN sql ELSE '' END)"),
        "dataset_profile_orders": profile_sql(OR_BASE, "sql"),
        "batch_split": E + f"SELECT ord, CASE WHEN row_number() OVER (ORDER BY ord) <= {BATCH} THEN 'batch' ELSE 'remaining' END AS part FROM ev",
        "catalogue_merge": merge_sql(),
        "catalogue_identity": identity_sql(),
        "catalogue_yaml": yaml_sql(),
        "catalogue_search": search_sql("group"),
        "catalogue_search_counts": search_sql("3 param"),
        "catalogue_preview": O + f", {viewer_cte('st', 'names')} SELECT {_PREVIEW} FROM vw",
        "tool_details": details_sql(),
        "dataset_preview": f"SELECT doc_id AS ord, {cutoff('text', 100)} AS text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
        "export_csv_layout": (
            O + f", {viewer_cte(pg, 'names')} SELECT tool_key AS tool_name, question AS description, st AS sql, CAST(len({name_list('names')}) AS INT) AS param_count, "
            "quality_score, labels, db_id, source FROM vw"
        ),
        "run_summary": summary_sql(),
        "dialect_fanout": fan_out_sql(False),
        "dialect_fanout_clean": fan_out_sql(True),
        "dialect_plain": plain_dialects_sql(),
        "field_scores": f"WITH {EV_BASE}, {raw_fields_cte()}, {field_table_sql()} SELECT field, records, sql_score, question_score FROM ft",
        "field_detection": detection_sql(),
        "text_field_scores": (
            "WITH b AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations) "
            f"SELECT id, CAST({field_points("'text'", 'text')[0]} AS BIGINT) AS sql_score, CAST({field_points("'text'", 'text')[1]} AS BIGINT) AS question_score FROM b"
        ),
        "profile_normalize": chosen_sql(["question"], ["query", "gold_sql", "sql"], ["db_id"]),
        "profile_normalize_renamed": O + "SELECT ord, question, sql, db_id, 'huggingface' AS source FROM od",
        # prompt has the best mean question score; records without it are read by the usual names
        "detected_normalize": chosen_sql(["prompt", "question", "query", "nl", "instruction", "text"], _SF, ["db_id", "db", "schema"]),
        "fallback_normalize": chosen_sql(["question", "query", "nl", "instruction", "text"], _SF, ["db_id", "db", "schema"]),
        "dataset_ids": (
            "WITH b AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'org' || page_id % 7 || '/set-' || page_id WHEN 1 THEN 'org_' || page_id || '/re.po' "
            "ELSE rtrim(split_part(split_part(rtrim(url, '/'), '?', 1), '#', 1), './-') END AS dataset_id FROM pages) "
            "SELECT page_id, dataset_id, replace(replace(dataset_id, '/', '_'), '.', '_') AS file_name FROM b"
        ),
        "slugs": (
            "WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM documents) "
            "SELECT doc_id, substr(CASE WHEN s = '' THEN 'tool' WHEN regexp_matches(s, '^[a-z]') THEN s ELSE 'tool_' || s END, 1, 60) AS slug FROM b"
        ),
        "datasets_top20": (
            "SELECT lang || '/' || source AS name, 'false' AS description, CAST(sum(n_chars) AS BIGINT) AS downloads FROM documents "
            "WHERE contains(source, 'src1') GROUP BY lang, source ORDER BY downloads DESC, name LIMIT 20"
        ),
        "stream_status_counts": (
            f"WITH {EV_BASE}, x AS (SELECT * FROM ev UNION ALL SELECT ord, k, t, ts, v, n, '', '', '', 'unknown', '', '', '', '' FROM ev0 WHERE k = 8), "
            f"{statused('x', False)} SELECT date_trunc('hour', ts) AS window_start, status, count(*) AS records FROM vs GROUP BY ALL"
        ),
        "batch_status_counts": (
            f"WITH {EV_BASE}, x AS (SELECT * FROM ev UNION ALL SELECT ord, k, t, ts, v, n, '', '', '', 'unknown', '', '', '', '' FROM ev0 WHERE k = 8), "
            f"{statused('x', False)} SELECT date_trunc('day', ts) AS window_start, status, count(*) AS records FROM vs GROUP BY ALL"
        ),
    }
    out |= {
        "stream_deduplicated": f"WITH {EV_BASE} SELECT sql, question FROM ev UNION SELECT '', ''",  # broken lines have neither
        "stream_closed_windows": (
            f"WITH {EV_BASE}, x AS (SELECT * FROM ev UNION ALL SELECT ord, k, t, ts, v, n, '', '', '', 'unknown', '', '', '', '' FROM ev0 WHERE k = 8), "
            f"{statused('x', False)} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, status, count(*) AS records FROM vs "
            "WHERE date_trunc('hour', ts) + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events) GROUP BY ALL"
        ),
        "template_support": (
            O + "SELECT st AS statement, count(*) AS uses, count(DISTINCT question) AS questions, count(DISTINCT db_id) AS databases, "
            "min(ord) AS first_ord, max(ord) AS last_ord, arg_min(question, ord) AS example FROM od GROUP BY st"
        ),
        "literal_domains": domains_sql(),
        "validity": E + f", {statused('ev', False, low=0)} SELECT ord, reason = '' AS is_valid, reason FROM vs",
        "corpus_round_trip": O + "SELECT ord, question, sql, db_id, source FROM od WHERE ord % 4 = 0",
        "catalogue_json": catalogue_rows_sql("*"),
        "catalogue_import": catalogue_rows_sql("*, row_number() OVER (ORDER BY first_ord) - 1 AS ord"),
        "dialect_store": (
            f"SELECT * FROM ({fan_out_sql(True)}) WHERE dialect = 'sqlite' UNION ALL SELECT * FROM ({fan_out_sql(False)}) WHERE dialect = 'postgres'"
        ),
        "stream_catalogue": (
            f"WITH {both_runs_sql()}, w AS (SELECT *, row_number() OVER (PARTITION BY tool_name, sql, question ORDER BY ord DESC) AS last, "
            "min(ord) OVER (PARTITION BY tool_name, sql, question) AS first_ord FROM al WHERE run = 1) SELECT tool_key, statement, first_ord FROM w WHERE last = 1"
        ),
        "support_across_runs": (
            O + "SELECT st AS statement, count(*) AS uses, min(ord) AS first_ord, max(ord) AS last_ord, true AS questions_close, true AS databases_close FROM od GROUP BY st"
        ),
        "literals_across_runs": f"SELECT statement, pos, name, uses, least, most, true AS literals_close FROM ({domains_sql()})",
        "score_percentiles": (
            O + f", {statused('od', False)} SELECT count(*) AS records, " + ", ".join(f"quantile_cont(CAST(score AS DOUBLE), {s}) AS p{round(100 * s)}" for s in SHARES)
            + ", true AS sketch_near FROM vs"
        ),
        "nearest_vectors": (
            "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) / 1e-6) AS BIGINT)) AS v FROM embeddings), "
            "d AS (SELECT a.vec_id, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance "
            "FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) "
            f"SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, id) AS rank, id, distance FROM d QUALIFY rank <= {TOP}"
        ),
        "nearest_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
        "retrieve_topk": retrieve_topk_sql(),
        "retrieve_documents": "WITH " + retrieval_sql("SELECT doc_id AS id, text FROM documents", "SELECT item_id AS key, text FROM benchmark", "item_id", "doc_id"),
        "best_per_template": (
            O + f", {statused('od', False)}, rk AS (SELECT *, row_number() OVER (PARTITION BY tpl, db_id ORDER BY score DESC, ord) AS r, "
            "count(*) OVER (PARTITION BY tpl, db_id) AS tools FROM vs WHERE status = 'success') "
            "SELECT tpl AS statement, db_id, ord, question, CAST(score AS DOUBLE) AS score, tools FROM rk WHERE r = 1"
        ),
        "score_histogram": histogram_sql(False),
        "score_histogram_clean": histogram_sql(True),
        # blanks beside the sign of a join condition are the one thing that a template doesn't keep
        "bind_templates": O + "SELECT ord, replace(sql, 's.id=e.cid', 's.id = e.cid') AS bound, '' AS missing FROM od",
    }
    out.update({name: pass_sql(name) for name in PASSES})
    return out
