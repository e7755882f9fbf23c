"""Hand-traced statements: template text and ordered parameter names, in both modes."""

import pytest

from sqlcorpus.config import CurationConfig
from sqlcorpus.functions.templates import extract_templates

# (statement, compat template, compat names, clean template or None if equal, clean names)
GOLD = [
    ("SELECT name FROM students", "SELECT {{.select_col}} FROM {{.table}}", "table,select_col", None, None),
    (
        "SELECT * FROM students WHERE age > 25",
        "SELECT * FROM {{.table}} WHERE age > {{.value}}",
        "value,table",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} > {{.value}}",
        "value,table,where_col",
    ),
    (
        "SELECT c.city, COUNT(*) FROM orders o JOIN customers c ON o.cust_id = c.id WHERE c.status = 'active' "
        "AND o.total >= 100.5 GROUP BY c.city HAVING COUNT(*) > 10 ORDER BY COUNT(*) DESC LIMIT 5",
        "SELECT c.city, COUNT(*) FROM {{.table}} o JOIN {{.table_1}} c ON o.{{.join_col}} = c.{{.join_col_1}} "
        "WHERE c.status = {{.active}} AND o.total >= {{.threshold}} GROUP BY c.{{.group_col}} "
        "HAVING COUNT(*) > {{.value}} ORDER BY COUNT(*) {{.order_dir}} LIMIT {{.limit_n}}",
        "active,threshold,value,table,table_1,join_col,join_col_1,group_col,limit_n,order_dir",
        "SELECT c.city, COUNT(*) FROM {{.table}} o JOIN {{.table_1}} c ON o.{{.join_col}} = c.{{.join_col_1}} "
        "WHERE c.{{.where_col}} = {{.active}} AND o.total >= {{.threshold}} GROUP BY c.{{.group_col}} "
        "HAVING COUNT(*) > {{.value}} ORDER BY COUNT(*) {{.order_dir}} LIMIT {{.limit_n}}",
        "active,threshold,value,table,table_1,where_col,join_col,join_col_1,group_col,limit_n,order_dir",
    ),
    (
        "SELECT name, age FROM singer WHERE country LIKE '%fr%' ORDER BY age LIMIT 3",
        "SELECT {{.select_col}}, {{.select_col_2}} FROM {{.table}} WHERE {{.where_col}} LIKE {{.fr}} "
        "ORDER BY {{.order_col}}LIMIT {{.limit_n}}",
        "fr,table,select_col,select_col_2,where_col,limit_n,order_col",
        "SELECT {{.select_col}}, {{.select_col_2}} FROM {{.table}} WHERE {{.where_col}} LIKE {{.fr}} "
        "ORDER BY {{.order_col}} LIMIT {{.limit_n}}",
        "fr,table,select_col,select_col_2,where_col,limit_n,order_col",
    ),
    (
        "SELECT city FROM t GROUP BY city",
        "SELECT {{.select_col}} FROM {{.table}} GROUP BY city",
        "table,select_col",
        "SELECT {{.select_col}} FROM {{.table}} GROUP BY {{.group_col}}",
        "table,select_col,group_col",
    ),
    (
        "SELECT COUNT(*) FROM sales WHERE year = '2005'",
        "SELECT COUNT(*) FROM {{.table}} WHERE year = {{.{{.value}}}}",
        "2005,value,table",
        "SELECT COUNT(*) FROM {{.table}} WHERE {{.where_col}} = {{.v_2005}}",
        "v_2005,table,where_col",
    ),
    (
        "SELECT a1 FROM t1 WHERE x IN ('aa','aa')",
        "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} IN ({{.aa}},{{.aa_1}})",
        "aa,aa_1,table,select_col,where_col",
        None,
        None,
    ),
    (
        "SELECT DISTINCT country FROM singer WHERE age BETWEEN 20 AND 30",
        "SELECT DISTINCT country FROM {{.table}} WHERE age BETWEEN {{.value}} AND {{.value_1}}",
        "value,value_1,table",
        None,
        None,
    ),
    (
        "SELECT name FROM singer WHERE singer_id NOT IN (SELECT singer_id FROM concert)",
        "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} NOT IN (SELECT {{.select_col_1}} FROM {{.table_1}})",
        "table,table_1,select_col,select_col_1,where_col",
        None,
        None,
    ),
    (
        "SELECT s.name FROM student AS s JOIN enrol AS e ON s.id=e.sid ORDER BY s.name DESC",
        "SELECT s.name FROM {{.table}} AS s JOIN {{.table_1}} AS e ON s.{{.join_col}} = e.{{.join_col_1}} "
        "ORDER BY {{.order_col}} {{.order_dir}}",
        "table,table_1,join_col,join_col_1,order_col,order_dir",
        None,
        None,
    ),
    (
        "UPDATE accounts SET status = 'closed' WHERE balance <= 0",
        "UPDATE {{.table}} SET status = {{.closed}} WHERE balance <= {{.value}}",
        "closed,value,table",
        "UPDATE {{.table}} SET status = {{.closed}} WHERE {{.where_col}} <= {{.value}}",
        "closed,value,table,where_col",
    ),
    (
        "SELECT a, b, c FROM t LIMIT 10 OFFSET 20",
        "SELECT {{.select_col}}, {{.select_col_2}}, {{.select_col_3}} FROM {{.table}} LIMIT {{.limit_n}} OFFSET {{.offset_n}}",
        "table,select_col,select_col_2,select_col_3,limit_n,offset_n",
        None,
        None,
    ),
    # no literal, nothing to do
    ("", "", "", None, None),
    # literals that stay: one character, answer and direction words
    (
        "SELECT x1 FROM tt WHERE f='Y' AND g='yes' AND h='no' AND k=\"desc\"",
        "SELECT {{.select_col}} FROM {{.table}} WHERE f='Y' AND g='yes' AND h='no' AND k=\"desc\"",
        "table,select_col",
        "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} ='Y' AND g='yes' AND h='no' AND k=\"desc\"",
        "table,select_col,where_col",
    ),
    # double-quoted literals are named before single-quoted ones
    (
        "DELETE FROM t WHERE a LIKE 'bb' OR c LIKE \"dd\"",
        "DELETE FROM {{.table}} WHERE {{.where_col}} LIKE {{.bb}} OR c LIKE {{.dd}}",
        "dd,bb,table,where_col",
        None,
        None,
    ),
    # names of literals collide with each other, with a numbered name and with later passes
    (
        "SELECT q FROM tt WHERE a IN ('foo','foo 1','foo','table','value') AND b = 3",
        "SELECT {{.select_col}} FROM {{.table_1}} WHERE {{.where_col}} IN "
        "({{.foo}},{{.foo_1}},{{.foo_2}},{{.table}},{{.value}}) AND b = {{.value_1}}",
        "foo,foo_1,foo_2,table,value,value_1,table_1,select_col,where_col",
        None,
        None,
    ),
    # a literal with no letters or digits; patterns; reserved bases
    (
        "SELECT * FROM t WHERE a IN ('8/%','--','%%','limit','offset')",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} IN ({{.{{.value}}}},{{.str_value}},{{.pattern}},{{.limit_n}},{{.offset_n}})",
        "8,str_value,pattern,limit_n,offset_n,value,table,where_col",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} IN ({{.v_8}},{{.str_value}},{{.pattern}},{{.limit_n}},{{.offset_n}})",
        "v_8,str_value,pattern,limit_n,offset_n,table,where_col",
    ),
    # a taken limit_n is not registered twice
    (
        "SELECT z FROM t WHERE a LIKE 'limit' LIMIT 7",
        "SELECT {{.select_col}} FROM {{.table}} WHERE {{.where_col}} LIKE {{.limit_n}} LIMIT {{.limit_n}}",
        "limit_n,table,select_col,where_col",
        None,
        None,
    ),
    # numbers: only near a condition, never near LIMIT/OFFSET, minus sign outside
    (
        "SELECT a + 1 FROM t WHERE b > -2 AND c < 3.50 LIMIT 5",
        "SELECT a + 1 FROM {{.table}} WHERE b > -{{.value}} AND c < {{.threshold}} LIMIT {{.limit_n}}",
        "value,threshold,table,limit_n",
        "SELECT a + 1 FROM {{.table}} WHERE {{.where_col}} > -{{.value}} AND c < {{.threshold}} LIMIT {{.limit_n}}",
        "value,threshold,table,where_col,limit_n",
    ),
    (
        "SELECT * FROM t WHERE id IN (1, 22, 333, 4444, 55555, 666666, 7777777, 88888888, 9)",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} IN ({{.value}}, {{.value_1}}, {{.value_2}}, {{.value_3}}, {{.value_4}}, {{.value_5}}, 7777777, 88888888, 9)",
        "value,value_1,value_2,value_3,value_4,value_5,table,where_col",
        None,
        None,
    ),
    # functions and ordinals in GROUP BY and ORDER BY
    (
        "SELECT a, SUM(b) FROM t GROUP BY a, YEAR(d), t.c, 2 ORDER BY a, SUM(b)",
        "SELECT a, SUM(b) FROM {{.table}} GROUP BY {{.group_col}}, YEAR(d), t.{{.group_col_3}}, 2 "
        "ORDER BY {{.order_col}}, SUM(b)",
        "table,group_col,group_col_3,order_col",
        None,
        None,
    ),
    # aliases and qualified columns stay; white space in lists is normalised
    (
        "SELECT  a ,b AS x,t.c\n FROM  t",
        "SELECT {{.select_col}}, b AS x, t.c FROM {{.table}}",
        "table,select_col",
        None,
        None,
    ),
    # INSERT: VALUES is no table, INTO is
    (
        "INSERT INTO logs (a, b) VALUES ('xx', 'yy')",
        "INSERT INTO {{.table}} (a, b) VALUES ({{.xx}}, {{.yy}})",
        "xx,yy,table",
        None,
        None,
    ),
    # three-part names: untouched in WHERE and ON
    (
        "SELECT p FROM a JOIN bb ON x.y.z = bb.k WHERE m.n.o IN (SELECT q FROM cc)",
        "SELECT {{.select_col}} FROM {{.table}} JOIN {{.table_1}} ON x.y.z = bb.{{.join_col}} WHERE m.n.o IN (SELECT {{.select_col_1}} FROM {{.table_2}})",
        "table,table_1,table_2,select_col,select_col_1,join_col",
        None,
        None,
    ),
    # schema-qualified table
    (
        "SELECT aa FROM db.tt",
        "SELECT {{.select_col}} FROM {{.table}}.tt",
        "table,select_col",
        "SELECT {{.select_col}} FROM {{.table}}",
        "table,select_col",
    ),
    # doubled quotes
    (
        "SELECT * FROM t WHERE n LIKE 'O''Brien'",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} LIKE 'O'{{.brien}}",
        "brien,table,where_col",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} LIKE {{.o_brien}}",
        "o_brien,table,where_col",
    ),
    # an empty literal swallows the text up to the next quote
    (
        "SELECT * FROM t WHERE n LIKE '' OR m LIKE 'zz'",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} LIKE '{{.or_m_like}}zz'",
        "or_m_like,table,where_col",
        "SELECT * FROM {{.table}} WHERE {{.where_col}} LIKE '' OR m LIKE {{.zz}}",
        "zz,table,where_col",
    ),
    # second ORDER BY: shared names, first description wins
    (
        "SELECT x FROM (SELECT x FROM t ORDER BY x ASC) ORDER BY MAX(y) DESC",
        "SELECT {{.select_col}} FROM (SELECT {{.select_col_1}} FROM {{.table}} ORDER BY {{.order_col}} {{.order_dir}}) ORDER BY MAX(y) {{.order_dir}}",
        "table,select_col,select_col_1,order_col,order_dir",
        None,
        None,
    ),
    # letters outside ASCII are word characters
    (
        "SELECT größe FROM länder WHERE größe IN ('Zürich')",
        "SELECT {{.select_col}} FROM länder WHERE größe IN ({{.z_rich}})".replace("länder", "{{.table}}").replace("größe IN", "{{.where_col}} IN"),
        "z_rich,table,select_col,where_col",
        None,
        None,
    ),
    # direction glued to a longer word
    (
        "SELECT * FROM t ORDER BY a descr",
        "SELECT * FROM {{.table}} ORDER BY {{.order_col}} {{.order_dir}}r",
        "table,order_col,order_dir",
        "SELECT * FROM {{.table}} ORDER BY {{.order_col}} descr",
        "table,order_col",
    ),
]


def run(spark, cfg):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLD)], "i int, sql string")
    return {r.i: r for r in extract_templates(df, cfg).collect()}


@pytest.fixture(scope="module")
def compat(spark):
    return run(spark, CurationConfig())


@pytest.fixture(scope="module")
def clean(spark):
    return run(spark, CurationConfig(mode="clean"))


@pytest.mark.parametrize("i", range(len(GOLD)))
def test_compat(compat, i):
    r = compat[i]
    assert r.statement == GOLD[i][1]
    assert ",".join(p.name for p in r.params) == GOLD[i][2]


@pytest.mark.parametrize("i", range(len(GOLD)))
def test_clean(clean, i):
    _, text, names, clean_text, clean_names = GOLD[i]
    r = clean[i]
    assert r.statement == (text if clean_text is None else clean_text)
    assert ",".join(p.name for p in r.params) == (names if clean_names is None else clean_names)


def test_descriptions(compat):
    assert [p.description for p in compat[1].params] == ["Numeric value (e.g., 25)", "Table name (e.g., students)"]
    assert compat[3].params[0].description == "String pattern for LIKE (e.g., %fr%)"
    assert {p.type for r in compat.values() for p in r.params} == {"string"}


def test_switches(spark):
    df = spark.createDataFrame([("SELECT a FROM t WHERE b LIKE 'xx' GROUP BY a LIMIT 2",)], "sql string")
    r = extract_templates(df, CurationConfig(parameterize_tables=False, parameterize_columns=False)).first()
    assert r.statement == "SELECT a FROM t WHERE b LIKE {{.xx}} GROUP BY {{.group_col}} LIMIT {{.limit_n}}"


def test_marker_characters_survive(spark):
    odd = "SELECT \x01x\x02 FROM t WHERE a LIKE '\x03b\x04\x05'"
    r = extract_templates(spark.createDataFrame([(odd,)], "sql string")).first()
    assert r.statement == "SELECT \x01x\x02 FROM {{.table}} WHERE {{.where_col}} LIKE {{.b}}"
    assert r.params[0].example == "\x03b\x04\x05"


def test_long_statement(spark):
    """Thousands of literals and a very long literal neither overflow the stack nor get cut."""
    many = "SELECT a FROM t WHERE b IN (" + ",".join(f"'w{i}'" for i in range(3000)) + ")"
    long = "SELECT a FROM t WHERE b LIKE '" + "x''y" * 20000 + "'"
    df = spark.createDataFrame([(many,), (long,)], "sql string")
    for mode in ("compat", "clean"):
        a, b = extract_templates(df, CurationConfig(mode=mode)).collect()
        assert len(a.params) == 3003
        assert a.statement.endswith("{{.w2999}})")
        assert len(b.params) > 2


def test_search_covers_shown_counts_and_scores(spark):
    from sqlcorpus.operators.search import search_catalogue

    rows = [("a", "d", "SELECT 1", [], 0.75, "x"), ("b", "d", "SELECT 2", ["p", "q", "r"], 0.5, "x"), ("c", None, None, None, None, None)]
    viewer = spark.createDataFrame(rows, "tool_key string, description string, sql string, parameters array<string>, quality_score double, labels string")
    keys = lambda text: {r.tool_key for r in search_catalogue(viewer, text).collect()}
    assert keys("no PARAMS") == {"a", "c"} and keys("3 param(s)") == {"b"} and keys("0.75") == {"a"} and keys("select 2") == {"b"}
