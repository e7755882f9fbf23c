"""Statements with one or two spots to a pass are rewritten without the arrays that many spots need."""

import pytest
from pyspark.sql import functions as F

from sqlcorpus.config import CurationConfig
from sqlcorpus.functions import labels as L
from sqlcorpus.functions.spots import Rewriter
from sqlcorpus.functions.templates import extract_templates

ROWS = [  # statement, compat template, names
    (
        "SELECT a, b FROM t JOIN u ON t.i = u.j WHERE c LIKE '%x%' AND d IN ('yy','yy') AND e > 4 GROUP BY f ORDER BY g DESC LIMIT 3",
        "SELECT {{.select_col}}, {{.select_col_2}} FROM {{.table}} JOIN {{.table_1}} ON t.{{.join_col}} = u.{{.join_col_1}} "
        "WHERE {{.where_col}} LIKE {{.x}} AND d IN ({{.yy}},{{.yy_1}}) AND e > {{.value}} GROUP BY {{.group_col}} "
        "ORDER BY {{.order_col}} {{.order_dir}} LIMIT {{.limit_n}}",
        ["x", "yy", "yy_1"],
    ),
    ("SELECT * FROM t WHERE a > 1 AND b < 2.5", "SELECT * FROM {{.table}} WHERE a > {{.value}} AND b < {{.threshold}}", ["value", "threshold"]),
    (None, None, []),
]


def _rows(spark, rows):
    df = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(rows)], "ord long, sql string")
    return [(r.statement, [p["name"] for p in r.params]) for r in extract_templates(df, CurationConfig()).orderBy("ord").collect()]


@pytest.mark.parametrize("i", [1, 2])
def test_one_or_two_spots_do_not_take_the_way_for_many(spark, monkeypatch, i):
    monkeypatch.setattr(Rewriter, "named", lambda *a, **k: "named_struct('text', raise_error('many'), 'log', '')")
    ((statement, names),) = _rows(spark, [ROWS[i]])
    assert statement == ROWS[i][1] and names[: len(ROWS[i][2])] == ROWS[i][2]


def test_three_spots_and_taken_names_take_it(spark):
    first, *rest = _rows(spark, ROWS + [("SELECT a FROM t WHERE b IN ('table')", "", [])])
    assert first[0] == ROWS[0][1] and first[1][:3] == ROWS[0][2]
    assert rest[-1] == ("SELECT {{.select_col}} FROM {{.table_1}} WHERE {{.where_col}} IN ({{.table}})", ["table", "table_1", "select_col", "where_col"])


def test_labels_and_names_are_compiled(spark, capsys):
    rows = [(0, "SELECT COUNT(*) FROM a LEFT JOIN b ON x = y GROUP BY c"), (1, "explain"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "ord long, sql string").repartition(1)
    found = df.select("ord", L.label_array(F.col("sql")).alias("labels"), L.tool_name(F.col("sql")).alias("name"))
    assert [(r.labels, r.name) for r in found.orderBy("ord").collect()] == [
        (["select", "join", "left_join", "count", "grouped"], "select_count_grouped_joined"),
        ([], "query"),
        ([], "query"),
        ([], "query"),
    ]
    found.explain()
    assert "lambda" not in capsys.readouterr().out
