"""Dialect conversion tries its regular expressions only on texts that have their words, in any folding."""

import pytest
from pyspark.sql import functions as F

from sqlcorpus.config import CurationConfig
from sqlcorpus.functions.dialects import convert, fan_out

ROWS = [
    ("SELECT a FROM t lımıt 5", "SELECT a FROM t OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY"),
    ("SELECT a FROM t LİMİT 5", "SELECT a FROM t OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY"),
    ("SELECT a FROM t Offſet 3", "SELECT a FROM t OFFSET 3 ROWS"),
    ("SELECT now(), Length(x), snow() FROM t", "SELECT GETDATE(), LEN(x), snow() FROM t"),
    ("SELECT date_add(d, interval 2 month), xdate_add(d, interval 3 week)", "SELECT DATEADD(month, 2, d), xDATEADD(day, 3, d)"),
    ("create table t (a boolean, b tinyint(1))", "create table t (a BIT, b TINYINT)"),
    ("SELECT boolean FROM t WHERE a = {{.limit}} AND b = {{.limit}}", "SELECT boolean FROM t WHERE a = @limit AND b = @limit"),
    ("", ""),
    (None, None),
]


def test_every_folding_is_converted(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "i int, statement string")
    got = {r.i: r.statement for r in convert(df, "sql_server", CurationConfig(mode="clean")).collect()}
    assert got == {i: r[1] for i, r in enumerate(ROWS)}


@pytest.mark.parametrize("mode", ["compat", "clean"])
def test_texts_without_the_words_are_spared(spark, mode):
    """Every regular expression of a plan stands behind a test, so a plan has no bare one as a column."""
    df = spark.createDataFrame([(1, "SELECT 1")], "ord int, statement string").withColumn("statement", F.concat("statement", F.lit("")))
    plan = fan_out(df, cfg=CurationConfig(mode=mode))._jdf.queryExecution().analyzed().toString()
    columns = [c for line in plan.splitlines() for c in line.split(", ") if " AS __sql_" in line]
    assert "regexp_replace(" in plan
    assert not [c for c in columns if c.lstrip("+- :[").startswith(("regexp_replace(", "Project [regexp_replace("))]
