"""Queries that read curated rows several times compute them once."""

import datetime

import pytest
from pyspark.sql import functions as F

from sqlcorpus.plans import queries as P


@pytest.mark.parametrize("name", ["literals_across_runs", "score_percentiles"])
def test_templates_are_computed_once(spark, tmp_path, monkeypatch, name):
    day = datetime.date(2020, 1, 2)
    orders = [(k, k % 5, "O", 10.5 + k, day, "1-URGENT") for k in range(36)]
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    spark.createDataFrame(orders, kind).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "AUTO") for k in range(5)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    seen = spark.sparkContext.accumulator(0)

    def read(sql):
        seen.add(1)
        return sql

    records = P.order_records
    counted = F.udf(read, "string").asNondeterministic()
    monkeypatch.setattr(P, "order_records", lambda spark, sf: records(spark, sf).withColumn("sql", counted("sql")))
    assert P.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert seen.value == 36
