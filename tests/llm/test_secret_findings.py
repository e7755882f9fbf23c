"""The forest of the secret scan: held-out findings, what stays, and its CASE expressions against Spark's own model."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sqlcorpus.llm import secrets

from .test_operators import SF, nothing, odd, session  # noqa: F401


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def words(docs):
    return secrets.frequent_words(docs, size=500)


def judged(findings, trees):
    vote = " + ".join(f"({t})" for t in trees)
    return findings.withColumn("p", F.expr(f"element_at(transform(array(x), f -> ({vote}) / {len(trees)}D), 1)"))


def test_held_out_findings(spark, words):
    """Values and contexts that were not learned from: precision and recall of both at least 0.9."""
    found = secrets.composed_findings(spark, words, each=80).cache()
    unseen = F.col("context") % 5 == 2
    trees = secrets.fit(found.filter((F.col("n") % 4 != 1) & ~unseen).select("x", "label"))
    got = judged(found, trees)
    for part in (got.filter((F.col("n") % 4 == 1) & ~unseen), got.filter(unseen)):
        tp, fp, fn = (part.filter(c).count() for c in ("p >= 0.5 AND label = 1", "p >= 0.5 AND label = 0", "p < 0.5 AND label = 1"))
        assert tp / (tp + fp) >= 0.9 and tp / (tp + fn) >= 0.9, (tp, fp, fn)


def test_expressions_equal_the_model(spark, words):
    found = secrets.composed_findings(spark, words, each=10).select("x", "label").cache()
    rows = found.withColumn("features", array_to_vector("x"))
    model = RandomForestClassifier(numTrees=secrets.TREES, maxDepth=secrets.DEPTH, seed=7, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)
    trees = secrets.trees_of(model.toDebugString)
    votes = [F.expr(f"element_at(transform(array(x), f -> {t}), 1)") for t in trees]
    # each tree alone, as Spark averages what the leaves hold and the text has the leaf's class
    for tree, vote in list(zip(model.trees, votes, strict=True))[:5]:
        assert tree.transform(rows).filter(vote != F.col("prediction")).count() == 0


def test_what_stays_and_what_goes(spark, docs):
    h, b = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "Zk3vQ9xPq7LmN2rT8sWb4YcD"
    cases = [
        ("token: /usr/local/lib/python3/site-packages/x1", False),
        (f"sha1: {h}", False),
        (f"commit {h} of main", False),
        ("id = 123e4567-e89b-12d3-a456-426614174000", False),
        (f'the token = "{h}" of', True),
        (f"Authorization: Bearer {b}\n", True),
        (f"the password is {b} today", True),
        (f"GET /a?access_token={h}&page=2", True),
    ]
    forest = secrets.learn(docs)
    assert set(secrets.PATH_WORDS) <= set(forest.words)
    got = secrets.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string"), forest).collect()
    assert {r.doc_id: "[secret]" in r.text for r in got} == {i: s for i, (_, s) in enumerate(cases)}


def test_dictionary_counts_all_documents(spark, nothing):
    docs = spark.createDataFrame([(1, "Alpha beta alpha"), (2, None), (3, ""), (4, "beta alpha gamma")], "doc_id int, text string")
    assert set(secrets.frequent_words(docs, size=2)) - set(secrets.PATH_WORDS) == {"alpha", "beta"}
    assert set(secrets.frequent_words(nothing)) == set(secrets.PATH_WORDS)
