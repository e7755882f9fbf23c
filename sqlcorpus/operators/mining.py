"""What a corpus of templates tells: support, literals, the best tool of each, scores, and binding.

All counts are exact. Hot templates are combined on the map side before anything is ranked, so
no window and no aggregate holds the raw rows of one template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .curate import SUCCESS

PLACEHOLDER = r"\{\{\.(\w+)\}\}"
STEP = 10  # width of a bar of the score histogram


def template_support(templates: DataFrame) -> DataFrame:
    """Per statement: uses, questions, databases, first and last ``ord``, and the first question."""
    return templates.groupBy("statement").agg(
        F.count("*").alias("uses"),
        F.count_distinct("question").alias("questions"),
        F.count_distinct("db_id").alias("databases"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.min_by("question", F.struct("ord", "question")).alias("example"),
    )


def literal_domains(templates: DataFrame, top: int = 3) -> DataFrame:
    """Per statement and parameter: uses, distinct literals, smallest, largest, and the ``top`` most frequent ones.

    Ties go to the smaller literal. Counting comes first; Spark then cuts each partition to
    ``top`` rows a parameter before it ranks them.
    """
    key = ["statement", "pos", "name"]
    each = templates.select("statement", F.posexplode("params").alias("pos", "p")).select("statement", "pos", "p.name", "p.example")
    counted = each.groupBy(*key, "example").agg(F.count("*").alias("n"))
    domains = counted.groupBy(*key).agg(
        F.sum("n").alias("uses"), F.count("example").alias("literals"), F.min("example").alias("least"), F.max("example").alias("most")
    )
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), F.asc("example")))
    best = counted.withColumn("rank", rank).filter(F.col("rank") <= top)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "example", "n"))), lambda r: F.concat_ws(" x", r["example"], r["n"].cast("string"))), "; ")
    return domains.join(best.groupBy(*key).agg(listed.alias("frequent")), key)


def best_per_template(curated: DataFrame) -> DataFrame:
    """One accepted record for each statement and database: the highest score, then the smallest ``ord``."""
    accepted = curated.filter(F.col("status") == SUCCESS)
    best = F.max_by(F.struct("ord", "question", "score"), F.struct("score", -F.col("ord")))
    return accepted.groupBy("statement", "db_id").agg(best.alias("b"), F.count("*").alias("tools")).select("statement", "db_id", "b.*", "tools")


def score_histogram(curated: DataFrame, step: int = STEP) -> DataFrame:
    """Records per bar of the score, with the share of all records up to and including the bar."""
    bar = (F.floor(F.col("score") / step) * step).cast("long")
    bars = curated.groupBy(bar.alias("bar")).agg(
        F.count("*").alias("records"), F.count_if(F.col("status") == SUCCESS).alias("accepted"), F.min("score").alias("least"), F.max("score").alias("most")
    )
    # a row for each bar, so one window partition is fine
    upto = F.sum("records").over(W.orderBy("bar")) * F.lit(100.0) / F.sum("records").over(W.partitionBy())
    return bars.withColumn("share_upto", upto)


def score_percentiles(curated: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99), stem: str = "p") -> DataFrame:
    """One row: records and exact percentiles of the score, ``p50`` and so on (``stem`` other than p: numbered)."""
    names = [f"p{round(100 * s)}" if stem == "p" else f"{stem}{i}" for i, s in enumerate(shares)]
    counted = curated.groupBy("score").agg(F.count("*").alias("n"))  # combined on the map side: a row for each score
    each = [F.expr(f"percentile(score, {float(s)!r}, n)").alias(c) for s, c in zip(shares, names, strict=True)]
    return counted.agg(F.sum("n").alias("records"), *each).select(*([] if stem != "p" else ["records"]), *names)


def own_bindings(params: Column, quoted: list[str]) -> Column:
    """The literals that a template was made from, by name; those of the kinds ``quoted`` in single quotes."""
    value = lambda p: F.when(p["kind"].isin(quoted), F.concat(F.lit("'"), p["example"], F.lit("'"))).otherwise(p["example"])
    first = F.array_distinct(F.transform(params, lambda p: p["name"]))
    return F.map_from_arrays(first, F.transform(first, lambda n: F.filter(F.transform(params, lambda p: F.struct(p["name"].alias("n"), value(p).alias("v"))), lambda x: x["n"] == n)[0]["v"]))


def bind(templates: DataFrame, bindings: DataFrame, key: str = "tool_id") -> DataFrame:
    """Templates with their placeholders filled in from ``bindings`` (``key``, map ``bindings``).

    Adds ``bound`` and ``missing``, the sorted names that no binding gives a value for; these
    placeholders stay. All are replaced in one go, so a value may look like a placeholder itself.
    """
    joined = templates.join(bindings.select(key, "bindings"), key, "left")
    names = F.regexp_extract_all("statement", F.lit(PLACEHOLDER), F.lit(1))
    value = lambda n: F.get(F.map_values(F.map_filter("bindings", lambda k, v: k == n)), F.lit(0))
    texts = F.transform(names, lambda n: F.coalesce(value(n), F.concat(F.lit("{{."), n, F.lit("}}"))))
    whole = F.array_join(F.zip_with(F.split("statement", PLACEHOLDER, -1), texts, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    missing = F.array_sort(F.array_distinct(F.filter(names, lambda n: value(n).isNull())))
    return joined.withColumns({"bound": whole, "missing": missing}).drop("bindings")
