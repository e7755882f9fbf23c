"""What templates tell over many runs, from sketches that merge: a run is read once, when it is curated.

A row for each template (or template and parameter) holds exact counts next to sketches of bounded size:
HyperLogLog for distinct counts, KLL for scores, frequent items for literals. Rows of any runs merge in one
aggregate, so a report over a year reads a row for each template and run and no raw record. ``mining`` has
the exact queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14  # HyperLogLog size: 2**14 registers, a standard error under 1 %
KLL_K = 400  # a rank is off by less than 1 % with this
ITEMS = 1000  # literals that the frequent-items sketch of a parameter tracks


def template_sketches(curated: DataFrame, run: int) -> DataFrame:
    """A run's row for each ``statement``: uses, first and last ``ord``, sketches of questions, databases and scores.

    Records with a null question, database or score count as uses only.
    """
    return curated.groupBy("statement").agg(
        F.lit(run).alias("run"),
        F.count("*").alias("uses"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.hll_sketch_agg("question", F.lit(LG_K)).alias("questions"),
        F.hll_sketch_agg("db_id", F.lit(LG_K)).alias("databases"),
        F.kll_sketch_agg_double(F.col("score").cast("double"), KLL_K).alias("scores"),
    )


def merge_template_sketches(rows: DataFrame, by: str | None = "statement") -> DataFrame:
    """Rows of any runs as one for each template, or one for everything (``by=None``)."""
    return rows.groupBy(*([by] if by else [])).agg(
        F.sum("uses").alias("uses"),
        F.min("first_ord").alias("first_ord"),
        F.max("last_ord").alias("last_ord"),
        F.hll_union_agg("questions").alias("questions"),
        F.hll_union_agg("databases").alias("databases"),
        F.kll_merge_agg_double("scores", KLL_K).alias("scores"),
    )


def template_estimates(rows: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Merged sketches as numbers: distinct questions and databases, and score percentiles ``p50`` and so on."""
    quantiles = [F.kll_sketch_get_quantile_double("scores", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares]
    kept = [c for c in ("statement",) if c in rows.columns]
    return rows.select(
        *kept, "uses", "first_ord", "last_ord",
        F.hll_sketch_estimate("questions").alias("questions"), F.hll_sketch_estimate("databases").alias("databases"), *quantiles,
    )


def literal_sketches(templates: DataFrame, run: int) -> DataFrame:
    """A run's row for each statement and parameter: uses, smallest, largest, sketches of distinct and of frequent literals."""
    each = templates.select("statement", F.posexplode("params").alias("pos", "p")).select("statement", "pos", "p.name", "p.example")
    return each.groupBy("statement", "pos", "name").agg(
        F.lit(run).alias("run"),
        F.count("*").alias("uses"),
        F.min("example").alias("least"),
        F.max("example").alias("most"),
        F.hll_sketch_agg("example", F.lit(LG_K)).alias("literals"),
        F.expr(f"approx_top_k_accumulate(example, {ITEMS})").alias("frequent"),
    )


def merge_literal_sketches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("statement", "pos", "name").agg(
        F.sum("uses").alias("uses"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.hll_union_agg("literals").alias("literals"),
        F.expr(f"approx_top_k_combine(frequent, {ITEMS})").alias("frequent"),
    )


def literal_estimates(rows: DataFrame, top: int = 3) -> DataFrame:
    """Merged sketches as numbers; ``frequent`` is an array of (item, count), most frequent first."""
    frequent = F.expr(f"approx_top_k_estimate(frequent, {top})")
    return rows.select("statement", "pos", "name", "uses", "least", "most", F.hll_sketch_estimate("literals").alias("literals"), frequent.alias("frequent"))
