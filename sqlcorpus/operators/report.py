"""Corpus and run statistics: one-row or few-row aggregates with partial sums on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .curate import STATUSES, SUCCESS

# Statement words that a dataset profile counts, and its thresholds.
PROFILE_WORDS = ["SELECT", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "HAVING", "UNION", "WITH"]
FEATURE_SHARE, FEATURE_POINTS = 10, 15
HIGH, MEDIUM = 70, 40


def _word_name(word: str) -> str:
    return "n_" + word.lower().replace(" ", "_")


def dataset_profile(records: DataFrame, sql: str = "sql") -> DataFrame:
    """Size, statement length, feature counts and the 0-100 quality indicator of raw records.

    Only the field ``sql`` is looked at, whatever other names a record uses.
    """
    text = F.coalesce(F.col(sql), F.lit(""))
    u = F.upper(text)
    one = records.agg(
        F.count("*").alias("total_records"),
        F.count_if(text != "").alias("valid_sql"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"),
        *[F.count_if(u.contains(w)).alias(_word_name(w)) for w in PROFILE_WORDS],
    )
    total, valid = F.col("total_records"), F.col("valid_sql")
    counts = [F.col(_word_name(w)) for w in PROFILE_WORDS]
    features = sum([(c * FEATURE_SHARE > total).cast("int") for c in counts[1:]], (counts[0] * FEATURE_SHARE > total).cast("int"))
    share = F.when(total > 0, valid * F.lit(100.0) / total).otherwise(0.0)
    one = one.withColumn("indicator", F.least(F.lit(100.0), features * F.lit(float(FEATURE_POINTS)) + share))
    level = F.when(F.col("indicator") > HIGH, "High").when(F.col("indicator") > MEDIUM, "Medium").otherwise("Low")

    def percent(word: str) -> Column:
        return F.when(total > 0, F.floor(F.col(_word_name(word)) * 100 / total)).alias(
            _word_name(word).replace("n_", "pct_")
        )

    return one.select(
        "total_records",
        "valid_sql",
        F.when(valid > 0, F.floor(F.col("chars") / valid)).otherwise(F.lit(0)).alias("avg_sql_length"),
        *counts,
        *[percent(w) for w in ("WHERE", "JOIN", "GROUP BY", "ORDER BY")],
        F.col("indicator"),
        level.alias("level"),
    )


def run_statistics(curated: DataFrame) -> DataFrame:
    """One row: records per status, total, acceptance rate and mean score of the accepted."""
    is_success = F.col("status") == SUCCESS
    one = curated.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(is_success, F.col("score"))), F.lit(0.0)).alias("score_sum"),
    )
    rate = F.when(F.col(SUCCESS) > 0, F.col(SUCCESS) * 100.0 / F.col("total"))
    mean = F.when(F.col(SUCCESS) > 0, F.col("score_sum") / F.col(SUCCESS))
    return one.select(*STATUSES, "total", rate.alias("acceptance_rate"), mean.alias("average_quality"))


def label_distribution(curated: DataFrame) -> DataFrame:
    """Tools per label among the accepted, with their share, most frequent first.

    The number of accepted tools travels along as one more group (label null),
    so the share needs no second pass and no join.
    """
    accepted = curated.filter(F.col("status") == SUCCESS)
    exploded = accepted.select(
        "ord", F.explode(F.concat(F.col("labels"), F.array(F.lit(None).cast("string")))).alias("label")
    )
    counts = exploded.groupBy("label").agg(F.count("*").alias("tools"), F.min("ord").alias("first_ord"))
    # at most one row per label (23 of them), so one window partition is fine
    total = F.max(F.when(F.col("label").isNull(), F.col("tools"))).over(W.partitionBy())
    shares = counts.withColumn("share", F.col("tools") * 100.0 / total).filter(F.col("label").isNotNull())
    return shares.orderBy(F.desc("tools"), "first_ord").select("label", "tools", "share")


def run_result(viewer: DataFrame, records: DataFrame, input_file: str, output_file: str) -> DataFrame:
    """One row: what a viewer run read and made."""
    made = viewer.agg(F.lit(0).cast("long").alias("items_processed"), F.count("*").alias("tools_created"))
    read = records.agg(F.count("*").alias("items_processed"), F.lit(0).cast("long").alias("tools_created"))
    both = read.union(made)
    one = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    return one.select(
        F.lit(input_file).alias("input_file"),
        "items_processed",
        "tools_created",
        F.lit(output_file).alias("output_file"),
        F.lit("Real processing completed").alias("processing_time"),
    )
