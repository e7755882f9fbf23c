"""The thin queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chats, collocations, decontam, fingerprint, jaccard, langid, licenses, periods, pieces, private, quality, secrets
from .common import crc_mod, ship, stored, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Every phrase of one to five words, counted; then the cuts, the longer phrases and the ranks.
ORACLES["op12_collocations"] = r"""
WITH texts AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM texts
), grams AS (
    SELECT lang, width, array_to_string(words[start : start + width - 1], ' ') AS phrase
    FROM (SELECT lang, words, width, unnest(range(1, len(words) - width + 2)) AS start FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS width))
), counted AS MATERIALIZED (
    SELECT lang, width, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE width = 1 GROUP BY lang
), frequent AS MATERIALIZED (
    SELECT * FROM counted WHERE a >= 100
), candidates AS (
    SELECT lang, width, phrase, string_split(phrase, ' ') AS words, a FROM frequent WHERE width > 1
), parts AS (
    SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 : width], ' ') AS tail
    FROM (SELECT *, unnest(range(1, width)) AS k FROM candidates)
), cuts AS (
    SELECT p.lang, p.phrase, p.a, k, h.a AS l, t.a AS r, n, (1000::HUGEINT * p.a * n) // (h.a::HUGEINT * t.a) AS score
    FROM parts p JOIN frequent h ON h.lang = p.lang AND h.phrase = head
    JOIN frequent t ON t.lang = p.lang AND t.phrase = tail JOIN totals ON totals.lang = p.lang
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(words[s : s + m - 1], ' ') AS phrase, max(a) AS a
    FROM candidates, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS s) WHERE m < width AND s + m - 1 <= width GROUP BY ALL
), kept AS (
    SELECT * FROM lowest ANTI JOIN inside USING (lang, phrase, a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the rows whose crc32(doc_id) mod 4 is not 2; predicts every row."""
    docs, held_out = documents(spark, sf_dir), crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.select("doc_id", "text", "lang"), public_tokenizers.path(VOCABULARY), ~held_out)
    return langid.detect(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(documents(spark, sf_dir))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(stored(licenses.votes(documents(spark, sf_dir)), "license-votes"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows whose crc32(doc_id) mod 3 is not 1; scores every row."""
    measured = stored(quality.with_statistics(documents(spark, sf_dir)), "quality-statistics")
    held_out = crc_mod("doc_id", 3) == 1
    forest = quality.fit(measured, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(measured.withColumn("held_out", held_out), forest)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted")


@query
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key would come from a vault; a fixed one makes the results repeatable."""
    return private.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key="benchmark-key")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return secrets.scan(docs, secrets.learn(docs))


@query
def op10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op1_near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other rows each row links with, counted over all verified links."""
    return jaccard.link_counts(*jaccard.links_of(documents(spark, sf_dir))).select("doc_id", "n_shingles", "n_links")


@query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(documents(spark, sf_dir), public_tokenizers.path(PIECES))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_report(documents(spark, sf_dir))
