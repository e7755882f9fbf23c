"""From raw documents to token digests: language, near copies, benchmark, secrets, tokens.

Each stage takes what the one before kept, written as Parquet and read again, and all but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcorpus.llm import bpe, decontam, jaccard, langid, secrets
from sqlcorpus.llm.common import crc_mod, fresh, ship, stored, table
from sqlcorpus.llm.queries import VOCABULARY

KEPT_STATES = 60_000  # of the encoder in each worker; the stages before leave the executors less room than a query of its own has
BATCH_ROWS = 1_000  # rows in an Arrow batch; Spark's 10,000 whole texts stand in an executor up to four times
LEAST_SCORE = 0.5  # posterior below which a language counts as unknown


def _ready(spark: SparkSession) -> None:
    """The package on the executors, and Arrow batches that fit whole texts; a smaller setting of the session's own stays."""
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of each row's text, which tells rows of one doc_id apart."""
    mark = fresh(docs.columns, "mark")
    return docs.withColumn(mark, F.xxhash64("text")), mark


def _narrow(marked: DataFrame, mark: str) -> DataFrame:
    return marked.select(F.struct("doc_id", F.col(mark).alias("mark")).alias("doc_id"), "text")


def _joined(marked: DataFrame, mark: str, names: DataFrame, how: str) -> DataFrame:
    """Rows of ``marked`` whose (doc_id, mark) is, or is not, in ``names``."""
    own = names.select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.mark").alias("__mark")).distinct()
    on = marked["doc_id"].eqNullSafe(own["__id"]) & (marked[mark] == own["__mark"])
    return marked.join(own, on, how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts among them, or of no language for sure, go; of a tie the first language counts."""
    _ready(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"), public_tokenizers.path(VOCABULARY), crc_mod("doc_id", 4) != 2)
    guess, score = fresh(docs.columns, "guess"), fresh(docs.columns, "sure")
    judged = langid.detect(docs, model, guess, score)
    return judged.filter((F.col(guess) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id, then of the smallest hash. Rows without words all stay."""
    _ready(spark)
    marked, mark = _marked(docs)
    found = jaccard.near_duplicates(_narrow(marked, mark))
    kept = _joined(marked, mark, found.filter(F.col("doc_id") == F.col("component_id")), "left_semi")
    worded = F.coalesce(F.length(F.regexp_replace("text", "[\\x20\\x09-\\x0D]", "")), F.lit(0)) > 0
    one = kept.filter(worded).dropDuplicates(["doc_id", mark])
    return one.select(*docs.columns).unionByName(docs.filter(~worded))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one word in twenty or more inside a benchmark phrase go.

    Null and empty texts have no words and stay; repeated rows are judged alike and all stay or go.
    """
    _ready(spark)
    marked, mark = _marked(docs)
    found = decontam.contamination(_narrow(marked, mark), table(spark, sf_dir, "benchmark")).filter(decontam.is_contaminated())
    # as a table its size is known before the join is planned: few ids are broadcast and no text is shuffled, many are not
    return _joined(marked, mark, stored(found.select("doc_id"), "contaminated"), "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, with its new length. Null texts stay null, repeated rows stay."""
    masked = secrets.scan(docs, secrets.learn(docs), columns_only=True)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each document; null and empty texts have no tokens."""
    _ready(spark)
    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, KEPT_STATES)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("tokens", tokens),
]

#: Language identification, the forest and the encoder are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
