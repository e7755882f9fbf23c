"""Records to tools: template, score, status and the two tool layouts.

Everything here is a narrow, stateless plan: one stage over the corpus however
large it is, the same for batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CurationConfig, dialect_of
from ..functions import labels as L
from ..functions import quality as Q
from ..functions import validate as V
from ..functions.dialects import convert, named_parameters
from ..functions.spots import sealed
from ..functions.templates import extract_templates

SUCCESS, EMPTY_SQL, QUALITY_ISSUES = "success", "empty_sql", "quality_issues"
LOW_SCORE, HIGH_SCORE, ERROR = "low_score", "high_score", "error"
STATUSES = [SUCCESS, EMPTY_SQL, QUALITY_ISSUES, LOW_SCORE, HIGH_SCORE, ERROR]


def _templates(df: DataFrame, cfg: CurationConfig) -> DataFrame:
    if cfg.use_parameterization:
        return extract_templates(df, cfg)
    none = F.from_json(F.lit("[]"), "array<struct<name:string,type:string,description:string,kind:string,example:string>>")
    return df.withColumns({"statement": F.col("sql"), "params": none})


def validate(df: DataFrame, cfg: CurationConfig, min_score: float | None = None) -> DataFrame:
    """Add ``breakdown``, ``score``, ``reason`` and ``is_valid`` to templates.

    The score of a template that an early rule turns down is 0.
    """
    least = cfg.min_quality_score if min_score is None else min_score
    st, params, q = F.col("statement"), F.col("params"), F.col("question")
    df = df.withColumn("early", V.early_reason(st, F.col("sql"), params, q, cfg))
    df = df.withColumn("breakdown", Q.score_breakdown(st, params, q, cfg))
    df = df.withColumn("score", F.when(F.col("early").isNull(), Q.total_score(F.col("breakdown"))).otherwise(0.0))
    low = F.when(F.col("score") < least, V.low_score_reason(F.col("score"), F.col("breakdown")))
    df = df.withColumn("reason", F.coalesce(F.col("early"), low, F.lit(""))).drop("early")
    return df.withColumn("is_valid", F.col("reason") == "")


def _failed(df: DataFrame) -> Column:
    return F.col("bad_type") if "bad_type" in df.columns else F.lit(False)


def with_status(df: DataFrame, cfg: CurationConfig = CurationConfig()) -> DataFrame:
    """Templates, scores and the ``status`` every record of a run ends with."""
    failed = _failed(df)
    df = validate(_templates(df, cfg), cfg)
    status = (
        F.when(failed, F.lit(ERROR))
        .when(F.col("sql") == "", F.lit(EMPTY_SQL))
        .when(F.size("params") < cfg.min_params, F.lit(LOW_SCORE))
        .when(F.col("reason").startswith(V.LOW_SCORE), F.lit(LOW_SCORE))
        .when(~F.col("is_valid"), F.lit(QUALITY_ISSUES))
        .when(F.col("score") > cfg.max_quality_score, F.lit(HIGH_SCORE))
        .otherwise(F.lit(SUCCESS))
    )
    df = df.withColumn("status", status).drop("is_valid")
    return sealed(df, "score", "breakdown", "reason", "status")


def curate(df: DataFrame, cfg: CurationConfig = CurationConfig()) -> DataFrame:
    """Normalised records to curated rows; keep ``status = 'success'`` for the catalogue."""
    df = with_status(df, cfg)
    st, sql, q = F.col("statement"), F.col("sql"), F.col("question")
    df = df.withColumn("labels", L.label_array(sql))
    df = df.withColumn("tool_name", L.tool_name(st, cfg))
    return df.withColumns(
        {
            "tool_key": L.tool_key(F.col("tool_name"), sql, q, cfg.digits),
            "tool_id": L.tool_id(F.col("tool_name"), sql, q),
            "description": L.with_labels(L.semantic_description(st, F.col("params")), F.col("labels")),
        }
    )


def plain_params(params: Column) -> Column:
    """Parameters in their published form: name, type, description."""
    return F.transform(params, lambda p: F.struct(p["name"], p["type"], p["description"]))


def catalogue_layout(curated: DataFrame, cfg: CurationConfig = CurationConfig()) -> DataFrame:
    """Accepted rows as catalogue tools (order kept in ``ord``); ``tool_id`` tells them apart, ``tool_key`` shows them."""
    return curated.filter(F.col("status") == SUCCESS).select(
        "tool_key",
        "ord",
        F.lit(cfg.kind).alias("kind"),
        F.lit(cfg.source_name).alias("source"),
        "statement",
        "description",
        plain_params(F.col("params")).alias("templateParameters"),
        "tool_id",
    )


def create_tools(df: DataFrame, cfg: CurationConfig = CurationConfig()) -> DataFrame:
    """Records straight to catalogue tools.

    Column parameterisation is always on for this entry point in compat mode.
    """
    if not cfg.clean:
        cfg = cfg.but(parameterize_columns=True, min_params=0, max_quality_score=float("inf"))
    return catalogue_layout(curate(df, cfg), cfg)


def curate_viewer(df: DataFrame, cfg: CurationConfig = CurationConfig()) -> DataFrame:
    """Records with statement and question as viewer tools, in the target dialect.

    Labels and score are those of the converted template. Unless the threshold
    applies, every such record becomes a tool. Number the rows with
    ``number_tools`` to name them.
    """
    dialect = dialect_of(cfg.dialect)
    df = df.filter(~_failed(df) & (F.col("sql") != "") & (F.col("question") != ""))
    df = _templates(df, cfg)
    if dialect != "mysql":
        df = convert(df, dialect, cfg)
    labelled = L.without_placeholders(F.col("statement")) if cfg.clean else F.col("statement")
    labels = L.label_array(labelled) if cfg.use_labeling else F.array().cast("array<string>")
    score = F.lit(100.0)
    if cfg.use_quality_scoring:
        df = df.withColumn("breakdown", Q.score_breakdown(F.col("statement"), F.col("params"), F.col("question"), cfg))
        score = Q.total_score(F.col("breakdown"))
    df = df.withColumns({"quality_score": score, "labels": L.labels_text(labels)})
    if cfg.viewer_threshold:
        df = df.filter(F.col("quality_score") >= cfg.min_quality_score)
    params = named_parameters(F.col("params")) if dialect == "sql_server" else plain_params(F.col("params"))
    return df.select(
        "ord",
        F.col("question").alias("description"),
        F.col("statement").alias("sql"),
        params.alias("parameters"),
        "quality_score",
        "labels",
        "db_id",
        "source",
    )
