"""Reading corpora: JSON lines, dataset dumps, streams and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CurationConfig
from ..functions.spots import sealed
from ..functions.text import strip
from ..operators.normalize import KNOWN_FIELDS, QUESTION_FIELDS, SQL_FIELDS

JSON_OPTIONS = {"allowSingleQuotes": "false"}
OBJECT, OTHER, BAD = "object", "other", "bad"


def parse_lines(lines: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Add ``kind`` and one string column per known field to rows with a JSON ``value``.

    ``kind`` tells objects, other JSON values and unparsable lines apart; blank
    lines are dropped. The value is parsed once, as the only element of an
    array: text behind an object makes the array invalid or longer.
    """
    fields = list(dict.fromkeys(KNOWN_FIELDS + (extra or [])))
    schema = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    lines = lines.withColumn("value", strip(F.col("value"))).filter(F.col("value") != "")
    v = F.col("value")
    wrapped = F.concat(F.lit("["), v, F.lit("]"))
    parsed = lines.withColumn(
        "__json", F.when(v.startswith("{") & v.endswith("}"), F.from_json(wrapped, schema, JSON_OPTIONS))
    )
    is_object = F.coalesce(F.size("__json") == 1, F.lit(False))
    plain = ~v.startswith("{") & ~v.startswith("'")
    is_other = plain & ((F.json_array_length(wrapped) == 1) | v.isin("NaN", "Infinity", "-Infinity"))
    kind = F.when(is_object, OBJECT).when(F.coalesce(is_other, F.lit(False)), OTHER).otherwise(BAD)
    parsed = parsed.withColumn("kind", kind)
    one = F.get("__json", F.lit(0))
    kept = [c for c in lines.columns]
    parsed = parsed.select(*kept, "kind", *[F.when(F.col("kind") == OBJECT, one[f]).alias(f) for f in fields])
    return sealed(parsed, "kind", *fields)


# A known field whose value is not a string, or any key written with an escape.
_ODD = (
    r'"(?:' + "|".join(dict.fromkeys(KNOWN_FIELDS)) + r')"[ \t]*:[ \t]*[^" \t]'
    r'|"[^"\\]*\\u[^"]*"[ \t]*:'
)


def _falsy(value: Column, kind: Column) -> Column:
    """JSON values that count as missing: null, false, 0, and empty text or containers."""
    zero = kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & (value.try_cast("double") == 0)
    return kind.isNull() | (kind == "VOID") | value.isin("", "false", "[]", "{}") | zero


def typed_fields(parsed: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Treat non-string values as the mode asks, and add ``bad_type``.

    Falsy values become null, so the next field name is tried. In compat mode a
    record whose chosen question or statement is not text is marked; clean mode
    takes its text. Only lines that look odd are parsed a second time.
    """
    known = list(dict.fromkeys(KNOWN_FIELDS))
    variants = T.ArrayType(T.StructType([T.StructField(f, T.VariantType()) for f in known]))
    odd = F.col("value").rlike(_ODD)
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    df = parsed.withColumn("__odd", F.get(F.when(odd, F.from_json(wrapped, variants, JSON_OPTIONS)), F.lit(0)))
    kinds = {f: F.when(F.col("__odd").isNotNull(), F.schema_of_variant(F.col("__odd")[f])) for f in known}
    df = df.withColumns({f"__k_{f}": k for f, k in kinds.items()})
    present = {
        f: F.when(F.col("__odd").isNull() | ~_falsy(F.col(f), F.col(f"__k_{f}")), F.nullif(F.col(f), F.lit("")))
        for f in known
    }
    df = df.withColumns(present)

    def not_text(names: list[str]) -> Column:
        kind = F.coalesce(*[F.when(F.col(f).isNotNull(), F.coalesce(F.col(f"__k_{f}"), F.lit("STRING"))) for f in names])
        return F.coalesce(kind != "STRING", F.lit(False))

    bad = (F.col("kind") == OTHER) | not_text(QUESTION_FIELDS) | not_text(SQL_FIELDS)
    bad = bad if not cfg.clean else F.col("kind") == OTHER
    df = df.withColumn("bad_type", bad).drop("__odd", *[f"__k_{f}" for f in known])
    return sealed(df, *known, "bad_type")


def corpus_from_lines(
    lines: DataFrame, cfg: CurationConfig = CurationConfig(), extra: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Raw records and rejects from rows with ``ord`` and a JSON ``value``.

    Records that are JSON but no object are kept and marked ``bad_type``; they end
    as errors. Unparsable lines are the rejects.
    """
    parsed = parse_lines(lines, extra)
    rejects = parsed.filter(F.col("kind") == BAD).select("ord", "value")
    records = typed_fields(parsed.filter(F.col("kind") != BAD), cfg).drop("value", "kind")
    return records, rejects


def read_lines(spark: SparkSession, path: str, position: str = "scan") -> DataFrame:
    """Text lines with their position ``ord``.

    ``scan`` numbers lines by reading order without a shuffle: increasing within a
    file, not dense. ``dense`` gives 0, 1, 2 ... over all files in path order, at the
    price of one shuffle.
    """
    lines = spark.read.text(path)
    if position == "scan":
        return lines.withColumn("ord", F.monotonically_increasing_id())
    lines = lines.select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__line"),
    )
    return _dense(lines)


def _dense(lines: DataFrame) -> DataFrame:
    """Positions from (file, split start, line in split): splits are the buckets."""
    from pyspark.sql import Window as W

    split = ["__file", "__start"]
    sizes = lines.groupBy(*split).agg(F.count("*").alias("__rows"))
    # one row per file split, first summed per file, then over files
    files = sizes.groupBy("__file").agg(F.sum("__rows").alias("__all"))
    past = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("__file", F.coalesce(F.sum("__all").over(past), F.lit(0)).alias("__skip"))
    inside = W.partitionBy("__file").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__inner", F.coalesce(F.sum("__rows").over(inside), F.lit(0)))
    offsets = sizes.join(files, "__file").select(*split, (F.col("__skip") + F.col("__inner")).alias("__offset"))
    rank = F.row_number().over(W.partitionBy(*split).orderBy("__line"))
    ranked = lines.withColumn("__rank", rank)
    return ranked.join(offsets, split).select(
        "value", (F.col("__offset") + F.col("__rank") - 1).cast("long").alias("ord")
    )


def read_corpus(
    spark: SparkSession,
    path: str,
    cfg: CurationConfig = CurationConfig(),
    position: str = "scan",
    extra: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of JSON-lines files."""
    return corpus_from_lines(read_lines(spark, path, position), cfg, extra)


def read_dump(spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None, **options) -> DataFrame:
    """A downloaded dataset dump; ``split`` picks one value of its ``split`` column or partition."""
    df = spark.read.format(fmt).options(**options).load(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())


def read_dump_stream(spark: SparkSession, path: str, schema, fmt: str = "json", **options) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


# --- exported catalogues ---------------------------------------------------------

# A tool starts at two blanks and a quoted key; all its other lines are indented further, and quoted
# text holds no line end. So a file can be cut at this text wherever a task's share of it begins.
TOOL_START = '\n  "'
_SCALARS = ["kind", "source", "statement", "description", "sql", "quality_score", "labels", "db_id"]
_PARAMETER = r"\n    - name: (.*)\n      type: (.*)\n      description: (.*)"


def read_catalogue_yaml(spark: SparkSession, path: str, viewer: bool = False) -> DataFrame:
    """An exported YAML catalogue (one file or a folder of parts) as tools, with their position ``ord`` from 0.

    Files are split between tasks at the tools' key lines, whatever their size, and blocks are parsed by column
    expressions. Other fields of a block are left out; a field that it lacks is null, missing parameters are an
    empty array. The rows can be searched or merged into a catalogue like those of a run.
    """
    blocks = spark.read.option("lineSep", TOOL_START).text(path).select(
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__line"),
        F.regexp_replace("value", r"^(?:tools:\n)?  \"", "").alias("value"),
    )
    blocks = _dense(blocks.filter(F.col("value").rlike(r'^(?:[^"\\]|\\.)*":')))

    def text(raw: Column) -> Column:
        return F.from_json(F.concat(F.lit('{"v":'), F.nullif(raw, F.lit("")), F.lit("}")), "v string")["v"]

    def field(name: str) -> Column:
        return text(F.regexp_extract("value", rf"\n    {name}: (.*)", 1)).alias(name)

    named = "parameters" if viewer else "templateParameters"
    item = [F.regexp_extract_all("value", F.lit(_PARAMETER), F.lit(i)) for i in (1, 2, 3)]
    objects = F.transform(F.arrays_zip(*[i.alias(n) for i, n in zip(item, "ntd", strict=True)]), lambda p: F.concat(
        F.lit('{"name":'), p["n"], F.lit(',"type":'), p["t"], F.lit(',"description":'), p["d"], F.lit("}")))
    params = F.from_json(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")), "array<struct<name: string, type: string, description: string>>")
    key = text(F.concat(F.lit('"'), F.regexp_extract("value", r'^((?:[^"\\]|\\.)*")', 1))).alias("tool_key")
    fields = ["description", "sql", "quality_score", "labels", "db_id", "source"] if viewer else ["kind", "source", "statement", "description"]
    tools = blocks.select(key, "ord", *[field(f) for f in fields if f in _SCALARS], params.alias(named))
    return tools.withColumn("quality_score", F.col("quality_score").cast("double")) if viewer else tools
