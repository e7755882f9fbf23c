"""The registered queries: every operator over the test tables, whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLEAN, CurationConfig
from ..functions import labels as L
from ..functions import quality as Q
from ..functions import templates as T
from ..functions.dialects import fan_out
from ..operators import detect as D
from ..operators.catalogue import as_export_rows
from ..operators.curate import SUCCESS, catalogue_layout, create_tools, curate, curate_viewer, validate, with_status
from ..operators.mining import best_per_template, bind, literal_domains, own_bindings, score_histogram, score_percentiles, template_support
from ..operators.nearest import build_vectors, nearest, probes_for
from ..operators.normalize import (
    datasets_clean,
    normalize,
    normalize_detected,
    normalize_with_profile,
    profile_for,
)
from ..operators.numbering import number_tools, split_batch
from ..operators.report import dataset_profile, label_distribution, run_result, run_statistics
from ..operators.retrieve import build_index, search
from ..operators.search import preview, record_preview, search_catalogue, search_datasets, tool_details
from ..operators.sketches import (
    literal_estimates,
    literal_sketches,
    merge_literal_sketches,
    merge_template_sketches,
    template_estimates,
    template_sketches,
)
from ..session import work_folder
from ..sources.corpus import corpus_from_lines, read_catalogue_yaml, read_dump, read_dump_stream
from ..sources.sinks import catalogue_yaml, read_dialect, rewrite_dialects, settings_of, summary_text, write_catalogue_json, write_catalogue_yaml, write_corpus, write_dialects
from ..sources.store import load_catalogue, upsert_catalogue
from ..streaming.jobs import curate_stream, deduplicated, read_counts, status_counts, write_counts
from .corpora import dealt, event_lines, event_records, odd_lines, order_records, scan

Query = Callable[[SparkSession, str], DataFrame]

COMPAT_CFG, CLEAN_CFG = CurationConfig(), CurationConfig(mode=CLEAN)
BATCH = 400
TOP = 10
SHARES = (0.5, 0.9, 0.99)
QUOTED = ["literal"]  # kinds of parameters that stand in quotes


def _events(spark: SparkSession, sf: str, cfg: CurationConfig = COMPAT_CFG) -> DataFrame:
    records, _ = corpus_from_lines(event_lines(spark, sf), cfg)
    return normalize(records)


def _pairs(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit("="), p["description"])), "; ")


def _names(params: Column) -> Column:
    return F.array_join(params["name"], ",")


def corpus_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).drop("bad_type")


def corpus_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_from_lines(event_lines(spark, sf))[1]


def odd_lines_status(cfg: CurationConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        records, rejects = corpus_from_lines(odd_lines(spark, sf), cfg)
        kept = with_status(normalize(records), cfg).select("ord", "status", "question", "sql")
        lost = rejects.select("ord", F.lit("rejected").alias("status"), F.lit("").alias("question"), F.lit("").alias("sql"))
        return kept.unionByName(lost)

    return run


def one_pass(step) -> Query:
    """A single template pass over the orders corpus."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return T.extract_templates(order_records(spark, sf), passes=[step]).select(
            "ord", "statement", _names(F.col("params")).alias("params")
        )

    return run


def templates(source: str, cfg: CurationConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _events(spark, sf, cfg) if source == "events" else order_records(spark, sf)
        return T.extract_templates(df, cfg).select("ord", "statement", _names(F.col("params")).alias("params"))

    return run


def template_params(spark: SparkSession, sf: str) -> DataFrame:
    df = T.extract_templates(order_records(spark, sf)).select("ord", F.posexplode("params").alias("pos", "p"))
    return df.select("ord", "pos", "p.name", "p.type", "p.description", "p.kind", "p.example")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    df = order_records(spark, sf).select("ord", L.label_array(F.col("sql")).alias("labels"))
    return df.select("ord", L.labels_text(F.col("labels")).alias("labels"))


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return label_distribution(curate(order_records(spark, sf)))


def tool_names(cfg: CurationConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return curate(order_records(spark, sf), cfg).select("ord", "tool_name", "tool_key")

    return run


def tool_description(spark: SparkSession, sf: str) -> DataFrame:
    return curate(order_records(spark, sf)).select("ord", "description")


def quality_scores(cfg: CurationConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = T.extract_templates(order_records(spark, sf), cfg)
        df = df.withColumn("b", Q.score_breakdown(F.col("statement"), F.col("params"), F.col("question"), cfg))
        return df.select("ord", "b.*", Q.total_score(F.col("b")).alias("score"))

    return run


def question_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Description score of whole document texts."""
    docs = dealt(scan(spark, sf, "documents"))
    return docs.select("doc_id", Q.description_score(F.col("text")).alias("score"))


def validation_status(cfg: CurationConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return with_status(_events(spark, sf, cfg), cfg).select("ord", "status", "reason", "score")

    return run


def statistics(cfg: CurationConfig) -> Query:
    return lambda spark, sf: run_statistics(with_status(_events(spark, sf, cfg), cfg))


def curate_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    tools = catalogue_layout(curate(order_records(spark, sf)))
    return tools.withColumn("templateParameters", _pairs(F.col("templateParameters"))).drop("tool_id")


def created_tools(spark: SparkSession, sf: str) -> DataFrame:
    tools = create_tools(_events(spark, sf))
    return tools.select("ord", "tool_key", "kind", "source", "statement", F.size("templateParameters").alias("n_params"))


def viewer(cfg: CurationConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return curate_viewer(order_records(spark, sf), cfg).withColumn("parameters", _names(F.col("parameters")))

    return run


def sql_server_names(spark: SparkSession, sf: str) -> DataFrame:
    df = curate_viewer(order_records(spark, sf), CurationConfig(dialect="mssql"))
    return df.select("ord", F.array_join(F.col("parameters")["_sql_server_name"], ",").alias("server_names"))


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_profile(corpus_from_lines(event_lines(spark, sf))[0])


def profile_orders(spark: SparkSession, sf: str) -> DataFrame:
    return dataset_profile(order_records(spark, sf))


def batch_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first records as one batch, the remaining ones next to it; together all of them."""
    batch, rest = split_batch(_events(spark, sf), BATCH)
    parts = [d.select("ord", F.lit(name).alias("part")) for d, name in ((batch, "batch"), (rest, "remaining"))]
    return parts[0].unionByName(parts[1])


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """Run 1 in compat mode, run 2 in clean mode over the same records."""
    path = work_folder(spark, "catalogue")
    for cfg in (COMPAT_CFG, CLEAN_CFG.but(key_digits=4)):
        upsert_catalogue(spark, catalogue_layout(curate(_events(spark, sf, cfg), cfg)), path)
    return load_catalogue(spark, path)


def catalogue_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select("tool_key", "statement", "first_run", "first_ord", "last_run")


def catalogue_identity(spark: SparkSession, sf: str) -> DataFrame:
    """How many tools two merged runs leave; the oracle counts names, statements and questions unhashed."""
    return _merged(spark, sf).agg(F.count("*").alias("tools"), F.count_distinct("tool_id").alias("identities"))


def catalogue_yaml_blocks(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "catalogue")
    upsert_catalogue(spark, catalogue_layout(curate(order_records(spark, sf))), path)
    return catalogue_yaml(load_catalogue(spark, path))


def _viewer_tools(spark: SparkSession, sf: str, cfg: CurationConfig = COMPAT_CFG) -> DataFrame:
    return number_tools(curate_viewer(order_records(spark, sf), cfg))


def numbered_tools(spark: SparkSession, sf: str) -> DataFrame:
    return number_tools(curate_viewer(_events(spark, sf)), "r1").select("ord", "tool_key")


def catalogue_search(spark: SparkSession, sf: str) -> DataFrame:
    return search_catalogue(_viewer_tools(spark, sf), "Group")


def catalogue_search_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A text that only the shown parameter count has."""
    return search_catalogue(_viewer_tools(spark, sf), "3 PARAM")


def catalogue_preview(spark: SparkSession, sf: str) -> DataFrame:
    return preview(_viewer_tools(spark, sf))


def details(spark: SparkSession, sf: str) -> DataFrame:
    return tool_details(_viewer_tools(spark, sf))


def dataset_preview(spark: SparkSession, sf: str) -> DataFrame:
    docs = dealt(scan(spark, sf, "documents")).withColumnRenamed("doc_id", "ord")
    return record_preview(docs, ["text", "lang", "source", "n_chars"])


def export_csv_layout(spark: SparkSession, sf: str) -> DataFrame:
    return as_export_rows(_viewer_tools(spark, sf, CurationConfig(dialect="postgres")))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = corpus_from_lines(event_lines(spark, sf))
    result = run_result(curate_viewer(normalize(records)), records, "events.jsonl", "tools.yaml")
    return summary_text(result, settings_of(COMPAT_CFG))


def dialects(cfg: CurationConfig) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = T.extract_templates(order_records(spark, sf), cfg).select("ord", "statement")
        return fan_out(df, cfg=cfg)

    return run


def plain_dialects(spark: SparkSession, sf: str) -> DataFrame:
    """Statements as they are, so literal paging and dates are rewritten."""
    return fan_out(order_records(spark, sf).select("ord", F.col("sql").alias("statement")))


def field_scores(spark: SparkSession, sf: str) -> DataFrame:
    return D.field_table(event_records(spark, sf)).drop("pos")


def field_detection(spark: SparkSession, sf: str) -> DataFrame:
    """The detected fields of three tables: all records, first record only, and conversations."""
    events = event_records(spark, sf)
    talk = dealt(scan(spark, sf, "conversations")).withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    runs = [
        ("events", D.detect_fields(events)),
        ("first_event", D.detect_fields(events, sample="first")),
        ("conversations", D.detect_fields(talk, ["role", "text"])),
    ]
    out = None
    for name, df in runs:
        df = df.select(F.lit(name).alias("corpus"), "sql_field", "question_field")
        out = df if out is None else out.unionByName(df)
    return out


def text_field_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Both field scores of every document text and every conversation turn."""
    docs = dealt(scan(spark, sf, "documents")).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    talk = dealt(scan(spark, sf, "conversations")).select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text"
    )
    name, value = F.lit("text"), F.col("text")
    return docs.unionByName(talk).select(
        "id",
        D.sql_field_score(name, value).cast("long").alias("sql_score"),
        D.question_field_score(name, value).cast("long").alias("question_score"),
    )


def validity(spark: SparkSession, sf: str) -> DataFrame:
    """Which templates any early rule turns down, whatever their score."""
    checked = validate(T.extract_templates(_events(spark, sf)), COMPAT_CFG, min_score=0)
    return checked.select("ord", "is_valid", "reason")


def corpus_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Order records written as JSON lines; one split of them is read back as a dump."""
    path = work_folder(spark, "corpus")
    split = F.when(F.col("ord") % 4 == 0, "test").otherwise("train")
    write_corpus(order_records(spark, sf).withColumn("split", split), path)
    return read_dump(spark, path, "json", "test").select("ord", "question", "sql", "db_id", "source")


def catalogue_json(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue written as JSON lines and read back."""
    path = work_folder(spark, "catalogue")
    upsert_catalogue(spark, catalogue_layout(curate(order_records(spark, sf))), path)
    write_catalogue_json(load_catalogue(spark, path), f"{path}-json")
    rows = spark.read.json(f"{path}-json")
    return rows.select("tool_key", "kind", "source", "statement", "description", _pairs(F.col("templateParameters")).alias("templateParameters"))


def catalogue_import(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue exported as YAML and read back, with its order."""
    path = work_folder(spark, "catalogue")
    upsert_catalogue(spark, catalogue_layout(curate(order_records(spark, sf))), path)
    write_catalogue_yaml(load_catalogue(spark, path), f"{path}-yaml")
    tools = read_catalogue_yaml(spark, f"{path}-yaml")
    return tools.withColumn("templateParameters", _pairs(F.col("templateParameters")))


def dialect_store(spark: SparkSession, sf: str) -> DataFrame:
    """Templates by dialect in a folder; SQLite's are then written anew in clean mode, and two dialects read back."""
    path = work_folder(spark, "dialects")
    templates = lambda cfg: T.extract_templates(order_records(spark, sf), cfg).select("ord", "statement")
    write_dialects(fan_out(templates(COMPAT_CFG)), path)
    rewrite_dialects(fan_out(templates(CLEAN_CFG), ("sqlite",), CLEAN_CFG), path)
    return read_dialect(spark, path, "sqlite").unionByName(read_dialect(spark, path, "postgresql"))


def stream_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of JSON files into a catalogue, stopped and started again after half of the records."""
    home = work_folder(spark, "stream-catalogue")
    lines = event_lines(spark, sf).select("ord", "value")
    middle = lines.agg((F.max("ord") / 2).cast("long")).first()[0]
    for half in (F.col("ord") <= middle, F.col("ord") > middle):
        write_corpus(lines.filter(half), f"{home}/in", mode="append")
        stream = read_dump_stream(spark, f"{home}/in", "ord long, value string")
        curate_stream(stream, f"{home}/catalogue", f"{home}/checkpoint").awaitTermination()
    return load_catalogue(spark, f"{home}/catalogue").select("tool_key", "statement", "first_ord")


def _two_runs(spark: SparkSession, sf: str, make: Callable[[DataFrame, int], DataFrame], df: DataFrame) -> DataFrame:
    """Sketches of two runs over the odd and the even records, stored and read back."""
    path = work_folder(spark, "sketches")
    for run in (0, 1):
        make(df.filter(F.pmod("ord", F.lit(2)) == run), run).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows that a query reads several times, computed once."""
    path = work_folder(spark, "written")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def support_across_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Template support from merged sketches, and whether it is within 3 % of the exact counts."""
    df = _written(spark, with_status(order_records(spark, sf)).select("ord", "statement", "question", "db_id", "score"))
    found = template_estimates(merge_template_sketches(_two_runs(spark, sf, template_sketches, df)))
    exact = template_support(df).select("statement", F.col("questions").alias("q"), F.col("databases").alias("d"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b) + 0.5
    return found.join(exact, "statement").select("statement", "uses", "first_ord", "last_ord", close("questions", "q").alias("questions_close"), close("databases", "d").alias("databases_close"))


def literals_across_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Literal domains from merged sketches, and whether distinct literals are within 3 % of the exact count."""
    params = F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["example"].alias("example"))).alias("params")
    df = _written(spark, T.extract_templates(order_records(spark, sf)).select("ord", "statement", params))
    found = literal_estimates(merge_literal_sketches(_two_runs(spark, sf, literal_sketches, df)), 1)
    exact = literal_domains(df).select("statement", "pos", "name", F.col("literals").alias("n"))
    close = F.abs(F.col("literals") - F.col("n")) <= 0.03 * F.col("n") + 0.5
    return found.join(exact, ["statement", "pos", "name"]).select("statement", "pos", "name", "uses", "least", "most", close.alias("literals_close"))


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Score percentiles of all records: exact, and whether the merged sketch is within two points of rank of them."""
    df = _written(spark, with_status(order_records(spark, sf)).select("ord", "statement", "question", "db_id", "score"))
    exact = score_percentiles(df)
    found = template_estimates(merge_template_sketches(_two_runs(spark, sf, template_sketches, df), None))
    wide = score_percentiles(df, tuple(x for s in SHARES for x in (max(0.0, s - 0.02), min(1.0, s + 0.02))), "b").first()
    near = reduce(and_, [F.col(f"s.p{round(100 * s)}").between(wide[2 * i], wide[2 * i + 1]) for i, s in enumerate(SHARES)])
    one = lambda d, a: d.withColumn("one", F.lit(1)).alias(a)  # noqa: E731  a row each
    return one(exact, "e").join(one(found, "s"), "one").select("e.records", *[f"e.p{round(100 * s)}" for s in SHARES], near.alias("sketch_near"))


def profile_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = event_records(spark, sf)
    named = raw.withColumn("query", F.coalesce("query", "gold_sql", "sql"))  # a dump of this dataset calls it so
    return normalize_with_profile(named, profile_for("spider"))


def spider_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under the field names of a known dataset, normalised by its profile."""
    raw = order_records(spark, sf).select(
        "ord", F.col("question").alias("sql_prompt"), "sql", F.col("db_id").alias("domain")
    )
    return normalize_with_profile(raw, profile_for("gretelai/synthetic_text_to_sql"))


def detected_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = event_records(spark, sf)
    found = D.detect_fields(raw).first()  # two field names
    return normalize_detected(raw, found.question_field, found.sql_field)


def fallback_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_detected(event_records(spark, sf), None, None)


def dataset_ids(spark: SparkSession, sf: str) -> DataFrame:
    pages = scan(spark, sf, "pages")
    hub = F.concat(F.lit("https://huggingface.co/datasets/org"), F.col("page_id") % 7, F.lit("/set-"), F.col("page_id"), F.lit("?library=x#top"))
    plain = F.concat(F.lit(" /org_"), F.col("page_id"), F.lit("/re.po-/ "))
    ref = (
        F.when(F.col("page_id") % 3 == 0, hub).when(F.col("page_id") % 3 == 1, plain).otherwise(F.col("url"))
    )
    return datasets_clean(pages.select("page_id", ref.alias("ref")), "ref").drop("ref")


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(scan(spark, sf, "documents")).select("doc_id", L.slug(F.col("text")).alias("slug"))


def datasets_top20(spark: SparkSession, sf: str) -> DataFrame:
    """Document sources as a dataset table: name, access flag and downloads."""
    meta = scan(spark, sf, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("downloads"))
    meta = meta.select(
        F.concat_ws("/", "lang", "source").alias("name"), F.lit("false").alias("description"), "downloads"
    )
    return search_datasets(meta, "SRC1", 20)


def stream_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Status counts per hour from a file stream of events, run until it has caught up."""
    schema = scan(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    counts = status_counts(event_records(spark, sf, events))
    out = work_folder(spark, "status-counts")
    write_counts(counts, f"{out}/counts", f"{out}/checkpoint", mode="update").awaitTermination()
    return read_counts(spark, f"{out}/counts", ["window_start", "status"])


def stream_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Status counts of the hours that the watermark (ten minutes late) has closed, in append mode."""
    events = spark.readStream.schema(scan(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    counts = status_counts(event_records(spark, sf, events))
    counts = counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))
    out = work_folder(spark, "closed-windows")
    write_counts(counts, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/counts")


def batch_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status_counts(event_records(spark, sf), window="1 day")


def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Which statements a stream of events holds; repeated ones within an hour are suppressed."""
    events = spark.readStream.schema(scan(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    records = normalize(event_records(spark, sf, events), "ts")
    kept = deduplicated(records, ["sql", "question"], "1 hour").select("sql", "question")
    out = work_folder(spark, "deduplicated")
    write_counts(kept, f"{out}/kept", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{out}/kept")


def support(spark: SparkSession, sf: str) -> DataFrame:
    return template_support(T.extract_templates(order_records(spark, sf)))


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return literal_domains(T.extract_templates(order_records(spark, sf)))


def best_tools(spark: SparkSession, sf: str) -> DataFrame:
    return best_per_template(with_status(order_records(spark, sf)))


def histogram(cfg: CurationConfig) -> Query:
    return lambda spark, sf: score_histogram(with_status(order_records(spark, sf), cfg))


def bind_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Every order template bound to the literals it was made from: the statement comes back."""
    df = T.extract_templates(order_records(spark, sf), CLEAN_CFG).select("ord", "statement", "params")
    own = df.select("ord", own_bindings(F.col("params"), QUOTED).alias("bindings"))
    bound = bind(df.select("ord", "statement"), own, "ord")
    return bound.select("ord", "bound", F.array_join("missing", ",").alias("missing"))


def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best tools of the orders catalogue for the question of each event record."""
    tools = curate(order_records(spark, sf)).filter(F.col("status") == SUCCESS)
    index = work_folder(spark, "tool-index")
    build_index(tools.select("ord", F.concat_ws(" ", "question", "description").alias("text")), index, "ord", "text")
    found = search(spark, index, _events(spark, sf).select("ord", "question"), TOP, "ord")
    return found.withColumnRenamed("id", "tool_ord")


def retrieve_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents that have most in common with each benchmark text."""
    index = work_folder(spark, "document-index")
    build_index(scan(spark, sf, "documents"), index, "doc_id", "text")
    return search(spark, index, scan(spark, sf, "benchmark"), TOP, "item_id", "text").withColumnRenamed("id", "doc_id")


def _vector_index(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The index over all vectors, and as queries those whose id is divisible by 20."""
    vectors, index = scan(spark, sf, "embeddings"), work_folder(spark, "vector-index")
    build_vectors(vectors, index)
    return index, vectors.filter(F.col("vec_id") % 20 == 0)


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    index, asked = _vector_index(spark, sf)
    return nearest(spark, index, asked, TOP)


def nearest_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a probed search finds nine tenths of what the exact one does."""
    index, asked = _vector_index(spark, sf)
    exact, probed = nearest(spark, index, asked, TOP), nearest(spark, index, asked, TOP, probes=probes_for(spark, index, asked, TOP))
    hit = exact.select("vec_id", "id").join(probed.select("vec_id", "id", F.lit(1).alias("found")), ["vec_id", "id"], "left")
    return hit.agg(F.count_distinct("vec_id").alias("queries"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


QUERIES: dict[str, Query] = {
    "corpus_normalize": corpus_normalize,
    "corpus_rejects": corpus_rejects,
    "odd_lines_status": odd_lines_status(COMPAT_CFG),
    "odd_lines_status_clean": odd_lines_status(CLEAN_CFG),
    "template_strings": one_pass(T.string_literals),
    "template_numbers": one_pass(T.numeric_literals),
    "template_tables": one_pass(T.table_names),
    "template_select": one_pass(T.select_columns),
    "template_where": one_pass(T.where_columns),
    "template_join": one_pass(T.join_columns),
    "template_group": one_pass(T.group_columns),
    "template_paging": one_pass(T.page_sizes),
    "template_order": one_pass(T.order_keys),
    "template_full": templates("events", COMPAT_CFG),
    "template_full_clean": templates("events", CLEAN_CFG),
    "template_orders": templates("orders", COMPAT_CFG),
    "template_orders_clean": templates("orders", CLEAN_CFG),
    "template_params": template_params,
    "labels": labels,
    "label_distribution": label_counts,
    "tool_names": tool_names(COMPAT_CFG),
    "tool_names_clean": tool_names(CLEAN_CFG),
    "tool_description": tool_description,
    "quality_scores": quality_scores(COMPAT_CFG),
    "quality_scores_clean": quality_scores(CLEAN_CFG),
    "question_scores": question_scores,
    "validation_status": validation_status(COMPAT_CFG),
    "validation_status_clean": validation_status(CLEAN_CFG),
    "run_statistics": statistics(COMPAT_CFG),
    "run_statistics_clean": statistics(CLEAN_CFG),
    "run_statistics_max_score": statistics(CurationConfig(min_quality_score=40.0, max_quality_score=60.0, min_params=3)),
    "curate_catalogue": curate_catalogue,
    "create_tools": created_tools,
    "curate_viewer": viewer(COMPAT_CFG),
    "curate_viewer_postgres": viewer(CurationConfig(dialect="postgresql")),
    "curate_viewer_clean": viewer(CLEAN_CFG),
    "curate_viewer_plain": viewer(CurationConfig(use_parameterization=False, use_quality_scoring=False, use_labeling=False)),
    "sql_server_names": sql_server_names,
    "numbered_tools": numbered_tools,
    "dataset_profile": profile,
    "dataset_profile_orders": profile_orders,
    "batch_split": batch_split,
    "catalogue_merge": catalogue_merge,
    "catalogue_identity": catalogue_identity,
    "catalogue_yaml": catalogue_yaml_blocks,
    "catalogue_search": catalogue_search,
    "catalogue_search_counts": catalogue_search_counts,
    "catalogue_preview": catalogue_preview,
    "tool_details": details,
    "dataset_preview": dataset_preview,
    "export_csv_layout": export_csv_layout,
    "run_summary": run_summary,
    "dialect_fanout": dialects(COMPAT_CFG),
    "dialect_fanout_clean": dialects(CLEAN_CFG),
    "dialect_plain": plain_dialects,
    "field_scores": field_scores,
    "field_detection": field_detection,
    "text_field_scores": text_field_scores,
    "profile_normalize": profile_normalize,
    "profile_normalize_renamed": spider_records,
    "detected_normalize": detected_normalize,
    "fallback_normalize": fallback_normalize,
    "dataset_ids": dataset_ids,
    "slugs": slugs,
    "datasets_top20": datasets_top20,
    "stream_status_counts": stream_status_counts,
    "batch_status_counts": batch_status_counts,
    "stream_closed_windows": stream_closed_windows,
    "stream_deduplicated": stream_deduplicated,
    "template_support": support,
    "literal_domains": domains,
    "best_per_template": best_tools,
    "score_histogram": histogram(COMPAT_CFG),
    "score_histogram_clean": histogram(CLEAN_CFG),
    "bind_templates": bind_templates,
    "validity": validity,
    "corpus_round_trip": corpus_round_trip,
    "catalogue_json": catalogue_json,
    "catalogue_import": catalogue_import,
    "dialect_store": dialect_store,
    "stream_catalogue": stream_catalogue,
    "support_across_runs": support_across_runs,
    "literals_across_runs": literals_across_runs,
    "score_percentiles": percentiles,
    "retrieve_topk": retrieve_topk,
    "retrieve_documents": retrieve_documents,
    "nearest_vectors": nearest_vectors,
    "nearest_recall": nearest_recall,
}
