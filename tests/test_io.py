"""Sources, sinks, catalogue snapshots, numbering and streams on files."""

import csv
import glob
import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from sqlcorpus.config import CurationConfig
from sqlcorpus.operators.catalogue import in_order, merge_catalogue
from sqlcorpus.operators.curate import catalogue_layout, curate, curate_viewer
from sqlcorpus.operators.normalize import normalize, profile_for
from sqlcorpus.operators.numbering import number_rows, number_tools, split_batch
from sqlcorpus.sources import sinks, store
from sqlcorpus.sources.corpus import read_corpus, read_dump, read_lines
from sqlcorpus.streaming.jobs import curate_stream

LINES = [
    {"question": "How many pupils are in each class, by name?", "sql": "SELECT c.name, COUNT(*) FROM pupil p JOIN class c ON p.cid = c.cid WHERE c.kind IN ('open') GROUP BY c.name ORDER BY c.name DESC LIMIT 3"},
    {"prompt": "Which pupils have no class at all? Größe", "query": "SELECT name FROM pupil WHERE cid NOT IN (SELECT cid FROM class) ORDER BY name LIMIT 9"},
    {"question": "x", "sql": ""},
]


def parts(path, ext=""):
    return [open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*{ext}"))]


def corpus_files(tmp_path, copies=1):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for i in range(copies):
        text = "\n".join(json.dumps(r, ensure_ascii=False) for r in LINES) + "\nbroken\n\n"
        (folder / f"c{i}.jsonl").write_text(text, encoding="utf-8")
    return str(folder)


def test_read_corpus_and_positions(spark, tmp_path):
    path = corpus_files(tmp_path, copies=3)
    records, rejects = read_corpus(spark, path, position="dense")
    assert rejects.count() == 3
    assert sorted(r.ord for r in records.select("ord").collect()) == [0, 1, 2, 5, 6, 7, 10, 11, 12]
    scan = read_lines(spark, f"{path}/c0.jsonl").orderBy("ord").collect()
    assert [r.value for r in scan][3] == "broken"


def test_catalogue_round_trip(spark, tmp_path):
    records, _ = read_corpus(spark, corpus_files(tmp_path), position="dense")
    tools = catalogue_layout(curate(normalize(records)))
    home = str(tmp_path / "cat")
    assert store.load_catalogue(spark, home) is None
    assert store.upsert_catalogue(spark, tools, home) == 1
    assert store.upsert_catalogue(spark, tools, home) == 2
    cat = store.load_catalogue(spark, home)
    assert cat.count() == 2 and {r.first_run for r in cat.collect()} == {1}

    sinks.write_catalogue_yaml(cat, str(tmp_path / "y"))
    text = "".join(parts(tmp_path / "y"))
    tools_map = yaml.safe_load(text)["tools"]
    assert list(tools_map) == [r.tool_key for r in in_order(cat).collect()]
    first = next(iter(tools_map.values()))
    assert first["statement"] == in_order(cat).first().statement
    assert first["templateParameters"][0] == {"name": "open", "type": "string", "description": "String value (e.g., open)"}

    sinks.write_catalogue_json(cat, str(tmp_path / "j"))
    assert len("".join(parts(tmp_path / "j")).strip().split("\n")) == 2

    sinks.write_catalogue_yaml(cat.filter("false"), str(tmp_path / "ye"))
    assert yaml.safe_load("".join(parts(tmp_path / "ye"))) == {"tools": {}}


def test_merge_keeps_first_place_and_last_value(spark):
    def run(rows):
        return spark.createDataFrame(rows, "tool_key string, ord long, statement string")

    one = merge_catalogue(None, run([("a", 1, "1"), ("b", 2, "1")]), 1)
    two = merge_catalogue(one, run([("b", 1, "2"), ("c", 2, "2"), ("c", 3, "3")]), 2)
    assert [(r.tool_key, r.statement) for r in in_order(two).collect()] == [("a", "1"), ("b", "2"), ("c", "3")]


def test_csv_export_and_summary(spark, tmp_path):
    records, _ = read_corpus(spark, corpus_files(tmp_path))
    tools = number_tools(curate_viewer(normalize(records)))
    sinks.write_catalogue_csv(tools, str(tmp_path / "c"))
    rows = [r for p in parts(tmp_path / "c") for r in list(csv.reader(p.splitlines()))[1:]]
    assert {r[0] for r in rows} == {"sql_tool_1", "sql_tool_2"} and len(rows[0]) == 8
    sinks.write_catalogue_csv(tools.filter("false"), str(tmp_path / "e"))
    assert "".join(parts(tmp_path / "e")).strip().startswith("tool_name,description,sql")
    result = spark.createDataFrame([(3,)], "items_processed long")
    sinks.write_run_summary(result, str(tmp_path / "s"), "json", {"min_quality_score": 50})
    assert json.loads("".join(parts(tmp_path / "s"))) == {"items_processed": 3, "min_quality_score": 50}


def test_numbers_are_dense_and_global(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 3_000_001).alias("ord")).repartition(5)
    got = number_rows(df).orderBy("ord").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))
    batch, rest = split_batch(df, 100)
    assert batch.count() == 100 and rest.count() == len(got) - 100
    assert batch.agg(F.max("ord")).first()[0] < rest.agg(F.min("ord")).first()[0]


def test_numbers_follow_a_hashed_order(spark, monkeypatch):
    """Small ranges over hashed, partly missing orders: the numbers are those of a sort of all rows."""
    from sqlcorpus.operators import numbering

    monkeypatch.setattr(numbering, "RANGE_ROWS", 40)
    df = spark.range(3000).select("id", F.xxhash64("id").alias("ord")).repartition(6)
    want = {r.id: k for k, r in enumerate(sorted(df.collect(), key=lambda r: r.ord), 1)}
    assert {r.id: r.n for r in number_rows(df).collect()} == want
    for size in (1, 40, 1234, 2999, 3000, 5000):
        batch, rest = split_batch(df, size)
        assert {want[r.id] for r in batch.collect()} == set(range(1, min(size, 3000) + 1)) and rest.count() == max(0, 3000 - size)
    gaps = spark.createDataFrame([(None, "a"), (5, "b"), (-7, "c")], "ord long, v string")
    assert [r.v for r in number_rows(gaps).orderBy("n").collect()] == ["a", "c", "b"]
    assert number_rows(gaps.limit(0)).count() == 0 and split_batch(gaps.limit(0), 3)[0].count() == 0


def test_dumps_profiles_and_paths(spark, tmp_path):
    spark.createDataFrame([("q", "train"), ("r", "test")], "question string, split string").write.parquet(str(tmp_path / "d"))
    assert [r.question for r in read_dump(spark, str(tmp_path / "d"), split="test").collect()] == ["r"]
    assert profile_for("s")["sql"] == ["query"] and profile_for("s", clean=True) is None
    assert profile_for("xlang/spider")["sql"] == ["query"] and profile_for("auto") is None
    assert sinks.dialect_path("out/tools.yaml", "PostgreSQL") == "out/tools_postgres.yaml"
    assert sinks.dialect_path("out/tools.yaml", "mysql") == "out/tools.yaml"


def test_stream_equals_batch(spark, tmp_path):
    path = corpus_files(tmp_path, copies=3)
    stream = (
        spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(path)
        .withColumn("ord", F.xxhash64("value"))
    )
    curate_stream(stream, str(tmp_path / "cat"), str(tmp_path / "cp")).awaitTermination()
    records, _ = read_corpus(spark, path)
    want = {r.tool_key for r in catalogue_layout(curate(normalize(records))).collect()}
    assert {r.tool_key for r in store.load_catalogue(spark, str(tmp_path / "cat")).collect()} == want
    assert store.snapshots(spark, str(tmp_path / "cat")) == [1, 2, 3]


def test_result_does_not_depend_on_partitions(spark, tmp_path):
    records, _ = read_corpus(spark, corpus_files(tmp_path))
    cfg = CurationConfig(mode="clean")
    few = curate(normalize(records.coalesce(1)), cfg).orderBy("ord").collect()
    many = curate(normalize(records.repartition(7)), cfg).orderBy("ord").collect()
    assert few == many


def test_equal_positions_give_one_row_per_key(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "x"), ("b", 1, "z")]
    got = merge_catalogue(None, spark.createDataFrame(rows, "tool_key string, ord long, statement string"), 1).collect()
    assert sorted(r.tool_key for r in got) == ["a", "b"]


def test_stream_goes_on_with_an_existing_catalogue(spark, tmp_path):
    records, _ = read_corpus(spark, corpus_files(tmp_path, copies=3))
    tools, home = catalogue_layout(curate(normalize(records))), str(tmp_path / "cat")
    for _ in range(3):
        store.upsert_catalogue(spark, tools.limit(1), home)
    assert store.upsert_catalogue(spark, tools, home, batch="s-0") == 4
    want = {r.tool_id for r in tools.collect()}
    assert {r.tool_id for r in store.load_catalogue(spark, home).collect()} == want
    assert store.upsert_catalogue(spark, tools, home, batch="s-1") == 5
    assert store.upsert_catalogue(spark, tools.limit(0), home, batch="s-0") == 4  # the repeated batch adds nothing
    assert store.snapshots(spark, home) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        store.upsert_catalogue(spark, tools, home, run=2)


def test_names_that_clash_are_lengthened(spark):
    from sqlcorpus.operators.catalogue import display_keys

    rows = [("k", "aa" * 20), ("k", "bb" * 20), ("m", "cc" * 20)]
    got = {r.tool_key for r in display_keys(spark.createDataFrame(rows, "tool_key string, tool_id string")).collect()}
    assert got == {"k_" + "a" * 16, "k_" + "b" * 16, "m"}


def test_detected_fields_fall_back_record_by_record(spark):
    from sqlcorpus.operators.normalize import normalize_detected

    rows = [(1, "q1", None, "SELECT 1"), (2, None, "q2", "SELECT 2")]
    df = spark.createDataFrame(rows, "ord long, question string, nl string, sql string")
    assert [r.question for r in normalize_detected(df, "question", "sql").orderBy("ord").collect()] == ["q1", "q2"]


def _tools(spark, rows):
    return spark.createDataFrame(rows, "tool_id string, tool_key string, ord long, statement string")


def _found(df):
    return sorted((r.tool_id, r.statement, r.first_run, r.first_ord, r.last_run) for r in df.collect())


def test_runs_write_their_own_tools_only(spark, tmp_path):
    """Twenty runs on a catalogue: each writes as much as itself, readers see the merge, compaction changes nothing."""
    home, seen = str(tmp_path / "cat"), None
    rows = [(f"id{k}", f"k{k}", k, "first") for k in range(400)]
    store.upsert_catalogue(spark, _tools(spark, rows), home)
    size = lambda f: sum(os.path.getsize(os.path.join(d, x)) for d, _, xs in os.walk(f) for x in xs)
    whole = size(home)
    for n in range(2, 6):
        store.upsert_catalogue(spark, _tools(spark, [(f"id{n}", f"k{n}", 0, f"run {n}"), (f"new{n}", "k", 7, "new")]), home, compact_after=100)
    deltas = {f: size(f"{home}/{f}") for f in os.listdir(home) if f.startswith("delta-") and not f.startswith("delta-1-")}
    assert len(deltas) == 4 and max(deltas.values()) < whole / 2
    seen = _found(store.load_catalogue(spark, home))
    assert len(seen) == 404 and ("id3", "run 3", 1, 3, 3) in seen and ("new5", "new", 5, 7, 5) in seen
    assert len(_found(store.load_catalogue(spark, home, 3))) == 402 and store.load_catalogue(spark, home, 9) is None
    store.compact_catalogue(spark, home)
    assert _found(store.load_catalogue(spark, home)) == seen
    gone = store.vacuum_catalogue(spark, home)
    assert len(gone) == 5 and _found(store.load_catalogue(spark, home)) == seen and store.snapshots(spark, home) == [5]
    store.upsert_catalogue(spark, _tools(spark, [("id1", "k1", 0, "again")]), home, compact_after=1)
    assert sum(f.startswith("base-") for f in os.listdir(home)) == 2 and ("id1", "again", 1, 1, 6) in _found(store.load_catalogue(spark, home))


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "cat")
    store.upsert_catalogue(spark, _tools(spark, [("a", "a", 1, "1")]), home)
    before = _found(store.load_catalogue(spark, home))

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store._Folder, "commit", crash)
        with pytest.raises(OSError):
            store.upsert_catalogue(spark, _tools(spark, [("a", "a", 1, "2"), ("b", "b", 2, "2")]), home, batch="s-3")
    assert len([f for f in os.listdir(home) if f.startswith("delta-")]) == 2
    assert _found(store.load_catalogue(spark, home)) == before and store.snapshots(spark, home) == [1]
    assert store.upsert_catalogue(spark, _tools(spark, [("b", "b", 2, "3")]), home, batch="s-3") == 2
    assert _found(store.load_catalogue(spark, home)) == [("a", "1", 1, 1, 1), ("b", "3", 2, 2, 2)]
    assert len(store.vacuum_catalogue(spark, home)) == 1
    # the newest run may be written again: its earlier delta no longer counts
    assert store.upsert_catalogue(spark, _tools(spark, [("c", "c", 1, "4")]), home, run=2) == 2


def test_yaml_heading_stands_before_the_first_tool(spark, tmp_path):
    """Positions that leave the first parts of the sort empty."""
    rows = [(f"id{k}", f"k{k}", k, "x", 1, k, 1) for k in range(30)]
    cat = spark.createDataFrame(rows, "tool_id string, tool_key string, ord long, sql string, first_run int, first_ord long, last_run int")
    cat = cat.drop("ord").withColumn("parameters", F.expr("cast(array() as array<struct<name: string, type: string, description: string>>)"))
    cat = cat.withColumns({"description": F.lit("d"), "quality_score": F.lit(1.0)})
    sinks.write_catalogue_yaml(cat, str(tmp_path / "y"))
    assert list(yaml.safe_load("".join(parts(tmp_path / "y")))["tools"]) == [f"k{k}" for k in range(30)]


def test_an_exported_catalogue_comes_back(spark, tmp_path):
    """Odd texts, no parameters, several parts, and one file that several tasks share."""
    from sqlcorpus.sources.corpus import read_catalogue_yaml

    odd = ['say "hi"\n  "x": no', "back\\slash\ttab", "Größe 漢字 😀", "", "    - name: y", "tools:"]
    item = "array<struct<name: string, type: string, description: string>>"
    rows = [(f"id{k}", f'k{k}"q' if k % 5 == 0 else f"k{k}", "mysql-sql", "mysql", odd[k % 6] + str(k), odd[(k + 1) % 6], [(odd[(k + i) % 6], "string", odd[(k + i + 1) % 6]) for i in range(k % 4)], 1, 1000 - k, 1) for k in range(300)]
    cat = spark.createDataFrame(rows, f"tool_id string, tool_key string, kind string, source string, statement string, description string, templateParameters {item}, first_run int, first_ord long, last_run int")
    sinks.write_catalogue_yaml(cat, str(tmp_path / "y"))
    one = tmp_path / "one.yaml"
    one.write_text("".join(parts(tmp_path / "y")), encoding="utf-8")
    want = [(k, *r[1:7]) for k, r in enumerate(sorted(rows, key=lambda r: r[8]))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for path in (str(tmp_path / "y"), str(one)):
            df = read_catalogue_yaml(spark, path)
            got = [(r.ord, r.tool_key, r.kind, r.source, r.statement, r.description, [tuple(p) for p in r.templateParameters]) for r in df.orderBy("ord").collect()]
            assert got == want
        assert spark.read.option("lineSep", '\n  "').text(str(one)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert list(yaml.safe_load(one.read_text(encoding="utf-8"))["tools"]) == [r[1] for r in want]
    # an imported catalogue merges like a run
    home = str(tmp_path / "cat")
    store.upsert_catalogue(spark, read_catalogue_yaml(spark, str(one)), home)
    store.upsert_catalogue(spark, read_catalogue_yaml(spark, str(one)).limit(3), home)
    assert store.load_catalogue(spark, home).count() == 300
    sinks.write_catalogue_yaml(cat.filter("false"), str(tmp_path / "ye"))
    assert read_catalogue_yaml(spark, str(tmp_path / "ye")).count() == 0


def test_counts_of_open_windows_are_updated(spark, tmp_path):
    """Three batches that change the same windows, the last of them run again: the newest counts are read."""
    from sqlcorpus.streaming.jobs import read_counts, write_counts

    folder = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(f"2024-01-01 0{h}:1{k}:00", "x") for h in range(3)], "ts string, status string").coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema("ts timestamp, status string").option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "1 day")
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "status").count().select(F.col("w.start").alias("window_start"), "status", F.col("count").alias("records"))
    write_counts(counts, str(tmp_path / "out"), str(tmp_path / "cp"), mode="update").awaitTermination()
    assert sorted(r.records for r in read_counts(spark, str(tmp_path / "out"), ["window_start", "status"]).collect()) == [3, 3, 3]
