"""Retrieval by words and by vectors against scoring everything."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators import nearest as N
from sqlcorpus.operators import retrieve as R


def plain_search(tools, questions, k):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = {i: Counter(words(t)) for i, t in tools}
    sizes = {i: sum(b.values()) for i, b in bags.items()}
    n, total = sum(s > 0 for s in sizes.values()), sum(sizes.values())
    have = Counter(w for b in bags.values() for w in b)
    rarity = {w: max(1, math.floor(math.log(1 + (n - h + 0.5) / (h + 0.5)) * 1000)) for w, h in have.items()}
    out = []
    for q, text in questions:
        scores = {}
        for i, b in bags.items():
            hit = set(words(text)) & b.keys()
            if hit:
                scores[i] = sum(max(1, rarity[w] * b[w] * 2200 // (1000 * b[w] + 300 + sizes[i] * n * 900 // total)) for w in hit)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, rank, i, s) for rank, (i, s) in enumerate(best, 1)]
    return Counter(out)


@pytest.mark.parametrize("rare, block", [(3, 4), (32, 1024), (1, 2)])
def test_search_matches_scoring_every_tool(spark, tmp_path, monkeypatch, rare, block):
    """Small blocks, so that lists are long enough to be skipped; copies, near copies, ties, nulls, repeated questions."""
    monkeypatch.setattr(R, "RARE", rare)
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(rare)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))
    tools = [(k * 7 % 401, text()) for k in range(250)]
    tools += [(1000 + k, f"Find orders of more than {k}") for k in range(80)]  # one wording, a rare number each
    tools += [(2000 + k, "the same text") for k in range(40)] + [(3000, None), (3001, ""), (3002, " ?! "), (3003, "Größe ÉTÉ 漢字")]
    questions = [(k, text()) for k in range(40)] + [(100, "orders of more than 17"), (101, "the"), (102, None), (103, "..."), (104, "nothing alike"), (105, "größe été")]
    questions += [(106, "the same text"), (106, "the same text"), (None, "the same text"), (107, "text same THE the")]
    R.build_index(spark.createDataFrame(tools, "ord long, text string").repartition(5), str(tmp_path / "i"), "ord", "text")
    asked = spark.createDataFrame(questions, "qid long, question string")
    for k in (1, 5, 100):
        got = R.search(spark, str(tmp_path / "i"), asked, k)
        assert got.columns == ["qid", "rank", "id", "score"]
        assert Counter(map(tuple, got.collect())) == plain_search(tools, questions, k)
    with pytest.raises(ValueError):
        R.search(spark, str(tmp_path / "i"), asked, 101)


def test_texts_are_computed_once_and_lists_hold_numbers(spark, tmp_path):
    """Texts may be dear to compute, and the hash of a class in each posting is larger than the rest of the index."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    tools = spark.createDataFrame([(k, f"one wording {k % 3}") for k in range(120)], "ord long, text string")
    R.build_index(tools.select("ord", F.udf(read, "string")("text").alias("text")), str(tmp_path / "i"), "ord", "text")
    assert seen.value == 120
    blocks = spark.read.parquet(str(tmp_path / "i" / "blocks"))
    assert dict(blocks.dtypes)["classes"] == "array<struct<class:bigint,worth:bigint>>"


def test_repeated_and_null_keys(spark, tmp_path):
    """Rows of one key and length count as one tool of all their uses; the number of tools is that of the rows."""
    rows = [(1, "a b"), (1, "a b"), (2, "a c d"), (None, "a"), (3, None)]
    R.build_index(spark.createDataFrame(rows, "ord long, text string"), str(tmp_path / "i"), "ord", "text")
    found = R.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "b"), (2, "c")], "qid long, question string"))
    worth = lambda uses, size: max(1, math.floor(math.log(1 + 3.5 / 1.5) * 1000) * uses * 2200 // (1000 * uses + 300 + size * 4 * 900 // 8))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, worth(2, 2)), (2, 1, 2, worth(1, 3))]


def test_shards_together_match_scoring_every_tool(spark, tmp_path, monkeypatch):
    """Shards of a few tools and parts of a few questions; words that are frequent only over all shards."""
    monkeypatch.setattr(R, "SHARD", 40)
    monkeypatch.setattr(R, "QUESTIONS", 3)
    monkeypatch.setattr(R, "RARE", 12)
    monkeypatch.setattr(R, "BLOCK", 2)
    rng = random.Random(5)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.9)) % 300}" for _ in range(rng.randint(0, 15)))
    tools = [(f"t{k * 7 % 211}", text()) for k in range(200)] + [(f"u{k}", "one wording of many") for k in range(50)]
    questions = [(k, text()) for k in range(25)] + [(90, "many of one"), (91, "w1 many")]
    R.build_index(spark.createDataFrame(tools, "ord string, text string").repartition(3), str(tmp_path / "i"), "ord", "text")
    assert spark.read.parquet(str(tmp_path / "i" / "blocks")).select("shard").distinct().count() > 20
    got = R.search(spark, str(tmp_path / "i"), spark.createDataFrame(questions, "qid long, question string"), 7)
    assert Counter(map(tuple, got.collect())) == plain_search(tools, questions, 7)


def test_a_key_with_very_many_rows_is_one_tool_of_each_length(spark, tmp_path, monkeypatch):
    rows = [(1, "a b a")] * 300 + [(1, "a c")] * 200 + [(None, "a d")] * 100 + [(2, "a c d"), (3, "b"), (4, "d e")]
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c a"), (4, "d"), (5, "e d")], "qid long, question string")
    found = []
    for size in (R.SHARD, 10):
        monkeypatch.setattr(R, "SHARD", size)
        R.build_index(spark.createDataFrame(rows, "ord long, text string").repartition(2), str(tmp_path / f"i{size}"), "ord", "text")
        found.append(sorted(map(str, R.search(spark, str(tmp_path / f"i{size}"), asked).collect())))
    assert found[0] == found[1]
    n, t = 603, 300 * 3 + 200 * 2 + 100 * 2 + 6
    worth = lambda have, uses, size: max(1, math.floor(math.log(1 + (n - have + 0.5) / (have + 0.5)) * 1000) * uses * 2200 // (1000 * uses + 300 + size * n * 900 // t))
    got = {(r.qid, r.id): r.score for r in R.search(spark, str(tmp_path / "i10"), asked).collect()}
    # "a" is in 4 rows of one key and length: 1 of 3 words, 1 of 2, null of 2, 2 of 3
    assert got[1, 1] == worth(4, 600, 3) + worth(4, 200, 2) and got[1, 2] == worth(4, 1, 3) and got[1, None] == worth(4, 100, 2)
    assert got[3, 1] == got[1, 1] + worth(2, 200, 2)


def test_an_index_takes_less_room_than_its_texts(spark, tmp_path):
    """Postings were stored five times, words and all: 1.2 times the texts' own Parquet file here, 0.4 in shards."""
    rng = random.Random(1)
    words = [f"{rng.randrange(36**5):x}" for _ in range(3000)]
    text = lambda: " ".join(words[min(2999, int(rng.paretovariate(0.5)))] for _ in range(300))
    tools = spark.createDataFrame([(k, text()) for k in range(1500)], "ord long, text string").coalesce(1)
    tools.write.parquet(str(tmp_path / "texts"))
    R.build_index(spark.read.parquet(str(tmp_path / "texts")), str(tmp_path / "i"), "ord", "text")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet"))
    assert size("i") < size("texts")


def test_a_wording_of_many_shards_is_one_class(spark, tmp_path, monkeypatch):
    """Else the work of a search would grow with questions times shards."""
    monkeypatch.setattr(R, "SHARD", 50)
    monkeypatch.setattr(R, "HEADS", 10)
    tools = [(k, f"one wording of {'many' if k % 2 else 'very few'} tools") for k in range(300)] + [(1000 + k, f"one wording of {k}") for k in range(40)]
    R.build_index(spark.createDataFrame(tools, "ord long, text string"), str(tmp_path / "i"), "ord", "text")
    shards = spark.read.parquet(str(tmp_path / "i" / "blocks")).filter("bag is null")
    assert shards.select("shard").distinct().count() > 20
    alike = spark.read.parquet(str(tmp_path / "i" / "alike"))
    assert alike.filter("word = 'very'").select(F.sum(F.size("classes"))).first()[0] == 1
    assert alike.filter("word is null").select(F.sum(F.size("ids"))).first()[0] <= 3 * R.HEADS
    questions = [(1, "very many tools"), (2, "few"), (3, "wording of 17"), (4, "one 3 8")]
    got = R.search(spark, str(tmp_path / "i"), spark.createDataFrame(questions, "qid long, question string"), 10)
    assert Counter(map(tuple, got.collect())) == plain_search(tools, questions, 10)


def test_search_in_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "ord long, text string")
    R.build_index(none, str(tmp_path / "i"), "ord", "text")
    assert R.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "a")], "qid long, question string")).count() == 0


def plain_nearest(rows, queries, k, skip_self=True):
    whole = lambda v: [math.floor(abs(x) / N.STEP + 0.5) * (1 if x >= 0 else -1) for x in v]
    stored = [(i, whole(v)) for i, v in rows if i is not None and v is not None and None not in v]
    out = []
    for q, v in queries:
        if q is None or v is None:
            continue
        w = whole(v)
        best = sorted((sum((a - b) ** 2 for a, b in zip(w, x, strict=True)), i) for i, x in stored if not (skip_self and i == q))[:k]
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, queries, lists", [(4096, 256, None), (7, 3, 5), (50, 1, 1)])
def test_exact_search_matches_comparing_with_every_row(spark, tmp_path, monkeypatch, block, queries, lists):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "QUERIES", queries)
    rng = random.Random(2)
    centre = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    vector = lambda: [float(round(c + rng.gauss(0, 0.1), 3)) for c in rng.choice(centre)]
    rows = [(k, vector()) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(60)]  # a vector with many copies: ties by key
    rows += [(2000, None), (2001, [None] * 8), (None, vector())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    N.build_vectors(df, str(tmp_path / "v"), lists=lists)
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(-1, vector()), (5, rows[5][1])]
    want = plain_nearest(rows, [a for a in asked if a[1] is not None and None not in a[1]], 10)
    queries_df = spark.createDataFrame(asked, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, N.nearest(spark, str(tmp_path / "v"), queries_df, 10).collect())) == want
    if lists is None:
        probes = N.probes_for(spark, str(tmp_path / "v"), queries_df)
        got = {(r.vec_id, r.id) for r in N.nearest(spark, str(tmp_path / "v"), queries_df, 10, probes=probes).collect()}
        assert len(got & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_distances_to_centroids_are_taken_piece_by_piece():
    """A batch times thousands of cells would not fit a worker."""
    batch = pa.RecordBatch.from_pydict({"no": list(range(10_000))})
    for cells in (0, 1, N.LISTS, 10 * N.PAIRS):
        pieces = list(N._pieces(iter([batch, batch.slice(0, 0)]), cells))
        assert all(p.num_rows == 1 or 0 < p.num_rows * cells <= N.PAIRS for p in pieces if cells)
        assert [x for p in pieces for x in p["no"].to_pylist()] == list(range(10_000))


def test_vectors_that_cannot_be_compared(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="components"):
        N.build_vectors(make([(1, [1.0, 2.0]), (2, [1.0])]), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="larger step"):
        N.build_vectors(make([(1, [1e6, 2.0])]), str(tmp_path / "b"))
    N.build_vectors(make([(1, None)]), str(tmp_path / "c"))
    assert N.nearest(spark, str(tmp_path / "c"), make([(1, [1.0])])).count() == 0
