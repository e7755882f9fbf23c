"""License scans by diagonal voting.

A rolling hash of k words at place p of a document that equals one at place q of a
template votes for the diagonal p - q. Spark joins all hashes of all documents to the
small table of template places, adds up the votes by diagonal, merges neighbouring
diagonals (a few words put in or left out) and keeps spans that cover enough of the
template. A base phrase must stand on one diagonal whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, LongType

from .common import ALNUM, words_of

GRAM = 2  # words a hash covers; the shortest base phrase has as many
GAP = 4  # diagonals so near to each other are one span
COVER = 0.6  # share of a template's hashes that a span must have
SHORT, SHORT_COVER = 8, 0.85  # templates of so few hashes tell licenses apart by single words
HEAD = -1  # stands for the document itself among the templates

# Phrases and their labels that are always looked for.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Wording of public licenses and notices, and the label each of them gives.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("all rights reserved", "reserved"),
]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def rolling(words: list[bytes], known: dict) -> np.ndarray:
    """A hash for each run of ``GRAM`` words."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out.view(np.int64)


def template_places(spark: SparkSession) -> DataFrame:
    """gram, template, place: a row for each hash of each template, some hundred in all."""
    rows, known = [(0, HEAD, 0)], _Hashes()
    for n, (text, _) in enumerate([*BASE, *TEMPLATES]):
        rows += [(int(h), n, q) for q, h in enumerate(rolling(words_of(text, ALNUM), known))]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def votes(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, template, diagonal, places: the template places hit on each diagonal.

    Each document also has one row of template ``HEAD``, so one without hits stays.
    """
    spark = docs.sparkSession
    frame = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = frame.select("row", "doc_id").schema.add("n_words", "long").add("grams", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, sizes, grams = b.slice(k, 256), [], []
                for t in part.column(2):
                    words = words_of(t.as_py(), ALNUM)
                    sizes.append(len(words))
                    g = rolling(words, known)
                    grams.append(np.where(g == 0, 1, g))
                # the hash 0 is kept for the document's own row, at the place behind its last one
                ends = np.cumsum([0, *(len(g) + 1 for g in grams)])
                flat = np.concatenate([x for g in grams for x in (g, [0])]) if grams else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), lists], names=["row", "doc_id", "n_words", "grams"])

    rolled = frame.mapInArrow(run, schema).select("row", "doc_id", "n_words", F.posexplode("grams").alias("at", "gram"))
    places = template_places(spark)
    hits = rolled.join(F.broadcast(places), "gram")  # the template table is the same at any size of corpus
    diagonal = F.when(F.col("template") == HEAD, F.lit(0)).otherwise(F.col("at") - F.col("place"))
    return hits.groupBy("row", "doc_id", "n_words", "template", diagonal.alias("diagonal")).agg(F.collect_set("place").alias("places"))


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: row, template, base, start, cover; ``found`` as ``votes`` gives it.

    A base phrase counts once for each diagonal that holds all of it. Of other templates the
    neighbouring diagonals with two votes and more are one span.
    """
    lengths = [len(words_of(t, ALNUM)) - GRAM + 1 for t, _ in [*BASE, *TEMPLATES]]
    length = F.array(*[F.lit(x) for x in lengths])[F.col("template")]
    own = found.filter(F.col("template") != HEAD).withColumns({"length": length, "n": F.size("places")})
    base = own.filter((F.col("template") < len(BASE)) & (F.col("n") == F.col("length")))
    base = base.select("row", "template", F.lit(True).alias("base"), F.col("diagonal").cast("long").alias("start"), F.lit(1.0).alias("cover"))
    near = W.partitionBy("row", "template").orderBy("diagonal")
    # a single vote is a word pair that any text has, unless the template holds no more
    voted = own.filter((F.col("template") >= len(BASE)) & (F.col("n") >= F.least(F.lit(2), F.col("length"))))
    stepped = voted.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(near) > GAP).cast("int"))
    merged = stepped.withColumn("group", F.sum(F.coalesce("new", F.lit(0))).over(near)).groupBy("row", "template", "group", "length").agg(
        F.min("diagonal").alias("start"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    )
    cover = F.size("places") / F.col("length")
    enough = merged.filter(cover >= F.when(F.col("length") <= SHORT, SHORT_COVER).otherwise(COVER))
    start = F.greatest("start", F.lit(0)).cast("long").alias("start")
    wide = enough.select("row", "template", F.lit(False).alias("base"), start, cover.alias("cover"))
    return base.unionByName(wide)


def scan(found: DataFrame) -> DataFrame:
    """One row per document from stored ``votes``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels. Repeated rows each keep a row.
    """
    names = F.array(*[F.lit(label) for _, label in [*BASE, *TEMPLATES]])
    head = F.struct("doc_id", "n_words")
    heads = found.filter(F.col("template") == HEAD).select("row", head.alias("head"))
    one = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = heads.select("row", "head", one("label", "string"), one("base", "boolean"), one("start", "long"), one("cover", "double")).unionByName(
        spans(found).select("row", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), names[F.col("template")].alias("label"), "base", "start", "cover")
    )
    base, none = F.col("base"), F.lit("")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(F.collect_set(c)), ","), none)
    out = rows.groupBy("row").agg(
        F.max("head").alias("head"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    )
    return out.select("head.doc_id", "head.n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
