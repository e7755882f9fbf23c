"""The best tools for each question of a table: a stored inverted index, exact top-k with bounds.

Words are runs of letters and digits in lower case; none is left out. A word that a tool and
a question share is worth a whole number that falls with the number of tools that have the
word, rises with its uses in the tool and falls with the tool's length; a score is the sum.

The index is cut into *shards* of some thousands of tools, each with lists of its own, so postings
travel packed and a search adds them up where they are. Only numbers of tools for each word of a
shard, and the best tools of a shard, are brought together over shards.

Tools that agree in all their frequent words are one *class*, so a catalogue of a million tools
of one wording is searched as one entry: any of its tools scores the same but for rare words,
and tools with a rare word of the question are few and are scored one by one. A class that several
tools of a shard are in is taken from its shard and is one over all of them; it keeps its first
``HEADS`` keys, which is all that a top-k up to ``HEADS`` can take from it.

Lists of classes are stored in blocks by falling worth. A search first takes the leading block
of each word of a question, which gives a score that the k-th result reaches at least; blocks
that cannot reach it are skipped.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.spots import sealed
from ..session import work_folder

WORD = r"([\p{L}\p{N}]+)"
RARE = 32  # words in fewer tools are looked up tool by tool
HEADS = 100  # keys that a class keeps, and so the largest k
BLOCK = 1024  # postings of a block
SHARD = 3 * 2**20  # words of a shard, about
SHARD_BYTES = 2**26  # and their bytes
QUESTIONS = 2**12  # questions that a task searches a shard for
ENTRY = np.dtype([("row", "<u4"), ("uses", "<u4")])  # a posting on its way; lists and nulls in lists would cost Arrow far more


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _bytes(starts: np.ndarray, row: np.ndarray, uses: np.ndarray) -> pa.Array:
    """Runs of postings, each as one value."""
    entries = np.empty(len(row), ENTRY)
    entries["row"], entries["uses"] = row, uses
    ends = np.append(starts, len(row)) * ENTRY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(entries)])


def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the runs, rows and uses."""
    runs = _one(column)
    ends = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1] // ENTRY.itemsize if len(runs) else np.zeros(1, np.int32)
    entries = np.frombuffer(runs.buffers()[2], ENTRY, ends[-1] - ends[0], ends[0] * ENTRY.itemsize) if ends[-1] > ends[0] else np.empty(0, ENTRY)
    return np.diff(ends), entries["row"].astype(np.int64), entries["uses"].astype(np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class _Shard:
    """Tools in the order of their ids; a *row* is an id and a length, as rows that agree in both count as one."""

    def __init__(self, kind: pa.DataType):
        self.ids, self.of, self.lens, self.copies = pa.array([], kind), [], [], []
        self.parts, self.size, self.bytes, self.docs = [], 0, 0, 0

    def add(self, words: pa.Array, rows: np.ndarray) -> None:
        self.parts.append((words, rows, np.ones(len(rows), np.int64)))
        self.size += len(rows)
        self.bytes += words.nbytes

    def counted(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Words in order, and for each posting the number of its word, its row and uses, by word and row."""
        coded = pa.chunked_array([p[0] for p in self.parts]).dictionary_encode().unify_dictionaries()
        words = coded.chunk(0).dictionary
        order = pc.array_sort_indices(words)
        rank = np.empty(len(words), np.int64)
        rank[order.to_numpy()] = np.arange(len(words))
        codes = rank[np.concatenate([c.indices.to_numpy() for c in coded.chunks])]
        keys = codes * len(self.lens) + np.concatenate([p[1] for p in self.parts])
        by = np.argsort(keys)
        keys, uses = keys[by], np.concatenate([p[2] for p in self.parts])[by]
        first = _starts(keys)
        return words.take(order), keys[first] // len(self.lens), keys[first] % len(self.lens), np.add.reduceat(uses, first)

    def merge(self) -> None:
        """Rows of a key that comes very often take no more room than its distinct words."""
        words, codes, rows, uses = self.counted()
        self.parts, self.size = [(words.take(pa.array(codes)), rows, uses)], len(rows)
        self.bytes = self.parts[0][0].nbytes

    def batch(self, shard: int) -> pa.RecordBatch:
        """A row at -1 that describes the tools, then a row for each word."""
        words, codes, rows, uses = self.counted()
        first = _starts(codes)
        lens, copies = np.array(self.lens, np.int64), np.array(self.copies, np.int64)
        n = np.diff(np.append(first, len(codes)))
        first = np.concatenate([[0], first + len(lens)])
        begin = np.minimum(np.arange(len(first)), 1) * len(self.ids)  # all ids are in the first row
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array(np.full(len(first), shard, np.int64)),
                "at": pa.array(np.arange(-1, len(words)), pa.int32()),
                "word": pa.concat_arrays([pa.array([""], words.type), words]),
                "n": pa.array(np.append(copies.sum(), n)),
                "t": pa.array(np.append((copies * lens).sum(), np.zeros(len(words), np.int64))),
                "data": _bytes(first, np.concatenate([self.of, rows]), np.concatenate([lens, uses])),
                "ids": _lists(begin, self.ids),
            }
        )


def _packed(size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, words), in the order of ids, to shards; all rows of an id are in one shard."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, shard = TaskContext.get().partitionId() << 33, object(), None
        for b in batches:
            ids, words = b.column(0), b.column(1)
            offsets = words.offsets.to_numpy()
            shard = shard or _Shard(ids.type)
            begun, rows, new = 0, [], []

            def take(upto: int) -> None:
                lens = np.diff(offsets[begun : upto + 1])
                shard.add(words.values.slice(offsets[begun], offsets[upto] - offsets[begun]), np.repeat(np.array(rows, np.int64), lens))  # noqa: B023
                shard.ids = pa.concat_arrays([shard.ids, ids.take(pa.array(new, pa.int64()))])  # noqa: B023

            for i, key in enumerate(ids.to_pylist()):
                if key != last:
                    if shard.size + offsets[i] - offsets[begun] >= size or shard.bytes >= most:
                        take(i)
                        yield shard.batch(number)
                        number, shard, begun, rows, new = number + 1, _Shard(ids.type), i, [], []
                    last, own = key, {}
                    shard.docs += 1
                    new.append(i)
                length = int(offsets[i + 1] - offsets[i])
                if length not in own:
                    own[length] = len(shard.lens)
                    shard.of.append(shard.docs - 1)
                    shard.lens.append(length)
                    shard.copies.append(0)
                shard.copies[own[length]] += 1
                rows.append(own[length])
            take(b.num_rows)
            if shard.size >= 2 * size or shard.bytes >= 2 * most:
                shard.merge()
        if shard and shard.docs:
            yield shard.batch(number)

    return pack


def _placed(n: int, t: int, block: int) -> Callable[[pa.Table], pa.Table]:
    """The lists of a shard, with what is known of its words, to its blocks."""

    def place(group: pa.Table) -> pa.Table:
        at, known = _one(group["at"]).to_numpy(), _one(group["known"]).to_numpy()
        lists, tools = (group.filter(pa.array((known == 0) & x)).sort_by("at") for x in (at >= 0, at < 0))
        size = lists.num_rows
        rarity = np.empty(size, np.int64)
        rarity[at[known != 0]] = known[known != 0]
        rarity, frequent = np.abs(rarity), rarity > 0
        _, of, lens = _entries(tools["data"])
        ids, norm = _one(tools["ids"]).flatten(), 300 + lens * n * 900 // max(1, t)

        words, (lengths, rows, uses) = _one(lists["word"]), _entries(lists["data"])
        word = np.repeat(np.arange(size), lengths)
        worth = np.maximum(1, rarity[word] * uses * 2200 // (1000 * uses + norm[rows]))
        first = _starts(word, of[rows])  # rows of one id count together
        word, tool, worth = word[first], of[rows][first], np.add.reduceat(worth, first) if size else worth

        # tools that agree in all frequent words, each word's worth included, are a class; null ids are in none
        often = frequent[word]
        by = np.flatnonzero(often)
        by = by[np.argsort(tool[by], kind="stable")]
        begin = _starts(tool[by])
        bag = np.stack([word[by], worth[by]], axis=1)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        class_of, numbers, first = np.full(len(ids), -1, np.int64), {}, []
        for a, b in zip(begin, np.append(begin, len(by))[1:], strict=True):
            if not null[d := tool[by[a]]]:
                c = class_of[d] = numbers.setdefault(hashlib.sha256(bag[a:b].tobytes()).digest(), len(numbers))
                if c == len(first):
                    first.append((a, b))

        # classes of several tools may be classes of other shards as well, so they leave this one; lists keep them where tools have rare words
        alike = np.bincount(class_of[class_of >= 0], minlength=len(first)) > 1
        has_rare = np.zeros(len(ids), bool)
        has_rare[tool[~often]] = True
        listed = ~alike
        listed[class_of[has_rare & (class_of >= 0)]] = True
        members = np.argsort(class_of, kind="stable")
        members = members[class_of[members] >= 0]
        members = np.split(members, _starts(class_of[members])[1:])
        heads = [members[c][:HEADS] for c in np.flatnonzero(alike)]
        bags = [by[a:b] for (a, b), x in zip(first, alike, strict=True) if x]
        heads = _lists(*_joined(heads, lambda x: ids.take(pa.array(x))))
        bags = _lists(*_joined(bags, lambda x: pa.StructArray.from_arrays([words.take(pa.array(word[x])), pa.array(worth[x])], ["word", "worth"])))

        leader = np.zeros(len(ids), bool)
        leader[tool[by[[a for a, _ in first]]]] = listed
        of_kept = np.append(np.where(listed, np.cumsum(listed) - 1, -1), -1)[class_of]
        shown = np.append(~alike, False)[class_of]
        kept = shown | has_rare  # tools that a search can find here
        entry = np.where(often, of_kept[tool], (np.cumsum(kept) - 1)[tool])
        some = np.flatnonzero(~often | leader[tool])
        shard = _one(group["shard"])[0].as_py()
        return _blocks(shard, words, frequent, word[some], entry[some], worth[some], ids.filter(pa.array(kept)), of_kept[kept], shown[kept], heads, bags, block)

    return place


def _joined(parts: list[np.ndarray], values: Callable[[np.ndarray], pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Where parts begin, and the values of all of them."""
    lens = np.array([len(x) for x in parts], np.int64)
    return np.cumsum(lens) - lens, values(np.concatenate(parts) if parts else np.empty(0, np.int64))


def _blocks(shard: int, words: pa.Array, frequent: np.ndarray, word: np.ndarray, entry: np.ndarray, worth: np.ndarray, ids: pa.Array, class_of: np.ndarray, shown: np.ndarray, heads: pa.Array, bags: pa.Array, block: int) -> pa.Table:
    """A row of the tools (as a class and whether it is found here), the lists of words (of classes; of tools for rare words), and classes that go elsewhere."""
    by = np.lexsort((entry, -worth, word))
    word, entry, worth = word[by], entry[by], worth[by]
    begin = _starts(word)
    number = (np.arange(len(word)) - np.repeat(begin, np.diff(np.append(begin, len(word))))) // block
    begin = _starts(word, number)
    top, of, numbers = worth[begin], word[begin], number[begin]
    by = np.lexsort((entry, number, word))  # inside a block in order, which is stored in less room
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([class_of, entry[by]])), pa.array(np.concatenate([shown.astype(np.int64), worth[by]]))], ["class", "worth"])
    count, others = len(begin), len(heads)
    classes = _lists(np.concatenate([[0], begin + len(ids), np.full(others, len(pairs))]), pairs)
    none = lambda n, like: pa.nulls(n, like.type)
    zeros = np.zeros(others, np.int64)
    return pa.table(
        {
            "shard": pa.array(np.full(1 + count + others, shard, np.int64)),
            "word": pa.concat_arrays([none(1, words), words.take(pa.array(of)), none(others, words)]),
            "frequent": pa.array(np.concatenate([[False], frequent[of], zeros > 0])),
            "number": pa.array(np.concatenate([[0], numbers, zeros]), pa.int32()),
            "top": pa.array(np.concatenate([[0], top, zeros])),
            "classes": classes,
            "ids": pa.concat_arrays([_lists(np.array([0]), ids), none(count, heads), heads]),
            "bag": pa.concat_arrays([none(1 + count, bags), bags]),
        }
    )


def _gathered(block: int) -> Callable[[pa.Table], pa.Table]:
    """Classes of one wording each, as their first tools and their words, to a shard of their own."""

    def gather(group: pa.Table) -> pa.Table:
        heads, bags = _one(group["ids"]), _one(group["bag"])
        ids, class_of = heads.flatten(), np.repeat(np.arange(len(heads)), np.diff(heads.offsets.to_numpy()))
        order = pc.sort_indices(ids)
        ids, class_of = ids.take(order), class_of[order.to_numpy()]
        rank = np.empty(len(heads), np.int64)
        rank[np.argsort(np.unique(class_of, return_index=True)[1])] = np.arange(len(heads))  # by their first tools
        texts, worth = bags.flatten().flatten()
        words = texts.dictionary_encode()
        entry = rank[np.repeat(np.arange(len(bags)), np.diff(bags.offsets.to_numpy()))]
        none = np.empty(0, np.int64)
        no_heads, no_bags = _lists(none, ids.slice(0, 0)), _lists(none, pa.StructArray.from_arrays([texts.slice(0, 0), worth.slice(0, 0)], ["word", "worth"]))
        word, words = words.indices.to_numpy().astype(np.int64), words.dictionary
        shard, all_of = _one(group["shard"])[0].as_py(), lambda x: np.ones(len(x), bool)
        return _blocks(shard, words, all_of(words), word, entry, worth.to_numpy(), ids, rank[class_of], all_of(ids), no_heads, no_bags, block)

    return gather


def build_index(tools: DataFrame, path: str, key: str = "tool_id", text: str = "description") -> None:
    """Write the index of a catalogue, one row for each ``key``, to a new folder.

    Tools with a null or empty text, or without a word, are never found. Every table of the index is
    a folder of Parquet files; nothing of it passes the driver but the number of tools and words.
    """
    # rows of one key meet here and lie side by side, and texts are computed once
    near = tools.select(F.col(key).alias("id"), F.col(text).alias("text")).repartition("id").sortWithinPartitions("id")
    split = sealed(near.select("id", words_of(F.col("text")).alias("words")), "words").filter(F.size("words") > 0)
    kind = split.schema["id"].dataType.simpleString()
    packed = split.mapInArrow(_packed(SHARD, SHARD_BYTES), f"shard long, at int, word string, n long, t long, data binary, ids array<{kind}>")
    packed = _stored(packed, f"{path}/packed")
    size = packed.filter("at < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    n = F.lit(size.n)
    # of each word and shard a row of numbers meets the others, its list stays behind
    have = packed.filter("at >= 0").select("shard", "at", "word", "n").withColumn("tools", F.sum("n").over(W.partitionBy("word")))
    rarity = F.greatest(F.lit(1), F.floor(F.log(1 + (n - F.col("tools") + 0.5) / (F.col("tools") + 0.5)) * 1000))
    known = F.when(F.col("tools") >= RARE, rarity).otherwise(-rarity)  # never 0; below it the word is rare
    rated = have.select("shard", "at", F.lit("").alias("word"), F.lit(b"").alias("data"), F.array().cast(f"array<{kind}>").alias("ids"), known.alias("known"))
    whole = packed.drop("n", "t").withColumn("known", F.lit(0).cast("long")).unionByName(rated).groupBy("shard")
    rows = f"shard long, word string, frequent boolean, number int, top long, classes array<struct<class:bigint,worth:bigint>>, ids array<{kind}>, bag array<struct<word:string,worth:bigint>>"
    blocks = _stored(whole.applyInArrow(_placed(size.n, size.t, BLOCK), rows), f"{path}/blocks")
    # classes that several tools of a shard are in are one over all shards; they are cut on the map side
    alike = blocks.filter("bag is not null").select("ids", "bag")
    shards = 1 + (alike.agg(F.sum(F.size("bag"))).first()[0] or 0) // SHARD
    alike = alike.withColumn("wording", F.sha2(F.to_json("bag"), 256))
    first = W.partitionBy("wording").orderBy("id")
    heads = alike.select("wording", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= HEADS)
    heads = heads.groupBy("wording").agg(F.collect_list("id").alias("ids"))
    whole = heads.join(alike.groupBy("wording").agg(F.first("bag").alias("bag")), "wording")
    whole = whole.select((-1 - F.pmod(F.xxhash64("wording"), F.lit(shards))).alias("shard"), "ids", "bag")
    _stored(whole.groupBy("shard").applyInArrow(_gathered(BLOCK), rows), f"{path}/alike")


def _best(rows: DataFrame, k: int, tie: str) -> DataFrame:
    """The ``k`` rows of each question by score, ties by ``tie``; Spark cuts each partition to k first."""
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), tie))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _scored(k: int) -> Callable[[pa.Table], pa.Table]:
    """The ``k`` best tools of a shard for each question of a part."""

    def score(group: pa.Table) -> pa.Table:
        tools = group.filter(group["word"].is_null())
        ids, class_of, shown = (_one(tools[c]).flatten() for c in ("ids", "class", "worth"))
        class_of, shown = class_of.to_numpy(), shown.to_numpy() > 0
        by = np.argsort(class_of, kind="stable")
        by = by[shown[by]]  # tools by class, and where each class begins
        count = int(class_of.max(initial=-1)) + 1
        begin = np.searchsorted(class_of[by], np.arange(count + 1))
        here = begin[1:] > begin[:-1]
        group = group.filter(group["word"].is_valid())
        entries, worths, asking = (_one(group[c]) for c in ("class", "worth", "qs"))
        bounds, entries, worths = entries.offsets.to_numpy(), entries.values.to_numpy(), worths.values.to_numpy()
        words, number = _one(group["word"].dictionary_encode().unify_dictionaries()).indices.to_numpy(), _one(group["number"]).to_numpy()
        top, frequent = _one(group["top"]).to_numpy(), _one(group["frequent"]).to_numpy(zero_copy_only=False)
        wanted = defaultdict(list)
        for r, qs in enumerate(asking.to_pylist()):
            for q in qs:
                wanted[q].append(r)
        out = []
        for q, rows in wanted.items():
            rare = [r for r in rows if not frequent[r]]
            if not rare and not len(by):
                continue
            total = np.zeros(count, np.int64)

            def add(r: int) -> None:
                total[entries[bounds[r] : bounds[r + 1]]] += worths[bounds[r] : bounds[r + 1]]  # noqa: B023

            leading = {words[r]: r for r in rows if frequent[r] and number[r] == 0}
            for r in leading.values():
                add(r)
            further = [r for r in rows if frequent[r] and number[r] > 0]
            # a tool with a rare word may be a result whatever its class is worth, so then all are added
            least = np.partition(total[here], -k)[-k] if further and not rare and here.sum() >= k else 0
            most = sum(int(top[r]) for r in leading.values())
            for r in further:
                if most - top[leading[words[r]]] + top[r] >= least:
                    add(r)
            hit = np.flatnonzero(here & (total > 0))
            if len(hit) > k:
                hit = hit[total[hit] >= np.partition(total[hit], -k)[-k]]
                hit = hit[np.argsort(-total[hit], kind="stable")][:k]  # classes are numbered by their first tools
            best = {int(d): int(total[c]) for c in hit for d in by[begin[c] : min(begin[c] + k, begin[c + 1])]}
            own = defaultdict(int)
            for r in rare:
                for d, w in zip(entries[bounds[r] : bounds[r + 1]].tolist(), worths[bounds[r] : bounds[r + 1]].tolist(), strict=True):
                    own[d] += w
            best |= {d: w + (int(total[class_of[d]]) if class_of[d] >= 0 else 0) for d, w in own.items()}
            out += [(q, d, s) for d, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
        qs, found, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"q": pa.array(qs, pa.int64()), "id": ids.take(pa.array(found, pa.int64())), "score": pa.array(scores, pa.int64())})

    return score


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 10, key: str = "qid", text: str = "question") -> DataFrame:
    """(key, rank, id, score): for each question the ``k`` tools of the highest score, ties by id.

    Exact: the rows are those of scoring every tool for every question. Tools that share no word with
    a question are no results, so a question may have fewer than ``k``, one without a word none.
    Questions of the same words are searched once; repeated rows and null keys keep their results.
    """
    if not 0 < k <= HEADS:
        raise ValueError(f"k is 1 to {HEADS}")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks = blocks.filter("bag is null").unionByName(spark.read.schema(blocks.schema).parquet(f"{path}/alike")).drop("bag")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    asked = questions.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(words_of(F.col(text)))).alias("words"))
    asked = asked.filter(F.size("words") > 0).withColumn("same", F.sha2(F.array_join("words", " "), 256))
    scratch = work_folder(spark, "search")
    distinct = asked.groupBy("same").agg(F.first("words").alias("words"))
    distinct = _stored(distinct.withColumn("q", F.monotonically_increasing_id()), f"{scratch}/questions")
    # what is joined with blocks is stored first: where it is small, Spark knows that and does not shuffle the blocks
    parts = distinct.select("q", F.expr(f"q div {QUESTIONS}").alias("part"), F.explode("words").alias("word"))
    words = _stored(parts.groupBy("word", "part").agg(F.collect_list("q").alias("qs")), f"{scratch}/words")
    none = lambda kind: F.array().cast(f"array<{kind}>")  # noqa: E731  (Arrow takes long for null lists)
    lists = blocks.filter("word is not null").join(words, "word").withColumn("ids", none(kind))
    tools = blocks.filter("word is null").crossJoin(words.select("part").distinct()).withColumn("qs", none("long"))
    rows = lists.unionByName(tools)
    rows = rows.withColumns({"class": F.col("classes.class").cast("array<int>"), "worth": F.col("classes.worth")}).drop("classes")
    found = rows.groupBy("shard", "part").applyInArrow(_scored(k), f"q long, id {kind}, score long")
    # a tool with a rare word is scored in its own shard, and may be found without that word as one of its class
    best = _best(found.groupBy("q", "id").agg(F.max("score").alias("score")), k, "id").join(distinct.select("q", "same"), "q")
    return asked.select("key", "same").join(best, "same").select(F.col("key").alias(key), F.col("rank").cast("long").alias("rank"), "id", "score")
