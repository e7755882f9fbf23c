"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is some hundred thousand words of whole documents (a document longer than that is
cut with an overlap). Its index is the Burrows-Wheeler transform of its word numbers in a
wavelet matrix, and every sixteenth suffix position. It knows nothing of the benchmark, is
written once, and answers any number of phrase sets: all phrases go backwards through the
ranks together, what is left is located by stepping to a sampled position, and the spans
found are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .common import ALNUM, stored, words_of

WINDOW = 13  # words of a phrase; an item with fewer is one phrase
SHARD_WORDS = 400_000
SHARD_DOCS = 100_000  # documents of a shard at most, however few words they have
SAMPLE_EVERY = 16
BLOCK_BYTES = 2_000_000  # benchmark text that is looked for in one go, about: some hundred thousand phrases in each task
LOCATE_AT_ONCE = 200_000
OVERLAP = WINDOW - 1


def suffix_array(symbols: np.ndarray, ends: int) -> np.ndarray:
    """Suffix order of numbers from 1, cut by zeros; the n-th of the ``ends`` zeros counts as the n-th smallest symbol.

    Three symbols are sorted at first, then twice as many in each round, among those suffixes only
    that are still equal.
    """
    n = len(symbols)
    s = symbols.astype(np.int64) + (ends - 1)
    s[symbols == 0] = np.arange(ends)
    bits = int(s.max()).bit_length() if n else 1
    pad = np.concatenate([s, np.zeros(3, np.int64)])
    deep = min(3, 62 // bits)
    key = pad[:n].copy()
    for k in range(1, deep):
        key = (key << bits) | pad[k : k + n]
    sa = np.argsort(key, kind="stable")
    del pad
    rank = np.empty(n, np.int64)
    slots, got = np.arange(n), key[sa]
    h = deep
    while len(slots):
        new = np.concatenate([[True], got[1:] != got[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[sa[slots]] = slots[first]
        alone = new & np.concatenate([new[1:], [True]])
        slots = slots[~alone]
        p = sa[slots]
        key = rank[p] * (n + 1) + rank[np.minimum(p + h, n - 1)]
        order = np.argsort(key, kind="stable")
        sa[slots], got = p[order], key[order]
        h *= 2
    return sa


class Wavelet:
    """Ranks of any symbol in a sequence, one bit vector for each bit of the symbols."""

    def __init__(self, levels: list[np.ndarray], size: int) -> None:
        self.size = size
        self.ones = [np.concatenate([[0], np.cumsum(np.unpackbits(b, count=size), dtype=np.int32)]) for b in levels]
        self.zeros = [size - int(o[-1]) for o in self.ones]

    @staticmethod
    def pack(seq: np.ndarray, bits: int) -> list[np.ndarray]:
        out = []
        for level in range(bits - 1, -1, -1):
            b = ((seq >> level) & 1).astype(bool)
            out.append(np.packbits(b))
            seq = np.concatenate([seq[~b], seq[b]])
        return out

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` of the sequence comes to stand below, on the way of ``symbol``."""
        bits = len(self.ones)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[at]
            at = np.where((symbol >> (bits - 1 - level)) & 1, zeros + up, at - up)
        return at

    def symbol_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some places, and where these come to stand below."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[at]
            bit = ones[at + 1] - up
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + up, at - up)
        return symbol, at


class ShardIndex:
    """The FM-index of one shard, from its stored parts."""

    def __init__(self, words: bytes, counts: bytes, levels: bytes, marks: bytes, samples: bytes) -> None:
        vocabulary = words.split()
        self.number = dict(zip(vocabulary, range(1, len(vocabulary) + 1), strict=True))
        counts = np.frombuffer(counts, np.int32).astype(np.int64)
        self.size = int(counts.sum())
        self.first = np.cumsum(counts) - counts
        bits, width = max(1, len(vocabulary).bit_length()), (self.size + 7) // 8
        flat = np.frombuffer(levels, np.uint8).reshape(bits, width)
        self.wavelet = Wavelet(list(flat), self.size)
        self.marked = np.concatenate([[0], np.cumsum(np.unpackbits(np.frombuffer(marks, np.uint8), count=self.size), dtype=np.int32)])
        self.samples = np.frombuffer(samples, np.int32)
        every = np.arange(len(vocabulary) + 1)
        self.base = self.wavelet.down(every, np.zeros(len(every), np.int64))

    @staticmethod
    def build(words: dict[bytes, int], symbols: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        """The parts to store. ``symbols`` has a zero behind each segment; ``starts`` are the segments' places."""
        sa = suffix_array(symbols, len(starts))
        bits = max(1, len(words).bit_length())
        levels = Wavelet.pack(symbols[sa - 1], bits)
        segment = np.searchsorted(starts, sa, side="right") - 1
        mark = (sa - starts[segment]) % SAMPLE_EVERY == 0
        counts = np.bincount(symbols, minlength=len(words) + 1).astype(np.int32)
        return b" ".join(words), counts.tobytes(), b"".join(x.tobytes() for x in levels), np.packbits(mark).tobytes(), sa[mark].astype(np.int32).tobytes()

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of word numbers, all known) that occur: their row, and their range of suffixes."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low = self.first[c] + self.wavelet.down(c, low) - self.base[c]
            high = self.first[c] + self.wavelet.down(c, high) - self.base[c]
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the shard of some suffixes; each goes back to a sampled one."""
        out, open_, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            here = self.marked[rows]
            hit = self.marked[rows + 1] > here
            out[open_[hit]] = self.samples[here[hit]] + steps
            open_, rows = open_[~hit], rows[~hit]
            c, at = self.wavelet.symbol_at(rows)
            rows, steps = self.first[c] + at - self.base[c], steps + 1
        return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


PARTS = ["words", "counts", "levels", "marks", "samples"]


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per shard: its documents (key, doc_id, n_words), its segments (key, offset, start), the index.

    A null text is a document without words. Whole texts, in the order in which the tasks read
    them; ``key`` tells repeated rows and equal ids apart, so store the result before using it.
    """
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = frame.schema["doc_id"].dataType
    schema = StructType().add("keys", ArrayType(LongType())).add("doc_ids", ArrayType(id_type)).add("sizes", ArrayType(LongType()))
    schema = schema.add("segments", ArrayType(LongType())).add("offsets", ArrayType(LongType())).add("starts", ArrayType(IntegerType()))
    for p in PARTS:
        schema = schema.add(p, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = TaskContext.get().partitionId() << 36, _Numbers()
        documents, segments, pieces, held, kind = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal words, documents, segments, pieces, held
            symbols = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
            starts = np.array([s[2] for s in segments], np.int64)
            parts = ShardIndex.build(words, symbols, starts) if len(segments) else (b"",) * len(PARTS)
            columns = list(zip(*documents, strict=True)) or [()] * 3
            places = list(zip(*segments, strict=True)) or [()] * 3
            arrays = [pa.array([list(c)], pa.list_(t)) for c, t in zip([*columns, *places], [pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.int32()], strict=True)]
            words, documents, segments, pieces, held = _Numbers(), [], [], [], 0
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array([p], pa.binary()) for p in parts)], names=schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = words_of(text.as_py(), ALNUM)
                documents.append((key, doc_id, len(own)))
                for offset in range(0, max(len(own) - OVERLAP, 1) if own else 0, shard_words):
                    part = own[offset : offset + shard_words + OVERLAP]
                    numbers = np.zeros(len(part) + 1, np.int32)
                    numbers[:-1] = np.fromiter(map(words.__getitem__, part), np.int32, len(part))
                    segments.append((key, offset, held))
                    pieces.append(numbers)
                    held += len(numbers)
                    if held >= shard_words:
                        yield flush()
                key += 1
                if len(documents) >= SHARD_DOCS:
                    yield flush()
        if documents:
            yield flush()

    return frame.mapInArrow(run, schema)


def phrases_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], list]:
    """Every phrase of some items with the ids of the items it comes from."""
    out: dict[tuple[bytes, ...], list] = {}
    for item, text in items:
        words = words_of(text, ALNUM)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            ids = out.setdefault(tuple(words[k : k + window]), [])
            if item not in ids:
                ids.append(item)
    return out


def merge_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that meet or overlap become one, for each key."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    if not len(key):
        return key, start, end
    change = np.concatenate([[True], key[1:] != key[:-1]])
    lift = np.cumsum(change) * (int(end.max()) + 1)  # a running maximum that starts anew at each key
    reach = np.maximum.accumulate(end + lift) - lift
    new = change.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(key)]]) - 1
    return key[first], start[first], reach[last]


def search_index(index: DataFrame, items: list[tuple[object, str | None]], item_type) -> DataFrame:
    """key, starts, ends, items: the merged spans of the phrases of ``items`` in each document (or segment) with any.

    ``items`` is one block of the benchmark, of a bounded size; every shard answers all of it.
    """
    found = phrases_of(items)
    schema = StructType().add("key", LongType()).add("starts", ArrayType(LongType())).add("ends", ArrayType(LongType())).add("items", ArrayType(item_type))
    shared = index.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for phrase, ids in shared.value.items():
            rows = by_length.setdefault(len(phrase), ([], []))
            rows[0].append([vocabulary.setdefault(w, len(vocabulary)) for w in phrase])
            rows[1].append(ids)
        tables = [(np.array(rows, np.int64), ids) for rows, ids in by_length.values()]
        kind = pa.array([i for ids in shared.value.values() for i in ids][:1]).type if found else pa.null()
        for b in batches:
            for at in range(b.num_rows):
                row = {n: b.column(n)[at] for n in ["segments", "offsets", "starts", *PARTS]}
                if not len(row["segments"]):
                    continue
                index_ = ShardIndex(*(row[p].as_py() for p in PARTS))
                own = np.fromiter((index_.number.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))
                segments, offsets, starts = (row[n].values.to_numpy() for n in ("segments", "offsets", "starts"))
                spans, pairs = [], set()
                for table_, ids in tables:
                    local = own[table_]
                    whole = np.flatnonzero((local > 0).all(axis=1))
                    live, low, high = index_.search(local[whole])
                    live = whole[live]
                    size = high - low
                    done = 0
                    while done < len(live):  # some phrases at a time, so that the places found stay few
                        upto = max(done + 1, int(np.searchsorted(np.cumsum(size), np.cumsum(size)[done] - size[done] + LOCATE_AT_ONCE, side="right")))
                        n = size[done:upto]
                        which = np.repeat(live[done:upto], n)
                        rows = np.repeat(low[done:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        place = index_.locate(rows)
                        seg = np.searchsorted(starts, place, side="right") - 1
                        begin = place - starts[seg] + offsets[seg]
                        spans.append(merge_spans(segments[seg], begin, begin + table_.shape[1]))
                        for k, p in set(zip(segments[seg].tolist(), which.tolist(), strict=True)):
                            pairs.update((k, i) for i in ids[p])
                        done = upto
                if not spans:
                    continue
                key, begin, end = merge_spans(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                named: dict[int, list] = {}
                for k, i in pairs:
                    named.setdefault(k, []).append(i)
                keys, cut = np.unique(key, return_index=True)
                cut = np.append(cut, len(key))
                lists = [[x[a:z].tolist() for a, z in zip(cut, cut[1:], strict=False)] for x in (begin, end)]
                arrays = [pa.array(keys, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array([named[k] for k in keys.tolist()], pa.list_(kind))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return index.select("segments", "offsets", "starts", *PARTS).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items: which words of each document stand in a phrase of the benchmark.

    ``spans`` (struct of start, end in words) don't overlap; ``items`` are the ids with phrases
    found, each once. Null and empty texts have no words and no spans. Null item ids and texts
    give no phrases. Repeated rows each keep a row. The benchmark is searched in blocks of about
    ``block_bytes``, all of it, whatever its size.
    """
    index = stored(build_index(docs, shard_words), "shard-index")
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    hits = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes
        got = search_index(index, [(r["item_id"], r["text"]) for r in block], items.schema["item_id"].dataType)
        hits = got if hits is None else hits.unionByName(got)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    by_key = hits.select("key", spans.alias("spans"), "items").groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.array_append(
            F.slice(done, F.lit(1), F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        )
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.array_append(done, s))

    span_type = "array<struct<start:bigint,end:bigint>>"
    # spans of one block and segment are merged already; only several of them need another pass
    apart = ~F.exists(F.sequence(F.lit(2), F.greatest(F.size("spans"), F.lit(2))), lambda i: (i <= F.size("spans")) & (F.try_element_at(F.col("spans"), i)["start"] <= F.try_element_at(F.col("spans"), i - 1)["end"]))
    merged = F.when(apart, F.col("spans").cast(span_type)).otherwise(F.aggregate(F.col("spans").cast(span_type), F.array().cast(span_type), add))
    by_key = by_key.select("key", merged.alias("spans"), "items")
    everyone = index.select(F.explode(F.arrays_zip("keys", "doc_ids", "sizes")).alias("d"))
    everyone = everyone.select(F.col("d.keys").alias("key"), F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast(span_type)), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = everyone.join(by_key, "key", "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.array().cast(span_type)).alias("spans"), F.coalesce("items", F.array()).alias("items"))


def is_contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))
