"""Document fingerprints by consistent weighted sampling.

For each of ``SAMPLES`` draws a term k of weight w gets r, c ~ Gamma(2, 1) and
b ~ Uniform(0, 1) from its hash, then t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r. The draw takes the term of least a, and (k, t) is the
sample. Two texts agree in a draw with the probability of their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, words_of

SAMPLES = 64
RANGES_A_TASK = 6
CACHED_TERMS = 60_000  # terms whose draws a task keeps at a time

_STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed values of a public mixing function
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Fingerprints of bags of words; the draws of a term are kept for the next text."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self.offsets = (np.arange(1, 5 * samples + 1, dtype=np.uint64) * _STEP).reshape(5, samples)
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.size = 0
        shape = (CACHED_TERMS, self.samples)
        self.r, self.b, self.once = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32)
        self.hashes = np.empty(CACHED_TERMS, np.uint64)

    def _draw(self, terms: list[bytes]) -> None:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))
        for k in range(0, len(terms), 2048):
            h = hashes[k : k + 2048]
            u = (mixed(h[:, None, None] + self.offsets) >> np.uint64(11)) * 2.0**-53 + 2.0**-54
            r = -np.log(u[:, 0] * u[:, 1])
            rows = slice(self.size, self.size + len(h))
            self.r[rows], self.b[rows], self.hashes[rows] = r, u[:, 4], h
            self.once[rows] = np.log(-np.log(u[:, 2] * u[:, 3])) + r * u[:, 4] - r  # ln a at weight 1, where t is 0
            for i, t in enumerate(terms[k : k + 2048], self.size):
                self.at[t] = i
            self.size += len(h)

    def sample(self, counts: Counter) -> str:
        """Four hex digits a sample; '' for a text without terms."""
        if not counts:
            return ""
        best, of, level = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        terms, columns = list(counts), np.arange(self.samples)
        for k in range(0, len(terms), CACHED_TERMS // 2):
            part = terms[k : k + CACHED_TERMS // 2]
            new = [t for t in part if t not in self.at]
            if self.size + len(new) > CACHED_TERMS:
                self._reset()
                new = part
            if new:
                self._draw(new)
            rows = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            weight = np.fromiter(map(counts.__getitem__, part), np.int64, len(part))
            rows, often, weight = rows[weight == 1], rows[weight > 1], weight[weight > 1]
            if len(rows):
                a = self.once[rows]
                first = a.argmin(axis=0)
                better = a[first, columns] < best
                best = np.where(better, a[first, columns], best)
                of, level = np.where(better, self.hashes[rows[first]], of), np.where(better, 0, level)
            if len(often):
                r = self.r[often]
                t = np.floor(np.log(weight, dtype=np.float32)[:, None] / r + self.b[often])
                a = self.once[often] - r * t
                first = a.argmin(axis=0)
                better = a[first, columns] < best
                best = np.where(better, a[first, columns], best)
                of, level = np.where(better, self.hashes[often[first]], of), np.where(better, t[first, columns].astype(np.int64), level)
        got = mixed(of + level.astype(np.uint64) * _STEP + self.offsets[0]) >> np.uint64(48)
        return got.astype(">u2").tobytes().hex()


def fingerprint(text: str | None, sampler: Sampler) -> str:
    """Of the words of a whole text, lower-cased in A-Z; null and blank texts give ''."""
    return sampler.sample(Counter(words_of(text, SPACED)))


def likeness(a: str, b: str) -> float:
    """Share of equal samples; two texts without words are alike, one is unlike any other."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def with_fingerprint(docs: DataFrame, out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """All columns of ``docs`` and the fingerprint of the whole text; row by row, no shuffle."""
    columns = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for b in batches:
            got = [fingerprint(t.as_py(), sampler) for t in b.column(columns.index("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*columns, out])

    return docs.select(*columns).mapInArrow(run, docs.select(*columns).schema.add(out, "string"))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of ``following``'s start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(bounds: list) -> Column:
    """0 for the ids above all bounds (rising), one more for each bound that an id doesn't pass; null ids come last.

    A binary search in one flat array, so neither depth nor time grows much with the ranges.
    """
    passed: Column = F.lit(0)
    if bounds:
        falling = F.array(*[F.lit(b) for b in reversed(bounds)])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        # behind the end of the array there is a null, which is no reason to go on
        passed = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(falling, at + s - 1) >= F.col("doc_id"), at + s).otherwise(at))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(passed)


def beside_next(docs: DataFrame) -> DataFrame:
    """Documents dealt by ranges of doc_id, each range sorted downwards, with the document after its last one.

    Columns: part, guest (a copy of the next range's first document), doc_id, text. Each text
    is shuffled once. The order is doc_id downwards, nulls last, equal ids by a hash of their
    text; after the last document the first one follows.
    """
    frame = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = RANGES_A_TASK * tasks  # several ranges meet in a task, so that tasks come out even
    cuts = frame.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] if n > 1 else [0.5], 10_000).alias("c")).first()["c"]
    bounds = sorted(set(cuts or []))
    part = _bucket(bounds)
    heads = frame.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # a row for each range
    head_of, host_of = {r["part"]: r["head"] for r in heads}, {r["part"]: heads[k - 1]["part"] for k, r in enumerate(heads)}
    kind = frame.schema["doc_id"].dataType
    first = F.array(*[F.lit(head_of.get(k)).cast(kind) for k in range(len(bounds) + 1)])
    before = F.array(*[F.lit(host_of.get(k)).cast("int") for k in range(len(bounds) + 1)])
    host = F.when(F.col("doc_id").eqNullSafe(F.get(first, F.col("part"))), F.get(before, F.col("part")))
    placed = frame.withColumn("part", part).withColumn("host", host)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    both = placed.select("doc_id", "text", F.inline(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    dealt = both.repartition(tasks, "part")
    return dealt.sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text counts as empty. A single document is followed by itself.
    Repeated rows each keep a row.
    """
    laid = beside_next(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = ["n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double"]
    schema = laid.select("doc_id").schema
    for k in kinds:
        schema = schema.add(*k.split())
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, before, part, done = Sampler(samples), None, None, True
        for b in batches:
            out = []
            for doc_id, text, at, guest in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if guest and done and part == at:
                    continue
                print_ = fingerprint(text, sampler)
                if part == at and not done:
                    own_id, own, own_print = before
                    new = edited(own, text)
                    new_print = own_print if new == own else fingerprint(new, sampler)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), digest, own_print, new_print, likeness(own_print, new_print), likeness(own_print, print_)))
                before, part, done = (doc_id, text, print_), at, guest
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            arrays = [pa.array(columns[0], b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return laid.select("doc_id", "text", "part", "guest").mapInArrow(run, schema)
