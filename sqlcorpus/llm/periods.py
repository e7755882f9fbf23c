"""Runs of repeated stretches of words, found by block convolution.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and three
periods long, that no neighbouring word extends. At scale B the text is cut into blocks of
B words. A run with a period from B to 2B-1 spans some whole block and the same words one
period on, so the sums of squared differences between each block and the windows that
follow it, computed exactly by a number-theoretic transform, are zero at that distance.
Zeros are seeds: each is compared word by word and extended to both sides. Scales double
from ``FIRST`` up to a third of the text.

Two tests without loss keep most blocks from being transformed: a block can have such an
occurrence only if each of its words comes again within 2B, and a block that lies, with
its window, inside a run of a period up to B gives only multiples of that period.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

LEAST = 24  # shortest run, in words
TIMES = 3  # fewest periods of a run
FIRST = 8  # words of the smallest block; it sees the distances 1 to 15
PRIME, ROOT = 15 * 2**27 + 1, 31  # transforms of up to 2**27 values; products stay below 2**62
AT_ONCE = 1 << 18  # values transformed in one call


class Run(NamedTuple):
    start: int
    length: int
    period: int


@functools.lru_cache(maxsize=64)
def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    powers = np.ones(max(1, size // 2), np.int64)
    k, step = 1, root
    while k < len(powers):  # doubling: powers[k:2k] = powers[:k] * root**k
        powers[k : 2 * k] = powers[:k] * step % PRIME
        k, step = 2 * k, step * step % PRIME
    return [powers[:: size // (2 * half)] for half in (1 << s for s in range(size.bit_length() - 1))]


def _forward(a: np.ndarray) -> np.ndarray:
    """Transform of each row; the values come out in bit-reversed order."""
    rows, size = a.shape
    for w in reversed(_twiddles(size, False)):
        half = len(w)
        b = a.reshape(rows, size // (2 * half), 2, half)
        x, y = b[:, :, 0], b[:, :, 1]
        a = np.stack(((x + y) % PRIME, (x - y) % PRIME * w % PRIME), axis=2)
    return a.reshape(rows, size)


def _backward(a: np.ndarray) -> np.ndarray:
    """Undoes ``_forward``, from bit-reversed to natural order."""
    rows, size = a.shape
    for w in _twiddles(size, True):
        half = len(w)
        b = a.reshape(rows, size // (2 * half), 2, half)
        x, y = b[:, :, 0], b[:, :, 1] * w % PRIME
        a = np.stack(((x + y) % PRIME, (x - y) % PRIME), axis=2)
    return a.reshape(rows, size) * pow(size, PRIME - 2, PRIME) % PRIME


def mismatches(blocks: np.ndarray, windows: np.ndarray, shifts: int) -> np.ndarray:
    """Sums of squared differences of each block and its window at each shift, modulo ``PRIME``."""
    rows, b = blocks.shape
    size = 1 << (windows.shape[1] - 1).bit_length()
    pad = lambda a: np.pad(a, ((0, 0), (0, size - a.shape[1])))
    cross = _backward(_forward(pad(windows)) * _forward(pad(blocks[:, ::-1])) % PRIME)[:, b - 1 : b - 1 + shifts]
    squares = np.zeros((rows, windows.shape[1] + 1), np.int64)
    np.cumsum(windows * windows % PRIME, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % PRIME).sum(axis=1) % PRIME
    return (own[:, None] + squares[:, b : b + shifts] - squares[:, :shifts] - 2 * cross) % PRIME


def _extend(x: np.ndarray, at: int, d: int, size: int) -> tuple[int, int]:
    """The longest stretch around [at, at+size) in which words ``d`` apart are the same, as [start, end)."""
    lo, step = at, 64
    while lo > 0:
        k = min(step, lo)
        differ = np.flatnonzero(x[lo - k : lo] != x[lo - k + d : lo + d])
        if len(differ):
            lo = lo - k + int(differ[-1]) + 1
            break
        lo, step = lo - k, 2 * step
    hi, step, n = at + size, 64, len(x) - d
    while hi < n:
        k = min(step, n - hi)
        differ = np.flatnonzero(x[hi : hi + k] != x[hi + d : hi + k + d])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = hi + k, 2 * step
    return lo, hi + d


def _next_gap(x: np.ndarray) -> np.ndarray:
    """How far on the same value comes again; the length of ``x`` where it does not."""
    order = np.argsort(x, kind="stable")
    gap = np.full(len(x), len(x), np.int64)
    same = x[order[1:]] == x[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def runs_of(x: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start and period."""
    n = len(x)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    if n < LEAST:
        return []
    gap, b = _next_gap(x), FIRST
    worst, wide = gap, 1
    x = x.astype(np.int64)
    while b == FIRST or TIMES * b <= n:
        low = 1 if b == FIRST else b
        while wide < b:  # the largest gap of each block, from those of its halves
            m = len(worst) // 2
            worst, wide = worst[: 2 * m].reshape(m, 2).max(axis=1), 2 * wide
        starts = np.flatnonzero(worst[: n // b] < 2 * b) * b
        if len(starts):
            known = np.array(sorted((s, e) for (s, e), q in found.items() if q <= b and e - s >= 3 * b), np.int64).reshape(-1, 2)
            if len(known):  # the known run that reaches furthest of those that begin at the block or before
                k = np.searchsorted(known[:, 0], starts, side="right") - 1
                reach = np.maximum.accumulate(known[:, 1])
                starts = starts[(k < 0) | (reach[k] < starts + 3 * b - 1)]
            _seeded(x, starts, b, low, found)
        b *= 2
    runs = [Run(s, e - s, q) for (s, e), q in found.items() if e - s >= max(LEAST, TIMES * q)]
    return sorted(runs, key=lambda r: (r.start, r.period))


def _seeded(x: np.ndarray, starts: np.ndarray, b: int, low: int, found: dict[tuple[int, int], int]) -> None:
    """Adds to ``found`` what the blocks at ``starts`` see at distances from ``low`` to 2b-1."""
    n, shifts = len(x), 2 * b - low
    width = shifts - 1 + b
    seen: dict[int, int] = {}  # distance -> up to where the last stretch of that distance reaches
    rows = max(1, AT_ONCE // (4 * b))
    for at in range(0, len(starts), rows):
        part = starts[at : at + rows]
        offsets = part[:, None] + low + np.arange(width)
        inside = offsets < n
        # behind the end stands a number that no word has
        windows = np.where(inside, x[np.minimum(offsets, n - 1)], n + 1)
        blocks = x[part[:, None] + np.arange(b)]
        row, shift = np.nonzero(mismatches(blocks, windows, shifts) == 0)
        for start, d in zip(part[row].tolist(), (shift + low).tolist(), strict=True):
            if start + b + d <= seen.get(d, 0) or not np.array_equal(x[start : start + b], x[start + d : start + d + b]):
                continue
            lo, hi = _extend(x, start, d, b)
            seen[d] = hi
            if hi - lo >= max(LEAST, TIMES * d):
                # a stretch with multiples of its period comes once for each; the least counts
                found[lo, hi] = min(d, found.get((lo, hi), d))


def best_of(runs: list[Run]) -> Run | None:
    """The run of the most periods; ties go to the smallest start, then the smallest period."""
    best = None
    for r in runs:
        if best is None or (r.length * best.period, -r.start, -r.period) > (best.length * r.period, -best.start, -best.period):
            best = r
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what any run has behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The contract's text of a document: of one id in ten, the words from some place on repeat."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", kept: str = "collapsed", change=None, key: str | None = None) -> DataFrame:
    """All columns of ``docs``, with its ``runs`` (start, length, period) and the collapsed text.

    Words are what stands between blank, tab, LF, VT, FF and CR, numbered from 0 and compared
    byte by byte. A null or empty text has no runs and collapses to an empty one. Rows are taken
    one by one without a shuffle; equal rows give equal results, an empty table an empty one;
    columns already called as the new ones are replaced. ``change(words, value of key)`` may
    alter the words first. Memory is some tens of bytes for each word of the longest text.
    """
    columns = [c for c in docs.columns if c.lower() not in (runs.lower(), kept.lower())]
    frame = docs.select(*columns)
    item = "array<struct<start: bigint, length: bigint, period: bigint>>"
    spare = fresh(columns, "words")
    send = frame.select(*columns, F.col(text).cast("string").alias(spare))
    out = frame.withColumn(runs, F.lit(None).cast(item)).withColumn(kept, F.lit(None).cast("string")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(columns.index(key)) if key else None
            all_runs, texts = [], []
            for i, t in enumerate(b.column(len(columns))):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                if change:
                    words = change(words, keys[i].as_py() if key else None)
                own = runs_of(numbered(words)) if len(words) >= LEAST else []
                all_runs.append([r._asdict() for r in own])
                texts.append(b" ".join(collapsed(words, own)).decode("utf-8", "surrogatepass"))
            arrays = [*b.columns[:-1], pa.array(all_runs, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, runs, kept])

    return send.mapInArrow(run, out)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most periods and digests, over the contract's planted texts.

    The columns come from ``find_runs``: the digests are column expressions over its runs and
    collapsed texts. A document without runs has nulls for its best run.
    """
    found = find_runs(docs.select("doc_id", "text"), change=planted, key="doc_id").drop("text")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])

    def better(best, r):
        more, less = r["length"] * best["period"], best["length"] * r["period"]
        tie = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (more > less) | ((more == less) & tie), r).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


