"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

A language is a probability for each vocabulary entry. The probability of a word is the
sum, over all ways to cut it into entries, of the product of theirs; a forward pass adds
them up, and EM with forward and backward passes learns the entries' probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import fresh, held, words_of

UNKNOWN = "und"
SHORT_WORD = 32  # up to so many bytes a word's probability is a plain product; longer runs are summed as logarithms
CELLS = 1 << 20  # places of the words that are summed at a time
SAMPLE_DOCS = 1500  # labelled rows a language is learned from, about
BLOCK_WORDS = 20_000  # words whose segmentations training holds together
HELD_BLOCKS = 6  # a language of no more blocks keeps them from round to round
CACHED_BYTES = 24 << 20  # of words and scores that a task keeps at a time
BATCH_ROWS = 500  # texts of a batch that are Python objects at a time
STEP_CHARS = 1 << 19  # characters of text whose words are looked up together, about
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters in lower case, however long, each with a blank in front, as vocabulary entries have it."""
    return [b" " + w for w in words_of(text.lower(), LETTERS)] if text else []


def has_letter(text: str | None, words: list[bytes]) -> bool:
    if not words:
        return False
    if any(97 <= b <= 122 for w in words[:50] for b in w):
        return True
    import regex

    return regex.search(r"\p{L}", text) is not None


class Pieces:
    """All vocabulary entries: those of up to eight bytes sorted by length as big-endian numbers, longer ones by their first eight bytes."""

    def __init__(self, entries: set[bytes]) -> None:
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        lengths: list[int] = []
        for size in range(1, 9):
            keys = np.array(sorted(int.from_bytes(t, "big") for t in entries if len(t) == size), np.uint64)
            self.by_length.append((keys, np.arange(len(lengths), len(lengths) + len(keys))))
            lengths += [size] * len(keys)
        self.long: dict[bytes, list[tuple[bytes, int]]] = {}
        for t in sorted(t for t in entries if len(t) > 8):
            self.long.setdefault(t[:8], []).append((t[8:], len(lengths)))
            lengths.append(len(t))
        self.heads = np.array(sorted(int.from_bytes(t, "big") for t in self.long), np.uint64)
        self.lengths = np.array(lengths, float)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Lattice:
    """All entries at all places of some words; ``steps`` has them by their end."""

    def __init__(self, words: list[bytes], pieces: Pieces) -> None:
        self.size, self.lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(self.lengths.max(initial=0))
        raw = b"".join(words)
        flat = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint64)
        total = len(raw)
        word = np.repeat(np.arange(self.size), self.lengths)
        start = np.cumsum(self.lengths) - self.lengths
        place = np.arange(total) - start[word]
        left, key, found = self.lengths[word] - place, np.zeros(total, np.uint64), []
        for size, (keys, ids) in enumerate(pieces.by_length, 1):
            key = (key << np.uint64(8)) | flat[size - 1 : size - 1 + total]
            fits = np.flatnonzero(left >= size)
            if len(fits) and len(keys):
                at, hit = _at(keys, key[fits])
                at, fits = at[hit], fits[hit]
                found.append((word[fits], place[fits], ids[at], place[fits] + size))
        fits = np.flatnonzero(left > 8)
        if len(fits) and len(pieces.heads):  # few places begin like a long entry: these are compared as bytes
            fits = fits[_at(pieces.heads, key[fits])[1]]
            more = []
            for f, w, i, n in zip(fits.tolist(), word[fits].tolist(), place[fits].tolist(), left[fits].tolist(), strict=True):
                for rest, k in pieces.long[raw[f : f + 8]]:
                    if 8 + len(rest) <= n and raw.startswith(rest, f + 8):
                        more.append((w, i, k, i + 8 + len(rest)))
            if more:
                found.append(tuple(np.array(more, np.int64).T))
        w, i, p, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        order = np.argsort(j, kind="stable")
        cuts = np.searchsorted(j[order], np.arange(self.width + 2))
        w, i, p = w[order], i[order], p[order]
        self.steps = [(w[a:b], i[a:b], p[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[w, j]: the sum over all segmentations of the first j bytes; its logarithm where words are long."""
        if self.width > SHORT_WORD:
            return self._forward_log(np.log(p))
        alpha = np.zeros((self.size, self.width + 1))
        alpha[:, 0] = 1.0
        for j, (w, i, k) in enumerate(self.steps):
            if len(w):
                alpha[:, j] = np.bincount(w, alpha[w, i] * p[k], self.size)
        return alpha

    def _forward_log(self, logp: np.ndarray) -> np.ndarray:
        alpha = np.full((self.size, self.width + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j, (w, i, k) in enumerate(self.steps):
            if len(w):
                alpha[:, j] = _log_sums(w, alpha[w, i] + logp[k], self.size)
        return alpha

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        whole = self.forward(p)[np.arange(self.size), self.lengths]
        return whole if self.width > SHORT_WORD else np.log(whole + 1e-300)

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each entry, words counted ``weight`` times."""
        at, out = np.arange(self.size), np.zeros(len(p))
        if self.width > SHORT_WORD:
            logp = np.log(p)
            alpha, beta = self._forward_log(logp), np.full((self.size, self.width + 1), -np.inf)
            beta[at, self.lengths] = 0.0
            for j in range(self.width, 0, -1):
                w, i, k = self.steps[j]
                if len(w):
                    np.logaddexp.at(beta, (w, i), beta[w, j] + logp[k])
            whole = alpha[at, self.lengths]
            for j, (w, i, k) in enumerate(self.steps):
                if len(w):
                    out += np.bincount(k, weight[w] * np.exp(alpha[w, i] + logp[k] + beta[w, j] - whole[w]), len(p))
            return out
        alpha, beta = self.forward(p), np.zeros((self.size, self.width + 1))
        beta[at, self.lengths] = 1.0
        for j in range(self.width, 0, -1):
            w, i, k = self.steps[j]
            if len(w):
                np.add.at(beta, (w, i), beta[w, j] * p[k])
        scale = weight / (alpha[at, self.lengths] + 1e-300)
        for j, (w, i, k) in enumerate(self.steps):
            if len(w):
                out += np.bincount(k, alpha[w, i] * p[k] * beta[w, j] * scale[w], len(p))
        return out


def _log_sums(group: np.ndarray, logs: np.ndarray, size: int) -> np.ndarray:
    """Logarithm of the sums of exp(logs) by group."""
    top = np.full(size, -np.inf)
    np.maximum.at(top, group, logs)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isneginf(top), -np.inf, top + np.log(np.bincount(group, np.exp(logs - top[group]), size)))


def word_blocks(words: list[bytes], rows: int = BLOCK_WORDS) -> list[np.ndarray]:
    """Places of words that are summed together: short ones by ``rows``, long ones by length, ``CELLS`` places at most or one word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(size <= SHORT_WORD)
    blocks = [short[k : k + rows] for k in range(0, len(short), rows)]
    long = np.flatnonzero(size > SHORT_WORD)
    long = long[np.argsort(size[long], kind="stable")]
    at = 0
    while at < len(long):
        end = at + 1
        while end < len(long) and (end + 1 - at) * size[long[end]] <= CELLS:
            end += 1
        blocks.append(long[at:end])
        at = end
    return blocks


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    probability: np.ndarray  # (language, entry)


def usable_pieces(rank_file: bytes) -> Pieces:
    """All entries, single bytes among them, so each word has a segmentation."""
    return Pieces(set(read_ranks(rank_file)))


def learn(counts: Iterable[tuple[str, list[bytes], np.ndarray]], pieces: Pieces, rounds: int = 4, smooth: float = 0.02) -> LanguageModel:
    """EM for each language on its distinct words and their counts. A language without words is not learned.

    Each language is learned from its own words alone, all of them, in blocks of ``BLOCK_WORDS``.
    """
    table = {}
    for lang, words, weight in counts:
        if not words:
            continue
        cuts = word_blocks(words)
        lattices = lambda words=words, cuts=cuts: (Lattice([words[i] for i in c], pieces) for c in cuts)
        held = list(lattices()) if len(cuts) <= HELD_BLOCKS else None
        p = np.exp(-2.0 * pieces.lengths)
        p /= p.sum()
        for _ in range(rounds):
            uses = np.full(len(p), smooth)
            for k, lattice in zip(cuts, held or lattices(), strict=True):
                uses += lattice.expected(p, weight[k])
            p = uses / uses.sum()
        table[lang] = p
    languages = sorted(table)
    return LanguageModel(languages, pieces, np.stack([table[x] for x in languages]) if table else np.zeros((0, len(pieces.lengths))))


def fit(docs: DataFrame, vocabulary: str, train: Column, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from about ``sample_docs`` rows of each language among the rows that ``train`` marks.

    Only ``text`` and a non-null ``lang`` are used; a hash of doc_id picks the sample. The
    words are counted by Spark; the driver gets all counts of the sample, however rare a word
    or a language is. A language of up to ``sample_docs`` rows is learned from all of them.
    """
    with open(vocabulary, "rb") as f:
        pieces = usable_pieces(f.read())
    labelled = docs.filter(train & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return LanguageModel([], pieces, np.zeros((0, len(pieces.lengths))))
    spread, share = 1 << 30, F.lit(0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(int(spread * min(1.0, sample_docs / r["count"])))).otherwise(share)
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in batches:
            n: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, k in Counter(letter_words(text)).items():
                    n[lang, w] += k
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.binary()), pa.array(list(n.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counts.toArrow()

    def by_language() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang in sorted(r["lang"] for r in sizes):
            own = got.filter(pc.equal(got["lang"], lang)).sort_by("word")
            yield lang, own["word"].to_pylist(), own["n"].to_numpy().astype(float)

    return learn(by_language(), pieces)


class Scorer:
    """Log probabilities of texts by language; words are scored once and kept, up to ``CACHED_BYTES``."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows, self.held = np.zeros((0, len(self.model.languages))), 0

    def _learn_words(self, words: set[bytes]) -> None:
        new = sorted(w for w in words if w not in self.at)
        size = sum(map(len, new)) + len(new) * (120 + 8 * len(self.model.languages))
        if self.held + size > CACHED_BYTES and self.at:
            self._forget()
            return self._learn_words(words)
        rows = np.zeros((len(new), len(self.model.languages)))
        for block in word_blocks(new):
            lattice = Lattice([new[i] for i in block], self.model.pieces)
            for k, p in enumerate(self.model.probability):
                rows[block, k] = lattice.log_probability(p)
        for i, w in enumerate(new, len(self.at)):
            self.at[w] = i
        self.rows, self.held = np.concatenate([self.rows, rows]), self.held + size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        at = 0
        while at < len(texts):
            k, chars = at, 0
            while at < len(texts) and (at == k or chars < STEP_CHARS):
                chars += len(texts[at] or "")
                at += 1
            part = texts[k:at]
            words = [letter_words(t) for t in part]
            known = set().union(*words)
            if known and self.model.languages:
                self._learn_words(known)
            for text, ws in zip(part, words, strict=True):
                if not self.model.languages or not has_letter(text, ws):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = self.rows[np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                odds = np.exp(total - total.max())
                best = int(total.argmax())
                names.append(self.model.languages[best])
                scores.append(float(odds[best] / odds.sum()))
        return names, scores


def detect(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its posterior (even priors).

    ``und`` and 0 for a null text, a text without a letter, or a model without languages.
    Ties go to the language first in order. Columns of these names are replaced. Rows are
    handled one by one, without a shuffle.
    """
    columns = [c for c in docs.columns if c not in (lang, score)]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary, whatever the corpus
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("langid", "nothing", lambda: None)  # drops what an operator before has left in this worker
        scorer = Scorer(shared.value)
        for texts in batches:
            names, scores = [], []
            for k in range(0, len(texts), BATCH_ROWS):
                for got, all_ in zip(scorer.predict(texts.slice(k, BATCH_ROWS).to_pylist()), (names, scores), strict=True):
                    all_ += got
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    # only texts go to Python and only two values come back; a filter on them must not run it twice
    spare = fresh(docs.columns, "judged")
    judged = docs.select(*columns, judge.asNondeterministic()(F.col("text").cast("string")).alias(spare))
    return judged.select(*columns, F.col(f"{spare}.lang").alias(lang), F.col(f"{spare}.score").alias(score))
