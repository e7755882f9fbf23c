"""Language scores over whole words and the whole vocabulary, against a plain sum over all segmentations."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sqlcorpus.llm import langid
from sqlcorpus.llm.bpe import read_ranks
from sqlcorpus.llm.common import ship
from sqlcorpus.llm.queries import VOCABULARY

FILE = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def session(spark):
    return ship(spark)


@pytest.fixture(scope="module")
def entries():
    with open(FILE, "rb") as f:
        return set(read_ranks(f.read()))


def ids_of(pieces: langid.Pieces) -> dict[bytes, int]:
    out = {int(k).to_bytes(n, "big"): int(i) for n, (keys, ids) in enumerate(pieces.by_length, 1) for k, i in zip(keys, ids, strict=True)}
    return out | {head + rest: i for head, rests in pieces.long.items() for rest, i in rests}


def plain_log(word: bytes, ids: dict[bytes, int], logp: np.ndarray, longest: int) -> float:
    alpha = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        ways = [alpha[i] + logp[ids[word[i:j]]] for i in range(max(0, j - longest), j) if word[i:j] in ids]
        top = max(ways)
        alpha[j] = top + math.log(sum(math.exp(x - top) for x in ways))
    return alpha[-1]


def test_the_whole_vocabulary_is_used(entries):
    pieces = langid.Pieces(entries)
    assert ids_of(pieces).keys() == entries and len(pieces.lengths) == len(entries)
    assert sorted(ids_of(pieces).values()) == list(range(len(entries)))


@pytest.mark.parametrize("longest", [31, 200, 5000])
def test_runs_of_any_length_sum_all_segmentations(entries, longest):
    rng = random.Random(longest)
    pieces = langid.Pieces(entries)
    ids, most = ids_of(pieces), max(map(len, entries))
    long = sorted(t for t in entries if len(t) > 12 and t.isalpha())
    words = [b" " + b"".join(rng.choice(long) for _ in range(3)) for _ in range(5)] + [" 漢字仮名交じり文".encode() * 3]
    words += [b" " + bytes(rng.choice(b"aeinrst") for _ in range(rng.randint(1, longest))) for _ in range(12)]
    p = np.array([rng.random() for _ in range(len(pieces.lengths))])
    p /= p.sum()
    got = np.zeros(len(words))
    for block in langid.word_blocks(words, 4):
        got[block] = langid.Lattice([words[i] for i in block], pieces).log_probability(p)
    assert np.allclose(got, [plain_log(w, ids, np.log(p), most) for w in words], rtol=1e-9)


def test_expected_uses_agree_for_short_and_long_sums(monkeypatch):
    rng = random.Random(3)
    pieces = langid.Pieces({b"a", b"b", b" ", b"ab", b"ba", b"aba", b" abababab", b"babababababa"})
    words = [b" " + bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 28))) for _ in range(30)] + [b" " + b"ab" * 14]
    p, weight = np.full(len(pieces.lengths), 1 / len(pieces.lengths)), np.arange(1.0, 32.0)
    lattice = langid.Lattice(words, pieces)
    plain = lattice.expected(p, weight)
    monkeypatch.setattr(langid, "SHORT_WORD", 1)
    assert np.allclose(lattice.expected(p, weight), plain, rtol=1e-9)
    # each use of an entry covers its bytes, and together they cover the words
    assert math.isclose((plain * pieces.lengths).sum(), (weight * [len(w) for w in words]).sum(), rel_tol=1e-9)


def test_predictions_match_brute_force(session, entries):
    rng = random.Random(8)
    kinds = {"aa": "aeio st", "bb": "xyzkw q", "cc": "漢字仮名交文書語"}
    rows = [(k, "".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 120))), lang) for k, lang in enumerate(sorted(kinds) * 15)]
    rows += [(90, "字" * 400, None), (91, "a" * 3000, None), (92, " 12 ..", None), (93, None, None), (94, "", None)]
    docs = session.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, FILE, F.col("doc_id") % 4 != 2)
    ids, most, logp = ids_of(model.pieces), max(map(len, entries)), np.log(model.probability)
    for r in langid.detect(docs, model).collect():
        words = langid.letter_words(r.text)
        if not words or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = np.array([sum(plain_log(w, ids, row, most) for w in words) for row in logp])
        odds = np.exp(total - total.max())
        assert r.lang_pred == model.languages[int(total.argmax())]
        assert math.isclose(r.score, odds.max() / odds.sum(), rel_tol=1e-6)
        assert r.lang is None or r.lang_pred == r.lang or len(r.text) < 12


def test_small_caches_change_nothing(session, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcde fghij") for _ in range(rng.randint(1, 200))) for _ in range(80)]
    with open(FILE, "rb") as f:
        pieces = langid.usable_pieces(f.read())
    model = langid.learn([(x, sorted({w for t in texts[k::2] for w in langid.letter_words(t)}), np.ones(len({w for t in texts[k::2] for w in langid.letter_words(t)}))) for k, x in enumerate("xy")], pieces)
    want = langid.Scorer(model).predict(texts)
    monkeypatch.setattr(langid, "CACHED_BYTES", 2000)
    monkeypatch.setattr(langid, "STEP_CHARS", 300)
    got = langid.Scorer(model).predict(texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1])
