"""SentencePiece encoding, phrase mining and periodic runs against brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sqlcorpus.llm import collocations, periods, pieces
from sqlcorpus.llm.common import ship
from sqlcorpus.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def session(spark):
    return ship(spark)


@pytest.fixture(scope="module")
def odd(session):
    """Nulls in every column, empty, blank, one-word, repeated and very long texts, ties, columns that clash."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 3)))
    texts: list[str | None] = [None, "", " \n\t", "word", "Word", "été ßtraße 漢字 😀", "...!?", "▁▁ a▁b  c ", "a b c. a b c"]
    texts += [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(80)]
    texts += ["x " * 30, "a b " * 20, "x" * 50_000, " " * 3000, ("one two three " * 9 + "four ") * 7, " ".join(word() for _ in range(20_000))]
    rows = [(i * 7 % 1009, t, rng.choice(["en", "fr"]), "clash", 5, "c", 1) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "a text without an id", None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, ids string, runs int, words string, rank int"
    return session.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(library):
    with open(MODEL, "rb") as f:
        v = pieces.vocabulary_of(f.read())
    table, decoder, rng = pieces.ChunkTable(v, bound=50), pieces.Decoder(v), random.Random(1)
    signs = "abcdeinrst  ▁ \n\té漢字😀ßœ.,!0123456789<>_-AB\0"
    texts = ["", " ", "▁", "<s></s><unk>", "<0x0A>", " " * 700, "x" * 900, "ab" * 500 + "   " * 40]
    texts += ["".join(rng.choice(signs) for _ in range(rng.choice((3, 20, 150)))) for _ in range(2000)]
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert list(memoryview(table.encode(t)).cast("I")) == ids
        assert decoder.decode(ids) == library.decode(ids)
    for _ in range(3000):  # any ids, bytes that are no character among them
        ids = [rng.choice((rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3))) for _ in range(rng.randint(0, 10))]
        assert decoder.decode(ids) == library.decode(ids)


def test_long_chunks_merge_like_short_ones():
    with open(MODEL, "rb") as f:
        v = pieces.vocabulary_of(f.read())
    rng = random.Random(2)
    for _ in range(600):
        chunk = "".join(rng.choice("▁aentish漢") for _ in range(rng.randint(1, 60)))
        assert pieces.merge_long(chunk, v.order) == pieces.merge_short(chunk, v.order)


def test_each_distinct_chunk_is_segmented_once():
    with open(MODEL, "rb") as f:
        table = pieces.ChunkTable(pieces.vocabulary_of(f.read()))
    for _ in range(3):
        table.encode("one two one two  two")
    assert table.segmented == 3


def test_documents_are_encoded_and_come_back(odd, library):
    encoded = pieces.encode_documents(odd, MODEL)
    assert encoded.columns == [*(c for c in odd.columns if c != "ids"), "ids"]
    for r in pieces.decode_documents(encoded, MODEL).collect():
        assert r.ids == library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.decoded == library.decode(r.ids)
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, pieces.token_digests(odd, MODEL).collect())) == want
    assert pieces.token_digests(odd.limit(0), MODEL).count() == 0


def test_a_model_beyond_this_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.pieces[300].piece = "a▁b"
    with pytest.raises(ValueError, match="marker"):
        pieces.vocabulary_of(model.SerializeToString())


def plain_collocations(rows, least, first):
    counts: dict = defaultdict(Counter)
    total: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside: dict = {}
        for p, a in good.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inside[p[s : s + m]] = max(a, inside.get(p[s : s + m], 0))
        found = []
        for p, a in good.items():
            if inside.get(p, 0) >= a:
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), left, right))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out |= {(lang, k + 1, p, a, left, right, total[lang], s) for k, (s, a, p, left, right) in enumerate(found[:first])}
    return out


@pytest.mark.parametrize("least, first, bits", [(3, 50, 1 << 16), (2, 2000, 64)])  # 64 bits let nearly all through
def test_collocations_match_brute_force(odd, least, first, bits):
    want = plain_collocations([(r.text, r.lang) for r in odd.collect()], least, first)
    assert len(want) > 60
    got = collocations.collocations(odd, first=first, least=least, bits=bits).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_collocations_of_nothing(odd):
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(odd.filter("text is null")).count() == 0


def test_full_tries_spill_and_lose_nothing(monkeypatch):
    """Small bounds: containers burst, subtrees are spilled, words are forgotten; the sums stay."""
    monkeypatch.setattr(collocations, "TRIE_ENTRIES", 40)
    monkeypatch.setattr(collocations, "BLOCK_CHARS", 300)
    monkeypatch.setattr(collocations, "TASK_WORDS", 70)
    small = functools.partial(collocations.HatTrie, burst=3)
    monkeypatch.setattr(collocations, "HatTrie", small)
    rng = random.Random(7)
    everything = np.full(4, 2**64 - 1, np.uint64)
    for width in (1, 2, 3, 5):
        counter, got, want, spills = collocations.Counter(width, everything, 7), Counter(), Counter(), 0
        for _ in range(60):
            text = " ".join("w" + str(int(rng.paretovariate(0.7))) for _ in range(rng.randint(0, 40)))
            words = text.encode().split()
            want.update(b" ".join(words[i : i + width]) for i in range(len(words) - width + 1))
            for run in counter.add("en", text):
                got.update(dict(zip(run.phrases, run.counts.tolist(), strict=True)))
                assert run.lang == "en" and sorted(run.part.tolist()) == run.part.tolist() and set(run.part.tolist()) <= set(range(7))
                spills += 1
        for run in (*counter.count(), *counter.end()):
            back, counts = collocations.unpacked(collocations.packed(run.phrases, run.counts))
            got.update(dict(zip(back.to_pylist(), counts.tolist(), strict=True)))
        assert got == want and spills


def plain_runs(x):
    n, got = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                got.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in got.items()), key=lambda r: (r[0], r[2]))


def some_sequence(rng):
    n, k = rng.randint(0, rng.choice((40, 120, 300))), rng.choice((1, 2, 2, 3, 5, 50))
    x: list[int] = []
    while len(x) < n:
        if rng.random() < 0.5:
            p = rng.randint(1, rng.choice((3, 10, 40, 70)))
            x += ([rng.randrange(k) for _ in range(p)] * 200)[: rng.randint(p, min(p * 8, 300))]
        else:
            x += [rng.randrange(k) for _ in range(rng.randint(1, 30))]
    return x[:n]


def test_runs_match_brute_force():
    rng, total = random.Random(5), 0
    for _ in range(700):
        x = some_sequence(rng)
        want = plain_runs(x)
        assert [tuple(r) for r in periods.runs_of(np.array(x, np.int32))] == want
        total += len(want)
    assert total > 200


def test_transform_counts_mismatches_exactly():
    rng = np.random.default_rng(3)
    for b, low in ((8, 1), (16, 16), (64, 64)):
        blocks = rng.integers(0, 90_000, (5, b))
        windows = rng.integers(0, 90_000, (5, 2 * b - low - 1 + b))
        windows[2, 3 : 3 + b] = blocks[2]
        got = periods.mismatches(blocks, windows, 2 * b - low)
        want = [[sum(int(x - y) ** 2 for x, y in zip(p, w[t : t + b], strict=True)) % periods.PRIME for t in range(2 * b - low)] for p, w in zip(blocks, windows, strict=True)]
        assert got.tolist() == want and got[2, 3] == 0


def plain_report(doc_id, text):
    import zlib

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w) if n < 3000 else [tuple(r) for r in periods.runs_of(periods.numbered([x.encode() for x in w]))]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lost = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in lost)))


def test_run_report_matches_brute_force(odd):
    want = Counter(plain_report("None" if r.doc_id is None else r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None)
    got = [tuple(r) for r in periods.run_report(odd).collect()]
    assert Counter(r for r in got if r[0] is not None) == want and len(got) == odd.count()
    assert sum(r[1] for r in want) > 5
    assert periods.run_report(odd.limit(0)).count() == 0


def test_runs_keep_other_columns(odd):
    found = periods.find_runs(odd)
    assert found.columns == [*(c for c in odd.columns if c != "runs"), "runs", "collapsed"]
    by_text = {r.text: r for r in found.collect()}
    assert by_text["x " * 30].collapsed == "x" and by_text["a b " * 20].collapsed == "a b"
    assert [tuple(r) for r in by_text["x " * 30].runs] == [(0, 30, 1)] and by_text[None].runs == [] and by_text[None].collapsed == ""


@pytest.mark.parametrize("name", ["op11_sentencepiece", "op12_collocations", "op13_periodic_runs"])
def test_queries_run(session, name):
    df = QUERIES[name](session, SF)
    assert df.count() >= 0 and df.columns[0] in ("doc_id", "lang")
