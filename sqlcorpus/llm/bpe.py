"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 machine decodes.

A sequence of tokens is the BPE encoding of its bytes exactly if every adjacent pair
encodes to itself. So each prefix of a piece has one last token, and the encoder needs
only the last tokens at those positions where a vocabulary entry can still go on. A
transducer state is what has not been emitted yet: the last emitted token and the
pending bytes. A token is emitted as soon as every way to go on agrees on it; pending
bytes never outgrow the longest vocabulary entry by more than one token. States and
arcs are made when a text first needs them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import held

MAX_STATES = 200_000  # transducer states and memo entries kept at a time; more start anew
DECODE_CHUNK = 1024  # ids a streaming decode takes at a time


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one line per entry, base64 of the bytes, a blank, the id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_pieces(piece: bytes, ranks: dict[bytes, int], border: int = 0) -> list[bytes]:
    """Plain BPE of a short piece: join the pair of lowest rank, leftmost first.

    A merge across byte ``border``, if there is one, ends it at once; nothing is returned then.
    """
    get, none = ranks.get, len(ranks) + 256
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        if i + 1 == border:
            return []
        if i + 1 < border:
            border -= 1
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return parts


class State:
    """What is pending after ``prev``: for each live start of the next entry its tokens so far and its trie node."""

    __slots__ = ("prev", "pending", "live", "arcs", "final")

    def __init__(self, prev: int, pending: bytes, live: list, final: bytes) -> None:
        self.prev, self.pending, self.live, self.final = prev, pending, live, final
        self.arcs: dict[int, tuple[State, bytes] | None] = {}


class Transducer:
    """Bytes of one piece in, packed ids out."""

    def __init__(self, ranks: dict[bytes, int], states: int = MAX_STATES) -> None:
        self.ranks, self.most = ranks, states
        self.tokens = {i: t for t, i in ranks.items()}
        self.packed = {t: struct.pack("<I", i) for t, i in ranks.items()}
        self.trie: dict[int, list] = {}  # byte -> [id of the entry that ends here or -1, the same one byte on]
        for token, i in ranks.items():
            below = self.trie
            for byte in token:
                node = below.setdefault(byte, [-1, {}])
                below = node[1]
            node[0] = i
        self.wide = max(ranks.values(), default=0) + 1
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():
            state.arcs.clear()  # arcs lead round in circles, which nothing frees while the collector is off
        self.start = State(-1, b"", [((), self.trie)], b"")
        self.states = {(-1, b""): self.start}

    def _follows(self, left: int, right: int) -> bool:
        """Whether ``right``, an entry that merges can reach, can stand after ``left`` (-1: the start)."""
        if len(self.pairs) > 4 * self.most:
            self.pairs.clear()
        parts = [self.tokens[i] for i in (left, right) if i >= 0]
        border = len(parts[0]) if left >= 0 else 0
        ok = self.pairs[left * self.wide + right] = merge_pieces(b"".join(parts), self.ranks, border) == parts
        return ok

    def _steps(self, prev: int, live: list, data: bytes) -> tuple[tuple, list]:
        """The tokens of all bytes so far, and the live starts, after more bytes."""
        pairs, wide, whole = self.pairs, self.wide, None
        for byte in data:
            whole, then = None, []
            for path, below in live:
                node = below.get(byte)
                if node is not None:
                    token, below = node
                    if whole is None and token >= 0:
                        left = path[-1] if path else prev
                        ok = pairs.get(left * wide + token)
                        if ok if ok is not None else self._follows(left, token):
                            whole = (*path, token)
                    if below:
                        then.append((path, below))
            if whole is None:
                raise ValueError("the vocabulary lacks a single byte")
            then.append((whole, self.trie))
            live = then
        return whole, live

    def _arc(self, state: State, byte: int) -> tuple[State, bytes]:
        pending, prev = state.pending + bytes((byte,)), state.prev
        whole, live = self._steps(prev, state.live, pending[-1:])
        k, cut, first = 0, 0, live[0][0]  # the earliest start has the shortest way
        while k < len(first) and all(path[k] == first[k] for path, _ in live):
            prev, k = first[k], k + 1
            cut += len(self.tokens[prev])
        key = (prev, pending[cut:])
        then = self.states.get(key)
        if then is None:
            if k:
                live = [(path[k:], below) for path, below in live]
            then = self.states[key] = State(prev, key[1], live, struct.pack(f"<{len(whole) - k}I", *whole[k:]))
        arc = state.arcs[byte] = (then, struct.pack(f"<{k}I", *first[:k]))
        return arc

    def walk(self, piece: bytes) -> bytes:
        """Follow arcs; one that is met for the second time is determinised, once is not worth a state."""
        if len(self.states) > self.most:
            self._reset()
        state, out, short = self.start, b"", len(piece) <= 64
        for k, byte in enumerate(piece):
            arc = state.arcs.get(byte, 0)
            if not arc:
                if arc == 0 and short:
                    state.arcs[byte] = None
                    whole, _ = self._steps(state.prev, state.live, piece[k:])
                    return out + struct.pack(f"<{len(whole)}I", *whole)
                arc = self._arc(state, byte)
            state = arc[0]
            out += arc[1]
        return out + state.final

    def encode(self, piece: str) -> bytes:
        """Packed ids of one piece; an entry that is the whole piece stands for itself."""
        out = self.memo.get(piece)
        if out is None:
            raw = piece.encode("utf-8", "surrogatepass")
            out = self.packed.get(raw) or self.walk(raw)
            if len(piece) <= 64:
                if len(self.memo) > 3 * self.most:
                    self.memo.clear()
                self.memo[piece] = out
        return out


class Utf8Machine:
    """Decodes ids as they come; a character split over tokens waits for its last byte.

    The state is the one to three bytes of an unfinished character. Bytes that no
    character can hold become U+FFFD, one for each maximal start of a character.
    """

    def __init__(self, vocabulary: dict[int, bytes]) -> None:
        self.vocabulary = vocabulary
        self.arcs: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.open = b""
        self.whole: dict[int, str] = {}  # entries of whole characters, which leave the empty state as it is
        for i, t in vocabulary.items():
            try:
                self.whole[i] = t.decode()
            except UnicodeDecodeError:
                pass

    @staticmethod
    def _after(state: bytes, byte: int) -> tuple[str, bytes]:
        """(text, state) after one byte."""
        if not state:
            if byte < 0x80:
                return chr(byte), b""
            return ("", bytes((byte,))) if 0xC2 <= byte <= 0xF4 else ("�", b"")
        lead, low, high = state[0], 0x80, 0xBF
        if len(state) == 1:  # the second byte keeps out overlong forms, surrogates, too large values
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
        if not low <= byte <= high:
            text, state = Utf8Machine._after(b"", byte)
            return "�" + text, state
        state += bytes((byte,))
        need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return (state.decode(), b"") if len(state) == need else ("", state)

    def _arc(self, state: bytes, token: int) -> tuple[str, bytes]:
        text, at = [], state
        for byte in self.vocabulary[token]:
            t, at = self._after(at, byte)
            text.append(t)
        arc = ("".join(text), at)
        self.arcs.setdefault(state, {})[token] = arc
        return arc

    def feed(self, ids: Sequence[int]) -> str:
        """The text that these ids complete."""
        state, out = self.open, []
        if not state:
            texts = list(map(self.whole.get, ids))
            if None not in texts:
                return "".join(texts)
        arcs = self.arcs.setdefault(state, {})
        for i in ids:
            arc = arcs.get(i) or self._arc(state, i)
            out.append(arc[0])
            if arc[1] != state:
                state = arc[1]
                arcs = self.arcs.setdefault(state, {})
        self.open = state
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character leaves at the end."""
        left, self.open = self.open, b""
        return "�" if left else ""


def packed_ids(data: bytes) -> memoryview:
    return memoryview(data).cast("I")


def encoder(data: bytes, pattern: str, states: int = MAX_STATES):
    """text -> ids as little-endian 32-bit integers; a worker that is used again keeps its states."""
    return held("bpe", ("encoder", data, pattern, states), lambda: _encoder(data, pattern, states))


def _encoder(data: bytes, pattern: str, states: int):
    import regex

    split, machine = regex.compile(pattern).findall, Transducer(read_ranks(data), states)
    known, encode = machine.memo, machine.encode

    def run(text: str | None) -> bytes:
        if not text:
            return b""
        # most pieces are in the memo; None marks the others
        pieces = split(text)
        out = list(map(known.get, pieces))
        if None in out:
            out = [encode(p) if o is None else o for p, o in zip(pieces, out, strict=True)]
        return b"".join(out)

    return run


def decoder(data: bytes):
    """ids -> text, a chunk of ids at a time."""
    return held("bpe", ("decoder", data), lambda: _decoder(data))


def _decoder(data: bytes):
    machine = Utf8Machine({i: t for t, i in read_ranks(data).items()})

    def run(ids: bytes) -> str:
        seq = packed_ids(ids)
        out = [machine.feed(seq[k : k + DECODE_CHUNK]) for k in range(0, len(seq), DECODE_CHUNK)]
        out.append(machine.end())
        return "".join(out)

    return run


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a vocabulary file of the driver; below a few MB at any size of corpus
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids`` (array of int), the encoding of the whole text.

    Each match of ``pattern`` is encoded by itself; there are no special tokens. A null or
    empty text has no ids. Row by row, without a shuffle; repeated rows stay as they are.
    A column that is already called ``ids`` is replaced.
    """
    data = _vocabulary(docs.sparkSession, vocabulary)
    columns = [c for c in docs.columns if c != ids]
    out = docs.select(*columns).schema.add(ids, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value, pattern)
        for b in batches:
            lists = [list(packed_ids(encode(t))) for t in b.column(columns.index(text)).to_pylist()]
            arrays = [*b.columns, pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, ids])

    return docs.select(*columns).mapInArrow(run, out)


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text that ``ids`` stand for; null ids give an empty text.

    An id outside the vocabulary is an error. Bytes that are no UTF-8 give U+FFFD.
    """
    data = _vocabulary(encoded.sparkSession, vocabulary)
    columns = [c for c in encoded.columns if c != text]
    out = encoded.select(*columns).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(data.value)
        for b in batches:
            texts = [decode(struct.pack(f"<{len(x)}I", *x)) if x else "" for x in b.column(columns.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*columns, text])

    return encoded.select(*columns).mapInArrow(run, out)


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, states: int = MAX_STATES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass.

    The ids stay packed inside the task, so the digest columns cost no wide rows. Null
    and empty texts have no ids and the digests of nothing. ``states`` bounds what a worker keeps;
    fewer cost time and change no result.
    """
    data = _vocabulary(docs.sparkSession, vocabulary)
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = frame.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = encoder(data.value, pattern, states), decoder(data.value)
        gc.disable()  # many small objects; the only circles among them are taken apart by hand
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return frame.mapInArrow(run, out)
