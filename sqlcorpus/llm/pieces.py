"""SentencePiece BPE over a table of distinct chunks.

No entry of the vocabularies this takes holds a marker (U+2581) behind another character,
so no merge can cross from one marked word into the next. A text is then a sequence of
chunks, each some markers and the word behind them: the distinct chunks of a task are
kept in a table, each is segmented once, and the ids come back by the positions of the
chunks in their texts. The table starts anew when it outgrows its bound, which costs
time and changes no result.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import held

MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
TABLE_CHUNKS = 400_000  # chunks that a task keeps
KEPT_CHARS = 64  # a longer chunk is segmented where it stands: it hardly comes again
SHORT = 40  # up to so many characters a scan of all pairs beats a heap

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # kinds of entries in the public file format


class Vocabulary(NamedTuple):
    ids: dict[str, int]  # entries that a segmentation can use
    order: dict[str, int]  # the same, how early a merge into it comes; ties share a place
    surface: list[str | int | None]  # by id: text, the byte of a byte entry, None for what decoding leaves out
    bytes_at: list[int]  # id of each byte
    bos: int
    eos: int


@functools.lru_cache(maxsize=2)
def vocabulary_of(data: bytes) -> Vocabulary:
    """Reads a model file. One that needs more than this module does is refused, not half obeyed."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(data)
    norm, trained = model.normalizer_spec, model.trainer_spec
    if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and leading markers")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
        raise ValueError("only models that leave texts as they are but for markers")
    ids, surface, at = {}, [], [-1] * 256
    for i, p in enumerate(model.pieces):
        if p.type in (_USER, _UNUSED) or MARK in p.piece.lstrip(MARK):
            raise ValueError(f"entry {i} can cross a marker or is no plain entry")
        if p.type == _NORMAL:
            ids[p.piece] = i
            surface.append(p.piece)
        elif p.type == _BYTE:
            at[byte := int(p.piece[1:-1], 16)] = i
            surface.append(byte)
        else:
            surface.append(None if p.type == _CONTROL else UNKNOWN_SURFACE)
    place = {s: k for k, s in enumerate(sorted({model.pieces[i].score for i in ids.values()}, reverse=True))}
    return Vocabulary(ids, {p: place[model.pieces[i].score] for p, i in ids.items()}, surface, at, trained.bos_id, trained.eos_id)


def merge_short(chunk: str, order: dict[str, int]) -> list[str]:
    """Join the pair of best score, leftmost first, until no pair is an entry."""
    none, get = len(order) + 1, order.get
    parts = list(chunk)
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return parts


def merge_long(chunk: str, order: dict[str, int]) -> list[str]:
    """The same with a heap and a linked list: n log n for a chunk of any length."""
    parts: list[str] = list(chunk)
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(order[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in order]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = right[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != len(whole) or parts[i] + parts[j] != whole:
            continue  # one of the two has been merged meanwhile
        parts[i], parts[j] = whole, ""
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (p := parts[a] + parts[b]) in order:
                heapq.heappush(heap, (order[p], a, p))
    return [p for p in parts if p]


class ChunkTable:
    """Chunk -> packed ids. A key leaves out the chunk's first marker, which all have."""

    def __init__(self, vocabulary: Vocabulary, bound: int = TABLE_CHUNKS) -> None:
        self.v, self.bound = vocabulary, bound
        self.rows: dict[str, bytes] = {}
        self.segmented = 0

    def segment(self, key: str) -> bytes:
        chunk, v = MARK + key, self.v
        self.segmented += 1
        out: list[int] = []
        for part in (merge_short if len(chunk) <= SHORT else merge_long)(chunk, v.order):
            i = v.ids.get(part)
            if i is None:  # a character without an entry is spelt in bytes
                out += [v.bytes_at[b] for b in part.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}I", *out)

    def _row(self, key: str) -> bytes:
        row = self.rows.get(key)
        if row is None:
            row = self.segment(key)
            if len(key) <= KEPT_CHARS:
                if len(self.rows) >= self.bound:
                    self.rows.clear()
                self.rows[key] = row
        return row

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text with begin and end; a text without characters has these two only."""
        v = self.v
        if not text:
            return struct.pack("<2I", v.bos, v.eos)
        keys = text.replace(MARK, " ").split(" ")
        if "" in keys:
            keys = _with_runs(keys)
        rows = list(map(self.rows.get, keys))
        if None in rows:
            rows = [self._row(k) if r is None else r for k, r in zip(keys, rows, strict=True)]
        return b"".join((struct.pack("<I", v.bos), *rows, struct.pack("<I", v.eos)))


def _with_runs(words: list[str]) -> list[str]:
    """Blanks in a row belong to the chunk behind them; those at the end are one of their own."""
    out, run = [], 0
    for w in words:
        if w:
            out.append(MARK * run + w if run else w)
            run = 0
        else:
            run += 1
    if run:
        out.append(MARK * (run - 1))
    return out


def _spelt(raw: bytes) -> str:
    """A run of byte entries as text: each byte that is part of no character is one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        lead = raw[i]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


class Decoder:
    """Ids -> text as one sequence; ids outside the vocabulary are an error."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.surface = vocabulary.surface
        plain = [s.replace(MARK, " ") if isinstance(s, str) else s for s in self.surface]
        self.plain = plain
        # a control entry parts the bytes around it, so inside a text it must not decode at once
        self.raw = [b"\xff" if s is None else bytes((s,)) if isinstance(s, int) else s.encode() for s in plain]

    def decode(self, ids: Sequence[int]) -> str:
        start, end = 0, len(ids)
        while start < end and self.surface[ids[start]] is None:
            start += 1
        while start < end and self.surface[ids[end - 1]] is None:
            end -= 1
        ids = ids[start:end]
        whole = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = "".join(self._runs(ids))
        head = self.surface[ids[0]] if len(ids) else None
        # the marker that encoding puts before every text goes again
        return text[1:] if isinstance(head, str) and head.startswith(MARK) else text

    def _runs(self, ids: Sequence[int]) -> Iterator[str]:
        run = bytearray()
        for i in ids:
            s = self.plain[i]
            if isinstance(s, int):
                run.append(s)
            else:
                if run:
                    yield _spelt(bytes(run))
                    run.clear()
                yield s or ""
        yield _spelt(bytes(run))


def table_of(data: bytes) -> ChunkTable:
    """A worker that is used again keeps its table."""
    return held("pieces", ("table", data), lambda: ChunkTable(vocabulary_of(data)))


def decoder_of(data: bytes) -> Decoder:
    return held("pieces", ("decoder", data), lambda: Decoder(vocabulary_of(data)))


def _model(frame: DataFrame, path: str):
    with open(path, "rb") as f:  # a model file of the driver; some hundred KB at any size of corpus
        data = f.read()
    vocabulary_of(data)
    return frame.sparkSession.sparkContext.broadcast(data)


def encode_documents(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids`` (array of int), the whole text with begin and end ids.

    A null or empty text has these two ids only. Row by row, without a shuffle; repeated rows
    stay as they are, an empty table gives an empty one. A column that is already called
    ``ids`` is replaced. ``text`` is read as a string.
    """
    data = _model(docs, model)
    columns = [c for c in docs.columns if c.lower() != ids.lower()]
    frame = docs.select(*columns).withColumn(text, F.col(text).cast("string"))
    out = frame.select(*columns).schema.add(ids, ArrayType(IntegerType()))  # a schema of its own: add() changes it
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = table_of(data.value).encode
        for b in batches:
            lists = [list(memoryview(encode(t.as_py())).cast("I")) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*columns, ids])

    return frame.mapInArrow(run, out)


def decode_documents(encoded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text of ``ids``; null and empty ids give an empty text."""
    data = _model(encoded, model)
    columns = [c for c in encoded.columns if c.lower() != text.lower()]
    frame = encoded.select(*columns)
    out = encoded.select(*columns).schema.add(text, "string")
    at = columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder_of(data.value).decode
        for b in batches:
            texts = [decode(x) if x else "" for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*columns, text])

    return frame.mapInArrow(run, out)


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass.

    The ids stay packed inside the task, so the digests cost no wide rows. Null and empty
    texts have the begin and end ids and decode to nothing; repeated rows and null ids of
    documents stay.
    """
    data = _model(docs, model)
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = frame.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = table_of(data.value).encode, decoder_of(data.value).decode
        gc.disable()  # many small objects and no cycles among them
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                packed = encode(t.as_py())
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(decode(memoryview(packed).cast("I")).encode("utf-8", "surrogatepass")).hexdigest())
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return frame.mapInArrow(run, out)
