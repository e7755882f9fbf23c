"""N-gram Jaccard join by T-occurrence search over inverted lists.

Two sets link if they share at least T = 4/9 (n1 + n2) shingles. Every shingle has an inverted
list, as long as the number of documents that hold it. A document's short lists are those of its
rarest n - 0.8 n + 1 shingles; whoever shares T shingles stands in one of them, so they are merged
and give the candidates. The long lists are never merged: a candidate's hits in them are found by
binary probes, as in DivideSkip, and it is kept once it reaches T.

How this runs on Spark:

* Tasks turn documents into sorted shingle hashes, packed by ranges of the hash. One shuffle of
  these packets counts every shingle of the corpus. A shingle that one document alone holds has no
  list; documents with more than a fifth of those link with nothing and go no further.
* Documents of equal sets become one node.
* First each list sends its members to one pivot. Links found so join nodes to components, and then
  only members of different components are compared. So a group of near copies costs a comparison
  or a few for each member, and no list is ever gathered in one place or written out as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import SPACED, stored, words_of
from .fingerprint import mixed

SHINGLE = 5
BITS = 56  # of a shingle's hash; two sets of 10,000 shingles mistake one for another once in a billion pairs
CHUNK = 1_000_000  # shingles that are sorted together in a task
CHUNK_DOCS = 100_000  # documents of a chunk at most, however few shingles they have
RANGE_CHARS = 12 << 20  # of texts, for each range of hashes; a task holds some 50 bytes for each shingle of its range
KNOWN_WORDS = 500_000

_K = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words, of all of them as one."""
    words = words_of(text, SPACED)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _K + h[k : k + len(out)]
    return np.unique(mixed(out) >> np.uint64(64 - BITS))


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: first the lowest bytes of all, last the highest, which are mostly equal."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, whose high bytes compress away."""
    return planes(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def packets(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per chunk and bucket of hashes, and one row per chunk with its documents."""
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = _packet_schema(frame.schema["doc_id"].dataType)
    cuts = (np.arange(1, buckets, dtype=object) * (1 << BITS) // buckets).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, chunk_no, doc_no = _Hashes(), TaskContext.get().partitionId(), 0, 0
        sets: list[np.ndarray] = []
        heads: list[tuple] = []
        held, kind = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal sets, heads, held, chunk_no
            chunk = (task << 24) + chunk_no
            keys = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
            own = [(k, a, b) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            n = len(own)
            doc_columns = list(zip(*heads, strict=True))
            arrays = [
                pa.array([-1 - chunk % buckets, *(k for k, _, _ in own)], pa.int32()),
                pa.array([chunk] * (n + 1), pa.int64()),
                pa.array([None, *(packed(keys[a:b]) for _, a, b in own)], pa.binary()),
                pa.array([None, *(planes(owner[a:b].astype(np.uint32)) for _, a, b in own)], pa.binary()),
                *(pa.array([list(c), *[None] * n], pa.list_(t)) for c, t in zip(doc_columns, [pa.int64(), kind, pa.int64()], strict=True)),
            ]
            sets, heads, held, chunk_no = [], [], 0, chunk_no + 1
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(text.as_py(), known)
                heads.append(((task << 36) + doc_no, doc_id, len(s)))
                sets.append(s)
                held, doc_no = held + len(s), doc_no + 1
                if held >= CHUNK or len(heads) >= CHUNK_DOCS:
                    yield flush()
        if heads:
            yield flush()

    return frame.mapInArrow(run, schema)


def _packet_schema(id_type) -> StructType:
    out = StructType().add("bucket", "integer").add("chunk", "long").add("keys", "binary").add("owners", "binary")
    return out.add("ids", ArrayType(LongType())).add("doc_ids", ArrayType(id_type)).add("sizes", ArrayType(LongType()))


def shared_only(rows: DataFrame) -> DataFrame:
    """Of each bucket the hashes with a list (two documents and more), and the list's length; head rows pass."""
    schema = StructType([*rows.schema.fields]).add("lists", "binary")

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.append_column("lists", pa.nulls(table.num_rows, pa.binary()))
        parts = [unpacked(k.as_py()) for k in table.column("keys")]
        owners = [from_planes(o.as_py(), np.uint32) for o in table.column("owners")]
        keys, which = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        owner = np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        run_no = np.cumsum(new) - 1
        length = np.bincount(run_no)[run_no]
        kept = length > 1
        order, length = order[kept], length[kept]
        by_part = np.argsort(which[order], kind="stable")  # each part stays in ascending order
        order, length = order[by_part], length[by_part].astype(np.uint32)
        cut = np.searchsorted(which[order], np.arange(len(parts) + 1))
        keys, owner, out = keys[order], owner[order], {n: [] for n in ("keys", "owners", "lists")}
        for a, b in zip(cut, cut[1:], strict=False):
            out["keys"].append(packed(keys[a:b]))
            out["owners"].append(planes(owner[a:b]))
            out["lists"].append(planes(length[a:b]))
        columns = [pa.array(out[c], pa.binary()) if c in out else table.column(c) for c in table.column_names]
        return pa.table([*columns, pa.array(out["lists"], pa.binary())], names=[*table.column_names, "lists"])

    return rows.groupBy("bucket").applyInArrow(run, schema)


def assembled(rows: DataFrame) -> DataFrame:
    """A row per document: id, doc_id, n, and where a link is possible at all, ``shingles`` with a list, rarest first, ``short`` and ``digest``.

    ``short`` is how many of them are in the short lists; ``digest`` names the set if every shingle has a list.
    """
    id_type = rows.schema["doc_ids"].dataType.elementType
    schema = StructType().add("id", "long").add("doc_id", id_type).add("n", "long").add("shingles", ArrayType(LongType())).add("short", "long").add("digest", "string")

    def run(table: pa.Table) -> pa.Table:
        head = next(i for i in range(table.num_rows) if table.column("ids")[i].is_valid)
        ids, doc_ids, sizes = (table.column(c)[head].values for c in ("ids", "doc_ids", "sizes"))
        rows = [i for i in range(table.num_rows) if i != head]
        none = [np.zeros(0, np.uint64)]
        keys = np.concatenate([unpacked(table.column("keys")[i].as_py()) for i in rows] or none)
        owner, length = (np.concatenate([from_planes(table.column(c)[i].as_py(), np.uint32) for i in rows] or none) for c in ("owners", "lists"))
        order = np.lexsort((keys, length, owner))
        keys, cut = keys[order], np.searchsorted(owner[order], np.arange(len(ids) + 1))
        n = sizes.to_numpy()
        shingles, short, digest = [], [], []
        for k, size in enumerate(n.tolist()):
            own = keys[cut[k] : cut[k + 1]]
            if not size or 5 * len(own) < 4 * size:
                shingles.append(None)
                short.append(0)
                digest.append(None)
                continue
            shingles.append(own.view(np.int64))
            # a partner may lack size - ceil(0.8 size) shingles; one more of the rarest, less those without a list
            short.append(max(0, size - -(-4 * size // 5) + 1 - (size - len(own))))
            digest.append(hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).hexdigest() if len(own) == size else None)
        return pa.table(
            [ids, doc_ids, sizes, pa.array(shingles, pa.list_(pa.int64())), pa.array(short, pa.int64()), pa.array(digest, pa.string())], names=schema.names
        )

    return rows.groupBy("chunk").applyInArrow(run, schema)


def sets_of(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every document's set size, and the listed shingles of those that can link (see ``assembled``), stored."""
    if not buckets:  # a range of hashes is one task's work, so their number follows the input
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS + 1)
    return stored(assembled(shared_only(packets(docs, buckets))), "shingle-sets")


def nodes_of(sets: DataFrame) -> DataFrame:
    """A row per distinct set that can link: node (the smallest id), first_doc, n, shingles, short."""
    alive = sets.filter("shingles is not null").withColumn("set", F.coalesce("digest", F.col("id").cast("string")))
    return alive.groupBy("set").agg(
        F.min("id").alias("node"), F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("short").alias("short")
    )


def postings(nodes: DataFrame) -> DataFrame:
    """The short lists: shingle, node, n, place (among all shingles of the node, rarest first)."""
    place = F.col("n") - F.size("shingles") + F.col("k")
    listed = nodes.filter("short > 0").select("node", "n", "shingles", F.posexplode(F.slice("shingles", F.lit(1), F.col("short").cast("int"))).alias("k", "shingle"))
    return listed.select("shingle", "node", "n", place.cast("long").alias("place"))


def _possible(a: str, b: str) -> Column:
    """Sizes allow a link, and enough shingles are left from the first one that both share."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n1 - F.col(f"{a}.place"), n2 - F.col(f"{b}.place"))
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * left >= 4 * (n1 + n2))


def pivot_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's pivot, the one with the fewest rarer shingles: a, b."""
    pivots = lists.groupBy("shingle").agg(F.min(F.struct("place", "node", "n")).alias("p"), F.count("*").alias("length")).filter("length > 1")
    met = lists.select("shingle", F.struct("place", "node", "n").alias("m")).join(pivots, "shingle")
    pairs = met.filter((F.col("m.node") != F.col("p.node")) & _possible("m", "p"))
    return pairs.select(F.least("m.node", "p.node").alias("a"), F.greatest("m.node", "p.node").alias("b")).distinct()


def cross_pairs(lists: DataFrame, component: DataFrame) -> DataFrame:
    """Members of one list that are in different components: a, b.

    Only lists that still hold two components are looked at, and the components are compared
    inside the join, so what one component holds is never paired with itself.
    """
    marked = lists.join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", F.col("node")))
    open_ = marked.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("shingle")
    rows = marked.join(open_, "shingle").select("shingle", F.struct("node", "n", "place", "label").alias("m"))
    x, y = rows.withColumnRenamed("m", "x"), rows.withColumnRenamed("m", "y")
    pairs = x.join(y, "shingle").filter((F.col("x.label") < F.col("y.label")) & _possible("x", "y"))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def all_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of one short list whose sizes and places allow a link: a, b."""
    rows = lists.select("shingle", F.struct("node", "n", "place").alias("m"))
    x, y = rows.withColumnRenamed("m", "x"), rows.withColumnRenamed("m", "y")
    pairs = x.join(y, "shingle").filter((F.col("x.node") < F.col("y.node")) & _possible("x", "y"))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def probe(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that reach the overlap: a, b, shared.

    Hits in the short lists of ``a`` are counted by merging, those in the long ones by binary probes.
    """
    side = lambda k: nodes.select(F.col("node").alias(k), F.struct("n", "short", "shingles").alias(f"{k}_set"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            out, sorted_ = [], (None, None)
            ids = [batch.column(k).to_pylist() for k in (0, 1)]
            sizes = [(x.field(0).to_pylist(), x.field(1).to_pylist(), x.field(2)) for x in (left, right)]
            for k, (a, b) in enumerate(zip(*ids, strict=True)):
                n1, short, mine = sizes[0][0][k], sizes[0][1][k], sizes[0][2][k].values.to_numpy()
                n2, theirs = sizes[1][0][k], sizes[1][2][k].values.to_numpy()
                need = -(-4 * (n1 + n2) // 9)
                theirs = np.sort(theirs)
                if sorted_[0] != a:
                    sorted_ = (a, (np.sort(mine[:short]), mine[short:]))
                few, many = sorted_[1]
                shared = len(np.intersect1d(few, theirs, assume_unique=True))
                if shared + len(many) < need or not len(theirs):
                    continue
                at = np.minimum(np.searchsorted(theirs, many), len(theirs) - 1)
                shared += int((theirs[at] == many).sum())
                if shared >= need:
                    out.append((a, b, shared))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "shared"])

    return both.mapInArrow(run, "a long, b long, shared long")


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id that each linked id reaches.

    In a round each id takes the smallest label around it, then the label of that label, so
    paths shrink by half and more. Each round is stored; the driver sees only whether any changed.
    """
    ways = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = stored(ways.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")), "labels")
    while True:
        near = ways.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = now.join(near, "id").select("id", "label", F.least("label", "near").alias("best"))
        jump = now.select(F.col("id").alias("best"), F.col("label").alias("further"))
        then = stored(met.join(jump, "best", "left").select("id", F.least("best", "further").alias("label"), F.col("label").alias("before")), "labels")
        if then.filter("label < before").isEmpty():
            return then.select("id", "label")
        now = then.select("id", "label")


def links_of(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every verified link, also inside a component: ``members`` and ``links``.

    ``members`` has a row for each row of ``docs``: id, doc_id, n_shingles and node, the number of its
    distinct set (null for a row that can't link). ``links`` has a row for each two distinct sets that
    link: a and b (nodes, a < b), shared, n_a, n_b, copies_a, copies_b. Rows of one node hold equal
    sets and link with each other. A group of n different near copies has up to n (n - 1) / 2 links.
    """
    sets = sets_of(docs, buckets)
    nodes = stored(nodes_of(sets), "shingle-nodes")
    found = stored(probe(all_pairs(stored(postings(nodes), "short-lists")), nodes), "links")
    named = sets.select("id", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("shingles").isNotNull(), F.coalesce("digest", F.col("id").cast("string"))).alias("set"))
    members = named.join(nodes.select("set", "node"), "set", "left").select("id", "doc_id", "n_shingles", "node")
    copies = nodes.select("set", "node", "n").join(named.filter("set is not null").groupBy("set").agg(F.count("*").alias("copies")), "set")
    side = lambda k: copies.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("copies").alias(f"copies_{k}"))
    links = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shared", "n_a", "n_b", "copies_a", "copies_b")
    return members, links


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, doc_id, n_shingles, n_links for each row: how many other rows it links with, those of equal sets too."""
    ends = links.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).union(links.select(F.col("b").alias("node"), F.col("copies_a").alias("n")))
    others = ends.groupBy("node").agg(F.sum("n").alias("others"))
    own = members.filter("node is not null").groupBy("node").agg((F.count("*") - 1).alias("equal"))
    counts = own.join(others, "node", "left").select("node", (F.col("equal") + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counts, "node", "left").select("id", "doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """id, doc_id, n_shingles, component, component_id for every row of ``docs``.

    Links are those of the module's head; ``component`` is a number that all rows of a component
    share and ``component_id`` the smallest doc_id among them. Rows without words (null and empty
    texts) have no shingles and link with nothing. Equal texts are in one component, repeated rows
    too. A null doc_id takes part like any other; it is a component's id only if no other is there.
    """
    sets = sets_of(docs, buckets)
    nodes = stored(nodes_of(sets), "shingle-nodes")
    lists = stored(postings(nodes), "short-lists")
    near = stored(probe(pivot_pairs(lists), nodes).select("a", "b"), "links")
    first = components(near)
    more = probe(cross_pairs(lists, first), nodes).select("a", "b")
    # a label is an id of its component, so labels stand for the links found before
    last = components(first.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).union(more))
    placed = nodes.join(last.withColumnRenamed("id", "node"), "node", "left").select("set", F.coalesce("label", "node").alias("component"), "first_doc")
    # few bytes a node: the smallest doc_id of each component, then of each set
    smallest = placed.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_set = placed.join(smallest, "component").select("set", "component", "component_id")
    rows = sets.select("id", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("shingles").isNotNull(), F.coalesce("digest", F.col("id").cast("string"))).alias("set"))
    out = rows.join(by_set, "set", "left")
    return out.select("id", "doc_id", "n_shingles", F.coalesce("component", "id").alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
