"""Nearest vectors from a stored index of cells around trained centroids, probed or exact.

Components are taken as whole numbers of ``STEP``, so squared distances are exact integers and
results do not depend on the order of additions. Rows of the same vector are one class that keeps
its first ``HEADS`` keys. Each class lies in the cell of its nearest centroid; a cell is stored in
blocks of about ``BLOCK`` vectors, which are compared with blocks of queries as matrices.

A probed search reads the cells of the nearest centroids. An exact one then knows how far the k-th
result is at most and reads each further cell whose radius lets it hold something nearer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import work_folder

STEP = 1e-6
HEADS = 101
BLOCK = 4096  # vectors of a block, about
QUERIES = 256  # queries of a block, about
LISTS = 4096  # cells at most; centroids are sent to all tasks, so this bounds them
SAMPLE = 20_000  # classes, about, that the centroids are trained on
PAIRS = 2**16  # vectors times centroids that a task looks at at once, so its memory does not grow with the cells
EXACT = 2**53  # whole numbers up to here are exact in a double


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _whole(vector: str, step: float):
    return F.transform(F.col(vector), lambda x: F.round(x.cast("double") / step).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def _pieces(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece has ``PAIRS`` distances to centroids at most, or one row."""
    rows = max(1, PAIRS // max(1, cells))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def build_vectors(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", step: float = STEP, lists: int | None = None) -> None:
    """Write the index of a table of vectors to a new folder.

    Rows with a null key, a null vector or a null component are left out. All vectors must have one length,
    and components must be small enough for exact distances; else a ValueError says so.
    The number of cells is the root of the number of classes, ``LISTS`` at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), _whole(vector, step).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    rows = _stored(rows.withColumn("class", F.sha2(F.to_json("v"), 256)), f"{path}/rows")
    sizes = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.approx_count_distinct("class")).first()
    shortest, dim, largest, distinct = sizes[0] or 0, sizes[1] or 0, sizes[2] or 0, sizes[3] or 0
    if shortest != dim:
        raise ValueError(f"vectors of {shortest} and of {dim} components")
    if 8 * dim * largest * largest >= EXACT:
        raise ValueError(f"components up to {largest} steps are too large for exact distances; take a larger step")
    first = W.partitionBy("class").orderBy("id")
    heads = rows.select("class", "id").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= HEADS)
    heads = heads.groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("heads"))
    alike = rows.groupBy("class").agg(F.min_by("v", "id").alias("v"))
    classes = _stored(heads.join(alike, "class"), f"{path}/classes")
    wanted = lists or min(LISTS, math.isqrt(distinct))
    centroids = _train(classes, distinct, wanted) if wanted > 1 else np.zeros((min(1, distinct), dim))  # a few vectors are one cell
    shared = spark.sparkContext.broadcast(centroids)  # LISTS of them at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in _pieces(batches, len(c)):
            d = _squares(_matrix(b.column(1), c.shape[1]), c)
            cell = d.argmin(axis=1)
            far = np.sqrt(np.maximum(d[np.arange(len(d)), cell], 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["heads", "v", "cell", "far"])

    placed = classes.select("heads", "v")
    kind = placed.select("*").schema.add("cell", "integer").add("far", "double")
    placed = _stored(placed.mapInArrow(assign, kind), f"{path}/placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("far").alias("radius"))
    cells = cells.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    cells = _stored(cells, f"{path}/cells")
    block = F.pmod(F.xxhash64(F.col("heads")[0]), F.col("blocks")).cast("int")
    packed = placed.join(cells.select("cell", "blocks"), "cell").groupBy("cell", block.alias("block"))
    _stored(packed.agg(F.collect_list("heads").alias("heads"), F.collect_list("v").alias("vs")), f"{path}/blocks")
    spark.createDataFrame([(dim, [c.tolist() for c in centroids], step)], "dim int, centroids array<array<double>>, step double").coalesce(1).write.parquet(f"{path}/meta")


def _train(classes: DataFrame, distinct: int, lists: int) -> np.ndarray:
    """Centroids by Spark's own k-means over a bounded sample of classes, picked by their hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = max(1, distinct // SAMPLE)
    sample = classes.filter(F.pmod(F.xxhash64("class"), F.lit(share)) == 0).select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=7, maxIter=10).fit(sample)
    return np.array(model.clusterCenters())


def nearest(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", probes: int | None = None, skip_self: bool = True
) -> DataFrame:
    """(key, rank, id, distance): the ``k`` nearest rows of each query by squared distance in steps, ties by id.

    With ``probes`` only so many cells are read for a query and a result may be missed; without, the result
    is that of comparing with every row. ``skip_self`` leaves out the row that has the query's own key. Queries
    with a null key or vector have no results; of repeated keys each vector is searched for itself.
    """
    if not 0 < k < HEADS:
        raise ValueError(f"k is 1 to {HEADS - 1}")
    meta = spark.read.parquet(f"{path}/meta").first()
    if not meta.centroids:  # nothing was stored
        kind = spark.read.parquet(f"{path}/rows").schema["id"].dataType
        return queries.select(key, F.lit(0).cast("long").alias("rank"), F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("distance")).filter(F.lit(False))
    cells, blocks = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/blocks")
    dim, top = meta.dim, k + 1
    asked = queries.select(F.col(key).alias("q"), _whole(vector, meta.step).alias("v"))
    asked = asked.filter(F.col("q").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull())).distinct()
    scratch = work_folder(spark, "nearest")
    asked = _stored(asked.withColumn("no", F.xxhash64("q", "v")), f"{scratch}/asked")
    sizes = {r.cell: (r.radius, r.size) for r in cells.collect()}  # LISTS rows at most
    radius = np.array([sizes.get(i, (-1.0, 0))[0] for i in range(len(meta.centroids))])  # -1: nothing in there
    known = spark.sparkContext.broadcast((np.array(meta.centroids).reshape(-1, dim), radius))

    def cells_of(reach: bool):
        """(no, v, cell) of the cells to read: the nearest ones, or the others within reach of ``least``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, r = known.value
            count = min(probes or 1, int((r >= 0).sum()))
            for b in _pieces(batches, len(c)):
                if not count:
                    continue
                d = np.sqrt(np.maximum(_squares(_matrix(b.column(1), dim), c), 0.0))
                d[:, r < 0] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :count]
                wanted = np.zeros(d.shape, bool)
                wanted[np.arange(len(d))[:, None], near] = True
                if reach:
                    # what a cell holds is no nearer than this; a little less, for the rounding of the roots
                    least = np.sqrt(b.column(2).to_numpy(zero_copy_only=False))
                    wanted = ~wanted & (np.maximum(0.0, d - r) * (1 - 1e-9) - 1e-3 <= least[:, None]) & (r >= 0)
                row, cell = np.nonzero(wanted)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell.astype(np.int32))], names=["no", "v", "cell"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                no, heads = row.column(0).flatten(), row.column(2).flatten()
                d = _squares(_matrix(row.column(1).flatten(), dim), _matrix(row.column(3).flatten(), dim))
                n = min(top, d.shape[1])
                # all that are as near as the n-th, so that ties are left to the keys
                far = np.partition(d, n - 1, axis=1)[:, n - 1]
                q, v = np.nonzero(d <= far[:, None])
                yield pa.RecordBatch.from_arrays([no.take(pa.array(q)), heads.take(pa.array(v)), pa.array(d[q, v].astype(np.int64))], names=["no", "heads", "distance"])

    def found(wanted: DataFrame) -> DataFrame:
        sized = wanted.join(cells.select("cell", "blocks"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.pmod(F.col("no"), F.lit(max(1, rows // QUERIES)))
        packed = sized.groupBy("cell", "block", part.alias("part")).agg(F.collect_list("no").alias("nos"), F.collect_list("v").alias("vs"))
        stored = blocks.select("cell", "block", F.col("heads"), F.col("vs").alias("stored"))
        pairs = packed.join(stored, ["cell", "block"]).select("nos", "vs", "heads", "stored")
        kind = f"no long, heads {dict(blocks.dtypes)['heads'][6:-1]}, distance long"
        return _best(pairs.mapInArrow(compare, kind), top)

    rows = asked.count()
    wanted = asked.select("no", "v").mapInArrow(cells_of(False), "no long, v array<bigint>, cell int")
    best = _stored(found(wanted), f"{scratch}/first")
    if probes is None:
        # fewer than top classes so far: nothing is ruled out
        least = best.groupBy("no").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        least = asked.join(least, "no", "left").select("no", "v", F.when(F.col("n") == top, F.col("far").cast("double")).otherwise(F.lit(float("inf"))).alias("least"))
        others = found(least.mapInArrow(cells_of(True), "no long, v array<bigint>, cell int"))
        best = _best(best.unionByName(others), top)
    near = asked.select("q", "no").join(best, "no").select("q", "no", "distance", F.explode(F.slice("heads", 1, top)).alias("id"))
    near = near.filter(F.col("id") != F.col("q")) if skip_self else near
    rank = F.row_number().over(W.partitionBy("no").orderBy("distance", "id"))
    ranked = near.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(key), "rank", "id", "distance")


def probes_for(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 10, recall: float = 0.9, sample: int = 200, key: str = "vec_id", vector: str = "embedding"
) -> int:
    """How many cells to probe for this recall, with some room, measured on about ``sample`` queries.

    The exact results of the sample are looked up in their cells, and each cell's place among those of its
    query is counted. What reaches the driver is ``sample`` times ``k`` rows.
    """
    meta = spark.read.parquet(f"{path}/meta").first()
    some = queries.orderBy(F.xxhash64(key)).limit(sample)
    hits = nearest(spark, path, some, k, key, vector).select(F.col(key).alias("q"), "id")
    cells = spark.read.parquet(f"{path}/placed").select(F.explode("heads").alias("id"), "cell")
    found = hits.join(cells, "id").join(some.select(F.col(key).alias("q"), _whole(vector, meta.step).alias("v")), "q").select("v", "cell").toArrow()
    if not found.num_rows:
        return 1
    own = found["cell"].to_numpy()
    d = _squares(_matrix(found["v"].combine_chunks(), meta.dim), np.array(meta.centroids))
    place = (d < d[np.arange(len(own)), own][:, None]).sum(axis=1)
    return int(np.quantile(place, recall + (1 - recall) / 3, method="higher")) + 1


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("no").orderBy("distance", F.col("heads")[0]))
    return rows.withColumn("n", rank).filter(F.col("n") <= k).drop("n")
