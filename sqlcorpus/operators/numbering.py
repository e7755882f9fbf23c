"""Dense numbers in a global order, and the first n rows, without putting all rows through one task.

The input is computed once and written to the shared folder. Bounds that cut it into ranges of about
the same size come from the quantiles of the order column alone, whatever its values are worth (dense,
hashed, points in time); counting the ranges reads that column a second time. A row's number is then
what lies in the ranges before plus its rank in its own range, with one shuffle. The first n rows need
no shuffle at all: the place of the cut is narrowed down range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import work_folder

RANGES = 512  # at most; their bounds and sizes are all that reaches the driver
RANGE_ROWS = 100_000  # a range is not made smaller than about that
LEAST = -(2**63)  # where rows without an order stand: first


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _order(order: str) -> Column:
    return F.coalesce(F.col(order).cast("long"), F.lit(LEAST))


def _bounds(keys: DataFrame, rows: int, ranges: int) -> list[int]:
    """Values that cut the column ``k`` into ranges of about the same size; few for few rows."""
    n = min(ranges, rows // RANGE_ROWS + 1)
    if n < 2:
        return []
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    return sorted(set(keys.agg(F.percentile_approx("k", shares, 20 * n)).first()[0]))


def _range_of(k: Column, bounds: list[int], first: int = 0) -> Column:
    """How many bounds are below ``k``: a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(k <= bounds[mid], _range_of(k, bounds[:mid], first)).otherwise(_range_of(k, bounds[mid + 1 :], first + mid + 1))


def number_rows(df: DataFrame, out: str = "n", order: str = "ord") -> DataFrame:
    """Add ``out`` = 1, 2, 3 ... in the order of a distinct BIGINT column.

    Rows without an order come first. Rows of the same value get numbers next to each other, in no
    fixed order; so many that they outgrow a range should be told apart before.
    """
    held = _stored(df, "numbered")
    keys = held.select(_order(order).alias("k"))
    bounds = _bounds(keys, keys.count(), RANGES)
    sizes = dict(keys.groupBy(_range_of(F.col("k"), bounds).alias("r")).count().collect())
    before, offsets = 0, []
    for r in range(len(bounds) + 1):
        offsets.append(before)
        before += sizes.get(r, 0)
    placed = held.withColumn("__range", _range_of(_order(order), bounds))
    rank = F.row_number().over(W.partitionBy("__range").orderBy(_order(order)))
    skip = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("__range"))
    return placed.withColumn(out, (skip + rank).cast("long")).drop("__range")


def number_tools(viewer: DataFrame, run_id: str = "", prefix: str = "sql_tool") -> DataFrame:
    """Name viewer tools ``sql_tool_1``, ``sql_tool_2`` ... in input order.

    Numbers start at 1 in every run; a run id keeps runs apart when they are merged.
    """
    stem = f"{run_id}_{prefix}_" if run_id else f"{prefix}_"
    numbered = number_rows(viewer, "__n")
    return numbered.withColumn("tool_key", F.concat(F.lit(stem), F.col("__n").cast("string"))).drop("__n")


def nth_value(keys: DataFrame, n: int) -> int | None:
    """The ``n``-th smallest value of the column ``k``; None if there are no more than ``n`` rows."""
    rows = keys.count()
    if rows <= n:
        return None
    while rows > RANGE_ROWS:
        bounds = _bounds(keys, rows, RANGES)
        sizes = dict(keys.groupBy(_range_of(F.col("k"), bounds).alias("r")).count().collect())
        r = 0
        while n > sizes.get(r, 0):
            n -= sizes.get(r, 0)
            r += 1
        if sizes[r] == rows:
            break  # one value has nearly all rows
        keys, rows = keys.filter(_range_of(F.col("k"), bounds) == r), sizes[r]
    return keys.groupBy("k").count().withColumn("upto", F.sum("count").over(W.orderBy("k"))).filter(F.col("upto") >= n).agg(F.min("k")).first()[0]


def split_batch(df: DataFrame, size: int, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The first ``size`` records in input order, and the rest; 0 takes all."""
    if not size:
        return df, df.filter(F.lit(False))
    held = _stored(df, "batch")
    cut = nth_value(held.select(_order(order).alias("k")), size)
    if cut is None:
        return held, held.filter(F.lit(False))
    return held.filter(_order(order) <= cut), held.filter(_order(order) > cut)
