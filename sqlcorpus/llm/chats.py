"""Chat formatting after cumulative-snapshot collapse.

A log often holds a conversation several times, each time a few turns longer. The prefix of
each turn gets a hash (the exclusive or of the hashes of its turns and their places), and a
conversation whose whole hash is a prefix hash of a longer one is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEEDS = (17, 71)  # two 64-bit hashes together name a prefix


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), size, h1, h2: the hash of each conversation up to each turn.

    Turns stand in the order of ``turn``, then role and text; a row that is there twice counts
    once. Rows with a null conv_id or turn are left out, a null role or text is a value of its
    own. The hashes are made before the shuffle, so no text is moved.
    """
    own = turns.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", *[F.xxhash64(F.lit(s), *_content()).alias(f"t{n}") for n, s in enumerate(SEEDS, 1)]
    )
    own = own.dropDuplicates()
    rows = W.partitionBy("conv_id").orderBy("turn", "t1", "t2")
    placed = own.withColumn("place", F.row_number().over(rows))
    upto = rows.rowsBetween(W.unboundedPreceding, W.currentRow)
    hashed = [F.bit_xor(F.xxhash64(F.lit(s), "place", f"t{n}")).over(upto).alias(f"h{n}") for n, s in enumerate(SEEDS, 1)]
    return placed.select("conv_id", "place", F.count("*").over(W.partitionBy("conv_id")).alias("size"), *hashed)


def _content() -> list:
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("role", "text")]


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, copies of the conversations that are no prefix of another; the smallest id of equal ones.

    Equal conversations and equal prefixes are brought together before the join, so one opening
    that a third of all conversations share is one row of it.
    """
    whole = hashed.filter("place = size").groupBy("size", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = hashed.filter("place < size").select(F.col("place").alias("size"), "h1", "h2").distinct()
    return whole.join(inner, ["size", "h1", "h2"], "left_anti").select("conv_id", "copies")


def render(turns: DataFrame, kept: DataFrame, head: str = "<|", tail: str = "|>\n", end: str = "\n") -> DataFrame:
    """conv_id, copies, n_turns, rendered: the kept conversations in one text each.

    A turn is ``<|role|>``, a line end, the text and a line end; a null role is ``unknown``, a
    null text empty. One row holds one conversation, however long its text is.
    """
    own = turns.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    own = own.join(kept, "conv_id").dropDuplicates(["conv_id", "turn", "role", "text"])
    order = [F.xxhash64(F.lit(s), *_content()).alias(f"t{n}") for n, s in enumerate(SEEDS, 1)]
    line = F.concat(F.lit(head), F.coalesce("role", F.lit("unknown")), F.lit(tail), F.coalesce("text", F.lit("")), F.lit(end))
    one = F.struct("turn", *order, line.alias("line"))
    out = own.groupBy("conv_id", "copies").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    return out.select("conv_id", "copies", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.col("lines.line"), "").alias("rendered"))


def format_chats(turns: DataFrame, **marks: str) -> DataFrame:
    """Collapse snapshots, then render the maximal conversations."""
    return render(turns, maximal(prefixes(turns)), **marks)
