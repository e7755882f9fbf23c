"""The same curation on streams of files or records.

All curation expressions are stateless, so the batch functions apply as they are;
only the sinks differ. Checkpoints make a restarted query go on where it stopped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CurationConfig
from ..operators.curate import catalogue_layout, curate, with_status
from ..operators.normalize import normalize
from ..sources.corpus import corpus_from_lines
from ..sources.store import upsert_catalogue


def curate_stream(
    lines: DataFrame,
    catalogue: str,
    checkpoint: str,
    cfg: CurationConfig = CurationConfig(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stream JSON lines (``ord``, ``value``) into a catalogue folder.

    Each micro-batch becomes the next run, whatever the folder holds already. Its manifest names
    the stream's checkpoint and its number, so a batch that is run again after a failure adds nothing.
    """
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def merge(batch: DataFrame, batch_id: int) -> None:
        records, _ = corpus_from_lines(batch, cfg)
        tools = catalogue_layout(curate(normalize(records), cfg), cfg)
        upsert_catalogue(batch.sparkSession, tools, catalogue, batch=f"{stream}-{batch_id}")

    return (
        lines.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _watermarked(records: DataFrame, delay: str) -> DataFrame:
    """With a watermark on ``ts``, which has to be a point in time for that."""
    return records.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def status_counts(
    records: DataFrame,
    cfg: CurationConfig = CurationConfig(),
    window: str = "1 hour",
    delay: str | None = "10 minutes",
) -> DataFrame:
    """Records per status and tumbling window of their event time ``ts``.

    On a stream, ``delay`` is the watermark: rows later than that are dropped and closed
    windows leave the state. The same plan on a batch counts everything.
    """
    if delay and records.isStreaming:
        records = _watermarked(records, delay)
    statuses = with_status(normalize(records, "ts"), cfg).select("ts", "status")
    counts = statuses.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count("*").alias("records"))
    return counts.select(F.col("w.start").alias("window_start"), "status", "records")


def deduplicated(records: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first record of each key; on a stream, for as long as ``delay`` after its event time ``ts``.

    The watermark lets keys leave the state, so a stream's state is that of ``delay``, not of the
    whole past. A batch keeps one row for each key.
    """
    if not records.isStreaming:
        return records.dropDuplicates(keys)
    return _watermarked(records, delay).dropDuplicatesWithinWatermark(keys)


def write_counts(counts: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Write windowed counts to Parquet.

    ``append`` emits a window once the watermark has closed it. ``update`` writes the windows that a batch has
    changed, each batch in a sub-folder of its own that a repeated batch replaces; ``read_counts`` takes the
    newest count of each window. The table is never away, and the state is that of the open windows.
    """
    trigger = trigger or {"availableNow": True}
    writer = counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
    if mode == "update":
        return writer.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    return writer.format("parquet").option("path", path).start()


def read_counts(spark: SparkSession, path: str, keys: list[str], value: str = "records") -> DataFrame:
    """What ``update`` has written: the newest value of each key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
