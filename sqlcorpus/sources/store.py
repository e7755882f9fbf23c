"""Catalogue folders: a log of deltas, merged when read.

    <catalogue>/_log/00000007.json        what the catalogue is after run 7
    <catalogue>/delta-7-<id>/bucket=3/    the tools of run 7, by a hash of their identity
    <catalogue>/base-7-<id>/bucket=3/     all tools up to run 7, merged

A run writes its own tools only, then its manifest. A folder that no manifest names is of no run: what
a failed or interrupted run leaves changes nothing. Reading merges what the newest manifest names, in
one aggregate; compacting writes that down as a new base. One writer at a time; readers at any time.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import merged, new_tools

BUCKETS = 8
COMPACT_AFTER = 16  # deltas that a reader merges at most
KEPT_BATCHES = 32  # of a stream; Spark repeats its last batch only
_MANIFEST = re.compile(r"/(\d+)\.json$")


class _Folder:
    """The file system of a catalogue, whatever its scheme."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def manifest(self, run: int):
        return self._p(f"{self.path}/_log/{run:08d}.json")

    def runs(self) -> list[int]:
        log = self._p(f"{self.path}/_log")
        if not self.fs.exists(log):
            return []
        hits = [_MANIFEST.search(s.getPath().toString()) for s in self.fs.listStatus(log)]
        return sorted(int(h.group(1)) for h in hits if h)

    def read(self, run: int) -> dict:
        stream = self.fs.open(self.manifest(run))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, run: int, content: dict) -> None:
        """The manifest is there as a whole or not at all: written beside its place, then renamed."""
        beside, place = self._p(f"{self.path}/_log/.{uuid.uuid4().hex}"), self.manifest(run)
        stream = self.fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if self.fs.exists(place):  # the same run again, or the run compacted; until the rename, the run before counts
            self.fs.delete(place, False)
        if not self.fs.rename(beside, place):
            raise OSError(f"manifest of run {run} could not be put in place")

    def folders(self) -> list[str]:
        if not self.fs.exists(self._p(self.path)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._p(self.path)) if s.isDirectory()]

    def buckets(self, name: str) -> list[str]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._p(f"{self.path}/{name}"))]
        return [n for n in names if n.startswith("bucket=")]

    def delete(self, name: str) -> None:
        self.fs.delete(self._p(f"{self.path}/{name}"), True)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs that a catalogue folder holds."""
    return _Folder(spark, path).runs()


def load_catalogue(spark: SparkSession, path: str, run: int | None = None) -> DataFrame | None:
    """The catalogue after the newest run, or after ``run``; None if there is none, or no tool in it."""
    folder = _Folder(spark, path)
    have = folder.runs()
    if not have or (run is not None and run not in have):
        return None
    parts = folder.read(run if run is not None else have[-1])["parts"]
    if not parts:
        return None
    return merged(_rows(spark, path, parts)) if len(parts) > 1 else _rows(spark, path, parts)


def _rows(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    each = [spark.read.parquet(f"{path}/{p}").drop("bucket") for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def _write(rows: DataFrame, folder: _Folder, name: str) -> list[str]:
    """The name of the new folder; none if there was nothing to write."""
    key = "tool_id" if "tool_id" in rows.columns else "tool_key"
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(f"{folder.path}/{name}")
    return [name] if folder.buckets(name) else []


def upsert_catalogue(
    spark: SparkSession, tools: DataFrame, path: str, run: int | None = None, batch: str | None = None, compact_after: int = COMPACT_AFTER
) -> int:
    """Put a run's tools into a catalogue folder; returns the number of the run.

    What is written follows the size of the run, not of the catalogue. Without a ``run`` the number follows the
    newest one; a ``run`` of its own may repeat the newest, never one with successors. ``batch`` names a
    micro-batch (``<stream>-<number>``): one that the catalogue holds already changes nothing. Once a reader would
    merge ``compact_after`` deltas, the run ends with a compaction.
    """
    folder = _Folder(spark, path)
    have = folder.runs()
    newest = folder.read(have[-1]) if have else {"parts": [], "batches": {}}
    stream, _, number = (batch or "").rpartition("-")
    if batch is not None and number in newest["batches"].get(stream, {}):
        return newest["batches"][stream][number]
    run = (have[-1] + 1 if have else 1) if run is None else run
    if have and run < have[-1]:
        raise ValueError(f"run {run} would come before run {have[-1]}, which is there")
    before = [n for n in have if n < run]
    state = newest if before == have else folder.read(before[-1]) if before else {"parts": [], "batches": {}}
    parts = [*state["parts"], *_write(new_tools(tools, run), folder, f"delta-{run}-{uuid.uuid4().hex}")]
    batches = dict(state["batches"])
    if batch is not None:
        held = list(batches.get(stream, {}).items())[-KEPT_BATCHES + 1 :]
        batches[stream] = {**dict(held), number: run}
    folder.commit(run, {"parts": parts, "batches": batches})
    if len(parts) > compact_after:
        compact_catalogue(spark, path)
    return run


def compact_catalogue(spark: SparkSession, path: str) -> None:
    """Write the newest catalogue as one base, which its manifest then names instead of its deltas."""
    folder = _Folder(spark, path)
    have = folder.runs()
    if not have:
        return
    state = folder.read(have[-1])
    if len(state["parts"]) < 2:
        return
    base = _write(merged(_rows(spark, path, state["parts"])), folder, f"base-{have[-1]}-{uuid.uuid4().hex}")
    folder.commit(have[-1], {**state, "parts": base})


def vacuum_catalogue(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the folders that none of the newest ``keep`` runs needs, and the manifests of the others; returns the folders.

    Not to be run while a run is being written: its folder has no manifest yet.
    """
    folder = _Folder(spark, path)
    have = folder.runs()
    needed = {p for n in have[-max(1, keep) :] for p in folder.read(n)["parts"]}
    for n in have[: -max(1, keep)]:
        folder.fs.delete(folder.manifest(n), False)
    gone = [f for f in folder.folders() if f.startswith(("delta-", "base-")) and f not in needed]
    for f in gone:
        folder.delete(f)
    return gone
