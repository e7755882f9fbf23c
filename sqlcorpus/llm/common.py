"""Helpers that the operators share: words, columns, the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

#: A-Z to a-z; the text stays UTF-8, whose bytes above 0x7F are never touched.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def keep_only(word_byte) -> bytes:
    """A table for ``bytes.translate``: lower case, and a blank for each byte outside words."""
    return bytes(LOWER[b] if word_byte(LOWER[b]) else 32 for b in range(256))


#: Words are runs of anything but blank, tab, LF, VT, FF, CR.
SPACED = keep_only(lambda b: b != 32 and not 9 <= b <= 13)
#: Words are runs of 0-9, a-z and everything outside ASCII.
ALNUM = keep_only(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words_of(text: str | None, table: bytes) -> list[bytes]:
    """The words of a whole text as UTF-8 bytes; none for a null."""
    if not text:
        return []
    # bytes.split() breaks at exactly the six bytes that SPACED takes as blanks
    return text.encode("utf-8", "surrogatepass").translate(table).split()


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id, which then counts as neither learned from nor held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def fresh(taken: Sequence[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes to clash with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


_HELD: dict = {"operator": None}


def held(operator: str, key, make):
    """What a Python worker keeps from task to task for one operator; the next operator that asks drops it.

    Workers are used again by later stages, so tables that an operator no longer needs would
    stand beside those of the next one.
    """
    if _HELD["operator"] != operator:
        _HELD.clear()
        _HELD["operator"] = operator
        gc.collect()
        pa.default_memory_pool().release_unused()
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    This cuts the lineage: what follows reads files that every executor can reach, so a
    lost executor costs a re-read and never a second run of the work before.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, as ``--py-files`` would; once for each session."""
    name, top = "sqlcorpus-tasks.zip", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), name)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(path)
    return spark
