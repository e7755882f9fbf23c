"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings of the SQL session our plans count on. Inferring constraints from long
# chains of text rewrites makes the optimiser repeat them exponentially often,
# and there is nothing to gain: our join keys are never null.
PLAN_SETTINGS = {"spark.sql.constraintPropagation.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a session made elsewhere."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "sqlcorpus", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with adaptive execution; ``master`` is left to spark-submit on a cluster.

    Shuffle parallelism starts high on a cluster and is coalesced by AQE; locally
    it follows the core count.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "16g").config(
                "spark.sql.shuffle.partitions", str(cores or os.cpu_count() or 8)
            )
    return prepare(b.getOrCreate())


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    Only a local session, where driver and tasks share one disk, may fall back
    to a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="sqlcorpus-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
