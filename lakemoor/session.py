"""Session settings and the shared folder that written intermediates go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Everything else (shuffle partitions, memory, executors) belongs to the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# While it is on, Spark removes the shuffle files of a written result once the write has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app_name: str = "lakemoor",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Start (or reuse) a session; ``conf`` entries win over the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def apply_session_conf(spark: SparkSession) -> None:
    """Give a session that somebody else built the settings the operators rely on."""
    for name, value in SESSION_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="lakemoor-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/lakemoor-{app}/{label}-{uuid.uuid4().hex[:12]}"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, and the same ever after.

    Unlike a checkpoint of rows it is columnar, so later steps read only the columns they use. The
    shuffle files of its plan, which nothing reads again, go at once: otherwise they stay until the
    driver happens to collect its garbage, and the disk holds those of all steps.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "pinned")
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)
