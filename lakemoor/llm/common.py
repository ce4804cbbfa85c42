"""What the training-data operators share: reading the tables, Arrow batches, registered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.session import apply_session_conf

Query = Callable[[SparkSession, str], DataFrame]

# Texts may be long: few rows in one Arrow batch keep a Python worker's memory bounded.
ROWS_PER_BATCH = 500

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under its name, with the SQL that checks it, if any."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return build(spark, sf_dir)

        QUERIES[build.__name__] = run
        if oracle:
            ORACLES[build.__name__] = oracle.strip()
        return run

    return register


def prepare(spark: SparkSession) -> None:
    apply_session_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (a null text is an empty one); other columns do not matter here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, or the next longer name that is not taken in any case."""
    lowered = {name.lower() for name in taken}
    while wish.lower() in lowered:
        wish += "_"
    return wish


def each_batch(handle: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A function for ``mapInArrow`` that turns one batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield handle(batch)

    return run
