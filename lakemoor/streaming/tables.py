"""Tables as streams, and streams run into tables of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemoor.session import scratch_path
from lakemoor.sources.files import DEFAULT_FORMAT


def stream_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = DEFAULT_FORMAT,
    only: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """The files of a table as a stream: those of a directory, or the one file that ``path`` names.

    ``only`` is a pattern of file names in a directory.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        only = "".join(f"\\{sign}" if sign in "*?[]{}\\" else sign for sign in at.getName())
        path = at.getParent().toString()
    reader = spark.readStream.format(fmt).schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(stream: DataFrame, at: str, lateness: str) -> DataFrame:
    """Declare ``at`` the event time, with rows up to ``lateness`` behind still accepted.

    Watermarks need an instant: a timestamp without zone is taken as one of the session's zone.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there, appending finished rows to a table; the table read back."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start(f"{path}/data")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(
    stream: DataFrame,
    label: str,
    mode: str = "append",
    each: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    path: str | None = None,
) -> DataFrame:
    """Process what is there batch by batch; ``each`` sees a batch as an ordinary frame.

    A batch overwrites its own folder, so a repeated batch changes nothing. The result carries the
    ``batch`` of each row. With the ``path`` of an earlier run the stream goes on where that one
    ended, and the result holds the batches of both.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    schema = each(spark.createDataFrame([], stream.schema)).schema
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        written.append(number)

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    if not written and not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def newest_rows(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each row that batches in update mode have written."""
    row = F.struct(*[c for c in batches.columns if c != "batch"])
    return batches.groupBy(*keys).agg(F.max_by(row, "batch").alias("_row")).select("_row.*")


def last_batch(batches: DataFrame) -> DataFrame:
    """The result as of the last batch, of batches in complete mode."""
    last = batches.agg(F.max("batch").alias("n")).first()["n"]
    return batches.where(F.col("batch") == last).drop("batch")
