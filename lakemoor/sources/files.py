"""Reading and writing tables by path, and small frames made from literals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemoor.sources.names import quote, quote_text

DEFAULT_FORMAT = "parquet"


def read_path(
    spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT, schema=None, **options
) -> DataFrame:
    """The table stored at ``path``. Give ``schema`` for text formats: nothing is inferred."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


DAMAGED = "_damaged"


def read_with_damage(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str, **options
) -> DataFrame:
    """The JSON or CSV table at ``path``, damaged rows included.

    ``_damaged`` holds the text of a row that does not fit ``schema``, whose other columns are null then, and is null
    for a good row; ``_file`` is the file that a row stands in. Nothing is dropped and nothing fails.
    Spark asks that a query reads another column of the schema beside ``_damaged``.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    whole = T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED, **options}
    read = spark.read.format(fmt).options(**options).schema(whole).load(path)
    good = F.col(DAMAGED).isNull()
    columns = [F.when(good, F.col(quote(name))).alias(name) for name in schema.names]
    return read.select(*columns, DAMAGED, F.col("_metadata.file_path").alias("_file"))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of few splits over all cores, for costly work per row.

    A file with one row group is one task's work however large it is. Scans that already have a
    split per core, as those of large tables do, are left alone and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_path(
    df: DataFrame,
    path: str,
    fmt: str = DEFAULT_FORMAT,
    partition_by: Sequence[str] = (),
    **options,
) -> str:
    """Replace the table at ``path`` by ``df``.

    With ``partition_by``, AQE first balances the rows by those columns: one task per file of
    an advisory size. A value that holds much of the data is split over several tasks and a
    rare one is not spread over many files.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode("overwrite").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def register_path(
    spark: SparkSession,
    name: Sequence[str],
    path: str,
    fmt: str = DEFAULT_FORMAT,
    exist_ok: bool = True,
) -> str:
    """Name the table stored at ``path``; ``name`` holds the parts, e.g. ``("db", "t")``."""
    target = ".".join(quote(part) for part in name)
    guard = "IF NOT EXISTS " if exist_ok else ""
    spark.sql(f"CREATE TABLE {guard}{target} USING {fmt} LOCATION {quote_text(path)}")
    return target


def rows_source(spark: SparkSession, rows: Iterable[Sequence], columns) -> DataFrame:
    """A frame of literal rows; ``columns`` are names, or a schema string for fixed types."""
    return spark.createDataFrame(list(rows), columns)


def range_source(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """``id`` from ``start`` up to but without ``end``, made on the executors."""
    return spark.range(start, end, step)
