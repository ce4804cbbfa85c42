"""Changes to a table: frames that hold its new state, and rewrites of the partitions that a change touches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemoor.session import pinned


def latest_per_key(changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the one with the highest ``version``. Combined before the shuffle."""
    row = F.struct(*changes.columns)
    return changes.groupBy(*keys).agg(F.max_by(row, version).alias("_row")).select("_row.*")


def upsert(target: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``patch`` replacing those of equal keys, and added otherwise.

    ``patch`` holds one row per key (see :func:`latest_per_key`); two rows of one key are an error
    when the result is computed, as in MERGE.
    """
    kept = target.join(patch.select(*keys), list(keys), "left_anti")
    counted = patch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*patch.columns)).alias("_row"))
    checked = F.assert_true(F.col("_n") == 1, "two rows of the patch have one key")
    once = counted.select("_row", checked.alias("_checked")).where(F.col("_checked").isNull()).select("_row.*")
    return kept.unionByName(once.select(*patch.columns))


def update_rows(df: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``changes`` applied where ``condition`` holds. All read the old values."""
    # `withColumns` takes every new value from the row as it was.
    return df.withColumns(
        {name: F.when(condition, value).otherwise(F.col(name)) for name, value in changes.items()}
    )


def delete_rows(df: DataFrame, condition: Column) -> DataFrame:
    """``df`` without the rows for which ``condition`` is true; unknown is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def overwrite_touched(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> str:
    """Write ``df`` under ``path``: partitions that it has rows of are replaced, all others stay as they are."""
    writer = df.hint("rebalance", *partition_by).write.format(fmt).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).save(path)
    return path


def rewrite_touched(
    target: DataFrame, path: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], partition_by: Sequence[str]
) -> None:
    """Apply ``change`` to those partitions of the Parquet table ``target`` (read from ``path``) that ``touched`` names.

    ``touched`` has a row of each of them at least (columns ``partition_by``; a null value is a partition, too). Their rows are read
    (other partitions are pruned), changed, and written to the shared folder before any file is replaced, so that a failed change
    leaves the table as it was. A partition that ends up empty is removed. Files of other partitions keep their names.
    """
    name = F.to_json(F.struct(*partition_by))
    names = _distinct(touched.select(name))
    changed = pinned(change(target.where(name.isin(names))).select(*target.columns))
    left = _distinct(changed.select(name))
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    emptied = [one for one in names if one not in set(left)]
    folders = _distinct(target.where(name.isin(emptied)).select(folder)) if emptied else []
    if not changed.isEmpty():
        overwrite_touched(changed, path, partition_by)
    spark = target.sparkSession
    for uri in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    spark.catalog.refreshByPath(path)


def _distinct(names: DataFrame) -> list[str]:
    """Names of partitions, or their folders: as many as a change touches, not as it has rows."""
    return sorted(row[0] for row in names.distinct().collect())


def upsert_touched(target: DataFrame, path: str, patch: DataFrame, keys: Sequence[str], partition_by: Sequence[str]) -> None:
    """:func:`upsert` into a partitioned table: only partitions that hold an old or a new row of the patch are rewritten."""
    patch = pinned(patch.select(*target.columns))
    old = target.join(patch.select(*keys), list(keys), "left_semi").select(*partition_by)
    touched = old.unionByName(patch.select(*partition_by))
    rewrite_touched(target, path, touched, lambda rows: upsert(rows, patch, keys), partition_by)


def delete_touched(target: DataFrame, path: str, condition: Column, partition_by: Sequence[str]) -> None:
    """:func:`delete_rows` of a partitioned table: only partitions with a row to delete are rewritten."""
    touched = target.where(condition).select(*partition_by)
    rewrite_touched(target, path, touched, lambda rows: delete_rows(rows, condition), partition_by)
