"""Names matched without regard to case: exclusion, unique resolution, first hit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_names(df: DataFrame, name: str, excluded: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose name is not excluded. ``excluded`` is a list, or a frame of one column.

    A list becomes a filter, which keeps the order of the rows and reaches the scan.
    """
    if isinstance(excluded, DataFrame):
        barred = F.lower(F.col(excluded.columns[0]))
        keys = excluded.select(barred.alias("_barred")).where("_barred is not null").distinct()
        return df.join(keys, F.lower(df[name]) == keys["_barred"], "left_anti")
    barred = sorted({entry.strip().lower() for entry in excluded} - {""})
    if not barred:
        return df
    folded = F.lower(F.col(name))
    return df.where(folded.isNull() | ~folded.isin(barred))


def resolve_unique_name(asked: DataFrame, known: DataFrame, name: str = "name", id: str = "id") -> DataFrame:
    """``asked`` with ``resolved_id`` and ``status`` for each of its names.

    An id given with the question wins. Otherwise the name has to match exactly one known entry.
    The known side is reduced to one row per name before it is joined, so a name that is known
    many times costs no more than any other.
    """
    entries = known.groupBy(F.lower(F.col(name)).alias("_folded")).agg(
        F.count(F.lit(1)).alias("_matches"), F.min(id).alias("_id")
    )
    given = F.col(id) if id in asked.columns else F.lit(None).cast(known.schema[id].dataType)
    matches = F.coalesce(F.col("_matches"), F.lit(0))
    joined = asked.join(entries, F.lower(asked[name]) == entries["_folded"], "left")
    return joined.select(
        *[F.col(c) for c in asked.columns],
        F.when(given.isNotNull(), given).when(matches == 1, F.col("_id")).alias("resolved_id"),
        F.when(given.isNotNull(), "given")
        .when(matches == 1, "resolved")
        .when(matches == 0, "not found")
        .otherwise(F.concat(F.lit("ambiguous ("), matches.cast("string"), F.lit(")")))
        .alias("status"),
    )


def lookup_name(asked: DataFrame, known: DataFrame, position: str, name: str = "name") -> DataFrame:
    """``asked`` with ``found``: the known name that equals it, else the first that does but for case."""
    exact = known.groupBy(F.col(name).alias("_exact")).agg(F.lit(True).alias("_is_exact"))
    folded = known.groupBy(F.lower(F.col(name)).alias("_folded")).agg(
        F.min_by(name, position).alias("_first")
    )
    return (
        asked.join(exact, asked[name] == exact["_exact"], "left")
        .join(folded, F.lower(asked[name]) == folded["_folded"], "left")
        .select(
            *[F.col(c) for c in asked.columns],
            F.when(F.col("_is_exact"), asked[name]).otherwise(F.col("_first")).alias("found"),
        )
    )
