"""Mergeable sketches kept per day of a table, so that questions about groups need no second scan.

A sketch table has one row per group and day: theta sketches of the values to be counted
distinctly, KLL sketches of the values to be ranked. Larger groups merge those rows, unions and differences
of groups are taken between merged sketches, and a day that changes is sketched again alone.

Bounds: a theta sketch counts exactly up to 2**``LG_NOMINAL`` values; beyond, one standard error of an estimate is
``1 / sqrt(2**LG_NOMINAL)`` of it (of the union, for a difference). A KLL sketch of ``RANKED`` keeps up to as many values as they are;
beyond, the rank of a quantile is off by less than :func:`rank_error` in 99 of 100 cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemoor.operators.changes import overwrite_touched

LG_NOMINAL = 14
RANKED = 4096


def rank_error(k: int = RANKED) -> float:
    """The share of rows by which the rank of a KLL quantile is off, at most, in 99 of 100 cases."""
    return 2.296 / k**0.9021


def daily_sketches(
    df: DataFrame, keys: Sequence[str], at: str, distinct: Sequence[str] = (), ranked: Sequence[str] = (),
    lg_nominal: int = LG_NOMINAL, k: int = RANKED,
) -> DataFrame:
    """``keys``, ``day`` of ``at``, and a sketch ``<column>_theta`` or ``<column>_kll`` of each named column.

    Nulls, and NaN among ranked values, are in no sketch.
    """
    made = [F.theta_sketch_agg(column, lg_nominal).alias(f"{column}_theta") for column in distinct]
    for column in ranked:
        value = F.col(column).cast("double")
        made.append(F.kll_sketch_agg_double(F.when(~F.isnan(value), value), k).alias(f"{column}_kll"))
    return df.groupBy(*keys, F.to_date(at).alias("day")).agg(*made)


def write_sketches(sketches: DataFrame, path: str) -> str:
    """Write sketches under ``path``, a folder per day; days that ``sketches`` does not have stay as they are."""
    return overwrite_touched(sketches, path, ["day"])


def merged(sketches: DataFrame, by: Sequence[str], lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """The sketches of larger groups (``by``; none: one group of all)."""
    found = []
    for column in sketches.columns:
        if column.endswith("_theta"):
            found.append(F.theta_union_agg(column, lg_nominal).alias(column))
        elif column.endswith("_kll"):
            found.append(F.kll_merge_agg_double(column).alias(column))
    return sketches.groupBy(*by).agg(*found)


def union_of(*sketches: Column, lg_nominal: int = LG_NOMINAL) -> Column:
    return reduce(lambda a, b: F.theta_union(a, b, lg_nominal), sketches)


def distinct_estimate(sketch: Column) -> Column:
    """The estimated number of different values, a whole number."""
    return F.theta_sketch_estimate(sketch)


def without(sketch: Column, other: Column) -> Column:
    """The sketch of the values that ``other`` has not seen."""
    return F.theta_difference(sketch, other)


def ranked_rows(sketch: Column) -> Column:
    """The number of rows that a KLL sketch has seen."""
    return F.kll_sketch_get_n_double(sketch)


def quantile_estimate(sketch: Column, share: float) -> Column:
    """The least value kept that has at least ``share`` of the rows at or below it; null without rows."""
    return F.when(ranked_rows(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))


def rank_estimate(sketch: Column, value: float) -> Column:
    """The estimated share of the rows at or below ``value``; null without rows."""
    return F.when(ranked_rows(sketch) > 0, F.kll_sketch_get_rank_double(sketch, F.lit(float(value))))
