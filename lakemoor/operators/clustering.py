"""Tables laid out along a Z-order curve, so that the statistics of files narrow a scan by each of several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemoor.sources.names import quote

SIDE = 16  # cells of a column are SIDE * SIDE, so 8 bits each


def rank_cells(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """For each column the cell (0 to 255) of a value, cells holding about as many rows each.

    The cuts come from one pass of quantile sketches over the columns alone. Nulls are in cell 0. A value that
    fills several cells has the first of them.
    """
    shares = [at / SIDE**2 for at in range(1, SIDE**2)]
    placed = df.select(*[_number(df, one).alias(f"c{at}") for at, one in enumerate(columns)])
    cuts = placed.agg(*[F.percentile_approx(name, shares, 10_000).alias(name) for name in placed.columns]).first()
    kinds = [field.dataType for field in placed.schema]
    return {one: _cell(_number(df, one), kind, own) for one, kind, own in zip(columns, kinds, cuts)}


def _number(df: DataFrame, name: str) -> Column:
    """Numbers and times as they are; of texts and bytes the first seven bytes as a number, which is in their order."""
    value = F.col(quote(name))
    if isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    return value


def _cell(value: Column, kind: T.DataType, cuts: list | None) -> Column:
    if not cuts:
        return F.lit(0)
    # The coarse cuts lead to a few fine ones: 30 comparisons a value instead of 255.
    fine = F.array(*[F.array(*[F.lit(cut).cast(kind) for cut in cuts[at : at + SIDE]]) for at in range(0, len(cuts), SIDE)])
    coarse = F.array(*[F.lit(cut).cast(kind) for cut in cuts[SIDE - 1 :: SIDE]])
    group = F.size(F.filter(coarse, lambda cut: cut < value))
    inside = F.size(F.filter(F.get(fine, group), lambda cut: cut < value))
    return F.coalesce(F.when(value.isNotNull(), group * SIDE + F.greatest(inside, F.lit(0))), F.lit(0)).cast("bigint")


def interleaved(cells: Sequence[Column], bits: int = 8) -> Column:
    """The bits of some numbers in turn, highest first: neighbours in it are neighbours in all of them."""
    out = F.lit(0).cast("bigint")
    for bit in range(bits):
        for at, cell in enumerate(cells):
            one = F.call_function("shiftright", cell.cast("bigint"), F.lit(bit)).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.call_function("shiftleft", one.cast("bigint"), F.lit(bit * len(cells) + len(cells) - 1 - at)))
    return out


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int, fmt: str = "parquet", **options) -> str:
    """Replace the table at ``path`` by ``df`` in ``files`` files of neighbours in all of ``columns`` (7 at most).

    Rows are dealt by ranges of the curve; equal places are dealt on by the columns' values, so that a hot cell is several files.
    """
    if not 1 <= len(columns) <= 7:
        raise ValueError("1 to 7 columns can be interleaved")
    cells = {f"_cell{at}": cell for at, cell in enumerate(rank_cells(df, columns).values())}
    by = ["_curve", *map(quote, columns)]
    # Cells are columns first: each of them stands in the curve once for every bit.
    laid = df.withColumns(cells).withColumn("_curve", interleaved([F.col(name) for name in cells])).drop(*cells)
    laid = laid.repartitionByRange(files, *by).sortWithinPartitions(*by).drop("_curve")
    laid.write.format(fmt).mode("overwrite").options(**options).save(path)
    return path
