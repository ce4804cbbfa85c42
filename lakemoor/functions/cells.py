"""Text cells, column widths and text tables, all as distributed expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemoor.functions.values import CUT_MARK, float_text, normalise

# Fixed values of the text form.
CELL_WIDTH = 60
NULL_CELL = "NULL"
NO_RESULT = "(statement executed — no result set)"


def display_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a plain value. Containers are written as JSON."""
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(value.cast("double"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def elide(text: Column, width: int = CELL_WIDTH) -> Column:
    """``NULL`` for NULL; text longer than ``width`` keeps ``width - 1`` characters and a mark."""
    return (
        F.when(text.isNull(), NULL_CELL)
        .when(F.char_length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit(CUT_MARK)))
        .otherwise(text)
    )


def cells(df: DataFrame, width: int = CELL_WIDTH) -> DataFrame:
    """``df`` with every value as the text of its cell; column names are kept."""
    names = df.columns
    inner = _by_position(normalise(df))
    texts = [
        elide(display_text(F.col(f.name), f.dataType), width).alias(f.name)
        for f in inner.schema.fields
    ]
    return inner.select(*texts).toDF(*names)


def _by_position(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _longest(names: list[str]) -> list[Column]:
    return [
        F.greatest(F.lit(len(name)), F.coalesce(F.max(F.char_length(F.col(f"c{i}"))), F.lit(0))).alias(f"c{i}")
        for i, name in enumerate(names)
    ]


def column_widths(df: DataFrame, width: int = CELL_WIDTH) -> DataFrame:
    """One row: per column the longer of its name and its longest cell. One pass for all."""
    return _by_position(cells(df, width)).agg(*_longest(df.columns)).toDF(*df.columns)


def widths_by_column(df: DataFrame, width: int = CELL_WIDTH) -> DataFrame:
    """:func:`column_widths` turned to rows ``(position, column, width)``."""
    names = df.columns
    wide = _by_position(column_widths(df, width))
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.col(f"c{i}").alias("width"))
            for i, name in enumerate(names)
        ]
    )
    return wide.select(F.inline(rows))


@dataclass(frozen=True)
class TextTable:
    """A rendered frame: header and rule, the lines of its rows, and the footer."""

    header: str
    rule: str
    lines: DataFrame
    footer: str

    def text(self) -> str:
        """The whole table as one string; only for frames that were bounded before."""
        body = [row["line"] for row in self.lines.collect()]
        return "\n".join([self.header, self.rule, *body, self.footer])


def footer_text(row_count: int, truncated: bool = False, limit: int | None = None) -> str:
    note = f"; truncated at limit {limit}" if truncated else ""
    return f"[{row_count} row(s){note}]"


def text_lines(df: DataFrame, widths: list[int], width: int = CELL_WIDTH) -> DataFrame:
    """One ``line`` per row of ``df``: cells padded to ``widths`` and joined by `` | ``."""
    inner = _by_position(cells(df, width))
    padded = [F.rpad(F.col(name), w, " ") for name, w in zip(inner.columns, widths)]
    return inner.select(F.concat_ws(" | ", *padded).alias("line"))


def text_rows(
    df: DataFrame,
    width: int = CELL_WIDTH,
    truncated: bool = False,
    limit: int | None = None,
) -> TextTable:
    """Render ``df``. One aggregate (a single row) fixes the widths; the lines stay lazy."""
    names = df.columns
    if not names:
        raise ValueError("a frame without columns has no text form")
    stats = _by_position(cells(df, width)).agg(F.count(F.lit(1)).alias("n"), *_longest(names)).first()
    widths = [stats[f"c{i}"] for i in range(len(names))]
    return TextTable(
        header=" | ".join(name.ljust(w) for name, w in zip(names, widths)),
        rule="-+-".join("-" * w for w in widths),
        lines=text_lines(df, widths, width),
        footer=footer_text(stats["n"], truncated, limit),
    )
