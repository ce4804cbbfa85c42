"""Functions written in Python: vectorised scalar, mergeable aggregate, and rows out of a row.

Built-in expressions are faster; these show and test the route for what they cannot express.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemoor.functions.cells import CELL_WIDTH, NULL_CELL
from lakemoor.functions.values import CUT_MARK


@F.pandas_udf(T.StringType())
def elide_batch(texts: pd.Series) -> pd.Series:
    """The cell form of whole Arrow batches of text."""
    long = texts.str.len() > CELL_WIDTH
    cut = texts.str.slice(0, CELL_WIDTH - 1) + CUT_MARK
    return texts.where(~long.fillna(False).astype(bool), cut).fillna(NULL_CELL)


def weighted_means(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean per group as a two-step aggregate.

    Python reduces each Arrow batch to one row per group before anything is shuffled; Spark adds
    those up. A grouped pandas function would need every group whole in one worker.
    """
    names = list(keys)

    def reduce_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.append_column("_product", pc.multiply(rows["_value"], rows["_weight"]))
            sums = rows.group_by(names).aggregate([("_product", "sum"), ("_weight", "sum")])
            ordered = sums.select([*names, "_product_sum", "_weight_sum"])
            yield from ordered.rename_columns([*names, "_product", "_weight"]).to_batches()

    picked = df.select(*names, F.col(value).cast("double").alias("_value"), F.col(weight).cast("double").alias("_weight"))
    picked = picked.where(F.col("_value").isNotNull() & F.col("_weight").isNotNull())
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(names)])
    partial = picked.mapInArrow(reduce_batches, f"{key_types}, _product double, _weight double")
    return partial.groupBy(*names).agg(
        F.try_divide(F.sum("_product"), F.sum("_weight")).alias("weighted_mean"), F.sum("_weight").alias("weight")
    )


_WORD = re.compile(r"[^ \t\r\n]+")
_WORD_ROW = T.StructType().add("word", T.StringType()).add("uses", T.IntegerType()).add("first_place", T.IntegerType())


@F.udtf(returnType=_WORD_ROW)
class Words:
    """The distinct words of a text with their uses and the place of the first one.

    Words are what is left between blanks and line breaks. Counting within the text keeps the
    number of rows that leave Python, and are shuffled, small.
    """

    def eval(self, text: str):
        if text is None:
            return
        found: dict[str, list[int]] = {}
        for place, word in enumerate(_WORD.findall(text)):
            found.setdefault(word, [0, place])[0] += 1
        for word, (uses, first_place) in found.items():
            yield word, uses, first_place


@F.arrow_udtf(returnType="lang string, word string, uses bigint, first_place bigint")
class WordTable:
    """The words of a table of texts (lang, text), counted batch by batch; no Python runs per row.

    Words are what is left between blanks and line breaks; ``first_place`` is the least place of a word in a text.
    """

    def eval(self, texts: pa.RecordBatch) -> Iterator[pa.Table]:
        lang, text = texts.column(0), pc.ascii_trim(texts.column(1), " \t\r\n")
        # A list of very many words has more than one chunk's offsets can hold: split few texts at a time.
        for at in range(0, texts.num_rows, 200):
            words = pc.split_pattern_regex(text.slice(at, 200), r"[ \t\r\n]+")
            row = pc.list_parent_indices(words)
            begins = pc.subtract(words.offsets[:-1], words.offsets[0])
            place = pc.subtract(pa.array(range(len(row)), pa.int64()), begins.take(row).cast(pa.int64()))
            table = pa.table({"lang": lang.slice(at, 200).take(row), "word": pc.list_flatten(words), "place": place})
            table = table.filter(pc.not_equal(table["word"], ""))
            found = table.group_by(["lang", "word"]).aggregate([("place", "count"), ("place", "min")])
            yield found.select(["lang", "word", "place_count", "place_min"]).rename_columns(["lang", "word", "uses", "first_place"])


@F.arrow_udtf(returnType="user_id bigint, day date, kind string, first_id bigint, last_id bigint, events bigint")
class Streaks:
    """Stretches of rows of one user, day and kind in an ordered partition (user_id, day, event_type, event_id).

    A partition may hold many users and days, one after the other: Spark calls Python once for each partition, which costs
    far more than the few rows of a user's day. No Python runs per row or stretch. A partition comes in batches; a
    stretch that goes on in the next batch is carried over, so a long one takes no memory.
    """

    def __init__(self) -> None:
        self._open: pa.Table | None = None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        own, ids = [rows.column(at) for at in range(3)], rows.column(3)
        begins = np.flatnonzero(reduce(np.logical_or, [_differs(column) for column in own])) + 1
        begins = np.concatenate([[0], begins])
        ends = np.append(begins[1:], rows.num_rows)
        columns = [*[column.take(pa.array(begins)) for column in own], ids.take(pa.array(begins)), ids.take(pa.array(ends - 1))]
        found = pa.table([*columns, pa.array(ends - begins, pa.int64())], names=_STREAK)
        if self._open is not None:
            met = pa.concat_tables([self._open, found.slice(0, 1)])
            if any(_differs(met[name].combine_chunks()).any() for name in _STREAK[:3]):
                found = pa.concat_tables([self._open, found])
            else:
                whole = met.slice(0, 1).set_column(4, "last_id", met["last_id"][1:])
                whole = whole.set_column(5, "events", pa.array([pc.sum(met["events"]).as_py()], pa.int64()))
                found = pa.concat_tables([whole, found.slice(1)])
        self._open = found.slice(found.num_rows - 1)
        if found.num_rows > 1:
            yield found.slice(0, found.num_rows - 1).combine_chunks()

    def terminate(self) -> Iterator[pa.Table]:
        if self._open is not None:
            yield self._open


_STREAK = ["user_id", "day", "kind", "first_id", "last_id", "events"]


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another one than that before it; a null is like a null."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    known = pc.fill_null(pc.not_equal(before, after), False)
    return pc.or_(known, pc.xor(pc.is_null(before), pc.is_null(after))).to_numpy(zero_copy_only=False)
