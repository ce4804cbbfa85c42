"""Joins that hold when one key, or one stretch of time, carries much of the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemoor.operators.ordered import (
    MOST_BROADCAST_BYTES,
    MOST_GROUP_ROWS,
    MOST_VALUES,
    broadcast_if_small,
    frame_bytes,
    with_last_known,
    with_running,
)
from lakemoor.session import pinned

MOST_HOT, MOST_TRACKED = 100, 10_000  # hot keys of a side, and keys that their sketch keeps
SALTS = 64
MOST_SLABS = 4096  # cuts of a range that are written into a plan
PAIRS_PER_ROW = 1000  # pairs a task may compare for each row it may hold

def sized_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    strategy: str = "auto",
    most_bytes: int = MOST_BROADCAST_BYTES,
) -> DataFrame:
    """Join with a chosen strategy: ``broadcast``, ``merge``, ``shuffle_hash`` or ``auto``.

    ``broadcast`` measures the right side first and merges when it is larger than ``most_bytes``.
    ``auto`` leaves the choice to Spark, which knows file and (with AQE) shuffle sizes.
    """
    if strategy == "broadcast":
        fits = frame_bytes(right) <= most_bytes
        right = F.broadcast(right) if fits else right.hint("merge")
    elif strategy in ("merge", "shuffle_hash"):
        right = right.hint(strategy)
    elif strategy != "auto":
        raise ValueError(f"unknown join strategy {strategy!r}")
    return left.join(right, list(on), how)


def outer_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, most_rows: int = MOST_GROUP_ROWS
) -> DataFrame:
    """``left``, ``right`` or ``full`` outer join on columns of the same names.

    AQE can split a hot key on the preserved side of a left or right join, so these are plain joins.
    It can split no side of a full one. There keys with more than ``most_rows`` rows on a side are found by a sketch of
    the keys alone; the larger side deals their rows to salts and the other side repeats its rows for each salt, so that
    one shuffled full join of both sides, each read once, has no hot key. Rows with a null key are dealt, too.
    The deal goes by where a row was read: pin inputs that do not give the same rows in the same order each time.
    """
    if how not in ("left", "right", "full"):
        raise ValueError(f"how must be left, right or full, not {how!r}")
    keys = list(on)
    if how != "full":
        return left.join(right, keys, how)
    item = _key_item(left, keys)
    left_hot, right_hot = _hot_keys(left, right, item, most_rows)
    by_left = [key for key, n in left_hot.items() if n >= right_hot.get(key, 0)]
    by_right = [key for key in right_hot if key not in set(by_left)]
    left = _salted(left, keys, item, by_left, by_right).withColumn("_from_left", F.lit(True))
    right = _salted(right, keys, item, by_right, by_left).withColumn("_from_right", F.lit(True))
    joined = left.withColumnRenamed("_repeated", "_left_repeated").join(
        right.withColumnRenamed("_repeated", "_right_repeated"), [*keys, "_salt"], "full"
    )
    # A repeated row without a partner in one salt has partners in others: its key is hot on the other side.
    alone = (F.col("_from_left").isNull() & F.col("_right_repeated")) | (F.col("_from_right").isNull() & F.col("_left_repeated"))
    found = joined.where(~F.coalesce(alone, F.lit(False)))
    return found.drop("_salt", "_from_left", "_from_right", "_left_repeated", "_right_repeated")


def _key_item(df: DataFrame, keys: Sequence[str]) -> Column:
    """One value that stands for a row's keys; null where one of them is null."""
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, (T.IntegralType, T.StringType, T.DateType)):
        return F.col(keys[0])
    known = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    return F.when(known, F.to_json(F.struct(*keys)))


def _hot_keys(left: DataFrame, right: DataFrame, item: Column, most_rows: int) -> list[dict]:
    """For each side the keys with more than ``most_rows`` rows, and about how many; MOST_HOT of them at most.

    Found from the sketches of one pass over the keys. Beyond a share of one in MOST_TRACKED of the rows no key is missed.
    """
    sides = [side.select(item.alias("_item"), F.lit(at).alias("_side")) for at, side in enumerate((left, right))]
    top = F.call_function("approx_top_k", F.col("_item"), F.lit(MOST_HOT), F.lit(MOST_TRACKED))
    found = sides[0].union(sides[1]).where("_item IS NOT NULL").groupBy("_side").agg(top.alias("top"))
    hot: list[dict] = [{}, {}]
    for row in found.collect():
        hot[row["_side"]] = {one["item"]: one["count"] for one in row["top"] if one["count"] > most_rows}
    return hot


def _salted(df: DataFrame, keys: Sequence[str], item: Column, dealt: Sequence, repeated: Sequence) -> DataFrame:
    """``_salt``: rows of ``dealt`` keys (and null ones) in turn, those of ``repeated`` keys once for each salt."""
    in_turn = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    no_key = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    salt = F.when(no_key | item.isin(list(dealt)), in_turn).otherwise(0) if dealt else F.when(no_key, in_turn).otherwise(0)
    if not repeated:
        return df.withColumn("_salt", salt).withColumn("_repeated", F.lit(False))
    again = F.coalesce(item.isin(list(repeated)), F.lit(False))
    marked = df.withColumn("_salt", salt).withColumn("_repeated", again)
    every = F.when(F.col("_repeated"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array("_salt"))
    return marked.withColumn("_salt", F.explode(every))


def having_partner(left: DataFrame, right: DataFrame, left_key: str, right_key: str, found: bool = True) -> DataFrame:
    """Rows of ``left`` with (or without) a partner; the right side is reduced to its keys first."""
    keys = right.select(F.col(right_key).alias("_key")).where("_key is not null").distinct()
    return left.join(keys, left[left_key] == keys["_key"], "left_semi" if found else "left_anti")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: int,
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Pairs of points and intervals with equal ``on`` and ``start <= at <= end``.

    ``at``, ``start`` and ``end`` are whole numbers. Both sides meet in cells of ``width`` doubled as
    often as an interval needs to touch two of them at most; a point lies in one cell of each
    size in use (64 at most), so every pair is found once, and open-ended intervals cost no more than others.
    Cells with more than ``most_rows`` rows on a side, or with more pairs to compare than
    ``PAIRS_PER_ROW`` times as many, are cut into blocks, and the other side visits each block. Column
    names of the two sides must differ, except for ``on``.
    """
    keys = list(on)
    ordered = intervals.where(F.col(start) <= F.col(end))
    ordered = ordered.withColumns({"_first": _base_cell(start, width), "_last": _base_cell(end, width)})
    cells = F.col("_last") - F.col("_first")
    level = F.when(cells > 1, F.length(F.bin(cells - 1))).otherwise(0).cast("int")
    touched = F.array_distinct(F.array(F.expr("shiftright(_first, _level)"), F.expr("shiftright(_last, _level)")))
    i = ordered.withColumn("_level", level).withColumn("_cell", F.explode(touched)).drop("_first", "_last")
    bits = ordered.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), level))).first()[0] or 0
    levels = [at for at in range(64) if bits >> at & 1]
    p = points.withColumn("_base", _base_cell(at, width))
    p = p.withColumn("_level", F.explode(F.lit(levels).cast("array<int>")))
    p = p.withColumn("_cell", F.expr("shiftright(_base, _level)")).drop("_base")
    where = at_cell = [*keys, "_level", "_cell"]
    blocks = _blocks(p, i, where, most_rows)
    if blocks is not None:
        p_blocks = blocks.select(*at_cell, F.col("_p_blocks").alias("_blocks"))
        i_blocks = blocks.select(*at_cell, F.col("_i_blocks").alias("_blocks"))
        p, i = _cut(p, p_blocks, at_cell, "_p_block"), _visit(i, p_blocks, at_cell, "_p_block")
        i, p = _cut(i, i_blocks, at_cell, "_i_block"), _visit(p, i_blocks, at_cell, "_i_block")
        where = [*at_cell, "_p_block", "_i_block"]
    joined = p.join(i, where).where(F.col(at).between(F.col(start), F.col(end)))
    return joined.drop(*[c for c in where if c not in keys])


def _base_cell(at: str, width: int) -> Column:
    at = F.col(at).cast("bigint")
    return F.call_function("div", at - F.pmod(at, F.lit(width).cast("bigint")), F.lit(width).cast("bigint"))


def _blocks(p: DataFrame, i: DataFrame, where: Sequence[str], most_rows: int) -> DataFrame | None:
    """How many blocks each side of a cell needs, of cells that need several; ``None`` if no cell does."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = p.select(*where, one.alias("_p"), none.alias("_i")).unionByName(i.select(*where, none.alias("_p"), one.alias("_i")))
    sizes = both.groupBy(*where).agg(F.sum("_p").alias("_p"), F.sum("_i").alias("_i")).where("_p > 0 AND _i > 0")
    pairs = F.col("_p").cast("double") * F.col("_i")
    each = F.ceil(F.sqrt(pairs / (float(most_rows) * PAIRS_PER_ROW)))

    def needed(size: str) -> Column:
        return F.greatest(F.ceil(F.col(size) / most_rows), F.least(each, F.col(size))).cast("int")

    large = sizes.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in where])).select(
        *where, needed("_p").alias("_p_blocks"), needed("_i").alias("_i_blocks")
    )
    large = large.where("_p_blocks > 1 OR _i_blocks > 1")
    return None if large.isEmpty() else broadcast_if_small(pinned(large))


def _cut(df: DataFrame, blocks: DataFrame, where: Sequence[str], name: str) -> DataFrame:
    """Give each row one block of its cell in turn, so that copies of one row are spread, too.

    The choice depends on where a row was read; it is pinned, so that no retry can change it.
    """
    in_turn = F.pmod(F.monotonically_increasing_id(), F.col("_blocks"))
    block = F.coalesce(in_turn, F.lit(0)).cast("int")
    return pinned(df.join(blocks, list(where), "left").withColumn(name, block).drop("_blocks"))


def _visit(df: DataFrame, blocks: DataFrame, where: Sequence[str], name: str) -> DataFrame:
    """Repeat each row for every block of its cell."""
    all_blocks = F.sequence(F.lit(0), F.coalesce(F.col("_blocks"), F.lit(1)) - 1)
    return df.join(blocks, list(where), "left").withColumn(name, F.explode(all_blocks)).drop("_blocks")


def asof_join(
    asked: DataFrame,
    known: DataFrame,
    on: Sequence[str],
    at: str,
    id: str,
    value: str,
    out: str,
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """``asked`` with the latest ``value`` of ``known`` at or before ``at`` in the same group.

    Both frames are laid on one line per group, known rows first at equal ``at``; a known row with
    the larger ``id`` counts as later. One shuffle, no pairs.
    """
    base = [*on, at, id]
    carried = {c: f"_asked_{c}" for c in asked.columns if c not in base}
    questions = asked.select(*base, *[F.col(c).alias(n) for c, n in carried.items()], F.lit(1).alias("_side"))
    answers = known.select(*base, F.struct(F.col(value).alias("v")).alias("_known"), F.lit(0).alias("_side"))
    line = questions.unionByName(answers, allowMissingColumns=True)
    order = [F.col(at), F.col("_side"), F.col(id)]
    filled = with_last_known(line, on, order, "_known", "_latest", most_rows).where(F.col("_side") == 1)
    rest = [F.col(n).alias(c) for c, n in carried.items()]
    return filled.select(*base, *rest, F.col("_latest").getField("v").alias(out))


def count_below(left: DataFrame, right: DataFrame, left_value: str, right_value: str, out: str,
                most_rows: int = MOST_VALUES) -> DataFrame:
    """For each distinct value of ``left`` the number of ``right`` rows with a smaller value.

    An inequality join that is only counted needs no pairs: both sides are counted per value, put
    on one line, and the running count of the right side is read off.
    """
    asked = left.groupBy(F.col(left_value).alias("_v")).agg(F.lit(0).cast("bigint").alias("_n"))
    counted = right.groupBy(F.col(right_value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    line = asked.withColumn("_side", F.lit(0)).unionByName(counted.withColumn("_side", F.lit(1)))
    line = line.where(F.col("_v").isNotNull()).withColumn("_all", F.lit(0))
    ran = with_running(line, ["_all"], [F.col("_v"), F.col("_side")], {out: F.col("_n")}, most_rows)
    return ran.where(F.col("_side") == 0).select(F.col("_v").alias(left_value), out)


def count_dominated(
    df: DataFrame, id: str, first: str, second: str, out: str, slabs: int | None = None, most_rows: int = MOST_VALUES
) -> DataFrame:
    """For each row of ``df`` the number of rows that are smaller in ``first`` and in ``second``: ``id`` and ``out``.

    A join on two inequalities that is only counted needs no pairs. The range of ``first`` is cut into slabs and that of
    ``second`` into strips of about as many rows; a value that is a cut is a slab or strip of its own, since its rows
    are not smaller than each other. Each row adds up three counts: the rows of lower slabs and lower strips, read off
    running sums over a table of rows per slab and strip; the smaller rows of its own slab; and
    the smaller rows of its own strip in lower slabs. Within a slab or strip, tasks count by the bits of ranks. So every row is
    shuffled once to its slab, once to its strip and once to its id (and once to its cell, where Spark does not broadcast
    the cells), however many slabs there are, and nothing meets in pairs. Slabs and strips hold ``most_rows`` rows, or a MOST_SLABS-th of all where that is more. Rows with a null,
    or a NaN, are smaller than nothing and have nothing below them: their count is 0. ``id`` names a row; the counts
    of rows that share one are added up.
    """
    rows = pinned(df.select(F.col(id).alias("_id"), F.col(first).alias("_x"), F.col(second).alias("_y")))
    known = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    for name in ("_x", "_y"):
        if isinstance(rows.schema[name].dataType, T.FractionalType):
            known &= ~F.isnan(F.col(name).cast("double"))
    points = rows.where(known)
    if slabs is None:
        slabs = min(max(1, -(-points.count() // most_rows)), MOST_SLABS)
    x_cuts, y_cuts = _cuts(points, "_x", slabs), _cuts(points, "_y", slabs)
    points = points.withColumns({"_slab": _slab_of(points, "_x", x_cuts), "_strip": _slab_of(points, "_y", y_cuts)})
    cells = _below_cells(points, 2 * len(x_cuts) + 1, 2 * len(y_cuts) + 1, most_rows)
    # A slab that is one value may hold any share of the rows, but counts nothing: its rows are dealt to several groups.
    in_turn = [F.when(F.col(at) % 2 == 1, F.pmod("_turn", f"{at}_parts")).otherwise(0).cast("int") for at in ("_slab", "_strip")]
    placed = points.withColumn("_turn", F.monotonically_increasing_id()).join(cells, ["_slab", "_strip"]).select(
        "_id", "_x", "_y", "_slab", "_strip", "_n", in_turn[0].alias("_slab_part"), in_turn[1].alias("_strip_part")
    )
    kept = ["_id", "_y", "_slab", "_strip", "_n", "_strip_part"]
    in_slabs = placed.groupBy("_slab", "_slab_part").applyInArrow(
        _counting("_x", kept), T.StructType([T.StructField(name, placed.schema[name].dataType) for name in kept])
    )
    in_strips = in_slabs.groupBy("_strip", "_strip_part").applyInArrow(
        _counting("_slab", ["_id", "_n"]), T.StructType([T.StructField(name, placed.schema[name].dataType) for name in ("_id", "_n")])
    )
    unknown = rows.where(~known).select("_id", F.lit(0).cast("bigint").alias("_n"))
    return in_strips.unionByName(unknown).groupBy(F.col("_id").alias(id)).agg(F.sum("_n").alias(out))


def _cuts(points: DataFrame, column: str, slabs: int) -> list:
    """Up to ``slabs - 1`` different values of ``column`` in order, with about as many rows from one to the next."""
    if slabs < 2:
        return []
    if isinstance(points.schema[column].dataType, (T.NumericType, T.DatetimeType, T.AnsiIntervalType)):
        found = F.percentile_approx(column, [at / slabs for at in range(1, slabs)], 100 * slabs)
        return sorted(set(points.agg(found).first()[0] or []))
    # No quantiles of such values: those of a sample. Cuts only balance the work, so any will do.
    share = min(1.0, 100 * slabs / max(1, points.count()))
    sample = points.sample(share, seed=1).agg(F.sort_array(F.collect_list(column)).alias("v"))
    place = F.sequence(F.lit(1), F.lit(slabs - 1)) if slabs > 2 else F.array(F.lit(1))
    at = F.transform(place, lambda n: F.get("v", F.floor(n * F.size("v") / slabs).cast("int")))
    return [row[0] for row in sample.select(F.explode(F.array_distinct(at))).where("col IS NOT NULL").orderBy("col").collect()]


def _slab_of(points: DataFrame, column: str, cuts: list) -> Column:
    """Twice the number of cuts below ``column``, and one more where it is a cut itself."""
    if not cuts:
        return F.lit(0)
    # Cuts in groups: the coarse ones lead to a few fine ones.
    step = max(1, int(len(cuts) ** 0.5))
    kind = points.schema[column].dataType
    coarse = F.array(*[F.lit(one).cast(kind) for one in cuts[::step]])
    group = F.greatest(F.size(F.filter(coarse, lambda cut: cut < F.col(column))) - 1, F.lit(0))
    fine = F.get(F.array(*[F.array(*[F.lit(one).cast(kind) for one in cuts[at : at + step]]) for at in range(0, len(cuts), step)]), group)
    below = group * step + F.size(F.filter(fine, lambda cut: cut < F.col(column)))
    is_cut = F.array_contains(fine, F.col(column)) | F.array_contains(coarse, F.col(column))
    return (2 * below + is_cut.cast("int")).cast("int")


def _below_cells(points: DataFrame, slabs: int, strips: int, most_rows: int) -> DataFrame:
    """For each slab and strip with rows: ``_n`` rows of lower slabs and lower strips, and groups for the rows of both."""
    rows = points.groupBy("_slab", "_strip").agg(F.count(F.lit(1)).alias("_rows"))
    every = points.sparkSession.range(slabs * strips).select(
        F.expr(f"CAST(id DIV {strips} AS INT)").alias("_slab"), F.expr(f"CAST(id % {strips} AS INT)").alias("_strip")
    )
    grid = every.join(rows, ["_slab", "_strip"], "left").fillna(0, ["_rows"])
    slab, strip = Window.partitionBy("_slab"), Window.partitionBy("_strip")
    before = (Window.unboundedPreceding, -1)
    ran = grid.withColumns({
        "_left": F.sum("_rows").over(slab.orderBy("_strip").rowsBetween(*before)),
        "_slab_parts": F.ceil(F.sum("_rows").over(slab) / most_rows).cast("int"),
    })
    ran = ran.withColumns({
        "_n": F.coalesce(F.sum("_left").over(strip.orderBy("_slab").rowsBetween(*before)), F.lit(0)),
        "_strip_parts": F.ceil(F.sum("_rows").over(strip) / most_rows).cast("int"),
    })
    return pinned(ran.where("_rows > 0").select("_slab", "_strip", "_n", "_slab_parts", "_strip_parts"))


def _counting(x: str, kept: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """A function that adds to ``_n`` of a group's rows those that are smaller in ``x`` and in ``_y``."""

    def count(group: pa.Table) -> pa.Table:
        below = pc.add(group["_n"], pa.array(_dominated(group[x], group["_y"])))
        return group.set_column(group.column_names.index("_n"), "_n", below).select(list(kept))

    return count


def _dominated(x: pa.ChunkedArray, y: pa.ChunkedArray) -> np.ndarray:
    """Per row the rows that are smaller in both, by the bits of the ranks of ``x``."""
    x = pc.rank(x.combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64) - 1
    y = pc.rank(y.combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64) - 1
    below = np.zeros(len(x), np.int64)
    for bit in range(int(x.max()).bit_length() if len(x) else 0):
        right = (x >> bit) & 1  # those on the right of a node ask, those on the left are counted
        node = x >> (bit + 1)
        order = np.lexsort((1 - right, y, node))  # at equal y those that ask come first
        left = 1 - right[order]
        upto = np.cumsum(left) - left
        begins = np.flatnonzero(np.diff(node[order], prepend=-1))
        base = np.repeat(upto[begins], np.diff(np.append(begins, len(x))))
        below[order] += np.where(left == 0, upto - base, 0)
    return below


def dense_grid(facts: DataFrame, members: DataFrame, key: str, step: str, steps: Column, measure: str) -> DataFrame:
    """Every member with every step, ``measure`` being 0 where ``facts`` has no row.

    ``steps`` is an array column that does not depend on the rows (a calendar, a range of codes), so
    each member row is unfolded in place. ``facts`` holds one row per ``(key, step)``.
    """
    grid = members.select(key).distinct().withColumn(step, F.explode(steps))
    filled = F.coalesce(F.col(measure), F.lit(0))
    return grid.join(facts, [key, step], "left").withColumn(measure, filled)
