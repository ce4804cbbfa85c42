"""Ordered computations within groups of any size.

A window puts each group into one task, which fails when a single key holds a large part of the
table. Here the groups are counted first (a map-side combined count of the key columns only).
Groups one task can sort go through ordinary windows. Larger ones are range-partitioned by
``(key, order)`` into segments: every segment is computed on its own, one summary row per segment
carries what the earlier segments of the group contribute, and both are joined. The segment of a
row is pinned by writing it to the shared folder, so that lost executors cannot move it.

``order`` should end in a column that makes rows unique; rows equal in it are taken in any order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemoor.session import pinned

# Rows of one group that a single task may sort.
MOST_GROUP_ROWS = 5_000_000
# Rows that may be broadcast, and bytes of their measured values.
MOST_BROADCAST_ROWS = 10_000
MOST_BROADCAST_BYTES = 64 * 1024 * 1024
# Distinct values of one group that a single task counts up, where only counts per value are ordered.
MOST_VALUES = 250_000
# Segments per call. Their borders are sampled by the driver; beyond this they get longer instead.
MOST_SEGMENTS = 20_000

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of the values of a row of ``df``: 16 per value, and what text, bytes or nested values hold."""
    widths = []
    for f in df.schema.fields:
        column = df[f.name]
        if isinstance(f.dataType, _FIXED_WIDTH):
            widths.append(F.lit(16))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            widths.append(F.coalesce(F.octet_length(column), F.lit(0)) + 16)
        else:
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16)
    return reduce(lambda a, b: a + b, widths).cast("bigint")


def frame_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df``, measured by one aggregate."""
    return df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it if one aggregate over it shows few rows and few bytes."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return F.broadcast(df) if _is_small(found["rows"], found["bytes"]) else df


def _is_small(rows: int, size: int | None) -> bool:
    return rows <= MOST_BROADCAST_ROWS and (size or 0) <= MOST_BROADCAST_BYTES


@dataclass(frozen=True)
class SplitGroups:
    """Rows of groups up to the row limit, and of those beyond it (``None`` if there are none)."""

    small: DataFrame
    large: DataFrame | None
    large_groups: int = 0
    large_rows: int = 0


def split_groups(df: DataFrame, keys: Sequence[str], most_rows: int = MOST_GROUP_ROWS) -> SplitGroups:
    """Count the groups of ``df`` and part the large ones from the rest."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > most_rows)
    size = F.sum(row_bytes(sizes)).alias("bytes")
    found = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_size").alias("rows"), size).first()
    if not found["groups"]:
        return SplitGroups(df, None)
    large_keys = sizes.select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    if _is_small(found["groups"], found["bytes"]):
        large_keys = F.broadcast(large_keys)
    same = _all_equal([(df[k], F.col(f"_large_{k}")) for k in keys])
    return SplitGroups(
        small=df.join(large_keys, same, "left_anti"),
        large=df.join(large_keys, same, "left_semi"),
        large_groups=found["groups"],
        large_rows=found["rows"],
    )


def _all_equal(pairs) -> Column:
    return reduce(lambda a, b: a & b, [left.eqNullSafe(right) for left, right in pairs])


@dataclass(frozen=True)
class _Segments:
    """Pinned rows with their segment number ``_seg``, and the bound of the summary rows."""

    rows: DataFrame
    keys: Sequence[str]
    most_summaries: int

    def window(self, order: Sequence[Column | str]):
        return Window.partitionBy("_seg", *self.keys).orderBy(*order)

    def chain(self):
        """The segments of one group in order."""
        return Window.partitionBy(*self.keys).orderBy("_seg")

    def attach(self, rows: DataFrame, summary: DataFrame, names: Sequence[str]) -> DataFrame:
        side = summary.select(*[F.col(c).alias(f"_s_{c}") for c in ("_seg", *self.keys)], *names)
        if self.most_summaries <= MOST_BROADCAST_ROWS:  # else it is not worth measuring
            side = broadcast_if_small(pinned(side))
        same = _all_equal([(rows[c], F.col(f"_s_{c}")) for c in ("_seg", *self.keys)])
        return rows.join(side, same).drop(*[f"_s_{c}" for c in ("_seg", *self.keys)])


def _segments(groups: SplitGroups, keys: Sequence[str], order: Sequence[Column | str], most_rows: int) -> _Segments:
    count = min(MOST_SEGMENTS, max(2, ceil(2 * groups.large_rows / most_rows)))
    # The last column parts rows that are equal in all others, such as copies of one row.
    numbered = groups.large.withColumn("_copy", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(count, *[F.col(k) for k in keys], *order, "_copy")
    rows = pinned(placed.withColumn("_seg", F.spark_partition_id()).drop("_copy"))
    # Each segment border and each group adds at most one (segment, group) pair.
    return _Segments(rows, keys, count + groups.large_groups)


def _both(small: DataFrame, large: DataFrame) -> DataFrame:
    """Both routes with the types of the ordinary one: sums of sums would widen decimals."""
    return small.unionByName(large.select(*[large[f.name].cast(f.dataType).alias(f.name) for f in small.schema]))


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Add for each of ``sums`` the sum over the rows of the group up to and with this one."""
    groups = split_groups(df, keys, most_rows)
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_SO_FAR)
    small = groups.small.withColumns({name: F.sum(value).over(so_far) for name, value in sums.items()})
    if groups.large is None:
        return small
    segments = _segments(groups, keys, order, most_rows)
    window = segments.window(order).rowsBetween(*_SO_FAR)
    inner = segments.rows.withColumns({name: F.sum(value).over(window) for name, value in sums.items()})
    totals = segments.rows.groupBy("_seg", *keys).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = segments.chain().rowsBetween(*_BEFORE)
    summary = totals.withColumns({f"_b_{n}": F.sum(f"_t_{n}").over(earlier) for n in sums})
    joined = segments.attach(inner, summary, [f"_b_{n}" for n in sums])
    return _both(small, joined.withColumns({n: _added(F.col(n), F.col(f"_b_{n}")) for n in sums}))


def _added(here: Column, before: Column) -> Column:
    return F.coalesce(here + before, here, before)


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    out: str,
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Add the last ``value`` that is not NULL among the rows of the group up to this one."""
    groups = split_groups(df, keys, most_rows)
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_SO_FAR)
    small = groups.small.withColumn(out, F.last(value, ignorenulls=True).over(so_far))
    if groups.large is None:
        return small
    segments = _segments(groups, keys, order, most_rows)
    window = segments.window(order)
    placed = segments.rows.withColumn("_place", F.row_number().over(window))
    inner = placed.withColumn(out, F.last(value, ignorenulls=True).over(window.rowsBetween(*_SO_FAR)))
    known = F.when(F.col(value).isNotNull(), F.col("_place"))
    per_segment = placed.groupBy("_seg", *keys).agg(F.max_by(value, known).alias("_in_segment"))
    carried = F.last("_in_segment", ignorenulls=True).over(segments.chain().rowsBetween(*_BEFORE))
    summary = per_segment.withColumn("_carried", carried)
    joined = segments.attach(inner, summary, ["_carried"])
    return _both(small, joined.withColumn(out, F.coalesce(out, "_carried")))


def with_ranks(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie: str,
    descending: bool = False,
    tiles: int = 4,
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Add ``row_number``, ``rank``, ``dense_rank``, ``percent_rank`` and ``ntile``.

    Rows equal in ``by`` are peers; ``tie`` makes the row numbers (and tiles) definite.
    """
    value = F.col(by).desc() if descending else F.col(by).asc()
    order = [value, F.col(tie).asc()]
    groups = split_groups(df, keys, most_rows)
    peers = Window.partitionBy(*keys).orderBy(value)
    rows = Window.partitionBy(*keys).orderBy(*order)
    small = groups.small.withColumns(
        {
            "row_number": F.row_number().over(rows).cast("bigint"),
            "rank": F.rank().over(peers).cast("bigint"),
            "dense_rank": F.dense_rank().over(peers).cast("bigint"),
            "percent_rank": F.percent_rank().over(peers),
            "ntile": F.ntile(tiles).over(rows),
        }
    )
    if groups.large is None:
        return small
    # Peers may lie on both sides of a segment border: the values are compared there.
    segments = _segments(groups, keys, order, most_rows)
    placed = segments.rows.withColumns(
        {
            "_row": F.row_number().over(segments.window(order)),
            "_rank": F.rank().over(segments.window([value])),
            "_dense": F.dense_rank().over(segments.window([value])),
        }
    )
    per_segment = placed.groupBy("_seg", *keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("_dense").alias("_values"),
        F.max("_rank").alias("_last_start"),
        F.min_by(by, "_row").alias("_first_value"),
        F.max_by(by, "_row").alias("_last_value"),
    )
    chain = segments.chain()
    earlier = chain.rowsBetween(*_BEFORE)
    continues = F.coalesce(
        F.lag(F.lit(True)).over(chain) & F.col("_first_value").eqNullSafe(F.lag("_last_value").over(chain)),
        F.lit(False),
    )
    begun = F.when(~(F.col("_continues") & (F.col("_values") == 1)), F.col("_offset") + F.col("_last_start"))
    summary = (
        per_segment.withColumn("_continues", continues)
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy(*keys)))
        .withColumn("_new", F.col("_values") - F.col("_continues").cast("int"))
        .withColumn(
            "_dense_offset",
            F.coalesce(F.sum("_new").over(earlier), F.lit(0)) - F.col("_continues").cast("int"),
        )
        .withColumn("_carried_rank", F.last(begun, ignorenulls=True).over(earlier))
    )
    carried = ["_continues", "_offset", "_total", "_dense_offset", "_carried_rank"]
    joined = segments.attach(placed, summary, carried)
    row_number = (F.col("_offset") + F.col("_row")).cast("bigint")
    rank = F.when(F.col("_continues") & (F.col("_rank") == 1), F.col("_carried_rank")).otherwise(
        F.col("_offset") + F.col("_rank")
    )
    share = F.when(F.col("_total") > 1, (F.col("rank") - 1) / (F.col("_total") - 1)).otherwise(0.0)
    large = (
        joined.withColumn("row_number", row_number)
        .withColumn("rank", rank.cast("bigint"))
        .withColumn("dense_rank", (F.col("_dense_offset") + F.col("_dense")).cast("bigint"))
        .withColumn("percent_rank", share.cast("double"))
        .withColumn("ntile", _tile(F.col("row_number"), F.col("_total"), tiles).cast("int"))
    )
    return _both(small, large)


def _tile(row: Column, total: Column, tiles: int) -> Column:
    size = F.floor(total / tiles)
    longer = total % tiles
    head = longer * (size + 1)
    in_head = F.floor((row - 1) / (size + 1)) + 1
    in_rest = longer + F.floor((row - 1 - head) / F.greatest(size, F.lit(1))) + 1
    return F.when(row <= head, in_head).otherwise(in_rest)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    before: int = 1,
    after: int = 1,
    nth: int = 2,
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Add ``previous``, ``next``, ``first``, ``last`` and ``nth`` of ``value`` in the whole group.

    Rows of large groups find each other by an equi-join on ``(keys, row number)``, which no key
    can skew.
    """
    groups = split_groups(df, keys, most_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    small = groups.small.withColumns(
        {
            "previous": F.lag(value, before).over(window),
            "next": F.lead(value, after).over(window),
            "first": F.first(value).over(whole),
            "last": F.last(value).over(whole),
            "nth": F.nth_value(value, nth).over(whole),
        }
    )
    if groups.large is None:
        return small
    numbered = pinned(with_running(groups.large, keys, order, {"_row": F.lit(1)}, most_rows))
    large = numbered
    for out, shift in (("previous", -before), ("next", after)):
        other = numbered.select(
            *[F.col(k).alias(f"_o_{k}") for k in keys],
            (F.col("_row") - shift).alias("_o_row"),
            F.col(value).alias(out),
        )
        pairs = [(large[k], F.col(f"_o_{k}")) for k in keys]
        found = large.join(other, _all_equal(pairs) & (F.col("_row") == F.col("_o_row")), "left")
        large = found.drop("_o_row", *[f"_o_{k}" for k in keys])
    ends = numbered.groupBy(*keys).agg(
        F.min_by(value, "_row").alias("first"),
        F.max_by(value, "_row").alias("last"),
        F.max(F.when(F.col("_row") == nth, F.col(value))).alias("nth"),
    )
    ends = ends.withColumnsRenamed({k: f"_e_{k}" for k in keys})
    if groups.large_groups <= MOST_BROADCAST_ROWS:
        ends = broadcast_if_small(pinned(ends))
    large = large.join(ends, _all_equal([(large[k], F.col(f"_e_{k}")) for k in keys]))
    return _both(small, large)


def with_trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: Column,
    out: str,
    rows: int,
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over this row and the ``rows`` rows before it.

    Large groups are cut into stretches by row number; each stretch takes along the ``rows`` rows
    before it, and the ordinary frame is computed there. A task holds a stretch (``rows`` rows or
    half the limit, whichever is more) and those.
    """
    groups = split_groups(df, keys, most_rows)
    frame = (-rows, Window.currentRow)
    small = groups.small.withColumn(
        out, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame))
    )
    if groups.large is None:
        return small
    numbered = pinned(with_running(groups.large, keys, order, {"_row": F.lit(1)}, most_rows))
    size = max(rows, most_rows // 2, 1)
    stretch = F.floor((F.col("_row") - 1) / size)
    own = numbered.withColumns({"_stretch": stretch, "_own": F.lit(True)})
    taken = numbered.where((F.col("_row") - 1) % size >= size - rows)
    taken = taken.withColumns({"_stretch": stretch + 1, "_own": F.lit(False)})
    window = Window.partitionBy(*keys, "_stretch").orderBy("_row").rowsBetween(*frame)
    large = own.unionByName(taken).withColumn(out, F.sum(value).over(window)).where("_own")
    return _both(small, large)


def with_trailing_range(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    id: str,
    reach: int,
    sums: Mapping[str, Column],
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Add sums over the rows of the group with ``at`` in ``[here - reach, here]``.

    ``at`` is a whole number (e.g. microseconds) and ``id`` is unique. In large groups, sums of exact
    types (integers, decimals) are differences of running sums: each row asks twice, before the
    first row in reach and after its last peer. Sums of doubles are never subtracted: a group
    is cut into stretches as long as the reach, each stretch takes along the one before it,
    and the ordinary frame is computed there, so a task holds the rows of two reaches.
    """
    groups = split_groups(df, keys, most_rows)
    frame = Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, Window.currentRow)
    small = groups.small.withColumns({name: F.sum(v).over(frame) for name, v in sums.items()})
    if groups.large is None:
        return small
    kinds = df.select(*[value.alias(name) for name, value in sums.items()]).schema
    if any(isinstance(field.dataType, (T.FloatType, T.DoubleType)) for field in kinds):
        return _both(small, _trailing_range_by_stretch(pinned(groups.large), keys, at, reach, sums))
    large = pinned(groups.large)
    base = [F.col(k) for k in keys] + [F.col(id).alias("_id")]

    def marks(position: Column, side: int) -> DataFrame:
        kept = {name: (value if side == 1 else F.lit(0)) for name, value in sums.items()}
        return large.select(
            *base, position.alias("_at"), F.lit(side).alias("_side"), *[v.alias(n) for n, v in kept.items()]
        )

    # Order at one position: questions for "before it", the rows, questions for "with it".
    line = marks(F.col(at) - reach, 0).unionByName(marks(F.col(at), 1)).unionByName(marks(F.col(at), 2))
    order = [F.col("_at"), F.col("_side"), F.col("_id")]
    known = {f"_c_{name}": F.when((F.col("_side") == 1) & F.col(name).isNotNull(), 1).otherwise(0) for name in sums}
    run = {f"_r_{name}": F.coalesce(F.col(name), F.lit(0)) for name in sums} | known
    answered = with_running(line, keys, order, run, most_rows)
    sign = F.when(F.col("_side") == 2, 1).when(F.col("_side") == 0, -1)
    answers = answered.groupBy("_id").agg(*[F.sum(sign * F.col(name)).alias(name) for name in run])
    answers = answers.select("_id", *[F.when(F.col(f"_c_{n}") > 0, F.col(f"_r_{n}")).alias(n) for n in sums])
    return _both(small, large.join(answers, F.col(id) == F.col("_id")))


def _trailing_range_by_stretch(
    large: DataFrame, keys: Sequence[str], at: str, reach: int, sums: Mapping[str, Column]
) -> DataFrame:
    length = max(reach, 1)
    start = F.col(at) - F.pmod(F.col(at), F.lit(length))
    own = large.withColumns({"_stretch": start, "_own": F.lit(True)})
    taken = large.where(F.col(at).isNotNull()).withColumns({"_stretch": start + length, "_own": F.lit(False)})
    window = Window.partitionBy(*keys, "_stretch").orderBy(at).rangeBetween(-reach, Window.currentRow)
    found = own.unionByName(taken).withColumns({name: F.sum(value).over(window) for name, value in sums.items()})
    return found.where("_own").drop("_stretch", "_own")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``place``.

    Spark keeps ``k`` rows per group in every map task before it shuffles (window group limit),
    so the size of a group does not matter while ``k`` is small.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    most_rows: int = MOST_VALUES,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: one column per entry of ``shares``.

    Equal values are counted before anything is ordered; then the values at the two positions
    around each share are picked by their running counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = pinned(counts)  # read three times below
    placed = with_running(counts, keys, [value], {"_end": F.col("_n")}, most_rows)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    totals = totals.withColumnsRenamed({k: f"_t_{k}" for k in keys})
    joined = placed.join(totals, _all_equal([(placed[k], F.col(f"_t_{k}")) for k in keys]))
    start, end, total = F.col("_end") - F.col("_n"), F.col("_end"), F.col("_total")
    picks = []
    for name, share in shares.items():
        position = (total - 1) * F.lit(float(share))
        for edge, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((start <= index) & (index < end), F.col(value))).alias(f"_{name}_{edge}"))
    picked = joined.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, share in shares.items():
        position = (total - 1) * F.lit(float(share))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *out)
