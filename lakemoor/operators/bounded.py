"""Results of bounded size that say whether something was left out."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# The most rows that may be brought to the driver at once, unless a caller says otherwise.
MOST_ROWS = 100_000


def checked_limit(limit: int, most_rows: int = MOST_ROWS) -> int:
    if not 1 <= limit <= most_rows:
        raise ValueError(f"limit must be between 1 and {most_rows}, not {limit}")
    return limit


@dataclass(frozen=True)
class BoundedRows:
    """Rows of a bounded result on the driver."""

    columns: list[str]
    rows: list[list]
    row_count: int
    truncated: bool
    limit: int

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Bounded:
    """``probe`` holds up to one row more than ``limit``: that row only shows there is more."""

    probe: DataFrame
    limit: int

    def rows(self) -> DataFrame:
        return self.probe.limit(self.limit)

    def summary(self) -> DataFrame:
        """One row ``(row_count, truncated, limit)``.

        Rows without content are fetched, ``limit + 1`` at most: Spark reads only as many splits as
        it takes to find them, where a count would start a task for each.
        """
        n = len(self.probe.select(F.lit(1).alias("one")).collect())
        row = (min(n, self.limit), n > self.limit, self.limit)
        return self.probe.sparkSession.createDataFrame([row], "row_count bigint, truncated boolean, limit int")

    def fetch_rows(self) -> list[Row]:
        return self.probe.collect()

    def fetch(self) -> BoundedRows:
        found = self.fetch_rows()
        kept = [[_plain_lists(value) for value in row] for row in found[: self.limit]]
        return BoundedRows(
            columns=list(self.probe.columns),
            rows=kept,
            row_count=len(kept),
            truncated=len(found) > self.limit,
            limit=self.limit,
        )


def _plain_lists(value):
    """Structs as lists; everything else already is plain."""
    if isinstance(value, (list, tuple)):
        return [_plain_lists(item) for item in value]
    if isinstance(value, dict):
        return {key: _plain_lists(item) for key, item in value.items()}
    return value


def bounded(df: DataFrame, limit: int, most_rows: int = MOST_ROWS) -> Bounded:
    """At most ``limit`` rows of ``df``. After an ORDER BY, Spark keeps only the top rows."""
    return Bounded(df.limit(checked_limit(limit, most_rows) + 1), limit)
