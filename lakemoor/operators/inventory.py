"""What a database holds: table probes, mount reports and landed listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemoor.functions.cells import TextTable, text_rows
from lakemoor.sources.catalog import Lake
from lakemoor.session import pinned

# Fixed values of the mount report and the table sample.
LISTED_TABLES = 50
LISTED_FAILURES = 10
SAMPLE_ROWS = 5
SAMPLE_WIDTH = 40


def table_probe(lake: Lake, database: str, tables: Sequence[str] | None = None) -> DataFrame:
    """``(table, row_count, column_count, columns)`` of many tables, counted in one job."""
    names = lake.table_names(database) if tables is None else list(tables)
    parts = []
    for name in names:
        df = lake.table(database, name)
        spelled = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table"),
                F.col("row_count"),
                F.lit(len(df.columns)).alias("column_count"),
                F.lit(spelled).alias("columns"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def table_sample(lake: Lake, database: str, table: str, order_by: Sequence[str] = ()) -> TextTable:
    """A few rows of a table as text: any, or the first in the order of ``order_by``."""
    df = lake.table(database, table)
    if order_by:
        df = df.orderBy(*order_by)
    # Taken once, so that widths and lines speak of the same rows.
    return text_rows(pinned(df.limit(SAMPLE_ROWS)), width=SAMPLE_WIDTH)


def mount_report(report: DataFrame, max_listed: int = LISTED_TABLES) -> DataFrame:
    """One row per database: counts, the first mounted names, and the first failures as text."""
    by_status = Window.partitionBy("database", "status").orderBy("position")
    place = F.row_number().over(by_status)
    most = F.when(F.col("status") == "mounted", max_listed).otherwise(LISTED_FAILURES)
    shown = (
        report.withColumn("_place", place)
        .where(F.col("_place") <= most)
        .groupBy("database")
        .agg(
            _listed("mounted", F.col("table")).alias("_mounted"),
            _listed("failed", F.concat(F.col("table"), F.lit(": "), F.col("error"))).alias("_failed"),
        )
    )
    counts = report.groupBy("database").agg(
        F.count_if(F.col("status") == "mounted").alias("mounted_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
    )
    more = F.col("mounted_count") - max_listed
    names = F.array_join("_mounted", ", ")
    return counts.join(shown, "database").select(
        "database",
        "mounted_count",
        F.when(F.col("mounted_count") == 0, "(none)")
        .when(more > 0, F.concat(names, F.lit(", … (+"), more.cast("string"), F.lit(" more)")))
        .otherwise(names)
        .alias("mounted"),
        "failed_count",
        F.array_join("_failed", "\n").alias("failed"),
    )


def mount_text(report: DataFrame, max_listed: int = LISTED_TABLES) -> str:
    """:func:`mount_report` as text, one line per database and one per failure shown."""
    lines = []
    for row in mount_report(report, max_listed).orderBy("database").collect():
        lines.append(f"Mounted {row['mounted_count']} table(s) in {row['database']}: {row['mounted']}")
        if row["failed_count"]:
            lines.append(f"{row['failed_count']} failed:")
            lines += [f"  {line}" for line in row["failed"].split("\n")]
    return "\n".join(lines)


def _listed(status: str, text):
    """Texts of one status in request order; at most a report's worth of rows arrives here."""
    picked = F.collect_list(F.when(F.col("status") == status, F.struct("position", text.alias("text"))))
    return F.transform(F.array_sort(picked), lambda entry: entry["text"])


def flatten_pages(
    pages: DataFrame, item_schema: str, items_key: str = "value", body: str = "body", seq: str = "seq"
) -> DataFrame:
    """Landed listing pages as one row per item, ``(seq, pos, item fields…)``.

    A page without ``items_key`` has no items. Sort by ``(seq, pos)`` for the listing's order.
    """
    schema = f"struct<`{items_key}`: array<struct<{item_schema}>>>"
    parsed = pages.select(F.col(seq).alias("seq"), F.from_json(body, schema).alias("page"))
    items = parsed.select("seq", F.posexplode(F.col("page").getField(items_key)).alias("pos", "item"))
    return items.select("seq", "pos", "item.*")


def last_page(pages: DataFrame, body: str = "body", seq: str = "seq") -> DataFrame:
    """Per page whether the listing goes on after it: it does while there is a continuation token."""
    token = F.get_json_object(body, "$.continuationToken")
    return pages.select(F.col(seq).alias("seq"), (F.coalesce(token, F.lit("")) == "").alias("is_last"))
