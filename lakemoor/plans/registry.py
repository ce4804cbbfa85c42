"""Queries over a mounted lake, each with the SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakemoor.session import apply_session_conf
from lakemoor.sources.catalog import Lake

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
SUFFIX = ".parquet"


@dataclass(frozen=True)
class Mounted:
    """A lake with one registered database; tables are mounted when a query names them."""

    lake: Lake
    db: str
    root: str

    @property
    def spark(self) -> SparkSession:
        return self.lake.spark

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which ``{db}`` stands for the database."""
        return self.lake.sql(text.replace("{db}", f"`{self.db}`"))

    def table(self, name: str) -> DataFrame:
        return self.lake.table(self.db, name)


@dataclass(frozen=True)
class Query:
    key: str
    covers: tuple[str, ...]
    build: Callable[[Mounted], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, oracle: str | None = None):
    """Register a function of a :class:`Mounted` lake under its own name.

    the result can be checked from outside.
    """

    def register(build: Callable[[Mounted], DataFrame]):
        key = build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = Query(key, tuple(covers.split()), build, oracle)
        return build

    return register


def same_sql(key: str, covers: str, text: str) -> None:
    """Register a statement both engines understand; ``{db}.`` names the mounted database."""

    def build(at: Mounted) -> DataFrame:
        return at.sql(text)

    build.__name__ = key
    query(covers, text.replace("{db}.", ""))(build)


def open_lake(spark: SparkSession, sf_dir: str) -> Mounted:
    apply_session_conf(spark)
    lake = Lake(spark)
    root = sf_dir.rstrip("/")
    return Mounted(lake, lake.add_database(root, suffix=SUFFIX), root)


def run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[key].build(open_lake(spark, sf_dir))
