"""A lake: directories of tables registered as databases, mounted when they are needed."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame, SparkSession

from lakemoor.functions.cells import NO_RESULT, text_rows
from lakemoor.functions.values import normalise
from lakemoor.operators.bounded import MOST_ROWS, BoundedRows, bounded, checked_limit
from lakemoor.sources.files import DEFAULT_FORMAT, register_path
from lakemoor.sources.names import database_name, name_parts, quote

# Fixed value: rows returned when no limit is given.
DEFAULT_LIMIT = 100

REPORT_SCHEMA = "database string, position int, table string, status string, error string"
OUTCOME_SCHEMA = (
    "seq int, ok boolean, has_result boolean, error_condition string, message string, "
    "row_count bigint, truncated boolean"
)

# What stands before the statement that EXPLAIN is asked about.
_EXPLAIN = re.compile(
    r"(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*EXPLAIN\s+(?:(?:LOGICAL|FORMATTED|EXTENDED|CODEGEN|COST)\s+)?",
    re.DOTALL | re.IGNORECASE,
)
# Nodes of a parsed statement that change the table they name, and nodes that stand for such a table.
_CHANGES = ("DeleteFromTable", "UpdateTable", "MergeIntoTable")
_CHANGED = ("UnresolvedIdentifier", "UnresolvedTable")


class UnknownDatabase(ValueError):
    """The database was not registered with this lake."""


class MissingTable(LookupError):
    """The table is not stored where its database keeps its tables."""

    def getCondition(self) -> str:
        return "TABLE_OR_VIEW_NOT_FOUND"


@dataclass(frozen=True)
class Database:
    """A registered database: the tables of ``root``, stored as ``{root}/{table}{suffix}``."""

    name: str
    root: str
    suffix: str = ""

    def path(self, table: str) -> str:
        return f"{self.root}/{table}{self.suffix}"


@dataclass
class Lake:
    """Databases known to one session, and what was mounted or created through it."""

    spark: SparkSession
    fmt: str = DEFAULT_FORMAT
    default_limit: int = DEFAULT_LIMIT
    most_rows: int = MOST_ROWS
    _known: dict[str, Database] = field(default_factory=dict)

    # -- databases ---------------------------------------------------------------------

    def add_database(self, root: str, name: str | None = None, suffix: str = "") -> str:
        """Register the directory ``root`` as a database. No table is touched."""
        root = root.rstrip("/")
        database = Database(name or database_name(root), root, suffix)
        earlier = self._known.get(database.name.lower())
        if earlier is not None and earlier.root != root:
            raise ValueError(f"database {earlier.name!r} already stands for {earlier.root}")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(database.name)}")
        self._known[database.name.lower()] = database
        return database.name

    def add_databases(self, parent: str, exclude: Iterable[str] = (), inside: str = "", suffix: str = "") -> list[str]:
        """Register every directory below ``parent`` as a database of its name.

        ``exclude`` names those to leave out, in any case; ``inside`` is the folder of each that
        holds the tables, if they do not lie in it directly.
        """
        barred = {name.strip().lower() for name in exclude}
        found = [e for e in self._list(parent) if e.isDirectory()]
        names = sorted(e.getPath().getName() for e in found)
        return [
            self.add_database("/".join(filter(None, [parent.rstrip("/"), name, inside])), name, suffix)
            for name in names
            if name.lower() not in barred and not name.startswith((".", "_"))
        ]

    def add_listed(self, listing: DataFrame, parent: str, inside: str = "", suffix: str = "") -> list[str]:
        """Register the databases of a listing (``name``, ``id``) whose folders are called by their ids.

        A name that stands for two ids is an error.
        """
        rows = sorted({(row["name"], row["id"]) for row in listing.select("name", "id").collect()})
        return [
            self.add_database("/".join(filter(None, [parent.rstrip("/"), folder, inside])), name, suffix)
            for name, folder in rows
        ]

    def _list(self, directory: str):
        """The entries of one directory; what lies deeper is not listed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(directory)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)

    def database(self, name: str) -> Database:
        """The registered database of that name, in any case."""
        found = self._known.get(name.lower())
        if found is None:
            known = sorted(d.name for d in self._known.values())
            raise UnknownDatabase(f"no database {name!r} is registered here, only {', '.join(known) or 'none at all'}")
        return found

    def databases(self) -> DataFrame:
        """All databases of the catalog with the root of those this lake registered."""
        rows = []
        for entry in self.spark.catalog.listDatabases():
            known = self._known.get(entry.name.lower())
            rows.append((entry.name, known is not None, known.root if known else None))
        return self.spark.createDataFrame(rows, "database string, registered boolean, root string")

    # -- tables ------------------------------------------------------------------------

    def table_names(self, database: str) -> list[str]:
        """Tables stored in a database, mounted or not: one listing of its root directory."""
        info = self.database(database)
        names = [entry.getPath().getName() for entry in self._list(info.root)]
        return sorted(
            name[: len(name) - len(info.suffix)]
            for name in names
            if not name.startswith((".", "_")) and name.endswith(info.suffix) and name != info.suffix
        )

    def tables(self, database: str) -> DataFrame:
        """``(database, table, path, mounted)`` of every table stored in a database."""
        info = self.database(database)
        rows = [
            (info.name, name, info.path(name), self.is_mounted(info.name, name))
            for name in self.table_names(database)
        ]
        return self.spark.createDataFrame(
            rows, "database string, table string, path string, mounted boolean"
        )

    def is_mounted(self, database: str, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{quote(database)}.{quote(table)}")

    def mount(self, database: str, table: str) -> str:
        """Make one stored table queryable as ``database.table``; repeating it changes nothing."""
        info = self.database(database)
        path = info.path(table)
        try:
            target = register_path(self.spark, (info.name, table), path, self.fmt)
        except AnalysisException as error:
            if error.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise MissingTable(f"table {info.name}.{table} not found at {path}") from error
            raise
        return target

    def mount_many(self, database: str, tables: Iterable[str]) -> DataFrame:
        """Mount several tables; a failure is reported as ``Type: message`` and the rest go on."""
        name = self.database(database).name
        rows = []
        for position, table in enumerate(tables):
            try:
                self.mount(name, table)
                rows.append((name, position, table, "mounted", None))
            except Exception as error:
                rows.append((name, position, table, "failed", f"{type(error).__name__}: {error}"))
        return self.spark.createDataFrame(rows, REPORT_SCHEMA)

    def mount_all(self, database: str, tables: Iterable[str] | None = None) -> DataFrame:
        """Mount the given tables, or every table stored in the database."""
        return self.mount_many(database, self.table_names(database) if tables is None else tables)

    def table(self, database: str, table: str) -> DataFrame:
        """A table by name, mounted on first use."""
        info = self.database(database)
        if not self.is_mounted(info.name, table):
            self.mount(info.name, table)
        return self.spark.table(f"{quote(info.name)}.{quote(table)}")

    # -- SQL ---------------------------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        """``spark.sql``; a statement that reads stored but unmounted tables mounts them first.

        That holds for what is read inside CREATE … AS, CACHE, INSERT, EXPLAIN and SHOW as well. A
        statement that would change a table of a registered database mounts nothing. The
        analyzer reports one missing name at a time, so each round mounts one table. A name is
        tried once, which ends the loop when mounting it did not help.
        """
        may_mount = self._may_mount(text)
        tried: set[tuple[str, str]] = set()
        while True:
            try:
                with _quiet_errors():
                    return self.spark.sql(text)
            except AnalysisException as error:
                target = self._unmounted(error) if may_mount else None
                if target is None or target in tried:
                    raise
                tried.add(target)
                self.mount(*target)

    def _may_mount(self, text: str) -> bool:
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except Exception:  # running the statement raises the same, for the caller
            return False
        if plan.getClass().getSimpleName() == "ExplainCommand":
            # The analyzer puts its errors into the answer here, so the statement itself is tried.
            asked = _EXPLAIN.sub("", text, count=1)
            inner = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(asked)
            if asked != text and not _is_command(self.spark, inner):
                self.sql(asked)
            return False
        current = self.spark.catalog.currentDatabase()
        owners = {(parts[-2] if len(parts) > 1 else current).lower() for parts in _changed_names(plan)}
        return owners.isdisjoint(self._known)

    def _unmounted(self, error: AnalysisException) -> tuple[str, str] | None:
        """The table a failed query misses, if a registered database may hold it."""
        if error.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            return None
        parts = name_parts((error.getMessageParameters() or {}).get("relationName", ""))
        if len(parts) == 3 and parts[0].lower() == "spark_catalog":
            parts = parts[1:]
        if len(parts) != 2 or parts[0].lower() not in self._known:
            return None
        info = self.database(parts[0])
        if self.is_mounted(info.name, parts[1]):
            return None
        return info.name, parts[1]

    def run_sql(self, text: str, limit: int | None = None) -> BoundedRows:
        """Run a statement and bring at most ``limit`` of its rows, in plain form, to the driver."""
        limit = checked_limit(self.default_limit if limit is None else limit, self.most_rows)
        df = self.sql(text)
        if not df.columns:
            return BoundedRows([], [], 0, False, limit)
        return bounded(normalise(df), limit, self.most_rows).fetch()

    def show_sql(self, text: str, limit: int | None = None) -> str:
        """:meth:`run_sql` as a text table."""
        limit = checked_limit(self.default_limit if limit is None else limit, self.most_rows)
        df = self.sql(text)
        if not df.columns:
            return NO_RESULT
        # Fetched once, so that widths, lines and footer speak of the same rows.
        part = bounded(normalise(df), limit, self.most_rows)
        fetched = part.fetch_rows()
        truncated = len(fetched) > limit
        kept = self.spark.createDataFrame(fetched[:limit], part.probe.schema, verifySchema=False)
        return text_rows(kept.coalesce(1), truncated=truncated, limit=limit).text()

    def outcomes(self, statements: Iterable[str], limit: int | None = None) -> DataFrame:
        """Run statements in order; each becomes a row, and an error does not stop the rest."""
        limit = checked_limit(self.default_limit if limit is None else limit, self.most_rows)
        with _quiet_errors():
            rows = [(i, *self._outcome(text, limit)) for i, text in enumerate(statements)]
        return self.spark.createDataFrame(rows, OUTCOME_SCHEMA)

    def _outcome(self, text: str, limit: int) -> tuple:
        try:
            df = self.sql(text)
            if not df.columns:
                return True, False, None, None, 0, False
            # The rows are fetched, not counted: counting would skip the columns that may fail.
            found = bounded(normalise(df), limit, self.most_rows).fetch()
            return True, True, None, None, found.row_count, found.truncated
        except Exception as error:
            read: Callable[[], str | None] | None = getattr(error, "getCondition", None)
            condition = read() if read else None
            return False, False, condition, f"{type(error).__name__}: {error}", None, None

    # -- session -----------------------------------------------------------------------

    def snapshot(self) -> DataFrame:
        """The session as ``(key, value)`` rows; lists are joined by commas."""
        catalog = self.spark.catalog
        databases = sorted(d.name for d in catalog.listDatabases())
        entries = [
            ("spark_version", self.spark.version),
            ("master", self.spark.sparkContext.master),
            ("app_id", self.spark.sparkContext.applicationId),
            ("current_database", catalog.currentDatabase()),
            ("default_limit", str(self.default_limit)),
            ("databases", ", ".join(databases)),
            ("registered", ", ".join(sorted(d.name for d in self._known.values()))),
        ]
        return self.spark.createDataFrame(entries, "key string, value string")

    def describe(self) -> str:
        """:meth:`snapshot` as text."""
        entries = {row["key"]: row["value"] for row in self.snapshot().collect()}
        lines = ["Spark session:"]
        for key, value in entries.items():
            if key in ("databases", "registered"):
                count = len(value.split(", ")) if value else 0
                lines.append(f"  {key} ({count}): {value or '(none)'}")
            else:
                lines.append(f"  {key}: {value}")
        return "\n".join(lines)

    def columns(self, database: str) -> DataFrame:
        """``(database, table, position, column, type)`` of the mounted tables of a database."""
        info = self.database(database)
        rows = []
        for entry in self.spark.catalog.listTables(info.name):
            if entry.isTemporary:
                continue
            schema = self.spark.table(f"{quote(info.name)}.{quote(entry.name)}").schema
            rows += [
                (info.name, entry.name, i, f.name, f.dataType.simpleString())
                for i, f in enumerate(schema.fields)
            ]
        return self.spark.createDataFrame(
            rows, "database string, table string, position int, column string, type string"
        )

    def reset(self) -> None:
        """Forget mounts, databases, temporary views and cached tables; stored data stays.

        A table that Spark itself stores (saved without a path) cannot be forgotten without losing
        its data, so it is left alone, and so is its database.
        """
        for info in self._known.values():
            stays = False
            for entry in self.spark.catalog.listTables(info.name):
                if entry.isTemporary:
                    continue
                if entry.tableType == "MANAGED":
                    stays = True
                    continue
                kind = "VIEW" if entry.tableType == "VIEW" else "TABLE"
                self.spark.sql(f"DROP {kind} IF EXISTS {quote(info.name)}.{quote(entry.name)}")
            if self.spark.catalog.currentDatabase().lower() == info.name.lower():
                self.spark.catalog.setCurrentDatabase("default")
            if not stays:
                self.spark.sql(f"DROP DATABASE IF EXISTS {quote(info.name)}")
        for entry in self.spark.catalog.listTables():
            if entry.isTemporary:
                self.spark.catalog.dropTempView(entry.name)
        self.spark.catalog.clearCache()
        self._known.clear()


@contextmanager
def _quiet_errors():
    """Keep errors that are handled here, such as names about to be mounted, out of the log."""
    log = PySparkLogger.getLogger("SQLQueryContextLogger")
    level = log.level
    log.setLevel(logging.CRITICAL)
    try:
        yield
    finally:
        log.setLevel(level)


def _is_command(spark: SparkSession, plan) -> bool:
    command = "org.apache.spark.sql.catalyst.plans.logical.Command"
    return spark._jvm.java.lang.Class.forName(command).isInstance(plan)


def _changed_names(plan) -> list[list[str]]:
    """The name parts of all tables that a parsed statement creates or changes."""
    kind = plan.getClass().getSimpleName()
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    found: list[list[str]] = []
    if kind == "InsertIntoStatement":
        found.append(_parts(plan.table().multipartIdentifier()))
    elif kind in _CHANGES:
        found.append(_parts(plan.collectLeaves().head().multipartIdentifier()))
    elif kind in _CHANGED:
        found.append(_parts(plan.nameParts() if kind == "UnresolvedIdentifier" else plan.multipartIdentifier()))
    for child in children:
        found += _changed_names(child)
    return found


def _parts(names) -> list[str]:
    return [names.apply(i) for i in range(names.size())]
