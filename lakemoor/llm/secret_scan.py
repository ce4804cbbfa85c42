"""Secret scans over an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its content. A ledger (a folder of
Parquet files) holds one row per blob and rule version with what was found there; only blobs that
the ledger has no row for under the present rules are scanned, each once however many paths carry
it, and the findings are joined back to all paths.

Skew: copies of one blob are combined in the map tasks before their text is shuffled, so a blob
that a third of all paths carry sends at most one text per task. The join back moves hashes and
findings only and is left to AQE, which splits a hot blob on the side of the paths.

Defined results: a null text is an empty one; an empty text, and an empty table, has no findings;
repeated rows each get their findings; other columns of the input are not read. Offsets are code
points, ends exclusive. Two runs that scan one ledger at the same time may both scan a blob, so a
ledger has one writer at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import each_batch, free_name, query, table, texts_of
from lakemoor.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    ``hints``: lower-case pieces of text; where none of them stands in the lower-cased text, there
    is no match and the pattern is not tried.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    def spans(self, text: str, lowered: str) -> list[tuple[int, int]]:
        if self.hints and not any(hint in lowered for hint in self.hints):
            return []
        found = re.compile(self.pattern, re.ASCII).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


@dataclass(frozen=True)
class WebToken(Rule):
    """Three parts between points, the first two beginning with ``pattern``, of ``parts`` characters or more.

    A first part may begin behind a hyphen. Each run of parts is read once, however often the beginning
    stands in it, which one regular expression would not do.
    """

    parts: tuple[int, int, int] = (1, 1, 1)

    def spans(self, text: str, lowered: str) -> list[tuple[int, int]]:
        if self.hints and not any(hint in lowered for hint in self.hints):
            return []
        out = []
        for run in _RUN_OF_PARTS.finditer(text):
            begins = run.start()
            parts = []
            for part in run.group().split("."):
                parts.append((begins, part))
                begins += len(part) + 1
            at = 0
            while at + 2 < len(parts):
                (begin, one), (_, two), (last, three) = parts[at : at + 3]
                first = 0 if one.startswith(self.pattern) else one.find("-" + self.pattern) + 1
                fits = first or one.startswith(self.pattern)
                fits = fits and len(one) - first >= self.parts[0] and two.startswith(self.pattern)
                if fits and len(two) >= self.parts[1] and len(three) >= self.parts[2]:
                    out.append((begin + first, last + len(three)))
                    at += 3
                else:
                    at += 1
        return out


_RUN_OF_PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++", re.ASCII)

# The base kinds, in the order that decides ties. A run of hex digits too short to count cannot
# hold a longer one, nor can a run after AKIA, so those two ask for the length in the pattern.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        hints=("password", "passwd", "secret", "token", "api_key", "apikey"),
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("private key-----",)),
    WebToken("jwt", "eyJ", parts=(11, 11, 16), hints=("eyj",)),
    Rule("forge_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("bearer", r"\b[Bb]earer [A-Za-z0-9_.=/+-]{24,}", hints=("bearer",)),
)
RULES = BASE + MORE

FINDINGS = "array<struct<kind: string, start: int, stop: int>>"
LEDGER = f"blob_id string, rule_version string, findings {FINDINGS}"


def rule_version(rules: Sequence[Rule]) -> str:
    """A name for exactly these rules in this order."""
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def find_all(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """Every finding, by start, then by the order of the rules."""
    lowered = text.lower()
    found = [(start, rank, stop) for rank, rule in enumerate(rules) for start, stop in rule.spans(text, lowered)]
    return [(rules[rank].kind, start, stop) for start, rank, stop in sorted(found)]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def _scanner(rules: tuple[Rule, ...]):
    version = rule_version(rules)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            [{"kind": k, "start": a, "stop": b} for k, a, b in find_all(text, rules)]
            for text in batch.column("text").to_pylist()
        ]
        return pa.record_batch(
            [batch.column("blob_id"), pa.array([version] * len(found), pa.string()), pa.array(found, _FOUND)],
            names=["blob_id", "rule_version", "findings"],
        )

    return each_batch(scan)


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing has been written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger has not seen of ``versions`` (``text``), and return its rows for ``rules``."""
    spark = versions.sparkSession
    known = read_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version(rules))
    blobs = versions.select(blob_id(F.col("text")).alias("blob_id"), "text")
    unseen = (
        blobs.groupBy("blob_id").agg(F.any_value("text").alias("text")).join(known, "blob_id", "left_anti")
    )
    unseen.mapInArrow(_scanner(tuple(rules)), LEDGER).write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version(rules))


def secret_findings(docs: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id``, ``blob_id`` and ``findings`` of every row of ``docs`` (``doc_id``, ``text``)."""
    versions = texts_of(docs)
    ledger = scan_unseen(versions, ledger_path, rules).select("blob_id", "findings").filter(F.size("findings") > 0)
    paths = versions.select("doc_id", blob_id(F.col("text")).alias("blob_id"))
    return paths.join(ledger, "blob_id", "left").select(
        "doc_id", "blob_id", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")
    )


def redact(docs: DataFrame, ledger_path: str, rules: Sequence[Rule] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping findings give one mark.

    Rows without findings are returned as they are. Each blob with findings is masked once.
    """
    blob = blob_id(F.coalesce("text", F.lit("")))
    hit = scan_unseen(texts_of(docs), ledger_path, rules).filter(F.size("findings") > 0)
    hit = hit.select(F.col("blob_id").alias("text_id"), "findings")
    held = free_name(docs.columns, "held")  # a column of the same name would hide it
    marked = docs.select(F.struct("*").alias(held), blob.alias("text_id")).join(hit, "text_id", "left")
    whole = F.col(held).getField("text")
    masked = F.when(F.col("findings").isNull(), whole).otherwise(_masked(whole, F.col("findings"), mark))
    out = marked.select(held, masked.alias("masked"))
    columns = []
    for name in docs.columns:
        value = F.col(held).getField(name)
        if name == "text":
            value = F.col("masked")
        elif name == "n_chars":
            value = F.char_length("masked").cast(docs.schema["n_chars"].dataType)
        columns.append(value.alias(name))
    return out.select(*columns)


def _masked(text: Column, findings: Column, mark: str) -> Column:
    """The text between the findings (which are ordered by start) with ``mark`` for each run of them."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(done: Column, one: Column) -> Column:
        piece = F.concat(done.done, text.substr(done.at + 1, one.start - done.at), F.lit(mark))
        return F.struct(
            F.when(one.start >= done.at, piece).otherwise(done.done).alias("done"),
            F.greatest(done.at, one.stop).alias("at"),
        )

    def finish(done: Column) -> Column:
        return F.concat(done.done, text.substr(done.at + 1, F.char_length(text)))

    return F.aggregate(findings, start, step, finish)


def digest(findings: DataFrame) -> DataFrame:
    """Counts, hash and text of the findings of each document."""
    found = F.col("findings")
    base = F.filter(found, lambda x: x.kind.isin([rule.kind for rule in BASE]))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    return findings.select(
        "doc_id",
        *[count(rule.kind) for rule in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(found).alias("spans"),
    )


@query()
def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_findings(table(spark, sf_dir, "documents"), scratch_path(spark, "blob-ledger"))
    return digest(found)
