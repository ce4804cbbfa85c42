"""Ranked lexical search by scanning documents with one automaton of all query terms.

No index of documents is made. The terms of all queries, each between two guards, are the words of
an Aho-Corasick automaton. A document's term characters are kept, A-Z lower-cased, and everything
else becomes a guard, so that a match is a whole term wherever it stands; neighbours share a
guard, which the automaton's overlapping matches allow. A term leads to the queries that hold it.

The documents are scanned twice. The first scan counts the documents and terms of the corpus and
the documents that hold each query term (summed by Spark). The second one scores: each task keeps the best documents
of each query that it has met, so it hands on ``k`` rows a query at most; the best of all tasks are
taken in two steps, first by query and a share of the tasks, then by query.

Queries with equal texts are one query. Distinct texts are dealt into blocks of some BLOCK_CHARS
characters and BLOCK_QUERIES texts, each with an automaton of its own that is broadcast, so what the driver holds and
broadcasts is bounded by a block; a larger query table means more blocks, each scanned for apart.

Defined results: a null text has no terms; a document without terms counts nowhere; a query without
terms gets no rows; each row of the documents is a document and each row of the queries a query,
whatever its id; equal scores go by ascending doc_id, rows without one last; documents that score
0 are left out; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemoor.llm.common import query, table, texts_of
from lakemoor.session import pinned

BLOCK_CHARS, BLOCK_QUERIES = 1 << 20, 4096
SHARES = 64  # into which the tasks' best rows are dealt before a query's rows meet

# One byte for one: A-Z to a-z, the ASCII characters of no term to a guard, all other bytes as they are.
_GUARD = " "
_FOLD = bytes(
    ord(chr(byte).lower()) if chr(byte).isalnum() else ord(_GUARD) if byte < 128 else byte
    for byte in range(128)
) + bytes(range(128, 256))


def folded(text: bytes) -> bytes:
    """``text`` with its terms lower-cased and one guard for each character between them."""
    return text.translate(_FOLD)


def count_terms(text: bytes) -> int:
    """The number of terms of a folded text."""
    inside = np.frombuffer(text, np.uint8) != ord(_GUARD)
    return int(np.count_nonzero(inside[1:] > inside[:-1]) + inside[0]) if len(inside) else 0


class QueryBlock:
    """The automaton of some queries' terms, and which queries hold a term how often."""

    def __init__(self, texts: list[str]) -> None:
        own = [Counter(folded(text.encode()).decode().split(_GUARD)) for text in texts]
        for terms in own:
            terms.pop("", None)
        self.terms = {term: at for at, term in enumerate(dict.fromkeys(term for terms in own for term in terms))}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for term, at in self.terms.items():
            self.found.add_word(_GUARD + term + _GUARD, at)
        self.found.make_automaton()
        # Queries with terms, one after the other: their terms and how often each stands there.
        self.queries = np.flatnonzero([len(terms) > 0 for terms in own])
        sizes = np.array([len(own[at]) for at in self.queries], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.term = np.array([self.terms[term] for at in self.queries for term in own[at]], np.int64)
        self.times = np.array([n for at in self.queries for n in own[at].values()], np.int64)

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The terms of this block in a folded text, and how often each occurs."""
        if not self.terms:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        met = [at for _, at in self.found.iter(f"{_GUARD}{text.decode()}{_GUARD}")]
        return np.unique(np.array(met, np.int64), return_counts=True)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Each query's sum of its terms' ``parts``, repeats included."""
        return np.add.reduceat(parts[self.term] * self.times, self.begins)


_BLOCKS: dict[int, QueryBlock] = {}


def _block(sent) -> QueryBlock:
    """This worker's copy of a broadcast block."""
    if sent.value[0] not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[sent.value[0]] = pickle.loads(sent.value[1])
    return _BLOCKS[sent.value[0]]


def _folded_texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    return zip(batch.column("doc_id").to_pylist(), map(folded, texts))


_DOCUMENTS, _TERMS = -1, -2  # stand in the place of a term for the counts of the corpus


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(sent)
        holding = np.zeros(len(block.terms), np.int64)
        documents = terms = 0
        for batch in batches:
            for _, text in _folded_texts(batch):
                n = count_terms(text)
                documents, terms = documents + (n > 0), terms + n
                holding[block.counts(text)[0]] += 1
        held = np.flatnonzero(holding)
        term = np.append(held, [_DOCUMENTS, _TERMS])
        count = np.append(holding[held], [documents, terms])
        yield pa.record_batch([pa.array(term), pa.array(count.astype(np.int64))], names=["term", "n"])

    return run


class _Best:
    """The ``k`` best documents of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.ones(queries, np.int64)  # what a document must score to come in
        self.rows: list[list[tuple[int, float, int | None]]] = [[] for _ in range(queries)]

    def add(self, doc_id: int | None, scores: np.ndarray) -> None:
        for at in np.flatnonzero(scores >= self.least).tolist():
            own = self.rows[at]
            own.append((-int(scores[at]), math.inf if doc_id is None else doc_id, doc_id))
            if len(own) >= 4 * self.k:
                self.cut(at)

    def cut(self, at: int) -> None:
        own = self.rows[at] = sorted(self.rows[at], key=lambda row: row[:2])[: self.k]
        if len(own) == self.k:
            self.least[at] = -own[-1][0]


def _score(sent, statistics, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(sent)
        documents, terms, weight = statistics.value
        best = _Best(len(block.queries), k)
        parts = np.zeros(len(block.terms), np.int64)
        for batch in batches:
            for doc_id, text in _folded_texts(batch):
                held, times = block.counts(text)
                if not len(held):
                    continue
                m = 100 - 75 + (75 * count_terms(text) * documents) // terms
                parts[held] = weight[held] * ((1_000_000_000 * times) // (1000 * times + 8 * m))
                best.add(doc_id, block.scores(parts))
                parts[held] = 0
        found = []
        for at in range(len(block.queries)):
            best.cut(at)
            found += [(int(block.queries[at]), doc_id, -negative) for negative, _, doc_id in best.rows[at]]
        if found:
            columns = [pa.array(column, pa.int64()) for column in zip(*found)]
            share = pa.array(np.full(len(found), TaskContext.get().partitionId() % SHARES), pa.int64())
            yield pa.record_batch([*columns, share], names=["query", "doc_id", "score", "share"])

    return run


def _best_rows(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, texts: list[str], number: int, k: int) -> DataFrame | None:
    block = QueryBlock(texts)
    if not block.terms:
        return None
    context = spark.sparkContext
    sent = context.broadcast((number, pickle.dumps(block)))
    counted = docs.mapInArrow(_count(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = dict(counted.collect())  # a row for each term of the block at most
    documents, terms = counts.pop(_DOCUMENTS, 0), counts.pop(_TERMS, 0)
    if not documents:
        return None
    weight = np.zeros(len(block.terms), np.int64)
    for at, holding in counts.items():
        weight[at] = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))
    statistics = context.broadcast((documents, terms, weight))
    found = docs.mapInArrow(_score(sent, statistics, k), "query long, doc_id long, score long, share long")
    return _best_rows(_best_rows(found, k, "query", "share"), k, "query").drop("share")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents (``doc_id``, ``text``) of each row of ``items`` (``item_id``, ``text``):
    item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text").filter("text IS NOT NULL").withColumn("key", F.sha2("text", 256))
    distinct = pinned(asked.groupBy("key").agg(F.first("text").alias("text")))
    size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-size[0] // BLOCK_QUERIES), -(-size[1] // BLOCK_CHARS), 1)
    docs, results = texts_of(docs), []
    for at in range(blocks):
        own = distinct.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == at).orderBy("key").collect()  # a block's texts
        found = _search_block(spark, docs, [row.text for row in own], hash((at, *(row.key for row in own))), k)
        if found is not None:
            keys = spark.createDataFrame([(n, row.key) for n, row in enumerate(own)], "query long, key string")
            results.append(found.join(keys, "query").select("key", "rank", "doc_id", "score"))
    if not results:
        none = docs.limit(0).selectExpr("CAST(NULL AS string) AS key", "1 AS rank", "doc_id", "0L AS score")
        results.append(none)
    ranked = results[0]
    for other in results[1:]:
        ranked = ranked.unionByName(other)
    return asked.select("item_id", "key").join(ranked, "key").select("item_id", "rank", "doc_id", "score")


@query(
    r"""
    WITH terms AS (
        SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ),
    tf AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
    corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
        FROM tf, corpus GROUP BY term, docs
    ),
    asked AS (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ),
    wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
    scored AS (
        SELECT item_id, row, doc_id, sum(times * w
            * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
        FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (row), corpus
        GROUP BY item_id, row, doc_id
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scored WHERE score > 0
    ) WHERE rank <= 10
    """
)
def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
