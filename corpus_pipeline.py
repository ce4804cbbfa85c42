"""The corpus pipeline: each stage reads what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``:

1. quality_classifier: documents that the model rejects go.
2. ngram_jaccard_join: of each group of linked documents the one with the least doc_id stays.
3. secret_scans: every document stays, what was found in it is masked in its text.
4. packing: the pieces of token sequences.

Defined results: a null text counts as an empty one; rows without a doc_id, and repeated ones, are rows of their own in each
stage; rows without words are copies of nothing; an empty table passes through as one; other columns stay as they are in
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakemoor.llm.common import prepare, table
from lakemoor.llm.packing import pack
from lakemoor.llm.quality import keep_good, train
from lakemoor.llm.secret_scan import redact
from lakemoor.llm.similar import keep_one_of_each
from lakemoor.session import pinned, scratch_path

import public_tokenizers  # isort: skip  (behind what the entry point may find missing)

ORACLE_SQL = None  # trained models and tokenizers are beyond SQL; the tests check against plain Python


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one_of_each(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return redact(docs, scratch_path(spark, "blob-ledger"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each),
    ("secret_scans", secrets_masked),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; what each stage keeps is written before the next one reads it."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
