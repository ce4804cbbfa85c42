"""The registered queries and the pipeline over whole tables."""

import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from compare import connect, difference
from odd import odd_documents
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from lakemoor.llm import quality
from lakemoor.llm.queries import ORACLES, QUERIES
from lakemoor.llm.secret_scan import BASE, find_all

REPO = Path(__file__).resolve().parents[2]


def test_all_are_registered():
    registered = entry_point.queries()
    assert "pipeline" in registered
    for n in range(1, 14):
        assert sum(key.startswith(f"op{n}_") for key in registered) == 1
    assert set(ORACLES) <= set(entry_point.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "lakemoor").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"lakemoor\.llm|corpus_pipeline", path.read_text()), path


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(key, spark, sf_dir):
    with connect(sf_dir) as con:
        assert difference(QUERIES[key](spark, sf_dir), con, ORACLES[key]) is None


def test_stages(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "secret_scans", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        kept[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
    assert set(kept["quality_classifier"]) == good
    once = kept["ngram_jaccard_join"]
    assert set(once) < good and len({r.text for r in once.values()}) == len(once)
    masked = kept["secret_scans"]
    assert set(masked) == set(once)
    for i, row in masked.items():
        assert not find_all(row.text, BASE)
        assert (row.text == texts[i]) == (not find_all(texts[i], BASE)) and row.n_chars == len(row.text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in kept["packing"]:
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, own in pieces.items():
        ids = tokenizer.encode(masked[i].text, add_special_tokens=False).ids + [1]
        whole = b"".join(piece for _, piece in sorted(own))
        assert zlib.crc32(whole) == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert set(pieces) == set(masked)


def test_stages_on_odd_rows(spark, sf_dir, tmp_path):
    docs = odd_documents(spark, "row", "text_id", "score", "set_id", "a.b", "text.x")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        assert out.count() > 0 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = out
