import math
import random
import re
from collections import Counter

import pytest
from odd import frame, odd_documents

from lakemoor.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) of each item, one document after the other."""
    cut = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    cut = [(doc_id, tf) for doc_id, tf in cut if tf]
    total = sum(sum(tf.values()) for _, tf in cut)
    holding = Counter(term for _, tf in cut for term in tf)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, tf in cut:
            m = 100 - 75 + (75 * sum(tf.values()) * len(cut)) // total
            score = 0
            for term in terms_of(text):
                if term in tf:
                    w = math.floor(1000 * math.log((2 * len(cut) + 2) / (2 * holding[term] + 1)))
                    score += w * ((1_000_000_000 * tf[term]) // (1000 * tf[term] + 8 * m))
            if score > 0:
                found.append((-score, math.inf if doc_id is None else doc_id, doc_id))
        best = sorted(found, key=lambda row: row[:2])[:k]
        out += [(item_id, at + 1, doc_id, -negative) for at, (negative, _, doc_id) in enumerate(best)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def items_frame(spark, items):
    return spark.createDataFrame([(*row, "clash") for row in items], "item_id long, text string, score string")


WORDS = ["a", "b", "ab", "ba", "A", "é", "É", "日本", "x9", "9", "the", "THE", "ß", "naïve", "🙂"]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    seps = [" ", "  ", ".", "\x00", "\n", "'", "-", "\x7f", "_"]
    texts = ["".join(rnd.choice(WORDS) + rnd.choice(seps) for _ in range(rnd.randrange(0, 40))) for _ in range(300)]
    docs = [(rnd.randrange(200), text) for text in texts] + [(None, "the naïve"), (500, None), (501, "")]
    items = [(i, " ".join(rnd.choices(WORDS + ["nowhere"], k=rnd.randrange(0, 9)))) for i in range(40)]
    return docs, items + [(40, None), (41, "..."), (None, "the ab"), (3, "the ab"), (42, "the the the AB")]


@pytest.mark.parametrize("block_queries", [4096, 7])
def test_brute_force(spark, corpus, monkeypatch, block_queries):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", block_queries)
    got = lexical.search(frame(spark, docs).repartition(5), items_frame(spark, items))
    assert rows(got) == brute(docs, items)


def test_odd_rows_ties_and_empty_tables(spark):
    docs = odd_documents(spark, "rank", "item_id", "key", "query")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(1, "words stand here"), (2, "x" * 5000), (3, "WORD word"), (4, "mit license")]
    assert rows(lexical.search(docs, items_frame(spark, items), k=2)) == brute(plain, items, k=2)
    asked = items_frame(spark, items)
    assert lexical.search(docs.limit(0), asked).collect() == []
    assert lexical.search(docs, asked.limit(0)).collect() == []
    assert lexical.search(docs, items_frame(spark, [(1, "?"), (2, None)])).collect() == []


def test_many_equal_scores_keep_the_least_ids(spark):
    docs = [(i, "same text here") for i in range(500, 0, -1)] + [(i + 1000, "other words") for i in range(700)]
    got = rows(lexical.search(frame(spark, docs).repartition(8), items_frame(spark, [(1, "text")])))
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(n, n) for n in range(1, 11)]
