import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from odd import TEXTS, frame, odd_documents

from lakemoor.llm import periodic


def brute_runs(words):
    """Every maximal stretch of every period, the least period of each."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        at = 0
        while at + p < n:
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end + p - at >= max(6, 4 * p):
                found.setdefault((at, end + p - at), p)
            at = end + 1
    return sorted((a, length, p) for (a, length), p in found.items())


def brute_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for a, n, p in runs for i in range(a + p, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    told = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = [hashlib.sha256(one.encode()).hexdigest() for one in (told, kept)]
    return (doc_id, len(runs), *best, milli, *sha)


def random_words(rnd):
    kind = rnd.random()
    if kind < 0.4:
        return rnd.choices("ab" if kind < 0.2 else "abc", k=rnd.randrange(0, 80))
    out = []
    while len(out) < 60:
        unit = rnd.choices("abcd", k=rnd.randrange(1, 12))
        whole = unit * rnd.randrange(1, 8)
        out += whole[: rnd.randrange(1, len(whole) + 1)]
    return out


def test_runs_of_random_words():
    rnd = random.Random(12)
    texts = [[w.encode() for w in random_words(rnd)] for _ in range(1500)]
    for words, runs in zip(texts, periodic.find_runs(texts)):
        assert runs == brute_runs(words), words
        assert periodic.find_runs([words]) == [runs]


def test_long_periods_and_many_powers():
    rnd = random.Random(3)
    texts = []
    for n in (100, 255, 256, 257, 511, 700):
        unit = [b"%d" % rnd.randrange(5) for _ in range(n)]
        texts.append([b"x"] * rnd.randrange(9) + (unit * 5)[: 4 * n + rnd.randrange(n)] + [b"y"])
        texts.append((unit * 4)[: 4 * n - 1])
    texts.append([b"a"] * 500 + [b"b"] + [b"a"] * 500 + [b"b"] + ([b"a"] * 500 + [b"b"]) * 3)
    for words, runs in zip(texts, periodic.find_runs(texts)):
        assert runs == brute_runs(words)


def test_every_square_is_caught():
    rnd = random.Random(5)
    for _ in range(300):
        words = np.array(rnd.choices(range(rnd.randrange(2, 4)), k=rnd.randrange(2, 60)))
        caught = {(a, b) for one in periodic.Catchers(words).runs() for a, b, _ in zip(*(x.tolist() for x in one))}
        for p in range(1, len(words) // 2 + 1):
            for at in range(len(words) - 2 * p + 1):
                if (words[at : at + p] == words[at + p : at + 2 * p]).all():
                    assert any(a <= at and at + 2 * p <= b for a, b in caught), (words, at, p)


def test_names_that_collide(monkeypatch):
    """Runs from a wrong name are not told; other names are taken."""
    words, seeds = np.array([1, 2, 3, 4] * 5 + [5]), []
    real = periodic.Catchers.runs

    def runs(self):
        seeds.append(len(seeds))
        wrong = [(np.array([0]), np.array([21]), np.array([3]))]
        return wrong if len(seeds) == 1 else real(self)

    monkeypatch.setattr(periodic.Catchers, "runs", runs)
    assert [x.tolist() for x in periodic._checked(words)] == [[0], [20], [4]] and len(seeds) == 2


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], list("abcdefg"), [str(i) for i in range(1000)]])
def test_long_texts_take_time_in_proportion(unit):
    words = [w.encode() for w in unit] * (400_000 // len(unit))
    began = time.monotonic()
    assert periodic.find_runs([words]) == [[(0, len(words), len(unit))]]
    assert time.monotonic() - began < 10


def test_collapse():
    words = b"a a a a a a b c b c b c b c d".split()
    runs = periodic.find_runs([words])[0]
    assert runs == [(0, 6, 1), (6, 8, 2)]
    assert periodic.collapse(words, runs) == b"a b c d".split()
    assert periodic.strongest([(5, 8, 2), (0, 6, 1), (9, 12, 2)]) == (0, 6, 1)
    assert periodic.strongest([]) is None


def test_rows(spark, monkeypatch):
    rnd = random.Random(8)
    docs = [(i, " ".join(random_words(rnd))) for i in range(300)] + [(None, "x " * 9), (7, "\x1c".join("abab" * 4))]
    docs += [(10, "p q r s t u v w " * 60), (3, " ".join(map(str, range(500))))]
    want = sorted((brute_row(*row) for row in docs), key=repr)
    monkeypatch.setattr(periodic, "BATCH_WORDS", 500)
    got = periodic.periodic_runs(frame(spark, docs), periodic.planted).drop("collapsed")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)


def test_odd_rows(spark):
    docs = odd_documents(spark, "start", "length", "n_runs", "words")
    got = periodic.periodic_runs(docs, periodic.planted)
    short = [row for row in TEXTS if len(row[1] or "") < 10_000]
    want = sorted((brute_row(*row) for row in short), key=repr)
    rows = [tuple(r)[:-1] for r in got.collect()]
    assert sorted((r for r in rows if r[0] != 8), key=repr) == want
    assert next(r for r in rows if r[0] == 8)[1:5] == (1, 0, 30_000, 1)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_registered(spark, sf_dir):
    rows = {r.doc_id: tuple(r) for r in periodic.op12_square_catchers(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 3000").select("doc_id", "text")
    for doc_id, text in docs.collect():
        assert rows[doc_id] == brute_row(doc_id, text)
