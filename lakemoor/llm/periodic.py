"""Runs: stretches of words that repeat with a period, found by online dyadic square catching.

A square is a stretch of words that stands twice in a row. For each power of two B, every completed
block of B words (blocks begin at multiples of B) has a catcher. Each appended word compares the
text's suffix of B words with the catchers whose blocks ended between 2B - 1 and 4B - 2 words ago;
where they are equal, at a distance p, two stretches p apart agree, and the catcher follows the
agreement word by word to both sides. It spans p words or more where there is a square of period p.
Any p words in a row, 2B - 1 <= p <= 4B - 2, hold a whole block, so the catchers of all powers
catch every square. Squares of one period that overlap or touch merge into one run.

The words of a batch of texts are appended together, a power of two at a time: suffixes are
compared by 64-bit names, doubled from power to power, and whole arrays of catchers advance at once.
What a catcher follows starts with the longest suffix that has a name and halves it. A word has at most four
catchers of a power to meet, so time grows as words x log(words), and memory likewise. Catchers
whose block and match both lie in a run of a period up to B that is known already have nothing new to tell and are dismissed:
without that, a text of one word would catch each multiple of its period. Names may collide in
theory, so runs are checked word by word before they are told.

A task works on its own documents; nothing is shuffled, and no document meets another one.

Defined results: a null text is an empty one; documents without words, or without runs, have n_runs
0, four nulls and the digest of nothing; repeated rows each get their results; a row without a
doc_id is never altered by ``planted``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakemoor.llm.common import query, table, texts_of

LEAST_LENGTH, LEAST_POWER = 6, 4  # a run told has so many words and so many periods at least
BATCH_WORDS = 1 << 17  # words appended together (a longer text comes alone)

Run = tuple[int, int, int]  # start, length, period


def words_of(text: str) -> list[bytes]:
    """The words of a text, split at ASCII white space, in UTF-8."""
    return text.encode().split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that a tenth of the doc_ids carry from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + at % p] for at in range(n - a)]


class Catchers:
    """The squares of one sequence of word numbers, caught a power of two at a time."""

    def __init__(self, words: np.ndarray, seed: int = 1) -> None:
        self.words = words
        random = np.random.default_rng(seed)
        self.mix = random.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
        # names[k][t] stands for the 2**k words that begin at t.
        self.names = [(words.astype(np.uint64) + np.uint64(1)) * self.mix[-1]]
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # period: first word and end of each run

    def _double(self) -> None:
        last, power = self.names[-1], len(self.names) - 1
        half = 1 << power
        left, right = last[:-half], last[half:]
        name = (left ^ (left >> np.uint64(29))) * self.mix[power] + right * self.mix[power + 31]
        self.names.append(name ^ (name >> np.uint64(32)))

    def runs(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Start, end and period of all runs of two periods or more, per period met."""
        n, power = len(self.words), 0
        while 3 * (1 << power) - 1 <= n:  # a block, and a suffix that begins 2B - 1 words later
            block, match, period = self._equal(power)
            if len(block):
                self._follow(block, match, period, power)
            power += 1
            if len(self.names[-1]) <= 1 << (power - 1):
                break
            self._double()
        return [(a, b, np.full(len(a), p)) for p, (a, b) in self.known.items()]

    def _equal(self, power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Catchers that meet an equal suffix: where block and suffix begin, and the distance."""
        names, size = self.names[power], 1 << power
        blocks = np.arange(0, len(names), size)
        found = []
        for distance in range(2 * size - 1, 4 * size - 1) if size <= 8 else ():
            own = blocks[: np.searchsorted(blocks, len(names) - distance)]
            hit = own[names[own] == names[own + distance]]
            found.append((hit, np.full(len(hit), distance)))
        if size > 8:  # few catchers with many suffixes each: one row of the table is one catcher
            reach = np.arange(2 * size - 1, 4 * size - 1)
            padded = np.concatenate([names, ~names[-1:], np.zeros(4 * size, np.uint64)])
            whole = np.lib.stride_tricks.sliding_window_view(padded, len(reach))
            own = blocks[blocks + reach[0] < len(names)]
            at, step = np.nonzero(whole[own + reach[0]] == names[own][:, None])
            keep = own[at] + reach[step] < len(names)
            found.append((own[at[keep]], reach[step[keep]]))
        block = np.concatenate([one[0] for one in found])
        period = np.concatenate([one[1] for one in found])
        fresh = ~self._inside_a_run(block, block + period + size, size)
        return block[fresh], block[fresh] + period[fresh], period[fresh]

    def _inside_a_run(self, first: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
        """Whether a known run of a period up to ``longest`` holds the words from ``first`` to ``end``."""
        inside = np.zeros(len(first), bool)
        known = [runs for period, runs in self.known.items() if period <= longest]
        if known and len(first):
            starts = np.concatenate([runs[0] for runs in known])
            order = np.argsort(starts, kind="stable")
            # The run that reaches farthest of those that begin no later holds the words if any does.
            reach = np.maximum.accumulate(np.concatenate([runs[1] for runs in known])[order])
            at = np.searchsorted(starts[order], first, side="right") - 1
            inside = (at >= 0) & (reach[at] >= end)
        return inside

    def _follow(self, block: np.ndarray, match: np.ndarray, period: np.ndarray, power: int) -> None:
        """Extend agreements by 2B - 1 words at most to both sides and merge those of one period."""
        size, n = 1 << power, len(self.words)
        left, right = block.copy(), block + size  # the agreement: words[left:right] == words[left + p:right + p]
        for k in range(power, -1, -1):
            names, step = self.names[k], 1 << k
            ok = left >= step
            ok[ok] = names[left[ok] - step] == names[left[ok] - step + period[ok]]
            left[ok] -= step
            ok = right + period + step <= n
            ok[ok] = names[right[ok]] == names[right[ok] + period[ok]]
            right[ok] += step
        order = np.lexsort((left, period))
        left, right, period = left[order], right[order], period[order]
        # Agreements of one period that overlap are one; the catchers inside it are a block apart.
        line = period * np.int64(n + 1)
        reach = np.maximum.accumulate(right + line)
        begins = np.flatnonzero(np.append(True, (left + line)[1:] > reach[:-1]))
        first, period = left[begins], period[begins]
        last = reach[np.append(begins[1:], len(left)) - 1] - period * np.int64(n + 1)
        square = last - first >= period
        first, last, period = first[square], last[square], period[square]
        edges = np.flatnonzero(np.append(True, np.diff(period) > 0)) if len(period) else np.empty(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(period))):
            self.known[int(period[a])] = (first[a:b], last[a:b] + period[a:b])


def _checked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs long enough to be told, each compared word by word."""
    seed = 1
    while True:
        caught = Catchers(words, seed).runs()
        start, end, period = (np.concatenate([one[i] for one in caught] or [np.empty(0, np.int64)]) for i in range(3))
        told = end - start >= np.maximum(LEAST_LENGTH, LEAST_POWER * period)
        start, end, period = start[told], end[told], period[told]
        # A stretch found with several periods has the least of them.
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        own = np.append(True, (np.diff(start) > 0) | (np.diff(end) > 0))[: len(start)]
        start, end, period = start[own], end[own], period[own]
        if all(np.array_equal(words[a : b - p], words[a + p : b]) for a, b, p in zip(start, end, period)):
            order = np.lexsort((period, start))
            return start[order], end[order], period[order]
        seed += 1  # two stretches had one name: name them otherwise


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words, by start, then period."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(words) for words in texts], np.int64)
    # A number of its own behind each text keeps runs from crossing.
    offsets = np.cumsum(lengths + 1) - lengths - 1
    line = np.empty(int((lengths + 1).sum()), np.int64)
    for at, (words, offset) in enumerate(zip(texts, offsets.tolist())):
        line[offset : offset + len(words)] = [numbers.setdefault(word, len(numbers)) for word in words]
        line[offset + len(words)] = -1 - at
    start, end, period = _checked(line)
    text = np.searchsorted(offsets, start, side="right") - 1
    out: list[list[Run]] = [[] for _ in texts]
    for at, a, n, p in zip(text.tolist(), (start - offsets[text]).tolist(), (end - start).tolist(), period.tolist()):
        out[at].append((a, n, p))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods; ties to the smallest start, then period."""

    def compare(a: Run, b: Run) -> int:
        more = b[1] * a[2] - a[1] * b[2]
        return more or (a[0] - b[0]) or (a[2] - b[2])

    return min(runs, key=cmp_to_key(compare)) if runs else None


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    kept, at = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        if end > at:
            kept += words[at : max(begin, at)]
            at = end
    return kept + words[at:]


ROWS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string"
)


def _row(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    best = strongest(runs)
    told = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    kept = b" ".join(collapse(words, runs))
    digests = hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests, kept.decode()


def _finder(alter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for doc_id, text in rows:
                words = alter(doc_id, words_of(text))
                if held and n + len(words) > BATCH_WORDS:
                    yield _told(held)
                    held, n = [], 0
                held.append((doc_id, words))
                n += len(words)
            if held:
                yield _told(held)

    return run


def _told(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    found = find_runs([words for _, words in held])
    rows = [_row(doc_id, words, runs) for (doc_id, words), runs in zip(held, found)]
    kinds = [pa.int64()] * 6 + [pa.string()] * 3
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.record_batch(columns, names=[field.split()[0] for field in ROWS.split(", ")])


def _unaltered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def periodic_runs(docs: DataFrame, alter=_unaltered) -> DataFrame:
    """Runs of every row of ``docs`` (``doc_id``, ``text``): how many, the strongest one, digests of all,
    and ``collapsed``, the text with one period of each run.

    ``alter(doc_id, words)`` gives the words to look at instead of the text's own.
    """
    return texts_of(docs).mapInArrow(_finder(alter), ROWS)


@query()
def op12_square_catchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted).drop("collapsed")
