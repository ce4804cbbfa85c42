"""Order-preserving packing of documents into token sequences of bounded length.

A task sees its documents as one stream of ids. Sequences are consecutive windows of that stream;
a window may end behind a document, behind a sentence (at a cost, as it truncates a document), or,
in a sentence too long for that, at a regular step (at a higher cost). Of all ways to cut, dynamic
programming takes the one with the least padding plus costs: with a window's padding linear in its
length, the best window that ends at a place starts where a key is least among the places in reach,
which a monotone queue holds, so a stream is cut in time linear in its places. A window
whose length is a power of two needs no padding and is tried apart.

A stream is solved in blocks; the last, open window of a block goes on into the next one, so memory
is bounded by the block (and the longest document). No rows are shuffled.

Defined results: a null text is an empty one and has the end id alone; null and repeated doc_ids
are kept; an empty table gives no rows; other columns are not read. The last window of each input
partition is whatever is left. Rows of one partition are packed in the order they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import query, table, texts_of
from lakemoor.llm.tokens import encoder, vocabulary

WINDOW = 2048
BLOCK = 1 << 19  # tokens solved at once
SENTENCE_COST = 6  # a window that ends inside a document, in tokens of padding
SENTENCE_ENDS = tuple(sign.encode() for sign in ".!?\n…。！？．｡।॥؟۔։።၊။།")
SHORTEST = 64  # the least power of two tried as a window's length where none is given
STEP, STEP_COST = 128, 64  # places inside sentences longer than a window, and what ending there costs
SEQUENCES_PER_TASK = 36  # bits

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


def cut_places(lengths: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a stream of documents of these lengths, and the cost of each.

    ``sentence_ends``: positions behind a sentence's last token. The stream's end is a place.
    """
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    inside = sentence_ends[(sentence_ends > 0) & (sentence_ends < total)]
    places = _union(ends, inside)
    gaps = np.diff(places, prepend=0)
    long = np.flatnonzero(gaps > window)
    step = min(STEP, window)
    steps = [np.arange(places[i] - gaps[i] + step, places[i], step) for i in long]
    steps = np.concatenate([*steps, np.empty(0, np.int64)]).astype(np.int64)
    places = _union(places, steps)
    cost = np.full(len(places), SENTENCE_COST, np.int64)
    cost[np.searchsorted(places, steps)] = STEP_COST
    cost[np.searchsorted(places, ends)] = 0
    return places, cost


class SentenceEnds:
    """Finds the ends of sentences in ids, also where a full stop's bytes are several tokens."""

    def __init__(self, words: list[bytes], end_id: int) -> None:
        self.words, self.none = words, max(len(words), end_id + 1)
        self.whole = np.zeros(max(len(words), end_id + 1), bool)
        self.whole[: len(words)] = [word.endswith(SENTENCE_ENDS) for word in words]
        parts = {sign[at:] for sign in SENTENCE_ENDS for at in range(1, len(sign))}
        self.part = np.zeros(len(self.whole), bool)
        self.part[: len(words)] = [word in parts for word in words]

    def behind(self, ids: np.ndarray) -> np.ndarray:
        """The positions behind the last token of each sentence."""
        found = self.whole[ids]
        parts = np.flatnonzero(self.part[ids] & ~found)
        if len(parts):
            # The last four ids hold the bytes of any full stop; each four of them is looked at once.
            four = np.concatenate([np.full(3, self.none), ids.astype(np.int64)])[parts[:, None] + np.arange(4)]
            kinds, kind = np.unique(four, axis=0, return_inverse=True)
            ends = [b"".join(self.words[i] for i in own if i < len(self.words)) for own in kinds.tolist()]
            found[parts] = np.array([end.endswith(SENTENCE_ENDS) for end in ends])[kind.ravel()]
        return np.flatnonzero(found) + 1


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.diff(both, prepend=-1) > 0]


def _powers(whole: np.ndarray, shortest: int, window: int) -> tuple[list[int], list[int]]:
    """The places that lie a power of two before each place: all in a row, and where each one's begin."""
    line = np.full(int(whole[-1]) + 1, -1, np.int32)
    line[whole] = np.arange(len(whole), dtype=np.int32)
    ends, starts = [], []
    power = shortest
    while power < window:
        first = int(np.searchsorted(whole, power))
        found = line[whole[first:] - power]
        hit = np.flatnonzero(found >= 0)
        ends.append(hit + first)
        starts.append(found[hit])
        power *= 2
    ends = np.concatenate([*ends, np.empty(0, np.int64)])
    starts = np.concatenate([*starts, np.empty(0, np.int32)])
    begins = np.cumsum(np.bincount(ends.astype(np.int64), minlength=len(whole)))
    return starts[np.argsort(ends, kind="stable")].tolist(), begins.tolist()


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW, shortest: int = SHORTEST) -> list[int]:
    """The window ends (the last place included) with the least padding plus cost.

    Windows of a power of two from ``shortest`` on need no padding. No gap between neighbouring places may exceed
    ``window``. A tie goes to the longer window.
    """
    whole = np.concatenate([[0], places])
    n = len(whole)
    exact, stops = _powers(whole, shortest, window)
    at = whole.tolist()
    least = [0] * n  # cost of the best cut of what lies before a place
    before = [0] * n
    key = [0] * n  # least + place: what decides between starts
    queue = [0] * n  # from head to tail
    head, tail = 0, 1
    begin = stops[0]
    for j, (end, extra, stop) in enumerate(zip(at[1:], cost.tolist(), stops[1:]), 1):
        reach = end - window
        while at[queue[head]] < reach:
            head += 1
        start = queue[head]
        value = key[start] - reach
        if begin != stop:
            for i in exact[begin:stop]:
                if least[i] < value:
                    value, start = least[i], i
            begin = stop
        value += extra
        least[j], before[j] = value, start
        key[j] = mine = value + end
        while tail > head and key[queue[tail - 1]] > mine:
            tail -= 1
        queue[tail] = j
        tail += 1
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(at[j])
        j = before[j]
    return cuts[::-1]


class _Stream:
    """Documents of one task that are not in a closed window yet."""

    def __init__(self, sentence_ends: SentenceEnds, window: int, first_sequence: int, shortest: int = 1) -> None:
        self.sentence_ends, self.window, self.sequence = sentence_ends, window, first_sequence
        self.shortest = shortest
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, tokens in all, start, ids
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), 0, ids))
        self.tokens += len(ids)

    def close(self, last: bool) -> pa.RecordBatch | None:
        """The pieces of all windows (but the last one, if more is to come)."""
        ids = np.concatenate([doc[3] for doc in self.docs])
        lengths = np.array([len(doc[3]) for doc in self.docs], np.int64)
        places, cost = cut_places(lengths, self.sentence_ends.behind(ids), self.window)
        cuts = np.array(best_cuts(places, cost, self.window, self.shortest), np.int64)
        if not last:
            cuts = cuts[:-1]
        if not len(cuts):
            return None
        closed = int(cuts[-1])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        stops = _union(cuts, ends[ends <= closed])
        begins = np.concatenate([[0], stops[:-1]])
        doc = np.searchsorted(ends, begins, side="right")
        window = np.searchsorted(cuts, begins, side="right")
        opened = np.concatenate([[0], cuts[:-1]])
        own_start = np.array([one[2] for one in self.docs], np.int64)
        in_all = np.array([one[1] for one in self.docs], np.int64)
        kept = ids[:closed].astype("<u4")
        batch = pa.record_batch(
            [
                pa.array([one[0] for one in self.docs], pa.int64()).take(pa.array(doc)),
                pa.array(begins - starts[doc] + own_start[doc]),
                pa.array(stops - begins),
                pa.Array.from_buffers(
                    pa.binary(),
                    len(stops),
                    [None, pa.py_buffer((np.concatenate([[0], stops]) * 4).astype("<i4")), pa.py_buffer(kept)],
                ),
                pa.array(in_all[doc]),
                pa.array(window + self.sequence),
                pa.array(begins - opened[window]),
                pa.array((cuts - opened)[window]),
            ],
            names=[field.split()[0] for field in PIECES.split(", ")],
        )
        self.sequence += len(cuts)
        first = int(np.searchsorted(ends, closed, side="right"))
        rest = self.docs[first:]
        if rest:
            doc_id, total, start, own = rest[0]
            done = closed - int(starts[first])
            rest[0] = (doc_id, total, start + done, own[done:])
        self.docs, self.tokens = rest, int(ends[-1]) - closed
        return batch


def _packer(tokenizer: str, end_id: int, window: int, shortest: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        sentence_ends = SentenceEnds(vocabulary(tokenizer), end_id)
        first = TaskContext.get().partitionId() << SEQUENCES_PER_TASK
        stream = _Stream(sentence_ends, window, first, shortest)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                stream.add(doc_id, np.append(ids, np.uint32(end_id)))
                if stream.tokens >= BLOCK and (closed := stream.close(last=False)) is not None:
                    yield closed
        if stream.docs:
            yield stream.close(last=True)

    return pack


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, shortest: int = 1) -> DataFrame:
    """The pieces of all ``docs`` (``doc_id``, ``text``) in sequences of at most ``window`` tokens.

    Every power of two from ``shortest`` on is tried as a sequence's length.

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit numbers; ``sequence_tokens``
    is the length of its sequence before padding.
    """
    return texts_of(docs).mapInArrow(_packer(tokenizer, end_id, window, shortest), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
