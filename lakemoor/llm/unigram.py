"""Token counts of texts under a unigram vocabulary, without making the tokens.

A tokenizer file's pieces and scores are the vocabulary. An Aho-Corasick automaton finds all
pieces in a stretch of text in one pass; dynamic programming over the ends of matches carries the
best score and its number of pieces, nothing else. The rules are those of the SentencePiece
library's unigram lattice: text is normalised as the file says; a character that is no piece alone
may stand as unknown, at the least score of all less 10, and counts as its bytes; of equal scores
the one whose last piece is longer stays. (What the library's faster ``encode`` returns is not
always the best segmentation of its own lattice; the counts here are those of the best one.)

White space begins words: no piece holds a space mark behind another character (the file is checked
for that), so the best segmentation of a text is that of its words in a row, and a worker counts
each word once (a bounded memory of them goes on between batches). Scores are added exactly, word
by word. No rows are shuffled.

Defined results: a null text is an empty one and has 0 tokens; repeated rows each get their count;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakemoor.llm.common import each_batch, query, table, texts_of

MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0  # fixed value of the library
MOST_CACHED = 500_000  # words a worker remembers, each of LONGEST_CACHED characters at most
LONGEST_CACHED = 40
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class UnigramCounter:
    """Counts tokens under the pieces and scores of a SentencePiece file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._file = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self._file.get_piece_size()
        plain = [
            at
            for at in range(size)
            if not (
                self._file.is_control(at)
                or self._file.is_unknown(at)
                or self._file.is_unused(at)
                or self._file.is_byte(at)
            )
        ]
        pieces = {self._file.id_to_piece(at): self._file.get_score(at) for at in plain}
        self._has_bytes = any(self._file.is_byte(at) for at in range(size))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece holds a space behind another character")
        self._unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self._single = {piece for piece in pieces if len(piece) == 1}
        self._found = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self._found.add_word(piece, (len(piece), score))
        self._found.make_automaton()
        self._known: dict[str, tuple[int, float]] = {}

    def _word(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation."""
        n = len(word)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self._found.iter(word):
            matches[end].append(match)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        for end in range(n):
            top, tokens = None, 0
            # The earliest start first: a later one must be better to count.
            for length, score in sorted(matches[end], reverse=True):
                start = end + 1 - length
                value = best[start] + score
                if top is None or value > top:
                    top, tokens = value, count[start] + 1
            if word[end] not in self._single:
                value = best[end] + self._unknown
                if top is None or value > top:
                    top, tokens = value, count[end] + (len(word[end].encode()) if self._has_bytes else 1)
            best[end + 1], count[end + 1] = top, tokens
        return count[n], best[n]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of whole texts."""
        known = self._known
        counts, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for at, text in enumerate(texts):
            words = _WORDS.findall(self._file.normalize(text)) if text else []
            found = list(map(known.get, words))
            if None in found:
                if len(known) > MOST_CACHED:
                    known.clear()
                for i, one in enumerate(found):
                    if one is None:
                        word = words[i]
                        found[i] = one = known.get(word) or self._word(word)
                        if len(word) <= LONGEST_CACHED:
                            known[word] = one
            counts[at] = sum(one[0] for one in found)
            scores[at] = sum(one[1] for one in found)
        return counts, scores


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """This worker's counter for a file, loaded once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``score`` (the best segmentation's) of every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, scores = counter(path).count(batch.column("text").to_pylist())
        names = ["doc_id", "n_tokens", "score"]
        return pa.record_batch([batch.column("doc_id"), pa.array(counts), pa.array(scores)], names=names)

    return texts_of(docs).mapInArrow(each_batch(run), "doc_id long, n_tokens long, score double")


@query()
def op4_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
