"""Token ids of texts by the tokenizers library, piece by piece through a bounded cache.

A byte-level BPE merges inside the pieces that its pattern cuts, never across them, so a text's ids
are those of its pieces in a row. Texts repeat their pieces: each worker keeps the ids of those
it has met and asks the library's model for new ones only.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex
from public_tokenizers import PATTERN

# White space as Unicode has it; \s of Python's modules takes in some control characters besides.
_PIECES = regex.compile(
    PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")
    .replace(r"\s", r"\p{White_Space}")
    .replace(r"\S", r"\P{White_Space}")
)
# The same pattern where all characters are ASCII; letters first, as they are the usual case.
_ASCII_PIECES = re.compile(
    r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

# And where all are Latin-1, whose letters, digits and spaces can be listed.
_LATIN_PIECES = re.compile(
    r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)

MOST_CACHED = 500_000  # pieces a worker remembers, each of LONGEST_CACHED characters at most
LONGEST_CACHED = 40


def pieces_of(text: str) -> list[str]:
    """What the pattern of the rank files cuts ``text`` into."""
    if text.isascii():
        return _ASCII_PIECES.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _PIECES.findall(text)
    return _LATIN_PIECES.findall(text)


class PieceMemory:
    """Ids of the pieces met so far, as bytes; ``learn`` gives those of new ones."""

    def __init__(self, learn, most: int = MOST_CACHED, longest: int = LONGEST_CACHED) -> None:
        self._learn, self._most, self._longest = learn, most, longest
        self._known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self._known
        cut = [pieces_of(text) for text in texts]
        found = [list(map(known.get, pieces)) for pieces in cut]
        gaps = [(at, [i for i, one in enumerate(ids) if one is None]) for at, ids in enumerate(found) if None in ids]
        if gaps:
            learned = self._learn(list({cut[at][i] for at, places in gaps for i in places}))
            for at, places in gaps:
                pieces, ids = cut[at], found[at]
                for i in places:
                    ids[i] = learned[pieces[i]]
            if len(known) + len(learned) > self._most:
                known.clear()
            known.update((piece, ids) for piece, ids in learned.items() if len(piece) <= self._longest)
        return [b"".join(ids) for ids in found]


class _Learned(dict):
    """Ids of pieces, as bytes; a piece that is not known yet is learned when it is asked for."""

    def __init__(self, learn) -> None:
        super().__init__()
        self._learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self._learn(piece)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of texts under a tokenizer file, as the library gives them with add_special_tokens=False.

    That adds no token, but reads the string of an added token in a text as that token: texts with
    such a string go to the library whole.
    """

    def __init__(self, path: str, most: int = MOST_CACHED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._added = [token.content for token in self._whole.get_added_tokens_decoder().values()]
        self._tokenize = self._whole.model.tokenize
        self._sign = {byte: sign for sign, byte in byte_alphabet().items()}
        self._merger = self._by_rank(path)
        self._known, self._most = _Learned(self._learn), most

    def _by_rank(self, path: str):
        """tiktoken's faster merging over the same vocabulary, where it gives the same ids, else None.

        It merges any two neighbours whose bytes together are a token, least id first. The model merges
        listed pairs, in their order. If ids grow in that order and the model makes each token's own bytes
        into that token, then whenever it is a token's turn, the model has its bytes as the listed pair or
        crossed by another token, so both merge the same.
        """
        import tiktoken

        state = json.loads(self._whole.to_str())["model"]
        if state["type"] != "BPE" or any(state.get(name) for name in ("dropout", "byte_fallback", "ignore_merges")):
            return None
        words, merges = state["vocab"], state["merges"]
        made = [words["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in merges]
        if made != sorted(set(made)):
            return None
        added = set(self._added)
        ranks = {bytes_of: at for at, bytes_of in enumerate(vocabulary(path)) if bytes_of}
        ranks = {bytes_of: at for bytes_of, at in ranks.items() if bytes_of.decode("latin-1") not in added}
        for bytes_of, at in ranks.items():
            signs = bytes_of.decode("latin-1").translate(self._sign)
            if [token.id for token in self._tokenize(signs)] != [at]:
                return None
        if not all(bytes([byte]) in ranks for byte in range(256)):
            return None
        return tiktoken.Encoding(path, pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _learn(self, piece: str) -> bytes:
        if self._merger is not None:
            return array("I", self._merger(piece)).tobytes()
        # A piece goes to the library's model itself: cutting it again would cost more than merging.
        if piece.isascii() and piece.isprintable():
            signs = piece.replace(" ", self._sign[32])
        else:
            signs = piece.encode().decode("latin-1").translate(self._sign)
        return array("I", [token.id for token in self._tokenize(signs)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        known, out = self._known.__getitem__, []
        for text in texts:
            if any(one in text for one in self._added):
                ids = array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                ids = b"".join(map(known, pieces_of(text)))
            out.append(np.frombuffer(ids, "<u4"))
            if len(self._known) > self._most:
                self._forget()
        return out

    def _forget(self) -> None:
        # Pieces of one id are words of the vocabulary: the usual ones, and bounded in number.
        usual = {piece: ids for piece, ids in self._known.items() if len(ids) == 4}
        self._known.clear()
        self._known.update(usual if 2 * len(usual) < self._most else {})


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a tokenizer file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file (empty for ids without bytes)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    alphabet = byte_alphabet()
    out = []
    for at in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(at) or ""
        out.append(bytes(alphabet[sign] for sign in token) if all(sign in alphabet for sign in token) else b"")
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: the byte's own
    character where that is printable Latin-1, else the next one from 256 on."""
    out, next_sign = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            out[chr(byte)] = byte
        else:
            out[chr(next_sign)] = byte
            next_sign += 1
    return out
