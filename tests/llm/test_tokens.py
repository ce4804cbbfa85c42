import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from odd import TEXTS, frame, odd_documents
from tokenizers import Tokenizer

from lakemoor.llm import bpe, frames, packing
from lakemoor.llm.tokens import _PIECES, PieceEncoder, pieces_of, vocabulary
from lakemoor.session import scratch_path

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def some_texts():
    rnd = random.Random(5)
    signs = ["<|endoftext|>", "<|end", "a", "the", " ", "  ", "\n", "'s", "'LL", "é", "日", "🙂", "\x85", " ", "\x1c", "½", "9", "!", "_", "　"]
    return [text or "" for _, text in TEXTS] + ["".join(rnd.choices(signs, k=rnd.randrange(40))) for _ in range(400)]


def test_pieces_and_ids(library):
    encoder = PieceEncoder(JSON)
    texts = some_texts()
    for text in texts:
        assert pieces_of(text) == _PIECES.findall(text)
    encoder._most = 50  # forgets again and again
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.encode(texts)] == [library(text) for text in texts]
    assert b"".join(vocabulary(JSON)[i] for i in library("naïve 日本 text")) == "naïve 日本 text".encode()


def test_both_ways_to_merge(library):
    """The faster merging and the library's model."""
    fast, slow = PieceEncoder(JSON), PieceEncoder(JSON)
    assert fast._merger is not None
    slow._merger = None
    rnd = random.Random(15)
    texts = ["".join(rnd.choices("etaoin shrdluETAOIN'.,0é日\n", k=rnd.randrange(80))) for _ in range(2000)]
    texts += ["".join(chr(rnd.randrange(32, 0x3000)) for _ in range(30)) for _ in range(300)] + ["a" * 999, "ab" * 500]
    want = [ids.tolist() for ids in slow.encode(texts)]
    assert [ids.tolist() for ids in fast.encode(texts)] == want == [library(text) for text in texts]


def test_recursive_queries():
    coder = bpe.RankCoder(RANKS)
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    texts = some_texts()
    texts += ["a" * 700, "ab" * 400, "!" * 500 + "'s", "é" * 300, "".join(rnd.choices("etaoinshr", k=600))]
    texts += ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(60))) for _ in range(300)]
    got = coder.encode(texts)
    assert got == [np.array(own.encode_ordinary(text), "<u4").tobytes() for text in texts]
    assert coder.decode(got) == [text.encode() for text in texts]
    with pytest.raises(ValueError, match="vocabulary"):
        coder.decode([np.array([60_000], "<u4").tobytes()])


def test_long_pieces_are_joined_from_parts():
    coder = bpe.RankCoder(RANKS)
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    rnd = random.Random(16)
    texts = ["".join(rnd.choices(some, k=k)) for some in ("abcdefghijklmnopqrstuvwxyz", "ab", "éüñßab") for k in (257, 20_000)]
    texts += ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "".join(rnd.choices("abcdef", k=30)) * 300]
    texts += ["a" * 5000, "abc" * 3000, "=-" * 3000, "-" * 5001, "日" * 5000, "abcab" * 700 + texts[0] + "xyzzy" * 800]
    got = coder.encode(texts)
    assert got == [np.array(own.encode_ordinary(text), "<u4").tobytes() for text in texts]
    assert coder.decode(got) == [text.encode() for text in texts]


@pytest.mark.parametrize("window", [1, 2])
def test_windows_at_seams_grow(monkeypatch, window):
    """Narrow windows and short parts: most seams need more than the first window."""
    monkeypatch.setattr(bpe, "WINDOW", window)
    monkeypatch.setattr(bpe, "PART", 5)
    monkeypatch.setattr(bpe, "LONG", 20)
    monkeypatch.setattr(bpe, "PART_ROWS", 50)
    monkeypatch.setattr(bpe, "DECODED_ROWS", 7)
    coder = bpe.RankCoder(RANKS)
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(17)
    some = "etaoin shrdlu=-.é日"
    texts = ["".join(rnd.choices(some[:width], k=rnd.randrange(200))) for width in (2, 5, 9, 19) for _ in range(20)]
    texts += ["-" * 77, "internationalizations" * 3, ""]
    got = coder.encode(texts)
    assert got == [np.array(own.encode_ordinary(text), "<u4").tobytes() for text in texts]
    assert coder.decode(got) == [text.encode() for text in texts]


def test_bpe_rows(spark):
    docs = odd_documents(spark, "ids", "bytes")
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    want = sorted(((i or 0, (text or "").encode()) for i, text in TEXTS), key=repr)
    assert sorted(((r.doc_id or 0, bytes(r["bytes"])) for r in rows), key=repr) == want
    assert bpe.encode(docs.limit(0), RANKS).collect() == []


def check_pieces(rows, want, window):
    """Gapless sequences, and each id of each document in exactly one piece."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and {r.sequence_tokens for r in own} == {at}
    got = sorted(b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start)) for own in docs.values())
    assert got == sorted(np.array(ids, "<u4").tobytes() for ids in want)
    for own in docs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length == len(bytes(r.ids)) // 4 > 0
            at += r.length
        assert at == own[0].doc_tokens
    return sequences


def test_packing_rows(spark, library):
    single = [(i, text) for i, text in dict((i, text) for i, text in TEXTS if i is not None).items()]
    docs = frame(spark, single).coalesce(1)
    rows = packing.pack(docs, JSON, window=64).collect()
    check_pieces(rows, [library(text or "") + [1] for _, text in single], 64)
    every = odd_documents(spark, "ids", "start", "length")
    assert packing.pack(every, JSON).groupBy().sum("length").first()[0] == sum(
        len(library(text or "")) + 1 for _, text in TEXTS
    )
    assert packing.pack(every.limit(0), JSON).collect() == []


def test_best_cuts_with_powers_of_two():
    """Windows of a power of two, 1 included, need no padding."""
    rnd, window = random.Random(9), 16
    for _ in range(300):
        lengths = np.array([rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 9))])
        ends = np.array(sorted(rnd.sample(range(1, 40), rnd.randrange(1, 9))))
        places, cost = packing.cut_places(lengths, ends, window)
        for shortest in (1, 2, 8):

            def padding(n):
                return 0 if n >= shortest and n & (n - 1) == 0 else window - n

            at, extra = [0, *places.tolist()], [0, *cost.tolist()]
            least = [0] + [10**9] * len(places)
            for j in range(1, len(at)):
                options = [least[i] + padding(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= window]
                least[j] = min(options) + extra[j]
            cuts = packing.best_cuts(places, cost, window, shortest)
            spent = sum(padding(b - a) for a, b in zip([0, *cuts], cuts))
            spent += sum(extra[at.index(cut)] for cut in cuts)
            assert cuts[-1] == at[-1] and spent == least[-1]


def test_sentence_ends_of_several_tokens():
    """Against the bytes of the last four ids, one position after the other."""
    words = vocabulary(JSON)
    ends = packing.SentenceEnds(words, 1)
    ids = PieceEncoder(JSON).encode(["One. Two! 日本語。 और। ok… ۔x។ y\n z？ end"])[0]
    found = [at + 1 for at in range(len(ids)) if b"".join(words[i] for i in ids[max(at - 3, 0) : at + 1]).endswith(packing.SENTENCE_ENDS)]
    assert ends.behind(ids).tolist() == found and len(found) >= 8
    assert ends.behind(ids[:0]).tolist() == []


def test_best_cuts_against_every_cut():
    rnd = random.Random(8)
    packing_window = 16
    for _ in range(200):
        lengths = np.array([rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 9))])
        ends = np.array(sorted(rnd.sample(range(1, 40), 5)))
        places, cost = packing.cut_places(lengths, ends, packing_window)
        at, extra = [0, *places.tolist()], [0, *cost.tolist()]
        least = [0] + [10**9] * len(places)
        for j in range(1, len(at)):
            for i in range(j):
                length = at[j] - at[i]
                if length <= packing_window:
                    least[j] = min(least[j], least[i] + packing_window - length + extra[j])
        cuts = packing.best_cuts(places, cost, packing_window)
        spans = np.diff([0, *cuts])
        price = dict(zip(places.tolist(), cost.tolist()))
        assert spans.max() <= packing_window and cuts[-1] == at[-1]
        assert sum(packing_window - n for n in spans) + sum(price[c] for c in cuts) == least[-1]


def test_every_sentence_end_is_a_place_to_cut(library):
    places, _ = packing.cut_places(np.array([30]), np.array([2, 3, 5, 8, 13, 14, 21]), 2048)
    assert places.tolist() == [2, 3, 5, 8, 13, 14, 21, 30]
    words = vocabulary(JSON)
    ends = packing.SentenceEnds(words, 1)
    for sign in "。！？।؟۔.!?":
        text = f"日本 ab{sign}日本 cd"
        ids = np.array(library(text))
        behind = {len(b"".join(words[i] for i in ids[:at])) for at in ends.behind(ids).tolist()}
        assert behind == {len(f"日本 ab{sign}".encode())} or any(
            sign.encode() in words[i] and not words[i].endswith(sign.encode()) for i in ids
        )
    assert ends.behind(np.array([1, 1])).tolist() == []


def test_short_windows_of_a_power_of_two_cost_nothing():
    places, cost = np.array([256, 2304]), np.array([0, 0])
    assert packing.best_cuts(places, cost, 2048) == [256, 2304]


def test_shards_round_trip(spark, library, monkeypatch):
    docs = odd_documents(spark, "read_at", "shard", "frame").repartition(3)
    folder = scratch_path(spark, "shards")
    manifest = frames.write_shards(docs, folder, JSON)
    rows = sorted(frames.read_shards(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at and len(bytes(r.ids)) == 4 * r.n_tokens
        at += r.n_tokens
    want = sorted(zlib.crc32(np.array(library(text or "") + [0], "<u4").tobytes()) for _, text in TEXTS)
    assert sorted(zlib.crc32(bytes(r.ids)) for r in rows) == want
    some = frames.read_shards(manifest, first=4, last=6).collect()
    assert sorted(r.doc_id for r in some) == [4, 5, 6]
    assert {(r.doc_id, r.start) for r in some} <= {(r.doc_id, r.start) for r in rows}
    empty = scratch_path(spark, "shards")
    assert frames.read_shards(frames.write_shards(docs.limit(0), empty, JSON)).collect() == []


def test_broken_frames_are_noticed(tmp_path):
    import zstandard

    plain = frames.frame_bytes([7, None], [np.array([1, 2], "<u4"), np.array([3], "<u4")])
    assert frames.frame_content(plain)[0] == [7, None]
    packed = zstandard.ZstdCompressor().compress(plain)
    path = tmp_path / "one.idz"
    path.write_bytes(packed + frames.seek_table([(len(packed), len(plain), frames.checksum(plain))]))
    with open(path, "rb") as file:
        (place,) = frames.read_seek_table(file, path.stat().st_size)
        assert frames.read_frame(file, *place) == plain
        with pytest.raises(ValueError, match="checksum"):
            frames.read_frame(file, *place[:3], place[3] ^ 1)
    assert zstandard.ZstdDecompressor().decompressobj().decompress(path.read_bytes()[: len(packed)]) == plain
