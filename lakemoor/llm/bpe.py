"""Byte-level BPE encoding and decoding by DuckDB queries inside the tasks of a partition.

A rank file gives tokens in the order of their ranks. Two neighbouring tokens merge if their bytes
together are a token; a piece of text is encoded by merging, again and again, the leftmost pair
of least rank until no pair is left. As rows: one per token and position, joined to the table of
merges, recursively until a piece has none. Ids are decoded by joining them to their bytes and
aggregating these in the order of the positions.

A task encodes each distinct piece that it meets once (a bounded memory of them goes on between
batches), in queries of a bounded number of rows. A piece that is itself a token is not merged, as
in the tiktoken library. Long pieces take a second query: where no merge of a rank can make a pair
of lower rank, the leftmost pair of that rank stays the next one until there is none, so all of
them are merged at once, which keeps the number of steps below the number of ranks.

No rows are shuffled. Defined results: a null text is an empty one: no ids, no bytes; repeated rows
each get their result; an empty table gives no rows; other columns are not read. Characters that
UTF-8 cannot hold do not occur in Spark's strings.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import each_batch, query, table, texts_of
from lakemoor.llm.tokens import PieceMemory

LONG = 256  # bytes from which a piece is encoded in parts, and a window takes the query for long ones
PART = 64  # bytes of a part
WINDOW = 8  # ids on each side of a seam that are encoded again at first
PART_ROWS = 20_000  # token rows of parts or windows given to one query
ROWS = 100_000  # token rows given to one query that encodes (a single piece may have more)
DECODED_ROWS = 300_000  # and to one that decodes
MEMORY = "300MB"

# A step keeps the pieces that have a pair to merge; a piece's last step is its fixpoint. ``place`` is
# piece and position in one number.
ENCODE = """
WITH RECURSIVE state(step, w, place, id) AS (
  SELECT 0::SMALLINT, w, (w::BIGINT << 32) + pos, id FROM start
  UNION ALL
  SELECT step, w, place - (place > spot)::INT, CASE WHEN place = spot THEN least ELSE id END
  FROM (
    WITH pairs AS MATERIALIZED (
      SELECT a.step + 1::SMALLINT AS step, a.w, a.place, a.id, m.merged
      FROM state a
      LEFT JOIN state b ON b.place = a.place + 1
      LEFT JOIN merges m ON m.pair = (a.id::BIGINT << 32) + b.id
    ),
    first AS (
      SELECT w, (best >> 32)::INT AS least, (w::BIGINT << 32) + (best & 4294967295) AS spot
      FROM (
        SELECT w, min((merged::BIGINT << 32) + (place & 4294967295)) AS best
        FROM pairs WHERE merged IS NOT NULL GROUP BY w
      )
    )
    SELECT step, w, place, id, least, spot FROM pairs JOIN first USING (w) WHERE place <> spot + 1
  )
)
SELECT w, list(id ORDER BY place) AS ids
FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step)
GROUP BY w ORDER BY w
"""

# The same with all pairs of a safe rank at once: in a run of overlapping pairs every other one.
# Rows are kept by (w, pos); those from a piece's present length on are left over from earlier steps.
ENCODE_LONG = """
WITH RECURSIVE state(w, pos, id, size) USING KEY (w, pos) AS (
  SELECT w, pos, id, size FROM start
  UNION
  SELECT w, pos, id, size FROM (
    WITH pairs AS MATERIALIZED (
      SELECT a.w, a.pos, a.id, m.merged
      FROM state a
      LEFT JOIN state b ON b.w = a.w AND b.pos = a.pos + 1
      LEFT JOIN merges m ON m.pair = (a.id::BIGINT << 32) + b.id
    ),
    least AS (SELECT w, min(merged) AS merged FROM pairs GROUP BY w HAVING min(merged) IS NOT NULL),
    hits AS (
      SELECT w, pos, merged, row_number() OVER (PARTITION BY w ORDER BY pos) AS n
      FROM pairs JOIN least USING (w, merged)
    ),
    runs AS (SELECT *, row_number() OVER (PARTITION BY w, pos - n ORDER BY pos) AS i FROM hits),
    chosen AS (
      SELECT w, pos, merged FROM runs
      WHERE i % 2 = 1 AND (n = 1 OR merged NOT IN (SELECT merged FROM unsafe))
    )
    SELECT p.w, (row_number() OVER (PARTITION BY p.w ORDER BY p.pos) - 1)::INT AS pos,
           coalesce(c.merged, p.id) AS id, (count(*) OVER (PARTITION BY p.w))::INT AS size
    FROM pairs p
    JOIN least ON least.w = p.w
    LEFT JOIN chosen c ON c.w = p.w AND c.pos = p.pos
    LEFT JOIN chosen d ON d.w = p.w AND d.pos = p.pos - 1
    WHERE d.pos IS NULL
  )
)
SELECT w, list(id ORDER BY pos) AS ids
FROM state JOIN (SELECT w, size AS now FROM state WHERE pos = 0) USING (w)
WHERE pos < now
GROUP BY w ORDER BY w
"""

DECODE = """
SELECT w, list(bytes ORDER BY pos) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankCoder:
    """Encodes and decodes by a rank file, in a DuckDB database of this process alone."""

    def __init__(self, path: str) -> None:
        ranks = self.ranks = read_ranks(path)
        self._bytes_of = {rank: token for token, rank in ranks.items()}
        merges = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        # A token that is a part of one of lower rank: making it may make a pair of lower rank.
        unsafe = sorted({part for left, right, merged in merges for part in (left, right) if part > merged})
        self._con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        left, right, merged = (np.array(column, "i8") for column in zip(*merges))
        self._keep("merges", pair=(left << 32) + right, merged=merged.astype("i4"))
        self._keep("unsafe", merged=np.array(unsafe, "i4"))
        self._keep("vocabulary", id=np.array(list(ranks.values()), "i4"), bytes=pa.array(list(ranks), pa.binary()))
        self._byte = np.array([ranks[bytes([byte])] for byte in range(256)], "i4")
        self._memory = PieceMemory(self._learn)

    def _keep(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self._con.register("given", given)
        self._con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self._con.unregister("given")

    def _ask(self, sql: str, name: str, given: pa.Table) -> pa.ListArray:
        self._con.register(name, given)
        found = self._con.sql(sql).to_arrow_table().column(1).combine_chunks()
        self._con.unregister(name)
        return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found

    def _merge(self, pieces: list[bytes], sql: str) -> list[bytes]:
        lengths = np.array([len(piece) for piece in pieces])
        ends = np.cumsum(lengths)
        start = pa.table(
            {
                "w": np.repeat(np.arange(len(pieces), dtype="i4"), lengths),
                "pos": (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype("i4"),
                "id": self._byte[np.frombuffer(b"".join(pieces), "u1")],
                "size": np.repeat(lengths, lengths).astype("i4"),
            }
        )
        found = self._ask(sql, "start", start)
        offsets = (found.offsets.to_numpy() - found.offsets[0].as_py()) * 4
        ids = found.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def _merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of parts or windows, in queries of at most ``PART_ROWS`` rows, or of one larger window."""
        out: list[np.ndarray | None] = [None] * len(pieces)

        def flush(group: list[int], sql: str) -> None:
            for at, ids in zip(group, self._merge([pieces[at] for at in group], sql)):
                out[at] = np.frombuffer(ids, "<u4")

        for sql, long in ((ENCODE, False), (ENCODE_LONG, True)):
            group, rows = [], 0
            for at, piece in enumerate(pieces):
                if (len(piece) > LONG) != long:
                    continue
                if group and rows + len(piece) > PART_ROWS:
                    flush(group, sql)
                    group, rows = [], 0
                group.append(at)
                rows += len(piece)
            if group:
                flush(group, sql)
        return out

    def _join(self, seams: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of two neighbouring parts as one, for each of ``seams``."""
        out: list[np.ndarray | None] = [None] * len(seams)
        open_, wide = list(range(len(seams))), WINDOW
        while open_:
            windows = [np.concatenate([seams[at][0][-wide:], seams[at][1][:wide]]) for at in open_]
            merged = self._merge_all([b"".join(map(self._bytes_of.__getitem__, own.tolist())) for own in windows])
            failed = []
            for at, own, new in zip(open_, windows, merged):
                left, right = seams[at]
                if (len(left) > wide and new[0] != own[0]) or (len(right) > wide and new[-1] != own[-1]):
                    failed.append(at)
                else:
                    out[at] = np.concatenate([left[:-wide], new, right[wide:]])
            open_, wide = failed, 2 * wide
        return out

    def _merge_long(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of long pieces, as bytes (see the text at the top)."""
        parts = [[piece[at : at + PART] for at in range(0, len(piece), PART)] for piece in pieces]
        flat = iter(self._merge_all([one for own in parts for one in own]))
        ids = [[next(flat) for _ in own] for own in parts]
        while any(len(own) > 1 for own in ids):
            joined = iter(self._join([pair for own in ids for pair in zip(own[::2], own[1::2])]))
            ids = [[next(joined) for _ in range(len(own) // 2)] + own[len(own) // 2 * 2 :] for own in ids]
        return [own[0].tobytes() for own in ids]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, as bytes."""
        out: dict[str, bytes] = {}
        short: list[tuple[str, bytes]] = []
        long: list[tuple[str, bytes]] = []
        rows = 0

        def flush() -> None:
            nonlocal rows
            if short:
                out.update(zip([one[0] for one in short], self._merge([one[1] for one in short], ENCODE)))
            short.clear()
            rows = 0

        for piece in pieces:
            raw = piece.encode()
            if raw in self.ranks:
                out[piece] = np.array([self.ranks[raw]], "<u4").tobytes()
            elif len(raw) > LONG:
                long.append((piece, raw))
            else:
                short.append((piece, raw))
                rows += len(raw)
                if rows >= ROWS:
                    flush()
        flush()
        out.update(zip([one[0] for one in long], self._merge_long([one[1] for one in long])))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        return self._memory.encode(texts)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for."""
        slices = [
            (row, one[at : at + DECODED_ROWS])
            for row, one in enumerate(np.frombuffer(own, "<u4") for own in ids)
            for at in range(0, len(one), DECODED_ROWS)
        ]
        out: list[list[bytes]] = [[] for _ in ids]
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            lengths = np.array([len(one) for _, one in group])
            tokens = pa.table(
                {
                    "w": np.repeat(np.arange(len(group), dtype="i4"), lengths),
                    "pos": np.arange(lengths.sum(), dtype="i4"),
                    "id": np.concatenate([one for _, one in group]).astype("i4"),
                }
            )
            found = self._ask(DECODE, "tokens", tokens)
            tokens_of = found.flatten()
            if len(tokens_of) != lengths.sum():
                raise ValueError("an id is not in the vocabulary")
            joined = pc.binary_join(found, pa.scalar(b"", tokens_of.type))
            for (row, _), text in zip(group, joined.to_pylist()):
                out[row].append(text)
            group.clear()
            held = 0

        for one in slices:
            if group and held + len(one[1]) > DECODED_ROWS:
                flush()
            group.append(one)
            held += len(one[1])
        if group:
            flush()
        return [b"".join(own) for own in out]


_CODERS: dict[str, RankCoder] = {}


def coder(path: str) -> RankCoder:
    """This worker's coder for a rank file, loaded once."""
    if path not in _CODERS:
        _CODERS[path] = RankCoder(path)
    return _CODERS[path]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit numbers) of every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = coder(ranks).encode(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(each_batch(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (``doc_id``, ``ids``) with the ``bytes`` that the ids stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = coder(ranks).decode(batch.column("ids").to_pylist())
        return pa.record_batch([*batch.columns, pa.array(found, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(each_batch(run), "doc_id long, ids binary, bytes binary")


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = decode(encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) DIV 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
