"""Token ids in binary shards of independent Zstandard frames.

A shard is a row of frames, each compressed alone, and a trailing seek table in a skippable frame:
per frame its compressed and plain size and a checksum of the plain bytes, then the number of
frames, so a reader finds and decompresses only the frames it needs (the seekable format that
Zstandard's contributors publish). A frame holds whole documents: their number, ids, null flags
and lengths, then the token ids as little-endian unsigned 32-bit numbers. A manifest (Parquet) has
one row per frame with the range of its doc_ids.

Documents are dealt out by ranges of doc_id, ties by where they were read, so copies of one doc_id
may spread over shards. A task writes a file under a name of its own and the manifest names the
files of the tasks that counted: what a lost or repeated task leaves behind is never read.

Defined results: a null text is an empty one and has the end id alone; null doc_ids come first;
repeated doc_ids are all kept; an empty table gives no shards and no rows; other columns are not
read. A frame whose bytes do not match its checksum raises ``ValueError``.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemoor.llm.common import query, table, texts_of
from lakemoor.llm.tokens import encoder
from lakemoor.session import scratch_path

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

SHARD_BYTES = 1 << 28  # of text behind one file
FRAME_TOKENS = 1 << 18  # a frame is closed once it holds as many
LEVEL = 3

MANIFEST = (
    "shard int, file string, frame int, at long, size long, plain_size long, checksum long, "
    "first_doc long, last_doc long, n_docs long, n_tokens long, tokens_before long"
)
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def frame_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The plain content of a frame."""
    return b"".join(
        [
            struct.pack("<I", len(doc_ids)),
            np.array([one or 0 for one in doc_ids], "<i8").tobytes(),
            np.array([one is None for one in doc_ids], "u1").tobytes(),
            np.array([len(one) for one in ids], "<u4").tobytes(),
            *[one.astype("<u4", copy=False).tobytes() for one in ids],
        ]
    )


def frame_content(plain: bytes) -> tuple[list[int | None], np.ndarray, bytes]:
    """doc_ids, lengths and the ids' bytes of a frame."""
    (n,) = struct.unpack_from("<I", plain)
    doc_ids = np.frombuffer(plain, "<i8", n, 4)
    null = np.frombuffer(plain, "u1", n, 4 + 8 * n)
    lengths = np.frombuffer(plain, "<u4", n, 4 + 9 * n).astype(np.int64)
    return [None if gone else one for one, gone in zip(doc_ids.tolist(), null)], lengths, plain[4 + 13 * n :]


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """``entries``: compressed size, plain size and checksum of each frame."""
    body = b"".join(struct.pack("<III", *entry) for entry in entries)
    body += struct.pack("<IBI", len(entries), WITH_CHECKSUMS, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int, int]]:
    """Place, compressed size, plain size and checksum of each frame of an open shard."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC or not flags & WITH_CHECKSUMS:
        raise ValueError("no seek table with checksums at the end of the shard")
    file.seek(size - 9 - 12 * n)
    entries = struct.iter_unpack("<III", file.read(12 * n))
    out, at = [], 0
    for compressed, plain, check in entries:
        out.append((at, compressed, plain, check))
        at += compressed
    return out


def read_frame(file, at: int, size: int, plain_size: int, check: int) -> bytes:
    """The checked content of one frame; nothing else of the shard is read."""
    file.seek(at)
    plain = zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=plain_size)
    if len(plain) != plain_size or checksum(plain) != check:
        raise ValueError(f"a frame at {at} does not match its checksum")
    return plain


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _writer(tokenizer: str, end_id: int, folder: str):
    names = [field.split()[0] for field in MANIFEST.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.idz"
        rows: list[tuple] = []
        entries: list[tuple[int, int, int]] = []
        at = tokens_before = held = 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sink = None

        def close() -> None:
            nonlocal at, tokens_before, held, doc_ids, ids
            plain = frame_bytes(doc_ids, ids)
            packed = compressor.compress(plain)
            sink.write(packed)
            entries.append((len(packed), len(plain), checksum(plain)))
            there = [one for one in doc_ids if one is not None]
            ends = (there[0], there[-1]) if there else (None, None)
            place = (shard, uri, len(rows), at, len(packed), len(plain), entries[-1][2])
            rows.append((*place, *ends, len(doc_ids), held, tokens_before))
            at, tokens_before, held, doc_ids, ids = at + len(packed), tokens_before + held, 0, [], []

        for batch in batches:
            if sink is None and batch.num_rows:
                fs, path = _open(uri)
                sink = fs.open_output_stream(path)
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                doc_ids.append(doc_id)
                ids.append(np.append(own, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= FRAME_TOKENS:
                    close()
        if sink is not None:
            if doc_ids:
                close()
            sink.write(seek_table(entries))
            sink.close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema=_ARROW_MANIFEST)

    return write


_ARROW_MANIFEST = pa.schema(
    [
        (name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind])
        for name, kind in (field.split() for field in MANIFEST.split(", "))
    ]
)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` (``doc_id``, ``text``) in ascending doc_id order; the manifest's frame.

    ``folder`` must be one that all executors reach; the manifest lies in ``folder``/manifest.
    """
    spark = docs.sparkSession
    docs = texts_of(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = (
        docs
        .withColumn("read_at", F.monotonically_increasing_id())
        .repartitionByRange(partitions, "doc_id", "read_at")
        .sortWithinPartitions("doc_id", "read_at")
        .select("doc_id", "text")
    )
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    ordered.mapInArrow(_writer(tokenizer, end_id, folder), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, frames, start of each) to documents."""
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = _open(row["file"])
            with fs.open_input_file(path) as file:
                places = read_seek_table(file, file.size())
                for frame, start in zip(row["frames"], row["starts"]):
                    doc_ids, lengths, ids = frame_content(read_frame(file, *places[frame]))
                    stops = np.cumsum(lengths)
                    offsets = np.concatenate([[0], stops * 4]).astype("<i4")
                    own = pa.Array.from_buffers(
                        pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]
                    )
                    yield pa.record_batch(
                        [pa.array(doc_ids, pa.int64()), pa.array(start + stops - lengths), pa.array(lengths), own],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )


def read_shards(manifest: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Every document of the shards, or those with doc_ids from ``first`` to ``last`` (both included).

    Only the frames that may hold such documents are read. ``start`` counts the ids of all
    documents before, in the order of the shards.
    """
    # One row per shard: the running total of so few rows may pass through one task.
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    asked = manifest
    if first is not None:
        asked = asked.filter(F.col("last_doc") >= first)
    if last is not None:
        asked = asked.filter(F.col("first_doc") <= last)
    frame = F.struct("frame", "tokens_before")
    files = asked.groupBy("shard", "file").agg(F.array_sort(F.collect_list(frame)).alias("asked"))
    files = files.join(shards, "shard").select(
        "file",
        F.col("asked.frame").alias("frames"),
        F.expr("transform(asked, one -> one.tokens_before + base)").alias("starts"),
    )
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    found = files.mapInArrow(_reader, DOCUMENTS)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    if last is not None:
        found = found.filter(F.col("doc_id") <= last)
    return found


@query()
def op7_seekable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    manifest = write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
