"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the lowest chunk of every id;
a bitmap tells which ids go on, and level 1 holds the next chunk of only those, and so on. A rank
directory counts the set bits before every block of the bitmap, so the place of an id's next chunk is
one directory entry and a count within one block: any token is read without decoding others.

File (all numbers little-endian): ``LDAC1\\0``, u16 number of levels, u64 ids, u64 documents; the
documents' ids (i64, and a byte each that is 1 for a null id); u64 first id of each document and their
total; then per level u64 count, the chunks (u8), and but for the last level the bitmap (bytes, lowest
bit first) and the directory (u32 set bits before each block of 512).

The corpus is written in ascending ``doc_id`` order: documents are tokenized where they are read, the
ids are shuffled to shards of neighbouring ``doc_id`` (bounds from approximate quantiles of the column,
a scan of that column only), and each shard becomes one file, or more if it is large. Files go to a
folder that the executors share, each under a temporary name first, so a rerun task replaces its own.

Defined results: null text is an empty document; rows that repeat a ``doc_id`` follow each other in the
order of their ids' bytes; null ``doc_id`` comes first; a very long text is one document of one file; an empty table gives no file and no rows; other columns
are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.tokenization import read_definition, worker_encoder
from lectern.llm.workers import map_arrow, own
from lectern.session import work_dir

MAGIC = b"LDAC1\0"
BLOCK_BITS = 512
#: Bounds sent to every task; with more documents a shard becomes several files.
MAX_SHARDS = 10_000
_MANIFEST = "shard int, part int, path string, n_docs long, n_ids long, n_bytes long"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Codes:
    """A sequence of unsigned ids with random access."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]], count: int):
        self.levels, self.count = levels, count

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest, levels = ids.astype(np.uint32), []
        while True:
            chunk, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
            if not more.any():
                levels.append((chunk, None, None))
                return cls(levels, len(ids))
            padded = np.zeros(-(-len(more) // BLOCK_BITS) * BLOCK_BITS, dtype=bool)
            padded[: len(more)] = more
            ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK_BITS).sum(axis=1))[:-1]]).astype(np.uint32)
            levels.append((chunk, np.packbits(more, bitorder="little"), ranks))
            rest = rest[more] >> 8

    def get(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK_BITS * (BLOCK_BITS // 8)
            here = np.unpackbits(bits[first : (i >> 3) + 1], bitorder="little")[: i - first * 8].sum()
            i = int(ranks[i // BLOCK_BITS]) + int(here)
        return value

    def all(self) -> np.ndarray:
        """Every id, decoded level by level."""
        rest = np.zeros(len(self.levels[-1][0]), dtype=np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            value = chunk.astype(np.uint32)
            if bits is not None:
                more = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
                value[more] |= rest << 8
            rest = value
        return rest


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's content; ``lengths`` sum to the number of ``ids``."""
    codes, out = Codes.of(ids), io.BytesIO()
    out.write(MAGIC + struct.pack("<HQQ", len(codes.levels), len(ids), len(doc_ids)))
    out.write(np.array([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes())
    out.write(bytes(x is None for x in doc_ids))
    out.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
    for chunk, bits, ranks in codes.levels:
        out.write(struct.pack("<Q", len(chunk)) + chunk.tobytes())
        if bits is not None:
            out.write(bits.tobytes() + ranks.astype("<u4").tobytes())
    return out.getvalue()


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, first id of each document (and the total), and the codes of a file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    n_levels, n_ids, n_docs = struct.unpack_from("<HQQ", data, len(MAGIC))
    at = len(MAGIC) + 18

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += got.nbytes
        return got

    numbers, null = take("<i8", n_docs), take("u1", n_docs)
    starts, levels = take("<u8", n_docs + 1).astype(np.int64), []
    for k in range(n_levels):
        n = int(take("<u8", 1)[0])
        chunk, bits, ranks = take("u1", n), None, None
        if k < n_levels - 1:
            bits, ranks = take("u1", -(-n // 8)), take("<u4", -(-n // BLOCK_BITS))
        levels.append((chunk, bits, ranks))
    return [None if z else int(x) for x, z in zip(numbers, null, strict=True)], starts, Codes(levels, n_ids)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def _put(folder: str, name: str, data: bytes) -> str:
    """Write under a name of this attempt, then move: a second attempt replaces the same file."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as f:
        f.write(data)
    store.move(attempt, f"{path}/{name}")
    return f"{folder}/{name}"


def write(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int, docs_per_shard: int = 8192, ids_per_file: int = 32 << 20) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and write them in ascending doc_id order under ``folder``.

    Returns the manifest, one row per file: shard, part, path, n_docs, n_ids, n_bytes. It is stored
    beside the files, so that reading it does not write them again.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(read_definition(tokenizer_path))
    end = end_id.to_bytes(4, "little")
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    n_docs = rows.count()
    n_shards = min(MAX_SHARDS, max(1, -(-n_docs // docs_per_shard)))
    bounds = rows.select(F.percentile_approx("doc_id", [i / n_shards for i in range(1, n_shards)], 10 * n_shards)).first()[0] if n_shards > 1 else []
    bounds = np.array(sorted({*(bounds or [])}), dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(definition.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [x + end for x in encoder.encode_batch([x or "" for x in part.column(1).to_pylist()])]
                numbers = part.column(0).to_numpy(zero_copy_only=False)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                shards = np.where(null, 0, np.searchsorted(bounds, np.where(null, 0, numbers).astype(np.int64), side="left")).astype(np.int32)
                values = np.frombuffer(b"".join(ids), "<u4")
                wide = bool(values.max() > 0xFFFF)
                kind = "<u4" if wide else "<u2"
                offsets = np.cumsum([0, *map(len, ids)]) // 4 * np.dtype(kind).itemsize
                held = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.astype(kind))])
                yield pa.RecordBatch.from_arrays([pa.array(shards), part.column(0), pa.array([wide] * len(ids), pa.bool_()), held], ["shard", "doc_id", "wide", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, numbers, held, size = None, 0, [], [], 0
        own("files", lambda: None)

        def put() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], dtype=np.int64)
            data = to_bytes(numbers, lengths, np.concatenate(held))
            path = _put(folder, f"shard-{shard:06d}-{part:04d}.dac", data)
            values = (shard, part, path, len(numbers), int(lengths.sum()), len(data))
            return pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _MANIFEST.split(", ")], values, strict=True))], schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in (x.slice(i, 1024) for x in batches for i in range(0, x.num_rows, 1024)):
            for s, number, wide, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (s != shard or size >= ids_per_file):
                    yield put()
                    part, numbers, held, size = (part + 1 if s == shard else 0), [], [], 0
                shard = s
                numbers.append(number)
                held.append(np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.uint32))
                size += len(held[-1])
        if held:
            yield put()

    encoded = map_arrow(rows, encode, "shard int, doc_id long, wide boolean, ids binary")
    sorted_rows = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    map_arrow(sorted_rows, save, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the files that ``manifest`` lists: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before, over all files in order.
    """
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_stream(name) as f:
                    numbers, starts, codes = from_bytes(f.read())
                ids = codes.all().astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                columns = [pa.array(numbers, pa.int64()), pa.array(starts[:-1] + base, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _DOCUMENTS.split(", ")])

    files = manifest.count()
    return map_arrow(placed.repartition(max(1, min(files, MAX_SHARDS))), load, _DOCUMENTS)


def round_trip(docs: DataFrame, tokenizer_path: str, *, end_id: int, docs_per_shard: int = 8192) -> DataFrame:
    """Write ``docs`` to a new shared folder and read the documents back from the files."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer_path, work_dir(spark, "codes"), end_id=end_id, docs_per_shard=docs_per_shard))
