"""Cost-balanced packing of documents into token sequences.

Each task tokenizes the rows of its input partition and packs them in blocks of bounded size, so
no shuffle is needed and memory does not grow with the input. In a block:

* a document longer than a sequence first gives whole sequences;
* the block's token total fixes the sequences: as many of ``capacity`` tokens as it fills. What they have no room
  for goes on to the next block; the last block of a partition makes one sequence for each power of two in the number of
  tokens that remain. A sequence whose length is a power of two needs no padding, so there is none;
* the other pieces go, in descending order of length, each to the lowest-cost sequence that has room
  for it. A piece's cost is ``linear * n + quadratic * n**2`` (attention within the piece). If no
  sequence has room, the piece is cut at the sequence with most room.

Given the same rows in the same partition, a rerun packs alike; the input should be a stored table
or another plan with a fixed row order, as ids of sequences hold the partition's number.

Defined results: null text is an empty document (one piece that holds only the end id); a very long text is cut over many
sequences; rows that repeat are packed each on their own; ties in length go by place, ties in cost to the first sequence; a null ``doc_id`` stays null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.tokenization import read_definition, worker_encoder
from lectern.llm.workers import map_arrow

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_WITH_IDS = PIECES + ", ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of the given lengths: (document, start, length, sequence, offset) pieces.

    All sequences come out full; sequences are numbered from 0.
    """
    return assign_block(lengths, capacity, linear, quadratic, True)[0]


def assign_block(lengths: np.ndarray, capacity: int, linear: float, quadratic: float, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """The pieces of one block. Unless this block is the ``last`` one, only whole
    sequences are made, and the ends of documents that they have no room for are returned as (document, start).
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    order = np.argsort(-lengths, kind="stable")
    n_full, rest, later = 0, [], []
    for d in order:
        n, at = int(lengths[d]), 0
        while n - at > capacity:
            pieces.append((int(d), at, capacity, n_full, 0))
            n_full += 1
            at += capacity
        if n > at:
            rest.append((n - at, int(d), at))
    rest.sort(key=lambda x: (-x[0], x[1], x[2]))
    left = sum(x[0] for x in rest)
    sizes = [capacity] * (left // capacity)
    if last:
        sizes += [1 << k for k in range(capacity.bit_length(), -1, -1) if (left % capacity) >> k & 1]
    room, cost, used = np.array(sizes, dtype=np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), dtype=np.int64)
    free = int(room.sum())
    for n, d, at in rest:
        while n and free:
            fits = np.flatnonzero(room >= n)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            k = min(n, int(room[s]))
            pieces.append((d, at, k, n_full + s, int(used[s])))
            cost[s] += linear * k + quadratic * k * k
            room[s] -= k
            used[s] += k
            free -= k
            at += k
            n -= k
        if n:
            later.append((d, at))
    return pieces, later


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    end_id: int,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    block_tokens: int = 2 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text), packed into sequences.

    ``linear`` and ``quadratic`` weigh a piece's tokens and the square of its tokens. Blocks of at
    least ``block_tokens`` tokens are packed together. ``with_ids`` adds the token ids of each piece.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, base, done = worker_encoder(definition.value), TaskContext.get().partitionId() << 32, 0
        waiting: list[tuple[int | None, bytes, int]] = []  # doc_id, ids, first id not packed yet
        tokens = 0

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal done, waiting, tokens
            got, later = assign_block(np.array([len(x) // 4 - first for _, x, first in waiting], dtype=np.int64), capacity, linear, quadratic, last)
            got = [(*waiting[d], at, n, s, offset) for d, at, n, s, offset in got]
            held = [x[4 * (first + at) : 4 * (first + at + n)] for _, x, first, at, n, _, _ in got]
            columns = [
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([x[2] + x[3] for x in got], pa.int64()),
                pa.array([x[4] for x in got], pa.int64()),
                pa.array([zlib.crc32(x) for x in held], pa.int64()),
                pa.array([len(x[1]) // 4 for x in got], pa.int64()),
                pa.array([base + done + x[5] for x in got], pa.int64()),
                pa.array([x[6] for x in got], pa.int64()),
            ]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            done += max((x[5] for x in got), default=-1) + 1
            waiting = [(waiting[d][0], waiting[d][1], waiting[d][2] + at) for d, at in later]
            tokens = sum(len(x) // 4 - first for _, x, first in waiting)
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                encoded = [x + end for x in encoder.encode_batch([x or "" for x in part.column(1).to_pylist()])]
                waiting += [(d, x, 0) for d, x in zip(part.column(0).to_pylist(), encoded, strict=True)]
                tokens += sum(map(len, encoded)) // 4
                if tokens >= block_tokens:
                    yield packed(False)
        if waiting:
            yield packed(True)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return map_arrow(rows, run, PIECES_WITH_IDS if with_ids else PIECES)
