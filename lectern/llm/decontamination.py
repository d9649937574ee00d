"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item (a shorter item is
one window). For each pattern length there is one table set, over blocks of ``BLOCK`` words:

* the shift table says how far the search may jump when a block ends a position: the distance from
  the block's last place in any pattern to the pattern's end, or the whole pattern less the block;
* where the shift is 0, a table by the final block (the suffix) gives the few patterns that may end
  here, and a direct comparison of all their words confirms.

Words are found on the UTF-8 bytes: every byte of a non-ASCII character is 0x80 or more, so a byte
table maps A-Z to lower case, all other ASCII but digits and letters to blanks, and keeps the rest.

The benchmark is searched in blocks of at most ``block_bytes`` of text and ``BLOCK_WORDS`` words. Words are numbered, so that a block's
tables are arrays of numbers and one dictionary of packed word numbers, some 150 bytes a word. One block at a time is on the
driver and the executors: its pass over the documents is stored before the next one starts, and adds its findings
to the row. A benchmark of one block, the usual case, is one narrow pass without a table. No shuffle at any size.

Defined results: null text has no words; null or wordless items have no windows; items that repeat an
``item_id`` count as one item; windows that several items hold count for each of them; rows that repeat are judged each on
their own; a very long text is searched whole; a null ``doc_id`` stays null; with an empty benchmark no word is hit; an empty
table gives no rows; other columns are ignored (or kept by ``keep``, whatever their names).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.workers import blobs, map_arrow
from lectern.session import discard, materialize

BLOCK = 3
#: Words in a block of the benchmark; word numbers fit 21 bits.
BLOCK_WORDS = 1 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_FOUND = "doc_id long, text string, hits array<int>, items array<string>"

_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return (text or b"").translate(_WORD_BYTES).split()


class WuManber:
    """Occurrences of word patterns; each pattern carries the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        ids, sizes = array("i"), []
        for _, text in items:
            words = words_of(text)
            ids.extend(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)  # 0 is every other word
            sizes.append(len(words))
        if len(self.numbers) >= 1 << 21:
            raise ValueError("a block of the benchmark has too many words")
        flat, sizes = np.frombuffer(ids, dtype=np.int32) if ids else np.zeros(0, np.int32), np.array(sizes, dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        self.names = [name for name, _ in items]
        self.tables = []
        lengths = np.minimum(sizes, window)
        for m in sorted({*lengths.tolist()} - {0}):
            some = np.flatnonzero(lengths == m)
            starts = np.concatenate([np.arange(first[i], first[i] + sizes[i] - m + 1) for i in some])
            owner = np.repeat(some, sizes[some] - m + 1)
            windows, which = np.unique(flat[starts[:, None] + np.arange(m)], axis=0, return_inverse=True)
            self.tables.append(self._table(m, windows, which.ravel(), owner))

    @staticmethod
    def _packed(block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block), dtype=np.int64)
        for column in block.T:
            out = out << 21 | column
        return out

    def _table(self, m: int, windows: np.ndarray, which: np.ndarray, owner: np.ndarray):
        """Length, block, steps by block, words of all patterns, patterns by suffix bucket, and items by pattern."""
        b = min(BLOCK, m)
        keys = np.concatenate([self._packed(windows[:, end - b : end]) for end in range(b, m + 1)])
        shifts = np.repeat(np.arange(m - b, -1, -1), len(windows))
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        least = np.concatenate([[True], keys[1:] != keys[:-1]])
        steps = dict(zip(keys[least].tolist(), shifts[least].tolist(), strict=True))
        suffix = self._packed(windows[:, m - b :])
        order = np.argsort(suffix, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], suffix[order][1:] != suffix[order][:-1]]))
        for k, key in enumerate(suffix[order][cuts].tolist()):
            steps[key] = -1 - k  # a bucket
        by_pattern = np.lexsort((owner, which))
        holders = np.searchsorted(which[by_pattern], np.arange(len(windows) + 1))
        return m, b, steps, array("i", windows[order].tobytes()), [*cuts.tolist(), len(windows)], order.tolist(), owner[by_pattern].tolist(), holders.tolist()

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, number of words) of every occurrence, and the items found."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        get = self.numbers.get
        ids = array("i", [get(w, 0) for w in words])
        total = len(ids)
        for m, b, steps, flat, cuts, patterns, owner, holders in self.tables:
            far, step_of, end = m - b + 1, steps.get, m
            while end <= total:
                block = 0
                for x in ids[end - b : end]:
                    block = block << 21 | x
                step = step_of(block, far)
                if step <= 0:
                    if step < 0:
                        here = ids[end - m : end]
                        for k in range(cuts[-1 - step], cuts[-step]):
                            if flat[k * m : (k + 1) * m] == here:
                                found.append((end - m, m))
                                p = patterns[k]
                                items.update(self.names[i] for i in owner[holders[p] : holders[p + 1]])
                                break  # patterns differ
                    step = 1
                end += step
        return found, items


def _chunks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size; the driver holds one and the next. An item over the bound is a block of its own."""
    chunk, size, words = [], 0, 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("body"))
    for r in rows.where("item is not null and body is not null").toLocalIterator():
        body = r["body"].encode()
        n = len(words_of(body))
        if chunk and (size + len(body) > block_bytes or words + n > BLOCK_WORDS):
            yield chunk
            chunk, size, words = [], 0, 0
        chunk.append((r["item"], body))
        size, words = size + len(body), words + n
    yield chunk


def _merged(hits: list[int]) -> list[int]:
    """A flat list first, count, first, count, ... without overlaps, in ascending order."""
    out: list[int] = []
    for first, n in sorted(zip(hits[::2], hits[1::2], strict=True)):
        if out and first <= out[-2] + out[-1]:
            out[-1] = max(out[-1], first + n - out[-2])
        else:
            out += [first, n]
    return out


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 32 << 20, digest: bool = False) -> DataFrame:
    """Hit words and found items of each row of ``docs`` (doc_id, text).

    Returns doc_id, text, hits (first word, count, first word, count, ...: ascending, disjoint) and
    items (ids as strings, sorted). With ``digest`` the last pass returns the columns of ``judge``.
    """
    spark = docs.sparkSession
    out = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", "cast(array() as array<int>) as hits", "cast(array() as array<string>) as items")

    def passed(searcher, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = searcher.value.search
            for batch in batches:
                hits, items, n_words = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
                for i, text in enumerate(blobs(batch.column(1))):
                    words = words_of(text)
                    n_words.append(len(words))
                    got, of = look(words)
                    if got:
                        hits[i] = _merged(hits[i] + [x for pair in got for x in pair])
                        items[i] = sorted({*items[i], *of})
                if last:
                    n_hit = [sum(x[1::2]) for x in hits]
                    columns = [
                        batch.column(0),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array(map(len, items), pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                        pa.array([x > 0 for x in n_hit], pa.bool_()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])
                else:
                    columns = [batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "hits", "items"])

        return run

    def each(out: DataFrame, searcher, final: bool) -> DataFrame:
        last = digest and final
        return map_arrow(out, passed(searcher, last), RESULT if last else _FOUND)

    return _by_blocks(spark, out, benchmark, window, block_bytes, each)


def _by_blocks(spark, out: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, each) -> DataFrame:
    """``each`` pass over ``out`` with one block's searcher; all but the last pass are stored, and their searchers dropped."""
    chunks, stored = _chunks(benchmark, block_bytes), None
    chunk = next(chunks)
    while True:
        after = next(chunks, None)
        searcher = spark.sparkContext.broadcast(WuManber(chunk, window))
        out = each(out, searcher, after is None)
        if after is None:
            return out
        out = materialize(out, "searched")
        searcher.unpersist()
        if stored is not None:
            discard(stored)
        stored, chunk = out, after


def judge(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Contamination of each document of ``docs`` (doc_id, text) by ``benchmark`` (item_id, text).

    A document word inside any occurrence of a window is hit. ``items_sha256`` digests the ids of the
    items with occurring windows, sorted as strings and joined by commas.
    """
    return find(docs, benchmark, window=window, block_bytes=block_bytes, digest=True)


def keep(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of ``benchmark``, with all their columns."""
    place = docs.columns.index("text")

    def each(out: DataFrame, searcher, final: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = searcher.value.search
            for batch in batches:
                yield batch.filter(pa.array([not look(words_of(x))[0] for x in blobs(batch.column(place))], pa.bool_()))

        return map_arrow(out, run, docs.schema)

    return _by_blocks(docs.sparkSession, docs, benchmark, window, block_bytes, each)


def oracle_sql(window: int = 10) -> str:
    """The same in DuckDB SQL: windows of either side as strings, joined."""
    cut = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {cut.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sized AS (SELECT item, w, least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
pattern AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS p FROM sized),
lengths AS (SELECT DISTINCT n FROM pattern),
spot AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'p': array_to_string(w[i:i + n - 1], ' ')}})) AS x FROM d, lengths WHERE len(w) >= n),
found AS (SELECT r, x.i AS i, spot.n AS n, item FROM spot JOIN pattern ON x.p = p AND spot.n = pattern.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
