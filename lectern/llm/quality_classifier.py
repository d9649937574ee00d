"""A quality classifier that asks which of two dictionaries compresses a text better.

Zstandard dictionaries are built from labelled good and from labelled bad text. A text is compressed with
both, in blocks of ``BLOCK`` bytes so that a long text does not become its own dictionary; the
difference of the compressed sizes, divided by the larger, is the signal. A logistic curve turns it into
the probability of a good text. The curve is fitted on signals of labelled texts from dictionaries that
do not hold them: two halves of the sample swap roles, and the final dictionaries hold both.

Fitting uses a bounded sample of labelled rows: per label at most ``max_documents`` documents (the first
by hash of the id) and ``max_bytes`` of text. Scoring is one narrow pass over all whole texts; executors get
two dictionaries of at most ``dictionary_bytes`` and two numbers.

Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have the signal 0 and so the curve's value there; documents whose
label rows disagree, and null labels, are not learned from; with labels of one kind only, or none, every text
scores that label's share with one pseudo-row each (0.5 without labels); rows that repeat are scored each on their own; a null
``doc_id`` stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.workers import blobs, map_arrow

BLOCK = 512
LEVEL = 3
SCORES = "doc_id long, score double, predicted int"


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a logistic curve."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def score(self, signal: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * signal + self.offset))))


class Signal:
    """Normalised difference of compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [self._compressor(x) for x in (good, bad)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        if not content:
            return zstandard.ZstdCompressor(**options)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, **options)

    def of(self, text: bytes | None) -> float:
        if not text:
            return 0.0
        good, bad = (sum(len(c.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK)) for c in self.pair)
        return (bad - good) / max(bad, good)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def _dictionaries(texts: dict[int, list[bytes]], size: int) -> tuple[bytes, bytes]:
    """Trained dictionaries of good and bad texts, of one size; plain text where there is too little to train."""
    size = min(size, *(sum(map(len, some)) for some in texts.values()))
    out = []
    for q in (1, 0):
        blocks = [x[i : i + 2048] for x in texts[q] for i in range(0, len(x), 2048)]
        try:
            out.append(zstandard.train_dictionary(size, blocks, k=256, d=8, level=LEVEL).as_bytes())
        except (zstandard.ZstdError, ValueError):
            out.append(b"\n".join(texts[q])[-size:])
    return out[0], out[1]


def _curve(signals: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression by Newton steps, with smoothed targets and a light pull of the slope to 0."""
    n_good, n_bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    scale = float(np.abs(signals).mean()) or 1.0
    x, w = np.column_stack([signals / scale, np.ones(len(signals))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (target - p) - np.array([1e-3 * w[0], 0])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-9]), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, max_documents: int = 4000, max_bytes: int = 24 << 20, dictionary_bytes: int = 112_640) -> Model:
    """Learn from ``labels`` (doc_id, quality) that are not held out, and their texts in ``docs`` (doc_id, text)."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    chosen = [r for q in (0, 1) for r in usable.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(max_documents).select("id", "quality").collect()]
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "id long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("body")).where("body <> ''").join(F.broadcast(sample), "id")
    sizes = {r["id"]: r["n"] for r in texts.groupBy("id").agg(F.max(F.octet_length("body")).alias("n")).collect()}
    room, taken = {0: max_bytes, 1: max_bytes}, []
    for r in chosen:
        if sizes.get(r["id"], max_bytes + 1) <= room[r["quality"]]:
            room[r["quality"]] -= sizes[r["id"]]
            taken.append((r["id"],))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(taken, "id long"))
    rows = {r["id"]: (r["quality"], r["body"].encode()) for r in texts.join(wanted, "id", "left_semi").groupBy("id", "quality").agg(F.min("body").alias("body")).collect()}
    by_label: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for i, (q, body) in sorted(rows.items()):
        by_label[q].append((i, body))
    n_good, n_bad = len(by_label[1]), len(by_label[0])
    if n_good < 2 or n_bad < 2:
        return Model(b"", b"", 0.0, math.log((n_good + 1) / (n_bad + 1)))
    halves = [{q: [body for n, (_, body) in enumerate(some) if n % 2 == h] for q, some in by_label.items()} for h in (0, 1)]
    found = []
    for learn, other in (halves, halves[::-1]):
        signal = Signal(*_dictionaries(learn, dictionary_bytes))
        found += [(signal.of(body), q) for q, some in other.items() for body in some]
    curve = _curve(np.array([x for x, _ in found]), np.array([q for _, q in found]))
    return Model(*_dictionaries({q: [body for _, body in some] for q, some in by_label.items()}, dictionary_bytes), *curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """score (0 to 1, higher: likelier good) and predicted of every whole text of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        signal = Signal(model.good, model.bad)
        for batch in batches:
            got = [model.score(signal.of(x)) for x in blobs(batch.column(1))]
            columns = [batch.column(0), pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), run, SCORES)
