"""Near-duplicate groups by bottom-k sketches from one hash function, with every link confirmed.

A document is the set of its distinct word shingles; two link if their Jaccard similarity reaches a
threshold. The steps:

1. *Sets to nodes.* One pass hashes every shingle (64-bit word hashes, mixed), counts the set, digests it
   (128 bits) and keeps the ``k`` smallest hashes. Documents with equal sets are one node, whatever
   their number, so exact copies never meet in pairs.
2. *Inverted lists.* A list holds the nodes that retain a value. Linked nodes share at least ``least``
   retained values (but for a chance of about one in 300,000 at a similarity of just 0.8, less above; small
   sets are retained whole, so there it is certain). Two sets of ``s`` values that share ``least`` meet
   among the ``s - least + 1`` rarest of either, so only those are listed; values of one node drop out. A passage
   that stands in a third of the documents is frequent and thus not listed.
3. *Pairs.* Lists are not expanded into all pairs. Each is first a star: its nodes are paired with the one
   whose values are the most common, then once more with another. Links join nodes to components; then
   only pairs from different components are left to be tried. In lists of up to ``SMALL`` nodes they are
   paired. What longer lists connect is a family, compared block by block within tasks of bounded size; only
   links that join components leave a task, so a large group of loose copies makes few rows.
4. *Filters and proof.* A pair must have sizes that allow the threshold; the union of both sketches estimates
   the similarity; at last the full sets are compared.

Sets are made a second time for listed nodes only. All joins are by value or digest and may be split by
adaptive execution; counts are combined before the shuffle. Intermediate tables go to the shared folder.

Defined results: null text or text without words has an empty set, linked with nothing; rows that repeat a
``doc_id`` are one document (all get the same component); null ``doc_id`` is never a component's name unless a
component has no other; an empty table gives no rows; other columns are ignored (or kept by ``keep``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lectern.llm.components import connected
from lectern.llm.workers import Remembered, blobs, map_arrow, own
from lectern.session import discard, materialize

#: Listed documents up to this number are sent to the tasks that make their sets; beyond, a join by shuffle.
BROADCAST_ROWS = 500_000
#: Lists up to this length are paired in full.
SMALL = 32
#: Shingles in a block of a family; a task compares two blocks.
BLOCK_ITEMS = 400_000
#: Hashes of short words that a worker remembers.
CACHE_WORDS = 500_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    """Words in a shingle; the threshold as a fraction; values retained; and how many a linked pair shares at least."""

    width: int = 5
    numerator: int = 80
    denominator: int = 100
    k: int = 64
    least: int = 36


_hashes = Remembered(xxhash.xxh64_intdigest, CACHE_WORDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """63 well-mixed bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(33))) >> np.uint64(1)).astype(np.int64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a UTF-8 text."""
    words = (text or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    m = min(width, n)
    total = np.full(n - m + 1, 0 if n >= width else n, dtype=np.uint64)
    for j in range(m):
        odd = _ODD[j % len(_ODD)] * np.uint64(2 * (j // len(_ODD)) + 1)
        part = h[j : n - m + 1 + j] * odd
        total = total * np.uint64(0x2545F4914F6CDD1D) + (part ^ (part >> np.uint64(29)))
    return np.unique(_mixed(total))


def _sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n, node (digest of the set; null if empty), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("shingles", _hashes.clear)
        for batch in batches:
            sets = [shingle_set(x, s.width) for x in blobs(batch.column(1))]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                pa.array([x[: s.k] for x in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "sketch"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), run, "doc_id long, n long, node binary, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """node, n and the whole set of the documents whose doc_id is in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("shingles", _hashes.clear)
        for batch in batches:
            sets = [x for x in (shingle_set(x, s.width) for x in blobs(batch.column(0))) if len(x)]
            columns = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "items"])

    few = wanted.count() <= BROADCAST_ROWS
    ids = F.broadcast(wanted) if few else wanted
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    rows = rows.join(ids.withColumnRenamed("doc_id", "wanted"), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    return map_arrow(rows, run, "node binary, n long, items array<long>").groupBy("node").agg(F.first("n").alias("n"), F.first("items").alias("items"))


def _lists(nodes: DataFrame, s: Settings) -> DataFrame:
    """(value, node, n, w): the listed values of each node, those of one node left out; w is how common its values are."""
    rows = nodes.select("node", "n", F.explode("sketch").alias("value"))
    counts = rows.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(counts, "value").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "value"))).alias("v"))  # k at most
    size = F.least("n", F.lit(s.k))
    whole = F.col("n") * s.denominator <= s.k * s.numerator  # a partner's set is then retained whole, too
    least = F.when(whole, F.ceil(size * s.numerator / s.denominator)).otherwise(F.least(F.lit(s.least), F.ceil(size * F.lit(s.least / s.k))))
    take = (size - least + 1 - (size - F.size("v"))).cast("int")  # values of one node are the rarest
    common = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    return shared.where(take > 0).select("node", "n", common.alias("w"), F.explode(F.slice("v", 1, F.greatest(take, F.lit(1)))).alias("x")).select("x.value", "node", "n", "w")


def _possible(a: Column, b: Column, s: Settings) -> Column:
    return F.least(a, b) * s.denominator >= F.greatest(a, b) * s.numerator


def _likely(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose union sketch does not speak against a link."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, s.k)
    met = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return both.where(met * s.k >= F.size(union) * s.least).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that link, by their full sets."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"i{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    met = F.size(F.array_intersect("ia", "ib")).cast("long")
    return both.select("a", "b", "na", "nb", met.alias("met")).where(f"{s.denominator} * met >= {s.numerator} * (na + nb - met)").select("a", "b")


def _families(rest: DataFrame) -> DataFrame:
    """(node, g, family) of the nodes of ``rest``: families are what the lists connect."""
    centres = rest.groupBy("value").agg(F.min("node").alias("a"))
    family = connected(rest.select("value", F.col("node").alias("b")).join(centres, "value").select("a", "b").distinct())
    return rest.select("node", "g").distinct().join(family, "node").select("node", "g", F.col("component").alias("family"))


def _across(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) between different components of each family, by full sets, enough to join what links join.

    A family is cut to blocks of about ``BLOCK_ITEMS`` shingles, and each task compares two blocks: the
    shared shingles of all pairs come from products of 0/1 matrices, and only links that join two
    components not joined yet leave the task.
    """
    full = members.join(sets.withColumnRenamed("node", "k"), F.col("node") == F.col("k")).drop("k")
    blocks = members.join(sets.select(F.col("node").alias("k"), F.col("n")), F.col("node") == F.col("k")).groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    placed = full.join(blocks.withColumnRenamed("family", "f"), F.col("family") == F.col("f")).drop("f").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "g", "n", "items")

    def compare(batch: pa.Table) -> pa.Table:
        nodes, g, sets_ = batch.column("node").to_pylist(), batch.column("g").to_pylist(), [np.array(x, dtype=np.int64) for x in batch.column("items").to_pylist()]
        n = np.array([len(x) for x in sets_])
        values, place = np.unique(np.concatenate(sets_), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)
        often = np.bincount(place) > 1
        place, owner = (np.cumsum(often) - 1)[place[often[place]]], owner[often[place]]
        order = np.argsort(place, kind="stable")
        place, owner, width = place[order], owner[order], int(often.sum())
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for at in range(0, len(n), 512):  # rows of the product at a time
            met = np.zeros((min(512, len(n) - at), len(n)), dtype=np.float32)
            for first in range(0, width, 2048):  # shingles at a time
                lo, hi = np.searchsorted(place, [first, first + 2048])
                m = np.zeros((len(n), min(2048, width - first)), dtype=np.float32)
                m[owner[lo:hi], place[lo:hi] - first] = 1
                met += m[at : at + 512] @ m.T
            near = s.denominator * met >= s.numerator * (n[at : at + 512, None] + n[None, :] - met)
            for x, y in zip(*np.nonzero(near), strict=True):
                x += at
                if x < y and root(g[x]) != root(g[y]):
                    parent[root(g[x])] = root(g[y])
                    out.append(tuple(sorted((nodes[x], nodes[y]))))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return dealt.groupBy("family", "i", "j").applyInArrow(compare, "a binary, b binary")


def _grouped(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n, node, g (the component's smallest node) and component_id of each row; the last three null for an empty set."""
    sketched = materialize(_sketches(docs, s), "sketches")
    nodes = materialize(
        sketched.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes"
    )
    lists = materialize(_lists(nodes, s), "lists")
    listed = nodes.join(lists.select("node").distinct(), "node", "left_semi")
    sets = materialize(_sets(docs, listed.select("doc_id").distinct(), s), "sets")
    listed = materialize(listed.select("node", "sketch"), "listed")

    tried, links, scratch = [], [], []

    def kept(df: DataFrame, name: str) -> DataFrame:
        scratch.append(materialize(df, name))
        return scratch[-1]

    def attempt(pairs: DataFrame) -> None:
        """Try pairs (a < b) that were not tried before; keep the links."""
        pairs = pairs.distinct()
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        tried.append(pairs)
        links.append(materialize(_linked(_likely(pairs, listed, s), sets, s), "links"))

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def all_links() -> DataFrame:
        return reduce(DataFrame.union, links)

    centres = lists.groupBy("value").agg(F.max(F.struct("w", "node", "n")).alias("m")).select("value", F.col("m.node").alias("c"), F.col("m.n").alias("cn"))
    attempt(lists.join(centres, "value").where((F.col("node") != F.col("c")) & _possible(F.col("n"), F.col("cn"), s)).select(*pair("node", "c")))
    for last in (False, True):
        known = kept(connected(all_links()), "components")
        placed = lists.join(known, "node", "left").select("value", "node", "n", F.coalesce("component", "node").alias("g"))
        mixed = placed.groupBy("value").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min(F.struct(F.xxhash64("node"), "node", "n", "g")).alias("m")).where("lo <> hi")
        if not last:
            centre = mixed.select("value", F.col("m.node").alias("c"), F.col("m.n").alias("cn"), F.col("m.g").alias("cg"))
            near = placed.join(centre, "value").where((F.col("g") != F.col("cg")) & _possible(F.col("n"), F.col("cn"), s))
            attempt(near.select(*pair("node", "c")))
        else:
            sizes = placed.groupBy("value").agg(F.count("*").alias("c"))
            rest = kept(placed.join(mixed.select("value").join(sizes, "value"), "value"), "unsettled")
            short = rest.where(F.col("c") <= SMALL)
            other = short.select("value", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("g").alias("g2"))
            across = short.join(other, "value").where((F.col("g") < F.col("g2")) & _possible(F.col("n"), F.col("n2"), s))
            attempt(across.select(*pair("node", "node2")))
            links.append(materialize(_across(kept(_families(rest.where(F.col("c") > SMALL)), "families"), sets, s), "links"))
    classes = connected(all_links())
    named = nodes.select("node", "doc_id").join(classes, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("g"))
    named = materialize(named, "classes")
    discard(nodes, lists, sets, listed, *tried, *links, *scratch)
    names = named.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    label = named.join(names, "g").select("node", "g", "component_id")
    return sketched.select("doc_id", "n", "node").join(label, "node", "left")


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable) of each row of ``docs`` (doc_id, text)."""
    out = _grouped(docs, settings)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def judge(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The groups with ``kept``: whether the row's document names its component."""
    return groups(docs, settings).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_nodes(docs: DataFrame, s: Settings) -> DataFrame:
    """row (all columns of ``docs``), id and node of each row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    schema = StructType([rows.schema["row"], rows.schema["id"], StructField("node", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("shingles", _hashes.clear)
        for batch in batches:
            sets = [shingle_set(x, s.width) for x in blobs(batch.column(2))]
            nodes = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes], ["row", "id", "node"])

    return map_arrow(rows, run, schema)


def keep(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with an empty set, and of each component those of its first document.

    That is the smallest ``doc_id`` and its smallest digest; rows that repeat both are one document. Rows with a null
    ``doc_id`` are documents of their own: one stays, and only if its component has no other. An id whose rows differ
    in their fate has its rows' digests made once more; all others are decided by their id alone.
    """
    rows = materialize(_grouped(docs, settings), "groups")
    first = rows.where("n > 0").groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "node")).alias("f"))
    first = materialize(first.select(F.col("f.doc_id").alias("first_id"), F.col("f.node").alias("first_node")), "first")
    stands = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node"))
    fate = rows.join(first, stands, "left").groupBy("doc_id", "node").agg(F.count("*").alias("c"), F.max(F.col("first_node").isNotNull() | F.col("node").isNull()).alias("stays"))
    again = F.col("doc_id").isNull() & F.col("node").isNotNull() & (F.col("c") > 1)
    ids = fate.groupBy("doc_id").agg(F.max(~F.col("stays") | again).alias("some"), F.max("stays").alias("stays")).where("some")
    gone = "gone" + "_" * max(map(len, docs.columns), default=0)  # no column of docs
    ids = materialize(ids.select(F.col("doc_id").alias(gone), F.col("stays").alias("mixed")), "copies")
    few = ids.count() <= BROADCAST_ROWS
    is_id = F.col("doc_id").cast("long").eqNullSafe(F.col(gone))
    out = docs.join(F.broadcast(ids.select(gone)) if few else ids.select(gone), is_id, "left_anti")
    mixed = ids.where("mixed").select(gone)
    if mixed.isEmpty():
        return out
    named = _with_nodes(docs.join(F.broadcast(mixed) if few else mixed, is_id, "left_semi"), settings)
    left = named.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node")), "left_semi")
    single = left.where("id is null").groupBy("node").agg(F.first("row").alias("row"))
    return reduce(DataFrame.union, [out, *[x.select("row.*") for x in (named.where("node is null"), left.where("id is not null"), single)]])


def oracle_sql(width: int = 5, numerator: int = 80, denominator: int = 100) -> str:
    """The same in DuckDB SQL, with all pairs that share a shingle."""
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) END) AS s FROM d),
items AS (SELECT r, unnest(s) AS x FROM sets),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM met JOIN sets p ON p.r = a JOIN sets q ON q.r = b WHERE {denominator} * n >= {numerator} * (len(p.s) + len(q.s) - n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(r, o) AS (SELECT r, r FROM sets UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.o = edges.a),
named AS (SELECT reach.r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.o GROUP BY reach.r)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (r)
"""
