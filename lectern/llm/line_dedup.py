"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line is the set of its distinct words; two match if the Jaccard similarity of their sets reaches a
threshold. A line is removed if any line before it (by doc_id, then place) matches it, removed or not.
Lines without words stay.

1. *Rarity.* Words are counted over all documents in ``2**19`` hash buckets; a word's rank is its bucket's
   count on a logarithmic scale. Any common order keeps the join exact; a good one keeps it small.
2. *Sets.* Each line's words are ordered by rank, then hash. Lines with equal sets meet in an aggregate
   (two 64-bit digests), so exact copies, however many, are one set with a first line.
3. *Prefixes.* Sets that match share one of their ``n - ceil(t n) + 1`` rarest words. Only those are
   shuffled, but for words that the counts show in one place alone.
4. *Stars.* A set is first paired with the earliest set (or a few early ones) that shares two neighbouring prefix words;
   what that leaves open, with a few early open sets of each long list. That settles most of a large group of near copies at a few
   rows a set.
5. *Pairs.* Sets that share a listed word are paired if their sizes, the word's positions and parity bits of
   their words allow the threshold, and one of them is not yet known to be removed. The smaller set of a pair is listed by
   a shorter prefix. Nothing is left out.
6. *Proof.* Full sets of 64-bit word hashes are compared. They are made again for paired lines only.

Everything is DataFrame operations. The joins are sort-merge joins that adaptive execution may split. Tables between steps
go to the shared folder.

Defined results: null text has no lines; rows that repeat both doc_id and text are one document and are
treated alike; rows that share a doc_id only are different documents, ordered by a hash of the text; null
doc_id comes first; very long texts and lines are read whole; an empty table gives no rows; other columns are ignored (or kept by
``dedup``, whatever their names).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.native import words
from lectern.session import discard, materialize

BUCKETS = 1 << 19
#: Sets with more words have 128 parity bits.
LARGE = 64
#: The counts' compiled hash map has room for all buckets.
COUNTING = {"spark.sql.codegen.aggregate.fastHashMap.capacityBit": "20"}
#: Pairs of neighbouring words by which a set looks for an early match.
STAR = 3
#: Sets that share a key beyond which they are cut to parts, and the number of parts.
SMALL, CENTRES = 32, 8
#: Lists are long from here, or from half the square root of the number of sets.
LONG = 64
#: Parts of the inverted lists that are joined one after another.
PASSES = 3
#: Paired lines up to this number (some 40 bytes each) are broadcast to the scan; beyond, a join by shuffle.
BROADCAST_ROWS = 400_000


@dataclass(frozen=True)
class Settings:
    """The threshold as a fraction."""

    numerator: int = 80
    denominator: int = 100


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _ranks(docs: DataFrame) -> Column:
    """The rank of each bucket, as one array constant of fixed size."""
    word = docs.select(F.explode(words(F.col("text"))).alias("w"))
    counts = materialize(word.groupBy((F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1))).cast("int").alias("bucket")).agg(F.count("*").alias("c")), "words", settings=COUNTING)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    ranked = every.join(counts, "bucket", "left").select("bucket", _rank(F.coalesce("c", F.lit(0))).alias("rank"))
    listed = ranked.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "rank"))), lambda x: x["rank"]), ",").alias("ranks"))
    found = listed.first()["ranks"]
    discard(counts)
    return F.split(F.lit(found), ",").cast("array<bigint>")  # folded when the query is planned


def _rank(count: Column) -> Column:
    return F.floor(8 * F.log2(count + 1)).cast("int")


def _keys(ranks: Column, line: Column) -> Column:
    """A line's distinct words, rarest first: rank in the upper bits, 48 bits of the hash below.

    Nothing here is a loop within a loop, so that all but the hashing and ranking is compiled. Each word is hashed once and
    each distinct one ranked once. No key is null, which Spark must know to sort plain numbers instead of objects.
    """

    def key(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(rank, 48).bitwiseOR(F.shiftrightunsigned(h, 16))

    return F.sort_array(F.transform(F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w))), key))


def _need(n: Column, s: Settings) -> Column:
    """Words that a match of a set of ``n`` shares at least."""
    return F.ceil(n * s.numerator / s.denominator)


def _flipped(k: Column, which: Callable[[Column], Column]) -> Column:
    """64 parity bits: each word flips the one that its lowest six bits name, if ``which`` is 1 for it."""
    place = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    return F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", which(x), place(x))))


def _lines(docs: DataFrame, ranks: Column, s: Settings) -> DataFrame:
    """doc_id, t, line, h1, h2, n, bits, more and the prefix of each line; a line of rare blanks alone has ``n`` 0.

    ``bits`` are of all words. Of larger sets, ``more`` are those of half of the words, which makes 128 bits in all.
    """
    # the hash comes before the lines, or it would be made for each of them
    split = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    keyed = split.where(F.trim("body") != "").select("doc_id", "t", "line", _keys(ranks, F.col("body")).alias("k"))
    n, one = F.size("k"), F.lit(1).cast("long")
    bits = _flipped(F.col("k"), lambda x: one)
    more = F.when(n > LARGE, _flipped(F.col("k"), lambda x: F.shiftright(x, 6).bitwiseAND(one)))
    prefix = F.slice("k", 1, (n - _need(n, s) + 1).cast("int"))
    return keyed.select(
        "doc_id", "t", "line", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), n.alias("n"), bits.alias("bits"), more.alias("more"), prefix.alias("prefix")
    )


def _postings(sets: DataFrame) -> DataFrame:
    """key, set, place and size of each prefix word that may stand in another set, with the set's bits and state."""
    rows = sets.where("n > 1").select("h1", "n", "bits", "more", "open", F.posexplode("prefix").alias("p", "key"))
    return rows.where(F.shiftright("key", 48) > _rank(F.lit(1.0)))  # a bucket of one word is in one set


def _met(n: Column, m: Column, s: Settings) -> Column:
    """Words that matching sets of these sizes share at least."""
    return F.ceil((n + m) * s.numerator / (s.numerator + s.denominator))


def _lower(rows: DataFrame, s: Settings) -> DataFrame:
    """The postings by which a set meets sets that are not smaller: a shorter prefix does."""
    return rows.where(F.col("p") <= F.col("n") - _met(F.col("n"), F.col("n"), s))


def _upper(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("h1").alias("o1"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("bits").alias("bits2"), F.col("more").alias("more2"), F.col("open").alias("open2"))


def _neighbours(sets: DataFrame) -> DataFrame:
    """Sets by the last ``STAR`` pairs of neighbouring words of their prefix; an edit moves or breaks only some of them."""
    size = F.size("prefix")
    pair = [F.when(size > k + 1, F.xxhash64(F.get("prefix", size - k - 2), F.get("prefix", size - k - 1))) for k in range(STAR)]  # no loop: compiled
    rows = sets.where("n > 1 and size(prefix) > 1").select("h1", "n", "bits", "more", F.col("first.doc_id").alias("doc_id"), F.explode(F.array(*pair)).alias("key"))
    return rows.where("key is not null")


def _common(sets: DataFrame, long: int) -> DataFrame:
    """Open sets by the words of their prefix that the corpus holds more than ``long`` times."""
    rows = sets.where("n > 1 and open").select("h1", "n", "bits", "more", F.col("first.doc_id").alias("doc_id"), F.explode("prefix").alias("key"))
    return rows.where(F.shiftright("key", 48) > _rank(F.lit(float(long))))


def _stars(rows: DataFrame, fewest: int, s: Settings) -> DataFrame:
    """Pairs (a, b) of a set and early sets that share a key with it, for keys of at least ``fewest`` sets.

    A set meets the earliest set of each key; where more than ``SMALL`` share one, also the earliest of each of ``CENTRES`` parts
    of them, so that most sets of a large group of near copies meet one they match, at a few rows each. Most keys stand in one set
    alone: keys are counted first, as plain numbers, and only rows of keys with enough sets go on.
    """
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= fewest), "shared-keys")
    rows = materialize(rows.join(counts, "key"), "sharing")
    earliest = F.min(F.struct("doc_id", "h1", "n", "bits", "more")).alias("x")
    centre = rows.groupBy("key").agg(earliest)
    parts = rows.where(F.col("c") > SMALL).groupBy("key", F.pmod(F.xxhash64("h1"), F.lit(CENTRES)).alias("part")).agg(earliest).select("key", "x")
    centre_of = centre.union(parts).select("key", F.col("x.h1").alias("o1"), F.col("x.n").alias("m"), F.col("x.bits").alias("bits2"), F.col("x.more").alias("more2"))
    met = rows.join(centre_of, "key").where((F.col("h1") != F.col("o1")) & _sized(s))
    stars = materialize(met.select(F.least("h1", "o1").alias("a"), F.greatest("h1", "o1").alias("b")).distinct(), "stars")
    discard(counts, rows)
    return stars


def _sized(s: Settings) -> Column:
    """Length and bit filters. Each word flips one bit, so bits that differ are words of one set alone."""
    n, m = F.col("n"), F.col("m")
    differ, half = F.col("bits").bitwiseXOR(F.col("bits2")), F.col("more").bitwiseXOR(F.col("more2"))
    apart = F.coalesce(F.bit_count(half) + F.bit_count(half.bitwiseXOR(differ)), F.bit_count(differ))
    return (F.least(n, m) * s.denominator >= F.greatest(n, m) * s.numerator) & (n + m - apart >= 2 * _met(n, m, s))


def _possible(s: Settings) -> Column:
    """Filters for a word that a set (h1, n, p, bits) shares with a set that is not smaller (o1, m, q, bits2).

    The word is the pair's first at places p and q, or another row is. A pair matters while one of it is open.
    """
    n, m = F.col("n"), F.col("m")
    order = (n < m) | ((n == m) & (F.col("h1") < F.col("o1")))
    return order & _sized(s) & (F.least(n - F.col("p"), m - F.col("q")) >= _met(n, m, s)) & (F.col("open") | F.col("open2"))


def _paired_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, first and the 64-bit word hashes of the sets in ``wanted`` (h1, h2, first)."""
    places = wanted.groupBy(F.col("first.doc_id").alias("d"), F.col("first.t").alias("dt")).agg(F.collect_list(F.struct("first.line", "h1", "h2")).alias("places"))  # a document's lines
    places = materialize(places, "places")
    few = (places.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_ROWS
    rows = docs.withColumn("t", F.xxhash64("text")).join(F.broadcast(places) if few else places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")))
    body = rows.select("doc_id", "t", F.split("text", "\n").alias("lines"), F.explode("places").alias("x")).select("doc_id", "t", "x.*", F.get("lines", F.col("x.line")).alias("body"))
    hashes = F.array_distinct(F.transform(words(F.col("body")), lambda w: F.xxhash64(w)))
    made = body.select("h1", "h2", F.struct("doc_id", "t", "line").alias("first"), hashes.alias("items"))
    full = materialize(made.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.first("items").alias("items")), "paired-sets")
    discard(places)
    return full


def _later(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(h1, h2) of the later set of each pair (a, b) that matches by its full sets."""
    of = lambda x: sets.select(F.col("h1").alias(x), F.col("h2").alias(f"{x}2"), F.col("first").alias(f"f{x}"), F.col("items").alias(f"i{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    met = F.size(F.array_intersect("ia", "ib"))
    both = both.where(met * s.denominator >= (F.size("ia") + F.size("ib") - met) * s.numerator)
    a_first = F.col("fa") < F.col("fb")
    return both.select(F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("h1"), F.when(a_first, F.col("b2")).otherwise(F.col("a2")).alias("h2")).distinct()


def removed_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, t (hash of the text) and the ascending places of each document's removed lines."""
    return _removed(_documents(docs), settings)


def _removed(docs: DataFrame, s: Settings) -> DataFrame:
    wide = materialize(_lines(docs, _ranks(docs), s), "lines", plan_chars=100_000)  # the ranks are not worth printing
    place = F.struct("doc_id", "t", "line")
    some = [F.first(x).alias(x) for x in ("n", "bits", "more", "prefix")]
    sets = materialize(wide.where("n > 0").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c"), *some), "sets")
    lines = materialize(wide.where("n > 0").select("doc_id", "t", "line", "h1", "h2"), "places")
    discard(wide)

    def proved(pairs: DataFrame) -> DataFrame:
        """The later set of each pair that matches, by the full sets of the paired lines."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), "paired")
        few = ids.count() <= BROADCAST_ROWS
        full = _paired_sets(docs, sets.select("h1", "h2", "first").join(F.broadcast(ids) if few else ids, "h1", "left_semi"))
        found = materialize(_later(pairs, full, s), "later")
        discard(ids, full)
        return found

    def marked(*gone: DataFrame) -> DataFrame:
        """The sets, and whether they are not yet known to be removed."""
        lost = reduce(DataFrame.union, gone).select("h1").distinct().withColumn("lost", F.lit(True))
        few = sum(x.count() for x in gone) <= BROADCAST_ROWS
        return sets.join(F.broadcast(lost) if few else lost, "h1", "left").withColumn("open", F.col("lost").isNull())

    near = _stars(_neighbours(sets), 2, s)
    gone = [proved(near)]
    long = max(LONG, int(sets.count() ** 0.5 / 2))  # shorter lists make at most that many pairs a set
    star = _stars(_common(marked(*gone), long), long, s)
    star = materialize(star.join(near, ["a", "b"], "left_anti"), "stars")
    gone.append(proved(star))
    now = marked(*gone)
    tables = []
    for k in range(PASSES):  # a part of the lists at a time holds less of the disk
        some = _postings(now).where(F.pmod("key", F.lit(PASSES)) == k)
        met = _lower(some, s).join(_upper(some), "key").where(_possible(s)).select(F.least("h1", "o1").alias("a"), F.greatest("h1", "o1").alias("b"))
        tables.append(materialize(met.distinct(), "pairs"))
    tried = near.union(star)
    rest = materialize(reduce(DataFrame.union, tables).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    gone.append(proved(rest))

    # per set: whether all its lines go, else all but the first; sets that lose none are not joined
    fate = sets.select("h1", "h2", "first", "c").join(reduce(DataFrame.union, gone).distinct().withColumn("all", F.lit(True)), ["h1", "h2"], "left").where("all or c > 1")
    lost = lines.join(fate, ["h1", "h2"]).where(F.coalesce("all", F.lit(False)) | (place != F.col("first")))
    lost = materialize(lost.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed")  # a document's lines
    discard(lines, sets, near, star, *tables, rest, *gone)
    return lost


def _with_removed(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """``rows`` (with d and t) and the removed places of each."""
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("t").alias("lost_t"), "removed")
    return rows.join(lost, F.col("d").eqNullSafe(F.col("lost_id")) & (F.col("t") == F.col("lost_t")), "left").drop("lost_id", "lost_t", "d", "t")


def judge(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_lines (with words), n_removed and removed (ascending places, by commas) of each row of ``docs`` (doc_id, text)."""
    plain = _documents(docs)
    lost = _removed(plain, settings)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = plain.select("doc_id", F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"))
    places = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_removed(rows, lost).select("doc_id", "n_lines", F.size(places).cast("long").alias("n_removed"), F.array_join(places, ",").alias("removed"))


def dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, perhaps n_chars) without removed lines.

    ``n_chars`` follows the text. A document that loses all its lines with words is left out.
    """
    lost = _removed(_documents(docs), settings)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    joined = _with_removed(rows, lost)
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i))
    emptied = F.col("removed").isNotNull() & ~F.exists("kept", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    joined = joined.withColumn("kept", F.when(F.col("removed").isNotNull(), kept)).where(~emptied)
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    given = {c: F.col(f"row.`{c}`") for c in docs.columns}
    given["text"] = text
    if "n_chars" in given:
        given["n_chars"] = F.when(F.col("removed").isNull(), given["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[v.alias(c) for c, v in given.items()])


def oracle_sql(numerator: int = 80, denominator: int = 100) -> str:
    """The same in DuckDB SQL, with all pairs of sets that share a word."""
    blank = "[\\x20\\x09-\\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text FROM documents),
cut AS (SELECT r, unnest(string_split(text, chr(10))) AS body, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM d),
lines AS (SELECT r, line, list_sort(list_distinct(list_filter(regexp_split_to_array(body, '{blank}'), lambda x: x <> ''))) AS s FROM cut),
sets AS MATERIALIZED (SELECT s, row_number() OVER () AS k, min((r, line)) AS first FROM lines WHERE len(s) > 0 GROUP BY s),
items AS (SELECT k, unnest(s) AS w FROM sets),
common AS (SELECT w, count(*) AS c FROM items GROUP BY w),
ranked AS (SELECT k, w, len(s) AS n, first, row_number() OVER (PARTITION BY k ORDER BY c, w) AS p FROM items JOIN common USING (w) JOIN sets USING (k)),
prefix AS (SELECT * FROM ranked WHERE p <= n - ceil(n * {numerator} / {denominator}) + 1),
pairs AS (SELECT DISTINCT a.k AS a, b.k AS b FROM prefix a JOIN prefix b ON a.w = b.w AND a.first < b.first WHERE least(a.n, b.n) * {denominator} >= greatest(a.n, b.n) * {numerator}),
met AS (SELECT b, len(list_intersect(p.s, q.s)) AS n, len(p.s) + len(q.s) AS total FROM pairs JOIN sets p ON p.k = a JOIN sets q ON q.k = b),
gone AS (SELECT DISTINCT b AS k FROM met WHERE {denominator} * n >= {numerator} * (total - n)),
judged AS (SELECT lines.r, line, (lines.r, line) <> first OR gone.k IS NOT NULL AS lost FROM lines JOIN sets USING (s) LEFT JOIN gone USING (k)),
per AS (SELECT r, count(*) AS n_lines, count(*) FILTER (lost) AS n_removed, coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (lost), '') AS removed FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN per USING (r)
"""
