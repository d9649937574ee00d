"""Ranked lexical retrieval: tokens of a stated query set are joined with the chunks' tokens; whole queries are looked for in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import single_spaces, tokens

#: Weight of a shared token by field, and of the whole query as a phrase in a field.
TOKEN_WEIGHTS = {"tags": 8, "title": 4, "section": 3, "text": 1}
PHRASE_WEIGHTS = {"title": 3, "section": 2, "text": 1}


def _field_tokens(chunks: DataFrame) -> DataFrame:
    """(id, token, weight): the weights of the fields that hold a token, added."""
    fields = [chunks.select("id", F.explode(F.array_distinct(tokens(F.array_join("tags", " ") if f == "tags" else F.col(f)))).alias("token"), F.lit(w).alias("weight")) for f, w in TOKEN_WEIGHTS.items()]
    out = fields[0]
    for f in fields[1:]:
        out = out.union(f)
    return out


#: Phrases that meet a chunk at a time.
PHRASE_BLOCK = 1000


def _phrase_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, score) of chunks that hold a whole query as a phrase; the query set meets each chunk in blocks of phrases."""
    numbered = queries.select("query_id", "phrase", F.pmod(F.xxhash64("query_id"), F.ceil(F.count("*").over(Window.partitionBy()) / PHRASE_BLOCK)).alias("block"))
    blocks = numbered.groupBy("block").agg(F.collect_list(F.struct("query_id", "phrase")).alias("wanted")).select("wanted")
    lowered = chunks.select("id", *[F.lower(F.col(f)).alias(f) for f in PHRASE_WEIGHTS])

    def bonus(q: Column) -> Column:
        return sum((F.when(F.contains(F.col(f), q["phrase"]), w).otherwise(0) for f, w in PHRASE_WEIGHTS.items()), F.lit(0))

    met = lowered.crossJoin(F.broadcast(blocks)).select("id", F.explode(F.transform("wanted", lambda q: F.struct(q["query_id"].alias("query_id"), bonus(q).alias("score")))).alias("x"))
    return met.select("x.query_id", "id", "x.score").where("score > 0")


def scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id, score) of every chunk that answers a query (query_id, query, tags).

    A chunk must carry all of a query's tags. It answers by shared tokens or by holding the whole query as a phrase; a query
    without tokens, but with tags, is answered by all chunks that carry them, with score 0. The query set is stated by
    the caller and small against the chunks.
    """
    q = queries.select(
        "query_id", F.array_distinct(tokens("query")).alias("_tokens"), F.lower(single_spaces("query")).alias("phrase"),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower).alias("_tags"),
    )
    met = q.select("query_id", F.explode("_tokens").alias("token")).join(_field_tokens(chunks), "token").groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    phrased = _phrase_scores(q.where("size(_tokens) > 0 and phrase <> ''"), chunks)
    found = met.union(phrased).groupBy("query_id", "id").agg(F.sum("score").cast("long").alias("score"))
    tagged = chunks.select("id", F.transform("tags", F.lower).alias("_has"))
    kept = found.join(F.broadcast(q.select("query_id", "_tags")), "query_id").join(tagged, "id").where(F.size(F.array_except("_tags", "_has")) == 0).select("query_id", "id", "score")
    bare = q.where("size(_tokens) = 0 and size(_tags) > 0").select("query_id", "_tags", F.col("_tags")[0].alias("tag"))
    by_tag = tagged.select("id", "_has", F.explode(F.array_distinct("_has")).alias("tag")).join(F.broadcast(bare), "tag").where(F.size(F.array_except("_tags", "_has")) == 0)
    return kept.union(by_tag.select("query_id", "id", F.lit(0).cast("long").alias("score")))


def _ranked(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores(queries, chunks).withColumn("rank", F.row_number().over(w))


def top(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` chunks of each query, by score, then id."""
    return _ranked(queries, chunks).where(F.col("rank") <= limit)


def route(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """A fixed route of queries with limits, concatenated; a chunk keeps its first place."""
    found = _ranked(queries, chunks).join(F.broadcast(queries.select("query_id", "limit")), "query_id").where(F.col("rank") <= F.col("limit"))
    return found.groupBy("id").agg(F.min(F.struct("query_id", "rank")).alias("p")).select("id", F.col("p.query_id").alias("query_id"), F.col("p.rank").alias("rank"))


def preferred(candidates: DataFrame, key: str) -> DataFrame:
    """Per key the selected candidate, else the most confident; the first wins a tie."""
    best = candidates.groupBy(key).agg(F.max(F.struct(F.col("selected").cast("int").alias("s"), F.when(F.col("selected"), 0.0).otherwise(F.col("confidence")).alias("c"), (-F.col("position")).alias("p"), F.col("text").alias("text"))).alias("b"))
    return best.select(key, F.col("b.text").alias("text"), (-F.col("b.p")).alias("position"))
