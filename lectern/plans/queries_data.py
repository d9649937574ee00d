"""Queries over manifests and texts: splits, duplicates, leaks, filters, tokens, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import hashing, text
from lectern.operators import filters, ranking, splits
from lectern.plans import fixtures as fx
from lectern.plans.fixtures import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {fx.MANIFEST_SQL}, firsts AS (SELECT sha, min(doc_id) AS f FROM manifest GROUP BY sha), uniq AS (SELECT m.* FROM manifest m JOIN firsts ON m.sha = firsts.sha AND m.doc_id = f),
spread AS (SELECT source FROM uniq GROUP BY source HAVING count(DISTINCT id_split) > 1), hot AS (SELECT sha FROM manifest GROUP BY sha HAVING count(DISTINCT id_split) > 1)
SELECT split, lang, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM uniq WHERE sha NOT IN (SELECT sha FROM hot) GROUP BY split, lang""")
def corpus_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash splits of unique documents, without content that an id-based split would have leaked."""
    m = fx.manifest(spark, sf_dir)
    clean = splits.without_leaks(splits.mark_duplicates(m, "sha", "doc_id").where("duplicate_of is null"), "sha", "split")
    clean = clean.join(splits.leaked(m, "sha", "id_split").select("sha"), "sha", "left_anti")
    return clean.groupBy("split", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


@query(f"WITH {fx.MANIFEST_SQL} SELECT doc_id, split FROM manifest")
def split_hash_70_85(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.manifest(spark, sf_dir).select("doc_id", "split")


@query(f"WITH {fx.MANIFEST_SQL} SELECT doc_id, id_split FROM manifest")
def split_hash_80_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.manifest(spark, sf_dir).select("doc_id", "id_split")


_SEEDED = fx.ranges_sql(fx.bucket_sql("'families' || chr(0) || '7' || chr(0) || source") + " % 100", 80, 90)


@query(f"SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'test' WHEN source = 'src3' THEN 'train' ELSE {_SEEDED} END AS split FROM documents")
def split_seeded_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen documents, then a frozen family, then the family's hash."""
    split = hashing.split_with_precedence(F.when(F.col("doc_id") % 50 == 0, "test"), F.when(F.col("source") == "src3", "train"), F.col("source"), F.col("doc_id").cast("string"), "families", 7)
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("split"))


@query("SELECT doc_id, " + fx.ranges_sql(fx.bucket_sql("'11:' || CAST(doc_id AS VARCHAR)", 2), 204, 230) + " AS split FROM documents")
def split_first_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.split_by_first_byte("doc_id", 11).alias("split"))


@query(f"WITH {fx.MANIFEST_SQL} SELECT doc_id, CASE WHEN f < doc_id THEN f END AS duplicate_of FROM manifest JOIN (SELECT sha, min(doc_id) AS f FROM manifest GROUP BY sha) USING (sha)")
def dedupe_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.mark_duplicates(fx.manifest(spark, sf_dir), "sha", "doc_id").select("doc_id", "duplicate_of")


@query(f"WITH {fx.MANIFEST_SQL} SELECT sha, count(*) AS copies, min(doc_id) AS first_id FROM manifest GROUP BY sha HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.duplicate_groups(fx.manifest(spark, sf_dir), "sha", "doc_id")


@query(f"WITH {fx.MANIFEST_SQL}, j AS (SELECT sha, doc_id, quality FROM manifest JOIN labels USING (doc_id)), f AS (SELECT sha, arg_min(quality, doc_id) AS first_target FROM j GROUP BY sha) SELECT sha, any_value(first_target) AS first_target, count(*) FILTER (quality <> first_target) AS conflicts FROM j JOIN f USING (sha) GROUP BY sha")
def dedupe_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = fx.manifest(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return splits.conflicting_targets(j, "sha", "doc_id", F.col("quality"))


@query(f"WITH {fx.MANIFEST_SQL} SELECT sha, count(DISTINCT id_split) AS n_splits FROM manifest GROUP BY sha HAVING count(DISTINCT id_split) > 1")
def leak_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leaked(fx.manifest(spark, sf_dir), "sha", "id_split")


@query(f"WITH {fx.MANIFEST_SQL} SELECT id_split, count(*) AS kept FROM manifest WHERE sha NOT IN (SELECT sha FROM manifest GROUP BY sha HAVING count(DISTINCT id_split) > 1) GROUP BY id_split")
def leak_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.without_leaks(fx.manifest(spark, sf_dir), "sha", "id_split").groupBy("id_split").agg(F.count("*").alias("kept"))


@query(f"WITH {fx.MANIFEST_SQL} SELECT 'owner_in_several_splits' AS rule, sha AS \"key\", string_agg(DISTINCT id_split, ',' ORDER BY id_split) AS detail FROM manifest GROUP BY sha HAVING count(DISTINCT id_split) > 1")
def split_isolation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.isolation_violations(fx.manifest(spark, sf_dir), "sha", "id_split")


@query(f"WITH {fx.MANIFEST_SQL} SELECT split, count(*) AS documents, count(DISTINCT sha) AS unique_documents, sum(n_chars)::BIGINT AS characters, count(DISTINCT source) AS families FROM manifest GROUP BY split")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.manifest(spark, sf_dir).groupBy("split").agg(F.count("*").alias("documents"), F.count_distinct("sha").alias("unique_documents"), F.sum("n_chars").alias("characters"), F.count_distinct("source").alias("families"))


@query("SELECT count(*) AS jobs, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('view', 'click')) AS completed, count(*) / (greatest(1, date_diff('second', min(ts), max(ts))) / 3600.0) AS per_hour FROM events")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and throughput of a run."""
    span = F.greatest(F.lit(1), F.timestamp_diff("SECOND", F.date_trunc("second", F.min("ts")), F.date_trunc("second", F.max("ts"))))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("jobs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type").isin("view", "click")).alias("completed"), (F.count("*") / (span / 3600.0)).alias("per_hour"))


_DICT = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,|"
_DICT_SQL = "'[^" + "a-zA-Z .,|" + "]'"


@query(f"WITH {fx.LINES_SQL}, r AS (SELECT CASE WHEN length(line) < 2 OR NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]') THEN 'empty_or_symbol_only' WHEN length(line) > 200 THEN 'too_long' WHEN regexp_matches(line, {_DICT_SQL}) THEN 'unsupported_character' ELSE 'accepted' END AS reason FROM lines) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def reject_reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = filters.line_reason(F.col("line"), F.lit(list(_DICT)), 200)
    return fx.lines(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.LINES_SQL}, s AS (SELECT split, regexp_matches(line, {_DICT_SQL}) AS bad FROM lines JOIN (SELECT doc_id, {fx.ranges_sql(fx.bucket_sql('CAST(doc_id AS VARCHAR)') + ' % 100', 80, 90)} AS split FROM documents) USING (doc_id)) SELECT split, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected FROM s GROUP BY split")
def dictionary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = filters.unsupported(F.col("line"), F.lit(list(_DICT)))
    found = fx.lines(spark, sf_dir).select(hashing.split_by_id("doc_id").alias("split"), bad.alias("bad"))
    return found.groupBy("split").agg(F.count_if(~F.col("bad")).alias("accepted"), F.count_if("bad").alias("rejected"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'answer_key' ELSE CASE p_partkey % 5 WHEN 0 THEN 'source_pdf' WHEN 1 THEN 'editable_reference' WHEN 2 THEN 'image_reference' ELSE 'unsupported' END END AS role FROM part")
def role_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.lit([".PDF", ".docx", ".png", ".exe", ""]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", filters.file_role(F.concat("p_name", ext), "ring").alias("role"))


@query(f"WITH {fx.LINES_SQL}, q AS (SELECT trim(line) AS t, {fx.score_sql('doc_id * 1000 + pos')} AS c FROM lines), r AS (SELECT CASE WHEN length(t) NOT BETWEEN 2 AND 60 THEN 'length' WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]') THEN 'no_alphanumeric' WHEN c < 0.5 THEN 'confidence' ELSE 'accepted' END AS reason FROM q) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def silver_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.functions.geometry import Box

    wide = Box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(20.0))
    none = F.array().cast("array<string>")
    c = hashing.unit_score(F.col("doc_id") * 1000 + F.col("pos"))
    reason = filters.label_reason(F.col("line"), c, F.lit(1.0), none, wide, least_confidence=0.5)
    return fx.lines(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_RATIO = "len(regexp_extract_all(text, '{}')) / greatest(1, length(text))::DOUBLE"


@query("SELECT doc_id, least(1.0, length(text) / 1000.0) AS length_ratio, " + ", ".join(f"{_RATIO.format(p)} AS {n}" for n, p in (("hangul_ratio", "[가-힣]"), ("digit_ratio", "\\p{Nd}"), ("latin_ratio", "[A-Za-z]"), ("symbol_ratio", "[^\\p{L}\\p{N}\\s\\x0B\\x{85}\\p{Z}]"))) + " FROM documents")
def char_class_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *text.character_features("text", 1000))


#: White space of any kind, and the characters that a line may hold, as DuckDB writes them.
_BLANK = "[\\s\\x0B\\x{85}\\p{Z}]"
_EXPECTED = text.EXPECTED.removeprefix("(?U)").replace("'", "''")


@query(
    f"WITH {fx.LINES_SQL}, v AS (SELECT doc_id, pos, {fx.score_sql('doc_id * 1000 + pos')} AS c, regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM lines), u AS (SELECT *, regexp_replace(t, '{_BLANK}+', '', 'g') AS vis FROM v) "
    f"SELECT doc_id, pos, round(CASE WHEN vis = '' THEN 0 ELSE greatest(0, least(1, c * 0.52 + len(regexp_extract_all(vis, '{_EXPECTED}')) / length(vis)::DOUBLE * 0.28 + 0.06 + least(1.0, length(vis) / 8.0) * 0.08 "
    f"- len(regexp_extract_all(vis, '[\\p{{Cc}}\\p{{Co}}]')) * 0.25 - (length(t) - length(replace(t, chr(65533), ''))) * 0.3 "
    # each Hangul letter is doubled, so that matches do not overlap
    f"- (len(regexp_extract_all(t, '\\?{{2,}}')) + len(regexp_extract_all(regexp_replace(t, '([{text.HANGUL}])', '\\1\\1', 'g'), '[{text.HANGUL}]\\?[{text.HANGUL}]'))) * 0.12 "
    + "".join(f"- CASE WHEN abs((length(t) - length(replace(t, '{a}', ''))) - (length(t) - length(replace(t, '{b}', '')))) > 1 THEN 0.03 ELSE 0 END " for a, b in ("()", "[]", "<>"))
    + ")) END, 9) AS quality FROM u"
)
def text_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition quality of every line."""
    q = text.quality_score("line", hashing.unit_score(F.col("doc_id") * 1000 + F.col("pos")))
    return fx.lines(spark, sf_dir).select("doc_id", "pos", F.round(q, 9).alias("quality"))


@query("WITH t AS (SELECT lower(unnest(regexp_extract_all(text, '([0-9A-Za-z가-힣]+)', 1))) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY token) SELECT token, n FROM c WHERE n >= 2 ORDER BY n DESC, token LIMIT 50000")
def token_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tokens: the report is a top list."""
    t = table(spark, sf_dir, "documents").select(F.explode(text.tokens("text")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "token").limit(50_000)


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '([0-9A-Za-z가-힣]+)', 1)) AS n_tokens FROM conversations")
def token_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.tokens("text")).alias("n_tokens"))


@query("""WITH v(id, line) AS (SELECT p_partkey, p_size || '. ' || p_name || ' [' || (p_partkey % 9) || '점] ① ㉠' FROM part) SELECT id, 'question:' || split_part(line, '.', 1) || '|score:' || (id % 9) || '|circled:①|hangul:㉠' AS tokens FROM v""")
def typed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_name", F.lit(" ["), (F.col("p_partkey") % 9).cast("string"), F.lit("점] ① ㉠"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.critical_tokens(line), "|").alias("tokens"))


_QUERIES_SQL = "q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM benchmark)"
_SCORES_SQL = f"""{fx.CHUNKS_SQL}, {_QUERIES_SQL},
wanted AS (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(query, '([0-9A-Za-z가-힣]+)', 1))) AS token FROM q),
fields AS (SELECT DISTINCT id, 8 AS w, lower(unnest(regexp_extract_all(array_to_string(tags, ' '), '([0-9A-Za-z가-힣]+)', 1))) AS token FROM chunks UNION ALL SELECT DISTINCT id, 4, lower(unnest(regexp_extract_all(title, '([0-9A-Za-z가-힣]+)', 1))) FROM chunks
  UNION ALL SELECT DISTINCT id, 3, lower(unnest(regexp_extract_all(section, '([0-9A-Za-z가-힣]+)', 1))) FROM chunks UNION ALL SELECT DISTINCT id, 1, lower(unnest(regexp_extract_all(text, '([0-9A-Za-z가-힣]+)', 1))) FROM chunks),
met AS (SELECT query_id, id, sum(w) AS s FROM wanted JOIN fields USING (token) GROUP BY query_id, id),
phrased AS (SELECT *, trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS phrase FROM q WHERE query_id IN (SELECT query_id FROM wanted)),
held AS (SELECT query_id, id, CASE WHEN contains(lower(title), phrase) THEN 3 ELSE 0 END + CASE WHEN contains(lower(section), phrase) THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), phrase) THEN 1 ELSE 0 END AS s FROM phrased, chunks WHERE phrase <> ''),
scores AS (SELECT query_id, id, CAST(sum(s) AS BIGINT) AS score FROM (SELECT * FROM met UNION ALL SELECT * FROM held WHERE s > 0) GROUP BY query_id, id)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), first.alias("query"), F.array().cast("array<string>").alias("tags"))


@query(f"WITH {_SCORES_SQL} SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores) WHERE rank <= 6")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(_queries(spark, sf_dir), fx.chunks(spark, sf_dir), 6)


@query(f"WITH {_SCORES_SQL}, tagged AS (SELECT scores.* FROM scores JOIN chunks USING (id) WHERE query_id < 3 AND list_contains(tags, 'Long') AND list_contains(tags, 'en')), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM tagged), f AS (SELECT id, query_id, rank, row_number() OVER (PARTITION BY id ORDER BY query_id, rank) AS k FROM r WHERE rank <= 2 + query_id) SELECT id, query_id, rank FROM f WHERE k = 1")
def retrieve_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries with tags and limits: the route is what the query is."""
    q = _queries(spark, sf_dir).where("query_id < 3").withColumns({"tags": F.lit(["long", "EN"]), "limit": F.col("query_id") + 2})
    return ranking.route(q, fx.chunks(spark, sf_dir))


@query()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text("html").alias("visible"))


@query()
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks with content ids."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.overlapping_chunks("text", 1000, 120)).alias("pos", "chunk"))
    return cut.withColumn("chunk_id", hashing.short_id("doc_id", "pos", "chunk"))


@query()
def split_lines_55(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training lines, each text kept once: at the first document and place that has it; places count the kept lines of a document."""
    from pyspark.sql import Window

    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.training_lines("text")).alias("pos", "line"))
    kept = cut.groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("f")).select("f.doc_id", "f.pos", "line")
    return kept.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int"))  # a document's lines


@query("WITH k AS (SELECT page_id, regexp_extract(url, '([^/?#]*)$', 1) AS x FROM pages), n AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'target' ELSE 'source' END AS side, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '[^0-9A-Za-z가-힣]', '', 'g')) AS key, length(html) AS n FROM pages) SELECT a.key, a.page_id AS source_id, b.page_id AS target_id, b.n < greatest(1, a.n // 2000) * 180 AS sparse FROM n a JOIN n b ON a.key = b.key AND a.side = 'source' AND b.side = 'target'")
def filename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and targets of one normalised name, with the sparse-target test."""
    p = table(spark, sf_dir, "pages").select("page_id", text.name_key(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("key"), F.length("html").alias("n"))
    from lectern.operators import joins

    pairs = joins.name_pairs(p.where("page_id % 3 <> 0"), p.where("page_id % 3 = 0"), "key")
    pages = F.greatest(F.lit(1), F.floor(F.col("n") / 2000))
    return pairs.select("key", F.col("page_id").alias("source_id"), F.col("t_page_id").alias("target_id"), filters.too_sparse(F.col("t_n"), F.lit(0), pages).alias("sparse"))


@query("WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents), b AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS ch, unnest(range(0, 26)) AS i) SELECT ch, CAST(row_number() OVER (ORDER BY coalesce(i, 26), ch) - 1 AS INT) AS pos FROM (SELECT ch, i FROM b UNION ALL SELECT ch, NULL FROM c WHERE ch NOT IN (SELECT ch FROM b) AND ch <> '')")
def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base dictionary's order, then the missing characters of the corpus, sorted."""
    from pyspark.sql import Window

    base = spark.createDataFrame([(c, i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")], "ch string, i int")
    seen = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").distinct()
    both = base.union(seen.join(base.select("ch"), "ch", "left_anti").select("ch", F.lit(None).cast("int").alias("i")))
    return both.select("ch", (F.row_number().over(Window.orderBy(F.coalesce("i", F.lit(26)), "ch")) - 1).cast("int").alias("pos"))  # a row per character
