"""Queries that evaluate documents, tables, formulas and models, and those of votes, look-ups and job queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluation as ev
from lectern.plans import fixtures as fx
from lectern.plans.fixtures import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Amounts of one document, as expressions over ``orders`` that Spark and DuckDB read alike.
AMOUNTS = {
    "text_edits": "o_orderkey % 7", "text_slots": "50 + o_custkey % 10", "critical_edits": "o_orderkey % 2", "critical_slots": "o_orderkey * 0",
    "order_exact": "o_orderkey % 2", "order_tau": "(o_orderkey % 5) / 4.0", "tables_exact": "CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END", "tables": "o_orderkey % 3",
    "formulas_found": "least(o_orderkey % 4, 2)", "formulas": "o_orderkey % 4", "formula_similarity": "(o_orderkey % 4) * 0.25",
}
_MICRO = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, {'count(*)' if whole is None else f'sum({whole})::BIGINT'} AS samples, sum({part})::DOUBLE / nullif({'count(*)' if whole is None else f'sum({whole})'}, 0) AS value FROM d"
    for name, part, whole in ev.MICRO_METRICS
)


@query(
    f"WITH d AS (SELECT {', '.join(f'{e} AS {n}' for n, e in AMOUNTS.items())} FROM orders), r AS (SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 4 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS b FROM orders), "
    "l AS (SELECT a AS label FROM r UNION SELECT b FROM r), f AS (SELECT label, 2.0 * count(*) FILTER (a = label AND b = label) / (count(*) FILTER (a = label) + count(*) FILTER (b = label)) AS f1 FROM l, r WHERE a = label OR b = label GROUP BY label) "
    f"{_MICRO} UNION ALL SELECT 'role_macro_f1', (SELECT count(*) FROM r), avg(f1) FROM f"
)
def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    guess = F.when(F.col("o_orderkey") % 4 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    return ev.micro_metrics(o.selectExpr(*[f"{e} AS {n}" for n, e in AMOUNTS.items()]), o.select(F.col("o_orderpriority").alias("reference"), guess.alias("prediction")))


@query(
    "WITH c AS (SELECT l_orderkey AS id, list_sort(list((l_linenumber, l_partkey % 4, 1 + l_suppkey % 2, 1))) AS want, list_sort(list((l_linenumber, l_partkey % 4 + (CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END), 1 + l_suppkey % 2, 1))) AS got FROM lineitem GROUP BY 1), "
    "t AS (SELECT o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND want IS NOT DISTINCT FROM got AS ok FROM orders LEFT JOIN c ON id = o_orderkey) SELECT count(*) AS samples, count(*) FILTER (ok) AS exact, count(*) FILTER (ok) / count(*) AS exact_rate FROM t"
)
def table_topology_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables and their lines as cells; some are not found, some have another size or other cells."""
    tables = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey % 9 AS n_rows", "4 AS n_columns")
    found = tables.where("id % 7 <> 0").withColumn("n_columns", F.expr("CASE WHEN id % 11 = 0 THEN 5 ELSE 4 END"))
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS row", "l_partkey % 4 AS column", "1 + l_suppkey % 2 AS row_span", "1 AS column_span")
    return ev.topology_exact(tables, cells, found, cells.withColumn("column", F.expr("column + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END")))


@query(
    "WITH p AS (SELECT p_partkey AS k, replace(p_name || '=' || p_size, ' ', '') AS a FROM part), q AS (SELECT *, CASE WHEN k % 7 = 0 THEN '' ELSE replace(a, 'a', '') END AS b FROM p), "
    "s AS (SELECT k % 3 <> 0 AS hit, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 AND b <> '' THEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) ELSE 0 END AS s FROM q) "
    "SELECT count(*) AS samples, count(*) FILTER (hit) AS detected, count(*) FILTER (hit) / count(*) AS recall, sum(s) / count(*) AS similarity FROM s"
)
def formula_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of which a third is not found, a fifth has another format and a seventh is blank."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "'latex' AS format", "p_name || ' = ' || p_size AS expression")
    found = p.where("id % 3 <> 0").selectExpr("id", "CASE WHEN id % 5 = 0 THEN 'mathml' ELSE format END AS format", "CASE WHEN id % 7 = 0 THEN ' ' ELSE replace(expression, 'a', '') END AS expression")
    return ev.formula_scores(p, found)


@query("SELECT sum(o_orderkey % 5)::BIGINT AS mismatched, sum(least(o_orderkey % 5, o_custkey % 3))::BIGINT AS routed, sum(least(o_orderkey % 5, o_custkey % 3)) / sum(o_orderkey % 5) AS recall FROM orders")
def high_risk_review_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.review_recall(table(spark, sf_dir, "orders").selectExpr("o_orderkey % 5 AS mismatched", "least(o_orderkey % 5, o_custkey % 3) AS routed"))


#: Predictions of a formula model, as expressions over ``lineitem``.
PREDICTIONS = {
    "model": "concat('m', l_suppkey % 3)", "expression": "CASE WHEN l_linenumber = 3 THEN '' ELSE 'x' END", "error": "CASE WHEN l_returnflag = 'A' THEN 'timeout' END", "seconds": "(l_partkey % 10) / 8.0",
    "exact_match": "CASE WHEN l_linestatus = 'F' THEN l_quantity > 25 END", "similarity": "(l_suppkey % 9) / 8.0",
}


@query(
    f"WITH p AS (SELECT {', '.join(f'{e} AS {n}' for n, e in PREDICTIONS.items())} FROM lineitem), g AS (SELECT *, expression <> '' AND error IS NULL AS good FROM p), s AS (SELECT model, count(*) AS samples, count(*) FILTER (good) AS successful, count(*) FILTER (good AND exact_match IS NOT NULL) AS evaluated_targets, "
    "count(*) FILTER (good AND exact_match) AS e, sum(similarity) FILTER (good AND exact_match IS NOT NULL) AS l, sum(seconds) FILTER (good) AS t FROM g GROUP BY model) "
    "SELECT model, samples, successful, samples - successful AS errors, round(coalesce(t, 0)::DOUBLE / greatest(1, successful), 4) AS average_inference_seconds, evaluated_targets, round(e::DOUBLE / nullif(evaluated_targets, 0), 6) AS exact_match_rate, round(l::DOUBLE / nullif(evaluated_targets, 0), 6) AS normalized_edit_similarity FROM s"
)
def formula_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PREDICTIONS.items()])
    return ev.model_summary(predictions.withColumn("seconds", F.col("seconds").cast("double")).withColumn("similarity", F.col("similarity").cast("double")))


@query("WITH v AS (SELECT l_partkey AS grp, l_suppkey % 5 AS page, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, page) AS k FROM v) SELECT grp, page FROM r WHERE k = 1")
def majority_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.majority_page(table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS grp", "l_suppkey % 5 AS page"), "grp", "page")


@query("SELECT l_partkey AS grp, format('{:.6f}', coalesce(sum(((l_suppkey % 9) / 8.0) * (l_linenumber - 1))::DOUBLE / nullif(sum(l_linenumber - 1), 0), 0))::DOUBLE AS score FROM lineitem GROUP BY 1")
def length_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "grp")
    return ev.weighted_score(cells, "grp", F.col("l_suppkey") % 9 / F.lit(8.0), F.col("l_linenumber") - 1)


@query("SELECT c_custkey, count(o_orderkey) AS n_parts, coalesce(sum((o_orderkey % 100) / 100.0)::DOUBLE / greatest(1, count(o_orderkey)), 0) AS confidence FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ev.mean_confidence(table(spark, sf_dir, "customer"), parts, "c_custkey", F.col("o_orderkey") % 100 / F.lit(100.0))


@query("SELECT doc_id, lang, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'gold' ELSE 'source' END AS role, CASE WHEN l.doc_id IS NOT NULL AND toxic = 1 THEN 'test' ELSE 'part' || (doc_id % 3) END AS split FROM documents LEFT JOIN labels l USING (doc_id)")
def configured_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and splits that the labels name, computed ones for the rest."""
    given = table(spark, sf_dir, "labels").selectExpr("doc_id", "CASE WHEN quality = 1 THEN 'gold' END AS role", "CASE WHEN toxic = 1 THEN 'test' END AS split")
    computed = {"role": F.lit("source"), "split": F.concat(F.lit("part"), (F.col("doc_id") % 3).cast("string"))}
    return ev.configured(table(spark, sf_dir, "documents").select("doc_id", "lang"), given, "doc_id", computed)


_JOBS = "o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'QUEUED' ELSE 'OCR' END AS status, o_orderdate AS created_at"


@query(f"SELECT {_JOBS} FROM orders")
def jobs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.newest_first(table(spark, sf_dir, "orders").selectExpr(*_JOBS.split(", ")))


@query(f"WITH j AS (SELECT {_JOBS} FROM orders) SELECT id, CASE status WHEN 'OCR' THEN 'RETRYING' ELSE status END AS status, created_at FROM j WHERE status <> 'COMPLETED'")
def recovery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recovery_queue(table(spark, sf_dir, "orders").selectExpr(*_JOBS.split(", ")))


_MESSAGE = "CASE event_id % 5 WHEN 0 THEN 'detecting tables' WHEN 1 THEN 'now verifying in Hancom' WHEN 2 THEN 'idle' ELSE concat('Page  ', event_id % 10, '/', user_id % 4, ' done') END"


@query(
    f"WITH m AS (SELECT event_id, {_MESSAGE} AS m FROM events), x AS (SELECT event_id, m, try_cast(regexp_extract(m, '(?i)page\\s+(\\d+)/(\\d+)', 1) AS DOUBLE) AS a, try_cast(regexp_extract(m, '(?i)page\\s+(\\d+)/(\\d+)', 2) AS DOUBLE) AS n FROM m) "
    "SELECT event_id, CASE WHEN n IS NOT NULL THEN 'OCR' WHEN contains(m, 'detecting tables') THEN 'STRUCTURING' WHEN contains(m, 'verifying in Hancom') THEN 'VALIDATING' END AS stage, "
    "CASE WHEN n = 0 THEN 0.7::DOUBLE WHEN n IS NOT NULL THEN least(0.7::DOUBLE, 0.1 + a / n * 0.6) WHEN contains(m, 'detecting tables') THEN 0.74 WHEN contains(m, 'verifying in Hancom') THEN 0.9 END AS progress, n::BIGINT AS page_count FROM x"
)
def message_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "events").selectExpr("event_id", f"{_MESSAGE} AS m")
    return messages.select("event_id", *ev.message_progress(F.col("m")))


_EXPRESSION = "CASE p_partkey % 5 WHEN 0 THEN concat('x^{', p_size, '}') WHEN 1 THEN concat('}', p_size, '{') WHEN 2 THEN concat('a; b', p_size) WHEN 3 THEN concat('{', p_name) ELSE p_name END"


@query(
    f"WITH e AS (SELECT p_partkey, {_EXPRESSION} AS e FROM part) SELECT p_partkey, regexp_full_match(e, '[A-Za-z0-9\\s{{}}_^+*/=().,|<>\\[\\]-]+') AND length(replace(e, '{{', '')) = length(replace(e, '}}', '')) "
    "AND list_min(list_transform(range(1, length(e) + 1), lambda i: length(replace(substr(e, 1, i), '}', '')) - length(replace(substr(e, 1, i), '{', '')))) >= 0 AS safe FROM e"
)
def safe_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_EXPRESSION} AS e").select("p_partkey", ev.safe_latex(F.col("e")).alias("safe"))


@query(
    f"WITH {fx.ORDERED_SQL}, t AS (SELECT grp, ref, list_transform(range(1, grp % 5 + 2), lambda x: 'w' || x) AS words, count(*) OVER (PARTITION BY grp) AS n FROM ordered) "
    "SELECT grp, ref, CASE WHEN n > 1 AND len(words) = n THEN words[ref] ELSE array_to_string(words, ' ') END AS line FROM t"
)
def shared_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that share a line of one to five words."""
    line = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("grp") % 5 + 1), lambda x: F.concat(F.lit("w"), x.cast("string"))), " ")
    return ev.cell_texts(fx.ordered(spark, sf_dir).select("grp", "ref", line.alias("line")), "grp", "ref", "line")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS change FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 5 = 0 AND text <> '') UNION ALL SELECT -1 - doc_id, 'added' FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all texts before and after some are lost, emptied or come in addition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = docs.where("doc_id % 7 <> 0")
    after = left.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text"))).union(left.where("doc_id % 11 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    digest = F.sha2("text", 256).alias("digest")
    return ev.snapshot_changes(docs.select("doc_id", digest), after.select("doc_id", digest), "doc_id", "digest")


@query()
def distinct_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision depends on the regions kept before, so there is no SQL."""
    return ev.distinct_regions(fx.regions(spark, sf_dir), "page")
