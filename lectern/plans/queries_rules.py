"""Queries that return violations, sequential operators, and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.hashing import unit_score
from lectern.operators import anomaly, constraints, grouped, ranking
from lectern.plans import fixtures as fx
from lectern.plans.fixtures import table
from lectern.plans.queries_layout import LEGAL
from lectern.streaming import jobs

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {fx.CELLS_SQL}, s AS (SELECT cells.*, n_rows, n_columns FROM cells JOIN tables USING (t)), o AS (SELECT t, count(*) AS n FROM s WHERE "row" + row_span > n_rows OR "column" + column_span > n_columns GROUP BY t),
p AS (SELECT t, unnest(range("row", "row" + row_span)) AS r, "column" AS c FROM s), k AS (SELECT t, r, c, count(*) AS n FROM p GROUP BY t, r, c), per AS (SELECT t, count(*) FILTER (n > 1) AS twice, count(*) AS covered FROM k GROUP BY t)
SELECT 'cell_out_of_bounds' AS rule, CAST(t AS VARCHAR) AS "key", CAST(n AS VARCHAR) AS detail FROM o UNION ALL SELECT 'cells_overlap', CAST(t AS VARCHAR), CAST(twice AS VARCHAR) FROM per WHERE twice > 0
UNION ALL SELECT 'grid_not_covered', CAST(t AS VARCHAR), CAST(n_rows * n_columns - coalesce(covered, 0) AS VARCHAR) FROM tables LEFT JOIN per USING (t) WHERE n_rows * n_columns > coalesce(covered, 0)""")
def grid_cover_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, cells = fx.grid(spark, sf_dir)
    return constraints.grid_violations(tables, cells, "t")


_REFS = "child AS (SELECT l_orderkey + CASE WHEN l_partkey % 97 = 0 THEN 100000000 ELSE 0 END AS ref FROM lineitem)"


@query(f"""WITH {_REFS} SELECT 'unknown_source' AS rule, CAST(ref AS VARCHAR) AS "key", CAST(NULL AS VARCHAR) AS detail FROM (SELECT DISTINCT ref FROM child) WHERE ref NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'duplicate_id', CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey * 8 + l_linenumber HAVING count(*) > 1""")
def evidence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that repeat and references without a source."""
    li = table(spark, sf_dir, "lineitem")
    child = li.select((F.col("l_orderkey") + F.when(F.col("l_partkey") % 97 == 0, 100_000_000).otherwise(0)).alias("ref"))
    unknown = constraints.dangling(child, "ref", table(spark, sf_dir, "orders"), "o_orderkey", "unknown_source")
    return unknown.union(constraints.not_unique(li, F.col("l_orderkey") * 8 + F.col("l_linenumber"), "duplicate_id"))


@query("""WITH need AS (SELECT DISTINCT c_custkey AS k FROM customer), have AS (SELECT o_custkey + CASE WHEN o_orderkey % 501 = 0 THEN 9000000 ELSE 0 END AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT 'owned_once' AS rule, CAST(k AS VARCHAR) AS "key", CASE WHEN need.k IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS detail FROM need FULL JOIN have USING (k) WHERE need.k IS NULL OR coalesce(n, 0) <> 1""")
def owner_cover_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    have = table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 501 == 0, 9_000_000).otherwise(0)).alias("k"))
    return constraints.not_exactly_covered(need, have, "k", "owned_once")


@query("""WITH o AS (SELECT user_id AS g, event_id AS i FROM events WHERE event_id % 97 <> 5), x AS (SELECT DISTINCT user_id AS g, event_id AS i FROM events) SELECT 'not_a_permutation' AS rule, CAST(g AS VARCHAR) AS "key", CAST(count(*) AS VARCHAR) AS detail FROM x WHERE i NOT IN (SELECT i FROM o) GROUP BY g""")
def permutation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("i"))
    return constraints.not_a_permutation(e.where("i % 97 <> 5"), e, "g", "i", "not_a_permutation")


_MANIFEST = "m AS (SELECT CASE WHEN doc_id % 100 = 1 THEN 'ID1' ELSE 'id' || doc_id END AS id, sha256(text) AS source_sha256, source || lang AS lineage_id, source AS family, CASE WHEN doc_id % 7 = 0 THEN 'test' ELSE 'train' END AS split, doc_id % 31 <> 0 AS verified, doc_id % 37 <> 0 AS rights FROM documents)"


@query(f"""WITH {_MANIFEST} SELECT 'duplicate_id' AS rule, lower(id) AS "key", CAST(count(*) AS VARCHAR) AS detail FROM m GROUP BY lower(id) HAVING count(*) > 1 UNION ALL SELECT 'duplicate_source', source_sha256, CAST(count(*) AS VARCHAR) FROM m GROUP BY source_sha256 HAVING count(*) > 1
UNION ALL SELECT 'not_verified', id, NULL FROM m WHERE NOT verified UNION ALL SELECT 'rights_not_verified', id, NULL FROM m WHERE NOT rights UNION ALL SELECT 'lineage_in_several_splits', lower(lineage_id), CAST(count(DISTINCT split) AS VARCHAR) FROM m GROUP BY lower(lineage_id) HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'family_in_test_and_development', lower(family), NULL FROM m GROUP BY lower(family) HAVING bool_or(split = 'test') AND bool_or(split <> 'test')""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    m = table(spark, sf_dir, "documents").select(
        F.when(d % 100 == 1, "ID1").otherwise(F.concat(F.lit("id"), d.cast("string"))).alias("id"), F.sha2("text", 256).alias("source_sha256"), F.concat("source", "lang").alias("lineage_id"),
        F.col("source").alias("family"), F.when(d % 7 == 0, "test").otherwise("train").alias("split"), (d % 31 != 0).alias("verified"), (d % 37 != 0).alias("rights"),
    )
    return constraints.manifest_violations(m)


@query(f"WITH {fx.LINES_SQL}, w AS (SELECT doc_id, sum(length(line)::BIGINT * length(line)) AS work FROM lines GROUP BY doc_id) SELECT 'comparison_over_budget' AS rule, CAST(doc_id AS VARCHAR) AS \"key\", CAST(work::BIGINT AS VARCHAR) AS detail FROM w WHERE work > 2000000")
def budget_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fx.lines(spark, sf_dir).select("doc_id", F.col("line").alias("a"), F.col("line").alias("b"))
    return constraints.over_budget(pairs, "doc_id", "a", "b", 2_000_000)


@query("WITH c AS (SELECT l_orderkey AS k, l_partkey % 3 = 0 AS sel, l_discount AS conf, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos, l_returnflag || l_partkey AS text FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sel DESC, CASE WHEN sel THEN 0 ELSE conf END DESC, pos) AS rn FROM c) SELECT k, text, pos AS position FROM r WHERE rn = 1")
def preferred_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected reading, else the most confident; the first wins a tie."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 3 == 0).alias("selected"), F.col("l_discount").alias("confidence"), pos.alias("position"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return ranking.preferred(c, "k")


@query("WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 = 0 THEN (turn // 4 + 1) || '. ' WHEN turn % 4 = 1 THEN '① ' WHEN turn % 4 = 2 THEN '- ' ELSE '' END AS head FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'question' WHEN turn % 4 = 1 AND turn > 0 THEN 'choice' ELSE 'unknown' END AS role FROM t")
def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of lines with question and choice marks put in front by rule."""
    from lectern.operators.windows import started

    turn = F.col("turn")
    head = F.when(turn % 4 == 0, F.concat((F.floor(turn / 4) + 1).cast("string"), F.lit(". "))).when(turn % 4 == 1, "① ").when(turn % 4 == 2, "- ").otherwise("")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, F.translate("text", "-―\n", "   "), F.when(turn % 4 == 2, ".").otherwise("")).alias("line"))
    s = started(t, "conv_id", "turn", text.question_number("line").isNotNull())
    return s.select("conv_id", "turn", text.line_role("line", F.col("started")).alias("role"))


@query()
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.blocks(spark, sf_dir).withColumns({"label": F.when(F.col("pk") % 2 == 0, "table").otherwise("image"), "confidence": unit_score(F.col("pk") * 10 + F.col("pos"))})
    return grouped.non_maximum_suppression(b.select("page", "pos", "label", "confidence", "x0", "y0", "x1", "y1"), "page", 0.1)


@query()
def mean_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.mean_clusters(fx.blocks(spark, sf_dir), "page", "y0", 60.0)


@query()
def question_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.floor(F.col("event_id") / 400) % 25 + F.col("event_id") % 3).cast("int").alias("number"))
    return grouped.question_starts(e, "user_id", "event_id", "number")


@query()
def hungarian_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("page"), (F.col("l_partkey") % 12).alias("gold"), (F.col("l_suppkey") % 10).alias("found"))
    return grouped.maximum_matching(li.groupBy("page", "gold", "found").agg(F.count("*").alias("shared")), "page", "gold", "found", "shared")


@query()
def cell_merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, _ = fx.grid(spark, sf_dir)
    cells = tables.select("t", "n_columns", F.explode(F.sequence(F.lit(0), F.col("n_rows") * F.col("n_columns") - 1)).alias("i"))
    cells = cells.selectExpr("t", "cast(floor(i / n_columns) as int) as r", "cast(i % n_columns as int) as c", "(t * 3 + i) % 4 = 0 as open_right", "(t + i * 5) % 6 = 0 as open_below")
    return grouped.rectangles(cells, "t")


@query()
def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.visual_rows(fx.blocks(spark, sf_dir), "page")


@query()
def regular_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.blocks(spark, sf_dir).select("page", ((F.col("y0") + F.col("y1")) / 2).alias("centre"), (F.col("y1") - F.col("y0")).alias("height"))
    return grouped.regular_runs(rows, "page", "centre", "height")


@query()
def job_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job logs through the state machine, illegal steps ignored; the batch twin of the stream."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return jobs.replay_jobs(e, "user_id", "event_type", "event_id", LEGAL)


@query()
def pca_reconstruction_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors under directions fitted on a training split, flagged over the 99.5 % quantile of training and validation."""
    from lectern.functions.hashing import split_by_id

    e = table(spark, sf_dir, "embeddings").withColumn("split", split_by_id("vec_id"))
    model = anomaly.fit(e.where("split = 'train'"), "embedding", 8)
    scored = e.select("vec_id", "label", "split", model.error(F.col("embedding")).alias("mse"))
    limit = anomaly.threshold(scored.where("split <> 'test'"), "mse")
    return scored.withColumn("flagged", F.col("mse") > F.lit(limit))
