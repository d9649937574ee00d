"""Queries that evaluate predictions, scores and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import gates, metrics
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


#: A reading that lacks letters only has as many errors as letters are gone, which SQL can count for any text.
_WHOLE_SQL = f"WITH {fx.LINES_SQL}, noisy AS (SELECT nfc_normalize(line) AS ref, nfc_normalize(replace(line, 'e', '')) AS pred FROM lines), s AS (SELECT *, length(ref) - length(pred) AS gone, regexp_replace(ref, '\\s+', '', 'g') AS bare FROM noisy)"


@query(f"{_WHOLE_SQL} SELECT sum(gone)::BIGINT AS errors, sum(length(ref))::BIGINT AS characters, sum(gone) / sum(length(ref)) AS cer FROM s")
def cer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.corpus_cer(fx.noisy_whole(spark, sf_dir), "ref", "pred")


@query(f"{_WHOLE_SQL} SELECT sum(gone)::BIGINT AS errors, sum(length(bare))::BIGINT AS characters, sum(gone) / greatest(1, sum(length(bare))) AS cer FROM s")
def cer_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.benchmark_cer(fx.noisy_whole(spark, sf_dir), "ref", "pred")


@query(f"{_WHOLE_SQL} SELECT count(*) AS lines, count(*) FILTER (ref = pred) AS exact, count(*) FILTER (ref = pred) / count(*) AS exact_rate, sum(gone)::BIGINT AS errors, sum(gone) / sum(length(ref)) AS cer FROM s")
def recognizer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recognizer_metrics(fx.noisy_whole(spark, sf_dir), "ref", "pred")


@query("SELECT (count(*) FILTER (p_partkey % 2 = 1) + count(*) FILTER (p_partkey % 3 = 0))::BIGINT AS errors, 4 * count(*) AS tokens, (count(*) FILTER (p_partkey % 2 = 1) + count(*) FILTER (p_partkey % 3 = 0)) / (4 * count(*)) AS error_rate FROM part")
def critical_token_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with four typed tokens against a reading with another number on odd parts and no score on every third."""
    size, score = (lambda more: (F.col("p_size") + more).cast("string")), F.concat(F.lit(" ["), (F.col("p_partkey") % 9).cast("string"), F.lit("점]"))
    ref = F.concat(size(0), F.lit(". "), F.col("p_name"), score, F.lit(" ① ㉠"))
    pred = F.concat(size(F.col("p_partkey") % 2), F.lit(". "), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(score), F.lit(" ① ㉠"))
    return metrics.critical_token_error(table(spark, sf_dir, "part").select(ref.alias("ref"), pred.alias("pred")), "ref", "pred")


@query()
def cer_corpus_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cer_corpus`` under the name that its brute-force test uses."""
    return metrics.corpus_cer(fx.noisy_whole(spark, sf_dir), "ref", "pred")


@query()
def cer_benchmark_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cer_benchmark`` under the name that its brute-force test uses."""
    return metrics.benchmark_cer(fx.noisy_whole(spark, sf_dir), "ref", "pred")


@query()
def recognizer_metrics_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``recognizer_metrics`` under the name that its brute-force test uses."""
    return metrics.recognizer_metrics(fx.noisy_whole(spark, sf_dir), "ref", "pred")


@query(f"WITH {fx.GUESS_SQL}, l AS (SELECT lang AS label FROM guessed UNION SELECT guess FROM guessed), f AS (SELECT label, 2.0 * count(*) FILTER (lang = label AND guess = label) / (count(*) FILTER (lang = label) + count(*) FILTER (guess = label)) AS f1 FROM l, guessed WHERE lang = label OR guess = label GROUP BY label) SELECT count(*) AS labels, avg(f1) AS macro_f1 FROM f")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(fx.guessed(spark, sf_dir), "lang", "guess")


@query(f"WITH {fx.GUESS_SQL} SELECT lang AS reference, guess AS prediction, count(*) AS n FROM guessed GROUP BY lang, guess")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(fx.guessed(spark, sf_dir), "lang", "guess")


@query(f"WITH {fx.GUESS_SQL} SELECT count(*) AS items, count(*) FILTER (guess <> second) AS changed, count(*) FILTER (guess <> lang AND second = lang) AS improved, count(*) FILTER (guess = lang AND second <> lang) AS regressed, count(*) FILTER (guess = second AND guess = lang) AS unchanged_correct, count(*) FILTER (guess = second AND guess <> lang) AS unchanged_incorrect, count(*) FILTER (guess <> lang AND second = lang) - count(*) FILTER (guess = lang AND second <> lang) AS net FROM guessed")
def transition_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.transitions(fx.guessed(spark, sf_dir), "lang", "guess", "second")


@query(f"WITH {fx.GUESS_SQL} SELECT guess || '->' || second AS step, count(*) AS n FROM guessed WHERE guess <> second GROUP BY 1")
def override_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = fx.guessed(spark, sf_dir).where("guess <> second")
    return changed.groupBy(F.concat_ws("->", "guess", "second").alias("step")).agg(F.count("*").alias("n"))


_TAU = f"WITH {fx.ORDERED_SQL}, w AS (SELECT a.grp, count(*) FILTER (a.pred > b.pred) AS discordant FROM ordered a JOIN ordered b ON a.grp = b.grp AND a.ref < b.ref GROUP BY a.grp), t AS (SELECT grp, count(*) AS n, any_value(coalesce(discordant, 0)) AS discordant FROM ordered LEFT JOIN w USING (grp) GROUP BY grp), k AS (SELECT *, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE 1 - discordant / (n * (n - 1) / 2) END AS kendall, discordant = 0 AS exact FROM t) "


@query(_TAU + "SELECT grp, n, discordant, kendall, exact FROM k")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.order_agreement(fx.ordered(spark, sf_dir), "grp", "ref", "pred")


@query(_TAU + "SELECT count(*) AS documents, avg(kendall) AS kendall_mean, count(*) FILTER (exact) / count(*) AS exact_rate FROM k")
def order_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.order_agreement(fx.ordered(spark, sf_dir), "grp", "ref", "pred")
    return per.agg(F.count("*").alias("documents"), F.avg("kendall").alias("kendall_mean"), (F.count_if("exact") / F.count("*")).alias("exact_rate"))


_RANKED = f"WITH {fx.SCORED_SQL}, g AS (SELECT tied AS s, count(*) AS n, sum(y) AS pos FROM scored GROUP BY tied), r AS (SELECT *, sum(n) OVER (ORDER BY s) AS cn, sum(n) OVER (ORDER BY s DESC) AS dn, sum(pos) OVER (ORDER BY s DESC) AS dp FROM g) "


@query(_RANKED + "SELECT sum(pos)::BIGINT AS positives, sum(n - pos)::BIGINT AS negatives, (sum(pos * (cn - (n - 1) / 2)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(n - pos)) AS roc_auc FROM r")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(fx.scored(spark, sf_dir), "y", "tied")


@query(_RANKED + "SELECT sum(pos * dp / dn) / sum(pos) AS average_precision FROM r")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(fx.scored(spark, sf_dir), "y", "tied")


@query(_RANKED + ", c AS (SELECT s, dp / greatest(1, dn) AS p, dp / (SELECT sum(pos) FROM g) AS rec FROM r) SELECT s AS threshold, p AS precision, rec AS recall FROM c WHERE rec + 1e-12 >= 0.9 ORDER BY p DESC, s DESC LIMIT 1")
def threshold_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold: one row is the answer."""
    return metrics.select_threshold(fx.scored(spark, sf_dir), "y", "tied", 0.9)


@query(f"WITH {fx.SCORED_SQL}, c AS (SELECT count(*) AS samples, sum(y)::BIGINT AS errors, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, avg((score - y) * (score - y)) AS brier FROM scored), d AS (SELECT *, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall FROM c) SELECT samples, errors, precision, recall, 2 * precision * recall / greatest(1e-12, precision + recall) AS f1, brier FROM d")
def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_at(fx.scored(spark, sf_dir), "y", "score", 0.5)


_BINS = f"WITH {fx.SCORED_SQL}, b AS (SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, sum(score) AS cs, sum(y)::BIGINT AS ok FROM scored GROUP BY 1) "


@query(_BINS + "SELECT bin, n, cs AS confidence_sum, ok AS correct FROM b")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_bins(fx.scored(spark, sf_dir), "score", "y")


@query(_BINS + "SELECT sum(n)::BIGINT AS samples, sum(n * abs(cs / n - ok / n)) / sum(n) AS ece FROM b")
def ece_10bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expected_calibration_error(fx.scored(spark, sf_dir), "score", "y")


@query("WITH p AS (SELECT l_orderkey + 1 AS k, l_partkey % 50 AS c FROM lineitem), a AS (SELECT l_orderkey AS k, l_partkey % 50 AS c FROM lineitem), x AS (SELECT k, c, count(*) AS n FROM a GROUP BY k, c), y AS (SELECT k, c, count(*) AS m FROM p GROUP BY k, c), j AS (SELECT coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM x FULL JOIN y USING (k, c)), s AS (SELECT sum(least(n, m))::BIGINT AS matched, sum(greatest(n - m, 0))::BIGINT AS missing, sum(greatest(m - n, 0))::BIGINT AS extra FROM j) SELECT *, matched / (matched + extra) AS precision, matched / (matched + missing) AS recall, 2 * matched / (2 * matched + missing + extra) AS f1 FROM s")
def multiset_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("c"))
    return metrics.multiset_scores(a, a.withColumn("k", F.col("k") + 1), ["k", "c"])


@query("SELECT o_orderpriority, min(o_totalprice) AS min, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, max(o_totalprice) AS max, avg(o_totalprice) AS mean FROM orders GROUP BY 1")
def quantile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", [0.5, 0.95])


@query("SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q250, quantile_cont(o_totalprice, 0.5) AS q500, quantile_cont(o_totalprice, 0.7) AS q700, quantile_cont(o_totalprice, 0.95) AS q950, quantile_cont(o_totalprice, 0.995) AS q995 FROM orders GROUP BY 1")
def quantile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.linear_quantiles(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", [0.25, 0.5, 0.7, 0.95, 0.995])


@query("SELECT c_nationkey, c_mktsegment, count(*) AS lines, sum(l_quantity) AS quantity, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rollup_page_doc_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, document and corpus totals in one pass."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.count_distinct("o_orderkey").alias("orders"))


_LONG = "m AS (SELECT o_orderstatus AS split, count(*)::DOUBLE AS orders, avg(o_totalprice) AS mean_price, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE max(o_totalprice) END AS max_price FROM orders GROUP BY 1)"


@query(f"WITH {_LONG} SELECT split, metric_name, metric_value FROM m UNPIVOT (metric_value FOR metric_name IN (orders, mean_price, max_price))")
def metric_long_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(
        F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("mean_price"), F.when(F.first("o_orderstatus") != "F", F.max("o_totalprice")).alias("max_price")
    )
    return o.unpivot("split", ["orders", "mean_price", "max_price"], "metric_name", "metric_value").where("metric_value is not null")


@query(f"WITH {_LONG}, l AS (SELECT split, metric_name, metric_value FROM m UNPIVOT (metric_value FOR metric_name IN (orders, mean_price, max_price))) SELECT split, metric_name, metric_value FROM l WHERE split <> 'O' UNION ALL SELECT split, metric_name, metric_value FROM l WHERE split <> 'O'")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with repeats appended to a log that holds one split: stored keys go, repeats in the batch stay."""
    from lectern.operators.splits import idempotent_rows

    rows = _long(spark, sf_dir)
    return idempotent_rows(rows.union(rows), rows.where("split = 'O'"), ["split", "metric_name"])


_CHECKS = "checks AS (SELECT o_custkey AS owner, 'check' || (o_orderkey % 3) AS \"check\", CASE WHEN o_totalprice > 470000 THEN 'block' WHEN o_totalprice > 300000 THEN 'review' ELSE 'pass' END AS status FROM orders)"


@query(f"WITH {_CHECKS} SELECT owner, CASE WHEN bool_or(status = 'block') OR count(DISTINCT \"check\") < 3 THEN 'block' WHEN bool_or(status = 'review') THEN 'review' ELSE 'auto_pass' END AS outcome FROM checks GROUP BY owner")
def outcome_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    checks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.concat(F.lit("check"), (F.col("o_orderkey") % 3).cast("string")).alias("check"), F.when(p > 470000, "block").when(p > 300000, "review").otherwise("pass").alias("status"))
    return gates.outcome(checks, "owner", ["check0", "check1", "check2"])


#: Comparator and threshold of each gate of the example.
GATES = [("macro_f1", ">=", 0.5), ("roc_auc", ">=", 0.97), ("ece", "<=", 0.05), ("samples", "==", 399.0), ("absent", "<=", 1.0)]


@query(f"WITH {fx.SCORED_SQL}, m AS (SELECT 'samples' AS id, count(*)::DOUBLE AS value FROM scored UNION ALL SELECT 'ece', 0.04 UNION ALL SELECT 'macro_f1', 0.4 UNION ALL SELECT 'roc_auc', 0.97), g(id, comparator, threshold) AS (VALUES {', '.join(str(g) for g in GATES)}) SELECT id, comparator, threshold::DOUBLE AS threshold, value, CASE WHEN value IS NULL THEN id || '.unmeasured' WHEN (comparator = '<=' AND value <= threshold) OR (comparator = '>=' AND value >= threshold) OR (comparator = '==' AND value = threshold) THEN 'passed' ELSE id || '.failed' END AS status FROM g LEFT JOIN m USING (id)")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.createDataFrame(GATES, "id string, comparator string, threshold double")
    counted = fx.scored(spark, sf_dir).agg(F.count("*").cast("double").alias("value")).select(F.lit("samples").alias("id"), "value")
    given = spark.createDataFrame([("ece", 0.04), ("macro_f1", 0.4), ("roc_auc", 0.97)], "id string, value double")
    return gates.decide(g, counted.union(given))


@query("WITH s AS (SELECT label, count(*) AS pages, count(*) FILTER (e > 8) AS flagged, max(e) AS max_error, quantile_cont(e, 0.95) AS p95 FROM (SELECT label, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS e FROM embeddings) GROUP BY label) SELECT label, pages, flagged, flagged / greatest(1, pages) AS rate, round(max_error, 6) AS max_error, round(p95, 6) AS p95 FROM s")
def anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, flagged pages and error statistics of each group; the error is the squared norm."""
    e = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    s = table(spark, sf_dir, "embeddings").select("label", e.alias("e")).groupBy("label").agg(F.count("*").alias("pages"), F.count_if(F.col("e") > 8).alias("flagged"), F.max("e").alias("m"), F.expr("percentile(e, 0.95)").alias("q"))
    return s.select("label", "pages", "flagged", (F.col("flagged") / F.greatest(F.lit(1), "pages")).alias("rate"), F.round("m", 6).alias("max_error"), F.round("q", 6).alias("p95"))
