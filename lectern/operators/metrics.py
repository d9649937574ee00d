"""Evaluation metrics as aggregates. A metric without its denominator is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import critical_tokens, nfc, nfkc, strip_space
from lectern.operators.cumulative import running_sums
from lectern.session import ship_package


def over(up: Column, down: Column) -> Column:
    """A ratio, null where the denominator is 0."""
    return F.when(down != 0, up / down)


def corpus_cer(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Edit errors over the sum of the longer lengths, in Unicode form C; white space counts."""
    ship_package(df.sparkSession)
    a, b = nfc(F.col(reference)), nfc(F.col(prediction))
    sums = df.agg(F.sum(F.levenshtein(a, b)).alias("errors"), F.sum(F.greatest(F.length(a), F.length(b))).alias("characters"))
    return sums.select("errors", "characters", over(F.col("errors"), F.col("characters")).alias("cer"))


def benchmark_cer(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Edit errors over the reference's length, in form KC, all white space removed; may exceed 1."""
    ship_package(df.sparkSession)
    a, b = strip_space(nfkc(F.col(reference))), strip_space(nfkc(F.col(prediction)))
    sums = df.agg(F.sum(F.levenshtein(a, b)).alias("errors"), F.sum(F.length(a)).alias("characters"))
    return sums.select("errors", "characters", (F.col("errors") / F.greatest(F.lit(1), F.col("characters"))).alias("cer"))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays: one row of the table is kept, as a fold over the other array."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda x, i: i)

    def row(before: Column, x: Column) -> Column:
        first = F.array(F.get(before, F.lit(0)) + 1)
        step = lambda r, i: F.concat(
            r, F.array(F.least(F.element_at(r, -1) + 1, F.get(before, i + 1) + 1, F.get(before, i) + F.when(F.get(b, i) == x, 0).otherwise(1)))
        )
        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(b) - 1, F.lit(0))), first, step)).otherwise(first)

    return F.element_at(F.aggregate(a, zero, row), -1)


def critical_token_error(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Edit errors of typed-token sequences over the sum of the longer lengths, in form C; null without a token on either side."""
    ship_package(df.sparkSession)
    rows = df.select(critical_tokens(nfc(F.col(reference))).alias("a"), critical_tokens(nfc(F.col(prediction))).alias("b"))
    sums = rows.agg(F.sum(token_distance(F.col("a"), F.col("b"))).cast("long").alias("errors"), F.sum(F.greatest(F.size("a"), F.size("b"))).alias("tokens"))
    return sums.select("errors", "tokens", over(F.col("errors"), F.col("tokens")).alias("error_rate"))


def recognizer_metrics(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Lines, exact lines and their share, character errors and rate."""
    a, b = F.col(reference), F.col(prediction)
    sums = df.agg(F.count("*").alias("lines"), F.count_if(a == b).alias("exact"), F.sum(F.levenshtein(a, b)).alias("errors"), F.sum(F.length(a)).alias("characters"))
    return sums.select("lines", "exact", over(F.col("exact"), F.col("lines")).alias("exact_rate"), "errors", over(F.col("errors"), F.col("characters")).alias("cer"))


def confusion(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Counts by pair of labels."""
    return df.groupBy(F.col(reference).alias("reference"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def label_scores(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Per label of either side: true positives, false positives, false negatives, F1."""
    pairs = confusion(df, reference, prediction)
    as_reference = pairs.select(F.col("reference").alias("label"), F.when(F.col("reference") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("reference") != F.col("prediction"), F.col("n")).otherwise(0).alias("fn"))
    as_prediction = pairs.where("reference <> prediction").select(F.col("prediction").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    sums = as_reference.union(as_prediction).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f1(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """Unweighted mean F1 over the labels of either side."""
    return label_scores(df, reference, prediction).agg(F.count("*").alias("labels"), F.avg("f1").alias("macro_f1"))


def order_agreement(df: DataFrame, group: str, reference: str, prediction: str) -> DataFrame:
    """Per group: items, discordant pairs, normalised Kendall agreement, and whether the order is equal.

    Both positions must be unique within a group. Pairs meet inside a group only.
    """
    a = df.select(F.col(group).alias("g"), F.col(reference).alias("r"), F.col(prediction).alias("p"))
    b = a.select(F.col("g").alias("g2"), F.col("r").alias("r2"), F.col("p").alias("p2"))
    wrong = a.join(b, (F.col("g") == F.col("g2")) & (F.col("r") < F.col("r2"))).groupBy("g").agg(F.count_if(F.col("p") > F.col("p2")).alias("discordant"))
    sizes = a.groupBy("g").agg(F.count("*").alias("n"))
    joined = sizes.join(wrong, "g", "left").select("g", "n", F.coalesce("discordant", F.lit(0)).alias("discordant"))
    tau = F.when(F.col("n") < 2, 1.0).otherwise(1.0 - F.col("discordant") / (F.col("n") * (F.col("n") - 1) / 2))
    return joined.select(F.col("g").alias(group), "n", "discordant", tau.alias("kendall"), (F.col("discordant") == 0).alias("exact"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks of tied scores; null unless both classes occur."""
    ranked = running_sums(_by_score(df, label, score), "s", ["n"])
    rank_sum = F.sum(F.col("pos") * (F.col("cum_n") - (F.col("n") - 1) / 2))
    sums = ranked.agg(rank_sum.alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(F.col("p").alias("positives"), F.col("q").alias("negatives"), over(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision with tied scores as one step; null without positives."""
    ranked = running_sums(_by_score(df, label, score), "s", ["n", "pos"], descending=True)
    sums = ranked.agg(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("a"), F.sum("pos").alias("p"))
    return sums.select(over(F.col("a"), F.col("p")).alias("average_precision"))


def select_threshold(df: DataFrame, label: str, score: str, target_recall: float) -> DataFrame:
    """The score threshold of highest precision among those that reach the recall; ties go to the higher one."""
    ranked = running_sums(_by_score(df, label, score), "s", ["n", "pos"], descending=True)
    total = ranked.agg(F.sum("pos").alias("total"))
    ok = ranked.join(F.broadcast(total), F.lit(True)).where(F.col("cum_pos") / F.col("total") + 1e-12 >= target_recall)
    precision = F.col("cum_pos") / F.greatest(F.lit(1), F.col("cum_n"))
    best = ok.agg(F.max(F.struct(precision.alias("precision"), F.col("s").alias("threshold"), (F.col("cum_pos") / F.col("total")).alias("recall"))).alias("b"))
    return best.select("b.threshold", "b.precision", "b.recall")


def risk_at(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Precision, recall, F1 and Brier score at a threshold."""
    y, hit = F.col(label).cast("int"), F.col(score) >= threshold
    sums = df.agg(
        F.count("*").alias("samples"), F.sum(y).alias("errors"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
    )
    p, r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return sums.select("samples", "errors", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(F.lit(1e-12), p + r)).alias("f1"), "brier")


def calibration_bins(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Ten bins by truncation, 1.0 in the last: count, summed confidence, correct."""
    index = F.least(F.floor(F.col(confidence) * 10), F.lit(9)).cast("int")
    return df.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.sum(confidence).alias("confidence_sum"), F.sum(F.col(correct).cast("int")).alias("correct"))


def expected_calibration_error(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Mean gap of a bin's mean confidence and accuracy, weighted by its share."""
    gap = F.abs(F.col("confidence_sum") / F.col("n") - F.col("correct") / F.col("n"))
    return calibration_bins(df, confidence, correct).agg(F.sum("n").alias("samples"), over(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"))


def multiset_scores(reference: DataFrame, prediction: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset overlap of two tables' rows: matched, missing, extra, precision, recall, F1."""
    a = reference.groupBy(*keys).agg(F.count("*").alias("a"))
    b = prediction.groupBy(*keys).agg(F.count("*").alias("b"))
    both = a.join(b, keys, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    sums = both.agg(
        F.sum(F.least("a", "b")).alias("matched"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra")
    )
    m, miss, more = F.col("matched"), F.col("missing"), F.col("extra")
    return sums.select("matched", "missing", "extra", over(m, m + more).alias("precision"), over(m, m + miss).alias("recall"), over(2 * m, 2 * m + miss + more).alias("f1"))


def transitions(df: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """What a second labelling changed: improved, regressed, unchanged right and wrong, and the net gain."""
    was, now = F.col(before) == F.col(truth), F.col(after) == F.col(truth)
    changed = F.col(before) != F.col(after)
    sums = df.agg(
        F.count("*").alias("items"), F.count_if(changed).alias("changed"), F.count_if(~was & now).alias("improved"), F.count_if(was & ~now).alias("regressed"),
        F.count_if(~changed & was).alias("unchanged_correct"), F.count_if(~changed & ~was).alias("unchanged_incorrect"),
    )
    return sums.withColumn("net", F.col("improved") - F.col("regressed"))


def nearest_rank(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Nearest-rank percentiles with minimum, maximum and mean."""
    name = lambda q: f"p{round(q * 100)}"
    return df.groupBy(group).agg(F.min(value).alias("min"), *[F.expr(f"percentile_disc({q}) within group (order by {value})").cast("double").alias(name(q)) for q in shares], F.max(value).alias("max"), F.avg(value).alias("mean"))


def linear_quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, and the median."""
    name = lambda q: f"q{round(q * 1000)}"
    return df.groupBy(group).agg(*[F.expr(f"percentile({value}, {q})").alias(name(q)) for q in shares])
