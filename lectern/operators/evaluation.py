"""Evaluation of documents, tables, formulas and models; votes, look-ups and queues beside them.

Rates whose denominator is 0 are null, unless a rule asks for another value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import nfc, strip_space
from lectern.operators.metrics import macro_f1
from lectern.session import ship_package

#: Metric, its numerator and its denominator (null: documents) among the columns of a document.
MICRO_METRICS = [
    ("overall_cer", "text_edits", "text_slots"),
    ("critical_token_error_rate", "critical_edits", "critical_slots"),
    ("reading_order_exact_match", "order_exact", None),
    ("reading_order_kendall_tau", "order_tau", None),
    ("table_topology_exact_match", "tables_exact", "tables"),
    ("formula_detection_recall", "formulas_found", "formulas"),
    ("normalized_formula_similarity", "formula_similarity", "formulas"),
]


def rate(part: Column, whole: Column) -> Column:
    """``part`` of ``whole``; null where that is 0."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


def rounded(x: Column, places: int) -> Column:
    """``x`` to some places by its binary value, ties to even, as Python rounds.

    The upper and the lower bits are scaled apart, which is exact for values up to 8 and six places; beyond, a value very near a tie
    may go either way.
    """
    upper = F.floor(x * 2.0**30) / 2.0**30
    scaled = upper * 10.0**places
    whole = F.floor(scaled)
    past = (scaled - whole - 0.5) + (x - upper) * 10.0**places
    return (whole + F.when((past > 0) | ((past == 0) & (whole % 2 != 0)), 1).otherwise(0)) / 10.0**places


def micro_metrics(documents: DataFrame, roles: DataFrame) -> DataFrame:
    """metric, samples and value of eight metrics over all documents, and over roles (reference, prediction).

    The F1 takes each label of either side alike; it is null without roles.
    """
    amounts = [(name, F.sum(F.col(part).cast("double")), F.count("*") if whole is None else F.coalesce(F.sum(whole), F.lit(0)).cast("long")) for name, part, whole in MICRO_METRICS]
    sums = documents.agg(*[F.struct(whole.alias("samples"), part.alias("part")).alias(name) for name, part, whole in amounts])
    each = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}.samples").alias("samples"), rate(F.col(f"{name}.part"), F.col(f"{name}.samples")).alias("value")) for name, _, _ in amounts])
    f1 = macro_f1(roles, "reference", "prediction").select(F.lit(0).cast("long").alias("samples"), "macro_f1")
    both = f1.union(roles.agg(F.count("*")).select("*", F.lit(None).cast("double"))).agg(F.max("samples").alias("samples"), F.max("macro_f1").alias("value"))
    role = both.select(F.lit("role_macro_f1").alias("metric"), "samples", F.when(F.col("samples") > 0, F.col("value")).alias("value"))
    return sums.select(F.explode(each).alias("x")).select("x.*").union(role)


def topology_exact(tables: DataFrame, cells: DataFrame, found_tables: DataFrame, found_cells: DataFrame) -> DataFrame:
    """samples, exact and exact_rate of tables (id, n_rows, n_columns) with cells (id, row, column, row_span, column_span).

    A table is exact if one of its id is found with the same size and the same cells, each as often. Cells meet by count, so
    that no table is gathered in one row.
    """
    key = ["id", "row", "column", "row_span", "column_span"]
    signed = cells.select(*key, F.lit(1).alias("side")).union(found_cells.select(*key, F.lit(-1).alias("side")))
    differ = signed.groupBy(*key).agg(F.sum("side").alias("more")).where("more <> 0").select("id").distinct().withColumn("differs", F.lit(True))
    size = F.struct("n_rows", "n_columns")
    judged = tables.select("id", size.alias("size")).join(found_tables.select("id", size.alias("found")), "id", "left").join(differ, "id", "left")
    exact = F.coalesce(F.col("size") == F.col("found"), F.lit(False)) & F.col("differs").isNull()
    return judged.agg(F.count("*").alias("samples"), F.count_if(exact).alias("exact")).select("samples", "exact", rate(F.col("exact"), F.col("samples")).alias("exact_rate"))


def formula_form(expression: Column) -> Column:
    """The form in which formulas are compared: NFC without white space."""
    return strip_space(nfc(expression))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 if ``b`` is empty."""
    return F.when(F.length(b) > 0, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def formula_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """samples, detected, recall and similarity of formulas (id, format, expression); another format has similarity 0."""
    ship_package(expected.sparkSession)
    a = expected.select("id", F.col("format").alias("f"), formula_form(F.col("expression")).alias("a"))
    b = found.select("id", F.lit(True).alias("hit"), F.col("format").alias("g"), formula_form(F.col("expression")).alias("b"))
    pairs = a.join(b, "id", "left")
    likeness = F.when(F.col("f") == F.col("g"), edit_similarity(F.col("a"), F.col("b"))).otherwise(0.0)
    sums = pairs.agg(F.count("*").alias("samples"), F.count("hit").alias("detected"), F.sum(likeness).alias("total"))
    return sums.select("samples", "detected", rate(F.col("detected"), F.col("samples")).alias("recall"), rate(F.col("total"), F.col("samples")).alias("similarity"))


def review_recall(documents: DataFrame) -> DataFrame:
    """High-risk mismatches, those routed to review, and their share."""
    sums = documents.agg(F.sum("mismatched").alias("mismatched"), F.sum("routed").alias("routed"))
    return sums.select("mismatched", "routed", rate(F.col("routed"), F.col("mismatched")).alias("recall"))


def model_summary(predictions: DataFrame) -> DataFrame:
    """Per model of predictions (model, expression, error, seconds, exact_match, similarity): samples, successes and means.

    A success has an expression and no error; it is evaluated if ``exact_match`` is not null. Empty text counts as none.
    """
    good = (F.coalesce(F.length("expression"), F.lit(0)) > 0) & (F.coalesce(F.length("error"), F.lit(0)) == 0)
    judged = good & F.col("exact_match").isNotNull()
    sums = predictions.groupBy("model").agg(
        F.count("*").alias("samples"), F.count_if(good).alias("successful"), F.sum(F.when(good, F.col("seconds"))).alias("s"), F.count_if(judged).alias("evaluated_targets"),
        F.count_if(judged & F.col("exact_match")).alias("e"), F.sum(F.when(judged, F.col("similarity"))).alias("l"),
    )
    return sums.select(
        "model", "samples", "successful", (F.col("samples") - F.col("successful")).alias("errors"),
        rounded(F.coalesce("s", F.lit(0.0)) / F.greatest(F.lit(1), "successful"), 4).alias("average_inference_seconds"), "evaluated_targets",
        rounded(rate(F.col("e"), F.col("evaluated_targets")), 6).alias("exact_match_rate"), rounded(rate(F.col("l"), F.col("evaluated_targets")), 6).alias("normalized_edit_similarity"),
    )


def majority_page(cells: DataFrame, group: str, page: str) -> DataFrame:
    """The page that most cells of each group are on; of several the first."""
    votes = cells.groupBy(group, page).agg(F.count("*").alias("n"))
    return votes.groupBy(group).agg(F.max_by(page, F.struct(F.col("n"), -F.col(page))).alias(page))


def weighted_score(cells: DataFrame, group: str, score: Column, length: Column) -> DataFrame:
    """Mean score of each group's cells weighted by text length, to six places; 0 if all are empty."""
    sums = cells.groupBy(group).agg(F.sum(score * length).alias("s"), F.sum(length).alias("n"))
    return sums.select(group, rounded(F.coalesce(rate(F.col("s"), F.col("n")), F.lit(0.0)), 6).alias("score"))


def mean_confidence(owners: DataFrame, parts: DataFrame, owner: str, confidence: Column) -> DataFrame:
    """n_parts and mean confidence of each owner; 0 for owners without parts."""
    sums = parts.groupBy(owner).agg(F.count("*").alias("n"), F.sum(confidence).alias("s"))
    joined = owners.select(owner).join(sums, owner, "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(owner, n.alias("n_parts"), (F.coalesce("s", F.lit(0.0)) / F.greatest(F.lit(1), n)).alias("confidence"))


def configured(files: DataFrame, given: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """``files`` with each column from ``given`` (one row a key) or, where that has none, from its expression."""
    ours = files.select(*files.columns, *[c.alias(f"_{name}") for name, c in columns.items()])
    joined = ours.join(given.select(key, *[F.col(name).alias(f"_given_{name}") for name in columns]), key, "left")
    rest = [c for c in files.columns if c not in columns]
    return joined.select(*rest, *[F.coalesce(f"_given_{name}", f"_{name}").alias(name) for name in columns])


# Statuses at which a job has ended or waits
ENDED, WAITING = ("COMPLETED", "FAILED", "CANCELLED"), ("QUEUED", "RETRYING")


def newest_first(jobs: DataFrame) -> DataFrame:
    """Jobs (id, status, created_at), newest first."""
    return jobs.orderBy(F.desc("created_at"), "id")


def recovery_queue(jobs: DataFrame) -> DataFrame:
    """Jobs to run after a restart, oldest first: interrupted ones are tried again, waiting ones keep their place."""
    status = F.when(F.col("status") == "QUEUED", F.col("status")).when(~F.col("status").isin(*ENDED), "RETRYING").otherwise(F.col("status"))
    return jobs.withColumn("status", status).where(F.col("status").isin(*WAITING)).orderBy("created_at", "id")


# Part of a progress message, its stage and its progress
PROGRESS_MESSAGES = [("detecting tables", "STRUCTURING", 0.74), ("writing editable HWPX", "EXPORTING", 0.8), ("verifying in Hancom", "VALIDATING", 0.9)]


def message_progress(message: Column) -> list[Column]:
    """stage, progress and page_count that a progress message tells; null for other messages, which move no job back.

    ``page i/n`` counts first; of ``n`` 0 the progress is that of the last page.
    """
    page = r"(?i)page\s+([0-9]+)/([0-9]+)"
    at, of = (F.nullif(F.regexp_extract(message, page, k), F.lit("")).try_cast("double") for k in (1, 2))
    stage, progress = F.when(of.isNotNull(), "OCR"), F.when(of.isNotNull(), F.least(F.lit(0.7), 0.1 + F.when(of > 0, at / of).otherwise(1.0) * 0.6))
    for part, name, value in PROGRESS_MESSAGES:
        stage, progress = stage.when(F.contains(message, F.lit(part)), name), progress.when(F.contains(message, F.lit(part)), value)
    return [stage.alias("stage"), progress.alias("progress"), of.cast("long").alias("page_count")]


def safe_latex(expression: Column) -> Column:
    """Whether an expression has only plain characters and balanced braces."""
    step = lambda a, x: F.when((a < 0) | ((x == "}") & (a == 0)), -1).when(x == "{", a + 1).otherwise(a - 1)
    depth = F.aggregate(F.regexp_extract_all(expression, F.lit("([{}])")), F.lit(0), step)
    return F.coalesce(expression.rlike(r"(?U)\A[A-Za-z0-9\s{}_^+*/=().,|<>\[\]-]+\z") & (depth == 0), F.lit(False))


def cell_texts(cells: DataFrame, line: str, cell: str, text: str) -> DataFrame:
    """The cells of each line with their part of its text: the words one by one if there are as many as cells, else all of it."""
    of_line = Window.partitionBy(line)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    numbered = cells.withColumn("_n", F.count("*").over(of_line)).withColumn("_i", F.row_number().over(of_line.orderBy(cell)))
    part = F.when((F.col("_n") > 1) & (F.size(words) == F.col("_n")), F.get(words, F.col("_i") - 1)).otherwise(F.col(text))
    return numbered.withColumn(text, part).drop("_n", "_i")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, missing, changed) of files whose digest is not the same in both snapshots; none: unchanged."""
    both = before.select(key, F.col(digest).alias("a"), F.lit(True).alias("was")).join(after.select(key, F.col(digest).alias("b"), F.lit(True).alias("is")), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def distinct_regions(regions: DataFrame, page: str, threshold: float = 0.65) -> DataFrame:
    """Boxes (pos, x0, y0, x1, y1) of a page, largest first, but those that a kept one covers by ``threshold``."""
    from lectern.operators.sequential import per_group

    def keep(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in sorted(rows, key=lambda r: (-(r[4] - r[2]) * (r[5] - r[3]), r[1])):
            own = max(1.0, r[4] - r[2]) * max(1.0, r[5] - r[3])
            if all(max(0.0, min(r[4], k[4]) - max(r[2], k[2])) * max(0.0, min(r[5], k[5]) - max(r[3], k[3])) / own < threshold for k in kept):
                kept.append(r)
        return kept

    rows = regions.select(page, F.col("pos").cast("int").alias("pos"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return per_group(rows, page, ["pos"], keep, f"{page} {dict(regions.dtypes)[page]}, pos int, x0 double, y0 double, x1 double, y1 double")
