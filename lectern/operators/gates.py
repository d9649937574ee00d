"""Release decisions from measurements and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARATORS = ("<=", ">=", "==")


def decide(gates: DataFrame, measurements: DataFrame) -> DataFrame:
    """Each gate (id, comparator, threshold) against its measurement (id, value): passed, failed or unmeasured."""
    m = measurements.select(F.col("id").alias("_id"), F.col("value").alias("value"))
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("comparator") == "<=", v <= t).when(F.col("comparator") == ">=", v >= t).when(F.col("comparator") == "==", v == t)
    status = F.when(v.isNull() | F.isnan(v), F.concat("id", F.lit(".unmeasured"))).when(ok, "passed").otherwise(F.concat("id", F.lit(".failed")))
    return gates.join(m, F.col("id") == F.col("_id"), "left").select("id", "comparator", "threshold", "value", status.alias("status"))


def release(decisions: DataFrame) -> DataFrame:
    """Whether all gates passed, and what did not."""
    return decisions.agg(F.bool_and(F.col("status") == "passed").alias("releasable"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") != "passed", F.col("status")))), ",").alias("open"))  # a row per gate


def outcome(checks: DataFrame, owner: str, required: list[str]) -> DataFrame:
    """Per owner block, review or auto_pass; the last needs every required check, and a missing one blocks."""
    found = checks.groupBy(owner).agg(F.bool_or(F.col("status") == "block").alias("b"), F.bool_or(F.col("status") == "review").alias("r"), F.collect_set("check").alias("seen"))  # as many as checks
    complete = F.size(F.array_except(F.lit(required), "seen")) == 0
    return found.select(owner, F.when(F.col("b") | ~complete, "block").when(F.col("r"), "review").otherwise("auto_pass").alias("outcome"))


def promotion(reports: DataFrame) -> DataFrame:
    """Whether the candidate beats the baseline: lower error, coverage of 0.98 or more, equal pages; with the relative change."""
    side = lambda k: reports.where(F.col("role") == k).agg(*[F.max(c).alias(f"{k[0]}_{c}") for c in ("cer", "coverage", "pages")])
    both = side("baseline").join(side("candidate"), F.lit(True))  # one row each
    change = (F.col("c_cer") - F.col("b_cer")) / F.greatest(F.col("b_cer"), F.lit(1e-9))
    ok: Column = (F.col("c_cer") < F.col("b_cer")) & (F.col("c_coverage") >= 0.98) & (F.col("c_pages") == F.col("b_pages"))
    return both.select(ok.alias("promote"), change.alias("relative_change"))
