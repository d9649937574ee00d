"""Duplicates and leaks between splits. Groups are combined before the shuffle, never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_duplicates(df: DataFrame, key: str, order: str, out: str = "duplicate_of") -> DataFrame:
    """``out``: the first row's ``order`` value for later rows with an equal ``key``, else null."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    joined = df.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(out, F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_key", "_first")


def duplicate_groups(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keys that occur more than once: count and first row."""
    return df.groupBy(key).agg(F.count("*").alias("copies"), F.min(order).alias("first_id")).where("copies > 1")


def conflicting_targets(df: DataFrame, key: str, order: str, target: Column) -> DataFrame:
    """Per key the target of the first row, and how many rows disagree with it."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(target, F.col(order)).alias("first_target"))
    joined = df.withColumn("_target", target).join(first, F.col(key) == F.col("_key"))
    return joined.groupBy(key).agg(F.first("first_target").alias("first_target"), F.count_if(F.col("_target") != F.col("first_target")).alias("conflicts"))


def leaked(df: DataFrame, fingerprint: str, split: str = "split") -> DataFrame:
    """Fingerprints owned by more than one split."""
    owners = df.where(F.col(split).isNotNull()).groupBy(fingerprint).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"), F.count_distinct(split).alias("n_splits"))
    return owners.where("_lo <> _hi").select(fingerprint, "n_splits")


def without_leaks(df: DataFrame, fingerprint: str, split: str = "split") -> DataFrame:
    """Rows whose fingerprint is in one split only."""
    return df.join(leaked(df, fingerprint, split).select(fingerprint), fingerprint, "left_anti")


def isolation_violations(df: DataFrame, owner: str, split: str = "split", rule: str = "owner_in_several_splits") -> DataFrame:
    """(rule, key, detail) of owners found in more than one split."""
    found = df.groupBy(owner).agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("detail"))  # as many as splits
    return found.where("detail like '%,%'").select(F.lit(rule).alias("rule"), F.col(owner).cast("string").alias("key"), "detail")


def idempotent_rows(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not stored yet; repeats inside ``new`` stay."""
    same = None
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = here if same is None else same & here
    return new.join(known, same, "left_anti")
