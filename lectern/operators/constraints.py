"""Constraints as queries that return violations: rule, key, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a table.
MAX_SIDE, MAX_CELLS = 10_000, 100_000


def violation(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def not_unique(df: DataFrame, key: str | Column, rule: str) -> DataFrame:
    """Keys that occur more than once."""
    k = F.col(key) if isinstance(key, str) else key
    found = df.groupBy(k.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1")
    return violation(found, rule, F.col("_k"), F.col("_n"))


def dangling(child: DataFrame, reference: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """References without a target."""
    missing = child.select(reference).where(F.col(reference).isNotNull()).distinct().join(parent.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")
    return violation(missing, rule, F.col(reference))


def failing(df: DataFrame, ok: Column, key: str, rule: str) -> DataFrame:
    """Rows for which a check is not true."""
    return violation(df.where(~F.coalesce(ok, F.lit(False))), rule, F.col(key))


def not_exactly_covered(required: DataFrame, owned: DataFrame, key: str, rule: str) -> DataFrame:
    """Required keys that are not owned exactly once, and owned ones that are not required."""
    need = required.select(key).distinct().withColumn("_need", F.lit(1))
    have = owned.groupBy(key).agg(F.count("*").alias("_n"))
    both = need.join(have, key, "full").where("_need is null or coalesce(_n, 0) <> 1")
    return violation(both, rule, F.col(key), F.when(F.col("_need").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").otherwise("repeated"))


def not_a_permutation(order: DataFrame, items: DataFrame, group: str, item: str, rule: str) -> DataFrame:
    """Groups whose order is not a permutation of their items."""
    a = order.groupBy(group, item).agg(F.count("*").alias("_a"))
    b = items.select(group, item).distinct().withColumn("_b", F.lit(1))
    bad = a.join(b, [group, item], "full").groupBy(group).agg(F.count_if(F.coalesce("_a", F.lit(0)) != F.coalesce("_b", F.lit(0))).alias("_bad")).where("_bad > 0")
    return violation(bad, rule, F.col(group), F.col("_bad"))


def grid_violations(tables: DataFrame, cells: DataFrame, table: str) -> DataFrame:
    """Cells out of bounds, grid places covered twice, and places not covered.

    ``tables`` has n_rows and n_columns; ``cells`` has row, column, row_span and column_span.
    """
    sized = cells.join(tables.select(table, "n_rows", "n_columns"), table)
    out = sized.where((F.col("row") < 0) | (F.col("column") < 0) | (F.col("row") + F.col("row_span") > F.col("n_rows")) | (F.col("column") + F.col("column_span") > F.col("n_columns")))
    large = tables.where((F.col("n_rows") > MAX_SIDE) | (F.col("n_columns") > MAX_SIDE) | (F.col("n_rows").cast("long") * F.col("n_columns") > MAX_CELLS))
    places = sized.join(large.select(table), table, "left_anti").select(table, F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r"), "column", "column_span")
    places = places.select(table, "r", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("column_span") - 1)).alias("c"))
    counts = places.groupBy(table, "r", "c").agg(F.count("*").alias("n"))
    per = counts.groupBy(table).agg(F.count_if(F.col("n") > 1).alias("twice"), F.count("*").alias("covered"))
    judged = tables.join(large.select(table), table, "left_anti").join(per, table, "left").withColumn("gap", F.col("n_rows").cast("long") * F.col("n_columns") - F.coalesce("covered", F.lit(0)))
    return (
        violation(large, "table_too_large", F.col(table))
        .union(violation(out.groupBy(table).agg(F.count("*").alias("n")), "cell_out_of_bounds", F.col(table), F.col("n")))
        .union(violation(judged.where("twice > 0"), "cells_overlap", F.col(table), F.col("twice")))
        .union(violation(judged.where("gap > 0"), "grid_not_covered", F.col(table), F.col("gap")))
    )


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Rules of a reference manifest: ids, lineages, digests and families, verification and rights.

    Families may not be in the test split and in another; a lineage is in one split.
    """
    fold = lambda c: F.lower(F.col(c))
    out = not_unique(manifest, fold("id"), "duplicate_id").union(not_unique(manifest, fold("source_sha256"), "duplicate_source"))
    out = out.union(failing(manifest, F.col("verified"), "id", "not_verified")).union(failing(manifest, F.col("rights"), "id", "rights_not_verified"))
    lineage = manifest.groupBy(fold("lineage_id").alias("k")).agg(F.count_distinct("split").alias("n")).where("n > 1")
    family = manifest.groupBy(fold("family").alias("k")).agg(F.count_if(F.col("split") == "test").alias("t"), F.count_if(F.col("split") != "test").alias("d")).where("t > 0 and d > 0")
    return out.union(violation(lineage, "lineage_in_several_splits", F.col("k"), F.col("n"))).union(violation(family, "family_in_test_and_development", F.col("k")))


def over_budget(pairs: DataFrame, group: str, left: str, right: str, budget: int = 10_000_000) -> DataFrame:
    """Groups whose edit distances would need more than ``budget`` steps."""
    work = pairs.groupBy(group).agg(F.sum(F.length(left).cast("long") * F.length(right)).alias("work")).where(F.col("work") > budget)
    return violation(work, "comparison_over_budget", F.col(group), F.col("work"))
