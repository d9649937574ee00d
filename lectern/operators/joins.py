"""Joins by geometry and by alignment. All geometry joins have the page as an equality key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.geometry import Box, overlap, share_inside


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def best_overlap(left: DataFrame, right: DataFrame, page: str, key: str, order: str, vertical: float = 0.45, horizontal: float = 0.25) -> DataFrame:
    """For each left box the right one of the same page with most overlap (0.7 vertical, 0.3 horizontal of the left's sides).

    Candidates overlap at least ``vertical`` and ``horizontal``; the first in ``order`` wins a tie.
    """
    r = _prefixed(right, "r_")
    a, b = Box.of(), Box.of("r_")
    one = F.lit(1.0)
    v = overlap(a.y0, a.y1, b.y0, b.y1) / F.greatest(one, a.height)
    h = overlap(a.x0, a.x1, b.x0, b.x1) / F.greatest(one, a.width)
    met = left.join(r, F.col(page) == F.col(f"r_{page}")).withColumns({"_v": v, "_h": h}).where((F.col("_v") >= vertical) & (F.col("_h") >= horizontal))
    score = F.col("_v") * 0.7 + F.col("_h") * 0.3
    best = met.groupBy(page, key).agg(F.max(F.struct(score.alias("score"), (-F.col(f"r_{order}")).alias("o"), F.col(f"r_{key}").alias("k"))).alias("b"))
    return left.join(best, [page, key], "left").select(*left.columns, F.col("b.k").alias("match"), F.col("b.score").alias("score"))


def containing_region(blocks: DataFrame, regions: DataFrame, page: str, key: str, order: str, least: float = 0.5) -> DataFrame:
    """The region that holds most of each block's area, if at least ``least`` of it; the first in ``order`` wins a tie."""
    r = _prefixed(regions, "r_")
    ratio = share_inside(Box.of(), Box.of("r_"))
    met = blocks.join(r, F.col(page) == F.col(f"r_{page}"))
    best = met.groupBy(page, key).agg(F.max(F.struct(ratio.alias("ratio"), (-F.col(f"r_{order}")).alias("o"), F.col(f"r_{key}").alias("k"))).alias("b"))
    ok = F.col("b.ratio") >= least
    return blocks.join(best, [page, key], "left").select(*blocks.columns, F.when(ok, F.col("b.k")).alias("region"), F.when(ok, F.col("b.ratio")).alias("ratio"))


def centers_in_boxes(lines: DataFrame, cells: DataFrame, page: str, margin: float = 0.0) -> DataFrame:
    """Lines with every cell of the same page that holds their centre; cell columns get the prefix ``c_``."""
    c = _prefixed(cells, "c_")
    return lines.join(c, (F.col(page) == F.col(f"c_{page}")) & Box.of("c_").contains_center_of(Box.of(), margin)).drop(f"c_{page}")


def interval_index(points: DataFrame, edges: DataFrame, page: str, value: Column) -> DataFrame:
    """Index of the interval of ``edges`` (page, edge, sorted array) that holds ``value``; the last edge is inside; else null."""
    joined = points.join(edges.withColumnRenamed(page, "_page"), F.col(page) == F.col("_page"), "left").drop("_page").withColumn("_v", value)
    n = F.size("edges")
    index = F.size(F.filter("edges", lambda e: e <= F.col("_v"))) - 1
    last = F.col("_v") == F.element_at("edges", -1)
    inside = (F.col("_v") >= F.element_at("edges", 1)) & (F.col("_v") <= F.element_at("edges", -1))
    return joined.withColumn("interval", F.when(inside & (n >= 2), F.when(last, n - 2).otherwise(index))).drop("_v", "edges")


def overlapping_columns(lines: DataFrame, columns: DataFrame, page: str, least: float = 0.05) -> DataFrame:
    """Every column interval (c0, c1, c_index) of the page that a line overlaps by ``least`` of its width."""
    width = F.col("x1") - F.col("x0")
    share = overlap(F.col("x0"), F.col("x1"), F.col("c0"), F.col("c1"))
    return lines.join(columns.withColumnRenamed(page, "_page"), (F.col(page) == F.col("_page")) & (width > 0) & (share >= width * least)).drop("_page")


def nearest_center(points: DataFrame, centers: DataFrame, page: str, key: str, value: Column) -> DataFrame:
    """Index of the nearest of ``centers`` (page, index, center); a tie goes to the lower index."""
    c = centers.select(F.col(page).alias("_page"), F.col("index").alias("_i"), F.col("center").alias("_c"))
    met = points.withColumn("_v", value).join(c, F.col(page) == F.col("_page"))
    best = met.groupBy(page, key).agg(F.min(F.struct(F.abs(F.col("_v") - F.col("_c")).alias("d"), F.col("_i").alias("i"))).alias("b"))
    return best.select(page, key, F.col("b.i").alias("nearest"), F.col("b.d").alias("distance"))


def differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs or that one side lacks, with both values."""
    x, y = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    return x.join(y, keys, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def aligned_texts(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of both sides by key; a side that lacks a key, or has it as another kind, contributes an empty text."""
    x = gold.select(*keys, F.col("kind").alias("gk"), F.col("text").alias("gt"))
    y = predicted.select(*keys, F.col("kind").alias("pk"), F.col("text").alias("pt"))
    both = x.join(y, keys, "full")
    fits = F.col("gk").isNull() | F.col("pk").isNull() | (F.col("gk") == F.col("pk"))
    empty = F.lit("")
    return both.select(*keys, F.coalesce("gt", empty).alias("reference"), F.when(fits, F.coalesce("pt", empty)).otherwise(empty).alias("prediction"))


def aligned_roles(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Roles of both sides by key, with sentinels for a missing node, another kind, and a node of the prediction only."""
    x = gold.select(*keys, F.col("kind").alias("gk"), F.col("role").alias("gr"))
    y = predicted.select(*keys, F.col("kind").alias("pk"), F.col("role").alias("pr"))
    reference = F.coalesce("gr", F.lit("<prediction-only>"))
    prediction = F.when(F.col("pr").isNull(), "<missing>").when(F.col("gk") != F.col("pk"), "<kind-mismatch>").otherwise(F.col("pr"))
    return x.join(y, keys, "full").select(*keys, reference.alias("reference"), prediction.alias("prediction"))


def coverage_difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or unexpected; none if both sides cover the same."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").select(F.lit("missing").alias("side"), key)
    extra = found.select(key).distinct().join(expected, key, "left_anti").select(F.lit("unexpected").alias("side"), key)
    return missing.union(extra)


def one_owner(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that exactly one row owns, with its value."""
    return df.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def name_pairs(sources: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """All pairs of a source and a target with one name; right columns get the prefix ``t_``."""
    t = _prefixed(targets, "t_")
    return sources.join(t, F.col(key) == F.col(f"t_{key}")).drop(f"t_{key}")


def unique_ratio_match(left: DataFrame, right: DataFrame, page: str, key: str, ratio: str, tolerance: float) -> DataFrame:
    """The one right row of the page whose ratio is within ``tolerance`` on a logarithmic scale; none if several are."""
    r = _prefixed(right, "r_")
    close = F.abs(F.ln(F.col(ratio)) - F.ln(F.col(f"r_{ratio}"))) <= tolerance
    met = left.join(r, (F.col(page) == F.col(f"r_{page}")) & close)
    return met.groupBy(page, key).agg(F.count("*").alias("_n"), F.min(f"r_{key}").alias("match")).where("_n = 1").drop("_n")
