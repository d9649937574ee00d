"""Order-dependent operators. Partitions are pages, documents or streams of one owner, which are bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.geometry import Box, column_index, layout_zone

#: How far the next line of one text flow may lie, on normalised pages.
FLOW_DX, FLOW_DY, SLACK = (-0.005, 0.05), (-0.005, 0.028), 1e-12


def reading_order(blocks: DataFrame, page: str, position: str, width: Column, height: Column, gutter: Column) -> DataFrame:
    """``reading_order`` from 0 by band, column, top and left; pages without a gutter keep their given order.

    Band 0 holds spanning text that ends in the top 18 %, 1 the columns, 3 spanning text that starts
    below 85 %, 2 other spanning text.
    """
    b = Box.of()
    column = column_index(b, gutter, width)
    band = F.when(column.isNotNull(), 1).when(b.y1 <= height * 0.18, 0).when(b.y0 >= height * 0.85, 3).otherwise(2)
    single = gutter.isNull()
    staged = blocks.withColumns({"_band": F.when(single, 1).otherwise(band), "_col": F.when(single, 0).otherwise(F.coalesce(column, F.lit(0))), "_y": F.when(single, 0.0).otherwise(b.y0), "_x": F.when(single, 0.0).otherwise(b.x0)})
    w = Window.partitionBy(page).orderBy("_band", "_col", "_y", "_x", position)
    return staged.withColumn("reading_order", F.row_number().over(w) - 1).withColumn("band", F.col("_band")).drop("_band", "_col", "_y", "_x")


def margin_order(blocks: DataFrame, page: str, position: str) -> DataFrame:
    """``content_order`` from 0: top margin by place, body as given, bottom margin by place (normalised boxes)."""
    b = Box.of()
    zone = F.when(b.y0 < 0.08, 0).when(b.y0 >= 0.92, 2).otherwise(1)
    staged = blocks.withColumns({"_z": zone, "_y": F.when(zone == 1, 0.0).otherwise(b.y0), "_x": F.when(zone == 1, 0.0).otherwise(b.x0)})
    return staged.withColumn("content_order", F.row_number().over(Window.partitionBy(page).orderBy("_z", "_y", "_x", position)) - 1).drop("_z", "_y", "_x")


def islands(df: DataFrame, owner: list[str], order: list[str], breaks: Column, out: str = "island") -> DataFrame:
    """``out``: number of the run a row belongs to; ``breaks`` may use ``lag`` over the same window and is null for the first row."""
    w = Window.partitionBy(*owner).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(breaks.cast("int"), F.lit(0)))
    return df.withColumn("_break", flag).withColumn(out, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_break")


def flow_blocks(lines: DataFrame, page: str, position: str) -> DataFrame:
    """``block``: lines chained while the zone is the same, the next lies close, has no anchor and no image came between.

    Needs normalised boxes and the boolean columns ``anchored`` and ``after_image``.
    """
    w = Window.partitionBy(page).orderBy(position)
    before = lambda c: F.lag(c).over(w)
    staged = lines.withColumn("_zone", layout_zone(Box.of()))
    dx, dy = F.col("x0") - before("x0"), F.col("y0") - before("y1")
    within = lambda v, lo, hi: (v >= lo - SLACK) & (v <= hi + SLACK)
    chained = (F.col("_zone") == before("_zone")) & within(dx, *FLOW_DX) & within(dy, *FLOW_DY) & ~F.col("anchored") & ~F.col("after_image")
    return islands(staged, [page], [position], ~chained, "block").drop("_zone")


def runs(df: DataFrame, owner: str, order: str, value: str) -> DataFrame:
    """Maximal runs of an equal value: first and last place, length."""
    w = Window.partitionBy(owner).orderBy(order)
    marked = islands(df, [owner], [order], ~F.col(value).eqNullSafe(F.lag(value).over(w)), "run")
    return marked.groupBy(owner, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def run_summary(df: DataFrame, owner: str, order: str, value: str) -> DataFrame:
    """Longest and last run of an equal value per owner."""
    found = runs(df, owner, order, value)
    return found.groupBy(owner).agg(F.max("length").alias("longest_run"), F.max_by("length", "run").alias("trailing_run"))


def fill_both_ways(df: DataFrame, owner: str, order: str, value: str, default: Column) -> DataFrame:
    """``value`` filled forward, then backward, then with a default."""
    past = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("filled", F.coalesce(F.last(value, ignorenulls=True).over(past), F.first(value, ignorenulls=True).over(future), default))


def merged_positions(df: DataFrame, owner: str, value: str, tolerance: float) -> DataFrame:
    """Sorted positions merged while the gap to the previous one is at most ``tolerance``: mean and size of each group."""
    w = Window.partitionBy(owner).orderBy(value)
    marked = islands(df.select(owner, value), [owner], [value], F.col(value) - F.lag(value).over(w) > tolerance, "cluster")
    return marked.groupBy(owner, "cluster").agg(F.avg(value).alias("position"), F.count("*").alias("members"))


def pitches(lines: DataFrame, owner: list[str], order: list[str]) -> DataFrame:
    """Distance of the tops of neighbouring lines, where it is 0.8 to 1.8 line heights."""
    following = F.lead("y0").over(Window.partitionBy(*owner).orderBy(*order))
    height = F.col("y1") - F.col("y0")
    found = lines.withColumn("pitch", following - F.col("y0"))
    return found.where(F.col("pitch").between(0.8 * height, 1.8 * height))


def midpoint_bounds(df: DataFrame, owner: str, center: str) -> DataFrame:
    """Bounds halfway to the neighbouring centres; the ends mirror their inner half; a lone centre has none."""
    w = Window.partitionBy(owner).orderBy(center)
    before, after, c = F.lag(center).over(w), F.lead(center).over(w), F.col(center)
    lower = F.when(before.isNotNull(), (before + c) / 2).otherwise(c - (after - c) / 2)
    upper = F.when(after.isNotNull(), (c + after) / 2).otherwise(c + (c - before) / 2)
    return df.withColumns({"lower": lower, "upper": upper})


def bucketed(df: DataFrame, owner: str, order: str, size: int, context: int = 0, item: str | None = None) -> DataFrame:
    """``segment`` and place in it by fixed size; with ``item``, the items before and after as context."""
    w = Window.partitionBy(owner).orderBy(order)
    place = F.row_number().over(w) - 1
    out = df.withColumns({"segment": F.floor(place / size).cast("int"), "place": (place % size).cast("int")})
    if context and item:
        out = out.withColumns({"before": F.collect_list(item).over(w.rowsBetween(-context, -1)), "after": F.collect_list(item).over(w.rowsBetween(1, context))})
    return out


def started(df: DataFrame, owner: str, order: str, event: Column) -> DataFrame:
    """``started``: whether ``event`` held in a row before."""
    w = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_event", event.cast("int")).withColumn("started", F.coalesce(F.max("_event").over(w), F.lit(0)) == 1).drop("_event")


def page_breaks(df: DataFrame, owner: str, order: str, page: str, explicit: str) -> DataFrame:
    """``breaks`` before each row: explicit ones, plus those that the known page number needs beyond them.

    A page number below the highest one before is flagged as ``regression`` and adds nothing.
    """
    past = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = df.withColumn("_high", F.max(page).over(past)).withColumn("_sum", F.sum(explicit).over(running))
    staged = staged.withColumn("_seen", F.max(F.when(F.col(page).isNotNull(), F.col("_sum"))).over(past))
    needed = F.col(page) - F.col("_high") - (F.col("_sum") - F.coalesce("_seen", F.lit(0)))
    extra = F.when(F.col(page) > F.col("_high"), F.greatest(F.lit(0), needed)).otherwise(0)
    return staged.withColumns({"breaks": F.col(explicit) + extra, "regression": F.coalesce(F.col(page) < F.col("_high"), F.lit(False))}).drop("_high", "_sum", "_seen")


def illegal_transitions(events: DataFrame, owner: str, order: list[str], state: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Steps of a state log that the transition table does not allow."""
    before = F.lag(state).over(Window.partitionBy(owner).orderBy(*order))
    steps = events.withColumn("from_state", before).where("from_state is not null")
    table = events.sparkSession.createDataFrame(legal, "a string, b string")  # a fixed, small table
    return steps.join(F.broadcast(table), (F.col("from_state") == F.col("a")) & (F.col(state) == F.col("b")), "left_anti")
