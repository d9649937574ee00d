"""Running sums over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, order: str, values: list[str], buckets: int = 64, descending: bool = False) -> DataFrame:
    """``cum_<value>`` for each value: its sum over all rows up to this one by ``order`` (which must be unique).

    Approximate quantiles cut the order into ranges; sums run inside each range, and the few ranges'
    totals are added. The cuts decide only how the work is spread.
    """
    cuts = sorted({x for x in (df.select(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []) if x is not None})
    place = F.lit(0)
    for c in cuts:
        place = place + F.when(F.col(order) > F.lit(c), 1).otherwise(0)
    ranged = df.withColumn("_range", place)
    by = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.col("_range").desc() if descending else F.col("_range").asc()
    before = Window.orderBy(ahead).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    summed = ranged.select("*", *[F.sum(v).over(inside).alias(f"_i_{v}") for v in values]).join(F.broadcast(offsets), "_range")
    return summed.select(*df.columns, *[(F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values])
