"""Connected components of a graph given by its edges, as repeated joins.

Each round lets every node point its larger neighbours, then its smaller ones, at the smallest node it
knows (large star, small star). The edge set shrinks to one star a component in a number of rounds that
grows with the logarithm of a component's diameter. Minima are combined before the shuffle, and the
joins are plain sort-merge joins, so that adaptive execution may split a hub's rows. Each round's edges are
written to the shared folder: lineage stays short and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import discard, materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its smallest node.

    Edges may repeat or be loops; a node with loops only is its own component. Null ends are ignored.
    """
    given = edges.select("a", "b").where("a is not null and b is not null")
    now = materialize(given.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    loops = now.where("u = v").select("u", "v")
    previous = None
    now, seen = now.where("u <> v"), None
    while True:
        facts = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if facts["n"] == 0 or seen == facts:
            break
        seen, before = facts, previous
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = previous = materialize(others.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large, *([before] if before is not None else []))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
