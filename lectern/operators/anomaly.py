"""Reconstruction error under the leading directions of a training split."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Directions:
    """Mean and leading directions of vectors."""

    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]

    def error(self, vector: Column) -> Column:
        """Mean squared difference of a vector and its projection; one expression, no Python."""
        centered = F.zip_with(vector, F.lit(list(self.mean)), lambda x, m: x.cast("double") - m)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        total = F.transform(F.array(centered), lambda c: dot(c, c) - sum((dot(c, F.lit(list(d))) * dot(c, F.lit(list(d))) for d in self.components), F.lit(0.0)))[0]
        return F.greatest(F.lit(0.0), total) / len(self.mean)


def fit(train: DataFrame, vector: str, rank: int) -> Directions:
    """Mean and second moments are summed on the executors; the driver gets one matrix of the vectors' width squared."""
    width = len(train.select(vector).first()[0])
    x = lambda i: F.col(vector)[i].cast("double")
    means = train.agg(F.count("*").alias("n"), *[F.avg(x(i)).alias(f"m{i}") for i in range(width)]).first()
    mean = np.array([means[f"m{i}"] for i in range(width)])
    c = F.zip_with(vector, F.lit(mean.tolist()), lambda a, m: a.cast("double") - m)
    rows = train.select(c.alias("c")).select(F.posexplode("c").alias("i", "a"), "c").select("i", F.posexplode(F.transform("c", lambda b: b * F.col("a"))).alias("j", "p"))
    moments = np.zeros((width, width))
    for r in rows.groupBy("i", "j").agg(F.sum("p").alias("s")).collect():  # width squared rows
        moments[r["i"], r["j"]] = r["s"]
    values, vectors = np.linalg.eigh(moments)
    lead = vectors[:, np.argsort(values)[::-1][:rank]].T
    return Directions(tuple(mean.tolist()), tuple(tuple(d) for d in lead.tolist()))


def threshold(scored: DataFrame, error: str, share: float = 0.995) -> float:
    """The error that ``share`` of the rows stay under, with linear interpolation."""
    return scored.agg(F.expr(f"percentile({error}, {share})")).first()[0]
