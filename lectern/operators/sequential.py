"""Groups in order, one at a time, without a data frame per group.

Rows are dealt by key and sorted inside their partitions, so that a group's rows follow each other in a
task; Arrow carries them in batches, whatever the size of the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.session import ship_package


def per_group(df: DataFrame, key: str, order: list[str], fn: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` over the rows of each group (tuples in the order of ``df``'s columns), sorted by ``order``."""
    ship_package(df.sparkSession)
    place, target = df.columns.index(key), StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for _, some in groupby(rows(batches), key=lambda r: r[place]):
            out.extend(fn(list(some)))
            if len(out) >= 8192:
                yield packed()
                out.clear()
        if out:
            yield packed()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, target)
