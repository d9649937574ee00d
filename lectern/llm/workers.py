"""Running Arrow functions on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lectern.session import ship_package


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` after this package's code went to the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


class Remembered(dict):
    """``make`` of short keys, remembered: at most ``limit`` keys of at most ``LONGEST`` bytes or characters each.

    Long keys are made anew each time, and a full memory is emptied at once, so it is bounded in bytes whatever the texts hold.
    """

    LONGEST = 48

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


_owner: list = [None, None]


def own(name: str, forget: Callable[[], None]) -> None:
    """Say at the start of a task whose memory this worker holds; what another operator remembered here is dropped first."""
    if _owner[0] not in (None, name):
        _owner[1]()
    _owner[:] = name, forget


def blobs(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null as None."""
    return column.cast(pa.large_binary()).to_pylist()
