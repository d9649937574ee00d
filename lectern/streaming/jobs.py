"""Streams of requests and job events, each with a batch twin that tests compare it with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.sequential import per_group

REQUEST = "id string, method string, path string"


def parse_requests(lines: DataFrame) -> DataFrame:
    """Requests from JSON lines (column value); a bad line becomes a row with an error and stops nothing. Streams or batches."""
    parsed = F.from_json("value", f"{REQUEST}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = F.col("r._corrupt").isNotNull() | F.col("r.id").isNull() | F.col("r.method").isNull()
    return lines.select("value", parsed.alias("r")).select("r.id", "r.method", "r.path", F.when(bad, "bad_request").alias("error"), "value")


def serve(requests: DataFrame, handle: Callable[[DataFrame], None], reject: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Feed good requests of each micro-batch to ``handle`` and bad ones to ``reject``."""

    def batch(df: DataFrame, _: int) -> None:
        parsed = parse_requests(df).persist()
        handle(parsed.where("error is null"))
        reject(parsed.where("error is not null"))
        parsed.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages_once(pages: DataFrame, document: str, page: str, time: str, delay: str) -> DataFrame:
    """Each page of a document once, however often it is reported within ``delay``."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark([document, page])


def incomplete_documents(pages: DataFrame, expected: DataFrame, document: str, page: str) -> DataFrame:
    """Documents of which not every expected page was handled exactly once (batch)."""
    seen = pages.groupBy(document).agg(F.count("*").alias("rows"), F.count_distinct(page).alias("pages"))
    return expected.join(seen, document, "left").where(~((F.col("rows") == F.col("expected")) & (F.col("pages") == F.col("expected"))) | F.col("rows").isNull())


def pending(requested: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose digest, status and settings have not been recorded as finished."""
    return requested.join(finished.select(*keys).distinct(), keys, "left_anti")


def track_jobs(events: DataFrame, job: str, state: str, order: str, legal: list[tuple[str, str]], keep: int = 1000) -> DataFrame:
    """Job machines over a stream of events: each event with the state before it and whether the step is legal.

    An illegal step leaves the state as it was. At most the last ``keep`` states of a job are remembered.
    """
    allowed = set(legal)

    def step(key: tuple, batches: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        now, log = memory.get if memory.exists else (None, "")
        out = []
        for pdf in batches:
            for o, s in pdf[[order, state]].sort_values(order).itertuples(index=False):
                ok = now is None or (now, s) in allowed
                out.append((key[0], o, now, s, ok))
                if ok:
                    now = s
                    log = "\n".join([*log.split("\n"), s][-keep:]).strip("\n")
        memory.update((now, log))
        yield pd.DataFrame(out, columns=[job, order, "from_state", "to_state", "legal"])

    kinds = dict(events.dtypes)
    schema = f"{job} {kinds[job]}, {order} {kinds[order]}, from_state string, to_state string, legal boolean"
    return events.groupBy(job).applyInPandasWithState(step, schema, "now string, log string", "append", GroupStateTimeout.NoTimeout)


def replay_jobs(events: DataFrame, job: str, state: str, order: str, legal: list[tuple[str, str]]) -> DataFrame:
    """The batch twin of ``track_jobs``."""
    allowed, kinds = set(legal), dict(events.dtypes)

    def run(rows: list[tuple]) -> list[tuple]:
        now, out = None, []
        for j, o, s in rows:
            ok = now is None or (now, s) in allowed
            out.append((j, o, now, s, ok))
            now = s if ok else now
        return out

    return per_group(events.select(job, order, state), job, [order], run, f"{job} {kinds[job]}, {order} {kinds[order]}, from_state string, to_state string, legal boolean")
