"""Readers and writers for manifests, reports, labels and knowledge files. Schemas are explicit."""

from __future__ import annotations

import codecs
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType


def list_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Files below ``folder`` with an allowed extension: path, length and sha256, by folded path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(ext.isin(*extensions)).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy(F.lower("path"), "path")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON objects, one a line; blank lines are skipped, anything else that does not fit the schema fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``image<TAB>text`` lines, split at the first tab; lines without a tab are skipped."""
    raw = spark.read.text(path).where(F.contains("value", F.lit("\t")))
    cut = F.split("value", "\t", 2)
    return raw.select(cut[0].alias("image"), cut[1].alias("text"))


def unique_keys(pairs: list) -> dict:
    """A JSON object's pairs as a dict; a repeated key is an error."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def json_problem(text: str, max_depth: int = 64, max_nodes: int = 100_000) -> str | None:
    """Why a text is not strict JSON (no repeated keys, finite numbers, 64-bit integers, bounded size), or None."""

    def number(s: str) -> int:
        n = int(s)
        if not -(2**63) <= n < 2**63:
            raise ValueError("integer out of range")
        return n

    def refuse(s: str):
        raise ValueError("number is not finite")

    def finite(s: str) -> float:
        x = float(s)
        return x if abs(x) != float("inf") else refuse(s)

    try:
        value = json.loads(text, object_pairs_hook=unique_keys, parse_int=number, parse_float=finite, parse_constant=refuse)
    except RecursionError:
        return "too deep"
    except ValueError as e:
        return str(e).split(":")[0]
    stack, nodes = [(value, 1)], 0
    while stack:
        x, depth = stack.pop()
        nodes += 1
        if depth > max_depth:
            return "too deep"
        if nodes > max_nodes:
            return "too many values"
        children = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        stack += [(y, depth + 1) for y in children]
    return None


@pandas_udf(StringType())
def strict_json_problem(s: pd.Series) -> pd.Series:
    """``json_problem`` of each text; null is a problem, too."""
    return s.map(lambda x: "missing" if x is None else json_problem(x))


@pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks, as hashed for contract digests."""
    return s.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")), na_action="ignore")


def contract_digest(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


@pandas_udf(StringType())
def decode_member(s: pd.Series) -> pd.Series:
    """Text of a file member: UTF-8 with or without mark, else the Korean code page; null if it holds NUL or neither fits."""

    def one(raw: bytes) -> str | None:
        if b"\0" in raw:
            return None
        for name in ("utf-8-sig", "cp949"):
            try:
                return codecs.decode(raw, name)
            except UnicodeDecodeError:
                continue
        return None

    return s.map(one, na_action="ignore")


def write_per_split(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in one folder a split; refuses to overwrite."""
    df.write.mode("errorifexists").partitionBy(split).json(path)


def append_metrics(rows: DataFrame, path: str, keys: list[str], schema: str) -> None:
    """Append metric rows as CSV, without those whose keys the log holds already."""
    from lectern.operators.splits import idempotent_rows

    try:
        stored = rows.sparkSession.read.schema(schema).option("header", "true").csv(path)
        new = idempotent_rows(rows, stored, keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = rows
    new.write.mode("append").option("header", "true").csv(path)
