"""Deterministic splits and short ids from hashes. The four split rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_number(digest: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def _ranges(bucket: Column, first: int, second: int) -> Column:
    return F.when(bucket < first, "train").when(bucket < second, "validation").otherwise("test")


def split_by_content(digest: ColumnOrName, namespace: str, eligible: Column | None = None) -> Column:
    """70/15/15 by sha256 of a namespace and a content digest; null where not eligible."""
    bucket = hex_number(F.sha2(F.concat(F.lit(namespace), _c(digest)), 256)) % 100
    split = _ranges(bucket, 70, 85)
    return split if eligible is None else F.when(eligible, split)


def split_by_id(identifier: ColumnOrName) -> Column:
    """80/10/10 by sha256 of an id."""
    return _ranges(hex_number(F.sha2(_c(identifier).cast("string"), 256)) % 100, 80, 90)


def split_seeded(key: ColumnOrName, namespace: str, seed: int | str) -> Column:
    """80/10/10 by sha256 of namespace, seed and key, separated by NUL."""
    nul = F.char(F.lit(0))
    return _ranges(hex_number(F.sha2(F.concat(F.lit(namespace), nul, F.lit(str(seed)), nul, _c(key).cast("string")), 256)) % 100, 80, 90)


def split_with_precedence(frozen_document: Column, frozen_family: Column, family: Column, lineage: Column, namespace: str, seed: int | str) -> Column:
    """A frozen document split, else a frozen family's, else the family's hash, else the lineage's."""
    return F.coalesce(frozen_document, frozen_family, F.when(family.isNotNull(), split_seeded(family, namespace, seed)), split_seeded(lineage, namespace, seed))


def split_by_first_byte(identifier: ColumnOrName, seed: int | str) -> Column:
    """About 80/10/10 by the first digest byte of ``seed:id``: under 204, under 230, else."""
    byte = hex_number(F.sha2(F.concat(F.lit(f"{seed}:"), _c(identifier).cast("string")), 256), 2)
    return _ranges(byte, 204, 230)


def short_id(*parts: ColumnOrName, length: int = 16) -> Column:
    """A content id: the first hex digits of sha256 over the parts, separated by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[_c(p).cast("string") for p in parts]), 256), 1, length)


def unit_score(identifier: ColumnOrName) -> Column:
    """A reproducible number in [0, 1] for an id."""
    return hex_number(F.sha2(_c(identifier).cast("string"), 256), 4) / F.lit(65535.0)
