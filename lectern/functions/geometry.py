"""Boxes as four columns; pixel and normalised variants keep their own denominators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Left, top, right and bottom edge columns."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}{suffix}").cast("double") for c in ("x0", "y0", "x1", "y1")])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2

    def contains_center_of(self, other: Box, margin: float = 0.0) -> Column:
        return other.center_x.between(self.x0 - margin, self.x1 + margin) & other.center_y.between(self.y0 - margin, self.y1 + margin)


def _zero() -> Column:
    return F.lit(0.0)


def _one() -> Column:
    return F.lit(1.0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length shared by two intervals."""
    return F.greatest(_zero(), F.least(a1, b1) - F.greatest(a0, b0))


def intersection(a: Box, b: Box) -> Column:
    return overlap(a.x0, a.x1, b.x0, b.x1) * overlap(a.y0, a.y1, b.y0, b.y1)


def iou_pixels(a: Box, b: Box) -> Column:
    """Intersection over union, the union floored at one square pixel."""
    i = intersection(a, b)
    return i / F.greatest(_one(), a.area + b.area - i)


def iou_normalized(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the union is empty."""
    i = intersection(a, b)
    union = a.area + b.area - i
    return F.when(union > 0, i / union).otherwise(_zero())


def share_inside(a: Box, b: Box) -> Column:
    """Part of ``a`` inside ``b``; each side of ``a`` floored at one pixel."""
    return intersection(a, b) / (F.greatest(_one(), a.width) * F.greatest(_one(), a.height))


def coverage(subject: Box, container: Box) -> Column:
    """Part of ``subject`` that ``container`` covers; 0 for an empty subject."""
    return F.when(subject.area > 0, intersection(subject, container) / subject.area).otherwise(_zero())


def union_box() -> list[Column]:
    """Aggregates of the box around a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def column_index(b: Box, gutter: Column, width: Column) -> Column:
    """0 or 1 by the centre's side of the gutter; null if the box spans it by over 1 % of the width; 0 without gutter."""
    margin = width * 0.01
    return (
        F.when(gutter.isNull(), 0)
        .when((b.x0 < gutter - margin) & (b.x1 > gutter + margin), F.lit(None).cast("int"))
        .otherwise(F.when(b.center_x < gutter, 0).otherwise(1))
    )


def layout_zone(b: Box) -> Column:
    """Zone of a normalised box."""
    return (
        F.when(b.y0 < 0.08, "top_margin").when(b.y0 >= 0.92, "bottom_margin")
        .when((b.x0 < 0.2) & (b.x1 > 0.8), "spanning_body").when(b.center_x < 0.5, "left_body").otherwise("right_body")
    )


def clamp01(x: Column) -> Column:
    return F.greatest(_zero(), F.least(_one(), x))


#: Fixed value: layout units in a millimetre (7,200 an inch).
UNITS_PER_MM = 7200 / 25.4


def units_to_mm(units: Column) -> Column:
    return units / F.lit(UNITS_PER_MM)


def mm_to_units(mm: Column) -> Column:
    return F.round(mm * F.lit(UNITS_PER_MM)).cast("long")


def padded_crop(b: Box, scale: float, width: Column, height: Column, padding: float = 0.0) -> list[Column]:
    """A scaled, padded box in whole pixels, clipped to the image."""
    return [
        F.greatest(F.lit(0), F.floor(b.x0 * scale - padding)).cast("int").alias("crop_x0"),
        F.greatest(F.lit(0), F.floor(b.y0 * scale - padding)).cast("int").alias("crop_y0"),
        F.least(width, F.ceil(b.x1 * scale + padding)).cast("int").alias("crop_x1"),
        F.least(height, F.ceil(b.y1 * scale + padding)).cast("int").alias("crop_y1"),
    ]
