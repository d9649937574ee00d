"""Row filters as ordered cascades: the first reason that holds is the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.geometry import Box
from lectern.functions.text import intrinsic_reasons, trim_space

HAS_LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
#: File kinds by extension.
OFFICE, IMAGES = ("hwp", "hwpx", "docx"), ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def label_reason(text: Column, confidence: Column, quality: Column, reasons: Column, box: Box, least_confidence: float = 0.985, least_quality: float = 0.92) -> Column:
    """Why a machine label is not used for training; ``accepted`` if it is."""
    t = trim_space(text)
    return (
        F.when(~F.length(t).between(2, 60), "length").when(~t.rlike(HAS_LETTER_OR_DIGIT), "no_alphanumeric")
        .when(confidence < least_confidence, "confidence").when(quality < least_quality, "language_quality")
        .when(F.size(reasons) > 0, "review_reason").when((box.width < 8) | (box.height < 6), "tiny_box").otherwise("accepted")
    )


def unsupported(text: Column, dictionary: Column) -> Column:
    """Whether a text has a character outside the dictionary (an array)."""
    return F.size(F.array_except(F.filter(F.split(text, ""), lambda c: c != ""), dictionary)) > 0


def line_reason(text: Column, dictionary: Column, longest: int) -> Column:
    """Why a line is rejected; null if it is not."""
    return F.when((F.length(text) < 2) | ~text.rlike(HAS_LETTER_OR_DIGIT), "empty_or_symbol_only").when(F.length(text) > longest, "too_long").when(unsupported(text, dictionary), "unsupported_character")


def review_reasons(confidence: Column, reasons: Column) -> Column:
    """Reasons with the low-confidence one added where it holds."""
    low = F.when(confidence < 0.75, F.array(F.lit("low_ocr_confidence"))).otherwise(F.array().cast("array<string>"))
    return F.array_union(reasons, low)


def file_role(name: Column, answer_pattern: str = r"(?i)정답|답안|해설|answer") -> Column:
    """Role of a file by name and extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return F.when(stem.rlike(answer_pattern), "answer_key").when(ext == "pdf", "source_pdf").when(ext.isin(*OFFICE), "editable_reference").when(ext.isin(*IMAGES), "image_reference").otherwise("unsupported")


def too_sparse(characters: Column, pictures: Column, pages: Column) -> Column:
    """Whether a target has too little text and too few pictures for its source's pages."""
    n = F.greatest(F.lit(1), pages)
    return (characters < n * 180) & (pictures < n)


def region_placement(label: Column, confidence: Column, source: Column) -> Column:
    """Where a detected region goes; null drops it."""
    weak = (source == "opencv_ruled_region") & (confidence < 0.7)
    return F.when(confidence < 0.45, F.lit(None).cast("string")).when(label == "image", "image").when((label == "table") & weak, "passage_box").when(label.isin("table", "passage_box"), label)


def frame_or_table(label: Column, box: Box, width: Column, height: Column) -> Column:
    """A "table" that covers much of the page is its frame."""
    large = (box.area / (width * height) > 0.25) | ((box.width / width > 0.35) & (box.height / height > 0.6))
    return F.when((label == "table") & large, "page_frame").otherwise(label)


def ruled_region(box: Box, width: Column, height: Column) -> Column:
    """Whether a ruled rectangle is a region: wide and high enough, neither tiny nor most of the page."""
    area = box.area / (width * height)
    return (box.width / width >= 0.12) & (box.height / height >= 0.025) & area.between(0.003, 0.45)


def formula_status(detection: Column, recognition: Column, expression: Column, valid: Column, threshold: float) -> Column:
    """accepted, review, or image_fallback for an empty expression."""
    return F.when(trim_space(expression) == "", "image_fallback").when((F.least(detection, recognition) >= threshold) & valid, "accepted").otherwise("review")


def node_needs_review(candidate_texts: Column, confidence: Column, quality: Column) -> Column:
    """Whether the candidates disagree or the selected one is weak."""
    return (F.size(F.array_distinct(candidate_texts)) > 1) | (confidence < 0.75) | F.coalesce(quality < 0.75, F.lit(False))


def second_reading(text: Column, confidence: Column) -> Column:
    return (confidence < 0.88) | (F.size(intrinsic_reasons(text, confidence)) > 0)
