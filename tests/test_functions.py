"""Text, split and geometry functions on literals with known results."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry, hashing, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_critical_tokens(spark):
    assert one(spark, text.critical_tokens("t"), t="1. 다음 문항은 [3점] ① ㉠") == ["question:1", "score:3", "circled:①", "hangul:㉠"]


@pytest.mark.parametrize(("line", "number"), [("12. 다음 글", 12), ("1) 가", None), ("1) 다음 글을 읽고 답하시오", 1), ("가 1.", None), ("1234. x", None)])
def test_question_number(spark, line, number):
    assert one(spark, text.question_number("t"), t=line) == number


@pytest.mark.parametrize(
    ("line", "started", "role"),
    [("3. 문항", False, "question"), ("① 답", True, "choice"), ("① 답", False, "unknown"), ("[1~3] 다음을", False, "instruction"), ("- 출처 -", False, "source"), ("(가) 지문", False, "passage"), ("글", True, "unknown")],
)
def test_line_role(spark, line, started, role):
    assert one(spark, text.line_role("t", F.col("s")), t=line, s=started) == role


def test_normalizers(spark):
    assert one(spark, text.strip_space("t"), t="a b \n c") == "abc"
    assert one(spark, text.strip_space_and_format("t"), t="a​b c") == "abc"
    assert one(spark, text.collapse_blanks("t"), t=" a\t  b ") == "a b"
    assert one(spark, text.name_key("t"), t="(고3) Mock-Exam 2025 (2)") == "mockexam2025"
    assert one(spark, text.safe_name("t"), t=' a:b/c?.') == "a_b_c_"
    assert one(spark, text.repair_slips("t"), t="옳은 것혼? [3점] 보기> <보기>") == "옳은 것은? [3점] <보기> <보기>"
    assert one(spark, text.nfc("t"), t="é") == "é" and one(spark, text.nfkc("t"), t="①") == "1"
    assert one(spark, text.utf16_length("t"), t="a\U0001f600") == 3


def test_quality_and_decision(spark):
    assert one(spark, text.quality_score("t", F.lit(0.9)), t="  ") == 0.0
    assert one(spark, text.quality_score("t", F.lit(1.0)), t="abcdefgh") == pytest.approx(0.52 + 0.28 + 0.06 + 0.08)
    got = one(spark, text.engine_decision(F.col("a"), F.lit(0.5), F.col("b"), F.lit(0.95)), a="1. abc??def", b="1. abcdef")
    assert got["engine"] == "second" and got["text"] == "1. abcdef"
    assert one(spark, text.intrinsic_reasons("t", F.lit(0.5)), t="a??�") == ["low_ocr_confidence", "invalid_character", "suspicious_character_sequence"]


def test_formula_syntax(spark):
    for e, kind, ok in [("\\frac{a}{b}", "latex", True), ("}{", "latex", False), ("{a", "latex", False), ("a \\frac ", "latex", False), ("<math>x</math>", "mathml", True), ("x", "mathml", False)]:
        assert one(spark, text.formula_is_valid("t", F.col("k")), t=e, k=kind) is ok


def test_chunks():
    assert text.chunks_of("short", 100, 10) == []
    body = "word " * 100
    got = text.chunks_of(body, 100, 20)
    assert all(len(c) <= 100 for c in got) and got[0].startswith("word") and "".join(got).count("word") >= 100
    assert text.training_lines_of("a" * 60 + " b1 ..") == ["a" * 55, "aaaaa b1 .."]


def test_visible_text(spark):
    html = "<p>a &amp; b<script>var t='</p>';</script></p><svg><style>x</style>hidden</svg><div>c<br>d</div>"
    assert [x for x in one(spark, text.visible_text("t"), t=html).split("\n") if x] == ["a & b", "c", "d"]


def test_split_rules(spark):
    for i in range(40):
        bucket = int(hashlib.sha256(str(i).encode()).hexdigest()[:8], 16) % 100
        assert one(spark, hashing.split_by_id("t"), t=str(i)) == ("train" if bucket < 80 else "validation" if bucket < 90 else "test")
        digest = hashlib.sha256(b"ns\x007\x00" + str(i).encode()).hexdigest()
        bucket = int(digest[:8], 16) % 100
        assert one(spark, hashing.split_seeded("t", "ns", 7), t=str(i)) == ("train" if bucket < 80 else "validation" if bucket < 90 else "test")
    assert one(spark, hashing.split_by_content("t", "x:", F.lit(False)), t="a") is None


def test_geometry(spark):
    a = geometry.Box(*[F.lit(float(v)) for v in (0, 0, 10, 10)])
    b = geometry.Box(*[F.lit(float(v)) for v in (5, 0, 15, 10)])
    assert one(spark, geometry.iou_pixels(a, b)) == pytest.approx(1 / 3)
    assert one(spark, geometry.share_inside(a, b)) == 0.5
    point = geometry.Box(*[F.lit(0.5)] * 4)
    assert one(spark, geometry.iou_normalized(point, point)) == 0.0
    assert one(spark, geometry.mm_to_units(F.lit(25.4))) == 7200
    assert one(spark, geometry.column_index(a, F.lit(5.0), F.lit(100.0))) is None
