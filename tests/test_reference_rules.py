"""Operators against the values their rules ask for; expected values are fixed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.geometry import Box
from lectern.operators import filters, grouped, metrics, ranking


def test_training_lines_are_cut_at_line_ends_first():
    assert text.training_lines_of("first line here\nsecond line here\r\n x \n--") == ["first line here", "second line here"]
    source = "다음 글을 읽고 물음에 답하시오. 우리말 문장을 정확하게 인식해야 합니다."
    got = text.training_lines_of(source, longest=20)
    assert all(2 <= len(x) <= 20 for x in got) and "".join(got).replace(" ", "") == source.replace(" ", "")


def test_chunks_keep_other_blanks():
    body = "a\u00a0b \t c " * 10
    assert text.chunks_of(body, 1000, 10) == ["a\u00a0b c " * 9 + "a\u00a0b c"]
    long = " ".join(f"w{i}" for i in range(200))
    got = text.chunks_of(long, 100, 20)
    assert all(len(x) <= 100 for x in got) and got[0] == long[: len(got[0])] and got[-1] == long[-len(got[-1]) :]


def test_em_width(spark):
    row = spark.createDataFrame([("가 (A)b1",)], "t string").select(text.em_width("t").alias("w")).first()
    assert row.w == pytest.approx(0.97 + 0.3 + 2 * 0.32 + 0.7 + 0.52 + 0.55)


def test_row_runs():
    assert grouped.row_runs([0, 10, 20, 30, 100, 110, 120], 10) == [(0, 30, 4), (100, 120, 3)]
    assert grouped.row_runs([0, 10, 20, 34, 44, 54], 10) == [(0, 20, 3), (34, 54, 3)]
    assert grouped.row_runs([0, 5, 10, 15], 10) == [] and grouped.row_runs([0, 33, 66], 10) == []


def test_label_reasons(spark):
    box, none = Box(F.lit(0.0), F.lit(0.0), F.lit(7.0), F.lit(20.0)), F.array().cast("array<string>")
    some = F.array(F.lit("x"))
    cases = [(0.5, none, "language_quality"), (1.0, some, "review_reason"), (1.0, none, "tiny_box")]
    one = spark.range(1)
    for quality, reasons, expected in cases:
        assert one.select(filters.label_reason(F.lit("abc"), F.lit(1.0), F.lit(quality), reasons, box)).first()[0] == expected


def test_retrieval_by_tags_and_phrases(spark):
    rows = [("z-tie", "표", "개체", "표 정의", ["table"]), ("a-tie", "표", "개체", "표 정의", ["table"]), ("style-tag", "일반 규칙", "참조", "표 정의", ["table", "style"]), ("paragraph", "문단", "본문", "문단 정의", ["paragraph"]), ("package", "Package header", "x", "y", [])]
    chunks = spark.createDataFrame(rows, "id string, title string, section string, text string, tags array<string>")
    queries = spark.createDataFrame([(1, "표", []), (2, "표", ["STYLE", "table"]), (3, "없는검색어", []), (4, "", ["table"]), (5, "pack", []), (6, "", [])], "query_id int, query string, tags array<string>")
    got = {}
    for r in ranking.top(queries, chunks, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert [x for x, _ in got[1]] == ["a-tie", "z-tie", "style-tag"] and [x for x, _ in got[2]] == ["style-tag"]
    assert got[4] == [("a-tie", 0), ("style-tag", 0), ("z-tie", 0)] and got[5] == [("package", 3)] and 3 not in got and 6 not in got


def test_token_distance(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abc") for _ in range(rng.randrange(6))]) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", metrics.token_distance(F.col("a"), F.col("b")).alias("d"))
    assert all(r.d == distance(r.a, r.b) for r in df.collect())
