"""Evaluation operators on fixed small cases: empty sides, zero denominators, ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluation as ev


def test_zero_denominators_are_null(spark):
    none = spark.createDataFrame([], "id long, format string, expression string")
    assert ev.formula_scores(none, none).first() == (0, 0, None, None)
    assert ev.review_recall(spark.createDataFrame([(0, 0)], "mismatched long, routed long")).first().recall is None
    docs = spark.range(2).selectExpr(*[f"0 as {c}" for c in {x for m in ev.MICRO_METRICS for x in m[1:] if x}])
    got = {r.metric: (r.samples, r.value) for r in ev.micro_metrics(docs, spark.createDataFrame([], "reference string, prediction string")).collect()}
    assert got["overall_cer"] == (0, None) and got["role_macro_f1"] == (0, None) and got["reading_order_kendall_tau"] == (2, 0.0)


def test_formulas_compare_without_blanks(spark):
    rows = "id long, format string, expression string"
    want = spark.createDataFrame([(1, "latex", "x + 1"), (2, "latex", "ab"), (3, "latex", "ab"), (4, "latex", "é")], rows)
    got = spark.createDataFrame([(1, "latex", "x+1"), (2, "mathml", "ab"), (4, "latex", "é "), (9, "latex", "z")], rows)
    assert ev.formula_scores(want, got).first() == (4, 3, 0.75, 0.5)


def test_topology_counts_repeated_cells(spark):
    t = spark.createDataFrame([(1, 2, 2), (2, 1, 1), (3, 1, 1)], "id long, n_rows int, n_columns int")
    kind = "id long, row int, column int, row_span int, column_span int"
    cells = spark.createDataFrame([(1, 0, 0, 1, 1), (1, 0, 0, 1, 1), (2, 0, 0, 1, 1)], kind)
    found = spark.createDataFrame([(1, 0, 0, 1, 1), (2, 0, 0, 1, 1)], kind)
    assert ev.topology_exact(t, cells, t, found).first() == (3, 2, pytest.approx(2 / 3))
    assert ev.topology_exact(t, cells, t.where("id = 1"), cells).first()[:2] == (3, 1)


def test_pages_scores_and_queues(spark):
    votes = spark.createDataFrame([("a", 3), ("a", 2), ("a", 3), ("a", 2), ("b", 9)], "g string, page int")
    assert {tuple(r) for r in ev.majority_page(votes, "g", "page").collect()} == {("a", 2), ("b", 9)}
    jobs = spark.createDataFrame([(1, "OCR", "3"), (2, "QUEUED", "1"), (3, "FAILED", "0"), (4, "RETRYING", "2")], "id int, status string, created_at string")
    assert [tuple(r)[:2] for r in ev.recovery_queue(jobs).collect()] == [(2, "QUEUED"), (4, "RETRYING"), (1, "RETRYING")]
    assert [r.id for r in ev.newest_first(jobs).collect()] == [1, 4, 2, 3]


def test_messages(spark):
    rows = spark.createDataFrame([("page 1/2",), ("PAGE 9/3",), ("page 1/0",), ("writing editable HWPX",), ("?",), (None,)], "m string")
    got = [tuple(r) for r in rows.select(*ev.message_progress(F.col("m"))).collect()]
    assert got == [("OCR", pytest.approx(0.4), 2), ("OCR", 0.7, 3), ("OCR", 0.7, 0), ("EXPORTING", 0.8, None), (None, None, None), (None, None, None)]


def test_safe_latex(spark):
    cases = {"x^{2}": True, "": False, "}{": False, "{{a}": False, "a\\b": False, "{a}{b}": True, "{}}{": False, "a\n": True}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, False)], "e string, want boolean")
    assert rows.where(ev.safe_latex(F.col("e")) != F.col("want")).collect() == []


def test_regions_keep_the_largest(spark):
    boxes = [(1, 0, 0, 0, 10, 10), (1, 1, 0, 0, 20, 20), (1, 2, 15, 15, 25, 25), (1, 3, 0, 0, 20, 20), (2, 0, 0, 0, 10, 10)]
    rows = [(page, pos, *map(float, box)) for page, pos, *box in boxes]
    got = ev.distinct_regions(spark.createDataFrame(rows, "page long, pos int, x0 double, y0 double, x1 double, y1 double"), "page").collect()
    assert {(r.page, r.pos) for r in got} == {(1, 1), (1, 2), (2, 0)}


def test_shared_lines(spark):
    rows = spark.createDataFrame([(1, 5, "a b"), (1, 2, "a b"), (2, 0, "a b"), (3, 0, "a"), (3, 1, "a")], "line int, cell int, t string")
    got = {(r.line, r.cell): r.t for r in ev.cell_texts(rows, "line", "cell", "t").collect()}
    assert got == {(1, 2): "a", (1, 5): "b", (2, 0): "a b", (3, 0): "a", (3, 1): "a"}


def test_rounding_is_that_of_python(spark):
    values = [0.5046875, 0.1234565, 0.0000005, 0.0000015, 2.5e-7, 1 / 3, 0.9999995, 0.25, 0.4890625, 61 / 128, *[k / (8 * n) for n in (7, 40, 80, 250, 1000) for k in range(0, 8 * n, 3)]]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ev.rounded(F.col("v"), 6).alias("r")).collect()
    assert [r.r for r in got] == [round(r.v, 6) for r in got]
