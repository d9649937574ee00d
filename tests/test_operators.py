"""Operators on small tables with results worked out by hand or by plain Python."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import anomaly, constraints, cumulative, filters, gates, grouped, joins, metrics, ranking, splits, windows
from lectern.sources import files
from lectern.streaming import jobs


def test_cer(spark):
    df = spark.createDataFrame([("abc", "adc"), ("가", "가")], "r string, p string")
    assert metrics.corpus_cer(df, "r", "p").first()["cer"] == 0.25
    assert metrics.corpus_cer(spark.createDataFrame([("", "가")], "r string, p string"), "r", "p").first()["cer"] == 1.0
    assert metrics.corpus_cer(df.where("false"), "r", "p").first()["cer"] is None


def test_order_agreement(spark):
    df = spark.createDataFrame([("a", i, 9 - i) for i in range(5)] + [("b", 1, 1)], "g string, r int, p int")
    got = {r["g"]: (r["kendall"], r["exact"]) for r in metrics.order_agreement(df, "g", "r", "p").collect()}
    assert got == {"a": (0.0, False), "b": (1.0, True)}


def test_average_precision_of_ties_ignores_order(spark):
    rows = [(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.9)]
    values = {metrics.average_precision(spark.createDataFrame(list(p), "y int, s double"), "y", "s").first()[0] for p in itertools.permutations(rows)if p[0][1] == 0.5}
    assert values == {0.5 * 1 + 0.5 * 2 / 4}


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x"), F.lit(1).alias("n"))
    got = {r["x"]: r["cum_n"] for r in cumulative.running_sums(df, "x", ["n"], buckets=8, descending=True).collect()}
    assert got == {float(i): 1000 - i for i in range(1000)}


def test_parser_numbers():
    assert grouped.accepted_numbers([1, 2, 4, 5]) == [True, True, True, True]
    assert grouped.accepted_numbers([1, 3, 2, 3]) == [True, False, True, True]
    assert grouped.accepted_numbers([1, 9, None, 2]) == [True, False, False, True]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.integers(0, 9, (rng.integers(1, 5), rng.integers(1, 5)))
        small = w if w.shape[0] <= w.shape[1] else w.T
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert sum(w[i, j] for i, j in grouped.best_assignment(w)) == best
    assert grouped.best_assignment(np.array([[5, 4], [4, 0]])) == [(0, 1), (1, 0)]  # not greedy


def test_grouped_operators(spark):
    boxes = spark.createDataFrame([(1, 0, "t", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, "t", 0.8, 1.0, 0.0, 11.0, 10.0), (1, 2, "i", 0.7, 1.0, 0.0, 11.0, 10.0)], "page int, pos int, label string, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["pos"] for r in grouped.non_maximum_suppression(boxes, "page", 0.5).collect()) == [0, 2]
    assert grouped.rectangles_of([(0, 0, True, False), (0, 1, False, True), (1, 0, False, False), (1, 1, False, False)]) == [(0, 0, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1)]
    assert grouped.rectangles_of([(0, 0, True, False), (0, 1, False, False)]) == [(0, 0, 1, 2)]
    assert grouped.runs_of([0, 10, 20, 30, 100, 110, 120], 1.75, 3) == [(0, 30, 4), (100, 120, 3)]


def test_mean_and_previous_member_clusters_differ(spark):
    values = [0.0, 10.0, 20.0]
    assert grouped.clusters_of(values, 10.0) == [[0.0, 10.0], [20.0]]
    df = spark.createDataFrame([("a", v) for v in values], "o string, v double")
    assert windows.merged_positions(df, "o", "v", 10.0).count() == 1


def test_constraints(spark):
    tables = spark.createDataFrame([("a", 2, 2), ("b", 1, 2), ("big", 20_000, 1)], "t string, n_rows int, n_columns int")
    cells = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 0, 1, 2, 1), ("b", 0, 0, 1, 3)], "t string, row int, column int, row_span int, column_span int")
    got = {(r["rule"], r["key"]) for r in constraints.grid_violations(tables, cells, "t").collect()}
    assert got == {("table_too_large", "big"), ("cells_overlap", "a"), ("grid_not_covered", "a"), ("cell_out_of_bounds", "b")}


def test_gates(spark):
    g = spark.createDataFrame([("a", "<=", 1.0), ("b", ">=", 1.0), ("c", "==", 1.0)], "id string, comparator string, threshold double")
    m = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "id string, value double")
    decided = gates.decide(g, m)
    assert {r["id"]: r["status"] for r in decided.collect()} == {"a": "passed", "b": "b.failed", "c": "c.unmeasured"}
    assert tuple(gates.release(decided).first()) == (False, "b.failed,c.unmeasured")
    reports = spark.createDataFrame([("baseline", 0.2, 1.0, 8), ("candidate", 0.1, 0.99, 8)], "role string, cer double, coverage double, pages int")
    assert gates.promotion(reports).first()["promote"] is True


def test_retrieval(spark):
    chunks = spark.createDataFrame([("a", "Package header", "intro", "text of header", ["HWPX", "package"]), ("b", "other", "header", "x", ["package"]), ("c", "none", "none", "none", ["package"])], "id string, title string, section string, text string, tags array<string>")
    q = spark.createDataFrame([(1, "package  HEADER", ["Package"])], "query_id int, query string, tags array<string>")
    got = [(r["id"], r["score"]) for r in ranking.top(q, chunks, 5).orderBy("rank").collect()]
    assert got == [("a", 8 + 4 + 4 + 1 + 3), ("b", 8 + 3), ("c", 8)]


def test_filters_and_joins(spark):
    dictionary = F.lit(list("abc 1"))
    got = [spark.range(1).select(filters.line_reason(F.lit(t), dictionary, 5)).first()[0] for t in ("a", "--", "abcabc", "abd", "abc")]
    assert got == ["empty_or_symbol_only", "empty_or_symbol_only", "too_long", "unsupported_character", None]
    a = spark.createDataFrame([(1, 1), (2, None)], "k int, v int")
    b = spark.createDataFrame([(1, 1), (2, None), (3, 5)], "k int, v int")
    assert [r["k"] for r in joins.differing(a, b, ["k"], "v").collect()] == [3]
    new, stored = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1)], "k string, v int"), spark.createDataFrame([("y", 9)], "k string, v int")
    assert splits.idempotent_rows(new, stored, ["k"]).count() == 2


def test_reconstruction_error(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4)) @ np.diag([3, 2, 0.1, 0.1])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    model = anomaly.fit(df, "v", 2)
    got = np.array([r[0] for r in df.select(model.error(F.col("v"))).collect()])
    c = x - x.mean(axis=0)
    lead = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(got, ((c - c @ lead.T @ lead) ** 2).mean(axis=1), atol=1e-9)


def test_strict_json():
    assert files.json_problem('{"a": [1, 2.5, null]}') is None
    assert files.json_problem('{"a": 1, "a": 2}') == "repeated key"
    assert files.json_problem("NaN") == "number is not finite" and files.json_problem("1e999") == "number is not finite"
    assert files.json_problem(str(2**63)) == "integer out of range"
    assert files.json_problem("[" * 70 + "]" * 70) == "too deep"
    assert files.json_problem("{") is not None


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "B.PDF").write_bytes(b"b")
    (tmp_path / "in" / "a.txt").write_bytes(b"a")
    (tmp_path / "in" / "c.exe").write_bytes(b"c")
    assert [r["path"].rsplit("/", 1)[-1] for r in files.list_files(spark, str(tmp_path / "in"), ["pdf", "txt"]).collect()] == ["a.txt", "B.PDF"]
    (tmp_path / "l.tsv").write_text("img1\ta\tb\nno tab\nimg2\t\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.tsv")).collect()] == [("img1", "a\tb"), ("img2", "")]
    schema = "k string, v double"
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema)
    for _ in range(2):
        files.append_metrics(rows, str(tmp_path / "log"), ["k"], schema)
    assert spark.read.schema(schema).option("header", "true").csv(str(tmp_path / "log")).count() == 2
    files.write_per_split(rows.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_per_split(rows.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    raw = spark.createDataFrame([(b"\xef\xbb\xbfa",), ("가".encode("cp949"),), (b"a\0",)], "b binary")
    assert [r[0] for r in raw.select(files.decode_member("b")).collect()] == ["a", "가", None]
    assert spark.range(1).select(files.canonical_json(F.lit('{"b": 1, "a": "가"}'))).first()[0] == '{"a":"가","b":1}'


LEGAL = [("new", "run"), ("run", "done"), ("run", "retry"), ("retry", "run")]


def test_requests_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"id": "1", "method": "convert", "path": "x"}\nbroken\n')
    good, bad = [], []
    stream = spark.readStream.text(str(tmp_path / "in"))
    jobs.serve(stream, lambda d: good.extend(d.collect()), lambda d: bad.extend(d.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["id"] for r in good] == ["1"] and [r["value"] for r in bad] == ["broken"]


def test_job_stream_equals_replay(spark, tmp_path):
    events = [("j1", 1, "new"), ("j1", 2, "done"), ("j1", 3, "run"), ("j1", 4, "done"), ("j2", 1, "new")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("job", "seq", "state"), e, strict=True))) for e in events))
    schema = "job string, seq long, state string"
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = jobs.track_jobs(stream, "job", "state", "seq", LEGAL).writeStream.format("memory").queryName("jobs_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    expected = jobs.replay_jobs(spark.createDataFrame(events, schema), "job", "state", "seq", LEGAL)
    assert sorted(map(tuple, spark.table("jobs_out").collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_pages_and_resume(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "doc string, page int")
    expected = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "doc string, expected long")
    assert sorted(r["doc"] for r in jobs.incomplete_documents(pages, expected, "doc", "page").collect()) == ["b", "c"]
    assert jobs.pending(expected, expected.where("doc = 'a'"), ["doc"]).count() == 2
