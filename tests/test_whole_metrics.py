"""The error-rate queries over all lines, long and accented ones too, against brute force."""

from __future__ import annotations

import pytest

from lectern.plans import registry

from .llm.helpers import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_of_all_lines(spark, tmp_path):
    texts = ["tree\nab cd", "élève près\n\n" + "never ending " * 40, "가나 e\nxyz"]
    documents(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(x, x.replace("e", "")) for t in texts for x in t.split("\n") if x]
    bare = [("".join(a.split()), "".join(b.split())) for a, b in pairs]
    errors, bare_errors = sum(distance(a, b) for a, b in pairs), sum(distance(a, b) for a, b in bare)
    n, bare_n = sum(len(a) for a, _ in pairs), sum(len(a) for a, _ in bare)
    get = lambda name: registry.queries()[name](spark, str(tmp_path)).first()
    r = get("cer_corpus_whole")
    assert (r.errors, r.characters, r.cer) == (errors, n, pytest.approx(errors / n))
    r = get("cer_benchmark_whole")
    assert (r.errors, r.characters, r.cer) == (bare_errors, bare_n, pytest.approx(bare_errors / bare_n))
    r = get("recognizer_metrics_whole")
    assert (r.lines, r.exact, r.errors, r.cer) == (len(pairs), sum(a == b for a, b in pairs), errors, pytest.approx(errors / n))
