from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import decontamination
from lectern.llm.queries import QUERIES

from .helpers import awkward, clashing, documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    doc, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=4))
def test_search_equals_brute_force(doc, items):
    text, bench = " ".join(doc), [(str(i), " ".join(x)) for i, x in enumerate(items)]
    spans, found = decontamination.WuManber([(i, x.encode()) for i, x in bench], 5).search(decontamination.words_of(text.encode()))
    hit = {p for a, n in spans for p in range(a, a + n)}
    expected = brute(text, bench, 5)
    assert (len(hit), len(found)) == expected[1:3]
    flat = decontamination._merged([x for pair in spans for x in pair])
    assert sum(flat[1::2]) == len(hit)


def test_on_the_tables(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_decontamination"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    assert sum(x[4] for x in got.values()) > 0
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(0, len(w) - 9))}
    for d, text in docs.items():
        w = words(text)
        if got[d][4] or any(tuple(w[i : i + 10]) in windows for i in range(len(w))):
            assert got[d] == brute(text, items)


def test_awkward_rows_and_blocks_of_the_benchmark(spark):
    items = [(10, "three four five"), (9, "ONE two, three"), (9, "nine-ten"), (8, None), (None, "one"), (7, "..."), (6, "Café été")]
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"), "hits")
    df = clashing(awkward(spark), "hits", "items", "n_hit")
    expected = sorted((r.doc_id or 0, *brute(r.text, [x for x in items if x[0] is not None])) for r in df.collect())
    for size in (1, 1 << 20):
        got = decontamination.judge(df, bench, block_bytes=size).collect()
        assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in got) == expected
    none = decontamination.judge(df, bench.where("false")).collect()
    assert len(none) == df.count() and not any(r.contaminated for r in none)
    assert decontamination.judge(df.where("false"), bench).count() == 0


def test_non_ascii_words(spark):
    df = documents(spark, [(1, "一二 ÜBER straße"), (2, "一二 über straße")])
    bench = spark.createDataFrame([(1, "ÜBER Straße")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.judge(df, bench).collect()} == {1: 2, 2: 0}
