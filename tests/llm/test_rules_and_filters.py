"""Quality rules, url filters, licence scans and the classifier."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, license_scans, quality_classifier, quality_rules, url_filters
from lectern.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

from .helpers import awkward, clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    df = QUERIES[name](spark, sf_dir)
    r = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(r.fetchall())


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts_of_awkward_rows(spark):
    df = clashing(awkward(spark).union(documents(spark, [(9, "a b c d e f a b c d e\nx\nx\n \n a b c d e # | é"), (10, "a a a a a a a")])), "n_words", "votes", "kept")
    got = sorted(map(tuple, quality_rules.judge(df).select(F.coalesce("doc_id", F.lit(0)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    assert got == sorted((r.doc_id or 0, *counts(r.text)) for r in df.collect())
    assert quality_rules.judge(df.where("false")).count() == 0
    assert quality_rules.keep(df).columns == df.columns


def test_rules_keep_clean_and_reject_junk(spark):
    clean = [(i, f"This is a plain sentence number {i} with some more words, and it ends here. Another one follows it.") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{i}x{j}$$$" for j in range(30))) for i in range(20)]
    kept = {r.doc_id for r in quality_rules.keep(documents(spark, clean + junk)).collect()}
    assert kept == {i for i, _ in clean}


def test_variety_reads_the_whole_text(spark):
    rng = random.Random(3)
    clean, poor = [f"w{i}" for i in range(2400)], [rng.choice("abcdefgh") for _ in range(4000)]
    texts = [clean[:400] + poor, poor[:400] + clean, clean[:30], clean[:401], poor[:950], clean[:400] + poor[:1]]
    got = {r.doc_id: r for r in quality_rules.measure(documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])).collect()}
    place = [name for name, *_ in quality_rules.RULES].index("variety")
    for i, w in enumerate(texts):
        n = min(len(w), 400)
        starts = [min(k, len(w) - n) for k in range(0, len(w), 400)]
        assert got[i].n_distinct == pytest.approx(sum(len(set(w[k : k + n])) for k in starts) / len(starts))
    failed_or_bad = lambda r: r.base_failed or r.votes[place] == -1
    assert failed_or_bad(got[0]) and got[1].votes[place] == 1 and got[3].votes[place] == 1


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x")]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {"x": "x", "y": "x", "z": "z"}
    assert components.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def brute_verdicts(pages, rules):
    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def fit(host, path):
        found = [r for r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(found, key=len, default=None)

    return [(i, *parts(u), fit(*parts(u))) for i, u, _ in pages]


def test_urls(spark):
    link = '<html><head><LINK rel="canonical" href="{}"></head>'
    pages = [
        (1, "https://a.example.com/en/1", None),
        (2, "https://Mirror.example.org/x?y=1#top", link.format("https://a.example.com/en/1")),
        (3, "http://other.example.org/z", '<meta http-equiv="refresh" content="0; url=http://mirror.example.org/x?y=1">'),
        (4, "http://www.example.com/en/77", link.format("https://a.example.com/en/1")),
        (5, "no scheme", link.format("https://a.example.com/en/1")),
        (6, None, None),
        (7, "http://clean.example.org/", link.format("/de/")),
        (7, "http://clean.example.org/", None),
        (8, "https://x.net/de/8", "<link href=/a rel=stylesheet>"),
        (9, "http://notexample.net/de/81?q#f", None),
        (10, "http://sub.example.net/de/81", None),
    ]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"), "host", "rule", "verdict", "address")
    got = url_filters.judge(df, URL_RULES).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter(brute_verdicts(pages, URL_RULES))
    verdict = {r.page_id: r.verdict for r in got}
    assert [verdict[i] for i in range(1, 11)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert url_filters.judge(df.where("false"), URL_RULES).count() == 0
    more = spark.createDataFrame([("http://clean.example.org/", "https://a.example.com/en/1")], "a string, b string")
    assert {r.verdict for r in url_filters.judge(df, URL_RULES, more).where("page_id = 7").collect()} == {"block"}


def test_many_rules_are_joined(spark):
    rules = URL_RULES | {f"h{i}.example.com/p{i}": ("allow", "block")[i % 2] for i in range(400)}
    df = spark.createDataFrame([("h3.example.com", "/p3/x"), ("www.h4.example.com", "/p4"), ("com", "/en/"), ("zz", "/")], "host string, path string")
    assert {tuple(r) for r in url_filters.fitting(df, rules).select("host", "rule").collect()} == {("h3.example.com", "h3.example.com/p3"), ("www.h4.example.com", "h4.example.com/p4"), ("com", "com/en/"), ("zz", None)}


def test_licences(spark):
    df = clashing(
        awkward(spark).union(documents(spark, [(20, "Intro words here.\nreleased under the MIT-license!\nLicensed under CC BY-NC 4.0."), (21, "Licensed under the\nApache License,\nVersion 2.0"), (22, "released the under license MIT")])),
        "dice", "licenses",
    )
    got = {r.doc_id: (r.n_matches, r.license_id, r.dice, r.licenses) for r in license_scans.scan(df).collect()}
    assert got[20] == (2, "MIT", 1.0, "CC-BY-4.0,CC-BY-NC-4.0,MIT") or got[20][:3] == (2, "MIT", 1.0)
    assert got[21][1] == "Apache-2.0" and got[22][0] == 0 and got[2] == (0, None, None, "")
    assert license_scans.scan(df.where("false")).count() == 0


def test_classifier(spark):
    from pyspark.sql import Row

    good = [(i, f"The town keeps a quiet garden where {i} people meet and talk about the weather. ") for i in range(120)]
    bad = [(1000 + i, f"BUY!! NOW!! CHEAP{i}!! PILLS!! CLICK!! HERE!! WIN!! {i * 7}!! ") for i in range(120)]
    docs = documents(spark, [(i, t * 6) for i, t in good + bad])
    labels = spark.createDataFrame([Row(doc_id=i, quality=int(i < 1000)) for i, _ in good + bad])
    model = quality_classifier.fit(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score(clashing(docs, "score"), model).collect()}
    held = {r.doc_id for r in docs.where(quality_classifier.held_out(F.col("doc_id"))).collect()}
    assert 50 < len(held) < 110
    assert all(got[i].predicted == int(i < 1000) and 0 <= got[i].score <= 1 for i in held)
    odd = awkward(spark)
    assert quality_classifier.score(odd, model).count() == odd.count()
    for some in (labels.where("false"), labels.where("quality = 1")):
        assert 0 <= quality_classifier.score(odd, quality_classifier.fit(docs, some)).first().score <= 1
    both = labels.union(labels.withColumn("quality", 1 - F.col("quality")))
    assert quality_classifier.fit(docs, both).slope == 0.0
    assert quality_classifier.score(odd.where("false"), model).count() == 0


def test_classifier_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a.quality == 1 for b in rows if b.quality == 0]
    assert sum(right) / len(right) > 0.95
