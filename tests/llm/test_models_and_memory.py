"""Planted rule accuracies, plan and memory sizes, licence texts in odd shapes, awkward rows through the pipeline's stages."""

from __future__ import annotations

import pickle
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontamination, license_scans, quality_rules, url_filters

from .helpers import awkward, clashing, documents


def planted(spark, n, good, bad, p=0.85, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        is_good = rng.random() < p
        votes = [0 if rng.random() < 0.2 else (1 if (rng.random() < g) == is_good or (not is_good and rng.random() > b) else -1) if is_good else (-1 if rng.random() < b else 1) for g, b in zip(good, bad, strict=True)]
        rows.append((False, votes, is_good))
    return spark.createDataFrame(rows, "base_failed boolean, votes array<int>, is_good boolean")


GOOD, BAD = [0.97, 0.95, 0.9, 0.93], [0.9, 0.75, 0.8, 0.6]


def test_fit_finds_planted_accuracies(spark):
    df = planted(spark, 20_000, GOOD, BAD)
    fitted = quality_rules.fit(df, 4)
    # a good document's vote is bad when its rule errs, and in the plant also by the second chance of the row above
    seen = df.where("is_good").select(*[(F.sum((F.col("votes")[j] == 1).cast("int")) / F.sum((F.col("votes")[j] != 0).cast("int"))).alias(f"g{j}") for j in range(4)]).first()
    assert fitted.p == pytest.approx(0.85, abs=0.05)
    assert list(fitted.good) == pytest.approx(list(seen), abs=0.05) and list(fitted.bad) == pytest.approx(BAD, abs=0.05)
    small = quality_rules.fit(planted(spark, 4_000, GOOD, BAD, seed=4), 4)
    assert list(small.bad) == pytest.approx(list(fitted.bad), abs=0.08)


def test_every_rule_can_change_a_verdict(spark):
    df = planted(spark, 6_000, GOOD, BAD, seed=5).distinct()
    fitted = quality_rules.fit(planted(spark, 6_000, GOOD, BAD, seed=5), 4)
    whole = {tuple(r.votes): r.kept for r in df.select("votes", (fitted.posterior(F.col("votes")) >= 0.5).alias("kept")).collect()}
    for j in range(4):
        without = F.transform("votes", lambda x, i, j=j: F.when(i == j, 0).otherwise(x)) if False else F.concat(F.slice("votes", 1, j), F.array(F.lit(0)), F.slice("votes", j + 2, 4))
        less = {tuple(r.votes): r.kept for r in df.select("votes", (fitted.posterior(without) >= 0.5).alias("kept")).collect()}
        assert less != whole


def test_plan_of_kept_documents_stays_small(spark, sf_dir):
    kept = quality_rules.keep(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_searcher_is_compact():
    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randrange(50_000)}" for _ in range(40)).encode()) for i in range(2_000)]
    searcher = decontamination.WuManber(items, 10)
    assert len(pickle.dumps(searcher)) < 20 * sum(len(t) for _, t in items)
    assert searcher.search(items[7][1].split())[1] == {"7"}


def test_licence_texts_in_odd_shapes(spark):
    texts = license_scans.TEMPLATES
    wrap = lambda t, n, sign: "\n".join(f"{sign} " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    names = ["MIT-grant", "BSD-grant", "ISC", "Apache-2.0-header", "GPL-header"]
    rows = [(k, f"Some words before. {wrap(texts[n], 9, '#')} and after it, more words follow here.") for k, n in enumerate(names)]
    rows += [(10 + k, "x " * 3000 + texts[n].replace("\n", " ") + " y" * 3000) for k, n in enumerate(names)]
    rows += [(20, "Copyright 2020 Acme. Released under the MIT License. All rights reserved."), (21, "the software and the source of the license")]
    got = {r.doc_id: r.licenses.split(",") for r in license_scans.scan(documents(spark, rows)).collect()}
    assert all(n in got[k] and n in got[10 + k] for k, n in enumerate(names))
    assert got[20] == ["MIT"] and got[21] == [""]


def test_links_in_any_form(spark):
    base = "http://a.example.org/dir/page"
    forms = {
        '<link href="b" rel="alternate canonical">': "a.example.org/dir/b",
        "<link rel=canonical href=../x/./y?q=1#f>": "a.example.org/x/y?q=1",
        "<LINK REL='Canonical' HREF='?y'>": "a.example.org/dir/page?y",
        '<meta content="0;URL=\'/z/\'" http-equiv=refresh>': "a.example.org/z/",
        '<meta http-equiv="Refresh" content="3; url=http://B.example.net">': "b.example.net/",
        '<link rel="canonical" title="a > b" href="//c.example.net/p&amp;q">': "c.example.net/p&q",
        '<meta http-equiv="refresh" content="600; url=/later">': None,
        '<link rel="canonical" href="mailto:x@y">': None,
        '<link rel="stylesheet" href="/canonical">': None,
        '<link rel="canonical" href="#top">': None,
    }
    pages = spark.createDataFrame([(i, base, f"<head>{t}</head>") for i, t in enumerate(forms)], "page_id long, url string, html string")
    for i, (tag, expected) in enumerate(forms.items()):
        got = [r.b for r in url_filters.alias_edges(pages.where(F.col("page_id") == i)).collect()]
        assert got == ([] if expected is None else [expected]), tag


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    df = clashing(awkward(spark), "row", "votes", "kept", "node", "removed")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.where("false")):
            out = stage(spark, docs, sf_dir)
            assert out.columns == df.columns, name
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, df.where("false"), sf_dir).count() == 0
