"""Near-duplicate documents, near-duplicate lines, and the pipeline, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontamination, line_dedup, minhash_dedup, quality_rules
from lectern.llm.tokenization import load, read_definition

from .helpers import awkward, clashing, documents
from .test_decontamination import words as bench_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if met and 100 * met >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    named: dict = {}
    for i, (d, _) in enumerate(rows):
        named.setdefault(root(i), []).append(d)
    smallest = {r: min((d for d in some if d is not None), default=None) for r, some in named.items()}
    return sorted(((d or 0), len(sets[i]), (smallest[root(i)] if sets[i] else d) or 0) for i, (d, _) in enumerate(rows))


def copies(seed, bases, each, edits, words=120, vocabulary=4000):
    """Base texts and copies with some words changed."""
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
        for k in range(each):
            w = list(base)
            for _ in range(rng.randrange(edits + 1) if k else 0):
                w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "bases", "each", "edits", "words"), [(1, 30, 5, 4, 120), (2, 2, 90, 6, 120), (3, 25, 4, 3, 30)])
def test_groups_equal_brute_force(spark, seed, bases, each, edits, words):
    rows = copies(seed, bases, each, edits, words)
    got = minhash_dedup.groups(documents(spark, rows), minhash_dedup.Settings(width=4)).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in got) == brute_groups(rows, 4)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 3)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ITEMS", 2000)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_ROWS", 1)
    rows = copies(5, 1, 120, 9)
    got = minhash_dedup.groups(documents(spark, rows), minhash_dedup.Settings(width=4)).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in got) == brute_groups(rows, 4)


def test_groups_of_awkward_rows(spark):
    df = clashing(awkward(spark), "node", "component_id", "kept", "n")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = minhash_dedup.groups(df).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in got) == brute_groups(rows, 5)
    assert minhash_dedup.keep(df).columns == df.columns and minhash_dedup.keep(df).count() == df.count()
    assert minhash_dedup.judge(df.where("false")).count() == 0


def test_copies_are_removed_by_row(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(7, a), (None, a), (None, b), (None, None), (3, c), (5, c), (5, d), (None, e), (None, e.upper()), (None, e + " more"), (8, None), (9, e[:-4] + " x y")]
    got = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in minhash_dedup.keep(clashing(documents(spark, rows), "node", "row", "id", "gone")).collect()))
    assert got == sorted([(7, a), (0, b), (0, ""), (3, c), (5, d), (8, ""), (9, e[:-4] + " x y")])
    only_null = [(None, e), (None, e), (None, e + " more"), (None, b), (5, a), (5, a + " more")]
    got = [(r.doc_id, r.text.split()[0][0]) for r in minhash_dedup.keep(documents(spark, only_null)).collect()]
    assert sorted(got, key=str) == [(5, "a"), (None, "b"), (None, "e")]


def brute_lines(rows, threshold=(80, 100)):
    seen, out = [], {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lost = []
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            s = frozenset(WORD.findall(line))
            if not s:
                continue
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                lost.append(k)
            seen.append(s)
        out[d] = lost
    return out


def line_rows(seed):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 6, 12, 30]))) for _ in range(40)]
    rows = []
    for d in range(60):
        some = []
        for _ in range(rng.randrange(6)):
            w = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            rng.shuffle(w)
            some.append(" ".join(w) if rng.random() < 0.9 else "  ")
        rows.append((d, "\n".join(some)))
    return rows


@pytest.mark.parametrize("small", [2, 32])
def test_lines_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    if small == 2:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 1)
    rows = line_rows(7)
    expected = brute_lines(rows)
    got = {r.doc_id: [int(x) for x in r.removed.split(",") if x] for r in line_dedup.judge(documents(spark, rows)).collect()}
    assert got == expected
    texts = {r.doc_id: r for r in line_dedup.dedup(documents(spark, rows)).collect()}
    for d, text in rows:
        left = [x for k, x in enumerate(text.split("\n")) if k not in expected[d]]
        if expected[d] and not any(WORD.search(x) for x in left):
            assert d not in texts
        else:
            assert texts[d].text == "\n".join(left) and texts[d].n_chars == len(texts[d].text)


def test_lines_of_awkward_rows(spark):
    df = clashing(awkward(spark), "t", "line", "removed", "row")
    got = line_dedup.judge(df)
    assert got.count() == df.count() and got.where("doc_id = 1 and n_removed > 0").count() == 0  # repeated rows are one document
    assert line_dedup.dedup(df).columns == df.columns
    assert line_dedup.judge(df.where("false")).count() == 0 and line_dedup.dedup(df.where("false")).count() == 0


def test_keys_are_sorted_as_plain_numbers_and_pairs_are_compiled(spark):
    df = spark.createDataFrame([("b a b c",), ("",)], "line string")
    kept = df.select(line_dedup._keys(F.expr("sequence(0L, 524287L)"), F.col("line")).alias("k"))
    assert not kept.schema["k"].dataType.containsNull  # else Spark sorts boxed objects
    assert [len(r.k) for r in kept.collect()] == [3, 0] and all(r.k == sorted(r.k) for r in kept.collect())
    sets = spark.createDataFrame([(n, n, 0, None, (1, 1, 0), list(range(n))) for n in range(1, 8)], "h1 long, n int, bits long, more long, first struct<doc_id: long, t: long, line: int>, prefix array<long>")
    found = line_dedup._neighbours(sets)
    assert "lambda" not in found._jdf.queryExecution().toString()
    pairs = [(n, k) for n in range(2, 8) for k in range(max(0, n - 1 - line_dedup.STAR), n - 1)]
    expected = spark.createDataFrame([(n, k, k + 1) for n, k in pairs], "h1 long, x long, y long").select("h1", F.xxhash64("x", "y").alias("key"))
    assert sorted(map(tuple, found.select("h1", "key").collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("fewest", [2, 4])
def test_stars_meet_the_earliest_set_of_each_shared_key(spark, monkeypatch, fewest):
    monkeypatch.setattr(line_dedup, "SMALL", 5)
    held = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, **k: held.append((name, m := corpus_pipeline.materialize(df, name, **k))) or m)
    monkeypatch.setattr(line_dedup, "discard", lambda *tables: None)
    groups = [1, 2, 3, 4, 8]
    rows = [(100 * g + i, 10, 0, None, 1000 - i, g) for g in groups for i in range(g)]
    df = spark.createDataFrame(rows, "h1 long, n int, bits long, more long, doc_id long, key long")
    got = {(r.a, r.b) for r in line_dedup._stars(df, fewest, line_dedup.Settings()).collect()}
    last = {g: 100 * g + g - 1 for g in groups if g >= fewest}
    assert {(100 * g + i, x) for g, x in last.items() for i in range(g - 1)} <= got
    assert all(a // 100 == b // 100 and a // 100 in last for a, b in got)
    tables = dict(held)  # rows of keys with too few sets are left out before the wide joins
    assert tables["sharing"].count() == sum(last)


def test_stages_equal_plain_python(spark, sf_dir):
    """Each stage on its own input; the rules' model and the line join have tests of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns
        rows = {r.doc_id: r.text for r in after.collect()}
        if stage is corpus_pipeline.quality:
            assert set(rows) == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        elif stage is corpus_pipeline.lines:
            lost = brute_lines(given)
            expected = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost[d]) for d, t in given}
            assert rows == {d: t for d, t in expected.items() if not lost[d] or WORD.search(t)}
        elif stage is corpus_pipeline.near_duplicates:
            assert set(rows) == {d for d, _, c in brute_groups(given, 5) if d == c}
        else:
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            cut = [bench_words(t) for _, t in bench]
            windows = {tuple(w[i : i + n]) for w in cut for n in [min(10, len(w))] for i in range(len(w) - n + 1) if n}
            sizes = {len(x) for x in windows}
            assert set(rows) == {d for d, t in given for w in [bench_words(t)] if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))}
        path = f"{corpus_pipeline.materialize(after, 'test').lectern_path}"
        docs = spark.read.parquet(path)
    tokenizer = load(read_definition(public_tokenizers.path("byte_bpe_50k.json")))
    left = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == left


def test_decontaminated_keeps_clean_rows(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string")
    rows = [(1, "x " + " ".join(f"b{i}" for i in range(10))), (2, " ".join(f"b{i}" for i in range(9))), (3, None)]
    for size in (1, 1 << 20):
        assert sorted(r.doc_id for r in decontamination.keep(documents(spark, rows), bench, block_bytes=size).collect()) == [2, 3]


def test_sketch_of_small_sets_is_the_set():
    assert np.array_equal(minhash_dedup.shingle_set(b"a b c", 5), minhash_dedup.shingle_set(b"A  b\tC", 5))
    assert len(minhash_dedup.shingle_set(b"a b c d e f", 5)) == 2 and len(minhash_dedup.shingle_set(None, 5)) == 0
