"""Token counts, packing and token files against the library on whole texts."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing, token_counts, token_output
from lectern.llm.queries import QUERIES
from lectern.llm.tokenization import WordEncoder, load, read_definition
from lectern.session import work_dir

from .helpers import awkward, clashing, documents

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DEFINITIONS = {x: read_definition(x) for x in (BYTE, WORD)}
ENCODERS = {x: WordEncoder(d) for x, d in DEFINITIONS.items()}
LIBRARY = {x: load(d) for x, d in DEFINITIONS.items()}


def whole(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab Z1'st.,\n\t\r  é́Σ  \x1c\U0001f600<|>")), max_size=60))
def test_parts_give_the_ids_of_the_whole_text(path, text):
    got = np.frombuffer(ENCODERS[path].encode_batch([text])[0], "<u4").tolist()
    assert got == whole(path, text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_parts_on_the_tables(spark, sf_dir, path):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = ENCODERS[path].encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole(path, x) for x in texts]


def unigram():
    from tokenizers import Tokenizer, models

    return Tokenizer(models.Unigram(token_counts.read_vocabulary(PIECE), 0, True))


@pytest.fixture(scope="module")
def counted():
    return token_counts.Counter(token_counts.read_vocabulary(PIECE)), unigram()


def by_library(model, text):
    return len(model.encode(token_counts.MARK + text.replace(" ", token_counts.MARK)).ids) if text else 0


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("abcdehinorst  .,\né\U0001f600一▁")), max_size=80))
def test_counts_equal_the_library(counted, text):
    assert counted[0].count(text) == by_library(counted[1], text)


def test_ties_take_the_longest_last_piece():
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁", -1.0)]
    assert token_counts.Counter(vocabulary).count("aaaa") == 3  # mark, a, aaa


def test_vocabulary_with_pieces_across_words_counts_whole_texts():
    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("▁", -1.0), ("a▁a", -1.5)]
    assert token_counts.Counter(vocabulary).count("a a") == 2


def test_counts_on_the_tables(spark, sf_dir, counted):
    rows = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows == {k: by_library(counted[1], v) for k, v in texts.items()}


def test_counts_of_awkward_rows(spark, counted):
    df = clashing(awkward(spark), "n_tokens")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(df, PIECE).collect())
    assert got == sorted((r.doc_id or 0, by_library(counted[1], r.text or "")) for r in df.collect())
    assert token_counts.count_tokens(df.where("false"), PIECE).count() == 0


def check_pieces(docs, pieces, end_id=1, capacity=2048):
    ids = {d: np.array([*whole(BYTE, t), end_id], dtype="<u4") for d, t in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        assert p.doc_tokens == len(ids[p.doc_id])
    for d, some in by_doc.items():
        at = 0
        for p in sorted(some, key=lambda x: x.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[d])
    assert set(by_doc) == set(docs)
    for some in by_seq.values():
        at = 0
        for p in sorted(some, key=lambda x: x.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at & (at - 1) == 0  # no padding


def test_packing_on_the_tables(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_pieces(docs, QUERIES["op2_packing"](spark, sf_dir).collect())


def test_packing_awkward_rows(spark):
    df = clashing(awkward(spark).dropDuplicates(["doc_id"]), "start", "ids")
    check_pieces({r.doc_id: r.text for r in df.collect()}, packing.pack(df, BYTE, end_id=1).collect())
    again = packing.pack(awkward(spark), BYTE, end_id=1, block_tokens=1000, with_ids=True).collect()
    assert sum(p.length for p in again if p.doc_id == 1) == 2 * next(p.doc_tokens for p in again if p.doc_id == 1)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in again)
    assert packing.pack(df.where("false"), BYTE, end_id=1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_assign_fills_every_sequence(lengths):
    got = packing.assign(np.array(lengths, dtype=np.int64), 64, 1.0, 0.01)
    used, seen = defaultdict(int), defaultdict(int)
    for d, at, n, s, offset in sorted(got, key=lambda x: (x[3], x[4])):
        assert offset == used[s] and n > 0
        used[s] += n
    for d, at, n, s, offset in sorted(got):
        assert at == seen[d]
        seen[d] += n
    assert all(seen[i] == n for i, n in enumerate(lengths))
    assert all(n == 64 or n & (n - 1) == 0 for n in used.values())


def test_assign_balances_cost():
    rng = random.Random(1)
    lengths = np.array([rng.randint(20, 900) for _ in range(2000)])
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.assign(lengths, 2048, 1.0, 1 / 1024):
        cost[s] += n + n * n / 1024
    full = sorted(cost.values())[12:]  # besides the few short ones
    assert max(full) < 1.35 * (sum(full) / len(full))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip_and_random_access(values):
    ids = np.array(values, dtype=np.uint32)
    codes = token_output.Codes.of(ids)
    assert codes.all().tolist() == values
    for i in range(0, len(values), 37):
        assert codes.get(i) == values[i]
    numbers, starts, back = token_output.from_bytes(token_output.to_bytes([7, None], np.array([len(values), 0]), ids))
    assert numbers == [7, None] and starts.tolist() == [0, len(values), len(values)] and back.all().tolist() == values
    with pytest.raises(IndexError):
        back.get(len(values))


def expected_documents(rows):
    at, out = 0, []
    for d, ids in sorted(((d, np.array([*whole(WORD, t), 2], dtype="<u4")) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_on_the_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op9_token_output"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected_documents(rows)


def test_files_of_awkward_rows(spark):
    df = clashing(awkward(spark), "shard", "ids")
    folder = work_dir(spark, "test")
    manifest = token_output.write(df, WORD, folder, end_id=2, docs_per_shard=3, ids_per_file=500)
    assert manifest.count() > 2
    got = token_output.read(spark, manifest).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected_documents([(r.doc_id, r.text) for r in df.collect()])
    assert token_output.round_trip(df.where("false"), WORD, end_id=2).count() == 0


def test_many_documents_of_one_number(spark):
    df = documents(spark, [(5, f"text {i % 3}") for i in range(300)] + [(i, "other") for i in range(20)])
    got = token_output.round_trip(df, WORD, end_id=2, docs_per_shard=16).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected_documents([(r.doc_id, r.text) for r in df.collect()])
