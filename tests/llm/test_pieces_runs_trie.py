"""SentencePiece rounds against the library, runs and the conversation trie against plain versions."""

import collections
import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
import test_operators as cases

from candlework.llm import periodic_runs, prefix_trie, sentence_pieces
from candlework.llm.common import PIECE_MODEL, tokenizer_path


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))


@pytest.fixture(scope="module")
def docs(spark):
    rows = cases.corpus(seed=3)
    rows += [(5000 + k, "buy now " * k, *[None] * 8) for k in range(0, 60, 3)]
    rows += [(6000 + k, " ".join(str(i % (k + 5)) for i in range(400)), *[None] * 8) for k in range(40)]
    return spark.createDataFrame(rows, cases.SCHEMA).repartition(5).cache()


def test_rounds_equal_the_library(docs, spark):
    lib = library()
    want = collections.Counter()
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    got = sentence_pieces.encode_documents(docs, tokenizer_path(PIECE_MODEL), keep_ids=True)
    assert cases.counted(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert all(hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"] for r in got.collect())
    assert sentence_pieces.encode_documents(spark.createDataFrame([], cases.SCHEMA), tokenizer_path(PIECE_MODEL)).count() == 0


def test_rounds_of_random_texts():
    own, lib, rng = sentence_pieces.PieceModel(tokenizer_path(PIECE_MODEL)), library(), random.Random(5)
    pool = "ab'stre !?é́İſ가각ᄀ한字漢😀 \x1c  \n\t\x0b\x0c.1२<s>▁▁  \r;){}()tionaaa\0�﻿"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (100, 2000, 5000)]
    texts += ["a" * 3000, " " * 999, "", " ", "▁", "0123456789" * 400, "=-" * 1500, "int main() {\r\n\treturn 0;\r\n}", "the " * 500]
    bounds, ids = own.encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        want = lib.encode(text)
        assert ids[a:b].tolist() == want, text
        assert own.decode(ids[a:b]).decode() == lib.decode([1, *want, 2]), text


def test_long_words_by_agenda_equal_rounds(monkeypatch):
    own, rng = sentence_pieces.PieceModel(tokenizer_path(PIECE_MODEL)), random.Random(9)
    texts = pa.array(["".join(rng.choice("etaoinshr aaa") for _ in range(700)) for _ in range(20)])
    want = own.encode(texts)[1].tolist()
    monkeypatch.setattr(sentence_pieces, "ROUND_CHARS", 3)
    monkeypatch.setattr(sentence_pieces, "WORD_CHARS", 2)
    assert own.encode(texts)[1].tolist() == want


def test_runs_of_random_words():
    rng, total = random.Random(1), 0
    for _ in range(700):
        n, k = rng.randint(0, 160), rng.choice([1, 2, 3, 5, 40])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 10:
                a = rng.randrange(n)
                p, end = rng.randint(1, max(1, (n - a) // 3)), a + rng.randint(1, n - a)
                for i in range(a + p, end):
                    w[i] = w[i - p]
                if rng.random() < 0.3:
                    w[rng.randrange(n)] = 99
        want = brute.runs(w)
        total += len(want)
        assert periodic_runs.runs(np.array(w, np.int64)) == want
    assert total > 200


@pytest.mark.parametrize("period", [1, 2, 100, 50_000])
def test_long_periodic_texts_stay_linear(period):
    words = np.arange(150_000) % period
    assert periodic_runs.runs(words) == [(0, 150_000, period)]
    assert len(periodic_runs.occurrences(words)[0]) < 3 * len(words)


def test_run_digests_equal_plain_ones(docs, spark):
    columns = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = cases.counted(periodic_runs.run_digests(docs, as_test=True), *columns)
    want = collections.Counter(brute.run_row(r["doc_id"], r["text"]) for r in docs.collect())
    assert got == want and any(k[2] > 1 for k in want)
    assert periodic_runs.run_digests(spark.createDataFrame([], cases.SCHEMA)).count() == 0
    listed = cases.counted(periodic_runs.periodic_runs(docs), "doc_id", "start", "length", "period")
    assert listed == collections.Counter((r["doc_id"], *x) for r in docs.collect() for x in brute.runs(brute.words(r["text"])))


TURNS = "conv_id long, turn long, role string, text string, depth int, path string, key string, seq string, h int"


@pytest.mark.parametrize("cells,again", [(1, True), (9, True), (1 << 20, False)])
def test_trie_equals_plain_one(spark, cells, again):
    rng = random.Random(4)
    said = [None, "", "a", "ab", "é", "x y", "a" * 5000]
    rows = [(c if c < 70 else c - 90, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), rng.choice(said[: rng.randint(1, 7)]), 1, "p", "k", "s", 0) for c in range(80) for t in range(rng.randint(1, 11))]
    rows += [(200 + c, t, "user", "hello", 1, "p", "k", "s", 0) for c in range(60) for t in range(3)]  # a hot conversation
    rows += [(300, t, "user", str(t % 3), 1, "p", "k", "s", 0) for t in range(150)]  # a long one
    rows += [rows[0], rows[7], (None, 1, "user", "no conversation", 1, "p", "k", "s", 0)]
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    got = cases.counted(prefix_trie.conversation_trie(turns, as_test=again, cells=cells), *prefix_trie.COLUMNS)
    assert got == brute.trie([r[:4] for r in rows], again)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS), as_test=True).count() == 0
