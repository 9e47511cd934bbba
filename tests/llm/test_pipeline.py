"""The pipeline's stages against plain versions, one after another, on a table of planted cases."""

import hashlib
import random

import brute
import numpy as np
import test_operators as cases

import corpus_pipeline
from candlework.llm import bpe
from candlework.llm.common import WORD_TOKENIZER, tokenizer_path


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = cases.corpus(seed=8, n=80)
    item = " ".join(rows[2][1].split()[:20])
    rows[2] = (*rows[2][:1], " ".join(f"w{k}" for k in range(60)) + " " + item, *rows[2][2:])
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(r[0], r[1]) for r in rows if brute.base_counts(r[1])[0] >= 50 and 100 * brute.base_counts(r[1])[4] <= 50 * brute.base_counts(r[1])[0]]
    first = brute.classes(sorted({k for k in kept if k[0] is not None}))
    kept = [(i, t) for i, t in dict(kept).items() if i is None or first[i] == i]
    raws = []
    for (i, t), (n, gone, _, _) in zip(kept, brute.cut([t for _, t in kept], corpus_pipeline.PASSAGE_BYTES)):
        if gone < n:
            raws.append((i, t, gone))
    cut = {i: gone for i, _, gone in raws}
    texts = {i: t for i, t, _ in raws}
    library = bpe.load_tokenizer(tokenizer_path(WORD_TOKENIZER))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    dirty = {i for i, t in texts.items() if item in t and not cut[i]}
    assert rows[2][0] in dirty and rows[2][0] not in got
    assert set(got) == set(texts) - dirty
    for i, r in got.items():
        assert hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"]
        if not cut[i]:
            assert r["ids"] == library.encode(texts[i], add_special_tokens=False).ids
    assert len(corpus_pipeline.STAGES) == 5


def test_planted_passages_go(spark):
    """Passages of 51 to 200 words that two or more documents share are cut, what stands around them is not."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (51, 52, 60, 75, 120, 200) for _ in range(4)]
    rows = [(10 * k + j, f"{text(80)} {p} {text(90)}") for k, p in enumerate(passages) for j in range(2 + k % 3)]
    rows += [(1000 + k, text(200)) for k in range(60)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for doc_id, before in rows:
        if doc_id >= 1000:
            assert got[doc_id] == before
        else:
            passage = passages[doc_id // 10]
            assert passage not in got[doc_id] and len(got[doc_id]) <= len(before) - len(passage)
            assert len(got[doc_id]) >= len(before) - len(passage) - 40


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", cases.SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
