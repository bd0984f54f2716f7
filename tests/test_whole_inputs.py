"""Registered queries read whole texts and ask every query."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import search
from veldspar.plans import catalog


@pytest.fixture
def long_texts(spark, tmp_path):
    text = "word " * 40 + "\ntwo\nthree\na fourth line of more than twenty characters\ntailmark"
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    said = "some plain words " * 10 + ". I prefer tailmark"
    spark.createDataFrame([(1, 0, "user", said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_tables_are_cleaned_with_the_whole_text(spark, long_texts):
    assert "tailmark" in catalog.QUERIES["clean_tables"](spark, long_texts).first()["clean"]


def test_memories_of_the_whole_message(spark, long_texts):
    assert any("prefers tailmark" in r["memory"] for r in catalog.QUERIES["memory_extract"](spark, long_texts).collect())


def test_tags_of_all_lines(spark, long_texts):
    tags = catalog.QUERIES["clean_tags"](spark, long_texts).first()["tags"].split("|")
    assert tags[1:] == ["two", "three", "a fourth line of more than twenty characters", "tailmark"]


def test_every_twentieth_vector_asks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {r["vec_id"]: np.sort(x @ x[i])[::-1][:10] for i, r in enumerate(rows) if r["vec_id"] % 20 == 0}
    got = defaultdict(list)
    for r in catalog.QUERIES["cosine_topk"](spark, sf_dir).collect():
        got[r["query_id"]].append(r["cosine"])
    assert sorted(got) == sorted(want)
    assert all(np.allclose(sorted(got[k], reverse=True), want[k], atol=1e-4) for k in want)


def test_blocks_of_queries_are_joined(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("vec_id").cast("long").alias("query_id"))
    q = v.filter("query_id % 20 = 0").select("query_id", "vector")
    rows = lambda block: sorted((r[0], r[1]) for r in search.dense_top_k(q, v.select("chunk_id", "vector"), 5, block).collect())
    assert rows(7) == rows(2000)


@pytest.mark.parametrize("name", ["prompt_messages", "retrieval_diagnostics", "answer_ladder"])
def test_sources_that_questions_share_cross_once(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz ."], 20_000)) for _ in range(20)]
    spark.createDataFrame([(200 * i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(400 * i, 0, "user", f"a question {i}?") for i in range(100)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert len(catalog.QUERIES[name](spark, str(tmp_path)).collect()) >= 100
    assert written() - before < 3 * sum(map(len, texts))
