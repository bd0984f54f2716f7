"""Whole flows on small corpora."""

from __future__ import annotations

import pytest

from veldspar.plans import retrieval
from veldspar.plans.options import Options


@pytest.fixture(scope="module")
def index(spark):
    texts = [
        ("refund-guide.txt", "Refund policy: customers can request a refund within 30 days.\n\nExceptions to the refund window need a manager."),
        ("shipping-guide.txt", "Shipping policy: express shipping takes two days. The code is ZXQ-991."),
        ("billing-guide.txt", "Billing runs monthly. The lunch menu includes rice and tea."),
    ]
    rows = [(i, name, text, i) for i, (name, text) in enumerate(texts)]
    made = retrieval.ingest(spark.createDataFrame(rows, "file_id long, filename string, text string, created_at long"), Options(chunk_size=70, chunk_overlap=10))
    return retrieval.Index(made.files.persist(), made.chunks.persist(), made.vectors.persist())


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_ingest_counts(index):
    got = {r["file_id"]: r for r in index.files.collect()}
    assert got[0]["chunk_count"] == 2 and "refund" in got[0]["keywords"] and got[0]["summary"].startswith("Refund policy")


@pytest.mark.parametrize("mode", ["hybrid", "vector", "keyword"])
def test_each_mode_finds_the_file(spark, index, mode):
    sources, levels = retrieval.retrieve(ask(spark, "ZXQ 991 code"), index, Options(mode=mode, top_k=1))
    assert [r["file_id"] for r in sources.collect()] == [1]
    assert levels.first()["answerability"] in ("medium", "high")


def test_scope_comes_before_the_limit(spark, index):
    scope = spark.createDataFrame([(0, 2)], "query_id long, file_id long")
    sources, _ = retrieval.retrieve(ask(spark, "policy shipping refund menu"), index, Options(top_k=1, mode="keyword"), scope)
    assert [r["file_id"] for r in sources.collect()] == [2]


def test_named_files_narrow(spark, index):
    sources, _ = retrieval.retrieve(ask(spark, "what does billing-guide.txt say about policy"), index, Options(top_k=5))
    assert {r["file_id"] for r in sources.collect()} == {2}


def test_routing_takes_the_best_file(spark, index):
    scope = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "query_id long, file_id long")
    sources, _ = retrieval.retrieve(ask(spark, "How do refund exceptions work?"), index, Options(file_selection_mode="auto", file_selection_limit=1), scope)
    assert {r["file_id"] for r in sources.collect()} == {0}


def test_windows_and_full_files(spark, index):
    wide, _ = retrieval.retrieve(ask(spark, "exceptions manager"), index, Options(top_k=1, source_window=1))
    assert "[chunk 0]" in wide.first()["text"] and "[chunk 1]" in wide.first()["text"]
    whole, levels = retrieval.retrieve(ask(spark, "refund"), index, Options(context_mode="full"))
    assert [r["chunk_id"] for r in whole.orderBy("position").collect()] == ["2:full", "0:full", "1:full"]
    none, levels = retrieval.retrieve(ask(spark, "refund"), index, Options(context_mode="none"))
    assert none.count() == 0 and levels.first()["answerability"] == "none"


def test_guard_withholds_answers(spark, index):
    answers, audits, _ = retrieval.ask(ask(spark, "refund window days", "zebra quantum"), index, Options(minimum_answerability="medium"))
    got = {r["query_id"]: r["answer"] for r in answers.collect()}
    assert got[0].startswith("Answer:") and "[1]" in got[0]
    assert got[1].startswith("I do not have enough")
    assert audits.count() == 2


def test_reindex_reports_failures(spark, index):
    rows = [(1, "shipping-guide.txt", "New shipping rules.", 9, None), (2, "billing-guide.txt", None, 9, "unreadable")]
    new, failed = retrieval.reindex(index, spark.createDataFrame(rows, "file_id long, filename string, text string, created_at long, error string"))
    assert [(r["file_id"], r["error"]) for r in failed.collect()] == [(2, "unreadable")]
    assert [r["text"] for r in new.chunks.filter("file_id = 1").collect()] == ["New shipping rules."]
    assert new.vectors.count() == new.chunks.count() and new.files.count() == 3


def test_options_are_checked():
    assert Options().override({"top_k": 8}, {"top_k": None}, {"mode": "keyword"}) == Options(top_k=8, mode="keyword")
    for bad in ({"top_k": 0}, {"mode": "x"}, {"mmr_lambda": 2.0}, {"source_window": 9}):
        with pytest.raises(ValueError):
            Options(**bad)
