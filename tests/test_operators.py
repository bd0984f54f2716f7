"""Operators on small literal inputs."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veldspar.functions import arithmetic, hashing, scripts
from veldspar.functions import text as T
from veldspar.operators import chats, chunks, cleaning, evidence, files, search, selection
from veldspar.sources import readers, sinks
from veldspar.streaming import jobs


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def reference_chunks(text, size, overlap):
    """The chunker restated over plain strings, for comparison."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    out, open_ = [], None

    def put(span):
        if span and span[1] > span[0] and text[span[0] : span[1]].strip():
            out.append(span)

    at = 0
    for part in re.split(r"(\n\s*\n)", text):
        start, end = at, at + len(part)
        at = end
        if not part.strip():
            continue
        start, end = start + len(part) - len(part.lstrip()), end - (len(part) - len(part.rstrip()))
        if end - start > size:
            put(open_)
            open_, k = None, start
            while True:
                stop = min(k + size, end)
                piece = text[k:stop]
                put((k + len(piece) - len(piece.lstrip()), stop - (len(piece) - len(piece.rstrip()))))
                if k + size >= end:
                    break
                k += size - overlap
        elif open_ and open_[2] + 2 + end - start <= size:
            open_ = (open_[0], end, open_[2] + 2 + end - start)
        else:
            put(open_)
            open_ = (start, end, end - start)
    put(open_)
    return [(s[0], s[1]) for s in out]


def test_chunks_fit_and_spans_agree(spark):
    rng = random.Random(3)
    texts = [" ".join(map(str, range(300))), "a b\n\nc d\n\n" + "x" * 50, "", "   ", "one\n\n\n\ntwo"]
    for _ in range(20):
        texts.append("".join(rng.choice(["word ", "a ", "\n\n", ". ", "\n", "longer-word "]) for _ in range(rng.randint(1, 80))))
    rows = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "file_id long, filename string, text string")
    got = chunks.chunk_documents(rows, 120, 20).orderBy("file_id", "chunk_index").collect()
    for i, t in enumerate(texts):
        own = [r for r in got if r["file_id"] == i]
        assert [(r["start_char"], r["end_char"]) for r in own] == reference_chunks(t, 120, 20)
        assert all(0 < len(r["text"]) <= 120 for r in own)


def test_chunk_arguments_are_checked():
    with pytest.raises(ValueError):
        chunks.chunk_documents(None, 0, 0)
    with pytest.raises(ValueError):
        chunks.chunk_documents(None, 10, 10)


def test_text_functions(spark):
    assert one(spark, T.normalize_text, "  a\t b\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, T.tokens, "Schön Foo_1") == ["sch", "n", "foo_1"]
    assert sorted(one(spark, T.meaningful_terms, "What is the Refund a I window")) == ["refund", "window"]
    assert one(spark, lambda t: T.word_cut(t, 8), "hello world") == "hello"
    assert one(spark, lambda t: T.word_cut(t, 3), "hello") == "hel"
    assert one(spark, T.answer_sentences, "Answer:\n- One. Two!\nSources: x") == ["One.", "Two!"]
    assert one(spark, T.filename_text, "A/b-C.txt") == "a b-c.txt"
    assert one(spark, T.stem, "a.b.txt") == "a.b"
    assert one(spark, T.keyword_query, "ZXQ-991 \"a\" to foo_bar") == ["zxq991", "to", "foo_bar"]


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0]), ([0.0], [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def candidates(spark):
    rows = [(1, "a:0", 1, 1, 0.95, 1, "refund policy text"), (1, "a:1", 1, 2, 0.94, 1, "refund policy text again"), (1, "b:0", 2, 3, 0.80, 1, "shipping takes two days")]
    return spark.createDataFrame(rows, "query_id long, chunk_id string, file_id long, ord int, score double, query_hits int, text string")


def test_diversity_prefers_another_file(spark):
    q = spark.createDataFrame([(1, "refund policy")], "query_id long, query string")
    ranked = search.rerank(q, candidates(spark))
    assert [r["chunk_id"] for r in selection.diversify(ranked, 0.35).orderBy("mmr_rank").limit(2).collect()] == ["a:0", "b:0"]
    assert [r["chunk_id"] for r in ranked.orderBy("rank").limit(2).collect()] == ["a:0", "a:1"]


def test_fusion_counts_hits(spark):
    rows = [(1, "a:0", 1, 0.50, 1), (1, "a:0", 2, 0.48, 1), (1, "b:0", 3, 0.52, 1)]
    fused = search.fuse(spark.createDataFrame(rows, "query_id long, chunk_id string, ord int, score double, query_hits int"))
    best = fused.orderBy(F.desc("score")).first()
    assert (best["chunk_id"], best["query_hits"], best["score"]) == ("a:0", 2, 0.54)


@pytest.mark.parametrize(("top", "budget", "cap"), [(5, 60, None), (2, 1000, None), (5, 1000, 1), (5, 25, None)])
def test_budget_against_a_loop(spark, top, budget, cap):
    rng = random.Random(budget)
    rows = [(1, k + 1, f"c{rng.randint(0, 9)}", rng.randint(1, 3), 1.0 - k / 100, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 9)))) for k in range(15)]
    got = selection.select_within_budget(spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, file_id long, score double, text string"), top, budget, cap)
    want, used, per = [], 0, {}
    for _, _, c, f, _, t in rows:
        if c in [w[0] for w in want] or (cap is not None and per.get(f, 0) >= cap):
            continue
        if budget - used <= 0 or len(want) >= top:
            break
        t = t.strip()
        if len(t) > budget - used:
            t = t[: budget - used].rsplit(" ", 1)[0].strip()
        if t:
            want.append((c, t))
            used += len(t)
            per[f] = per.get(f, 0) + 1
    assert [(r["chunk_id"], r["text"]) for r in got.orderBy("position").collect()] == want


def test_answerability_levels(spark):
    q = spark.createDataFrame([(1, "refund window"), (2, "zebra")], "query_id long, query string")
    s = spark.createDataFrame([(1, 0.8, "The refund window is 30 days.")], "query_id long, score double, text string")
    got = {r["query_id"]: r for r in evidence.answerability(q, s).collect()}
    assert (got[1]["answerability"], got[1]["coverage"]) == ("high", 1.0)
    assert got[2]["answerability"] == "none"


def test_audit_of_supported_and_unsupported(spark):
    a = spark.createDataFrame([("m", "Refunds are available within 30 days [1]. The office is on Mars.")], "message_id string, answer string")
    s = spark.createDataFrame([("m", 1, "Refunds are available within 30 days of purchase.")], "message_id string, source_index int, text string")
    assert [r["status"] for r in evidence.audit_sentences(a, s).orderBy("sentence_index").collect()] == ["supported", "unsupported"]
    row = evidence.audit(a, s).first()
    assert (row["answer_supported"], row["quality"]) == (False, "weak")
    none = evidence.grounding(a, s.limit(0)).first()
    assert (none["has_sources"], none["missing_citation_count"]) == (False, 0)


def test_bm25_orders_as_sqlite_does(spark):
    import sqlite3

    texts = ["refund policy refund", "shipping policy", "refund within thirty days of the policy", "nothing here", "policy"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, t, tokenize='unicode61')")
    db.executemany("insert into f values (?, ?)", [(f"c{i}", t) for i, t in enumerate(texts)])
    want = [r[0] for r in db.execute("select id from f where f match 'refund OR days' order by bm25(f), id")]
    rows = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "refund days")], "query_id long, query string")
    got = search.keyword_ranks(search.bm25(q, rows), 10).orderBy(F.desc("keyword_score")).collect()
    assert [r["chunk_id"] for r in got] == want


def test_hash_vectors_follow_the_digest(spark):
    rows = spark.createDataFrame([("a", "Foo bar foo"), ("b", "")], "chunk_id string, text string")
    got = {r["chunk_id"]: r["vector"] for r in hashing.hash_vectors(rows, 16).collect()}
    want = [0.0] * 16
    for t in ("foo", "bar", "foo"):
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        want[int.from_bytes(d[:4], "big") % 16] += 1 if d[4] & 1 else -1
    norm = sum(x * x for x in want) ** 0.5 or 1.0
    assert got["a"] == pytest.approx([x / norm for x in want])
    assert got["b"] == [0.0] * 16


def test_arithmetic():
    assert arithmetic.evaluate("Calculate 6 * 7") == "42"
    assert arithmetic.evaluate("what is (1 + 2) / 2") == "1.5"
    assert arithmetic.evaluate("2^10") == "1024"
    assert arithmetic.evaluate("9**9**9**9") is None
    assert arithmetic.evaluate("nothing") is None


def test_scripts_and_trust(spark):
    assert one(spark, scripts.dominant_script, "Привет как дела ok") == "Cyrillic"
    assert one(spark, scripts.dominant_script, "abc") is None
    assert one(spark, scripts.coarse_script, "x ب") == "Arabic"
    assert one(spark, scripts.text_trust, "zxcvb" * 60)["trusted"] is False
    assert one(spark, scripts.text_trust, "the other one is in the garden " * 10)["trusted"] is True


def test_tables_as_markdown(spark):
    source = "<table><tr><th>a</th><th colspan='2'>b</th></tr><tr><td rowspan='2'>1</td><td>x|y</td><td>&amp;</td></tr><tr><td>z</td></tr></table>"
    assert cleaning.table_markdown(source).split("\n") == ["| a | b |  |", "| --- | --- | --- |", "| 1 | x\\|y | & |", "| 1 | z |  |"]
    assert one(spark, cleaning.clean_markdown, "a b\r\n#T\n\n\n\n|  | |\n| x |y|") == "a b\n# T\n\n| x | y |\n"


def test_html_as_markdown():
    got = readers.html_markdown("<h1>T</h1><script>x</script><p>a <b>b</b> <a href='/u'>c</a></p><ul><li>1<ol><li>2</li></ol></li></ul>")
    assert got.startswith("# T") and "**b**" in got and "[c](/u)" in got and "- 1" in got and "1. 2" in got and "x" not in got.replace("\n", "")


def test_readers_report_what_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n3\n")
    (tmp_path / "b.json").write_text('{"k": 1}')
    (tmp_path / "c.zip").write_bytes(b"PK")
    (tmp_path / "d.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "e.eml").write_bytes(b"From: a@b.c\nSubject: Hi\n\nBody")
    got = {r["filename"]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"]["text"] == "| x | y |\n| --- | --- |\n| 1 | 2 |"
    assert '"k": 1' in got["b.json"]["text"]
    assert got["c.zip"]["text"] is None and "unsupported" in got["c.zip"]["error"]
    assert got["d.txt"]["text"] == "é"
    assert got["e.eml"]["text"] == "**From:** a@b.c\n**Subject:** Hi\n\nBody"


def test_memories(spark):
    said = "Remember that my dog is Rex. I prefer tea! call me Ann, ok"
    rows = spark.createDataFrame([(1, 0, "user", said), (1, 1, "user", "")], "chat_id long, pos int, role string, content string")
    assert [r["memory"] for r in chats.extract_memories(rows).orderBy("item").collect()] == [
        "User's dog is Rex", "User's dog is Rex", "User prefers tea", "User wants to be called Ann, ok",
    ][1:]
    m = spark.createDataFrame([(1, 0, "likes tea"), (1, 1, "has dog"), (1, 2, "Likes  TEA")], "chat_id long, ord int, content string")
    assert [(r["pos"], r["content"]) for r in chats.upsert_memories(m).orderBy("pos").collect()] == [(0, "Likes  TEA"), (1, "has dog")]


def test_follow_up_plans_use_what_was_said(spark):
    rows = spark.createDataFrame([(1, 0, "system", "hint"), (1, 1, "user", "first question about refunds and returns now"), (1, 2, "user", "and shipping?")], "chat_id long, pos int, role string, content string")
    got = [r["query"] for r in chats.plan_queries(rows).filter("pos = 2").orderBy("plan_pos").collect()]
    assert got == ["hint and shipping?", "first question about refunds and returns now and shipping?", "and shipping?"]


def test_tools_by_request(spark):
    rows = chats.tool_triggers(spark.createDataFrame([("what time is it, 2+2",)], "content string"))
    assert chats.select_tools(rows).first()["tools"] == ["calculator", "time"]
    assert chats.select_tools(rows, ["list_files"], ["time"]).first()["tools"] == ["list_files", "time"]
    with pytest.raises(ValueError):
        chats.select_tools(rows, ["nope"])


def test_scope_rules(spark):
    e = spark.createDataFrame([(1, 0, 7), (1, 1, 8)], "query_id long, pos long, file_id long")
    c = spark.createDataFrame([(1, "k"), (2, "empty")], "query_id long, knowledge_id string")
    m = spark.createDataFrame([("k", 0, 8), ("k", 1, 9)], "knowledge_id string, pos long, file_id long")
    assert [(r["query_id"], r["file_id"]) for r in files.resolve_scope(e, c, m).orderBy("query_id", "ord").collect()] == [(1, 7), (1, 8), (1, 9)]
    assert files.resolve_scope(e, c, m, strict=True).filter("query_id = 2").first()["file_id"] is None


def test_file_names_in_queries(spark):
    q = spark.createDataFrame([(1, "please open refund-guide.txt"), (2, "shipping guide rules"), (3, "nothing")], "query_id long, query string")
    f = spark.createDataFrame([(1, "refund-guide.txt", ["refund"], "", 1), (2, "shipping-guide.txt", [], "rules of shipping", 2)], "file_id long, filename string, keywords array<string>, summary string, created_at long")
    best = {r["query_id"]: r for r in files.search_files(q, f).filter("rank = 1").collect()}
    assert best[1]["file_id"] == 1 and best[1]["reasons"].startswith("filename_exact")
    assert best[2]["file_id"] == 2 and 3 not in best
    assert sorted((r["query_id"], r["file_id"]) for r in files.narrow_by_filename(q, f).collect()) == [(1, 1), (2, 2)]


def test_chats_round_trip(spark):
    rows = spark.createDataFrame([(3, 0, "user", "hi"), (3, 1, "assistant", "ho")], "chat_id long, pos long, role string, content string")
    e = sinks.export_chats(rows)
    kept = sinks.import_chats(e, rows.select("chat_id").limit(0), preserve=True)
    assert sorted(kept.collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        sinks.import_chats(e, rows.select("chat_id"), preserve=True)
    assert sinks.import_chats(e, rows.select("chat_id")).first()["chat_id"] == 7


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    good = '{"user_id": "u", "attachments": [{"attachment_id": "a", "title": "t"}]}'
    rows = spark.createDataFrame([("1", good), ("2", "{bad"), ("3", ""), ("1", good)], "job_id string, data string")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.read_jobs(spark, str(tmp_path / "in"), "job_id string, data string")
    out = str(tmp_path / "out")
    jobs.process(stream, lambda df: jobs.out_events(df), out, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r["job_id"] for r in spark.read.parquet(out + "/done").collect()] == ["1"]
    assert sorted((r["job_id"], r["reason"]) for r in spark.read.parquet(out + "/dead").collect()) == [("2", "invalid json"), ("3", "missing data")]
    assert spark.read.parquet(out + "/status").count() == 3


def test_answer_events_in_order():
    got = [e["event"] for e in jobs.answer_events({"answer": "x" * 100, "tools": ["calculator"]})]
    assert got == ["retrieval", "tools", "token", "token", "done"]
