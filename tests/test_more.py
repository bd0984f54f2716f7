"""Searches against brute force, office files, remote recognition, answers and a stream that is started again."""

from __future__ import annotations

import hashlib
import io
import json
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions import hashing, rowwise
from veldspar.functions import text as T
from veldspar.operators import answers, cleaning, pages, search, selection
from veldspar.plans import catalog
from veldspar.plans import retrieval_queries as R
from veldspar.sources import office, readers, remote
from veldspar.streaming import jobs


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    stock = [f"w{k}" for k in range(60)] + ["The", "of", "ünïcode", "x_1"]
    rows = [(f"{i % 9}:{i}", i % 9, f"f{i % 4}", i, " ".join(rng.choice(stock) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id long, filename string, chunk_index int, text string").repartition(5)
    asked = [(k, " ".join(rng.choice(stock) for _ in range(rng.randrange(1, 6)))) for k in range(12)] + [(99, "nothing_like_it"), (98, "")]
    return chunks, rows, spark.createDataFrame(asked, "query_id long, query string"), asked


def embedded(text, dimensions=16):
    v = np.zeros(dimensions)
    for t in re.findall(r"[a-zA-Z0-9_]+", text.lower()):
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "big") % dimensions] += 1 if d[4] & 1 else -1
    return v / np.linalg.norm(v) if np.linalg.norm(v) else v


def test_hash_vectors_against_a_loop(spark):
    texts = ["a b a", "", "Foo bar_2 foo", "ünï x", "w1 " * 50]
    got = {r["chunk_id"]: r["vector"] for r in hashing.hash_vectors(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), 16).collect()}
    assert all(np.allclose(got[i], embedded(t)) for i, t in enumerate(texts))
    embed = rowwise.Embedder(16, 2)  # forgets its slots
    assert np.allclose(embed(texts[2]), embedded(texts[2])) and np.allclose(embed(texts[0]), embedded(texts[0]))


@pytest.mark.parametrize("most", [100_000, 0])
def test_lexical_best_against_brute_force(corpus, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_KEPT", most)
    chunks, rows, queries, asked = corpus
    token = lambda t: set(re.findall(r"[a-zA-Z0-9_]+", t.lower()))
    got = defaultdict(list)
    for r in search.lexical_top_k(queries, chunks, 4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["chunk_id"], r["text"]))
    for q, text in asked:
        scored = [(round(len(token(text) & token(t)) / max(1, len(token(text))), 5), c, t) for c, _, _, _, t in rows]
        assert got[q] == sorted((s for s in scored if s[0] >= 0.05), key=lambda s: (-s[0], s[1]))[:4]


@pytest.mark.parametrize("most", [100_000, 0])
def test_keyword_best_in_a_scope(spark, corpus, monkeypatch, most):
    chunks, rows, queries, asked = corpus
    scope = spark.createDataFrame([(q, f) for q, _ in asked if q % 2 for f in (1, 4)], "query_id long, file_id long")
    want = defaultdict(list)
    for r in search.bm25(queries, chunks).collect():
        if r["query_id"] % 2 == 0 or int(r["chunk_id"].split(":")[0]) in (1, 4):
            want[r["query_id"]].append((-round(r["score"], 9), r["chunk_id"]))
    monkeypatch.setattr(search, "MOST_KEPT", most)
    # As for queries without rows in a scope, those of even numbers see all files; the join is told so by rows for each file.
    whole = scope if most else scope.unionByName(spark.createDataFrame([(q, f) for q, _ in asked if not q % 2 for f in range(9)], scope.schema))
    got = defaultdict(list)
    for r in search.bm25_top_k(queries, chunks, 5, whole).collect():
        got[r["query_id"]].append((-r["score"], r["chunk_id"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x)[:5] for q, x in want.items()}


def test_hybrid_best_against_brute_force(spark, corpus):
    chunks, rows, queries, asked = corpus
    both = chunks.join(hashing.hash_vectors(chunks.select("chunk_id", "text"), 16), "chunk_id")
    vectors = hashing.hash_vectors(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), 16).withColumnRenamed("chunk_id", "query_id")
    keyword = search.keyword_ranks(search.bm25_top_k(queries, chunks, 10), 10)
    told = {(r["query_id"], r["chunk_id"]): r["keyword_score"] for r in keyword.collect()}
    got = defaultdict(list)
    for r in search.hybrid_top_k(queries, vectors, both, keyword, 6).collect():
        got[r["query_id"]].append((-r["score"], r["chunk_id"]))
    token = lambda t: set(re.findall(r"[a-zA-Z0-9_]+", t.lower()))
    for q, text in asked:
        scored = []
        for c, _, name, at, t in rows:
            s = 0.7 * float(embedded(text) @ embedded(t)) + 0.2 * len(token(text) & token(t)) / max(1, len(token(text))) + 0.35 * told.get((q, c), 0.0)
            if s >= 0.05:
                scored.append((-round(s, 5), name, at, c))
        assert sorted(got[q]) == sorted((s, c) for s, _, _, c in sorted(scored)[:6])


def test_budget_and_diversity_of_real_candidates(spark, sf_dir):
    """Both folds over the candidates of every question, against loops as the docstrings tell them."""
    ranked = R._reranked(spark, sf_dir).withColumn("file_id", F.col("file_id").cast("long")).cache()
    by = defaultdict(list)
    for r in ranked.collect():
        by[r["query_id"]].append(r)
    budget = {(r["query_id"], r["position"]): (r["chunk_id"], r["chars"]) for r in catalog.QUERIES["budget_select"](spark, sf_dir).collect()}
    order = defaultdict(list)
    for r in catalog.QUERIES["mmr_select"](spark, sf_dir).orderBy("query_id", "mmr_rank").collect():
        order[r["query_id"]].append(r["chunk_id"])
    tokens = lambda t: set(re.findall(r"[a-zA-Z0-9_]+", t.lower()))
    seen = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        used, out, files = 0, [], Counter()
        for r in rows:
            if files[r["file_id"]] >= 2:
                continue
            left = 3000 - used
            if left <= 0 or len(out) >= 5:
                break
            text = r["text"].strip()
            text = text if len(text) <= left else text[:left].rsplit(" ", 1)[0].strip()
            if text:
                used += len(text)
                files[r["file_id"]] += 1
                out.append((r["chunk_id"], len(text)))
        assert out == [budget[q, k + 1] for k in range(len(out))]
        seen += len(out)
        free, picked = list(range(len(rows))), []
        sets = [tokens(r["text"]) for r in rows]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        while free:
            if not picked:
                best = free[0]
            else:
                near = {i: max(jaccard(sets[i], sets[j]) for j in picked) for i in free}
                same = {rows[j]["file_id"] for j in picked}
                value = {i: 0.35 * rows[i]["score"] - 0.65 * near[i] - (0.15 if rows[i]["file_id"] in same else 0.0) for i in free}
                best = max(free, key=lambda i: (value[i], -i))
            picked.append(best)
            free.remove(best)
        assert order[q] == [rows[i]["chunk_id"] for i in picked]
    assert seen == len(budget)


def test_cleaning_of_tables_on_a_grid():
    source = "<table><tr><td rowspan=3>a</td><td>b</td></tr><tr><td colspan=2>c</td><td>d</td></tr><tr><td>e</td></tr></table>"
    assert cleaning.table_markdown(source).split("\n") == ["| a | b |  |  |", "| --- | --- | --- | --- |", "| a | c |  | d |", "| a | e |  |  |"]
    assert cleaning.table_markdown("<table></table>") == "<table></table>"
    assert cleaning.bare("<style>x</style><p>A &amp; B</p>\n\n\n\n<script>y</script>C&nbsp;D") == "A & B \n\nC\xa0D\n"


# office files


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W, A, P, S, R_ = (x[1:-1] for x in (office.W, office.A, office.P, office.S, office.R))
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def rel(ident, kind, target):
    return f'<Relationship Id="{ident}" Type="http://x/{kind}" Target="{target}"/>'


def docx_file() -> bytes:
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    para = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}{run(t)}</w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Report", "T1") + para("Part one", "H2") + para("plain &amp; simple") + para("item", "LB") + para("") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    body += f'<w:p><w:r><w:drawing><a:blip xmlns:a="{A}" xmlns:r="{R_}" r:embed="i1"/></w:drawing></w:r></w:p>'
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("T1", "Title"), ("H2", "heading 2"), ("LB", "List Bullet")))
    return archive({
        "word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>',
        "word/_rels/document.xml.rels": RELS.format(rel("i1", "image", "media/one.png") + rel("i2", "image", "media/two.png")),
    })


def test_word_files():
    found = office.blocks(docx_file(), "docx")
    assert [(b.kind, b.text) for b in found] == [
        ("text", "# Report"), ("text", "## Part one"), ("text", "plain & simple"), ("text", "- item"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("image", "word/media/one.png"), ("image", "word/media/two.png"),
    ]
    assert readers.extract(docx_file(), "x.docx") == ("# Report\n\n## Part one\n\nplain & simple\n\n- item\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", None)


def test_slides():
    para = lambda t, level=0: f'<a:p>{f"<a:pPr lvl=\'{level}\'/>" if level else ""}<a:r><a:t>{t}</a:t></a:r></a:p>'
    shape = lambda inner, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{inner}</p:txBody></p:sp>"
    grid = f"<p:graphicFrame><a:tbl><a:tr><a:tc>{para('h')}</a:tc></a:tr><a:tr><a:tc>{para('v')}</a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = lambda inner: f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R_}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'
    data = archive({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R_}"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format(rel("a", "slide", "slides/s1.xml") + rel("b", "slide", "slides/s2.xml")),
        "ppt/slides/s1.xml": slide(f"<p:grpSp>{shape(para('in a group') + para('below', 1) + para('deeper', 2))}</p:grpSp>{grid}"),
        "ppt/slides/s2.xml": slide(shape(para("First")) + '<p:pic><p:blipFill><a:blip r:embed="p"/></p:blipFill></p:pic>'),
        "ppt/slides/_rels/s2.xml.rels": RELS.format(rel("p", "image", "../media/p.png") + rel("n", "notesSlide", "../notes/n.xml")),
        "ppt/notes/n.xml": f'<p:notes xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shape(para("say this"), "<p:ph type=\'body\'/>")}{shape(para("3"), "<p:ph type=\'sldNum\'/>")}</p:spTree></p:cSld></p:notes>',
    })
    assert [(b.page, b.kind, b.text) for b in office.blocks(data, "pptx")] == [
        (0, "text", "First"), (0, "image", "ppt/media/p.png"), (0, "notes", "> **Notes:** say this"), (1, "text", "in a group\n- below\n  - deeper"), (1, "table", "| h |\n| --- |\n| v |"),
    ]
    assert readers.extract(data, "x.pptx")[0].startswith("### Slide 1\n\nFirst\n\n> **Notes:** say this\n\n### Slide 2")


def test_sheets():
    cell = lambda ref, v, t="": f'<c r="{ref}" t="{t or "n"}"><v>{v}</v></c>'
    rows = f'<row r="1">{cell("A1", 0, "s")}{cell("C1", 1, "s")}</row><row r="2">{cell("A2", "1.5")}{cell("B2", 1, "b")}</row><row r="3">{cell("A3", "")}</row><row r="9">{cell("A9", 7)}</row>'
    data = archive({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R_}"><sheets><sheet name="One" r:id="s"/><sheet name="Two" r:id="t"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format(rel("s", "worksheet", "worksheets/a.xml") + rel("t", "worksheet", "worksheets/b.xml")),
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>na|me</t></si><si><r><t>li</t></r><r><t>ne\n2</t></r></si></sst>',
        "xl/worksheets/a.xml": f'<worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet xmlns="{S}"><sheetData><row r="2">{cell("B2", 5)}</row></sheetData></worksheet>',
    })
    text, error, note = readers.extract_noted(data, "x.xlsx", most_rows=4)
    assert error is None and "row 9" in note
    assert text.split("\n\n")[:2] == ["### Sheet: One", "| na\\|me |  | line 2 |\n| --- | --- | --- |\n| 1.5 | True |  |"]
    assert text.endswith("### Sheet: Two\n\n| col1 | col2 |\n| --- | --- |\n|  |  |\n|  | 5 |")


def test_readers_say_what_they_leave_out(spark, tmp_path):
    rows = "a;b\n" + "bad line\n" * 5 + "1;2\n" * 6
    text, _, note = readers.extract_noted(rows.encode(), "t.csv", most_rows=4)
    assert text.count("| 1 | 2 |") == 4 and note.startswith("2 rows")
    (tmp_path / "a.txt").write_text("long " * 10)
    (tmp_path / "b.html").write_text("<dl><dt>t</dt><dd>d</dd></dl><hr><figure><figcaption>c</figcaption></figure>")
    got = {r["filename"]: r for r in readers.read_files(spark, str(tmp_path), most_chars=9).collect()}
    assert got["a.txt"]["text"] == "long long" and got["a.txt"]["note"].startswith("41 characters") and got["b.html"]["text"] == "t\n\nd\n\n---\n\nc"
    readers.register("shout", [".loud"], lambda data, kind, chars, rows: (data.decode().upper(), None))
    assert readers.extract(b"hey", "x.LOUD") == ("HEY", None)

    def service(content, name):
        if name == "b.txt":
            raise ConnectionError("down")
        return {"markdown": "# " + content.decode(), "text": "no"}

    read = readers.read_remote(spark.createDataFrame([("p/a.txt", "a.txt", b"one"), ("p/b.txt", "b.txt", b"two")], "path string, filename string, content binary"), service)
    assert {r["filename"]: (r["text"], r["reader"]) for r in read.collect()} == {"a.txt": ("# one", "remote"), "b.txt": ("two", "local")}


# remote recognition


def test_replicas_rest_and_return():
    now = [0.0]
    pool = remote.Pool(["a", "b", "c"], rest=10, clock=lambda: now[0])
    assert [pool.pick() for _ in range(4)] == ["a", "b", "c", "a"]
    pool.failed("b")
    assert "b" not in {pool.pick() for _ in range(6)}
    for x in "ac":
        pool.failed(x)
    assert {pool.pick() for _ in range(6)} == {"a", "b", "c"}  # all rest, so all are asked
    now[0] = 11.0
    assert pool.healthy() == ["a", "b", "c"]
    assert pool.probe(lambda address, payload: "x" if address != "c" else _fail(503)) == {"a": True, "b": True, "c": False}
    assert pool.healthy() == ["a", "b"]


def _fail(status):
    raise remote.Failed(status)


def test_retries_wait_longer_and_end():
    waits, answers_ = [], iter([500, None, 200])

    def send(address, payload):
        status = next(answers_)
        return "text" if status == 200 else _fail(status)

    client = remote.Client(remote.Pool(["a", "b"]), send, tries=3, first=4, most=6, sleep=waits.append, draw=lambda wait: wait)
    assert client.ask({}) == "text" and waits == [4, 6]
    calls = []
    client = remote.Client(remote.Pool(["a"]), lambda address, payload: calls.append(1) or _fail(413), sleep=waits.append)
    with pytest.raises(remote.Failed):
        client.ask({})
    assert len(calls) == 1  # a refusal that lasts isn't repeated


def test_blocks_are_routed_by_script(spark):
    def client(name, refuse=None):
        def send(address, payload):
            if refuse and "max_tokens" not in payload:
                raise remote.Failed(refuse)
            return f"{name}:{payload['image'].decode()}"[: payload.get("max_tokens", 1000)]

        return remote.Client(remote.Pool([name]), send, tries=1, sleep=lambda s: None)

    def made():
        return {"eu": client("eu"), "asia": client("asia", 413), "down": client("down", 503)}

    routes, script = {"Han": "asia", "Thai": "down"}, lambda t: {"h": "Han", "t": "Thai"}.get(t.split(":")[1][:1])
    read = lambda image, around, mode: remote.read_block(image, around, made(), routes, "eu", script, mode, 30)
    assert read(b"x", None, "surrounding_text") == ("eu:x", "eu", None, None)
    assert read(b"h1", None, "probe_ocr") == ("eu:h1", "eu", "Han", None)  # the routed backend refuses for good, so the probe stays
    assert read(b"t1", None, "both")[0].startswith("<!-- OCR failed") and read(b"t1", None, "both")[3] == "status 503"
    assert read(b"x" * 200, None, "probe_ocr")[0] == "eu:" + "x" * 27  # a probe of fewer characters than three a token is whole
    frame = spark.createDataFrame([(1, b"x", None), (2, b"h", "Han")], "block_id long, image binary, surrounding_script string")
    got = {r["block_id"]: (r["text"], r["backend"]) for r in remote.recognise(frame, made, routes, "eu", script).collect()}
    assert got[1] == ("eu:x", "eu") and got[2][0].startswith("<!-- OCR failed")


# pages, answers, streams


def test_density_of_grey_pixels(spark):
    frame = spark.createDataFrame([(1, bytes([255, 0, 249, 250])), (2, b""), (3, None)], "k int, p binary")
    assert {r["k"]: r["d"] for r in frame.select("k", pages.visual_density(F.col("p")).alias("d")).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_the_ladder_of_answers(spark):
    q = spark.createDataFrame([(k, "what tea do I like") for k in range(1, 7)], "query_id long, query string")
    sources = spark.createDataFrame([(1, 1, "a.txt", "Tea is good. Coffee too.")], "query_id long, position int, filename string, text string")
    tools = spark.createDataFrame([(1, 0, "time", "noon"), (2, 1, "b", "2"), (2, 0, "a", "1")], "query_id long, ord int, name string, output string")
    memory = "Saved chat memory:\n- Lives far away..\n- Likes green tea.\nEarlier conversation summary:\nold"
    history = spark.createDataFrame([(3, 0, "system", memory), (4, 1, "assistant", "x" * 600), (5, 1, "assistant", ""), (4, 0, "assistant", "older")], "query_id long, pos long, role string, content string")
    got = {r["query_id"]: (r["kind"], r["answer"]) for r in answers.answer(q, sources, tools, history).collect()}
    assert got[1] == ("sources", "Answer:\n\n[1] Tea is good. Coffee too.\n\nSources: [1] a.txt")
    assert got[2] == ("tools", "Tool results:\n\n- a: 1\n- b: 2")
    assert got[3] == ("memory", "From saved chat memory: Likes green tea.")
    assert got[4][0] == "history" and got[4][1].endswith(": " + "x" * 500)
    assert got[5] == got[6] == ("none", answers.NOTHING)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"job_id": k, "data": json.dumps({"user_id": "u", "attachments": [{"attachment_id": "1", "title": "t"}]}) if k else ""}))

    def run():
        rows = jobs.read_jobs(spark, str(tmp_path / "in"), "job_id long, data string", files_per_trigger=1)
        jobs.process(rows, lambda good: good.select("job_id"), str(tmp_path / "out"), str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["job_id"] for r in spark.read.parquet(str(tmp_path / "out" / "done")).collect()), sorted(r["job_id"] for r in spark.read.parquet(str(tmp_path / "out" / "dead")).collect())

    assert run() == ([1, 2], [0])
    (tmp_path / "in" / "9.json").write_text(json.dumps({"job_id": 9, "data": ""}))
    assert run() == ([1, 2], [0, 9])  # only what was pending is read


def test_skills_without_a_bound(spark):
    from veldspar.operators import chats

    skills = spark.createDataFrame([(k, k % 2 == 0, [f"word{k}", " "]) for k in range(3000)], "skill_id long, enabled boolean, triggers array<string>")
    said = spark.createDataFrame([(1, 0, "say WORD2998 now"), (1, 1, "word2999")], "chat_id long, pos long, content string")
    chosen = spark.createDataFrame([(1, 1, 4), (1, 1, 5)], "chat_id long, pos long, skill_id long")
    assert Counter((r["pos"], r["skill_id"]) for r in chats.match_skills(said, skills, chosen=chosen).collect()) == {(0, 2): 1, (0, 2998): 1, (1, 4): 1, (1, 2): 1} | {
        (p, k): 1 for p, w in ((0, "2998"), (1, "2999")) for k in range(0, 3000, 2) if f"word{k}" in f"word{w}"
    }


def test_what_is_run_again(spark):
    from veldspar.operators import chats

    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(4)] + [(2, 0, "user", "alone")]
    m = spark.createDataFrame(rows, "chat_id long, pos long, role string, content string")
    targets = spark.createDataFrame([(1, 2), (2, 5)], "chat_id long, target_pos long")
    told = lambda pair: (sorted((r["chat_id"], r["pos"]) for r in pair[0].collect()), sorted(tuple(r) for r in pair[1].collect()))
    assert told(chats.rerun(m, targets)) == ([(1, 0), (1, 1), (2, 0)], [(1, "m2")])
    edits = spark.createDataFrame([(1, "edited")], "chat_id long, content string")
    assert told(chats.rerun(m, targets, edits)) == ([(1, 0), (1, 1), (2, 0)], [(1, "edited")])
    assert told(chats.regenerate(m)) == ([(1, 0), (1, 1), (2, 0)], [(1, "m2")])


def test_registries(spark, sf_dir):
    from veldspar.operators import chats

    hashing.register("ones", lambda dimensions: lambda text: np.ones(dimensions))
    rows = spark.createDataFrame([("a", "x")], "chunk_id string, text string")
    assert hashing.embed(rows, "ones", 3).first()["vector"] == [1.0] * 3 and hashing.embed(rows, "hash", 4).first()["vector"] is not None
    with pytest.raises(ValueError):
        hashing.embed(rows, "none")
    answers.register("echo", lambda q, *rest: q.select("query_id", F.lit("echo").alias("kind"), F.col("query").alias("answer")))
    q = spark.createDataFrame([(1, "hi")], "query_id long, query string")
    assert answers.answer_by("echo", q, q, q, q).first()["answer"] == "hi"
    chats.register_tool("shout", (r"(?i)\bshout\b",), F.upper)
    said = chats.tool_triggers(spark.createDataFrame([(1, "please shout, 2+2")], "query_id long, content string"))
    assert chats.select_tools(said).first()["tools"] == ["calculator", "shout"]
    assert {(r["ord"], r["name"], r["output"]) for r in chats.run_tools(chats.select_tools(said)).collect()} == {(0, "calculator", "4"), (1, "shout", "PLEASE SHOUT, 2+2")}
    del chats.TOOL_TRIGGERS["shout"]


def test_whole_files_are_cut_where_the_budget_ends(spark):
    rows = [("s", f, f"n{f}", c, "x" * 40) for f in range(30) for c in range(2)] + [("s", 99, "a", 0, " "), ("t", 1, "n", 0, "y" * 500)]
    frame = spark.createDataFrame(rows, "scope_id string, file_id long, filename string, chunk_index int, text string")
    got = {(r["scope_id"], r["file_id"]): r["text"] for r in selection.full_context(frame, 100).collect()}
    assert got == {("s", 0): "x" * 40 + "\n\n" + "x" * 40, ("s", 1): "x" * 18, ("t", 1): "y" * 100}
    assert T.TOKEN and search.explained(5, 4) == 12 and search.oversampled(1) == 10


@pytest.mark.parametrize("template", ["Use:\n{context}\n\nQ: {question}", "Q: {question}\n{context} {question}\n{context}", "no sources: {question}"])
def test_digests_of_prompts_that_share_sources(spark, template):
    q = spark.createDataFrame([(1, "a?", 7), (2, "b?", 7), (3, "c?", None), (4, "d?", 8), (5, "e?", 9), (6, None, 7)], "query_id long, query string, pack long")
    texts = {7: ["one", "asks {question} twice {question}", None, "four"], 8: [None], 10: ["unasked"]}
    rows = [(k, i + 1, "f.txt", i, f"{i}:0", 0, 0, 1, 0, 9, 0.5, t) for k, all_ in texts.items() for i, t in enumerate(all_)]
    sources = spark.createDataFrame(rows, "pack long, position int, filename string, file_id int, chunk_id string, chunk_index int, context_start int, context_end int, start_char int, end_char int, score double, text string")
    tools = spark.createDataFrame([(2, 0, "time", "noon"), (3, 0, "time", "noon")], "query_id long, ord int, name string, output string")
    history = spark.createDataFrame([(2, 0, "system", "note"), (2, 1, "user", "hi"), (2, 2, "assistant", "ho"), (4, 0, "system", "")], "query_id long, pos long, role string, content string")
    own = q.select("query_id", "query"), sources.join(q.select("query_id", "pack"), "pack")
    want = answers.prompt_messages(*own, tools, history, "System.", template).withColumn("content", F.md5(F.col("content").cast("binary")))
    rows_of = lambda df: sorted(df.collect(), key=lambda r: (r["query_id"], r["pos"]))
    assert rows_of(answers.prompt_messages(q, sources, tools, history, "System.", template, "pack", digest=True)) == rows_of(want)
    shared = answers.prompt_messages(q, sources, tools, history, "System.", template, "pack").withColumn("content", F.md5(F.col("content").cast("binary")))
    assert rows_of(shared) == rows_of(want)
