"""Queries on retrieval: scoring, fusion, selection, files, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions import text as T
from veldspar.operators import chunks as C
from veldspar.operators import evidence, files, search, selection
from veldspar.plans import sql as S
from veldspar.plans.text_queries import document_chunks, document_files, documents, table

TOP = 5


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_top(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    """The best chunks of each question by shared tokens: query_id, rank, chunk_id, score, file_id, filename, chunk_index, text."""
    return search.lexical_top_k(questions(spark, sf_dir), document_chunks(spark, sf_dir).select("chunk_id", "file_id", "filename", "chunk_index", "text"), k)


_TOP_SQL = S.with_(
    S.CHUNKS, S.QUERIES, S.LEXICAL,
    "scored as (select query_id, chunk_id, round(lexical_score, 5) as score from lexical)",
    "best as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored where score >= 0.05)",
    "top as (select query_id, rank, chunk_id, score, file_id, filename, chunk_index, text from best join chunks using (chunk_id) where rank <= 5)",
)


def answer_evidence(spark, d):
    """Flagship: chunk, score, rank and judge the evidence for every question."""
    q = questions(spark, d)
    top = lexical_top(spark, d)
    return evidence.answerability(q, top)


def lexical_overlap_topk(spark, d):
    return lexical_top(spark, d).select("query_id", "rank", "chunk_id", "score")


def bm25_topk(spark, d):
    return search.top_k(search.bm25_top_k(questions(spark, d), document_chunks(spark, d), 10, places=6), 10)


def keyword_rank_score(spark, d):
    return search.keyword_ranks(search.bm25_top_k(questions(spark, d), document_chunks(spark, d), 15), 15)


def cosine_topk(spark, d):
    """Every vec_id that 20 divides asks, against all rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), "vec_id")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("long").alias("query_id"), "vector")
    best = search.dense_top_k(q, v.select("chunk_id", "vector"), 10)
    return best.select("query_id", "chunk_id", F.round("cosine", 4).alias("cosine"))


#: Letters whose numbers make a text's vector where SQL has to say the same.
LETTERS = "aeinorst"


def letter_vectors(text: str) -> F.Column:
    return F.array(*[(F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def hybrid_topk(spark, d):
    """Blend of cosine, lexical share and keyword rank of every chunk for every question, in one pass; vectors are numbers of letters."""
    q, chunks = questions(spark, d), document_chunks(spark, d)
    keyword = search.keyword_ranks(search.bm25_top_k(q, chunks, 45), 45)
    best = search.hybrid_top_k(q, q.select("query_id", letter_vectors("query").alias("vector")), chunks.withColumn("vector", letter_vectors("text")), keyword, 15)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "filename", "chunk_index", "chunk_id")
    named = best.join(chunks.select("chunk_id", "filename", "chunk_index"), "chunk_id")
    return named.select("query_id", "chunk_id", "score", F.row_number().over(order).alias("rank"))


def hybrid_join(spark, d):
    """The same blend where the parts come from joins; the dense part is a digest of the pairs that share a token."""
    q, chunks = questions(spark, d), document_chunks(spark, d)
    lex = search.lexical(q, chunks)
    kw = search.keyword_ranks(search.bm25_top_k(q, chunks, 45), 45)
    dense = lex.select("query_id", "chunk_id", (F.ascii(F.md5(F.col("chunk_id").cast("binary"))) / 1000.0).alias("cosine"))
    return search.top_k(search.hybrid(dense, lex, kw), 15)


def _candidates(spark, d) -> DataFrame:
    """Candidates of two planned variants of each question: as it stands, and its first half."""
    q = questions(spark, d)
    half = q.select((F.col("query_id") + 100000).alias("query_id"), F.left("query", F.floor(F.length("query") / 2).cast("int")).alias("query"))
    chunks = document_chunks(spark, d)
    best = search.lexical_top_k(q.unionByName(half), chunks.select("chunk_id", "text"), 15, 0.0)
    return best.select(
        (F.col("query_id") % 100000).alias("query_id"), "chunk_id", (F.floor(F.col("query_id") / 100000) * 100 + F.col("rank")).cast("int").alias("ord"), "score", F.lit(1).alias("query_hits")
    )


_CANDIDATES = S.with_(
    S.CHUNKS,
    "base as (select item_id as query_id, text as query from benchmark)",
    "queries as (select query_id, query from base union all select query_id + 100000, left(query, cast(floor(length(query) / 2) as int)) from base)",
    S.LEXICAL,
    "best as (select query_id, chunk_id, round(lexical_score, 5) as score, row_number() over (partition by query_id order by round(lexical_score, 5) desc, chunk_id) as rank from lexical)",
    "candidates as (select query_id % 100000 as query_id, chunk_id, cast(floor(query_id / 100000) * 100 + rank as int) as ord, score, 1 as query_hits from best where rank <= 15)",
    "fused as (select query_id, chunk_id, min(ord) as ord, round(max(score) + least(0.2, 0.04 * (sum(query_hits) - 1)), 5) as score, cast(sum(query_hits) as bigint) as query_hits from candidates group by query_id, chunk_id)",
    f"ranked as (select query_id, chunk_id, ord, query_hits, file_id, text, score + 0.15 * ({S.shared(S.token_set('query'), S.token_set('text'))} / greatest(len({S.token_set('query')}), 1)) as score"
    " from fused join base using (query_id) join chunks using (chunk_id))",
    "reranked as (select *, row_number() over (partition by query_id order by score desc, ord) as rank from ranked)",
)


def fuse_candidates(spark, d):
    return search.fuse(_candidates(spark, d))


def _reranked(spark, d) -> DataFrame:
    chunks = document_chunks(spark, d).select("chunk_id", "file_id", "chunk_index", "text")
    fused = search.fuse(_candidates(spark, d)).join(chunks, "chunk_id")
    return search.rerank(questions(spark, d), fused)


def rerank(spark, d):
    return _reranked(spark, d).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


def per_file_cap(spark, d):
    """One chunk a file by the operator; neither the budget nor the number binds."""
    ranked = _reranked(spark, d).withColumn("file_id", F.col("file_id").cast("long"))
    return selection.select_within_budget(ranked, 1000, 10_000_000, 1).select("query_id", "position", "chunk_id", "file_id", "score")


def budget_select(spark, d):
    ranked = _reranked(spark, d).withColumn("file_id", F.col("file_id").cast("long"))
    chosen = selection.select_within_budget(ranked, TOP, 3000, 2)
    return chosen.select("query_id", "position", "chunk_id", "score", F.length("text").alias("chars"))


def mmr_select(spark, d):
    return selection.diversify(_reranked(spark, d), 0.35)


def window_expand(spark, d):
    top = lexical_top(spark, d, 3).select("query_id", F.col("rank").alias("position"), "file_id", "chunk_index")
    wide = selection.expand_windows(top, document_chunks(spark, d), 1, 4000)
    return wide.select("query_id", "position", F.md5(F.col("text").cast("binary")).alias("digest"), "context_start_index", "context_end_index", "start_char", "end_char")


def explain_candidates(spark, d):
    fused = search.fuse(_candidates(spark, d)).join(document_chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    chosen = lexical_top(spark, d).select("query_id", "chunk_id")
    out = search.explain(questions(spark, d), fused, chosen, 10)
    return out.withColumn("matched_terms", F.array_join("matched_terms", " ")).withColumn("reasons", F.array_join("reasons", " "))


def full_context(spark, d):
    chunks = document_chunks(spark, d).join(documents(spark, d).select(F.col("doc_id").alias("file_id"), F.col("source").alias("scope_id")), "file_id")
    out = selection.full_context(chunks, 24000)
    return out.select("scope_id", "file_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def auto_context_mode(spark, d):
    chunks = document_chunks(spark, d).join(documents(spark, d).select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang").alias("scope_id")), "file_id")
    return selection.context_mode(chunks, 24000)


def _file_table(spark, d) -> DataFrame:
    docs = documents(spark, d)
    name = F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    base = docs.select("doc_id", name.alias("filename"))
    return base.join(C.summaries(docs), "doc_id").select(F.col("doc_id").alias("file_id"), "filename", "keywords", "summary", F.col("doc_id").alias("created_at"))


def file_search(spark, d):
    found = files.search_files(questions(spark, d), _file_table(spark, d))
    return found.filter("rank <= 10")


def filename_narrowing(spark, d):
    """Each question asked of some source and number, as a file name would be."""
    q = questions(spark, d).select("query_id", F.concat(F.lit("what does src"), (F.col("query_id") % 20).cast("string"), F.lit("-"), (F.col("query_id") * 7).cast("string"), F.lit(".txt say on "), F.col("query")).alias("query"))
    return files.narrow_by_filename(q, document_files(spark, d))


def auto_route(spark, d):
    q = questions(spark, d)
    found = files.search_files(q, _file_table(spark, d))
    candidates = documents(spark, d).select(F.col("doc_id").alias("file_id"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("k"))
    candidates = q.join(candidates, F.col("query_id") % 20 == F.col("k")).select("query_id", "file_id")
    return files.route_files(found, candidates, 5)


def knowledge_scope(spark, d):
    members = documents(spark, d).select(F.col("source").alias("knowledge_id"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("file_id"))
    q = questions(spark, d)
    chosen = q.select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("knowledge_id"))
    explicit = q.select("query_id", F.lit(0).cast("long").alias("pos"), F.col("query_id").alias("file_id"))
    return files.resolve_scope(explicit, chosen, members)


def answerability(spark, d):
    return answer_evidence(spark, d)


def source_pack(spark, d):
    return evidence.source_pack(questions(spark, d), lexical_top(spark, d).withColumnRenamed("rank", "position"))


def _answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as answers that cite [1] and [9], and three documents as the sources of each."""
    said = table(spark, d, "conversations").filter("role = 'assistant'")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    answers = said.select(key.alias("message_id"), F.concat("text", F.lit(" See [1]. And see [9] too.")).alias("answer"), "conv_id")
    n = documents(spark, d).count()
    places = answers.select("message_id", "conv_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("source_index"))
    places = places.withColumn("doc_id", (F.col("conv_id") * 3 + F.col("source_index")) % n)
    return answers.select("message_id", "answer"), places.join(documents(spark, d).select("doc_id", "text"), "doc_id").select("message_id", "source_index", "text")


_ANSWERS = """answers as (select conv_id || '-' || turn as message_id, text || ' See [1]. And see [9] too.' as answer, conv_id from conversations where role = 'assistant'),
sources as (select message_id, source_index, d.text from (select message_id, conv_id, unnest([1, 2, 3]) as source_index from answers) a join documents d on d.doc_id = (a.conv_id * 3 + a.source_index) % (select count(*) from documents)),
n as (select message_id, count(*) as n from sources group by message_id)"""
_SENTENCES = f"""parts as (select message_id, array_to_string(list_filter(list_transform(string_split(answer, chr(10)), lambda s: {S.strip('s')}), lambda s: s <> ''), ' ') as t from answers),
sent0 as (select message_id, {S.sentences('t')} as s from parts),
sent as (select message_id, unnest(range(1, len(s) + 1)) as sentence_index, unnest(s) as text from sent0),
sent2 as (select s.*, list_transform(list_filter(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: cast(x as int) between 1 and coalesce(n, 0)), lambda x: cast(x as int)) as cited,
  {S.meaningful("regexp_replace(text, '\\[[0-9]+\\]', ' ', 'g')")} as terms from sent s left join n using (message_id)),
st as (select message_id, source_index, {S.meaningful('text')} as terms from sources),
pair as (select a.message_id, sentence_index, source_index, {S.shared('a.terms', 'b.terms')} / greatest(len(a.terms), 1) as share from sent2 a join st b on a.message_id = b.message_id and (len(cited) = 0 or list_contains(cited, source_index))),
sbest as (select message_id, sentence_index, max(share) as best, list_sort(list(source_index) filter (share > 0)) as matched from pair group by all),
scored as (select message_id, sentence_index, text, round(coalesce(best, 0), 5) as support_score, coalesce(array_to_string(matched, ','), '') as matched,
  case when len(terms) = 0 then 'supported' when coalesce(best, 0) >= 0.55 then 'supported' when coalesce(best, 0) >= 0.25 then 'weak' else 'unsupported' end as status
  from sent2 left join sbest using (message_id, sentence_index))"""
_GROUND = """g0 as (select message_id, coalesce(n, 0) as n, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: cast(x as int)) as numbers from answers left join n using (message_id)),
g1 as (select message_id, n, len(numbers) as k, list_filter(numbers, lambda x: x between 1 and n) as inside from g0),
ground as (select message_id, n > 0 as has_sources, case when n > 0 then len(list_distinct(inside)) else 0 end as cited_source_count,
  n - case when n > 0 then len(list_distinct(inside)) else 0 end as uncited_source_count, case when n > 0 then k - len(inside) else 0 end as missing_citation_count, array_to_string(list_sort(list_distinct(inside)), ',') as cited from g1)"""


def grounding(spark, d):
    return evidence.grounding(*_answers(spark, d))


def audit_sentences(spark, d):
    return evidence.audit_sentences(*_answers(spark, d))


def answer_quality(spark, d):
    return evidence.audit(*_answers(spark, d))


def extractive_answer(spark, d):
    top = lexical_top(spark, d).withColumnRenamed("rank", "position")
    return evidence.extractive_answer(questions(spark, d), top)


def prompt_assembly(spark, d):
    top = lexical_top(spark, d).withColumnRenamed("rank", "position")
    p = evidence.prompts(questions(spark, d), top, "Answer from the sources.", "Context:\n{context}\n\nQuestion: {question}")
    return p.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


def minimum_answerability(spark, d):
    a = answer_evidence(spark, d)
    return a.select("query_id", "answerability", evidence.meets(F.col("answerability"), "medium").alias("allowed"))


_FILES = f"""kt as (select doc_id, unnest({S.keyword_terms(S.normalize('text'))}) as term from documents),
kn as (select doc_id, term, count(*) as n from kt group by all),
kw as (select doc_id, list(term) as keywords from (select * from kn qualify row_number() over (partition by doc_id order by n desc, term) <= 12) group by doc_id),
s0 as (select doc_id, {S.sentences(S.compact(S.normalize('text')))} as s from documents),
s1 as (select doc_id, case when len(s) = 1 and length(s[1]) > 700 then [{S.strip(S.word_cut('s[1]', 700))}] else s end as s from s0),
s2 as (select doc_id, unnest(range(len(s))) as p, unnest(s) as sentence from s1),
sr as (select doc_id, p, sentence, {S.shared(S.token_set('sentence'), "coalesce(keywords, [])")} + cast(p = 0 as int) as score from s2 left join kw using (doc_id)),
sj as (select doc_id, {S.strip("string_agg(sentence, ' ' order by p)")} as t from (select * from sr qualify row_number() over (partition by doc_id order by score desc, p) <= 3) group by doc_id),
files as (select doc_id as file_id, source || '-' || lang || '_' || doc_id as stem, coalesce(keywords, []) as keywords, coalesce({S.excerpt('t', 600)}, '') as summary from documents left join kw using (doc_id) left join sj using (doc_id)),
ft as (select file_id, stem, {S.meaningful("translate(stem, '-_', '  ')")} as by_name, list_distinct(keywords) as by_keyword, {S.meaningful('summary')} as by_summary from files),
fq as (select item_id as query_id, lower({S.compact('text')}) as asked, {S.meaningful('text')} as terms from benchmark),
fs as (select query_id, file_id, case when contains(asked, stem || '.txt') then 3.0 when contains(asked, stem) then 2.0 else 0.0 end as exact,
  {S.shared('terms', 'by_name')} as n1, {S.shared('terms', 'by_keyword')} as n2, {S.shared('terms', 'by_summary')} as n3,
  list_sort(list_filter(terms, lambda t: list_contains(by_name, t) or list_contains(by_keyword, t) or list_contains(by_summary, t))) as matched from fq, ft),
found as (select query_id, file_id, round(exact + 1.5 * n1 + 1.25 * n2 + 0.75 * n3, 5) as score, array_to_string(matched, ' ') as matched_terms,
  array_to_string(list_filter([case when exact = 3 then 'filename_exact' when exact = 2 then 'filename_stem' end, case when n1 > 0 then 'filename_terms=' || n1 end, case when n2 > 0 then 'keywords=' || n2 end, case when n3 > 0 then 'summary_terms=' || n3 end], lambda x: x is not null), ',') as reasons
  from fs where exact + n1 + n2 + n3 > 0),
franked as (select *, row_number() over (partition by query_id order by score desc, file_id desc) as rank from found)"""
_ANSWERABLE = f"""qat as (select query_id, {S.meaningful('query')} as terms from queries),
held as (select query_id, list_distinct(flatten(list({S.meaningful('text')}))) as held, count(*) as selected_count, max(greatest(score, 0)) as t, avg(greatest(score, 0)) as m from top group by query_id),
cov as (select query_id, coalesce(selected_count, 0) as selected_count, {S.shared('terms', 'coalesce(held, [])')} / greatest(len(terms), 1) as c, coalesce(t, 0) as t, coalesce(m, 0) as m from qat left join held using (query_id)),
answerable as (select query_id, selected_count, round(c, 5) as coverage, round(t, 5) as top_score, round(m, 5) as average_score,
  case when c >= 0.75 and t >= 0.45 then 'high' when c >= 0.45 and t >= 0.2 then 'medium' when c > 0 or t > 0 then 'low' else 'none' end as answerability from cov)"""

_ANSWER_SQL = _TOP_SQL.rstrip() + ",\n" + _ANSWERABLE + "\nselect * from answerable"

QUERIES = {
    "answer_evidence": (answer_evidence, _ANSWER_SQL),
    "minimum_answerability": (minimum_answerability, _TOP_SQL.rstrip() + ",\n" + _ANSWERABLE + "\nselect query_id, answerability, answerability in ('medium', 'high') as allowed from answerable"),
    "lexical_overlap_topk": (lexical_overlap_topk, _TOP_SQL + "select query_id, rank, chunk_id, score from top"),
    "bm25_topk": (
        bm25_topk,
        S.with_(S.CHUNKS, S.QUERIES, S.BM25) + "select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank from bm25 qualify rank <= 10",
    ),
    "keyword_rank_score": (
        keyword_rank_score,
        S.with_(S.CHUNKS, S.QUERIES, S.BM25, "r as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm25 qualify rank <= 15)")
        + "select query_id, chunk_id, 1.0 - (rank - 1) / count(*) over (partition by query_id) as keyword_score from r",
    ),
    "cosine_topk": (
        cosine_topk,
        "with p as (select q.vec_id as query_id, cast(v.vec_id as varchar) as chunk_id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as c from embeddings q, embeddings v where q.vec_id % 20 = 0)"
        " select query_id, chunk_id, round(c, 4) as cosine from p qualify row_number() over (partition by query_id order by c desc, chunk_id) <= 10",
    ),
    "hybrid_topk": (
        hybrid_topk,
        S.with_(
            S.CHUNKS, S.QUERIES, S.LEXICAL, S.BM25,
            "kr as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm25 qualify rank <= 45)",
            "kw as (select query_id, chunk_id, 1.0 - (rank - 1) / count(*) over (partition by query_id) as k from kr)",
            "qv as (select query_id, [" + ", ".join(f"length(query) - length(replace(query, '{c}', ''))" for c in LETTERS) + "]::double[] as v from queries)",
            "cv as (select chunk_id, filename, chunk_index, [" + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in LETTERS) + "]::double[] as v from chunks)",
            "cs as (select query_id, chunk_id, filename, chunk_index, coalesce(list_dot_product(qv.v, cv.v) / nullif(sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(cv.v, cv.v)), 0), 0) as cosine from qv, cv)",
            "b as (select query_id, chunk_id, filename, chunk_index, 0.7 * cosine + 0.2 * coalesce(lexical_score, 0) + 0.35 * coalesce(k, 0) as raw from cs left join lexical using (query_id, chunk_id) left join kw using (query_id, chunk_id))",
        )
        + "select query_id, chunk_id, round(raw, 5) as score, row_number() over (partition by query_id order by round(raw, 5) desc, filename, chunk_index, chunk_id) as rank from b where raw >= 0.05 qualify rank <= 15",
    ),
    "hybrid_join": (
        hybrid_join,
        S.with_(
            S.CHUNKS, S.QUERIES, S.LEXICAL, S.BM25,
            "kr as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm25 qualify rank <= 45)",
            "kw as (select query_id, chunk_id, 1.0 - (rank - 1) / count(*) over (partition by query_id) as k from kr)",
            "b as (select query_id, chunk_id, 0.7 * coalesce(case when lexical_score is not null then ascii(md5(chunk_id)) / 1000.0 end, 0) + 0.2 * coalesce(lexical_score, 0) + 0.35 * coalesce(k, 0) as raw from lexical full join kw using (query_id, chunk_id))",
        )
        + "select query_id, chunk_id, round(raw, 5) as score, row_number() over (partition by query_id order by round(raw, 5) desc, chunk_id) as rank from b where raw >= 0.05 qualify rank <= 15",
    ),
    "fuse_candidates": (fuse_candidates, _CANDIDATES + "select * from fused"),
    "rerank": (rerank, _CANDIDATES + "select query_id, rank, chunk_id, round(score, 9) as score from reranked"),
    "per_file_cap": (
        per_file_cap,
        _CANDIDATES.rstrip() + ",\nfirsts as (select * from reranked qualify row_number() over (partition by query_id, file_id order by rank) <= 1)\n"
        "select query_id, cast(row_number() over (partition by query_id order by rank) as int) as position, chunk_id, file_id, round(score, 5) as score from firsts",
    ),
    "budget_select": (
        budget_select,
        _CANDIDATES.replace("with ", "with recursive ", 1).rstrip() + f""",
        budget as (
          select query_id, cast(0 as bigint) as rank, cast(0 as bigint) as used, cast([] as bigint[]) as files, false as done, cast(null as varchar) as chunk_id, cast(0 as double) as score, cast(0 as bigint) as chars from (select distinct query_id from reranked)
          union all
          select query_id, rank, used + case when take then length(t) else 0 end, case when take then list_append(files, file_id) else files end, done, case when take then chunk_id end, score, length(t)
          from (select *, not capped and not done and t <> '' as take from (
            select *, was or (not capped and (lft <= 0 or len(files) >= 5)) as done, case when length(whole) > lft then {S.strip(S.word_cut('whole', 'greatest(lft, 0)'))} else whole end as t from (
              select b.query_id, x.rank, b.used, b.files, b.done as was, x.chunk_id, x.file_id, x.score, 3000 - b.used as lft, {S.strip('x.text')} as whole, len(list_filter(b.files, lambda f: f = x.file_id)) >= 2 as capped
              from budget b join reranked x on x.query_id = b.query_id and x.rank = b.rank + 1))))
        select query_id, cast(row_number() over (partition by query_id order by rank) as int) as position, chunk_id, round(score, 5) as score, chars from budget where chunk_id is not null""",
    ),
    "mmr_select": (mmr_select, None),
    "window_expand": (
        window_expand,
        _TOP_SQL.replace("with ", "with recursive ", 1).rstrip() + f""",
        w as (select t.query_id, t.rank as position, c.chunk_index as i, c.text, c.start_char as a, c.end_char as b from top t join chunks c on c.file_id = t.file_id and c.chunk_index between t.chunk_index - 1 and t.chunk_index + 1 where t.rank <= 3),
        e as (select query_id, cast(position as int) as position, string_agg('[chunk ' || i || ']' || chr(10) || text, chr(10) || chr(10) order by i) as text, min(i) as context_start_index, max(i) as context_end_index, min(a) as start_char, max(b) as end_char from w group by query_id, position),
        f as (
          select query_id, 0 as position, 0 as used, cast(null as varchar) as text from (select distinct query_id from e)
          union all
          select e.query_id, e.position, f.used + length(coalesce(case when length(e.text) <= 4000 - f.used then e.text when f.used < 4000 then {S.strip(S.word_cut('e.text', 'greatest(4000 - f.used, 0)'))} end, '')),
            case when length(e.text) <= 4000 - f.used then e.text when f.used < 4000 then {S.strip(S.word_cut('e.text', 'greatest(4000 - f.used, 0)'))} end
          from f join e on e.query_id = f.query_id and e.position = f.position + 1)
        select query_id, position, md5(f.text) as digest, context_start_index, context_end_index, start_char, end_char from f join e using (query_id, position) where f.text is not null and f.text <> ''""",
    ),
    "explain_candidates": (
        explain_candidates,
        S.with_(_CANDIDATES[5:], "er as (select *, row_number() over (partition by query_id order by score desc, ord) as rank from fused qualify rank <= 10)",
                "ch as (select query_id, chunk_id from best where rank <= 5 and query_id < 100000 and score >= 0.05)",
                f"em as (select e.query_id, e.chunk_id, e.rank, e.score, e.query_hits, list_sort(list_intersect({S.meaningful('query')}, {S.meaningful('c.text')})) as m, ch.chunk_id is not null as selected from er e join base using (query_id) join chunks c on c.chunk_id = e.chunk_id left join ch on ch.query_id = e.query_id and ch.chunk_id = e.chunk_id)")
        + "select query_id, chunk_id, rank, score, selected, array_to_string(m, ' ') as matched_terms, concat_ws(' ', 'score=' || score, case when query_hits > 1 then 'query_hits=' || query_hits end, case when len(m) > 0 then 'matched_terms=' || len(m) end, case when selected then 'selected_for_context' else 'not_selected' end) as reasons from em",
    ),
    "full_context": (
        full_context,
        S.with_(S.CHUNKS, f"f as (select source as scope_id, file_id, filename, {S.strip('string_agg(text, chr(10) || chr(10) order by chunk_index)')} as t from chunks group by all)",
                "b as (select *, coalesce(sum(length(t)) over (partition by scope_id order by filename, file_id rows between unbounded preceding and 1 preceding), 0) as before from f)")
        + "select scope_id, file_id, length(left(t, cast(24000 - before as int))) as chars, md5(left(t, cast(24000 - before as int))) as digest from b where before < 24000",
    ),
    "auto_context_mode": (
        auto_context_mode,
        S.with_(S.CHUNKS) + "select d.source || '/' || d.lang as scope_id, sum(length(c.text)) as chars, case when sum(length(c.text)) > 0 and sum(length(c.text)) <= 24000 then 'full' else 'rag' end as mode from chunks c join documents d on d.doc_id = c.file_id group by 1",
    ),
    "file_search": (file_search, S.with_(_FILES) + "select query_id, rank, file_id, score, matched_terms, reasons from franked where rank <= 10"),
    "filename_narrowing": (
        filename_narrowing,
        "with q as (select item_id as query_id, array_to_string(regexp_extract_all(translate(lower('what does src' || item_id % 20 || '-' || item_id * 7 || '.txt say on ' || text), '\\/', '  '), '[a-zA-Z0-9_.-]+'), ' ') as asked from benchmark),"
        " f as (select doc_id as file_id, lower(source) || '-' || doc_id as stem from documents),"
        " w as (select query_id, file_id, count(*) over (partition by query_id) as matches from q, f where contains(asked, stem || '.txt') or contains(asked, stem)"
        " or (len(list_filter(string_split(replace(stem, '-', ' '), ' '), lambda x: length(x) >= 3)) >= 2 and len(list_filter(list_filter(string_split(replace(stem, '-', ' '), ' '), lambda x: length(x) >= 3), lambda x: not list_contains(string_split(translate(asked, '.-_', '   '), ' '), x))) = 0))"
        " select query_id, file_id from w where matches < (select count(*) from documents)",
    ),
    "auto_route": (
        auto_route,
        S.with_(_FILES, "cand as (select item_id as query_id, doc_id as file_id from benchmark join documents on item_id % 20 = cast(regexp_extract(source, '[0-9]+') as int))",
                "inside as (select query_id, file_id, row_number() over (partition by query_id order by rank) as r from franked semi join cand using (query_id, file_id) qualify r <= 5)")
        + "select query_id, file_id, true as routed from inside union all select query_id, file_id, false from cand where query_id not in (select query_id from inside)",
    ),
    "knowledge_scope": (
        knowledge_scope,
        "with l as (select item_id as query_id, 0 as part, 0 as pos, item_id as file_id from benchmark union all select item_id, 1, doc_id, doc_id from benchmark join documents on source = 'src' || item_id % 20),"
        " f as (select query_id, file_id, min(part * 1000000000 + pos) as o from l group by all) select query_id, row_number() over (partition by query_id order by o, file_id) as ord, file_id from f",
    ),
    "source_pack": (
        source_pack,
        _TOP_SQL.rstrip() + f""",
        pi as (select t.query_id, rank as position, file_id, score, text, {S.meaningful('query')} as terms from top t join queries using (query_id)),
        ps as (select query_id, position, {S.sentences("translate(text, chr(10), ' ')")} as s, terms, text, file_id, score from pi),
        pe as (select query_id, position, unnest(range(len(s))) as p, unnest(s) as x, terms from ps),
        pb as (select query_id, position, x from pe qualify row_number() over (partition by query_id, position order by {S.shared('terms', S.meaningful('x'))} desc, p) = 1),
        px as (select query_id, position, file_id, score, list_sort(list_intersect(terms, {S.meaningful('text')})) as m, {S.excerpt('x', 320)} as e from ps join pb using (query_id, position)),
        pf as (select query_id, file_id, count(*) as source_count, round(max(greatest(score, 0)), 5) as top_score, string_agg('[' || position || ']', ',' order by position) as markers,
          string_agg(array_to_string(m, ' '), '|' order by position) as matched_terms, string_agg(e, '|' order by position) as excerpts, min(position) as f from px group by all)
        select query_id, file_id, row_number() over (partition by query_id order by top_score desc, f) as file_rank, source_count, top_score, markers, matched_terms, excerpts from pf""",
    ),
    "extractive_answer": (
        extractive_answer,
        _TOP_SQL.rstrip() + ",\nsrc as (select query_id, rank as position, filename, text from top),\n" + S.quoted("queries")
        + "\nselect query_id, coalesce(quoted, 'I do not have enough retrieved file context to answer that confidently.') as answer from queries left join quoted using (query_id)",
    ),
    "prompt_assembly": (
        prompt_assembly,
        _TOP_SQL.rstrip() + """,
        c as (select query_id, string_agg('<source id=''' || rank || ''' file=''' || filename || ''' chunk_id=''' || chunk_id || ''' score=''' || score || '''>' || chr(10) || text || chr(10) || '</source>', chr(10) || chr(10) order by rank) as c from top group by query_id)
        select query_id, md5('Answer from the sources.' || coalesce(chr(10) || chr(10) || 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || query, '')) as digest from queries left join c using (query_id)""",
    ),
    "grounding": (grounding, S.with_(_ANSWERS, _GROUND) + "select * from ground"),
    "audit_sentences": (audit_sentences, S.with_(_ANSWERS, _SENTENCES) + "select * from scored"),
    "answer_quality": (
        answer_quality,
        S.with_(_ANSWERS, _SENTENCES, _GROUND,
                "agg as (select message_id, count(*) as sentence_count, count(*) filter (status = 'supported') as supported_count, count(*) filter (status = 'weak') as weak_count, count(*) filter (status = 'unsupported') as unsupported_count, sum(cast(round(support_score * 100000) as bigint)) as total from scored group by message_id)",
                "v as (select message_id, missing_citation_count, coalesce(sentence_count, 0) as sentence_count, coalesce(supported_count, 0) as supported_count, coalesce(weak_count, 0) as weak_count, coalesce(unsupported_count, 0) as unsupported_count, coalesce(total, 0) as total from ground left join agg using (message_id))")
        + "select message_id, sentence_count, supported_count, weak_count, unsupported_count, floor((2 * total + greatest(sentence_count, 1)) / (2 * greatest(sentence_count, 1))) / 100000 as support_score, (sentence_count > 0 and unsupported_count = 0 and missing_citation_count = 0) as answer_supported,"
        " case when sentence_count = 0 then 'unknown' when sentence_count > 0 and unsupported_count = 0 and missing_citation_count = 0 then 'supported' when supported_count + weak_count > 0 then 'weak' else 'unsupported' end as quality from v",
    ),
}
