"""Whole flows: ingest files, retrieve for many questions at once, explain, answer, index anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import text as T
from veldspar.functions.hashing import hash_vectors
from veldspar.operators import chunks as C
from veldspar.operators import evidence, files, search, selection
from veldspar.plans.options import Options


@dataclass(frozen=True)
class Index:
    """Tables of an ingested corpus: files, chunks and the chunks' hashed vectors."""

    files: DataFrame
    chunks: DataFrame
    vectors: DataFrame


def ingest(documents: DataFrame, options: Options = Options()) -> Index:
    """``documents`` (file_id, filename, text, created_at) as an index.

    Files get their keywords, summary and counts. Nothing is kept here: write the tables, or persist them, to use them often.
    """
    parts = C.chunk_documents(documents.select("file_id", "filename", "text"), options.chunk_size, options.chunk_overlap)
    named = documents.select(F.col("file_id").alias("doc_id"), "text")
    counts = parts.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    table = (
        documents.select("file_id", "filename", "created_at", F.length(T.normalize_text(F.col("text"))).alias("text_chars"))
        .join(C.summaries(named).withColumnRenamed("doc_id", "file_id"), "file_id", "left")
        .join(counts, "file_id", "left")
    )
    none = F.expr("cast(array() as array<string>)")
    table = table.withColumn("keywords", F.coalesce("keywords", none)).withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return Index(table, parts, hash_vectors(parts.select("chunk_id", "text"), options.dimensions))


def reindex(index: Index, read: DataFrame, options: Options = Options()) -> tuple[Index, DataFrame]:
    """Replace the files in ``read`` (file_id, filename, text, created_at, error) by what was read of them.

    Files with an error keep their rows; they come back as failures (file_id, error).
    """
    failed = read.filter("error is not null").select("file_id", "error")
    new = ingest(read.filter("error is null").drop("error"), options)
    kept = index.vectors.join(index.chunks.select("chunk_id", "file_id").join(new.files.select("file_id"), "file_id", "left_anti").select("chunk_id"), "chunk_id", "left_semi")
    return Index(
        files.replace_group(index.files, new.files.select(*index.files.columns), "file_id"), files.replace_group(index.chunks, new.chunks.select(*index.chunks.columns), "file_id"), kept.unionByName(new.vectors)
    ), failed


def candidates(planned: DataFrame, index: Index, options: Options, scope: DataFrame | None = None, k: int | None = None, fetch: int | None = None) -> DataFrame:
    """Fused candidates of planned queries (query_id, plan_pos, query), the best 3k (or ``fetch``) of each: query_id, chunk_id, ord, score, query_hits.

    ``scope`` (query_id, file_id) applies before anything is ranked; queries without rows there see all files. Chunks are scored where
    they are read, all parts of the score at once; questions too many for that meet chunks in joins, where the dense part is
    scored for chunks that share a token with the query and for its nearest ones.
    """
    k = fetch or 3 * (k or options.top_k)
    keyed = planned.select("query_id", "plan_pos", (F.col("query_id") * 64 + F.col("plan_pos")).alias("pid"), "query")
    q = keyed.select(F.col("pid").alias("query_id"), "query")
    allowed = None
    if scope is not None:
        everything = keyed.select("query_id").distinct().join(scope.select("query_id").distinct(), "query_id", "left_anti")
        whole = everything.join(keyed, "query_id").select(F.col("pid").alias("query_id"))
        allowed = scope.join(keyed.select("query_id", "pid"), "query_id").select(F.col("pid").alias("query_id"), "file_id")

    def within(pairs: DataFrame) -> DataFrame:
        if allowed is None:
            return pairs
        located = pairs.join(index.chunks.select("chunk_id", "file_id"), "chunk_id")
        inside = located.join(allowed, ["query_id", "file_id"], "left_semi").drop("file_id")
        return inside.unionByName(pairs.join(whole, "query_id", "left_semi"))

    hits = search.oversampled(k)
    keyword = search.keyword_ranks(search.bm25_top_k(q, index.chunks, hits, allowed), hits) if options.mode != "vector" else None
    if options.mode == "keyword":
        scored = search.hybrid(None, None, keyword, "keyword", options.relevance_threshold)
    elif search.small_enough(q, hits, allowed):
        asked = hash_vectors(q.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), options.dimensions).withColumnRenamed("chunk_id", "query_id")
        both = index.chunks.select("chunk_id", "file_id", "filename", "chunk_index", "text").join(index.vectors, "chunk_id")
        scored = search.hybrid_top_k(q, asked, both, keyword, k, options.relevance_threshold, allowed)
    else:
        lexical = within(search.lexical(q, index.chunks))
        asked = hash_vectors(q.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), options.dimensions).withColumnRenamed("chunk_id", "query_id").withColumnRenamed("vector", "asked")
        near = within(search.dense_top_k(asked.select("query_id", F.col("asked").alias("vector")), index.vectors, 4 * k).select("query_id", "chunk_id"))
        pairs = lexical.select("query_id", "chunk_id").unionByName(near).distinct()
        dense = pairs.join(asked, "query_id").join(index.vectors, "chunk_id").select("query_id", "chunk_id", T.cosine(F.col("asked"), F.col("vector")).alias("cosine"))
        scored = search.hybrid(dense, lexical, keyword, options.mode, options.relevance_threshold)
    natural = index.chunks.select("chunk_id", F.struct("filename", "chunk_index", "chunk_id").alias("place"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    best = scored.join(natural, "chunk_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    each = best.select((F.floor(F.col("query_id") / 64)).cast("long").alias("query_id"), "chunk_id", (F.pmod("query_id", F.lit(64)) * 100_000 + F.col("rank")).cast("int").alias("ord"), "score", F.lit(1).alias("query_hits"))
    return search.fuse(each)


def retrieve(questions: DataFrame, index: Index, options: Options = Options(), scope: DataFrame | None = None, planned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources of each question (query_id, query), and how well they answer it.

    ``planned`` (query_id, plan_pos, query) are the queries asked for a question, by default itself. Files that a question names narrow
    its scope, and so does routing where the options say auto and a scope is given. Returns sources (query_id, position,
    file_id, filename, chunk_id, chunk_index, score, text, ranges) and diagnostics, a row per question.
    """
    planned = planned if planned is not None else questions.select("query_id", F.lit(0).alias("plan_pos"), "query")
    named = files.narrow_by_filename(questions, index.files)
    if scope is not None:
        whole = named.join(scope, ["query_id", "file_id"], "left_semi")
        if options.file_selection_mode == "auto":
            routed = files.route_files(files.search_files(questions, index.files), scope, options.file_selection_limit).select("query_id", "file_id")
        else:
            routed = scope.select("query_id", "file_id")
        scope = whole.unionByName(routed.join(whole.select("query_id").distinct(), "query_id", "left_anti"))
    else:
        scope = named
    located = index.chunks.select("chunk_id", F.col("file_id").cast("long").alias("file_id"), "filename", "chunk_index", "start_char", "end_char", "text")
    if options.context_mode == "none":
        chosen = located.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("position"), "chunk_id", "file_id", F.lit(0.0).alias("score"), "text")
    elif options.context_mode == "full":
        chosen = _whole_files(questions, located, scope, options.max_context_chars).join(index.files.select(F.col("file_id").cast("long").alias("file_id"), "filename"), "file_id")
        order = Window.partitionBy("query_id").orderBy("filename", "file_id")
        full_id = F.concat(F.col("file_id").cast("string"), F.lit(":full"))
        chosen = chosen.select("query_id", F.row_number().over(order).alias("position"), full_id.alias("chunk_id"), "file_id", F.lit(1.0).alias("score"), "text")
    else:
        found = candidates(planned, index, options, scope)
        ranked = search.rerank(questions, found.join(located.select("chunk_id", "file_id", "text"), "chunk_id"))
        if options.diversity == "mmr":
            new = selection.diversify(ranked, options.mmr_lambda)
            ranked = ranked.drop("rank").join(new, ["query_id", "chunk_id"]).withColumnRenamed("mmr_rank", "rank")
        chosen = selection.select_within_budget(ranked, options.top_k, options.max_context_chars, options.max_sources_per_file)
        if options.source_window:
            placed = chosen.join(located.select("chunk_id", "chunk_index"), "chunk_id")
            wide = selection.expand_windows(placed.select("query_id", "position", "file_id", "chunk_index"), located, options.source_window, options.max_context_chars)
            chosen = chosen.drop("text").join(wide.select("query_id", "position", "text"), ["query_id", "position"])
    sources = chosen.join(located.select("chunk_id", "filename", "chunk_index", "start_char", "end_char"), "chunk_id", "left")
    return sources, evidence.answerability(questions, sources)


def _whole_files(questions: DataFrame, located: DataFrame, scope: DataFrame, budget: int) -> DataFrame:
    """Whole files for each question: of its scope, or for one without any, those of the whole corpus, which are chosen once and fit the budget."""
    inside = selection.full_context(scope.join(located, "file_id").select("query_id", *located.columns), budget, "query_id")
    every = selection.full_context(located.withColumn("query_id", F.lit(0).cast("long")), budget, "query_id").drop("query_id")
    open_ = questions.select("query_id").join(scope.select("query_id").distinct(), "query_id", "left_anti")
    # The budget bounds the one side, the questions asked the other.
    return inside.unionByName(open_.join(F.broadcast(every), how="cross").select("query_id", "file_id", "text"))


def explain(questions: DataFrame, index: Index, options: Options = Options(), scope: DataFrame | None = None, planned: DataFrame | None = None) -> DataFrame:
    """Why a retrieval chose what it did: the candidates of each question, ``options.explain_limit`` at most, with reasons."""
    planned = planned if planned is not None else questions.select("query_id", F.lit(0).alias("plan_pos"), "query")
    chosen, _ = retrieve(questions, index, options, scope, planned)
    found = candidates(planned, index, options, scope, fetch=search.explained(options.explain_limit, options.top_k))
    return search.explain(questions, found.join(index.chunks.select("chunk_id", "text"), "chunk_id"), chosen, options.explain_limit)


def ask(questions: DataFrame, index: Index, options: Options = Options(), scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quoted answers, their audit against the sources, and the diagnostics.

    A question whose evidence is below the least answerability gets no answer but the statement that there is not enough.
    """
    sources, levels = retrieve(questions, index, options, scope)
    allowed = levels.filter(evidence.meets(F.col("answerability"), options.minimum_answerability)).select("query_id")
    answers = evidence.extractive_answer(questions, sources.join(allowed, "query_id", "left_semi"))
    told = answers.select(F.col("query_id").alias("message_id"), "answer")
    used = sources.select(F.col("query_id").alias("message_id"), F.col("position").cast("int").alias("source_index"), "text")
    return answers, evidence.audit(told, used), levels
