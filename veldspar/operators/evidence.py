"""How well evidence supports a question or an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import answer_sentences, citation_numbers, excerpt, meaningful_terms, split_sentences, strip, strip_citations

LEVELS = {"none": 0, "low": 1, "medium": 2, "high": 3}


def answerability(queries: DataFrame, sources: DataFrame, by: str = "query_id") -> DataFrame:
    """Coverage and level of each query's sources.

    ``queries`` (query_id, query), ``sources`` (query_id, score, text). Terms of all sources count together. A
    query without sources is ``none``. Where queries share sources, both have a column ``by`` instead, and sources are given once.
    Returns query_id, selected_count, coverage, top_score, average_score, answerability.
    """
    keys = list(dict.fromkeys(["query_id", by]))
    q = queries.select(*keys, meaningful_terms(F.col("query")).alias("terms"))
    asked = q.select(*keys, F.explode("terms").alias("term"))
    held = sources.select(by, F.explode(meaningful_terms(F.col("text"))).alias("term")).distinct()
    covered = asked.join(held, [by, "term"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("covered"))
    scores = sources.select(by, F.greatest("score", F.lit(0.0)).alias("s")).groupBy(by).agg(
        F.count(F.lit(1)).alias("selected_count"), F.max("s").alias("top"), F.avg("s").alias("mean")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = q.join(covered, "query_id", "left").join(scores, by, "left")
    coverage = zero("covered") / F.greatest(F.size("terms"), F.lit(1))
    top = F.coalesce("top", F.lit(0.0))
    level = (
        F.when((coverage >= 0.75) & (top >= 0.45), "high")
        .when((coverage >= 0.45) & (top >= 0.20), "medium")
        .when((coverage > 0) | (top > 0), "low")
        .otherwise("none")
    )
    return both.select(
        "query_id", zero("selected_count").alias("selected_count"), F.round(coverage, 5).alias("coverage"), F.round(top, 5).alias("top_score"),
        F.round(F.coalesce("mean", F.lit(0.0)), 5).alias("average_score"), level.alias("answerability"),
    )


def meets(actual: Column, least: str) -> Column:
    """Whether a level is at least ``least``."""
    rank = F.lit(0)
    for name, value in LEVELS.items():
        rank = F.when(actual == name, value).otherwise(rank)
    return rank >= LEVELS.get(least, 0)


def best_sentences(text: Column, terms: Column, limit: int = 320, most: int = 1) -> Column:
    """Sentences of ``text`` that share most of ``terms``, the earlier among equals, cut at ``limit``."""
    sentences = split_sentences(F.translate(text, "\n", " "))
    ranked = F.array_sort(
        F.transform(sentences, lambda s, i: F.struct((-F.size(F.array_intersect(terms, meaningful_terms(s)))).alias("n"), i.alias("i"), s.alias("s")))
    )
    chosen = F.array_join(F.transform(F.slice(ranked, 1, most), lambda x: x["s"]), " ")
    return excerpt(F.when(F.size(sentences) > 0, chosen).otherwise(strip(F.translate(text, "\n", " "))), limit)


def source_pack(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources grouped by file: query_id, file_id, source_count, top_score, markers, matched_terms, excerpts.

    ``sources`` has query_id, position, file_id, score, text; files are ranked by their best score, then by
    where they first appear.
    """
    q = queries.select("query_id", meaningful_terms(F.col("query")).alias("terms"))
    items = sources.join(q, "query_id").select(
        "query_id", "position", "file_id", "score",
        F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]")).alias("marker"),
        F.array_sort(F.array_intersect("terms", meaningful_terms(F.col("text")))).alias("matched"),
        best_sentences(F.col("text"), F.col("terms")).alias("excerpt"),
    )
    files = items.groupBy("query_id", "file_id").agg(
        F.count(F.lit(1)).alias("source_count"), F.round(F.max(F.greatest("score", F.lit(0.0))), 5).alias("top_score"),
        F.array_sort(F.collect_list(F.struct("position", "marker", "matched", "excerpt"))).alias("items"), F.min("position").alias("first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("top_score"), "first")
    return files.select(
        "query_id", "file_id", F.row_number().over(order).alias("file_rank"), "source_count", "top_score",
        F.array_join(F.transform("items", lambda x: x["marker"]), ",").alias("markers"),
        F.array_join(F.transform("items", lambda x: F.array_join(x["matched"], " ")), "|").alias("matched_terms"),
        F.array_join(F.transform("items", lambda x: x["excerpt"]), "|").alias("excerpts"),
    )


def grounding(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of each answer against its sources.

    ``answers`` (message_id, answer), ``sources`` (message_id, source_index). Cited sources count once, citations of absent
    ones each time. An answer without sources has zeros throughout.
    """
    n = sources.groupBy("message_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    at = answers.join(n, "message_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("numbers", citation_numbers(F.col("answer")))
    inside = F.filter("numbers", lambda x: (x >= 1) & (x <= F.col("n")))
    cited = F.when(F.col("n") > 0, F.size(F.array_distinct(inside))).otherwise(0)
    missing = F.when(F.col("n") > 0, F.size("numbers") - F.size(inside)).otherwise(0)
    return at.select(
        "message_id", (F.col("n") > 0).alias("has_sources"), cited.alias("cited_source_count"), (F.col("n") - cited).alias("uncited_source_count"),
        missing.alias("missing_citation_count"), F.array_join(F.transform(F.array_distinct(inside), lambda x: x.cast("string")), ",").alias("cited"),
    )


def audit_sentences(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Support of each sentence of an answer by the sources it cites, or by all if it cites none.

    Support is the largest share of the sentence's terms that one source holds. Terms meet through a join on (message,
    term), so sentences and sources aren't paired unless they share one. Returns message_id, sentence_index, text,
    support_score, matched (source indexes), status.
    """
    s = answers.select("message_id", F.posexplode(answer_sentences(F.col("answer"))).alias("p", "text"))
    s = s.select("message_id", (F.col("p") + 1).alias("sentence_index"), "text", citation_numbers(F.col("text")).alias("numbers"), meaningful_terms(strip_citations(F.col("text"))).alias("terms"))
    n = sources.groupBy("message_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    s = s.join(n, "message_id", "left").withColumn("cited", F.array_distinct(F.filter("numbers", lambda x: (x >= 1) & (x <= F.coalesce("n", F.lit(0))))))
    asked = s.select("message_id", "sentence_index", "cited", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    held = sources.select("message_id", "source_index", F.explode(meaningful_terms(F.col("text"))).alias("term"))
    shared = (
        asked.join(held, ["message_id", "term"])
        .filter((F.size("cited") == 0) | F.array_contains("cited", F.col("source_index")))
        .groupBy("message_id", "sentence_index", "size", "source_index")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    best = shared.groupBy("message_id", "sentence_index").agg(
        F.max(F.col("k") / F.col("size")).alias("best"), F.array_sort(F.collect_set("source_index")).alias("matched")
    )
    score = F.coalesce("best", F.lit(0.0))
    status = F.when(F.size("terms") == 0, "supported").when(score >= 0.55, "supported").when(score >= 0.25, "weak").otherwise("unsupported")
    return s.join(best, ["message_id", "sentence_index"], "left").select(
        "message_id", "sentence_index", "text", F.round(score, 5).alias("support_score"),
        F.coalesce(F.array_join(F.transform("matched", lambda x: x.cast("string")), ","), F.lit("")).alias("matched"), status.alias("status"),
    )


def _mean(total: Column, n: Column) -> Column:
    """Mean of whole hundred-thousandths, rounded half up without a detour by binary fractions."""
    return F.floor((2 * total + n) / (2 * n)) / 100000


def audit(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts, mean support and verdict of each answer."""
    per = audit_sentences(answers, sources).groupBy("message_id").agg(
        F.count(F.lit(1)).alias("sentence_count"), F.count_if(F.col("status") == "supported").alias("supported_count"),
        F.count_if(F.col("status") == "weak").alias("weak_count"), F.count_if(F.col("status") == "unsupported").alias("unsupported_count"),
        F.sum(F.round(F.col("support_score") * 100000).cast("long")).alias("total"),
    )
    counts = ("sentence_count", "supported_count", "weak_count", "unsupported_count", "total")
    both = grounding(answers, sources).join(per, "message_id", "left").select("message_id", "missing_citation_count", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])
    supported = (F.col("sentence_count") > 0) & (F.col("unsupported_count") == 0) & (F.col("missing_citation_count") == 0)
    quality = (
        F.when(F.col("sentence_count") == 0, "unknown").when(supported, "supported").when(F.col("supported_count") + F.col("weak_count") > 0, "weak").otherwise("unsupported")
    )
    return both.select(
        "message_id", *counts[:4], _mean(F.col("total"), F.greatest("sentence_count", F.lit(1))).alias("support_score"), supported.alias("answer_supported"), quality.alias("quality")
    )


def extractive_answer(queries: DataFrame, sources: DataFrame, most: int = 4, by: str = "query_id") -> DataFrame:
    """An answer quoted from the first ``most`` sources (query_id, position, filename, text): query_id, answer.

    Where queries share sources, both have a column ``by`` instead, and sources are given once.
    """
    from veldspar.functions.text import token_set

    q = queries.select(*dict.fromkeys(["query_id", by]), token_set(F.col("query")).alias("terms"))
    flat = F.translate(F.col("text"), "\n", " ")
    split = {"parts": F.transform(split_sentences(flat), lambda s: F.struct(s.alias("s"), token_set(s).alias("tokens"))), "whole": strip(flat)}
    first = sources.filter(F.col("position") <= most)
    # Shared texts are split once, before queries meet them; others after the join, as texts are smaller than their tokens.
    items = first.join(q, by).withColumns(split) if by == "query_id" else first.withColumns(split).drop("text").join(q, by)
    ranked = F.array_sort(F.transform("parts", lambda x, i: F.struct((-F.size(F.array_intersect("terms", x["tokens"]))).alias("n"), i.alias("i"), x["s"].alias("s"))))
    quoted = F.when(F.size("parts") > 0, F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["s"]), " ")).otherwise(F.col("whole"))
    from veldspar.functions.text import word_cut

    quoted = F.when(F.length(quoted) > 650, F.concat(word_cut(quoted, 650), F.lit("..."))).otherwise(quoted)
    mark = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "))
    per = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(mark, quoted).alias("line"), F.concat(mark, F.col("filename")).alias("name")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    names = F.array_join(F.transform("x", lambda x: x["name"]), ", ")
    answer = F.concat(F.lit("Answer:\n\n"), body, F.lit("\n\nSources: "), names)
    none = F.lit("I do not have enough retrieved file context to answer that confidently.")
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce(answer, none).alias("answer"))


def prompts(queries: DataFrame, sources: DataFrame, system: str, template: str) -> DataFrame:
    """The system prompt of each query with its sources in the template's {context} and the query in {question}."""
    block = F.concat(
        F.lit("<source id='"), F.col("position").cast("string"), F.lit("' file='"), F.col("filename"), F.lit("' chunk_id='"), F.col("chunk_id"), F.lit("' score='"),
        F.col("score").cast("string"), F.lit("'>\n"), F.col("text"), F.lit("\n</source>"),
    )
    context = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("x"))
    joined = queries.join(context, "query_id", "left")
    filled = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.array_join(F.transform("x", lambda x: x["b"]), "\n\n")), F.lit("{question}"), F.col("query"))
    return joined.select("query_id", F.when(F.col("x").isNotNull(), F.concat(F.lit(system + "\n\n"), filled)).otherwise(F.lit(system)).alias("prompt"))
