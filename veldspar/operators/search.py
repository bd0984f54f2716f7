"""Scoring of chunks for many queries at once: keyword, lexical, dense and hybrid."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions.rowwise import token_list
from veldspar.functions.text import keyword_query, token_set

K1, B = 1.2, 0.75
#: Rows of the best that a task keeps for all questions together, and question tokens that go with it.
MOST_KEPT, MOST_TOKENS = 100_000, 2_000_000
_WORD = re.compile(r"[^\W_]+")
WEIGHTS = {"vector": 0.70, "lexical": 0.20, "keyword": 0.35}
THRESHOLD = 0.05


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank from 1; Spark cuts each task's rows before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def index_terms(chunks: DataFrame) -> DataFrame:
    """Postings of ``chunks`` (chunk_id, text): term, chunk_id, tf, length; terms are letters and digits without case."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = chunks.select("chunk_id", F.size(words).alias("length"), F.explode(words).alias("term"))
    return each.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Keyword scores of ``queries`` (query_id, query) over ``chunks``: query_id, chunk_id, score.

    Only chunks that share a term meet a query, through the postings. Document frequency and average
    length are of the whole index; ``scope`` (query_id, file_id) narrows what is scored. A term that most
    chunks hold weighs 1e-6, and a term repeated in the query counts each time.
    """
    postings = index_terms(chunks)
    stats = chunks.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")
    ).first()
    n, average = stats["n"], stats["average"] or 1.0
    asked = queries.select("query_id", F.explode(keyword_query(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("times")
    )
    held = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(held, "term").withColumn("idf", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf))
    part = F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average)))
    scored = postings.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    if scope is not None:
        files = chunks.select("chunk_id", "file_id")
        scored = scored.join(files, "chunk_id").join(scope, ["query_id", "file_id"], "left_semi").drop("file_id")
    return scored


def keyword_ranks(scored: DataFrame, k: int) -> DataFrame:
    """``bm25`` scores of the best ``k`` as 1 - rank / hits, with rank from 0: query_id, chunk_id, keyword_score."""
    hits = Window.partitionBy("query_id")
    # Sums of floats come in any order; rounding keeps equal scores equal.
    best = top_k(scored.withColumn("score", F.round("score", 9)), k)
    return best.select("query_id", "chunk_id", (1.0 - (F.col("rank") - 1) / F.count(F.lit(1)).over(hits)).alias("keyword_score"))


def lexical(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Share of a query's distinct tokens that a chunk holds, for all chunks that hold one: query_id, chunk_id, lexical_score."""
    asked = queries.select("query_id", token_set(F.col("query")).alias("q"))
    asked = asked.select("query_id", F.size("q").alias("size"), F.explode("q").alias("token"))
    held = chunks.select("chunk_id", F.explode(token_set(F.col("text"))).alias("token"))
    return (
        held.join(asked, "token")
        .groupBy("query_id", "chunk_id", "size")
        .agg(F.count(F.lit(1)).alias("shared"))
        .select("query_id", "chunk_id", (F.col("shared") / F.greatest("size", F.lit(1))).alias("lexical_score"))
    )


class Asked:
    """Questions by number as tasks score them: their ids, tokens or terms, and of the scopes the files that each may see."""

    def __init__(self, queries: DataFrame, terms: Column, scope: DataFrame | None = None) -> None:
        rows = queries.select("query_id", terms.alias("terms")).toArrow()
        self.ids, self.terms = rows["query_id"].to_pylist(), [t or [] for t in rows["terms"].to_pylist()]
        self.kind = dict(queries.dtypes)["query_id"]
        self.allowed: dict | None = None
        self.open = np.ones(len(self.ids), bool)
        if scope is not None:
            self.allowed = {}
            place = {q: i for i, q in enumerate(self.ids)}
            for query_id, file_id in zip(*(scope.select("query_id", "file_id").distinct().toArrow()[c].to_pylist() for c in ("query_id", "file_id")), strict=True):
                if query_id in place:
                    self.open[place[query_id]] = False
                    self.allowed.setdefault(file_id, []).append(place[query_id])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.ids)), f"nth int, query_id {self.kind}")

    def visible(self, files: list) -> np.ndarray:
        """Which questions may see each of some files."""
        seen = np.tile(self.open, (len(files), 1))
        for i, f in enumerate(files):
            if f in self.allowed:
                seen[i, self.allowed[f]] = True
        return seen


def small_enough(queries: DataFrame, k: int, scope: DataFrame | None = None) -> bool:
    """Whether questions, their results and their scopes may go to all tasks."""
    n = queries.count()
    tokens = queries.agg(F.sum(F.length("query"))).first()[0] or 0
    return n * k <= MOST_KEPT and tokens <= 8 * MOST_TOKENS and (scope is None or scope.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS)


def best_rows(chunks: DataFrame, asked: Asked, k: int, scores: Callable[[pa.RecordBatch], np.ndarray], number: str, ties: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The ``k`` best of ``chunks`` for each question: nth, value (``number`` type) and the columns of ``chunks``, of each task.

    ``scores`` gives a matrix of a batch's rows by questions, where nothing above 0 is no match. A task keeps its best ``k`` of each question by
    value and then the columns in ``ties``, so no pair is shuffled and nothing is read twice.
    """
    names, kinds, n = chunks.columns, dict(chunks.dtypes), len(asked.ids)
    step = max(1, min(1024, 4_000_000 // max(1, n)))
    columns = ["nth", "value", *names]
    by = [("nth", "ascending"), ("value", "descending"), *((c, "ascending") for c in ties)]
    visible = asked.visible if asked.allowed is not None else None
    arrow = pa.int32() if number == "int" else pa.float64()

    def merged(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).sort_by(by)
        nth = np.asarray(whole["nth"])
        return whole.take(pa.array(np.flatnonzero(np.arange(len(nth)) - np.searchsorted(nth, nth) < k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        floor = np.zeros(n)
        for batch in batches:
            for at in range(0, len(batch) if n else 0, step):
                part = batch.slice(at, step)
                value = scores(part)
                if visible is not None:
                    value = np.where(visible(part.column(names.index("file_id")).to_pylist()), value, 0)
                fits = (value > 0) & (value >= floor)
                if len(part) > k:
                    least = np.partition(np.where(fits, value, -np.inf), len(part) - k, axis=0)[len(part) - k]
                    fits &= value >= least
                row, nth = np.nonzero(fits)
                if not len(row):
                    continue
                rows = part.take(pa.array(row))
                new = pa.Table.from_arrays([pa.array(nth, pa.int32()), pa.array(value[row, nth], arrow), *rows.columns], names=columns)
                best = merged([new] if best is None else [best, new])
                counts = np.bincount(np.asarray(best["nth"]), minlength=n)
                full = counts >= k
                floor[full] = np.asarray(best["value"])[(np.cumsum(counts) - 1)[full]]
        if best is not None:
            yield from best.combine_chunks().to_batches(max_chunksize=5000)

    schema = ", ".join(["nth int", f"value {number}", *(f"`{c}` {kinds[c]}" for c in names)])
    return chunks.mapInArrow(run, schema).join(F.broadcast(asked.frame(chunks.sparkSession)), "nth").drop("nth")  # as many rows as questions


def _spread(rows: list[int], hits: list[np.ndarray], weights: list | None, shape: tuple[int, int]) -> np.ndarray:
    """Sums of ``weights`` (or ones) at each (row, question) of ``hits``."""
    if not hits:
        return np.zeros(shape)
    flat = np.repeat(np.array(rows), [len(h) for h in hits]) * shape[1] + np.concatenate(hits)
    return np.bincount(flat, None if weights is None else np.concatenate(weights), minlength=shape[0] * shape[1]).reshape(shape)


def overlap_scorer(terms: list[list[str]], at: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Numbers of a question's tokens that each text (column ``at``) holds."""
    postings: dict[str, list[int]] = {}
    for i, words in enumerate(terms):
        for word in words:
            postings.setdefault(word, []).append(i)
    lists = {w: np.array(q, np.int64) for w, q in postings.items()}

    def scores(part: pa.RecordBatch) -> np.ndarray:
        rows, hits = [], []
        for i, text in enumerate(part.column(at)):
            for token in lists.keys() & set(token_list(text.as_py())):
                rows.append(i)
                hits.append(lists[token])
        return _spread(rows, hits, None, (len(part), len(terms)))

    return scores


def lexical_top_k(queries: DataFrame, chunks: DataFrame, k: int, least: float = THRESHOLD) -> DataFrame:
    """The ``k`` best chunks of each query by ``lexical``: query_id, score (5 places), rank and the columns of ``chunks``.

    Tasks count overlaps chunk by chunk (``best_rows``). Questions that are too many for that meet chunks in a join on tokens instead.
    """
    if not small_enough(queries, k):
        scored = lexical(queries, chunks.select("chunk_id", "text")).select("query_id", "chunk_id", F.round("lexical_score", 5).alias("score"))
        return top_k(scored.filter(F.col("score") >= least), k).join(chunks, "chunk_id").select("query_id", "score", "rank", *chunks.columns)
    asked = Asked(queries, token_set(F.col("query")))
    found = best_rows(chunks, asked, k, overlap_scorer(asked.terms, chunks.columns.index("text")), "int")
    sizes = queries.select(F.col("query_id").alias("own"), F.size(token_set(F.col("query"))).alias("size"))
    scored = found.join(F.broadcast(sizes), F.col("query_id") == F.col("own")).select("query_id", F.round(F.col("value") / F.col("size"), 5).alias("score"), *chunks.columns)
    return top_k(scored.filter(F.col("score") >= least), k)


def bm25_top_k(queries: DataFrame, chunks: DataFrame, k: int, scope: DataFrame | None = None, places: int = 9) -> DataFrame:
    """The ``k`` best chunks of each query by ``bm25`` (rounded to ``places``): query_id, chunk_id, score.

    A first pass counts in how many chunks the asked terms stand, a second one scores chunks within tasks; ``scope`` narrows what is scored, not
    what is counted. Questions that are too many for that meet chunks through postings.
    """
    if not small_enough(queries, k, scope):
        return top_k(bm25(queries, chunks, scope).withColumn("score", F.round("score", places)), k).drop("rank")
    asked = Asked(queries, keyword_query(F.col("query")), scope)
    wanted = {t for terms in asked.terms for t in terms}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        n = total = 0
        for batch in batches:
            for text in batch.column(0):
                words = _words(text.as_py())
                n, total = n + 1, total + len(words)
                for t in wanted & set(words):
                    held[t] = held.get(t, 0) + 1
        rows = [*held.items(), (None, n), ("", total)]  # the number of chunks and of words go under names that no term has
        yield pa.RecordBatch.from_pydict({"term": pa.array([r[0] for r in rows], pa.string()), "n": pa.array([r[1] for r in rows], pa.int64())})

    found = {r["term"]: r["n"] for r in chunks.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(None, 0), found.pop("", 0)
    return _scored_bm25(asked, chunks, k, found, n, total / max(1, n) or 1.0, places)


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _scored_bm25(asked: Asked, chunks: DataFrame, k: int, held: dict[str, int], n: int, average: float, places: int) -> DataFrame:
    weights: dict[str, dict[int, float]] = {}
    for i, terms in enumerate(asked.terms):
        for t in terms:
            if t in held:
                idf = math.log((n - held[t] + 0.5) / (held[t] + 0.5))
                own = weights.setdefault(t, {})
                own[i] = own.get(i, 0.0) + (idf if idf > 0 else 1e-6)
    lists = {t: (np.array(list(w), np.int64), np.array(list(w.values()))) for t, w in weights.items()}
    columns = ["chunk_id", "file_id", "text"] if asked.allowed is not None else ["chunk_id", "text"]
    at, shape = len(columns) - 1, len(asked.ids)

    def scores(part: pa.RecordBatch) -> np.ndarray:
        rows, hits, values = [], [], []
        for i, text in enumerate(part.column(at)):
            words = _words(text.as_py())
            for t in lists.keys() & set(words):
                tf = words.count(t)
                rows.append(i)
                hits.append(lists[t][0])
                values.append(lists[t][1] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))))
        return np.round(_spread(rows, hits, values, (len(part), shape)), places)

    found = best_rows(chunks.select(*columns), asked, k, scores, "double").withColumnRenamed("value", "score")
    return top_k(found, k).select("query_id", "chunk_id", "score")


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2000, least: float | None = None) -> DataFrame:
    """Exact cosine top-k of ``queries`` (query_id, vector) over ``vectors`` (chunk_id, vector).

    Queries are a stated set. They are dealt to blocks of about ``block``, and each row of ``vectors`` goes to every block once,
    with its task: a task compares its vectors with the queries of a block, which it reads as one broadcast row, and keeps its best ``k``
    of each before anything is shuffled. Returns query_id, chunk_id, cosine.
    """
    rows = queries.select("query_id", "vector")
    parts = max(1, -(-rows.count() // block))
    table = rows.toArrow() if parts == 1 else None
    if table is not None:
        found = vectors.select("chunk_id", "vector").mapInArrow(_best(table["query_id"].to_pylist(), table["vector"].to_pylist(), k, least), "query_id long, chunk_id string, cosine double")
    else:
        found = _blocks_of(rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), vectors, parts, k, least)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


#: Vectors that one task compares with one block of queries.
VECTORS = 20_000


def _blocks_of(queries: DataFrame, vectors: DataFrame, parts: int, k: int, least: float | None) -> DataFrame:
    """Blocks of queries against blocks of vectors, cogrouped: no side is held whole anywhere."""
    turns = max(1, -(-vectors.count() // VECTORS))
    left = queries.select("block", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "query_id", "vector")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(turns)).cast("int").alias("turn"), F.col("chunk_id").cast("string").alias("chunk_id"), "vector")

    def run(asked, held):
        import pandas as pd

        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "cosine": []}).astype({"query_id": "int64", "chunk_id": "str", "cosine": "float64"})
        batch = pa.RecordBatch.from_arrays([pa.array(held["chunk_id"], pa.string()), pa.array([list(v) for v in held["vector"]])], names=["chunk_id", "vector"])
        return pa.Table.from_batches(_best(asked["query_id"].tolist(), asked["vector"].tolist(), k, least)(iter([batch]))).to_pandas()

    return left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(run, "query_id long, chunk_id string, cosine double")


def _best(ids: list[int], asked: list, k: int, least: float | None):
    names = ["query_id", "chunk_id", "cosine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array([list(v) for v in asked], np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(q, axis=1)
        for batch in batches:
            if not len(batch) or not ids:
                continue
            v = np.array(batch.column(1).to_pylist(), np.float64)
            n = np.linalg.norm(v, axis=1)
            keys = np.array(batch.column(0).cast(pa.string()).to_pylist())
            place = np.argsort(np.argsort(keys, kind="stable"))
            for at in range(0, len(ids), 500):
                scores = (q[at : at + 500] @ v.T) / np.where(norm > 0, norm, 1)[at : at + 500, None] / np.where(n > 0, n, 1)[None, :]
                order = np.lexsort((np.broadcast_to(place, scores.shape), -scores), axis=1)[:, :k]
                top = np.take_along_axis(scores, order, 1)
                row, column = np.nonzero(top >= (-np.inf if least is None else least))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ids)[at + row], pa.int64()), pa.array(keys[order[row, column]], pa.string()), pa.array(top[row, column], pa.float64())], names=names
                )

    return run


def oversampled(k: int) -> int:
    """Keyword hits that are fetched and counted for ``k`` results."""
    return max(3 * k, 10)


def explained(limit: int, k: int) -> int:
    """Candidates of each planned query that an explanation of ``limit`` rows is made of."""
    return max(limit, 3 * k, k)


def hybrid_top_k(
    queries: DataFrame, asked_vectors: DataFrame, chunks: DataFrame, keyword: DataFrame | None, k: int, threshold: float = THRESHOLD, scope: DataFrame | None = None
) -> DataFrame:
    """The ``k`` best chunks of each query by ``hybrid`` in one pass over ``chunks``: query_id, chunk_id, score.

    ``queries`` (query_id, query), ``asked_vectors`` (query_id, vector), ``chunks`` (chunk_id, file_id, filename, chunk_index, text, vector), ``keyword``
    (query_id, chunk_id, keyword_score) or None. Every chunk is scored for every question that may see it, exactly, where it is read; ties go by name and
    place. For questions that ``small_enough`` admits.
    """
    asked = Asked(queries, token_set(F.col("query")), scope)
    n = len(asked.ids)
    told = asked_vectors.toArrow()
    by_id = dict(zip(told["query_id"].to_pylist(), told["vector"].to_pylist(), strict=True))
    q = np.array([by_id[i] for i in asked.ids], np.float64).reshape(n, -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    held: dict[str, list[tuple[int, float]]] = {}
    if keyword is not None:
        place = {i: at for at, i in enumerate(asked.ids)}
        rows = keyword.select("query_id", "chunk_id", "keyword_score").toArrow()
        for query_id, chunk_id, score in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            held.setdefault(chunk_id, []).append((place[query_id], score))
    overlaps = overlap_scorer(asked.terms, 4)
    sizes = np.array([max(1, len(t)) for t in asked.terms])
    weights = WEIGHTS

    def scores(part: pa.RecordBatch) -> np.ndarray:
        v = np.array(part.column(5).to_pylist(), np.float64).reshape(len(part), -1)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        total = weights["vector"] * ((v / np.where(norm > 0, norm, 1.0)) @ q.T) + weights["lexical"] * overlaps(part) / sizes
        for i, chunk_id in enumerate(part.column(0).to_pylist()):
            for at, score in held.get(chunk_id, ()):
                total[i, at] += weights["keyword"] * score
        return np.where(total >= threshold, np.round(total, 5), 0.0)

    columns = ["chunk_id", "file_id", "filename", "chunk_index", "text", "vector"]
    found = best_rows(chunks.select(*columns), asked, k, scores, "double", ("filename", "chunk_index", "chunk_id")).withColumnRenamed("value", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "filename", "chunk_index", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score")


def hybrid(semantic: DataFrame, lexical_scores: DataFrame, keyword_scores: DataFrame, mode: str = "hybrid", threshold: float = THRESHOLD) -> DataFrame:
    """Blend of scores, each (query_id, chunk_id, its score), where a missing one is 0: query_id, chunk_id, score."""
    if mode not in {"hybrid", "vector", "keyword"}:
        raise ValueError(f"unknown mode: {mode}")
    keys = ["query_id", "chunk_id"]
    if mode == "keyword":
        return keyword_scores.select(*keys, F.round("keyword_score", 5).alias("score")).filter(F.col("keyword_score") >= threshold)
    both = semantic.join(lexical_scores, keys, "full_outer")
    if mode == "hybrid":
        both = both.join(keyword_scores, keys, "full_outer")
    else:
        both = both.withColumn("keyword_score", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = WEIGHTS["vector"] * zero("cosine") + WEIGHTS["lexical"] * zero("lexical_score") + WEIGHTS["keyword"] * zero("keyword_score")
    return both.select(*keys, score.alias("raw")).filter(F.col("raw") >= threshold).select(*keys, F.round("raw", 5).alias("score"))


def fuse(candidates: DataFrame) -> DataFrame:
    """Candidates of several planned queries as one row per chunk.

    ``candidates`` has query_id, chunk_id, ord (order of appearance), score, query_hits. The best score
    stays, the first among equals, with 0.04 for each hit beyond the first, 0.2 at most.
    """
    fused = candidates.groupBy("query_id", "chunk_id").agg(
        F.sum(F.greatest("query_hits", F.lit(1))).alias("query_hits"), F.max("score").alias("best"), F.min("ord").alias("ord")
    )
    boost = F.least(F.lit(0.2), 0.04 * (F.col("query_hits") - 1))
    return fused.select("query_id", "chunk_id", "ord", F.round(F.col("best") + boost, 5).alias("score"), "query_hits")


def rerank(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id, ord, score, text) with 0.15 of the lexical share added, ranked; ties keep their order."""
    q = queries.select("query_id", token_set(F.col("query")).alias("q_tokens"))
    share = F.size(F.array_intersect("q_tokens", token_set(F.col("text")))) / F.greatest(F.size("q_tokens"), F.lit(1))
    scored = candidates.join(q, "query_id").withColumn("score", F.col("score") + 0.15 * share).drop("q_tokens")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(order))


def explain(queries: DataFrame, candidates: DataFrame, selected: DataFrame, limit: int) -> DataFrame:
    """Why candidates rank as they do: rank, whether selected, matched terms, reasons.

    Reasons are the score, the number of planned queries that found it if several did, how many terms match if any do, and whether it was selected.
    """
    from veldspar.functions.text import meaningful_terms

    terms = queries.select("query_id", meaningful_terms(F.col("query")).alias("q_terms"))
    best = top_k(candidates, limit, tie="ord").join(terms, "query_id")
    best = best.join(selected.select("query_id", "chunk_id", F.lit(True).alias("chosen")), ["query_id", "chunk_id"], "left")
    matched = F.array_sort(F.array_intersect("q_terms", meaningful_terms(F.col("text"))))
    best = best.withColumn("matched_terms", matched).withColumn("selected", F.coalesce("chosen", F.lit(False)))
    told = lambda label, c: F.concat(F.lit(label + "="), c.cast("string"))
    reasons = F.array_compact(
        F.array(
            told("score", F.col("score")),
            F.when(F.col("query_hits") > 1, told("query_hits", F.col("query_hits"))),
            F.when(F.size("matched_terms") > 0, told("matched_terms", F.size("matched_terms"))),
            F.when(F.col("selected"), "selected_for_context").otherwise("not_selected"),
        )
    )
    return best.select("query_id", "chunk_id", "rank", "score", "selected", "matched_terms", reasons.alias("reasons"))
