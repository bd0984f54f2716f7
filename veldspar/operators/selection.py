"""Choosing what goes into a context: budgets, caps per file, diversity, windows, whole files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import strip, word_cut

#: Candidates of one query that diversity orders in a task, at most; retrieval keeps far fewer.
MOST_CANDIDATES = 2000


def select_within_budget(ranked: DataFrame, top_k: int, budget: int, per_file: int | None = None) -> DataFrame:
    """Take candidates in order of rank until ``top_k`` or ``budget`` characters are reached.

    ``ranked`` has query_id, rank, chunk_id, file_id, score, text, a bounded number for each query. The last text
    is cut back to a word, so what remains may still hold a later one; a file past its cap is
    skipped. Returns query_id, position (from 1), chunk_id, file_id, score, text.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "file_id", F.round("score", 5).alias("score"), "text")))
    first = F.expr("named_struct('used', 0, 'done', false, 'out', cast(array() as array<struct<chunk_id:string,file_id:bigint,score:double,text:string>>))")

    def step(s: Column, x: Column) -> Column:
        left = F.lit(budget) - s["used"]
        whole = strip(x["text"])
        text = F.when(F.length(whole) > left, strip(word_cut(whole, left))).otherwise(whole)
        capped = F.lit(False) if per_file is None else F.size(F.filter(s["out"], lambda o: o["file_id"] == x["file_id"])) >= per_file
        skip = F.exists(s["out"], lambda o: o["chunk_id"] == x["chunk_id"]) | capped
        done = s["done"] | (~skip & ((left <= 0) | (F.size(s["out"]) >= top_k)))
        take = ~skip & ~done & (text != "")
        item = F.struct(x["chunk_id"].alias("chunk_id"), x["file_id"].alias("file_id"), x["score"].alias("score"), text.alias("text"))
        return F.struct(
            F.when(take, s["used"] + F.length(text)).otherwise(s["used"]).alias("used"),
            done.alias("done"),
            F.when(take, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out"),
        )

    chosen = ranked.groupBy("query_id").agg(F.aggregate(rows, first, step, lambda s: s["out"]).alias("chosen"))
    each = chosen.select("query_id", F.posexplode("chosen").alias("position", "c"))
    return each.select("query_id", (F.col("position") + 1).alias("position"), "c.chunk_id", "c.file_id", "c.score", "c.text")


def diversify(ranked: DataFrame, balance: float = 0.7) -> DataFrame:
    """Reorder each query's candidates by maximal marginal relevance: adds mmr_rank.

    The next one is best by balance * score - (1 - balance) * its largest Jaccard similarity to
    those before it, less 0.15 if its file is among them; the earlier wins ties. Similarities to
    the last pick alone update running maxima, so n candidates need n squared comparisons, not their cube.
    A query with more than ``MOST_CANDIDATES`` is an error.
    """
    from veldspar.functions.text import token_set

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if len(rows) > MOST_CANDIDATES:
            raise ValueError(f"more than {MOST_CANDIDATES} candidates of a query")
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        sets = [set(t) for t in rows["tokens"]]
        score, files = rows["score"].to_numpy(float), rows["file_id"].to_numpy()
        redundant, penalty = np.zeros(len(rows)), np.zeros(len(rows))
        free, picked = np.ones(len(rows), bool), []
        for turn in range(len(rows)):
            value = np.where(free, balance * score - (1 - balance) * redundant - penalty if turn else -rows.index.to_numpy(), -np.inf)
            best = int(np.argmax(value))
            picked.append(best)
            free[best] = False
            for i in np.flatnonzero(free):
                both = len(sets[i] | sets[best])
                if sets[i] and sets[best]:
                    redundant[i] = max(redundant[i], len(sets[i] & sets[best]) / both)
            penalty[files == files[best]] = 0.15
        out = rows.loc[picked, ["query_id", "chunk_id"]].copy()
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    tokens = ranked.select("query_id", "chunk_id", "rank", "score", "file_id", token_set(F.col("text")).alias("tokens"))
    schema = f"query_id {dict(ranked.dtypes)['query_id']}, chunk_id string, mmr_rank int"
    return tokens.groupBy("query_id").applyInPandas(order, schema)


def expand_windows(selected: DataFrame, chunks: DataFrame, width: int, budget: int) -> DataFrame:
    """Selected chunks with the neighbours of each, under the budget again.

    ``selected`` has query_id, position, file_id, chunk_index. Each place of a window is one row of an equi-join with
    ``chunks`` (file_id, chunk_index, text, start_char, end_char). Overlapping windows repeat their chunks. Returns
    query_id, position, text and the ranges of places and characters.
    """
    last = chunks.groupBy("file_id").agg(F.max("chunk_index").alias("last"))
    places = selected.join(last, "file_id").select(
        "query_id", "position", "file_id",
        F.explode(F.sequence(F.greatest(F.col("chunk_index") - width, F.lit(0)), F.least(F.col("chunk_index") + width, F.col("last")))).alias("chunk_index"),
    )
    parts = places.join(chunks.select("file_id", "chunk_index", "text", "start_char", "end_char"), ["file_id", "chunk_index"])
    joined = parts.groupBy("query_id", "position").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"),
        F.min("chunk_index").alias("context_start_index"), F.max("chunk_index").alias("context_end_index"),
        F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"),
    )
    label = lambda p: F.concat(F.lit("[chunk "), p["chunk_index"].cast("string"), F.lit("]\n"), strip(p["text"]))
    text = strip(F.array_join(F.transform("parts", label), "\n\n"))
    ranges = ("context_start_index", "context_end_index", "start_char", "end_char")
    rows = F.array_sort(F.collect_list(F.struct("position", text.alias("text"), *ranges)))
    first = F.expr("named_struct('used', 0, 'out', cast(array() as array<struct<position:int,text:string,context_start_index:int,context_end_index:int,start_char:int,end_char:int>>))")

    def step(s: Column, x: Column) -> Column:
        left = F.lit(budget) - s["used"]
        cut = F.when(F.length(x["text"]) > left, strip(word_cut(x["text"], F.greatest(left, F.lit(0))))).otherwise(x["text"])
        take = (left > 0) & (cut != "")
        item = F.struct(x["position"].alias("position"), cut.alias("text"), *[x[r].alias(r) for r in ranges])
        return F.struct(
            F.when(take, s["used"] + F.length(cut)).otherwise(s["used"]).alias("used"), F.when(take, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out")
        )

    chosen = joined.groupBy("query_id").agg(F.aggregate(rows, first, step, lambda s: s["out"]).alias("chosen"))
    return chosen.select("query_id", F.explode("chosen").alias("c")).select("query_id", "c.*")


def full_context(chunks: DataFrame, budget: int = 24000, scope: str = "scope_id") -> DataFrame:
    """Whole files in order of name, cut hard where the budget of their scope ends.

    ``chunks`` has the scope column, file_id, filename, chunk_index, text. A file that starts within the budget is
    kept; running sums of lengths say where it is cut. A file takes one character at least, so of each scope only as many files as the budget has
    characters are summed, whatever its size, and only the texts of those that are kept are put together. Returns scope, file_id, text.
    """
    held = chunks.select(scope, "file_id", "filename", "chunk_index", strip(F.col("text")).alias("text")).filter("text <> ''")
    sized = held.groupBy(scope, "file_id", "filename").agg((F.sum(F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("n"))
    order = Window.partitionBy(scope).orderBy("filename", "file_id")
    first = sized.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= budget)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("before", before).filter(F.col("before") < budget).select(F.col(scope).alias("own_scope"), F.col("file_id").alias("own_file"), F.col("filename").alias("own_name"), "before")
    own = F.col(scope).eqNullSafe(F.col("own_scope")) & (F.col("file_id") == F.col("own_file")) & F.col("filename").eqNullSafe(F.col("own_name"))
    parts = held.join(kept, own).groupBy(scope, "file_id", "filename", "before").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return parts.select(scope, "file_id", F.left(text, (F.lit(budget) - F.col("before")).cast("int")).alias("text"))


def context_mode(chunks: DataFrame, budget: int = 24000, scope: str = "scope_id") -> DataFrame:
    """``full`` where all chunks of a scope fit the budget, else ``rag``: scope, chars, mode."""
    total = chunks.groupBy(scope).agg(F.sum(F.length("text")).alias("chars"))
    return total.select(scope, "chars", F.when((F.col("chars") > 0) & (F.col("chars") <= budget), "full").otherwise("rag").alias("mode"))
