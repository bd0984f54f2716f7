"""Files: search, narrowing and routing by name and summary, scopes, keyed tables, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.text import compact, filename_text, meaningful_terms, stem


def resolve_scope(explicit: DataFrame, chosen: DataFrame, members: DataFrame, strict: bool = False) -> DataFrame:
    """Files of each query's scope: those named and the members of knowledge bases named.

    ``explicit`` (query_id, pos, file_id), ``chosen`` (query_id, knowledge_id), ``members`` (knowledge_id, pos, file_id).
    A query with no row means all files, also where it named an empty base; ``strict`` adds a row with a null
    file for such a query. Returns query_id, ord, file_id without repeats, in order of first appearance.
    """
    listed = explicit.select("query_id", F.lit(0).alias("part"), "pos", "file_id").unionByName(
        chosen.join(members, "knowledge_id").select("query_id", F.lit(1).alias("part"), "pos", "file_id")
    )
    first = listed.groupBy("query_id", "file_id").agg(F.min(F.struct("part", "pos")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "file_id")
    found = first.select("query_id", F.row_number().over(order).alias("ord"), "file_id")
    if strict:
        empty = chosen.select("query_id").distinct().join(found, "query_id", "left_anti")
        found = found.unionByName(empty.select("query_id", F.lit(1).alias("ord"), F.lit(None).cast(found.schema["file_id"].dataType).alias("file_id")))
    return found


def _runs(text: Column) -> Column:
    """All runs of letters and digits within the words of a query, whole words and parts of them."""

    def inside(word: Column) -> Column:
        ends = lambda i: F.transform(F.sequence(i, F.length(word)), lambda j: F.substring(word, i, j - i + 1))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), ends))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), inside)))


def search_files(queries: DataFrame, files: DataFrame) -> DataFrame:
    """Files that match each query, scored by name, keywords and summary.

    ``queries`` (query_id, query) should be few beside ``files`` (file_id, filename, keywords, summary, created_at). Files that share
    a term come from a join on terms; those whose name stands in the query from its words. Returns query_id, rank,
    file_id, score, matched_terms, reasons.
    """
    q = queries.select("query_id", F.lower(compact(F.col("query"))).alias("text"), meaningful_terms(F.col("query")).alias("terms"))
    name_words = F.translate(stem(F.col("filename")), "-_", "  ")
    f = files.select(
        "file_id", "created_at", meaningful_terms(name_words).alias("by_name"), F.array_distinct("keywords").alias("by_keyword"),
        meaningful_terms(F.col("summary")).alias("by_summary"), filename_text(F.col("filename")).alias("name"), filename_text(stem(F.col("filename"))).alias("stem"),
    )
    asked = q.select("query_id", F.explode("terms").alias("term"))
    each = lambda c: f.select("file_id", F.explode(c).alias("term"), F.lit(c).alias("part"))
    shared = asked.join(each("by_name").unionByName(each("by_keyword")).unionByName(each("by_summary")), "term")
    by = shared.groupBy("query_id", "file_id").agg(
        F.count_if(F.col("part") == "by_name").alias("n_name"), F.count_if(F.col("part") == "by_keyword").alias("n_keyword"),
        F.count_if(F.col("part") == "by_summary").alias("n_summary"), F.array_sort(F.collect_set("term")).alias("matched"),
    )
    # A name that stands in the query begins with its first word, which is some run of letters and digits within a
    # query's word. Those runs are the key on which queries and names meet, rather than each with each.
    first_words = F.array_distinct(F.array(F.regexp_extract("name", "[a-z0-9]+", 0), F.regexp_extract("stem", "[a-z0-9]+", 0)))
    opening = f.select("file_id", "name", "stem", F.explode(first_words).alias("w"))
    inside = F.when((F.col("name") != "") & F.contains("text", "name"), 3.0).when((F.col("stem") != "") & F.contains("text", "stem"), 2.0).otherwise(0.0)

    named = q.select("query_id", "text", F.explode(_runs(F.col("text"))).alias("w")).join(opening, "w").withColumn("exact", inside).filter("exact > 0").groupBy("query_id", "file_id").agg(F.max("exact").alias("exact"))
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    both = by.join(named, ["query_id", "file_id"], "full_outer").join(f.select("file_id", "created_at"), "file_id")
    score = zero("exact", 0.0) + 1.5 * zero("n_name", 0) + 1.25 * zero("n_keyword", 0) + 0.75 * zero("n_summary", 0)
    count = lambda c, label: F.when(zero(c, 0) > 0, F.concat(F.lit(label + "="), F.col(c).cast("string")))
    reasons = F.array_compact(
        F.array(
            F.when(zero("exact", 0.0) == 3.0, F.lit("filename_exact")).when(zero("exact", 0.0) == 2.0, F.lit("filename_stem")),
            count("n_name", "filename_terms"), count("n_keyword", "keywords"), count("n_summary", "summary_terms"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), "file_id")
    return both.withColumn("score", F.round(score, 5)).select(
        "query_id", F.row_number().over(order).alias("rank"), "file_id", "score", F.coalesce(F.array_join("matched", " "), F.lit("")).alias("matched_terms"), F.array_join(reasons, ",").alias("reasons")
    )


def narrow_by_filename(queries: DataFrame, files: DataFrame) -> DataFrame:
    """Files that a query names, where it names some and not all: query_id, file_id.

    A file is named by its full name, by its stem, or by all words of its stem of three letters or more, two at least. However a file is
    named, the first letters and digits of its name or of its stem's words stand within a word of the query: those are the key on which
    files and queries (query_id, query) meet.
    """
    split = lambda c: F.split(compact(F.translate(c, ".-_", "   ")), " ")
    q = queries.select("query_id", filename_text(F.col("query")).alias("asked"))
    q = q.filter(F.col("asked") != "").withColumn("words", split(F.col("asked")))
    f = files.select("file_id", filename_text(F.col("filename")).alias("name"), filename_text(stem(F.col("filename"))).alias("stem"))
    f = f.withColumn("stem_words", F.filter(split(F.col("stem")), lambda w: F.length(w) >= 3))
    n = files.count()
    hit = (
        F.contains("asked", "name")
        | ((F.col("stem") != "") & F.contains("asked", "stem"))
        | ((F.size("stem_words") >= 2) & (F.size(F.array_except("stem_words", "words")) == 0))
    ) & (F.col("name") != "")
    first = lambda c: F.regexp_extract(c, "[a-z0-9]+", 0)
    keys = F.array_distinct(F.array(first(F.col("name")), first(F.col("stem")), first(F.coalesce(F.get("stem_words", F.lit(0)), F.col("name")))))
    # A name without any of them has the empty key, as has every query.
    asked = q.withColumn("key", F.explode(F.array_append(_runs(F.col("asked")), F.lit(""))))
    named = f.withColumn("key", F.explode(keys)).join(asked, "key").filter(hit).select("query_id", "file_id").distinct()
    whole = Window.partitionBy("query_id")
    return named.withColumn("matches", F.count(F.lit(1)).over(whole)).filter(F.col("matches") < n).select("query_id", "file_id")


def route_files(found: DataFrame, candidates: DataFrame, limit: int = 5) -> DataFrame:
    """The best ``limit`` files of a search among each query's candidates, or all of them if none matches.

    ``found`` is of ``search_files``, ``candidates`` has query_id, file_id. A query without candidates isn't routed.
    """
    inside = found.join(candidates, ["query_id", "file_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    best = inside.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(1, limit)).select("query_id", "file_id")
    rest = candidates.join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "file_id")
    return best.withColumn("routed", F.lit(True)).unionByName(rest.withColumn("routed", F.lit(False)))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both by ``key``, the one of the highest ``version`` where several share it."""
    columns = [c for c in table.columns if c != key]
    both = table.unionByName(changes)
    newest = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(version)).alias("row"))
    return newest.select(key, "row.*")


def replace_group(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with all rows of the keys in ``rows`` replaced by those of ``rows``."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows)


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "file_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys in ``gone``."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def reindex_scope(files: DataFrame, members: DataFrame, chosen: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """Files to read and index anew: those of ``chosen`` (file_id) and of the knowledge bases in ``bases`` (knowledge_id), or all if neither names any."""
    named = None
    if chosen is not None:
        named = chosen.select("file_id")
    if bases is not None:
        own = members.join(bases.select("knowledge_id").distinct(), "knowledge_id", "left_semi").select("file_id")
        named = own if named is None else named.unionByName(own)
    if named is None or named.isEmpty():
        return files
    return files.join(named.distinct(), "file_id", "left_semi")


def slice_text(docs: DataFrame, start: int, end: int) -> DataFrame:
    """Characters ``start`` to ``end`` (exclusive) of each text, clamped: doc_id, text, start, end."""
    if start < 0 or end < start:
        raise ValueError("end must not be before start")
    n = F.length("text")
    a, b = F.least(F.lit(start), n), F.least(F.lit(end), n)
    return docs.select("doc_id", F.substring(F.col("text"), a + 1, b - a).alias("text"), a.alias("start"), b.alias("end"))


def storage_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and characters of each table's text column, if it has one: name, rows, chars."""
    out = None
    for name, t in tables.items():
        chars = F.sum(F.length("text")) if "text" in t.columns else F.lit(0)
        row = t.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(chars, F.lit(0)).cast("long").alias("chars")).select(F.lit(name).alias("name"), "rows", "chars")
        out = row if out is None else out.unionByName(row)
    return out
