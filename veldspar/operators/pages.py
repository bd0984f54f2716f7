"""Extracted documents: page decisions, block routing, rollups and rendering."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def decide_pages(
    pages: DataFrame, force: bool = False, min_chars: int = 50, min_ink: float = 0.005, flood: int = 30, made: str | None = None
) -> DataFrame:
    """How each page is read: rendered whole for recognition, its text kept, both, or left blank.

    ``pages`` has doc_id, page_index, chars (of native text), trusted, images, ink (share of dark pixels). A document whose first page is
    untrusted or flooded with images is rendered throughout. Adds action (render, text, hybrid, blank) and reason;
    where several hold, untrusted text comes before a flood, that before missing text, that before little text. ``made`` names a column with the
    number of blocks that reading the text gave, if that is known: a page that gave none is rendered if it has any ink, and else is blank.
    """
    sick = ~F.col("trusted") | (F.col("images") > flood)
    first = F.max(F.when(F.col("page_index") == 0, sick).otherwise(False)).over(Window.partitionBy("doc_id"))
    ink = F.col("ink") >= min_ink
    short = F.col("chars") < min_chars
    reason = (
        F.when(F.lit(force), "forced")
        .when(~F.col("trusted"), "untrusted_text")
        .when(F.col("images") > flood, "image_flood")
        .when(first, "first_page")
        .when((F.col("chars") == 0) & ink, "no_text")
        .when(short & ink, "low_text")
    )
    action = F.when(reason.isNotNull(), "render").when((F.col("chars") == 0) & (F.col("images") == 0), "blank").when(F.col("images") > 0, "hybrid").otherwise("text")
    if made is not None:
        nothing = reason.isNull() & (F.col(made) == 0)
        action = F.when(nothing & ink, "render").when(nothing, "blank").otherwise(action)
        reason = F.when(nothing & ink, "safety_net_force_render").otherwise(reason)
    return pages.withColumn("action", action).withColumn("reason", reason)


@F.pandas_udf(DoubleType())
def _density(pixels: pd.Series, white: pd.Series) -> pd.Series:
    return pd.Series([float((np.frombuffer(p, np.uint8) < w).mean()) if p else 0.0 for p, w in zip(pixels, white, strict=True)])


def visual_density(pixels: Column, white: int = 250) -> Column:
    """Share of the pixels of a grey image (a byte each) that are darker than ``white``; 0 for none."""
    return _density(pixels, F.lit(white))


def reading_order(blocks: DataFrame, by: str = "page_index") -> DataFrame:
    """Blocks (doc_id, page_index, y, block_pos and any others) with their place on the page from the top; those of one height stay in order."""
    order = Window.partitionBy("doc_id", by).orderBy("y", "block_pos")
    return blocks.withColumn("place", F.row_number().over(order))


def settle_blocks(blocks: DataFrame, fallback: str) -> DataFrame:
    """What becomes of image blocks whose backend has answered or refused: adds final_text, final_backend, error.

    ``blocks`` has backend, probe_text (null without a probe), text, status (null if it answered, else what it failed with, 0 without any
    answer). A refusal for good of a block that was probed leaves the probe; any other failure a comment.
    """
    refused = F.col("status").between(400, 499) & F.col("probe_text").isNotNull() & (F.col("backend") != fallback)
    failed = F.col("status").isNotNull() & ~refused
    what = F.concat(F.lit("status "), F.col("status").cast("string"))
    return (
        blocks.withColumn("final_text", F.when(failed, F.concat(F.lit("<!-- OCR failed: "), what, F.lit(" -->"))).otherwise(F.trim(F.when(refused, F.col("probe_text")).otherwise(F.col("text")))))
        .withColumn("final_backend", F.when(failed, F.lit(None)).when(refused, F.lit(fallback)).otherwise(F.col("backend")))
        .withColumn("error", F.when(failed, what))
    )


def histograms(blocks: DataFrame, default: str = "Latin") -> DataFrame:
    """Blocks of each document by script and by what read them: doc_id, scripts, buckets (maps), dominant_script.

    ``blocks`` has page_index, block_pos, source (ocr or native), script, backend. The script of most blocks is dominant, the one met first among
    equals; native text has a bucket of its own.
    """
    placed = blocks.withColumn("script", F.coalesce("script", F.lit(default))).withColumn("bucket", F.when(F.col("source") == "ocr", F.coalesce("backend", F.lit("default"))).otherwise("native_text"))

    def counted(column: str) -> DataFrame:
        n = placed.groupBy("doc_id", column).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_index", "block_pos")).alias("first"))
        return n.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", F.col(column).alias("name")))).alias(f"{column}s"))

    as_map = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["name"], -x["n"])))
    both = counted("script").join(counted("bucket"), "doc_id")
    return both.select("doc_id", as_map("scripts").alias("scripts"), as_map("buckets").alias("buckets"), F.get("scripts", F.lit(0))["name"].alias("dominant_script"))


def counters(blocks: DataFrame, timings: DataFrame) -> DataFrame:
    """Pages, blocks and seconds of each document, as its sidecar tells them: ``timings`` has doc_id, stage, seconds."""
    n = blocks.groupBy("doc_id").agg(F.count_distinct("page_index").alias("pages"), F.count_if(F.col("source") == "ocr").alias("ocr_blocks"))
    spent = timings.groupBy("doc_id").agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.max_by("stage", F.struct("seconds", "stage")).alias("slowest"))
    return n.join(spent, "doc_id", "left")


def route_blocks(blocks: DataFrame, backends: Mapping[str, str], fallback: str, mode: str = "surrounding_text", min_tokens: int = 8) -> DataFrame:
    """The recognition backend of each image block, by the script around it or by a probe.

    ``blocks`` has surrounding_script, probe_script, probe_chars. A probe long enough is taken as the
    result. Adds script, backend and reuse_probe.
    """
    if mode not in {"surrounding_text", "probe_ocr", "both"}:
        raise ValueError(f"unknown mode: {mode}")
    script = {"surrounding_text": F.col("surrounding_script"), "probe_ocr": F.col("probe_script"), "both": F.coalesce("surrounding_script", "probe_script")}[mode]
    backend: Column = F.lit(fallback)
    for name, alias in sorted(backends.items()):
        backend = F.when(F.col("script") == name, F.lit(alias)).otherwise(backend)
    probed = F.lit(False) if mode == "surrounding_text" else (F.col("probe_chars") > 0) & (F.col("probe_chars") < 3 * min_tokens)
    return blocks.withColumn("script", script).withColumn("backend", F.coalesce(backend, F.lit(fallback))).withColumn("reuse_probe", F.coalesce(probed, F.lit(False)))


def is_small(width: Column, height: Column, least: int = 32) -> Column:
    return (width < least) | (height < least)


def fit_image(width: Column, height: Column, side: int = 1540, pixels: int = 1_500_000) -> Column:
    """Width and height scaled down to a longest side and then to an area, floored."""
    s1 = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(width, height))
    w1, h1 = F.floor(width * s1), F.floor(height * s1)
    s2 = F.least(F.lit(1.0), F.sqrt(F.lit(float(pixels)) / F.greatest(w1 * h1, F.lit(1))))
    return F.struct(F.greatest(F.floor(w1 * s2), F.lit(1)).alias("width"), F.greatest(F.floor(h1 * s2), F.lit(1)).alias("height"))


def rollup_blocks(blocks: DataFrame) -> DataFrame:
    """Counts of each document's blocks: native and recognised ones, pages, the main script of the recognised."""
    scripts = blocks.filter("source = 'ocr' and script is not null").groupBy("doc_id", "script").agg(F.count(F.lit(1)).alias("n"))
    main = scripts.groupBy("doc_id").agg(F.max_by("script", F.struct("n", "script")).alias("main_script"))
    counts = blocks.groupBy("doc_id").agg(
        F.count_if(F.col("source") == "ocr").alias("ocr_blocks"), F.count_if(F.col("source") == "native").alias("text_blocks"), F.count_distinct("page_index").alias("pages")
    )
    return counts.join(main, "doc_id", "left").select("doc_id", "ocr_blocks", "text_blocks", "pages", "main_script")


def render_markdown(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """Each document as Markdown: its title, a heading for each labelled page, block texts; parted by blank lines.

    ``blocks`` (doc_id, page_index, page_label, block_pos, text), ``titles`` (doc_id, title).
    """
    first = F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("block_pos")) == 1
    labelled = first & (F.coalesce("page_label", F.lit("")) != "")
    body = F.concat_ws("\n\n", F.when(labelled, F.concat(F.lit("### "), F.col("page_label"))), F.when(F.coalesce("text", F.lit("")) != "", F.col("text")))
    each = blocks.withColumn("body", body).filter("body <> ''")
    joined = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "block_pos", "body"))).alias("x"))
    head = F.concat(F.lit("# "), F.col("title"))
    return titles.join(joined, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", head, F.array_join(F.transform("x", lambda b: b["body"]), "\n\n")).alias("markdown"))


def sidecar(blocks: DataFrame) -> DataFrame:
    """What is known of each document's blocks, as JSON: type, source, character count and script in order."""
    item = F.struct("page_index", "block_pos", F.col("type"), F.col("source"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"), "script")
    return blocks.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("blocks"))


def cached_or_new(documents: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, content) whose result is in ``cache`` (key, markdown), and those to extract, one per content."""
    from veldspar.functions.hashing import content_key

    keyed = documents.withColumn("key", content_key(F.col("content"), version))
    known = keyed.join(cache, "key").select("doc_id", "key", "markdown")
    fresh = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("content").alias("content"))
    return known, fresh
