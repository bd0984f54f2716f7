"""Chunks of texts: packed paragraphs, windows of long ones, keywords and summaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import rowwise

CHUNK_SIZE, OVERLAP = 900, 180


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` (file_id, filename, text) as chunks: chunk_id, file_id, filename, chunk_index, text, start_char, end_char.

    Paragraphs of the normalised text are packed while they fit, longer ones are cut in overlapping windows. No shuffle: a
    text is one row and its chunks come of it where it is read.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def cut(text: str | None) -> Iterator[tuple]:
        return ((i, *c) for i, c in enumerate(rowwise.chunks(rowwise.normalize(text), size, overlap)))

    found = rowwise.each(docs.select("file_id", "filename", F.col("text").alias("whole")), "whole", "chunk_index int, text string, start_char int, end_char int", cut)
    return found.select(F.concat_ws(":", F.col("file_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), *found.columns)


def neighbours(chunks: DataFrame, width: int) -> DataFrame:
    """Each chunk with the chunks up to ``width`` places before and after it in its file."""
    if not 0 <= width <= 10:
        raise ValueError("width must be from 0 to 10")
    order = Window.partitionBy("file_id").orderBy("chunk_index")
    around = order.rangeBetween(-width, width)
    return chunks.select(
        "chunk_id", "file_id", "chunk_index",
        F.collect_list("chunk_index").over(around).alias("window_indexes"),
        (F.min("chunk_index").over(Window.partitionBy("file_id")) < F.col("chunk_index") - width).alias("has_previous"),
        (F.max("chunk_index").over(Window.partitionBy("file_id")) > F.col("chunk_index") + width).alias("has_next"),
    )


def keywords(docs: DataFrame, limit: int = 12) -> DataFrame:
    """The most frequent keyword terms of each document: doc_id, rank, term, n (ties by term)."""
    top = lambda text: ((i + 1, w, n) for i, (w, n) in enumerate(rowwise.keywords(rowwise.normalize(text), limit)))
    return rowwise.each(docs.select("doc_id", "text"), "text", "rank int, term string, n long", top)


def summaries(docs: DataFrame, most: int = 3, limit: int = 600) -> DataFrame:
    """Extractive summaries, the sentences that share most keywords, in text order: doc_id, summary, keywords (the most frequent first)."""
    return rowwise.each(docs.select("doc_id", "text"), "text", "summary string, keywords array<string>", lambda text: [rowwise.summary(rowwise.normalize(text), 12, most, limit)])
