"""Content digests and hashed token vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import rowwise

DIMENSIONS = 384


def content_key(content: Column, version: str) -> Column:
    """sha256 of the version, a zero byte and the content."""
    return F.sha2(F.concat(F.lit(version.encode() + b"\x00"), content.cast("binary")), 256)


def hash_vectors(chunks: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Signed, hashed token counts of unit length: chunk_id, vector. A text without tokens has zeros."""
    embed = rowwise.Embedder(dimensions)
    return rowwise.each(chunks.select("chunk_id", "text"), "text", "vector array<double>", lambda text: [(embed(text).tolist(),)])


#: Embedders by name: from a number of dimensions to a function of a text. ``hash`` needs no model.
EMBEDDERS: dict[str, Callable[[int], Callable[[str | None], np.ndarray]]] = {"hash": rowwise.Embedder}


def register(name: str, make: Callable[[int], Callable[[str | None], np.ndarray]]) -> None:
    """Add an embedder; ``make`` is called once for a query and what it returns goes to the tasks."""
    EMBEDDERS[name] = make


def embed(chunks: DataFrame, name: str = "hash", dimensions: int = DIMENSIONS) -> DataFrame:
    """Vectors of ``chunks`` (chunk_id, text) by an embedder of that name: chunk_id, vector."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {name}")
    make = EMBEDDERS[name](dimensions)
    return rowwise.each(chunks.select("chunk_id", "text"), "text", "vector array<double>", lambda text: [([float(x) for x in make(text)],)])
