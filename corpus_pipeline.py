"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns rows with the columns of
documents; the last returns the pieces of the packed sequences. A stage is called once
its predecessor's result has been written, so what that one kept aside goes then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import store
from veldspar.llm.exact_dedup import drop_copies
from veldspar.llm.language import drop_unidentified
from veldspar.llm.mixing import mix_documents
from veldspar.llm.near_dedup import drop_near_duplicates
from veldspar.llm.packing import pack_documents
from veldspar.llm.queries import tokenizer_path


#: Chunks of text whose ids a packing worker remembers: few, as executors that ran the stages before have grown.
REMEMBERED = 80_000


#: Documents are near duplicates from 80 % on; a pair at that similarity misses all bands with probability (1 - 0.8**6)**46 < 1e-6.
SIMILAR = {"percent": 80, "bands": 46, "rows": 6}


def stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(run)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.drop("stage")
        with store.tagged("stage"):
            return run(spark, docs, sf_dir)

    return begin


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language no evidence settles go."""
    return drop_unidentified(docs)


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then the smallest doc_id."""
    return drop_copies(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their shingles of five words the smallest doc_id stays."""
    return drop_near_duplicates(docs, **SIMILAR)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each time that the mix takes one."""
    return mix_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a document that is taken twice is packed twice."""
    return pack_documents(docs, tokenizer_path(), remember=REMEMBERED, keep=False)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack),
]
#: Signatures, tokenizers and packing are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES[:-1]):
        kept = step(spark, docs, sf_dir)
        with store.tagged(f"result {k % 2}"):
            store.drop(f"result {k % 2}")
            docs = store.written(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
