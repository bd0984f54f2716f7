"""The queries of this folder and, where SQL can express them, their equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.oracles import ORACLES  # noqa: F401
from veldspar.llm import exact_dedup, language, licenses, mixing, near_dedup, neighbours, packing, secrets, toxicity, url_reputation

from veldspar.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan_of(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_language(language.document_rows(_table(spark, sf_dir, "documents")))
    return found.withColumn("kept", ~F.col("rejected"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_language(language.page_rows(_table(spark, sf_dir, "pages")))
    return found.withColumnRenamed("doc_id", "page_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_groups(_table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")
    )
    return url_reputation.filter_urls(_table(spark, sf_dir, "pages"), labels)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_language": op4_language,
    "language_of_pages": language_of_pages,
    "op5_neighbours": op5_neighbours,
    "op6_packing": op6_packing,
    "op7_near_dedup": op7_near_dedup,
    "op8_licenses": op8_licenses,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_urls": op10_urls,
}
