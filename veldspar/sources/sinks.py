"""Sinks: chats as exchange files, markdown beside its sidecar, replaced groups of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1"


def export_chats(messages: DataFrame) -> DataFrame:
    """Each chat as one JSON envelope: chat_id, envelope."""
    items = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    body = messages.groupBy("chat_id").agg(items.alias("messages"))
    return body.select("chat_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), "chat_id", "messages")).alias("envelope"))


def import_chats(envelopes: DataFrame, taken: DataFrame, preserve: bool = False, offset: int = 0) -> DataFrame:
    """Messages of envelopes: chat_id, pos, role, content.

    With ``preserve`` the ids stay and one that is in ``taken`` (chat_id) is an error; else each is moved past those taken.
    """
    schema = "struct<version:string,chat_id:bigint,messages:array<struct<pos:bigint,role:string,content:string>>>"
    parsed = envelopes.select(F.from_json("envelope", schema).alias("e")).filter("e.version = '1'")
    if preserve:
        clash = parsed.join(taken, F.col("e.chat_id") == F.col("chat_id"), "left_semi").limit(1).count()
        if clash:
            raise ValueError("a chat of this id exists")
        new = F.col("e.chat_id")
    else:
        most = taken.agg(F.coalesce(F.max("chat_id"), F.lit(-1))).first()[0]
        new = F.col("e.chat_id") + F.lit(most + 1 + offset)
    return parsed.select(new.alias("chat_id"), F.explode("e.messages").alias("m")).select("chat_id", "m.*")


def write_markdown(rendered: DataFrame, path: str) -> None:
    """One row per document with its markdown, partitioned by nothing: documents are rows, not files."""
    rendered.write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks dealt by a digest of their file, so that replacing files rewrites only their buckets."""
    spot = F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")
    chunks.withColumn("bucket", spot).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
