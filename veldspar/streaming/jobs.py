"""A stream of extraction jobs: validation, dead letters, status, events, counts by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

PAYLOAD = "struct<user_id:string,message_id:string,chat_id:string,op:string,created_at:string,attachments:array<struct<attachment_id:string,title:string>>>"


def read_jobs(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 50) -> DataFrame:
    """Jobs that arrive as JSON files. A restart goes on from the checkpoint, so what was pending is read again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def validate(jobs: DataFrame) -> DataFrame:
    """``jobs`` (job_id, data) with the parsed payload and the first reason to refuse it, null if there is none."""
    parsed = jobs.withColumn("payload", F.from_json("data", PAYLOAD))
    reason = (
        F.when(F.coalesce("data", F.lit("")) == "", "missing data")
        .when(F.col("payload").isNull() | F.try_parse_json("data").isNull(), "invalid json")
        .when(F.coalesce("payload.user_id", F.lit("")) == "", "missing user_id")
        .when(F.coalesce(F.size("payload.attachments"), F.lit(0)) <= 0, "no attachments")
    )
    return parsed.withColumn("reason", reason)


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs to do, and dead letters with their original fields."""
    return validated.filter("reason is null").drop("reason"), validated.filter("reason is not null").drop("payload")


def latest(states: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return states.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def statuses(validated: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to show of each job and of each of its files.

    ``validated`` is of ``validate``; ``results`` has job_id, attachment_id, error (null if it was read). Returns job rows (job_id, status, ui, error_reason,
    current_stage) and file rows (job_id, idx, attachment_id, status, error). A file that no result tells of is still being extracted.
    """
    files = validated.filter("reason is null").select("job_id", F.posexplode("payload.attachments").alias("idx", "a")).select("job_id", "idx", F.col("a.attachment_id").alias("attachment_id"))
    told = results.select("job_id", "attachment_id", F.col("error"), F.lit(True).alias("told"))
    each = files.join(told, ["job_id", "attachment_id"], "left").select(
        "job_id", "idx", "attachment_id", F.when(F.col("told").isNull(), "extracting").when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error"
    )
    per = each.groupBy("job_id").agg(F.count_if(F.col("status") == "extracting").alias("open"), F.min_by("error", F.when(F.col("status") == "failed", F.col("idx"))).alias("first"))
    wrong = F.coalesce(F.col("reason"), F.col("first"))
    status = F.when(wrong.isNotNull(), "failed").when(F.col("open") > 0, "Extracting").otherwise("extraction_success")
    jobs = validated.select("job_id", "reason").join(per, "job_id", "left").select(
        "job_id", status.alias("status"), F.when(status == "Extracting", "Extracting files").otherwise("").alias("ui"), wrong.alias("error_reason"), F.when(wrong.isNotNull(), "file_extractor").alias("current_stage")
    )
    return jobs, each


def ordered_results(results: DataFrame) -> DataFrame:
    """Results of a job's attachments (job_id, idx and others) in the order of the attachments, whenever they came: job_id, results."""
    rest = [c for c in results.columns if c not in ("job_id", "idx")]
    return results.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("idx", *rest))).alias("results"))


def out_events(done: DataFrame) -> DataFrame:
    """The next stage's message of each finished job: the payload that was built, not the one received."""
    return done.select("job_id", F.to_json(F.struct("job_id", "payload.user_id", "payload.chat_id", "payload.message_id", F.lit("extracted").alias("op"), "payload.attachments")).alias("data"))


def process(jobs: DataFrame, handle: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> DataStreamWriter:
    """Run ``handle`` on each batch's valid jobs; results, dead letters and status go to folders below ``folder``.

    Rows are written under their batch number, so a batch that is run again overwrites
    its own output and nothing is done twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        checked = validate(rows.dropDuplicates(["job_id"])).persist()
        good, dead = split(checked)
        handle(good).write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
        dead.write.mode("overwrite").parquet(f"{folder}/dead/batch={number}")
        status = checked.select("job_id", F.when(F.col("reason").isNull(), "done").otherwise("failed").alias("status"), F.col("reason").alias("error"))
        status.write.mode("overwrite").parquet(f"{folder}/status/batch={number}")
        checked.unpersist()

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def counts_by_time(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their value by type in tumbling windows of event time; those later than ``late`` are dropped on a stream."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = at.groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = at.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def answer_events(row: dict, width: int = 60):
    """The events of one answered question, in the order in which they are sent: retrieval, tools, tokens, done."""
    yield {"event": "retrieval", "sources": row.get("sources", [])}
    if row.get("tools"):
        yield {"event": "tools", "tools": row["tools"]}
    answer = row.get("answer") or ""
    for at in range(0, len(answer), width):
        yield {"event": "token", "text": answer[at : at + width]}
    yield {"event": "done", "answer": answer}
