"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.store import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Relative weight by training progress for each of the weight classes in turn: heavy
#: sources lead and fade, light ones arrive late. Points are joined by straight lines.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
#: Rows of a source that one block of the running sums holds, about.
BLOCK_ROWS = 300


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def invert_schedule(share: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Progress at which the integral of a piecewise linear weight reaches ``share`` of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False)]
    total, before, result = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(points, points[1:], strict=False), areas, strict=True):
        slope = (w1 - w0) / (t1 - t0)
        need = share * F.lit(total) - F.lit(before)
        at = F.lit(t0) + F.lit(2.0) * need / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2.0 * slope) * need))
        before += area
        result = at if result is None else F.when(share * F.lit(total) < F.lit(before - area), result).otherwise(at)
    return result


def source_targets(sources: DataFrame, weights: Sequence[float], epochs: float, most: float) -> DataFrame:
    """Targets of ``sources`` (source, words): shares by weight, none above ``most`` times its words.

    Weights repeat over the sources by code point, null last. What a capped source cannot
    take is shared by weight among the rest: with the sources in order of words by weight,
    those capped come first, so running sums give the level at which the rest settle. One
    row per source goes through a single task here, never a row per document.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn(
        "rank", F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ).select(
        "source",
        "words",
        (F.col("rank") % len(weights)).cast("int").alias("class"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        "rank",
    )
    order = everything.orderBy(F.col("ratio"), F.col("rank"))
    leveled = (
        ranked.withColumn("cap", F.lit(float(most)) * F.col("words"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(epochs)) * F.sum("words").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("settled", F.min(F.when(~F.col("capped"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    )
    return leveled.select(
        "source", "words", "class", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("settled")).alias("target")
    )


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    epochs: float = 1.5,
    most: float = 2.0,
    curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add to every row of ``docs`` (doc_id, source, size and any others) what the mix takes of it.

    ``docs`` should be settled, as it is read several times. Within a source documents
    stand in the order of a digest of their ids, so reruns agree. The source's passes over that order form one
    line of words; the mix takes the line up to the rounded target, so only the last
    document taken may be taken in part. Where a document starts on the line, as a share of the
    target, is inverted through the source's integrated weight schedule: that is its training position.

    A hot source is no bottleneck: its rows are dealt to blocks by digest, each block is
    summed apart, and offsets of blocks (few rows) are joined back. Adds source_size,
    target, taken, and passes: an array with taken, size and position for each pass that takes words. Rows alike in all
    columns are separate documents; null ids are ordered first; sizes of 0 take nothing.
    """
    source_key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sources = settle(docs.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    rows = sources.agg(F.max("rows")).first()[0] or 1
    digits = max(1, min(8, math.ceil(math.log(max(2, rows / block_rows), 16))))
    docs = docs.withColumn("mix_source", source_key).withColumn("mix_digest", digest).withColumn(
        "mix_block", F.substring("mix_digest", 1, digits)
    )
    in_source = Window.partitionBy("mix_source").orderBy("mix_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        docs.groupBy("mix_source", "mix_block")
        .agg(F.sum("size").alias("block_words"))
        .withColumn("block_start", F.coalesce(F.sum("block_words").over(in_source), F.lit(0)))
        .drop("block_words")
    )
    targets = source_targets(sources.drop("rows"), weights, epochs, most).select(
        source_key.alias("mix_source"), F.col("words").alias("source_size"), F.col("class").alias("mix_class"), "target"
    )
    offsets = settle(offsets.join(targets, "mix_source"))
    in_block = (
        Window.partitionBy("mix_source", "mix_block")
        .orderBy("mix_digest", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = docs.withColumn("mix_start", F.coalesce(F.sum("size").over(in_block), F.lit(0))).join(
        offsets, ["mix_source", "mix_block"]
    )
    demand = F.floor(F.col("target") + 0.5).cast("long")
    start = F.col("block_start") + F.col("mix_start")
    passes = []
    for turn in range(math.ceil(most)):
        begins = start + F.lit(turn) * F.col("source_size")
        share = begins.cast("double") / F.nullif(demand, F.lit(0)).cast("double")
        position = F.lit(None).cast("double")
        for k in range(len(weights)):
            position = F.when(F.col("mix_class") == k, invert_schedule(share, curriculum[k % len(curriculum)])).otherwise(position)
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), demand - begins))
        passes.append(F.struct(taken.alias("taken"), F.when(taken > 0, position).alias("position")))
    return (
        placed.withColumn("passes", F.filter(F.array(*passes), lambda p: p.taken > 0))
        .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p.taken))
        .drop("mix_source", "mix_block", "mix_start", "block_start", "mix_class")
    )


def mix_plan_of(docs: DataFrame, **options) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source), range-sorted by first training position.

    Returns doc_id, size, source_size, target, taken and position (null if nothing is
    taken; those rows come first). A null text has size 0; an empty table gives an empty one.
    """
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    planned = plan_mix(sized, **options).withColumn("position", F.get("passes", F.lit(0))["position"])
    return (
        planned.repartitionByRange("position", "mix_digest")
        .sortWithinPartitions("position", "mix_digest")
        .select("doc_id", "size", "source_size", "target", "taken", "position")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: a row per document and pass, range-sorted by training position.

    Keeps the columns of ``docs`` (doc_id, text, source and any others). The one document
    of a source that the target cuts keeps its leading words; if there is n_chars, it follows.
    """
    kept = docs.columns
    inner = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*kept).alias("mix_row"))
    planned = plan_mix(inner, **options)
    each = planned.select("size", "mix_digest", "mix_row", F.explode("passes").alias("pass"))
    text = F.col("mix_row")["text"]
    pieces = F.regexp_extract_all(text, F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.when(F.col("pass.taken") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("pass.taken").cast("int")), "")).otherwise(text)
    each = each.withColumn("mix_text", cut)
    new = {"text": F.col("mix_text"), "n_chars": F.length("mix_text").cast("long")}
    sorted_ = each.repartitionByRange("pass.position", "mix_digest").sortWithinPartitions("pass.position", "mix_digest")
    return sorted_.select(*[new.get(c, F.col("mix_row")[c]).alias(c) for c in kept])
