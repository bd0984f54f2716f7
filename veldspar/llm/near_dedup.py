"""MinHash near-duplicate detection with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.components import connected_components
from veldspar.llm.kernels import LOWER, jaccard_parts, mix, shingle_set, tidy, word_hashes
from veldspar.llm.store import settle, small_batches, written

WIDTH = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair at the threshold misses all bands with probability (1 - 0.85**7)**36 < 1e-6.
BANDS, ROWS = 36, 7
#: Signature values compared at a time, and the chance that a link may be pruned.
STEP, MISS = 42, 1e-7
#: Pivots that a large group meets in a round, and comparisons left for each node that call for one more round.
SALTS, LEFT = 8, 20_000
#: Members and other members of a bucket that one task compares at a time.
FEW, MANY = 256, 512

SKETCH = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]
)


@lru_cache(1)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n].astype(np.uint32) | np.uint32(1)), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures (len(sets) x n, 32 bits) of sets that aren't empty."""
    factor, offset = _permutations(n)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out, hashed = np.empty((n, len(sets)), np.uint32), np.empty(len(keys), np.uint32)
    for k in range(n):
        np.multiply(keys, factor[k], out=hashed)
        np.add(hashed, offset[k], out=hashed)
        out[k] = np.minimum.reduceat(hashed, starts)
    return np.ascontiguousarray(out.T)


@lru_cache(8)
def least_matches(n: int, step: int, percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """Pairs (values compared, matches needed): with fewer, the posterior chance of a link is under ``miss``.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), whose
    upper tail is a sum of binomial terms.
    """
    t, out = percent / 100, []
    for seen in range(step, n + 1, step):
        tail = 0.0
        for m in range(seen + 1):
            tail += math.comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
            if tail >= miss:
                out.append((seen, m))
                break
    return tuple(out)


def text_shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    return shingle_set(word_hashes((text or b"").translate(LOWER)), width)


def _sketch(width: int, bands: int, rows: int):
    n = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                part: list = []
                size = 0
                while at < len(ids) and (size < 400_000 or not part):
                    text = texts[at].as_py()
                    part.append((ids[at].as_py(), text_shingles(text, width)))
                    size += len(part[-1][1])
                    at += 1
                yield _sketch_rows(part, seen, bands, rows, n)

    return tidy(run)


def _sketch_rows(part: list, seen: set[bytes], bands: int, rows: int, n: int) -> pa.RecordBatch:
    prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for _, s in part]
    fresh = []
    for i, (p, (doc_id, _)) in enumerate(zip(prints, part, strict=True)):
        if p is not None and doc_id is not None and p not in seen:
            if len(seen) < 2_000_000:
                seen.add(p)
            fresh.append(i)
    band_rows: list = [None] * len(part)
    sig_rows: list = [None] * len(part)
    if fresh:
        sig = signatures([part[i][1] for i in fresh], n)
        words = np.zeros(sig.shape[:1] + (bands,), np.uint64)
        for k in range(rows):
            words = mix(words * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows])
        keys = mix(words ^ mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))).view(np.int64)
        short = sig.astype(np.uint16)
        for j, i in enumerate(fresh):
            band_rows[i], sig_rows[i] = keys[j], short[j].tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in part], pa.int64()),
            pa.array([len(s) for _, s in part], pa.int64()),
            pa.array(prints, pa.binary()),
            pa.array(band_rows, pa.list_(pa.int64())),
            pa.array(sig_rows, pa.binary()),
        ],
        schema=SKETCH,
    )


def _survivors(a: np.ndarray, b: np.ndarray, plan: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Which of the pairs of signatures (rows of a and b) live through every batch of values."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for seen, need in plan:
        matches = matches + (a[alive, done:seen] == b[alive, done:seen]).sum(1, dtype=np.int32)
        keep = matches >= need
        alive, matches, done = alive[keep], matches[keep], seen
        if not len(alive):
            break
    return alive


def _prune(plan: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(batch), -1) for i in (2, 3)]
            yield batch.select([0, 1, 4, 5]).take(pa.array(_survivors(sig[0], sig[1], plan)))

    return tidy(run)


def _cross(plan: tuple[tuple[int, int], ...], width: int, percent: int):
    """Links between the components of a bucket's members, compared block by block.

    A pair that shares several buckets is compared in that of the first band it shares. What the
    signatures can't rule out is verified on full sets here, so only links leave the task; once two
    components are linked, their other pairs in the block don't matter.
    """

    def run(key, few, many):
        import pandas as pd

        links: list[tuple[int, int]] = []
        if len(few) and len(many):
            sig_f, sig_m = (np.frombuffer(b"".join(x["sig"]), np.uint16).reshape(len(x), -1) for x in (few, many))
            keys_f, keys_m = (np.stack(x["bands"].to_list()) for x in (few, many))
            id_f, id_m = few["node"].to_numpy(), many["node"].to_numpy()
            comp_f, comp_m = few["component"].to_numpy(), many["component"].to_numpy()
            sets = [text_shingles(t, width) for t in many["text"]]
            sizes = np.array([len(x) for x in sets])
            for i in range(len(few)):
                other = np.flatnonzero((comp_m != comp_f[i]) & (id_m != id_f[i]))
                same = keys_m[other] == keys_f[i]
                first = same.argmax(1)
                other = other[same.any(1) & (keys_f[i][first] == key[0])]
                live = other[_survivors(np.broadcast_to(sig_f[i], (len(other), sig_f.shape[1])), sig_m[other], plan)]
                own = text_shingles(few["text"].iloc[i], width)
                # Sizes alone bound the similarity.
                live = live[100 * np.minimum(sizes[live], len(own)) >= percent * np.maximum(sizes[live], len(own))]
                met: set[int] = set()
                for at in range(0, len(live), 64):
                    part = np.array([j for j in live[at : at + 64] if comp_m[j] not in met], int)
                    if not len(part):
                        continue
                    flat = np.concatenate([sets[j] for j in part])
                    spot = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                    shared = np.add.reduceat((own[spot] == flat).astype(np.int64), starts)
                    for j in part[100 * shared >= percent * (sizes[part] + len(own) - shared)]:
                        if comp_m[j] not in met:
                            met.add(comp_m[j])
                            links.append((min(comp_f[i], comp_m[j]), max(comp_f[i], comp_m[j])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64").drop_duplicates()

    return run


def _verify(width: int, percent: int):
    """Exact comparison of full shingle sets; the set of a text met again just after is reused. Returns the components linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                ta = ta.as_py()
                if ta != last[0]:
                    last = (ta, text_shingles(ta, width))
                shared, union = jaccard_parts(last[1], text_shingles(tb.as_py(), width))
                if shared and 100 * shared >= percent * union:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return tidy(run)


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The components (a, b) of those of ``pairs`` (a, b, comp_a, comp_b) whose texts are similar enough."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(tb, "b").join(ta, "a").select("comp_a", "comp_b", "text_a", "text_b")
    return both.mapInArrow(_verify(width, percent), "comp_a long, comp_b long").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """Components of the documents of ``docs`` (doc_id, text) under near-duplicate links.

    1. Each text becomes its set of distinct shingles, a fingerprint of the set and, once per task
       and fingerprint, a MinHash signature with its band keys. Documents of one set form a
       class that one of them, its node, stands for.
    2. In each bucket of a band, members are paired with a pivot. Pairs are compared signature
       batch by signature batch and dropped as soon as the posterior chance of a link falls
       under ``miss``; the full sets of survivors are compared exactly.
    3. Components of these links become single nodes. While buckets with several components leave very many pairs and a
       round still finds links, there is one more round of pivots. At last all pairs across components
       are compared likewise, in blocks; pairs
       within a component can't change it. So every pair that shares a bucket is either
       compared or known to be connected.

    Returns doc_id, n_shingles, component_id, kept for each row. Null, empty and blank texts have no
    shingles and no links. A row with a null doc_id can't be named by links: its
    component_id is null and it is kept. Rows alike in doc_id are one document: it is
    linked if any of its texts is. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plan = least_matches(bands * rows, STEP, percent, miss)
    sketch = written(
        docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
            _sketch(width, bands, rows), "doc_id long, n_shingles long, fp binary, bands array<bigint>, sig binary"
        )
    )
    classes = settle(
        sketch.filter("fp is not null and doc_id is not null")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("sig").isNotNull(), F.col("doc_id"))).alias("node"))
    )
    nodes = classes.select("node")
    keyed = (
        sketch.filter("bands is not null")
        .select(F.col("doc_id").alias("node"), "bands")
        .join(nodes, "node", "left_semi")
        .select("node", F.explode("bands").alias("bucket"))
    )
    shared = (
        keyed.groupBy("bucket")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.struct(_digest(0).alias("h"), "node")).alias("pivot"))
        .filter("low < high")
        .select("bucket", F.col("pivot.node").alias("pivot"))
    )
    members = written(keyed.join(shared, "bucket").select("bucket", "node", "pivot"))
    held = members.select("node").distinct()
    sigs = written(sketch.filter("sig is not null").select(F.col("doc_id").alias("node"), "sig", "bands").join(held, "node", "left_semi"))
    texts = written(docs.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text")).join(held, "node", "left_semi"))
    at = members.select("bucket", "node", F.col("node").alias("component"))
    paired = members.filter("node <> pivot").select("node", F.col("node").alias("own"), "pivot", F.col("pivot").alias("other"))
    label = None
    for turn in itertools.count(1):
        step = _components(_links(_pruned(_pairs(paired), sigs, plan), texts, width, percent))
        if step is not None:
            label = step if label is None else _composed(label, step)
            at = at.join(step, at["component"] == step["node"], "left").select("bucket", at["node"], F.coalesce(step["component"], at["component"]).alias("component"))
        main = settle(_open_buckets(at))
        left, rows = main.agg(F.sum(F.col("minors") * F.col("n")), F.sum("n")).first()
        if not left:
            break
        at = written(at.join(main.select("bucket"), "bucket"))
        if step is None or left <= LEFT * rows:
            step = _components(_across(at, main, sigs, texts, plan, width, percent))
            if step is not None:
                label = step if label is None else _composed(label, step)
            break
        paired = _with_pivots(at, turn)

    component = nodes.limit(0).select("node", F.col("node").alias("component")) if label is None else label
    # A component is named by the smallest doc_id of all its classes.
    classes = classes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = settle(classes.join(names, "component").select("fp", "component_id"))
    return (
        sketch.select("doc_id", "n_shingles", "fp")
        .join(named, "fp", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _digest(turn: int) -> Column:
    """What a bucket's pivot is the smallest by.

    It is salted by turn and by a few classes of buckets: members that share many buckets meet some pivots, not a different one in each.
    """
    return F.xxhash64("node", F.pmod("bucket", F.lit(SALTS)) + F.lit(turn * SALTS))


def _with_pivots(at: DataFrame, turn: int) -> DataFrame:
    """Each bucket's members with one pivot of it that is in another component: node, own, pivot, other."""
    pivots = at.groupBy("bucket").agg(F.min(F.struct(_digest(turn).alias("h"), "node", "component")).alias("pivot"))
    return at.join(pivots, "bucket").filter(F.col("component") != F.col("pivot.component")).select(
        "node", F.col("component").alias("own"), F.col("pivot.node").alias("pivot"), F.col("pivot.component").alias("other")
    )


def _pairs(paired: DataFrame) -> DataFrame:
    """``paired`` (node, own, pivot, other) as distinct pairs a < b with their components."""
    ends = F.array_sort(F.array(F.struct(F.col("node").alias("id"), F.col("own").alias("comp")), F.struct(F.col("pivot").alias("id"), F.col("other").alias("comp"))))
    return paired.select(ends.alias("e")).select(
        F.col("e")[0]["id"].alias("a"), F.col("e")[1]["id"].alias("b"), F.col("e")[0]["comp"].alias("comp_a"), F.col("e")[1]["comp"].alias("comp_b")
    ).distinct()


def _pruned(pairs: DataFrame, sigs: DataFrame, plan: tuple[tuple[int, int], ...]) -> DataFrame:
    sig_a = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b", "comp_a", "comp_b")
    return both.mapInArrow(_prune(plan), "a long, b long, comp_a long, comp_b long")


def _components(links: DataFrame) -> DataFrame | None:
    found = settle(links)
    return None if found.isEmpty() else connected_components(found)


def _composed(label: DataFrame, step: DataFrame) -> DataFrame:
    """``label`` (node, component) with components moved on by ``step``, and what ``step`` alone has."""
    named = step.select(F.col("node").alias("was"), F.col("component").alias("now"))
    moved = label.join(named, label["component"] == named["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
    alone = named.join(label.select("node"), F.col("was") == F.col("node"), "left_anti")
    return moved.unionByName(alone.select(F.col("was").alias("node"), F.col("now").alias("component")))


def _open_buckets(at: DataFrame) -> DataFrame:
    """Buckets that hold several components, but those of two members, whose pair has been tested: bucket, main (the largest component), n, minors."""
    sizes = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    by = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("n"), F.max("size").alias("most"))
    return by.filter("n > most and n > 2").select("bucket", "main", "n", (F.col("n") - F.col("most")).alias("minors"))


def _across(at: DataFrame, main: DataFrame, sigs: DataFrame, texts: DataFrame, plan: tuple[tuple[int, int], ...], width: int, percent: int) -> DataFrame:
    """Links between different components in the buckets of ``at`` (bucket, node, component).

    The members outside the bucket's largest component meet all others of the bucket.
    Both sides are dealt to chunks, so no task holds a bucket of any size. Texts go with them: of texts that share long
    passages, signatures let so many pairs through that handing these on would be more than the texts.
    """
    counts = at.join(main, "bucket").select("bucket", "node", "component", "n", "minors", (F.col("component") != F.col("main")).alias("minor"))
    few_parts = F.ceil(F.col("minors") / FEW).cast("int")
    many_parts = F.ceil(F.col("n") / MANY).cast("int")
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    held = sigs.join(texts, "node")
    few = (
        counts.filter("minor")
        .select("bucket", "node", "component", (spot % few_parts).alias("f"), F.explode(F.sequence(F.lit(0), many_parts - 1)).alias("m"))
        .join(held, "node")
    )
    many = counts.select(
        "bucket", "node", "component", F.explode(F.sequence(F.lit(0), few_parts - 1)).alias("f"), (spot % many_parts).alias("m")
    ).join(held, "node")
    kinds = {"bucket": "long", "f": "long", "m": "long", "node": "long", "component": "long", "sig": "binary", "bands": "array<long>", "text": "binary"}
    few, many = (x.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]) for x in (few, many))
    keys = ("bucket", "f", "m")
    return few.groupBy(*keys).cogroup(many.groupBy(*keys)).applyInPandas(_cross(plan, width, percent), "a long, b long")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns: the smallest doc_id of each component.

    Rows without an id stay, and so do all rows of a document that stays.
    """
    gone = written(near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
