"""Grace hash deduplication of documents by their complete normalised text."""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.kernels import SPACE, tidy
from veldspar.llm.store import settle, small_batches, written

#: Bytes of distinct content that a table holds before it passes the rest on.
TABLE_BYTES = 24 << 20
FAN_OUT = 16
#: Members from which a group may wait when a task's table is passed on.
HOT = 16

LOCAL = pa.schema(
    [("doc_id", pa.int64()), ("gid", pa.int64()), ("best", pa.bool_()), ("points", pa.int64()), ("members", pa.int64()), ("bucket", pa.int64()), ("content", pa.binary())]
)
CLASSES = pa.schema(
    [("gid", pa.int64()), ("winner", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())]
)


class ContentTable:
    """Open addressing with linear probing; a slot is equal only if the complete content is."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, content: bytes, insert: bool = True) -> tuple[int, bool]:
        """Number of the content, and whether it is new; -1 if it is absent and not to be inserted."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, False
            at = (at + 1) & mask
        if not insert:
            return -1, True
        self.slots[at] = k = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k
        self.slots = slots


def _better(points: int, doc_id: int | None, than: tuple[int, int | None]) -> bool:
    """More code points first, then the smaller doc_id, null last."""
    if points != than[0]:
        return points > than[0]
    return doc_id is not None and (than[1] is None or doc_id < than[1])


class _Groups:
    """A task's groups of equal content: their numbers, members, and best rows so far.

    A row is (doc_id, gid, points). The best row of a group bears its content. What is passed on when the table is full goes without
    the groups of most members, whose best rows wait: a text with very many copies is passed on once a task.
    """

    def __init__(self, base: int, table_bytes: int) -> None:
        self.next, self.table_bytes = base, table_bytes
        self.table = ContentTable()
        self.rows: list[tuple[int | None, int, int]] = []
        #: Of each content: gid, members, the best row's points and doc_id, and where in ``rows`` it is, or -1 where it waits.
        self.groups: list[list] = []

    def add(self, doc_id: int | None, points: int, content: bytes) -> None:
        h = int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")
        k, new = self.table.find(h, content)
        if new:
            self.groups.append([self.next, 1, points, doc_id, len(self.rows)])
            self.next += 1
        else:
            g = self.groups[k]
            g[1] += 1
            if _better(points, doc_id, (g[2], g[3])):
                if g[4] < 0:
                    self.rows.append((g[3], g[0], g[2]))
                g[2:] = [points, doc_id, len(self.rows)]
        self.rows.append((doc_id, self.groups[k][0], points))

    @property
    def full(self) -> bool:
        return self.table.bytes > self.table_bytes or len(self.rows) >= 500_000

    def waiting(self) -> set[int]:
        """The groups of at least ``HOT`` members, as many as fit a quarter of the table."""
        chosen, size = set(), 0
        for k in sorted((k for k, g in enumerate(self.groups) if g[1] >= HOT), key=lambda k: -self.groups[k][1]):
            size += len(self.table.contents[k]) + 100
            if 4 * size > self.table_bytes:
                break
            chosen.add(k)
        return chosen

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        stay = set() if last else self.waiting()
        bearer: dict[int, int] = {}
        gone = set()
        for k, (gid, _, points, doc_id, at) in enumerate(self.groups):
            if k in stay:
                gone.add(at)
            elif at < 0:
                bearer[len(self.rows)] = k
                self.rows.append((doc_id, gid, points))
            else:
                bearer[at] = k
        gone.discard(-1)
        kept = [i for i in range(len(self.rows)) if i not in gone]
        for at in range(0, len(kept), 2000):
            part = kept[at : at + 2000]
            held = [bearer.get(i) for i in part]
            of = lambda use: [None if k is None else use(k) for k in held]  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([self.rows[i][c] for i in part], pa.int64()) for c in (0, 1)),
                    pa.array([k is not None for k in held], pa.bool_()),
                    pa.array([self.rows[i][2] for i in part], pa.int64()),
                    pa.array(of(lambda k: self.groups[k][1]), pa.int64()),
                    pa.array(of(lambda k: self.table.hashes[k] - (1 << 63)), pa.int64()),
                    pa.array(of(lambda k: self.table.contents[k]), pa.binary()),
                ],
                schema=LOCAL,
            )
        table, groups = self.table, self.groups
        self.table, self.rows, self.groups = ContentTable(), [], []
        for k in sorted(stay):
            self.table.find(table.hashes[k], table.contents[k])
            self.groups.append([*groups[k][:4], -1])


def _gather(table_bytes: int):
    """Within a task, collapse equal contents: a row per document, with the content once per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        groups = _Groups(TaskContext.get().partitionId() << 33, table_bytes)
        for batch in batches:
            ids, points, texts = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, n, text in zip(ids, points, texts, strict=True):
                groups.add(doc_id, n, (text or b"").translate(None, SPACE))
                if groups.full:
                    yield from groups.flush(False)
        yield from groups.flush(True)

    return tidy(run)


def _grace(records: Iterator[tuple[int, bytes, int, int, int | None, int]], folder: str, depth: int, table_bytes: int):
    """Groups of equal content among ``records`` (hash, content, gid, points, doc_id, members).

    Contents fill a table while they fit. What is absent from a full table goes to spill
    files by the next bits of its hash, and each file is treated likewise; copies of what
    the table holds never spill, however many they are. Yields (content, gids, winner, doc_id, members).
    """
    table, groups, files = ContentTable(), [], None
    salt = depth.to_bytes(2, "little")
    for record in records:
        h, content, gid, points, doc_id, members = record
        k, new = table.find(h, content, insert=table.bytes < table_bytes)
        if k < 0:
            if files is None:
                files = [open(f"{folder}/{depth}-{i}", "wb") for i in range(FAN_OUT)]  # noqa: SIM115
            part = hashlib.blake2b(h.to_bytes(8, "little") + salt, digest_size=1).digest()[0] % FAN_OUT
            pickle.dump(record, files[part], protocol=5)
        elif new:
            groups.append([[gid], (points, doc_id), gid, members])
        else:
            g = groups[k]
            g[0].append(gid)
            g[3] += members
            if _better(points, doc_id, g[1]):
                g[1], g[2] = (points, doc_id), gid
    for content, (gids, (_, doc_id), winner, members) in zip(table.contents, groups, strict=True):
        yield content, gids, winner, doc_id, members
    del table, groups
    for f in files or ():
        f.close()
    for f in files or ():
        inner = tempfile.mkdtemp(dir=folder)
        yield from _grace(_read(f.name), inner, depth + 1, table_bytes)
        shutil.rmtree(inner)
        os.unlink(f.name)


def _read(path: str):
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _resolve(table_bytes: int):
    """The classes of one partition of contents; spill files live in the task's own folder until it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for h, content, gid, points, doc_id, members in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    yield h + (1 << 63), content, gid, points, doc_id, members

        folder = tempfile.mkdtemp(prefix="veldspar-grace-")
        try:
            out: list[tuple] = []
            for content, gids, winner, doc_id, members in _grace(records(), folder, 0, table_bytes):
                digest = hashlib.sha256(content).hexdigest()
                for gid in gids:
                    out.append((gid, winner, doc_id, members, digest))
                    if len(out) >= 5000:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return tidy(run)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CLASSES, strict=True)], schema=CLASSES)


def assign_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Group the rows of ``docs`` (doc_id, text) whose texts are equal but for white space.

    First each task collapses its own copies; when its table is full it passes groups on, but for those of most members, so a text with very
    many copies sends its content once a task. Contents are then dealt by hash to buckets, each of which an
    open-addressing table settles, spilling to files as it must. Members find their class by the task's group number,
    which is even however large the class is.

    Null texts count as empty, and all empty texts are one group. Returns a row per input
    row: doc_id, keep_id, group_size, kept, text_sha256. Of repeated rows exactly one can
    be kept; a null doc_id ranks after any other and may be the keep_id of its group.
    """
    small_batches(docs.sparkSession)
    text = F.col("text")
    read = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"), text.cast("binary").alias("text")
    )
    local = written(read.mapInArrow(_gather(table_bytes), "doc_id long, gid long, best boolean, points long, members long, bucket long, content binary"))
    contents = local.filter("best").select("bucket", "content", "gid", "points", "doc_id", "members").repartition("bucket")
    classes = settle(contents.mapInArrow(_resolve(table_bytes), "gid long, winner long, keep_id long, group_size long, text_sha256 string"))
    return local.select("doc_id", "gid", "best").join(classes, "gid").select(
        "doc_id", "keep_id", "group_size", (F.col("best") & (F.col("gid") == F.col("winner"))).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Among rows alike in doc_id and in normalised text, the longest original stays, once. A null doc_id ranks
    after any other of as many code points.
    """
    groups = assign_groups(docs, table_bytes).select("doc_id", "kept", "text_sha256")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        # The dropped ids are the fewer; Spark broadcasts their table if its size allows it.
        gone = written(groups.filter("not kept").select(F.col("doc_id").alias("gone_id")))
        return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    kept = written(groups.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")))
    bare = F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE.decode(), "").cast("binary")
    # An aggregate keeps one row of a key in each task, however many rows share it.
    order = F.struct(-F.length("text"), F.col("text"), F.xxhash64(F.lit(0), *[F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]))
    return (
        docs.withColumn("own_sha", F.sha2(bare, 256))
        .join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha")), "left_semi")
        .groupBy(F.col("doc_id").alias("own_id"), "own_sha")
        .agg(F.min_by(F.struct(*docs.columns), order).alias("own_row"))
        .select(*[F.col("own_row")[c].alias(c) for c in docs.columns])
    )
