"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.store import settle, written

#: Vectors that the codebooks and the reach of a search are fitted on, about; centroids of each half.
TRAIN_ROWS, ROUNDS = 20_000, 12
#: Entries of a cell, about, that set the number of centroids of each half, and the bounds of that number: finer books tell more of
#: a vector, so a search meets a smaller share of a larger table; the time that the heap takes bounds them.
ENTRIES, LEAST_CENTROIDS, MOST_CENTROIDS = 12, 16, 512
#: Recall that the reach is fitted for on the sample, and queries it is fitted with.
RECALL, TRIAL_QUERIES = 0.96, 200
#: Vectors and queries that a task holds at a time, and queries that it compares at a time.
VECTORS, QUERIES, AT_ONCE = 4096, 4096, 256
#: Queries whose cells one task looks up, about.
ROUTED = 250


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of vectors with neither null nor non-finite components, nor zero throughout."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = (
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return np.unique(centres, axis=0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def scores_of(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever its vector stands."""
    return (vectors * query).sum(axis=1)


def visit_cells(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: int) -> tuple[list[int], float]:
    """Cells by falling sum of the halves' products (the distance of inner-product search) until ``wanted`` entries are met, and the last sum.

    A heap holds the frontier: with each half's centroids sorted, a pair opens the
    pairs one step further in either half, each by one parent only.
    """
    half = len(books[0][0])
    parts = [b @ q for b, q in zip(books, (query[:half], query[half:]), strict=True)]
    order = [np.argsort(-p, kind="stable") for p in parts]
    u, v = (p[o].tolist() for p, o in zip(parts, order, strict=True))
    first, second = (o.tolist() for o in order)
    across = len(v)
    heap, cells, met, last = [(-(u[0] + v[0]), 0, 0)], [], 0, float("inf")
    while heap and met < wanted:
        least, i, j = heapq.heappop(heap)
        cell = first[i] * across + second[j]
        if held := sizes[cell]:
            cells.append(cell)
            met += held
            last = -least
        if j + 1 < across:
            heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
    return cells, last


def _cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = books[0].shape[1]
    return _nearest(x[:, :half], books[0]) * len(books[1]) + _nearest(x[:, half:], books[1])


def fit_reach(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, trial: int) -> float:
    """Share of all entries that a search must meet so that, on the sample, ``recall`` of the true neighbours are among them."""
    cells = _cells_of(sample, books)
    sizes = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    told = sizes.tolist()
    need = []
    for q in range(0, len(sample), max(1, len(sample) // trial)):
        scores = scores_of(sample[q], sample)
        scores[q] = -np.inf
        near = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        visited, _ = visit_cells(sample[q], books, told, len(sample))
        met = dict(zip(visited, np.cumsum(sizes[visited]), strict=True))
        need += [met[c] / len(sample) for c in cells[near]]
    return float(np.quantile(need, recall)) if need else 1.0


def _assign(books: tuple[np.ndarray, np.ndarray]):
    """Vectors as bytes with their cells; ``nth`` tells rows of a task apart, for dealing out copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v.values) for v in batch.column(1)])
                nth = np.arange(seen, seen + len(batch))
                seen += len(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(_cells_of(x, books), pa.int64()), pa.array(nth, pa.int64())],
                    names=["vec_id", "vector", "cell", "nth"],
                )

    return run


def _route(books: tuple[np.ndarray, np.ndarray], sizes: list[int], groups: np.ndarray, wanted: int):
    """A row for each group of cells that a query visits, with the sum down to which it visits cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                cells, last = visit_cells(np.frombuffer(batch.column(1)[at].as_py()), books, sizes, wanted)
                met = np.unique(groups[np.array(cells, np.int64) // len(books[1])])
                one = pa.array(np.zeros(len(met), np.int64))
                part = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(one), part.column(1).take(one), pa.array(met, pa.int64()), pa.array(np.full(len(met), last))],
                    names=["query_id", "query", "block", "down_to"],
                )

    return run


def _compare(books: tuple[np.ndarray, np.ndarray], k: int):
    """The best k of a block's vectors for each of a block's queries, among the cells that the query visits."""

    def run(queries, vectors):
        import pandas as pd

        out = []
        if len(queries) and len(vectors):
            ids, cells = vectors["vec_id"].to_numpy(), vectors["cell"].to_numpy()
            v = np.frombuffer(b"".join(vectors["vector"])).reshape(len(ids), -1)
            half, widest = len(books[0][0]), float(np.sqrt((v**2).sum(1).max()))
            first, second = cells // len(books[1]), cells % len(books[1])
            for at in range(0, len(queries), AT_ONCE):
                part = queries.iloc[at : at + AT_ONCE]
                asked = part["query_id"].to_numpy()
                q = np.frombuffer(b"".join(part["query"])).reshape(len(asked), -1)
                slack = 1e-12 * widest * np.sqrt((q**2).sum(1))
                visited = (q[:, :half] @ books[0].T)[:, first] + (q[:, half:] @ books[1].T)[:, second] >= (part["down_to"].to_numpy() - slack - 1e-12)[:, None]
                rough = np.where(visited & (asked[:, None] != ids[None, :]), q @ v.T, -np.inf)
                least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(asked), -np.inf)
                row, near = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
                exact = np.concatenate([scores_of(q[row[i : i + 8192]], v[near[i : i + 8192]]) for i in range(0, len(row), 8192)] or [np.empty(0)])
                order = np.lexsort((ids[near], -exact, row))
                row, near, exact = row[order], near[order], exact[order]
                begins = np.searchsorted(row, np.arange(len(asked)))
                best = np.arange(len(row)) - begins[row] < k
                out.append(pd.DataFrame({"query_id": asked[row[best]], "vec_id": ids[near[best]], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def group_rows(rows: np.ndarray, most: int) -> np.ndarray:
    """Groups of neighbouring first-half centroids, so that a group holds about ``most`` vectors or is a single centroid."""
    groups, group, filled = np.zeros(len(rows), np.int64), 0, 0
    for i, n in enumerate(rows.tolist()):
        if filled and filled + n > most:
            group, filled = group + 1, 0
        groups[i] = group
        filled += n
    return groups


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    centroids: int | None = None,
    train_rows: int = TRAIN_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """The ``k`` nearest found for each query among all other vectors, by inner product.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. The two halves of
    the vectors are quantised apart, by codebooks fitted on ``train_rows`` of them at most; a vector's
    cell is its pair of centroids. A query visits cells by summed product until the share of
    entries fitted on the sample is met, and what it meets is ranked by exact products.

    Vectors are dealt to blocks of bounded size by groups of first-half centroids, and a query to the groups it visits,
    where it is compared with the vectors of its cells; a cell that holds any part of the vectors is split over
    many blocks. Only codebooks, the sample and the sizes of cells (centroids squared at
    most, and those are bounded) go to the driver. Returns query_id, rank, vec_id, score; ties rank by vec_id. Unusable vectors
    (null, empty, zero, null or non-finite components, null ids, a length other than the most frequent) take no part. A vec_id that
    several rows share names them all: as a query the largest of their vectors by components asks, and as neighbours each counts.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    fine = settle(usable(vectors))
    lengths = fine.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d, total = lengths
    fine = fine.filter(F.size("embedding") == d)
    # A filter leaves about as many as are wanted; their order by digest makes the bound exact and reruns alike.
    digest = F.xxhash64("vec_id", "embedding")
    pick = F.pmod(digest, F.lit(1 << 20)) < min(1 << 20, int(1.2 * train_rows / total * (1 << 20)) + 64)
    ordered = lambda frame: frame.orderBy(digest, "vec_id").limit(train_rows).select("vec_id", "embedding").toArrow()
    rows = ordered(fine.filter(pick)) if total > train_rows else ordered(fine)
    if not len(rows):
        rows = ordered(fine)
    column = rows.column("embedding").combine_chunks()
    sample = np.asarray(column.flatten()).reshape(len(rows), d).astype(np.float64)
    half = max(1, d // 2)
    centroids = centroids or min(MOST_CENTROIDS, max(LEAST_CENTROIDS, round((total / ENTRIES) ** 0.5)))
    books = (_kmeans(sample[:, :half], centroids, ROUNDS, 1), _kmeans(sample[:, half:], centroids, ROUNDS, 2)) if d > 1 else (np.unique(sample, axis=0), np.zeros((1, 0)))
    reach = fit_reach(sample, books, k, recall, TRIAL_QUERIES)
    indexed = written(fine.mapInArrow(_assign(books), "vec_id long, vector binary, cell long, nth long"))
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for cell, n in indexed.groupBy("cell").count().collect():
        sizes[cell] = n
    wanted = min(total, max(k + 1, int(np.ceil(reach * total))))
    groups = group_rows(sizes.reshape(len(books[0]), -1).sum(1), VECTORS)
    asking = indexed.filter(is_query).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    # So many tasks that none traverses cells for very many queries; they are too small for Spark to tell.
    asking = asking.repartition(max(1, -(-asking.count() // ROUTED)), "vec_id")
    routed = settle(asking.mapInArrow(_route(books, sizes.tolist(), groups, wanted), "query_id long, query binary, block long, down_to double"))
    group_of = F.element_at(F.array(*[F.lit(int(g)) for g in groups]), (F.floor(F.col("cell") / len(books[1])) + 1).cast("int")).cast("long")
    held = indexed.withColumn("block", group_of)
    counts = routed.groupBy("block").agg(F.count(F.lit(1)).alias("asked"))
    blocks = settle(
        held.groupBy("block")
        .agg(F.count(F.lit(1)).alias("held"))
        .join(counts, "block")
        .select("block", F.ceil(F.col("held") / VECTORS).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("turns"))
    )
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(blocks, "block").select("block", spot("query_id", "turns").alias("turn"), each("parts").alias("part"), "query_id", "query", "down_to")
    spread = F.pmod(F.xxhash64("vec_id", "nth"), F.col("parts")).cast("int")
    right = held.join(blocks, "block").select("block", each("turns").alias("turn"), spread.alias("part"), "vec_id", "cell", "vector")
    keys = ("block", "turn", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(books, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
