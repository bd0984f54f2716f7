"""Language identification by fusing evidence: text, declared language, address suffix, host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.kernels import LOWER, tidy
from veldspar.llm.store import settle, small_batches

#: Rows of each language that the text model is fitted on, about.
TRAIN_ROWS = 20_000
#: Of these, those that one task counts, about.
ROWS_A_TASK = 4000
BUCKETS = 1 << 16
#: A text's evidence counts as that of so many independent n-grams at most.
EVIDENCE = 40.0
#: Pseudo-counts that pull a host towards its domain and a domain towards all hosts.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
MIN_POSTERIOR = 0.5
#: A text speaks for an unknown language as much as against its best one if its n-grams are, on average, so far from
#: the usual level of that language (0) towards that of n-grams never seen in it (1).
UNKNOWN_LEVEL = 0.4


#: Of bytes in lower case: letters and parts of characters beyond ASCII 2, a space 1, anything else 0.
_KIND = np.array([2 if 97 <= c <= 122 or c >= 128 else int(c in (9, 10, 11, 12, 13, 32)) for c in range(256)], np.uint8)


def gram_buckets(text: bytes, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a whole text, lower-cased and between spaces, that hold letters and spaces only.

    Figures, marks, keys and the like belong to no language, so trigrams with any of their characters don't count.
    """
    data = b" " + text.translate(LOWER) + b" "
    for at in range(0, len(data) - 2, chunk):
        raw = np.frombuffer(data[at : at + chunk + 2], np.uint8)
        kind = _KIND[raw]
        fine = (kind[:-2] > 0) & (kind[1:-1] > 0) & (kind[2:] > 0) & ((kind[:-2] == 2) | (kind[1:-1] == 2) | (kind[2:] == 2))
        b = np.where(kind == 1, np.uint8(32), raw).astype(np.uint32)
        yield (((b[:-2] * np.uint32(0x9E3B) + b[1:-1] * np.uint32(0x85EB5) + b[2:] * np.uint32(0xC2B2AE3)) * np.uint32(0x27D4EB2F)) >> np.uint32(16))[fine]


def has_letters(text: bytes) -> bool:
    return any(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in set(text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = counts.setdefault(label, np.zeros(BUCKETS, np.int64))
            for grams in gram_buckets(text.as_py() or b""):
                own += np.bincount(grams, minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict(
        {"label": pa.array(list(counts), pa.string()), "counts": pa.array([c.tobytes() for c in counts.values()], pa.binary())}
    )


def primary(tag: Column) -> Column:
    """The language of a tag without its variants, in lower case: en of en-US and EN_gb; null if there is none."""
    plain = F.lower(F.trim(tag))
    first = F.regexp_extract(plain, r"\A((?:[ix][-_])?[^-_]+)", 1)
    return F.when(first != "", first)


def fit_text_model(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Trigram log-probabilities by declared language, and the level of an unknown one, from a bounded sample of ``rows`` (doc_id, declared, text).

    Every language that a row with text declares counts. Of each, about ``train_rows`` rows are drawn by a digest
    of id and text, or all if there are no more. A table of a fixed size for each language comes to the driver. The
    level is a log-probability for each language, between its own mean and that of trigrams it lacks.
    """
    told = rows.select("doc_id", primary(F.col("declared")).alias("declared"), "text").filter("declared is not null and text <> ''")
    sizes = {r[0]: r[1] for r in told.groupBy("declared").count().collect()}
    names = sorted(sizes)
    if not names:
        return ["und"], np.zeros((1, BUCKETS), np.float32), np.full(1, -np.inf)
    limits = [F.lit(x) for k in names for x in (k, int(min(1.0, train_rows / sizes[k]) * (1 << 20)) + 1)]
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(F.create_map(*limits), F.col("declared"))
    sample = told.filter(pick).select("declared", F.col("text").cast("binary").alias("text"))
    at, table = {k: i for i, k in enumerate(names)}, np.zeros((len(names), BUCKETS))
    # Part by part, as the driver needn't hold the counts of all tasks at once.
    shares = -(-train_rows // ROWS_A_TASK)
    dealt = sample.repartition(len(names) * shares, "declared", F.pmod(F.xxhash64("text"), F.lit(shares)))
    for label, counts in settle(dealt.mapInArrow(_count, "label string, counts binary")).toLocalIterator():
        table[at[label]] += np.frombuffer(counts, np.int64)
    share = table / np.maximum(table.sum(1, keepdims=True), 1.0)
    table += 0.5
    table /= table.sum(1, keepdims=True)
    logs = np.log(table, out=table)
    usual = (share * logs).sum(1)
    return names, logs.astype(np.float32), usual + UNKNOWN_LEVEL * (logs.min(1) - usual)


def text_posterior(text: bytes, table: np.ndarray, unknown: np.ndarray, evidence: float) -> np.ndarray:
    """P(language | text) with all languages and, last, an unknown one alike beforehand."""
    sums, n = np.zeros(len(table)), 0
    for grams in gram_buckets(text):
        n += len(grams)
        for k in range(len(table)):
            sums[k] += table[k].take(grams).sum(dtype=np.float64)
    logs = np.zeros(len(table) + 1)
    if n:
        best = int(sums.argmax())
        logs[:-1], logs[-1] = sums * (min(n, evidence) / n), unknown[best] * min(n, evidence)
    e = np.exp(logs - logs.max())
    return e / e.sum()


def _score(table: np.ndarray, unknown: np.ndarray, evidence: float, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py() or b"" for text in batch.column(0)]
            columns = [pa.array([text_posterior(t, table, unknown, evidence) for t in texts], pa.list_(pa.float64())), pa.array([has_letters(t) for t in texts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1 : 1 + kept], *columns], names=[*batch.schema.names[1 : 1 + kept], "p", "letters"]
            )

    return tidy(run)


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("p")[k]).alias(f"c{k}") for k in range(n)]


def _array(n: int) -> Column:
    return F.array(*[F.col(f"c{k}") for k in range(n)])


def _likelihood(scored: DataFrame, column: str, n: int, prior: float = 1.0) -> DataFrame:
    """log P(value of ``column`` | language) by grouped sums of the texts' posteriors."""
    by = settle(scored.filter(F.col(column).isNotNull()).groupBy(column).agg(*_sums(n)))
    totals = by.agg(F.count(F.lit(1)), *[F.sum(f"c{k}") for k in range(n)]).first()
    values = totals[0]
    return by.select(
        column,
        F.array(*[F.log((F.col(f"c{k}") + prior) / F.lit(float((totals[k + 1] or 0.0) + prior * max(1, values)))) for k in range(n)]).alias(f"{column}_log"),
    )


def identify_language(
    rows: DataFrame,
    train_rows: int = TRAIN_ROWS,
    min_posterior: float = MIN_POSTERIOR,
    evidence: float = EVIDENCE,
) -> DataFrame:
    """The language of each row of ``rows``: doc_id, text, declared, suffix, host, domain.

    declared is what the markup (or metadata) says, of which variants such as en-US are merged; suffix what the address ends in, host and
    domain where the text comes from; each may be null, then it is no evidence. A naive Bayes
    model of byte trigrams gives P(text | language) of the whole text, and one more class stands for what no modelled language explains,
    such as other languages and gibberish. From its posteriors, grouped
    sums give P(declared | language), P(suffix | language) and each host's prior, a
    host's counts being shrunk towards its domain's and those towards all, without the row itself.
    Their product is the posterior. A host's counts are all its rows', those of a domain all its hosts'; a host named with several
    domains belongs to each by the rows that name it.

    Returns doc_id, lang, confidence (its posterior), text_lang (by text alone) and rejected: no letters, or
    a posterior below ``min_posterior``, as of texts in no modelled language. Null, empty and letterless texts are rejected; their text says
    nothing, so lang is the best by the other evidence. Every row returns once, repeated ones too; null ids stay null. If no row declares a
    language, all are ``und``.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.withColumn("declared", primary(F.col("declared")))
    names, table, unknown = fit_text_model(rows.select("doc_id", "declared", "text"), train_rows)
    n = len(names) + 1  # the last stands for none of them
    keep = ["doc_id", "declared", "suffix", "host", "domain"]
    narrow = rows.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in keep[1:]])
    scored = settle(
        narrow.mapInArrow(_score(table, unknown, evidence, len(keep)), "doc_id long, declared string, suffix string, host string, domain string, p array<double>, letters boolean")
    )
    totals = scored.agg(*_sums(n)).first()
    whole = sum(totals[k] or 0.0 for k in range(n))
    everywhere = [((totals[k] or 0.0) + 1.0) / (whole + n) for k in range(n)]
    # A row's host counts are those of its (host, domain); the domain's are of all its hosts.
    hosts = settle(scored.filter("host is not null").groupBy(F.col("host").alias("own_host"), F.col("domain").alias("own_domain")).agg(*_sums(n)))
    domains = hosts.filter("own_domain is not null").groupBy(F.col("own_domain").alias("of_domain")).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(n)])
    domains = domains.select("of_domain", _array(n).alias("domain_counts"))
    hosts = settle(
        hosts.select("own_host", "own_domain", _array(n).alias("host_counts"))
        .join(domains, F.col("own_domain") == F.col("of_domain"), "left")
        .select("own_host", "own_domain", "host_counts", "domain_counts")
    )
    fused = (
        scored.join(_likelihood(scored, "declared", n), "declared", "left")
        .join(_likelihood(scored, "suffix", n), "suffix", "left")
        .join(hosts, (F.col("host") == F.col("own_host")) & F.col("domain").eqNullSafe(F.col("own_domain")), "left")
    )
    prior = F.array(*[F.lit(x) for x in everywhere])
    zero = F.array(*[F.lit(0.0)] * n)
    others = lambda counts: F.zip_with(F.coalesce(counts, F.col("p")), F.col("p"), lambda c, p: F.greatest(c - p, F.lit(0.0)))
    total = lambda counts: F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)

    def shrink(counts: str, weight: float, towards: str) -> Column:
        return F.zip_with(counts, towards, lambda c, t: (c + weight * t) / (F.col(f"{counts}_n") + weight))

    fused = (
        fused.withColumn("by_host", others(F.col("host_counts")))
        .withColumn("by_domain", others(F.col("domain_counts")))
        .withColumn("by_host_n", total("by_host"))
        .withColumn("by_domain_n", total("by_domain"))
        .withColumn("everywhere", prior)
        .withColumn("domain_prior", shrink("by_domain", DOMAIN_WEIGHT, "everywhere"))
        .withColumn("host_prior", shrink("by_host", HOST_WEIGHT, "domain_prior"))
    )
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = F.transform("p", lambda p: F.log(F.greatest(p, F.lit(1e-30))))
    for part in (F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero), F.transform("host_prior", lambda x: F.log(x))):
        logs = add(logs, part)
    known = lambda c: F.slice(c, 1, n - 1)
    best = lambda c: F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(known(c), F.array_max(known(c))).cast("int"))
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    mass = F.aggregate(F.transform("logs", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda s, x: s + x)
    return fused.withColumn("confidence", F.round(F.exp(F.array_max(known("logs")) - F.col("top")) / mass, 6)).select(
        "doc_id",
        best(F.col("logs")).alias("lang"),
        "confidence",
        F.when(F.col("letters"), best(F.col("p"))).alias("text_lang"),
        (~F.col("letters") | (F.col("confidence") < min_posterior)).alias("rejected"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source) as evidence: lang is declared and source the host. Only a source with a dot has a domain and a suffix."""
    from veldspar.llm.url_reputation import parents

    domain, suffix = parents(F.col("source"))
    dotted = lambda c: F.when(F.contains(F.col("source"), F.lit(".")), c)
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), dotted(suffix).alias("suffix"), F.col("source").alias("host"), dotted(domain).alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as evidence: the markup's lang, the address's suffix and host, the text without tags."""
    from veldspar.llm.url_reputation import parents, split_url

    host, path = split_url(F.col("url"))
    domain, suffix = parents(F.col("host"))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1))
    own = F.regexp_extract("path", r"\A/([a-z]{2})(?:/|\z)", 1)
    full = lambda c: F.when(c != "", c)
    return (
        pages.select("page_id", bare.alias("text"), declared.alias("declared"), host.alias("host"), path.alias("path"))
        .select(
            F.col("page_id").alias("doc_id"), "text", full(F.col("declared")).alias("declared"), F.concat_ws("/", suffix, own).alias("suffix"), full(F.col("host")).alias("host"), full(domain).alias("domain"),
        )
    )


def drop_unidentified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is identified; all rows of a doc_id go if each of them is rejected."""
    from veldspar.llm.store import written

    verdicts = identify_language(document_rows(docs), **options)
    gone = written(verdicts.groupBy("doc_id").agg(F.min("rejected").alias("gone")).filter("gone").select(F.col("doc_id").alias("gone_id")))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
