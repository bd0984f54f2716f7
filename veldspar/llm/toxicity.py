"""Toxicity by a linear-chain conditional random field over the tokens of a text."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.kernels import tidy
from veldspar.llm.store import small_batches

#: Labelled documents that the model learns from, of each class at most, and the characters of their texts in all, about.
TRAIN_PER_CLASS, TRAIN_CHARS = 3000, 12_000_000
WEIGHTS = 1 << 18
EPOCHS, SENTENCE = 60, 24
#: A kind of token is taken for toxic if at least so many toxic training documents hold it, toxic ones hold it so many times
#: as often as clean ones, and chance would give less than so many such kinds in all.
LEAST_DOCS, LEAST_LIFT, CHANCE = 4, 5.0, 0.05
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’…*_~`|/\\-+=#"
TOKEN = re.compile(r"\S+")
CACHE = 500_000


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a token: itself, its beginnings and its end, in lower case and without punctuation."""
    w = word.strip(EDGES).lower()
    kinds = [f"w:{w}", *(f"{n}:{w[:n]}" for n in (3, 4, 5, 6)), f"e:{w[-3:]}"]
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % WEIGHTS for k in kinds)


@dataclass
class Chain:
    """Weights of features for the toxic tag, scores of tag pairs [from][to], and the document's logistic layer."""

    weights: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0, 0.0]))


def messages(odds: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Ratios of the two tags' forward messages along chains laid end to end.

    ``odds`` are the tokens' odds of the toxic tag, ``first`` marks where chains begin. All tokens
    are updated at once from their left neighbours, again and again until nothing
    changes: each sweep carries evidence one token further, and it fades with distance.
    """
    m = np.exp(pairs)
    start = np.where(first, odds, 0.0)
    inner = ~first
    now = odds.copy()
    for _ in range(len(odds)):
        before = np.empty_like(now)
        before[0] = 0.0
        before[1:] = now[:-1]
        after = np.where(inner, odds * (m[0, 1] + m[1, 1] * before) / (m[0, 0] + m[1, 0] * before), start)
        change = np.abs(after - now) > 1e-9 * (after + 1e-9)
        now = after
        if not change.any():
            break
    return now


def marginals(odds: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: P(toxic) of every token, and the ratios of forward and backward messages."""
    if not len(odds):
        return odds, odds, odds
    forward = messages(odds, first, pairs)
    last = np.empty_like(first)
    last[:-1] = first[1:]
    last[-1] = True
    backward = messages(odds[::-1], last[::-1], pairs.T)[::-1]
    both = np.clip(forward, 1e-300, 1e300) * (np.clip(backward, 1e-300, 1e300) / np.clip(odds, 1e-300, 1e300))
    return both / (1 + both), forward, backward


def _clip_odds(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores, -30, 30))


def kinds_of(word: str) -> tuple[str, ...]:
    """What a token of four letters or more may be known by: itself and its longer beginnings."""
    w = word.strip(EDGES).lower()
    return tuple(dict.fromkeys((w + "$", *(w[:n] for n in (4, 5, 6) if n <= len(w))))) if len(w) >= 4 else ()


def label_kinds(docs: list[tuple[np.ndarray, int]], names: list[str]) -> set[str]:
    """Kinds that tell a toxic token, as clean documents (nearly) lack them.

    ``docs`` have numbers of words in ``names``. Copies would make any word of theirs look
    telling, so documents alike in their four smallest word digests count once.
    """
    seen, met = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    known = [kinds_of(w) for w in names]
    digests = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in names], np.int64)
    groups: set[tuple] = set()
    for words, toxic in docs:
        distinct = np.unique(words)
        group = (toxic, *np.sort(digests[distinct])[:4].tolist())
        if group in groups:
            continue
        groups.add(group)
        met[toxic] += 1
        kinds: set[str] = set()
        for w in distinct.tolist():
            kinds.update(known[w])
        seen[toxic].update(kinds)
    if not met[0] or not met[1]:
        return set()
    base = met[1] / (met[0] + met[1])
    least = 2 * math.log(max(1, len(seen[1])) / CHANCE)

    def surprise(n: int, clean: int) -> float:
        """Likelihood ratio of the share of toxic documents among those that hold a kind, against the share in all."""
        share = n / (n + clean)
        return 2 * (n * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0))

    lift = lambda n, clean: (n / met[1]) / ((clean + 0.5) / met[0])
    return {k for k, n in seen[1].items() if n >= LEAST_DOCS and lift(n, seen[0][k]) >= LEAST_LIFT and surprise(n, seen[0][k]) >= least}


def fit(docs: Iterable[tuple[str, int]], epochs: int = EPOCHS, base_rate: float | None = None) -> Chain:
    """Train on texts with document labels.

    Tokens are labelled first: in toxic documents, those of a kind that sets them apart. The chain
    then learns tags from tokens' features and neighbours by gradient ascent on the
    conditional likelihood of sentences; a logistic layer learns documents from its marginals.
    Texts are held as numbers of their words, so that the driver needs little memory.
    """
    chain, vocabulary = Chain(np.zeros(WEIGHTS)), {}
    words = [(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in TOKEN.findall(t)], np.int32), int(y)) for t, y in docs]
    names = list(vocabulary)
    if not names or len({y for _, y in words}) < 2:
        return chain
    kinds = label_kinds(words, names)
    known = np.array([features(w) for w in names], np.int32)
    telling = np.array([not kinds.isdisjoint(kinds_of(w)) for w in names])
    rng = np.random.default_rng(11)
    rows, tags, first = [], [], []
    for tokens, toxic in words:
        for at in range(0, len(tokens), SENTENCE):
            span = tokens[at : at + SENTENCE]
            own = telling[span] & bool(toxic)
            if own.any() or rng.random() < 0.12:
                rows.append(span)
                tags.append(own)
                first.append(np.arange(len(span)) == 0)
    if not rows:
        return chain
    x, y, starts = known[np.concatenate(rows)], np.concatenate(tags).astype(float), np.concatenate(first)
    g2, gp2 = np.full(WEIGHTS, 1e-8), np.full((2, 2), 1e-8)
    linked = ~starts[1:]
    was, now = y[:-1][linked], y[1:][linked]
    seen_pairs = np.array([[((1 - was) * (1 - now)).sum(), ((1 - was) * now).sum()], [(was * (1 - now)).sum(), (was * now).sum()]])
    for _ in range(epochs):
        p, forward, backward = marginals(_clip_odds(chain.weights[x].sum(1) - 3.0), starts, chain.pairs)
        m = np.exp(chain.pairs)
        f, b = forward[:-1][linked], backward[1:][linked]
        joint = np.stack([m[0, 0] * np.ones_like(f), m[0, 1] * b, m[1, 0] * f, m[1, 1] * f * b])
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        grad = -0.02 * chain.weights
        for k in range(x.shape[1]):
            grad += np.bincount(x[:, k], y - p, WEIGHTS)
        g2 += grad**2
        chain.weights += 0.5 * grad / np.sqrt(g2)
        pair_grad = seen_pairs - expected - 0.5 * chain.pairs
        gp2 += pair_grad**2
        chain.pairs += 0.2 * pair_grad / np.sqrt(gp2)
    odds = _clip_odds(chain.weights[known].sum(1) - 3.0)
    layer_x = []
    for tokens, _ in words:
        start = np.zeros(len(tokens), bool)
        start[:1] = True
        layer_x.append(summary(marginals(odds[tokens], start, chain.pairs)[0], len(tokens)))
    chain.layer = fit_layer(np.stack(layer_x), np.array([t for _, t in words], float), base_rate)
    return chain


def summary(p: np.ndarray, n: int) -> np.ndarray:
    """What the logistic layer sees: 1, the largest marginal, and the sure ones by number and by share."""
    sure = float(np.where(p > 0.05, p, 0.0).sum())
    return np.array([1.0, float(p.max()) if n else 0.0, math.log1p(sure), 100 * sure / (n + 50)])


def fit_layer(x: np.ndarray, y: np.ndarray, base_rate: float | None) -> np.ndarray:
    """Logistic regression with a ridge, classes weighed to the base rate, by Newton's method."""
    rate = y.mean() if base_rate is None else min(0.999, max(0.001, base_rate))
    weight = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    beta, ridge = np.zeros(x.shape[1]), 1e-5 * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class _Odds(dict):
    """Odds of tokens by their text, computed once while they are remembered."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        self[word] = odds = math.exp(min(30.0, max(-30.0, float(self.weights[list(features(word))].sum()) - 3.0)))
        return odds


def _score(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Odds(chain.weights)
        for batch in batches:
            at = 0
            while at < len(batch):
                texts, size, from_ = [], 0, at
                while at < len(batch) and (size < 1 << 20 or not texts):
                    texts.append(batch.column(2)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                scores, spans = _score_texts(chain, known, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(from_, at - from_),
                        batch.column(1).slice(from_, at - from_),
                        pa.array(scores, pa.float64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "held_out", "score", "spans"],
                )

    return tidy(run)


def _score_texts(chain: Chain, known: _Odds, texts: list[str]) -> tuple[list[float], list[list[dict]]]:
    tokens = [t.split() for t in texts]
    lengths = np.array([len(t) for t in tokens])
    ends = np.cumsum(lengths)
    odds = np.fromiter((known[w] for t in tokens for w in t), float, int(ends[-1]) if len(ends) else 0)
    first = np.zeros(len(odds), bool)
    first[(ends - lengths)[lengths > 0]] = True
    p = marginals(odds, first, chain.pairs)[0]
    scores, spans = [], []
    for text, n, end in zip(texts, lengths, ends, strict=True):
        own = p[end - n : end]
        scores.append(float(1 / (1 + math.exp(-min(30.0, max(-30.0, float(summary(own, int(n)) @ chain.layer)))))))
        toxic = np.flatnonzero(own >= 0.5)
        found: list[dict] = []
        if len(toxic):
            chosen = set(toxic.tolist())
            for k, m in enumerate(TOKEN.finditer(text)):
                if k in chosen:
                    if found and k - 1 in chosen:
                        found[-1]["end"] = m.end()
                    else:
                        found.append({"start": m.start(), "end": m.end()})
        spans.append(found)
    return scores, spans


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, chars: int = TRAIN_CHARS) -> Chain:
    """Fit on ``per_class`` labelled documents of each class at most, chosen by a digest of doc_id, of about ``chars`` characters in all.

    ``labels`` has doc_id and toxic; of several labels of a document the toxic one holds, and of several texts of
    a doc_id the first in order. The ids are bounded by ``per_class``, so they are broadcast to find the lengths of their texts;
    half of ``chars`` goes to each class, in the order of the digest. A text that is longer than that is not learnt from.
    """
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in told.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Chain(np.zeros(WEIGHTS))
    chosen = None
    for toxic in (0, 1):
        part = told.filter((F.col("toxic") > 0) == F.lit(bool(toxic))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = docs.filter("text is not null").select("doc_id", "text", F.length("text").alias("n")).filter(F.col("n") <= chars // 2)
    sizes = known.select("doc_id", "n", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("h", "n")).alias("one"))
    fits, used = {}, [0, 0]
    for doc_id, toxic, one, _ in sizes.select("doc_id", "toxic", "one", F.xxhash64("doc_id").alias("d")).orderBy("d", "doc_id").collect():
        if used[toxic] + one["n"] <= chars // 2:
            used[toxic] += one["n"]
            fits[doc_id] = (toxic, one["h"])
    if len({toxic for toxic, _ in fits.values()}) < 2:
        return Chain(np.zeros(WEIGHTS))
    wanted = docs.sparkSession.createDataFrame([(k, h) for k, (_, h) in fits.items()], "doc_id long, h long")
    texts = known.join(F.broadcast(wanted), "doc_id").filter(F.xxhash64("text") == F.col("h")).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.toArrow().sort_by("doc_id")
    pairs = ((t.as_py(), fits[k][0]) for k, t in zip(rows["doc_id"].to_pylist(), rows["text"], strict=True))
    return fit(pairs, base_rate=totals[1] / (totals[0] + totals[1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, toxic).

    Documents whose crc32 of doc_id as text leaves 1 by 3 are held out: their labels are not learnt from.
    Returns doc_id, held_out, score, predicted (score >= 0.7) and spans, the code points (end
    exclusive) of the runs of tokens tagged toxic. Null texts count as empty; an empty
    text has the score of a text without toxic tokens. Rows with a null doc_id are scored and not held out. Without labels
    of both classes all scores are near 0. Every row returns once.
    """
    small_batches(docs.sparkSession)
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))
    chain = train(docs, labels.filter(~held(F.col("doc_id"))), per_class)
    return (
        docs.select("doc_id", held(F.col("doc_id")).alias("held_out"), "text")
        .mapInArrow(_score(chain), "doc_id long, held_out boolean, score double, spans array<struct<start:bigint,end:bigint>>")
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
    )
