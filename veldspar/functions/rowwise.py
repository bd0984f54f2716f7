"""Work within one text at a time, in Arrow batches: chunks, keywords, summaries, trust, cleaning, hashed vectors.

As expressions these took ten times as long: Catalyst interprets lambdas over arrays of strings, and each of their steps copies and
scans anew. Here a text crosses to Python once, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from veldspar.functions.text import KEYWORD, KEYWORD_STOPWORDS, TOKEN

#: Characters of results that are handed on at a time, about.
PART = 4 << 20

_BLANKS, _LINES, _GAP, _SPACES = re.compile(r"[ \t]+"), re.compile(r"\n{3,}"), re.compile(r"\n\s*\n"), re.compile(r"\s+")
_TOKEN, _KEYWORD, _SENTENCE = re.compile(TOKEN), re.compile(KEYWORD), re.compile(r"(?<=[.!?])\s+")
_STOP = frozenset(KEYWORD_STOPWORDS)


def normalize(text: str | None) -> str:
    """As ``text.normalize_text``."""
    return _LINES.sub("\n\n", _BLANKS.sub(" ", (text or "").replace("\0", " "))).strip()


def token_list(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _cut(text: str, first: int) -> tuple[str, int, int]:
    inner = text.strip()
    start = first + len(text) - len(text.lstrip())
    return inner, start, start + len(inner)


def paragraphs(text: str) -> Iterator[tuple[str, int, int]]:
    """Stripped paragraphs (parted by blank lines) of a normalised text with their spans."""
    at = 0
    for gap in [*(m.span() for m in _GAP.finditer(text)), (len(text), len(text))]:
        part = _cut(text[at : gap[0]], at)
        if part[0]:
            yield part
        at = gap[1]


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """Chunks of a normalised text: paragraphs packed while they fit, longer ones cut in overlapping windows."""
    packed: list[tuple[str, int, int]] = []
    held = 0

    def flush() -> Iterator[tuple[str, int, int]]:
        if packed:
            yield "\n\n".join(p[0] for p in packed), packed[0][1], packed[-1][2]

    for part in paragraphs(text):
        long = len(part[0]) > size
        if packed and (long or held + 2 + len(part[0]) > size):
            yield from flush()
            packed, held = [], 0
        if long:
            step = size - overlap
            for at in range(0, max(0, -(-(len(part[0]) - size) // step)) * step + 1, step):
                window = _cut(part[0][at : at + size], part[1] + at)
                if window[0]:
                    yield window
        else:
            held += len(part[0]) + (2 if packed else 0)
            packed.append(part)
    yield from flush()


def keywords(text: str, limit: int) -> list[tuple[str, int]]:
    """The most frequent keyword terms of a normalised text and their numbers, ties by term."""
    counts = Counter(_KEYWORD.findall(text.lower()))
    for word in _STOP:
        counts.pop(word, None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:limit]


def word_cut(text: str, limit: int) -> str:
    return text[:limit].rsplit(" ", 1)[0]


def sentences(text: str) -> list[str]:
    """Sentences of a normalised text, its white space compacted; one overlong sentence is cut at a word."""
    found = [s for s in (x.strip() for x in _SENTENCE.split(_SPACES.sub(" ", text).strip())) if s]
    return [word_cut(found[0], 700).strip()] if len(found) == 1 and len(found[0]) > 700 else found


def summary(text: str, terms: int = 12, most: int = 3, limit: int = 600) -> tuple[str, list[str]]:
    """The sentences that share most keywords, in text order, and the keywords."""
    words = [w for w, _ in keywords(text, terms)]
    known = set(words)
    scored = [(-len(known.intersection(token_list(s))) - (i == 0), i, s) for i, s in enumerate(sentences(text))]
    joined = " ".join(s for _, _, s in sorted(sorted(scored)[:most], key=lambda x: x[1])).strip()
    return (word_cut(joined, limit).strip() + "..." if len(joined) > limit else joined), words


def each(rows: DataFrame, text: str, schema: str, make: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """The other columns of ``rows`` with each tuple that ``make`` gives of a row's text; ``schema`` names the new columns."""
    kept = [c for c in rows.columns if c != text]
    kinds = dict(rows.dtypes)
    whole = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), schema])
    new = StructType.fromDDL(schema).fields
    types = [to_arrow_type(f.dataType) for f in new]
    names = [*kept, *(f.name for f in new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            made: list[tuple] = []
            size = 0
            for i, value in enumerate(batch.column(len(kept))):
                for row in make(value.as_py()):
                    at.append(i)
                    made.append(row)
                    size += sum(len(x) if isinstance(x, (str, list)) else 8 for x in row)
                if size > PART:
                    yield out(batch, at, made)
                    at, made, size = [], [], 0
            if at:
                yield out(batch, at, made)

    def out(batch: pa.RecordBatch, at: list[int], made: list[tuple]) -> pa.RecordBatch:
        own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))], names=names)

    return rows.select(*kept, text).mapInArrow(run, whole)


def token_slot(token: str, dimensions: int) -> tuple[int, int]:
    """Bucket and sign of a token."""
    digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dimensions, 1 if digest[4] & 1 else -1


class Embedder:
    """Signed, hashed token counts of unit length; zeros for a text without tokens. A token's slot is found once while it is remembered."""

    def __init__(self, dimensions: int, remember: int = 500_000) -> None:
        self.dimensions, self.remember = dimensions, remember
        self.slots: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        vector = np.zeros(self.dimensions)
        for token in token_list(text):
            slot = self.slots.get(token)
            if slot is None:
                if len(self.slots) >= self.remember:
                    self.slots.clear()
                slot = self.slots[token] = token_slot(token, self.dimensions)
            vector[slot[0]] += slot[1]
        norm = np.sqrt((vector * vector).sum())
        return vector / norm if norm > 0 else vector
