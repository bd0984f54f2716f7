"""Packing documents into token sequences along a Hilbert curve."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from veldspar.llm.kernels import mix, tidy
from veldspar.llm.store import small_batches, written

SEQUENCE = 4096
END_ID = 2
#: Hashed features of a document's vector, dimensions of its projection, bits of each.
FEATURES, DIMENSIONS, BITS = 512, 3, 12
#: Tokens that one task packs, about.
TASK_TOKENS = 8_000_000
#: Stretches of the curve whose tokens the driver sums up.
MOST_STRETCHES = 1 << 20
#: Distinct chunks of text whose ids a worker remembers; when so many have come, those before them go.
WORDS = 600_000
#: Bytes that a remembered chunk takes with its ids, on average at most: of longer ones, as of texts without spaces, fewer are remembered.
CHUNK_BYTES = 128
#: A chunk that is one token and hardly occurs.
MARK = "~"

ENCODED = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


#: Of Latin-1 bytes: letters in lower case, and line feeds as spaces.
_FOLD = bytes(32 if c == 10 else ord(chr(c).lower()) for c in range(256))
#: Bytes of which it isn't plain whether they are marks: controls but for tabs and returns, no-break space, soft hyphen.
_DOUBTFUL = bytes(c for c in range(256) if (c < 32 and c not in (9, 10, 13)) or 127 <= c <= 160 or c == 173)
#: Kinds of bytes after that: white space, letters and digits, stops and commas, other marks, doubtful ones.
_KIND = bytes(63 if c in _DOUBTFUL else 32 if c in (9, 10, 13, 32) else 97 if chr(c).isalnum() else 46 if c in b".," else 120 for c in range(256))
_MARKS = "".join(f"\\x{c:02x}" for c in range(33, 256) if not chr(c).isalnum() and c != 39 and c not in _DOUBTFUL)
#: Whole runs of marks without an apostrophe, which may begin a contraction.
_RUN = re.compile(f"(?<![{_MARKS}'])[{_MARKS}]++(?!')".encode("ascii"))


#: A pattern of pieces under which a run of letters is one piece.
_LETTERS_WHOLE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _for_letters(path: str):
    """The tokenizer without its patterns, for runs of letters in lower case, of which they'd leave each as it is; None if its file has others."""
    from tokenizers import Tokenizer

    rules = json.loads(Path(path).read_text("utf-8"))
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
    forms = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers") or []]
    if [x.get("type") for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"].get("Regex") != _LETTERS_WHOLE or steps[1].get("use_regex") or forms != ["NFC", "Replace", "Lowercase"]:
        return None
    return Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}))


class ChunkEncoder:
    """Token ids of texts, by the chunks between plain spaces and line feeds.

    The tokenizer drops white space, lets no token cross it and doesn't tell cases apart, so a
    text's ids are those of its chunks one after the other. Each distinct chunk is encoded once
    while it is remembered, which both the number of chunks and their bytes bound. The tokenizer parts runs of marks from letters and digits too, so where a text has only Latin-1 characters
    these runs are chunks of their own, and the case is dropped before: this leaves fewer chunks to tell apart and the same ids.
    """

    def __init__(self, path: str, remember: int = WORDS) -> None:
        self.remember = remember
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _for_letters(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        #: Chunks as bytes where the text was taken as Latin-1, else as they stand.
        self.known: dict[bytes | str, bytes] = {b"": b"", "": b""}
        self.former: dict[bytes | str, bytes] = {}
        #: Bytes of what is known, with its ids.
        self.held = 0

    def _split(self, text: str) -> list:
        try:
            low = text.encode("latin-1").translate(_FOLD)
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        kinds = low.translate(_KIND)
        if b"?" in kinds or b"<|" in low:
            return text.replace("\n", " ").split(" ")
        if b"x." in kinds or b".x" in kinds or b".." in kinds:
            return _RUN.sub(rb" \g<0> ", low).split()
        return low.replace(b".", b" .").replace(b",", b" ,").split(b" ")  # the same where stops and commas stand alone, and faster

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian and ``width`` bytes each."""
        if len(self.known) > self.remember or self.held > self.remember * CHUNK_BYTES:
            self.former, self.known, self.held = self.known, {b"": b"", "": b""}, 0
        split = [self._split(t) for t in texts]
        known, former = self.known, self.former
        flat = list(chain.from_iterable(split))
        ids = list(map(known.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        fresh = {flat[i] for i in missing}
        if former:
            known.update((w, former[w]) for w in fresh if w in former)
        self._learn([w for w in fresh if w not in known])
        self.held += sum(map(sys.getsizeof, fresh)) + sum(map(sys.getsizeof, map(known.__getitem__, fresh)))
        for i in missing:
            ids[i] = known[flat[i]]
        ends = list(accumulate(map(len, split)))
        return [b"".join(ids[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def _learn(self, fresh: list) -> None:
        """Encode chunks many at a time; those that were taken as Latin-1 and are letters only need no patterns."""
        plain, rest = [], []
        for w in fresh:
            text = w if isinstance(w, str) else w.decode("latin-1")
            (plain if self.letters is not None and text is not w and text.isalpha() else rest).append((w, text))
        self._encode(plain, self.letters)
        self._encode(rest, self.tokenizer)

    def _encode(self, pairs: list[tuple], tokenizer) -> None:
        """Learn chunks (and their texts) with a mark between them that none of them holds."""
        kind, mark = f"<u{self.width}", self.mark
        for at in range(0, len(pairs), 20_000):
            part, texts = zip(*pairs[at : at + 20_000], strict=True)
            found = np.array(tokenizer.encode_batch_fast([f" {MARK} ".join(texts)], add_special_tokens=False)[0].ids, kind)
            cuts = np.flatnonzero(found == mark)
            if len(cuts) == len(part) - 1:
                ids, width = found.tobytes(), self.width
                starts = [0, *((cuts + 1) * width).tolist()]
                ends = [*(cuts * width).tolist(), len(ids)]
                self.known.update(zip(part, map(ids.__getitem__, map(slice, starts, ends)), strict=True))
            else:  # some chunk holds the mark itself
                each = tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
                self.known.update((w, np.array(x.ids, kind).tobytes()) for w, x in zip(part, each, strict=True))


@lru_cache(1)
def encoder_of(path: str, remember: int) -> ChunkEncoder:
    """The encoder of this worker, whose memory lasts from task to task."""
    return ChunkEncoder(path, remember)


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points (n x d, unsigned integers of ``bits`` bits).

    Axes become the transposed index by undoing rotations from the top bit down, then Gray
    decoding (Skilling, 2004); interleaving its bits gives the index.
    """
    x = coordinates.T.astype(np.uint64).copy()
    d = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        low = q - np.uint64(1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip = np.where((x[d - 1] & q) != 0, flip ^ (q - np.uint64(1)), flip)
        q >>= np.uint64(1)
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return out.astype(np.int64)


def curve_keys(ids: list[np.ndarray], features: int = FEATURES, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents: hashed token counts of unit length, projected at random and squashed to a grid."""
    lengths = np.array([len(x) for x in ids])
    tokens = np.concatenate(ids).astype(np.uint64)
    owner = np.repeat(np.arange(len(ids)), lengths)
    feature = (mix(tokens) % np.uint64(features)).astype(np.int64)
    counts = np.bincount(owner * features + feature, minlength=len(ids) * features).reshape(len(ids), features)
    vector = np.sqrt(counts)
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
    axes = np.random.default_rng(7).standard_normal((features, dimensions))
    axes -= axes.mean(0)  # else what all documents share would move them alike
    place = 1 / (1 + np.exp(-2.0 * (vector @ axes)))
    return hilbert_index(np.minimum((place * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _encode(path: str, end_id: int, remember: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and walking all remembered words again and again takes a tenth of the time
        try:
            yield from encoded(batches)
        finally:
            gc.enable()  # workers go on to tasks of other stages

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, remember) if keep else ChunkEncoder(path, remember)
        kind = f"<u{encoder.width}"
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            whole, at = batch.column(1).to_pylist(), 0
            while at < len(batch):
                texts, size, first = [], 0, at
                while at < len(batch) and (size < 1 << 19 or not texts):
                    texts.append(whole[at] or "")
                    size += len(texts[-1])
                    at += 1
                ids = [b + end for b in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, at - first),
                        pa.array(curve_keys([np.frombuffer(b, kind) for b in ids])),
                        pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                        pa.array([len(b) // encoder.width for b in ids], pa.int64()),
                        pa.array([bytes([encoder.width]) + b for b in ids], pa.binary()),
                    ],
                    schema=ENCODED,
                )

    return run if keep else tidy(run)


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1).astype("<u4")


def _pack(length: int):
    """Lay the documents of a task end to end and cut the line into sequences.

    What is left at the end of the task is cut at powers of two, which need no padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # pieces of the sequence being filled
        filled, rows = 0, []

        def close(pieces: list, size: int) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, total, ids in pieces:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + number, offset))
                offset += len(ids)
            assert offset == size
            number += 1

        def emit() -> pa.RecordBatch:
            nonlocal rows
            out, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, start = _wide(ids.as_py()), 0
                total = len(ids)
                while start < total:
                    take = min(length - filled, total - start)
                    held.append((doc_id, start, total, ids[start : start + take]))
                    start, filled = start + take, filled + take
                    if filled == length:
                        close(held, length)
                        held, filled = [], 0
                        if len(rows) >= 5000:
                            yield emit()
        while filled:
            size, used, part, rest = 1 << (filled.bit_length() - 1), 0, [], []
            for doc_id, start, total, ids in held:
                take = min(size - used, len(ids))
                if take:
                    part.append((doc_id, start, total, ids[:take]))
                if take < len(ids):
                    rest.append((doc_id, start + take, total, ids[take:]))
                used += take
            close(part, size)
            held, filled = rest, filled - size
        if rows:
            yield emit()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, task_tokens: int = TASK_TOKENS, remember: int = WORDS, keep: bool = True
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``length`` tokens (a power of two), neighbours on the curve together.

    ``tokenizer`` is the path of a tokenizer file whose tokens never cross white space; a worker remembers
    the ids of ``remember`` to twice as many chunks of text (fewer if they are long), with ``keep`` from task to task, which trades memory for time. Documents, each with ``end_id``
    behind its ids, are range-sorted by Hilbert key; ties, as of copies, fall by a digest of the ids and the doc_id,
    so copies of one text are no single range. Ranges hold about ``task_tokens`` tokens each. A task lays its range end to end: only its last sequences
    are shorter than ``length``, of powers of two, so nothing is padded.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null
    or empty text is its end id alone; repeated rows are packed each; null ids stay null.
    """
    small_batches(docs.sparkSession)
    encoded = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _encode(tokenizer, end_id, remember, keep), "doc_id long, curve long, tie long, n_tokens long, ids binary"
        )
    )
    tasks, deal = ranges(encoded, task_tokens)
    ordered = encoded.withColumn("deal", F.xxhash64("tie", "doc_id"))
    return (
        ordered.withColumn("task", deal(F.col("curve"), F.col("deal")))
        .repartitionById(tasks, "task")
        .sortWithinPartitions("curve", "deal", "doc_id")
        .select("doc_id", "ids")
        .mapInArrow(_pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )


def ranges(encoded: DataFrame, task_tokens: int) -> tuple[int, Callable[[Column, Column], Column]]:
    """How many tasks share the curve, about ``task_tokens`` tokens each, and which of them a document goes to by its key and a digest.

    Tokens are summed by stretches of the curve, about four to a task: documents of one kind are alike in length, so ranges of as many
    documents would differ widely. Neighbouring stretches are joined up to a task's share; one that holds more, as that of a text with very many
    copies, is dealt to several tasks by the digest. The driver gets a number for each stretch, ``MOST_STRETCHES`` at most.
    """
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    wanted = max(1, -(-4 * total // task_tokens))
    bits = DIMENSIONS * BITS - min(MOST_STRETCHES, max(1, wanted)).bit_length()
    sums = encoded.groupBy(F.shiftright("curve", bits).alias("stretch")).agg(F.sum("n_tokens").alias("n")).toArrow().sort_by("stretch")
    stretches, first, parts = np.asarray(sums["stretch"]), np.zeros(len(sums), np.int64), np.ones(len(sums), np.int64)
    task, filled = 0, 0
    for i, n in enumerate(sums["n"].to_pylist()):
        if filled and filled + n > task_tokens:
            task, filled = task + 1, 0
        first[i] = task
        filled += n
        if n > task_tokens:
            parts[i] = -(-n // task_tokens)
            task, filled = task + parts[i], 0

    @F.pandas_udf(IntegerType())
    def deal(curve: pd.Series, digest: pd.Series) -> pd.Series:
        at = np.searchsorted(stretches, curve.to_numpy() >> bits)
        return pd.Series((first[at] + digest.to_numpy() % parts[at]).astype(np.int32))

    return int(max(1, task + bool(filled))), deal
