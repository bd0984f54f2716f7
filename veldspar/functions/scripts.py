"""Writing systems and whether a text looks like prose."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# Inclusive ranges of code points of each writing system, in order of precedence.
SCRIPTS: dict[str, tuple[tuple[int, int], ...]] = {
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF),),
    "Hebrew": ((0x0590, 0x05FF), (0xFB1D, 0xFB4F),),
    "Devanagari": ((0x0900, 0x097F),),
    "Bengali": ((0x0980, 0x09FF),),
    "Gurmukhi": ((0x0A00, 0x0A7F),),
    "Gujarati": ((0x0A80, 0x0AFF),),
    "Oriya": ((0x0B00, 0x0B7F),),
    "Tamil": ((0x0B80, 0x0BFF),),
    "Telugu": ((0x0C00, 0x0C7F),),
    "Kannada": ((0x0C80, 0x0CFF),),
    "Malayalam": ((0x0D00, 0x0D7F),),
    "Sinhala": ((0x0D80, 0x0DFF),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Lao": ((0x0E80, 0x0EFF),),
    "Tibetan": ((0x0F00, 0x0FFF),),
    "Myanmar": ((0x1000, 0x109F),),
    "Khmer": ((0x1780, 0x17FF),),
    "Hiragana": ((0x3040, 0x309F),),
    "Katakana": ((0x30A0, 0x30FF), (0x31F0, 0x31FF),),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF),),
    "Hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF),),
    "Cyrillic": ((0x0400, 0x04FF), (0x0500, 0x052F),),
    "Greek": ((0x0370, 0x03FF),),
    "Armenian": ((0x0530, 0x058F),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Latin": ((0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF),),
}
RANGES = {name: "".join(rf"\x{{{low:04X}}}-\x{{{high:04X}}}" for low, high in spans) for name, spans in SCRIPTS.items()}
# Pairs of letters that are common in European prose.
COMMON_PAIRS = (
    "th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar",
    "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "de", "la", "ch", "ei", "ie", "ge", "un", "ne", "me", "el",
)


@lru_cache(1)
def _ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last code points of all ranges in order, the writing system of each, and the digits of all systems."""
    rows = sorted((low, high, i) for i, spans in enumerate(SCRIPTS.values()) for low, high in spans)
    digits = [c for c in range(0x660, 0x11000) if unicodedata.category(chr(c)) == "Nd"]
    return *(np.array(x, np.int64) for x in zip(*rows, strict=True)), np.array(digits, np.int64)


@F.pandas_udf(ArrayType(IntegerType()))
def _tallies(texts: pd.Series) -> pd.Series:
    """Of each text: the characters of each writing system, and then which of its characters is the first of each; digits don't count."""
    first, last, owner, digits = _ranges()
    n = len(SCRIPTS)

    def tally(text: str | None) -> np.ndarray:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.searchsorted(first, points, side="right") - 1
        inside = (at >= 0) & (points <= last[at])
        if (points > 0x65F).any():
            inside &= ~np.isin(points, digits)
        found = owner[at[inside]]
        begins = np.full(n, len(points))
        which, where = np.unique(found, return_index=True)
        begins[which] = where
        return np.concatenate([np.bincount(found, minlength=n), begins]).astype(np.int32)

    return texts.map(tally)


def script_counts(text: Column) -> Column:
    """Characters of each writing system, as a map; systems without any are absent. Digits and white space don't count."""
    tallies = _tallies(text)
    pairs = F.array(*[F.struct(F.lit(name), F.get(tallies, F.lit(i))) for i, name in enumerate(SCRIPTS)])
    return F.map_from_entries(F.filter(pairs, lambda p: p["col2"] > 0))


def dominant_script(text: Column, least: int = 8) -> Column:
    """The most frequent writing system, the one met first among equals; null with fewer than ``least`` characters."""
    tallies, n = _tallies(text), len(SCRIPTS)
    each = F.array(*[F.struct(F.get(tallies, F.lit(i)).alias("n"), (-F.get(tallies, F.lit(n + i))).alias("first"), F.lit(name).alias("name")) for i, name in enumerate(SCRIPTS)])
    total = F.aggregate(F.slice(tallies, 1, n), F.lit(0), lambda s, x: s + x)
    return F.when(total >= least, F.array_max(each)["name"])


def coarse_script(text: Column) -> Column:
    """The first of four non-Latin systems of which the text holds a character, else Latin."""
    t = F.coalesce(text, F.lit(""))
    found = F.when(t.rlike(r"[\x{0600}-\x{06FF}]"), "Arabic").when(t.rlike(r"[\x{0900}-\x{097F}]"), "Devanagari")
    return found.when(t.rlike(r"[\x{0980}-\x{09FF}]"), "Bengali").when(t.rlike(r"[\x{4E00}-\x{9FFF}]"), "Han").otherwise("Latin")


_LETTERS, _PAIRS = re.compile("[^a-z\u00c0-\u024f]+"), re.compile(f"(?=(?:{'|'.join(COMMON_PAIRS)}))")


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("letters", "vowels", "pairs")]))
def _letter_counts(texts: pd.Series) -> pd.DataFrame:
    """Of each text: its letters in lower case, the vowels among them, and where a common pair starts (pairs overlap)."""
    letters = [_LETTERS.sub("", (t or "").lower()) for t in texts]
    return pd.DataFrame({"letters": [len(x) for x in letters], "vowels": [sum(map(x.count, "aeiou")) for x in letters], "pairs": [len(_PAIRS.findall(x)) for x in letters]})


def text_trust(text: Column, least: int = 100) -> Column:
    """Struct of letters, vowel_ratio, bigram_ratio and trusted; with few letters a text is trusted."""

    def judged(c: Column) -> Column:
        n = c["letters"]
        vowels, common = c["vowels"] / F.greatest(n, F.lit(1)), c["pairs"] / F.greatest(n - 1, F.lit(1))
        trusted = (n < least) | ((vowels >= 0.25) & (vowels <= 0.60) & (common >= 0.08))
        return F.struct(n.alias("letters"), F.round(vowels, 3).alias("vowel_ratio"), F.round(common, 3).alias("bigram_ratio"), trusted.alias("trusted"))

    return judged(_letter_counts(text))
