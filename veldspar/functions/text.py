"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two stopword lists of the data model differ on purpose.
KEYWORD_STOPWORDS = (
    "about", "after", "also", "and", "are", "because", "before", "can", "from", "has", "have", "into",
    "is", "it", "its", "of", "or", "that", "the", "this", "to", "with",
)
QUERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "for", "how", "in", "is", "of", "on", "or", "the", "to",
    "what", "when", "where", "which", "who", "why",
)

TOKEN = r"[a-zA-Z0-9_]+"
KEYWORD = r"[a-zA-Z][a-zA-Z0-9_-]{2,}"
SENTENCE_END = r"(?<=[.!?])(?U)\s+"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def compact(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """NUL as a space, runs of spaces and tabs as one, at most two line feeds in a row, stripped."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u0000", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def tokens(text: Column) -> Column:
    """ASCII word tokens of the lower-cased text, in order, repeated."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def meaningful_terms(text: Column) -> Column:
    """Distinct tokens of two characters or more that aren't query stopwords."""
    stop = F.array(*[F.lit(w) for w in QUERY_STOPWORDS])
    return F.array_except(F.filter(token_set(text), lambda t: F.length(t) > 1), stop)


def keyword_terms(text: Column) -> Column:
    """Terms that may be keywords, in order, repeated."""
    found = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*KEYWORD_STOPWORDS))


def split_sentences(text: Column) -> Column:
    """Stripped sentences, without empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def answer_sentences(answer: Column) -> Column:
    """Sentences of an answer's lines, without labels and list marks."""
    lines = F.transform(F.split(answer, r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"), strip)
    kept = F.filter(lines, lambda s: (s != "") & (F.lower(s) != "answer:") & ~F.lower(s).startswith("sources:"))
    plain = F.transform(kept, lambda s: F.when(s.startswith("- "), strip(F.substring(s, 3, 1 << 30))).otherwise(s))
    return split_sentences(F.array_join(plain, " "))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", " ")


def citation_numbers(text: Column) -> Column:
    """Every number cited as ``[n]``, in order, repeated."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def word_cut(text: Column, limit: Column | int) -> Column:
    """The first ``limit`` characters, back to the last space if there is one."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.regexp_replace(F.left(text, limit), r" [^ ]*\z", "")


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(strip(word_cut(text, limit)), F.lit("..."))).otherwise(text)


def filename_text(name: Column) -> Column:
    """File names and queries in the form in which they are compared."""
    plain = F.translate(F.lower(name), "\\/", "  ")
    return F.array_join(F.regexp_extract_all(plain, F.lit(r"[a-zA-Z0-9_.-]+"), F.lit(0)), " ")


def stem(filename: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]+\z", "")


def keyword_query(text: Column, most: int = 16) -> Column:
    """The terms of a keyword query: letters, digits and underscores only, two or more, the first ``most``, repeats kept."""
    words = F.split(compact(F.translate(text, "\"'", "  ")), " ")
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\p{L}\p{N}_]", "")))
    return F.slice(F.filter(plain, lambda w: F.length(w) >= 2), 1, most)


def clean_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, distinct tags of at most 80 characters, the first 20."""
    plain = F.transform(tags, lambda t: F.left(compact(F.lower(t)), F.lit(80)))
    return F.slice(F.array_distinct(F.filter(plain, lambda t: t != "")), 1, 20)


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / F.greatest(union, F.lit(1))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if empty or if either norm is 0."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    times = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    norm = F.sqrt(total(times(left, left))) * F.sqrt(total(times(right, right)))
    return F.when((n > 0) & (norm > 0), total(times(left, right)) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)
