"""Fragments of DuckDB SQL that say in SQL what the operators say in Spark."""

from __future__ import annotations

from veldspar.functions.text import KEYWORD_STOPWORDS, QUERY_STOPWORDS

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def normalize(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def compact(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-Z0-9_]+')"


def token_set(x: str) -> str:
    return f"list_distinct({tokens(x)})"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def meaningful(x: str) -> str:
    return f"list_filter({token_set(x)}, lambda t: length(t) > 1 and t not in ({_quoted(QUERY_STOPWORDS)}))"


def keyword_terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-zA-Z][a-zA-Z0-9_-]{{2,}}'), lambda t: t not in ({_quoted(KEYWORD_STOPWORDS)}))"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def word_cut(x: str, n: int | str) -> str:
    return f"regexp_replace(left({x}, {n}), ' [^ ]*$', '')"


def excerpt(x: str, n: int) -> str:
    return f"case when length({x}) > {n} then {strip(word_cut(x, n))} || '...' else {x} end"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


#: Documents as chunks; they have no blank lines, so each is one paragraph that windows cut.
CHUNKS = f"""
norm as (select doc_id, source, {normalize('text')} as t from documents),
cut as (select doc_id, source, t, unnest(generate_series(0, cast(ceil(greatest(length(t) - 900, 0) / 720.0) as int))) as i from norm),
raw as (select doc_id, source, cast(i as int) as chunk_index, substr(t, i * 720 + 1, 900) as r, i * 720 as first from cut where t <> ''),
chunks as (
  select doc_id || ':' || chunk_index as chunk_id, doc_id as file_id, source || '-' || doc_id || '.txt' as filename, source, chunk_index, {strip('r')} as text,
    cast(first + length(r) - length(ltrim(r, {SPACE})) as int) as start_char,
    cast(first + length(rtrim(r, {SPACE})) as int) as end_char
  from raw)"""
QUERIES = "queries as (select item_id as query_id, text as query from benchmark)"
LEXICAL = f"""
q as (select query_id, {token_set('query')} as terms from queries),
qt as (select query_id, len(terms) as size, unnest(terms) as token from q),
ct as (select chunk_id, unnest({token_set('text')}) as token from chunks),
lexical as (select query_id, chunk_id, count(*) / greatest(any_value(size), 1) as lexical_score from ct join qt using (token) group by query_id, chunk_id)"""
BM25 = r"""
words as (select chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from chunks),
stats as (select count(*) as n, avg(len(w)) as average from words),
post as (select chunk_id, len(w) as length, unnest(w) as term from words),
tf as (select chunk_id, length, term, count(*) as tf from post group by all),
df as (select term, count(*) as df from tf group by term),
asked as (
  select query_id, term, count(*) as times from (
    select query_id, unnest(list_filter(list_transform(string_split(trim(regexp_replace(translate(query, '"''', '  '), '\s+', ' ', 'g')), ' '),
      lambda w: lower(regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g'))), lambda w: length(w) >= 2)[1:16]) as term from queries)
  group by all),
weighted as (select query_id, term, times, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end as idf from asked join df using (term), stats),
bm25 as (
  select query_id, chunk_id, round(sum(times * idf * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average))), 9) as score
  from tf join weighted using (term), stats group by query_id, chunk_id)"""


def quoted(questions: str) -> str:
    """The answer quoted from the first four of src (query_id, position, filename, text) for ``questions`` (query_id, query)."""
    flat = r"regexp_replace(text, '\n', ' ', 'g')"
    return f"""quote0 as (select query_id, position, filename, {strip(flat)} as whole, {sentences(flat)} as s, {token_set('query')} as terms from src join {questions} using (query_id) where position <= 4),
quote1 as (select query_id, position, p, sentence, row_number() over (partition by query_id, position order by {shared(token_set('sentence'), 'terms')} desc, p) as r from (select query_id, position, terms, unnest(range(len(s))) as p, unnest(s) as sentence from quote0)),
quote2 as (select query_id, position, string_agg(sentence, ' ' order by r) as x from quote1 where r <= 2 group by all),
quote3 as (select query_id, position, filename, case when length(coalesce(x, whole)) > 650 then {word_cut('coalesce(x, whole)', 650)} || '...' else coalesce(x, whole) end as x from quote0 left join quote2 using (query_id, position)),
quoted as (select query_id, 'Answer:' || chr(10) || chr(10) || string_agg('[' || position || '] ' || x, chr(10) order by position) || chr(10) || chr(10) || 'Sources: ' || string_agg('[' || position || '] ' || filename, ', ' order by position) as quoted from quote3 group by query_id)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"
