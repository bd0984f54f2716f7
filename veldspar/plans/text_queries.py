"""Queries on texts: normalisation, tokens, sentences, chunks, keywords, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import hashing, scripts
from veldspar.functions import text as T
from veldspar.operators import chunks as C
from veldspar.operators import files
from veldspar.plans import sql as S
from veldspar.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files."""
    name = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), name.alias("filename"), "text", "source")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(document_files(spark, sf_dir))


def md5(c: str) -> F.Column:
    return F.md5(F.col(c).cast("binary")).alias(c)


def normalize_text(spark, d):
    t = T.normalize_text(F.col("text"))
    return documents(spark, d).select("doc_id", F.length(t).alias("chars"), F.md5(t.cast("binary")).alias("digest"))


def token_stats(spark, d):
    t, m = T.token_set(F.col("text")), T.meaningful_terms(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("tokens"), F.size(t).alias("distinct_tokens"), F.size(m).alias("meaningful"), F.md5(F.array_join(F.array_sort(m), " ").cast("binary")).alias("digest"))


def sentence_split(spark, d):
    s = T.split_sentences(T.compact(F.col("text")))
    return documents(spark, d).select("doc_id", F.size(s).alias("sentences"), F.md5(F.array_join(s, "|").cast("binary")).alias("digest"))


def answer_sentences(spark, d):
    s = T.answer_sentences(F.concat(F.lit("Answer:\n- "), F.col("text"), F.lit("\nSources: [1] a.txt")))
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", F.size(s).alias("sentences"), F.array_join(s, "|").alias("joined"))


def keywords_top12(spark, d):
    return C.keywords(documents(spark, d))


def extractive_summary(spark, d):
    return C.summaries(documents(spark, d)).withColumn("keywords", F.array_join("keywords", " "))


def chunk_windows(spark, d):
    return document_chunks(spark, d).select("chunk_id", "file_id", "chunk_index", md5("text"), "start_char", "end_char")


def chunk_packed(spark, d):
    """Sentence breaks as blank lines, so that paragraphs are packed."""
    rows = document_files(spark, d).withColumn("text", F.regexp_replace("text", r"([.!?])(?U)\s+", "$1\n\n"))
    return C.chunk_documents(rows).select("chunk_id", "file_id", "chunk_index", md5("text"), "start_char", "end_char")


def chunk_neighbors(spark, d):
    n = C.neighbours(document_chunks(spark, d).select("chunk_id", "file_id", "chunk_index"), 2)
    return n.withColumn("window_indexes", F.array_join(F.transform("window_indexes", lambda x: x.cast("string")), ","))


def text_slice(spark, d):
    return files.slice_text(documents(spark, d), 100, 400)


def script_histogram(spark, d):
    counts = documents(spark, d).select("doc_id", F.explode(scripts.script_counts(F.col("text"))).alias("script", "n"))
    return counts.withColumn("n", F.col("n").cast("long"))


def _many_scripts(spark, d) -> DataFrame:
    """Documents, every other one written in one of six scripts, letter by letter, with its first word left as it is."""
    shift = [0x0430, 0x05D0, 0x0905, 0x4E00, 0x0391, 0x0995]
    letters = "abcdefghijklmnopqrstuvwxyz"
    written = F.element_at(F.array(*[F.translate(F.lower("text"), letters, "".join(chr(s + i) for i in range(26))) for s in shift]), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents(spark, d).withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.concat(F.element_at(F.split("text", " "), 1), F.lit(" "), written)).otherwise(F.col("text")))


def dominant_script(spark, d):
    return _many_scripts(spark, d).select("doc_id", scripts.dominant_script(F.col("text")).alias("script"), scripts.coarse_script(F.col("text")).alias("coarse"))


def text_trust(spark, d):
    return documents(spark, d).select("doc_id", scripts.text_trust(F.col("text")).alias("t")).select("doc_id", "t.*")


def content_hash_dedupe(spark, d):
    keyed = documents(spark, d).select("doc_id", hashing.content_key(F.col("text"), "v1").alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def hash_embed(spark, d):
    v = hashing.hash_vectors(document_chunks(spark, d).select("chunk_id", "text"))
    return v.select("chunk_id", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.md5(F.array_join(F.transform("vector", lambda x: F.round(x, 9).cast("string")), ",").cast("binary")).alias("digest"))


_RE2 = scripts.RANGES
_PLAIN = r"regexp_replace(text, '[\s\p{Nd}]', '', 'g')"
_COUNT = lambda cls: rf"(length({_PLAIN}) - length(regexp_replace({_PLAIN}, '[{cls}]', '', 'g')))"
_LETTERS = r"regexp_replace(lower(text), '[^a-z\x{00C0}-\x{024F}]', '', 'g')"
_PAIRS = ", ".join(f"'{p}'" for p in scripts.COMMON_PAIRS)

QUERIES = {
    "normalize_text": (normalize_text, f"select doc_id, length({S.normalize('text')}) as chars, md5({S.normalize('text')}) as digest from documents"),
    "token_stats": (
        token_stats,
        f"select doc_id, len({S.tokens('text')}) as tokens, len({S.token_set('text')}) as distinct_tokens, len({S.meaningful('text')}) as meaningful, md5(array_to_string(list_sort({S.meaningful('text')}), ' ')) as digest from documents",
    ),
    "sentence_split": (sentence_split, f"select doc_id, len({S.sentences(S.compact('text'))}) as sentences, md5(array_to_string({S.sentences(S.compact('text'))}, '|')) as digest from documents"),
    "answer_sentences": (
        answer_sentences,
        "with a as (select conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: " + S.strip("s") + "), lambda s: s <> ''), ' ') as t from conversations where role = 'assistant')"
        f" select conv_id, turn, len({S.sentences('t')}) as sentences, array_to_string({S.sentences('t')}, '|') as joined from a",
    ),
    "keywords_top12": (
        keywords_top12,
        f"with t as (select doc_id, unnest({S.keyword_terms(S.normalize('text'))}) as term from documents), n as (select doc_id, term, count(*) as n from t group by all)"
        " select doc_id, row_number() over (partition by doc_id order by n desc, term) as rank, term, n from n qualify rank <= 12",
    ),
    "extractive_summary": (
        extractive_summary,
        f"""with t as (select doc_id, unnest({S.keyword_terms(S.normalize('text'))}) as term from documents),
        n as (select doc_id, term, count(*) as n from t group by all),
        k as (select doc_id, list(term order by n desc, term) as keywords from (select * from n qualify row_number() over (partition by doc_id order by n desc, term) <= 12) group by doc_id),
        s0 as (select doc_id, {S.sentences(S.compact(S.normalize('text')))} as s from documents),
        s1 as (select doc_id, case when len(s) = 1 and length(s[1]) > 700 then [{S.strip(S.word_cut('s[1]', 700))}] else s end as s from s0),
        s2 as (select doc_id, unnest(range(len(s))) as p, unnest(s) as sentence from s1),
        r as (select doc_id, p, sentence, {S.shared(S.token_set('sentence'), "coalesce(keywords, [])")} + cast(p = 0 as int) as score from s2 left join k using (doc_id)),
        b as (select * from r qualify row_number() over (partition by doc_id order by score desc, p) <= 3),
        j as (select doc_id, {S.strip("string_agg(sentence, ' ' order by p)")} as t from b group by doc_id)
        select doc_id, coalesce({S.excerpt('t', 600)}, '') as summary, coalesce(array_to_string(keywords, ' '), '') as keywords from documents left join j using (doc_id) left join k using (doc_id)""",
    ),
    "chunk_windows": (chunk_windows, S.with_(S.CHUNKS) + "select chunk_id, file_id, chunk_index, md5(text) as text, start_char, end_char from chunks"),
    "chunk_packed": (
        chunk_packed,
        f"""with recursive norm as (select doc_id, {S.normalize(r"regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(10) || chr(10), 'g')")} as t from documents),
        p0 as (select doc_id, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) as i, unnest(string_split(t, chr(10) || chr(10))) as raw from norm),
        p1 as (select doc_id, i, raw, coalesce(sum(length(raw) + 2) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as o from p0),
        p as (select doc_id, row_number() over (partition by doc_id order by i) as i, {S.strip('raw')} as x, o + length(raw) - length(ltrim(raw, {S.SPACE})) as a from p1 where {S.strip('raw')} <> ''),
        g as (
          select doc_id, i, 1 as g, length(x) as n, length(x) <= 900 as open from p where i = 1
          union all
          select p.doc_id, p.i, case when length(x) <= 900 and open and n + 2 + length(x) <= 900 then g else g + 1 end, case when length(x) <= 900 and open and n + 2 + length(x) <= 900 then n + 2 + length(x) else length(x) end, length(x) <= 900
          from g join p on p.doc_id = g.doc_id and p.i = g.i + 1),
        short as (select doc_id, g, 0 as w, string_agg(x, chr(10) || chr(10) order by i) as text, min(a) as a, max(a + length(x)) as b from g join p using (doc_id, i) where open group by doc_id, g),
        cut as (select doc_id, g, x, a, unnest(generate_series(0, cast(ceil((length(x) - 900) / 720.0) as int))) as w from g join p using (doc_id, i) where not open),
        long as (select doc_id, g, w, substr(x, cast(w * 720 + 1 as int), 900) as r, a + w * 720 as a from cut),
        joint as (select * from short union all select doc_id, g, w, {S.strip('r')}, a + length(r) - length(ltrim(r, {S.SPACE})), a + length(rtrim(r, {S.SPACE})) from long where {S.strip('r')} <> ''),
        numbered as (select *, cast(row_number() over (partition by doc_id order by g, w) - 1 as int) as k from joint)
        select doc_id || ':' || k as chunk_id, doc_id as file_id, k as chunk_index, md5(text) as text, cast(a as int) as start_char, cast(b as int) as end_char from numbered""",
    ),
    "chunk_neighbors": (
        chunk_neighbors,
        S.with_(S.CHUNKS, "last as (select file_id, max(chunk_index) as last from chunks group by file_id)")
        + "select chunk_id, file_id, chunk_index, array_to_string(range(greatest(chunk_index - 2, 0), least(chunk_index + 2, last) + 1), ',') as window_indexes, chunk_index > 2 as has_previous, last > chunk_index + 2 as has_next from chunks join last using (file_id)",
    ),
    "text_slice": (text_slice, 'select doc_id, substr(text, 101, 300) as text, least(100, length(text)) as start, least(400, length(text)) as "end" from documents'),
    "script_histogram": (
        script_histogram,
        "select doc_id, script, n from (" + " union all ".join(f"select doc_id, '{n}' as script, {_COUNT(c)} as n from documents" for n, c in _RE2.items()) + ") where n > 0",
    ),
    "dominant_script": (
        dominant_script,
        "with w as (select doc_id, case when doc_id % 2 = 1 then string_split(text, ' ')[1] || ' ' || (case doc_id % 6 "
        + " ".join(f"when {k} then translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{''.join(chr(s + i) for i in range(26))}')" for k, s in enumerate((0x0430, 0x05D0, 0x0905, 0x4E00, 0x0391, 0x0995)))
        + " end) else text end as text from documents),\n"
        f"p as (select doc_id, text, {_PLAIN} as plain from w),\n"
        "n as (" + " union all ".join(f"select doc_id, {i} as i, '{name}' as name, length(plain) - length(regexp_replace(plain, '[{c}]', '', 'g')) as n, length(regexp_extract(plain, '^[^{c}]*')) as first from p" for i, (name, c) in enumerate(_RE2.items()))
        + "),\nb as (select doc_id, sum(n) as total, arg_max(name, n * 1000000 - first) as script from n group by doc_id)\n"
        "select doc_id, case when total >= 8 then script end as script, case when regexp_matches(text, '[\\x{0600}-\\x{06FF}]') then 'Arabic' when regexp_matches(text, '[\\x{0900}-\\x{097F}]') then 'Devanagari' when regexp_matches(text, '[\\x{0980}-\\x{09FF}]') then 'Bengali'"
        " when regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') then 'Han' else 'Latin' end as coarse from p join b using (doc_id)",
    ),
    "text_trust": (
        text_trust,
        f"""with l as (select doc_id, {_LETTERS} as t from documents),
        m as (select doc_id, length(t) as letters, length(regexp_replace(t, '[^aeiou]', '', 'g')) / greatest(length(t), 1) as v,
          len(list_filter(range(1, length(t)), lambda i: substr(t, i, 2) in ({_PAIRS}))) / greatest(length(t) - 1, 1) as b from l)
        select doc_id, letters, round(v, 3) as vowel_ratio, round(b, 3) as bigram_ratio, (letters < 100 or (v >= 0.25 and v <= 0.60 and b >= 0.08)) as trusted from m""",
    ),
    "content_hash_dedupe": (content_hash_dedupe, r"select sha256('v1\x00'::blob || encode(text)) as key, min(doc_id) as first_id, count(*) as copies from documents group by 1"),
    "hash_embed": (hash_embed, None),
}
