"""Queries on conversations, feedback, tools, stored tables and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import arithmetic
from veldspar.functions import text as T
from veldspar.operators import chats, files
from veldspar.plans import sql as S
from veldspar.plans.text_queries import document_chunks, documents, table
from veldspar.sources import sinks


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def _remembering(spark, d) -> DataFrame:
    """User turns that state something about the user."""
    content = F.concat(F.element_at(F.array(F.lit("Remember that "), F.lit("My favourite word is "), F.lit("I prefer "), F.lit("please call me ")), (F.col("pos") % 4 + 1).cast("int")), F.col("content"), F.lit(". Thanks!"))
    return messages(spark, d).withColumn("content", content)


def rolling_context(spark, d):
    notes = messages(spark, d).groupBy("chat_id").agg(F.lit("- likes tea").alias("memory"), F.concat(F.lit("turns "), F.max("pos").cast("string")).alias("summary"))
    return chats.rolling_context(messages(spark, d), notes, 4)


def compact_chat(spark, d):
    return chats.compact_chats(messages(spark, d), 2)


def memory_extract(spark, d):
    return chats.extract_memories(_remembering(spark, d))


def memory_block(spark, d):
    m = messages(spark, d).select("chat_id", "pos", "content")
    return chats.memory_block(m, 4, 700)


def memory_upsert(spark, d):
    m = messages(spark, d).select("chat_id", F.col("pos").alias("ord"), F.element_at(F.split("content", " "), 1).alias("content"))
    return chats.upsert_memories(m, 3)


def prune_branch(spark, d):
    m = messages(spark, d)
    return chats.prune_branch(m, m.groupBy("chat_id").agg((F.max("pos") - 1).alias("target_pos"))).select("chat_id", "pos", "role")


def previous_question(spark, d):
    return chats.previous_question(messages(spark, d))


def feedback_review(spark, d):
    tags = F.array(F.element_at(F.array(F.lit("helpful"), F.lit("citation")), (F.col("doc_id") % 2 + 1).cast("int")))
    rated = table(spark, d, "labels").select(F.col("doc_id").alias("message_id"), F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"), tags.alias("tags"), (F.col("doc_id") % 97).alias("updated_at"))
    return chats.review_feedback(rated, "down", "HELPFUL", 20).withColumn("tags", F.array_join("tags", ","))


def plan_queries(spark, d):
    return chats.plan_queries(messages(spark, d))


def tool_trigger(spark, d):
    said = messages(spark, d).withColumn("content", F.concat("content", F.element_at(F.array(F.lit(" what is 3 * 4"), F.lit(" list my files"), F.lit(" how many chunks"), F.lit(" the date")), (F.col("chat_id") % 4 + 1).cast("int"))))
    return chats.tool_triggers(said).select("chat_id", "pos", F.array_join("tools", ",").alias("tools"))


def calculator(spark, d):
    """Four forms of expressions, with brackets, powers, signs and fractions."""
    a, b = F.col("chat_id").cast("string"), F.col("pos").cast("string")
    forms = F.array(
        F.concat(F.lit("Calculate ("), a, F.lit(" + "), b, F.lit(") * 6")), F.concat(F.lit("what is "), a, F.lit(" - "), b, F.lit(" * 3 - -2?")), F.concat(F.lit("2 ^ "), b, F.lit(" + "), a, F.lit(" please")),
        F.concat(F.lit("sum: ("), a, F.lit(" * 4 + 2) / 4")),
    )
    asked = messages(spark, d).filter("role = 'user'").select("chat_id", "pos", F.element_at(forms, ((F.col("chat_id") + F.col("pos")) % 4 + 1).cast("int")).alias("q"))
    return asked.select("chat_id", "pos", arithmetic.calculate(F.col("q")).alias("value"))


def rerun_branch(spark, d):
    """The second message of each chat is asked again if it is the user's; every other chat has it edited."""
    m = messages(spark, d)
    targets = m.groupBy("chat_id").agg(F.lit(2).cast("long").alias("target_pos"))
    kept, asked = chats.rerun(m, targets, m.select("chat_id").distinct().filter("chat_id % 2 = 0").withColumn("content", F.lit("edited")))
    return kept.groupBy("chat_id").agg(F.count(F.lit(1)).alias("kept")).join(asked, "chat_id", "left")


def regenerate_last(spark, d):
    kept, asked = chats.regenerate(messages(spark, d))
    return kept.groupBy("chat_id").agg(F.count(F.lit(1)).alias("kept")).join(asked, "chat_id", "full_outer")


def reindex_scope(spark, d):
    f = documents(spark, d).select(F.col("doc_id").alias("file_id"), F.col("source").alias("knowledge_id"))
    chosen = f.filter("file_id % 50 = 0").select("file_id")
    return files.reindex_scope(f.select("file_id"), f, chosen, f.filter("knowledge_id like '%7'").select("knowledge_id"))


def skill_match(spark, d):
    skills = spark.createDataFrame([("brief", True, ["th", "en"]), ("french", True, [" la ", " le "]), ("off", False, ["a"])], "skill_id string, enabled boolean, triggers array<string>")
    return chats.match_skills(messages(spark, d), skills)


def chat_export(spark, d):
    e = sinks.export_chats(messages(spark, d))
    back = sinks.import_chats(e, messages(spark, d).select("chat_id"))
    return back.groupBy("chat_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("content")).alias("chars"))


def context_suggest(spark, d):
    docs = documents(spark, d).select("doc_id", (F.col("doc_id") % 50).alias("chat_id"))
    have = docs.filter("doc_id % 3 = 0").groupBy("chat_id").agg(F.array_sort(F.collect_list("doc_id")).alias("file_ids"))
    new = docs.filter("doc_id % 2 = 0").groupBy("chat_id").agg(F.array_sort(F.collect_list("doc_id")).alias("suggested_ids"))
    out = chats.context_suggestions(have, new)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("chat_id", join("file_ids"), join("added"))


def answer_options(spark, d):
    """A request's field where it is set (even turns), else the chat's default (chats of odd id), else 5."""
    explicit = F.when(F.col("pos") % 2 == 0, F.col("pos") + 1)
    default = F.when(F.col("chat_id") % 2 == 1, F.lit(8))
    return messages(spark, d).select("chat_id", "pos", chats.prefer(explicit, default, 5).cast("long").alias("top_k"))


def storage_stats(spark, d):
    t = {n: table(spark, d, n) for n in ("documents", "conversations", "benchmark", "pages")}
    return files.storage_stats(t | {"chunks": document_chunks(spark, d)})


def upsert_files(spark, d):
    docs = documents(spark, d).select("doc_id", "lang", "n_chars", F.lit(1).alias("version"))
    changes = docs.filter("doc_id % 10 = 0").withColumn("lang", F.lit("xx")).withColumn("version", F.lit(2))
    new = docs.filter("doc_id % 100 = 1").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return files.upsert(docs, changes.unionByName(new), "doc_id", "version")


def replace_chunks(spark, d):
    chunks = document_chunks(spark, d).select("chunk_id", "file_id", "chunk_index")
    rows = chunks.filter("file_id % 7 = 0 and chunk_index = 0")
    return files.replace_group(chunks, rows, "file_id")


def delete_files(spark, d):
    chunks = document_chunks(spark, d).select("chunk_id", "file_id")
    gone = documents(spark, d).filter("lang = 'fr'").select(F.col("doc_id").alias("file_id"))
    return files.delete_cascade({"chunks": chunks}, gone)["chunks"]


def list_files(spark, d):
    """The newest files of each source, with the number there are before the limit."""
    from pyspark.sql import Window

    by = Window.partitionBy("source")
    rows = documents(spark, d).withColumn("r", F.row_number().over(by.orderBy(F.desc("doc_id")))).withColumn("total", F.count(F.lit(1)).over(by))
    return rows.filter("r <= 10").select("source", "r", "doc_id", "total")


def clean_tags(spark, d):
    tags = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("  "), x, F.lit(" ")))
    return documents(spark, d).select("doc_id", F.array_join(T.clean_tags(tags), "|").alias("tags"))


_MSG = "m as (select conv_id as chat_id, turn as pos, role, text as content from conversations)"
_RC = S.strip(r"regexp_replace(content, '\n', ' ', 'g')")

QUERIES = {
    "rolling_context": (
        rolling_context,
        S.with_(_MSG) + "select chat_id, pos, role, content from m qualify row_number() over (partition by chat_id order by pos desc) <= 4 union all"
        " select chat_id, -1, 'system', 'Saved chat memory:' || chr(10) || '- likes tea' || chr(10) || chr(10) || 'Earlier conversation summary:' || chr(10) || 'turns ' || max(pos) from m group by chat_id",
    ),
    "compact_chat": (
        compact_chat,
        S.with_(_MSG, "o as (select * from m qualify row_number() over (partition by chat_id order by pos desc) > 2)",
                f"l as (select chat_id, pos, role || ': ' || case when length({_RC}) > 240 then {S.word_cut(_RC, 240)} || '...' else {_RC} end as line from o)")
        + f"select chat_id, count(*) as folded, right({S.strip('string_agg(line, chr(10) order by pos)')}, 3000) as summary from l group by chat_id",
    ),
    "memory_extract": (
        memory_extract,
        S.with_(_MSG, f"c as (select chat_id, pos, {S.compact("(['Remember that ', 'My favourite word is ', 'I prefer ', 'please call me '])[pos % 4 + 1] || content || '. Thanks!'")} as c from m where role = 'user')",
                f"x as (select chat_id, pos, trim(case pos % 4 when 0 then {S.strip("regexp_extract(c, '^Remember that ([^.?!]+)', 1)")} when 1 then 'User''s favourite word is ' || {S.strip("regexp_extract(c, '^My favourite word is ([^.?!]+)', 1)")}"
                f" when 2 then 'User prefers ' || {S.strip("regexp_extract(c, '^I prefer ([^.?!]+)', 1)")} else 'User wants to be called ' || {S.strip("regexp_extract(c, '^please call me ([^.?!]+)', 1)")} end, ' ,;:') as x from c)")
        + "select chat_id, pos, 0 as item, upper(left(x, 1)) || substr(x, 2) as memory from x where length(x) >= 4",
    ),
    "memory_block": (
        memory_block,
        S.with_(_MSG, f"l as (select chat_id, pos, '- ' || {S.strip('content')} as line from m qualify row_number() over (partition by chat_id order by pos desc) <= 4)",
                "u as (select *, sum(length(line)) over (partition by chat_id order by pos) as used from l)")
        + "select chat_id, count(*) as lines, string_agg(line, chr(10) order by pos) as memory from u where used <= 700 group by chat_id",
    ),
    "memory_upsert": (
        memory_upsert,
        S.with_(_MSG, f"w as (select chat_id, pos as ord, string_split(content, ' ')[1] as content, array_to_string({S.tokens("string_split(content, ' ')[1]")}, ' ') as key from m)",
                f"o as (select chat_id, key, min(ord) as pos, {S.strip('max_by(content, ord)')} as content from w where key <> '' group by all)")
        + "select chat_id, pos, content from o qualify row_number() over (partition by chat_id order by pos desc) <= 3",
    ),
    "prune_branch": (prune_branch, S.with_(_MSG) + "select chat_id, pos, role from m where pos < (select max(pos) - 1 from m x where x.chat_id = m.chat_id)"),
    "previous_question": (
        previous_question,
        S.with_(_MSG, "p as (select *, coalesce(last_value(case when role = 'user' then content end ignore nulls) over (partition by chat_id order by pos rows between unbounded preceding and 1 preceding), '') as question from m)")
        + "select chat_id, pos, question from p where role = 'assistant'",
    ),
    "feedback_review": (
        feedback_review,
        "with r as (select doc_id as message_id, case when quality = 1 then 'up' else 'down' end as rating, case when doc_id % 2 = 0 then 'helpful' else 'citation' end as tags, doc_id % 97 as updated_at from labels),"
        " f as (select *, count(*) over () as total from r where rating = 'down' and tags = 'helpful') select * from f order by updated_at desc, message_id limit 20",
    ),
    "plan_queries": (
        plan_queries,
        S.with_(_MSG, f"sys as (select chat_id, pos, role, content, string_agg(case when role = 'system' and {S.strip('content')} <> '' then {S.strip('content')} end, chr(10) || chr(10)) over (partition by chat_id order by pos rows between unbounded preceding and 1 preceding) as raw from m)",
                f"u0 as (select chat_id, pos, content, {S.compact("coalesce(raw, '')")} as h, lag(content) over w as p1, lag(content, 2) over w as p2 from sys where role = 'user' window w as (partition by chat_id order by pos))",
                "u as (select *, case when length(h) > 500 then regexp_replace(right(h, 500), '^[^ ]* ', '') else h end as hint,"
                f" (len(list_filter(string_split({S.compact('lower(content)')}, ' '), lambda x: x <> '')) <= 5 or regexp_matches({S.strip('lower(content)')}, '^(and |what about|how about|then |also |compare|same for)')) as follow from u0)",
                f"p as (select chat_id, pos, list_filter(list_transform([case when follow and hint <> '' then hint || chr(10) || content end, case when follow then p1 || chr(10) || content end, content, coalesce(p2 || chr(10), '') || p1 || chr(10) || content, case when hint <> '' then hint || chr(10) || content end], lambda x: {S.compact('x')}), lambda x: x is not null and x <> '') as l from u)",
                "d as (select chat_id, pos, list_filter(l, lambda x, i: list_position(l, x) = i)[1:3] as l from p)")
        + "select chat_id, pos, cast(unnest(range(len(l))) as int) as plan_pos, unnest(l) as query from d",
    ),
    "tool_trigger": (
        tool_trigger,
        S.with_(_MSG, "t as (select chat_id, pos, content || ([' what is 3 * 4', ' list my files', ' how many chunks', ' the date'])[chat_id % 4 + 1] as c from m)")
        + r"select chat_id, pos, array_to_string(list_filter([case when regexp_matches(c, '(?i)\b(calculate|math|sum|plus|minus|times|divided|=)\b') or regexp_matches(c, '\d+\s*[-+*/^]\s*\d+') then 'calculator' end,"
        r" case when regexp_matches(c, '(?i)\b(list|show|what).*\b(files|documents|uploads)\b') then 'list_files' end, case when regexp_matches(c, '(?i)\b(stats|statistics|how many|count).*\b(files|chunks|documents)\b') then 'file_stats' end,"
        r" case when regexp_matches(c, '(?i)\b(time|date|today|now)\b') then 'time' end], lambda x: x is not null), ',') as tools from t",
    ),
    "calculator": (
        calculator,
        S.with_(_MSG) + "select chat_id, pos, case (chat_id + pos) % 4 when 0 then cast((chat_id + pos) * 6 as varchar) when 1 then cast(chat_id - pos * 3 + 2 as varchar) when 2 then cast(cast(2 ** pos as bigint) + chat_id as varchar)"
        " else cast(chat_id as varchar) || '.5' end as value from m where role = 'user'",
    ),
    "rerun_branch": (
        rerun_branch,
        S.with_(_MSG, "t as (select chat_id, content from m where pos = 2 and role = 'user')")
        + "select m.chat_id, count(*) filter (t.chat_id is null or pos < 2) as kept, any_value(case when m.chat_id % 2 = 0 and t.chat_id is not null then 'edited' else t.content end) as content from m left join t using (chat_id) group by m.chat_id having kept > 0",
    ),
    "regenerate_last": (
        regenerate_last,
        S.with_(_MSG, "l as (select chat_id, arg_max(role, pos) as r1, max(pos) as p1, count(*) as n from m group by chat_id)", "b as (select m.chat_id, max(pos) as p2, arg_max(role, pos) as r2, arg_max(content, pos) as c2 from m join l using (chat_id) where pos < p1 group by m.chat_id)",
                "g as (select chat_id, p2, c2 from l join b using (chat_id) where r1 = 'assistant' and r2 = 'user')", "k as (select m.chat_id, count(*) as kept from m left join g using (chat_id) where p2 is null or pos < p2 group by m.chat_id)")
        + "select chat_id, kept, c2 as content from k full join g using (chat_id)",
    ),
    "reindex_scope": (reindex_scope, "select doc_id as file_id from documents where doc_id % 50 = 0 or source like '%7'"),
    "skill_match": (
        skill_match,
        S.with_(_MSG) + "select chat_id, pos, 'brief' as skill_id from m where contains(lower(content), 'th') or contains(lower(content), 'en') union all select chat_id, pos, 'french' from m where contains(lower(content), 'la') or contains(lower(content), 'le')",
    ),
    "chat_export": (chat_export, "select conv_id + (select max(conv_id) + 1 from conversations) as chat_id, count(*) as messages, sum(length(text)) as chars from conversations group by conv_id"),
    "context_suggest": (
        context_suggest,
        "with h as (select doc_id % 50 as chat_id, list(doc_id order by doc_id) as a from documents where doc_id % 3 = 0 group by 1), n as (select doc_id % 50 as chat_id, list(doc_id order by doc_id) as b from documents where doc_id % 2 = 0 group by 1),"
        " j as (select chat_id, coalesce(a, []) as a, coalesce(b, []) as b from h full join n using (chat_id)) select chat_id, array_to_string(a || list_filter(b, lambda x: not list_contains(a, x)), ',') as file_ids, array_to_string(list_filter(b, lambda x: not list_contains(a, x)), ',') as added from j",
    ),
    "answer_options": (answer_options, S.with_(_MSG) + "select chat_id, pos, coalesce(case when pos % 2 = 0 then pos + 1 end, case when chat_id % 2 = 1 then 8 end, 5) as top_k from m"),
    "storage_stats": (
        storage_stats,
        S.with_(S.CHUNKS) + "select 'documents' as name, count(*) as rows, sum(length(text)) as chars from documents union all select 'conversations', count(*), sum(length(text)) from conversations"
        " union all select 'benchmark', count(*), sum(length(text)) from benchmark union all select 'pages', count(*), 0 from pages union all select 'chunks', count(*), sum(length(text)) from chunks",
    ),
    "upsert_files": (
        upsert_files,
        "select doc_id, case when doc_id % 10 = 0 then 'xx' else lang end as lang, n_chars, case when doc_id % 10 = 0 then 2 else 1 end as version from documents union all select doc_id + 1000000000, lang, n_chars, 1 from documents where doc_id % 100 = 1",
    ),
    "replace_chunks": (replace_chunks, S.with_(S.CHUNKS) + "select chunk_id, file_id, chunk_index from chunks where file_id % 7 <> 0 or chunk_index = 0"),
    "delete_files": (delete_files, S.with_(S.CHUNKS) + "select chunk_id, file_id from chunks where file_id not in (select doc_id from documents where lang = 'fr')"),
    "list_files": (list_files, "select source, row_number() over (partition by source order by doc_id desc) as r, doc_id, count(*) over (partition by source) as total from documents qualify r <= 10"),
    "clean_tags": (
        clean_tags,
        f"with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: left({S.compact('lower(x)')}, 80)), lambda x: x <> '') as l from documents)"
        " select doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20], '|') as tags from l",
    ),
}
