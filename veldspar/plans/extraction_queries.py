"""Queries on extraction, cleaning and the job stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.operators import cleaning, pages
from veldspar.plans import sql as S
from veldspar.plans.text_queries import documents, table
from veldspar.sources import readers
from veldspar.streaming import jobs

_TABLE = "<table><tr><th>a</th><th colspan=2>b</th></tr><tr><td rowspan=2>1</td><td>x|y</td><td>&amp;</td></tr><tr><td>z</td></tr></table>"


def strip_html(spark, d):
    bare = cleaning.bare_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(bare).alias("chars"), F.md5(bare.cast("binary")).alias("digest"))


def html_to_markdown(spark, d):
    m = readers.pages_markdown(table(spark, d, "pages"))
    return m.select("page_id", F.length("markdown").alias("chars"), F.regexp_count("markdown", F.lit(r"(?m)^#{1,6} ")).alias("headings"), F.md5(F.col("markdown").cast("binary")).alias("digest"))


def clean_markdown(spark, d):
    """The chain without tables and entities, on documents made untidy."""
    raw = F.concat(F.lit("#Title\t  x\r\n"), F.regexp_replace("text", r" ([a-zA-Z0-9_]+)\.", " <b>$1</b> ....... "), F.lit("\n\n\n\n|  | |\n| a |b|\n_______ ( q ) <br/>end"))
    clean = cleaning.clean_markdown(raw, tables=False)
    return documents(spark, d).select("doc_id", F.length(clean).alias("chars"), F.md5(clean.cast("binary")).alias("digest"))


def clean_tables(spark, d):
    raw = F.concat(F.lit("before"), F.lit(_TABLE), F.col("text"))
    return documents(spark, d).select("doc_id", cleaning.clean_markdown(raw).alias("clean"))


def plain_lines(spark, d):
    raw = F.concat(F.lit("# Head\n\n## "), "text")
    return documents(spark, d).select("doc_id", F.md5(cleaning.plain_lines(raw).cast("binary")).alias("digest"))


def _features(spark, d) -> DataFrame:
    """Events as pages: the user is the document, numbers come of the value."""
    n = (F.col("event_id") % 7).cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_index"), F.when(n < 2, 0).otherwise((F.floor("value")).cast("int")).alias("chars"),
        (F.col("event_type") != "error").alias("trusted"), F.when(n == 3, 40).otherwise(n).alias("images"), (F.col("event_id") % 100 / 1000).alias("ink"),
    )


def page_decision(spark, d):
    return pages.decide_pages(_features(spark, d)).select("doc_id", "page_index", "action", "reason")


def page_safety_net(spark, d):
    """Pages of which it is known how many blocks their text gave."""
    made = _features(spark, d).withColumn("made", (F.col("page_index") % 3).cast("int"))
    return pages.decide_pages(made, made="made").select("doc_id", "page_index", "action", "reason")


def visual_density(spark, d):
    """The digits of a digest as dark pixels."""
    return documents(spark, d).select("doc_id", pages.visual_density(F.md5(F.col("text").cast("binary")).cast("binary"), 97).alias("density"))


def reading_order(spark, d):
    b = _blocks(spark, d).withColumn("y", F.length("text") % 50)
    return pages.reading_order(b).select("doc_id", "page_index", "block_pos", "place")


def settled_blocks(spark, d):
    b = _blocks(spark, d).select(
        "doc_id", "block_pos", F.when(F.col("block_pos") % 2 == 0, "a").otherwise("b").alias("backend"), F.when(F.col("block_pos") % 3 > 0, F.lit(" probe ")).alias("probe_text"), "text",
        F.element_at(F.array(F.lit(None).cast("int"), F.lit(413), F.lit(503), F.lit(None).cast("int"), F.lit(0)), (F.col("doc_id") % 5 + 1).cast("int")).alias("status"),
    )
    return pages.settle_blocks(b, "a").select("doc_id", "block_pos", "final_text", "final_backend", "error")


def extraction_histograms(spark, d):
    b = _blocks(spark, d).withColumn("backend", F.when(F.col("block_pos") % 4 == 0, "eu").when(F.col("block_pos") % 4 == 2, "asia"))
    out = pages.histograms(b)
    told = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return out.select("doc_id", told("scripts").alias("scripts"), told("buckets").alias("buckets"), "dominant_script")


def sidecar_counters(spark, d):
    b = _blocks(spark, d)
    return pages.counters(b, b.select("doc_id", F.concat(F.lit("stage"), (F.col("block_pos") % 3).cast("string")).alias("stage"), (F.length("text") / 8.0).alias("seconds")))


def _job_files(spark, d) -> tuple:
    """Chats as jobs whose turns are attachments; every fifth has no data."""
    items = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("t"), F.col("turn").cast("string").alias("attachment_id"), F.col("role").alias("title")))).alias("a"))
    attachments = F.transform("a", lambda x: F.struct(x["attachment_id"].alias("attachment_id"), x["title"].alias("title")))
    data = F.when(F.col("conv_id") % 5 > 0, F.to_json(F.struct(F.lit("u").alias("user_id"), F.col("conv_id").cast("string").alias("message_id"), attachments.alias("attachments"))))
    results = table(spark, d, "conversations").filter("conv_id % 3 > 0 or turn % 2 = 0").select(F.col("conv_id").alias("job_id"), F.col("turn").cast("string").alias("attachment_id"), F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") % 2 == 1), F.concat(F.lit("bad "), F.col("turn").cast("string"))).alias("error"))
    return jobs.validate(items.select(F.col("conv_id").alias("job_id"), data.alias("data"))), results


def job_statuses(spark, d):
    return jobs.statuses(*_job_files(spark, d))[0]


def file_statuses(spark, d):
    return jobs.statuses(*_job_files(spark, d))[1]


def attachment_order(spark, d):
    r = table(spark, d, "conversations").select(F.col("conv_id").alias("job_id"), (-F.col("turn")).alias("idx"), "role")
    return jobs.ordered_results(r).select("job_id", F.array_join(F.transform("results", lambda x: x["role"]), ",").alias("roles"))


_SCRIPTS = ("Latin", "Arabic", "Han", None)


def ocr_route(spark, d):
    pick = F.element_at(F.array(*[F.lit(s) for s in _SCRIPTS]), (F.col("event_id") % 4 + 1).cast("int"))
    blocks = table(spark, d, "events").select("event_id", pick.alias("surrounding_script"), F.lit("Han").alias("probe_script"), (F.col("event_id") % 60).alias("probe_chars"))
    return pages.route_blocks(blocks, {"Latin": "small", "Han": "cjk"}, "general", "both").select("event_id", "script", "backend", "reuse_probe")


def _blocks(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") % 3).alias("page_index"), F.concat(F.lit("page "), (F.col("turn") % 3 + 1).cast("string")).alias("page_label"), F.col("turn").alias("block_pos"),
        "text", F.lit("text").alias("type"), F.when(F.col("role") == "user", "ocr").otherwise("native").alias("source"), F.when(F.col("turn") % 2 == 0, "Latin").otherwise("Han").alias("script"),
    )


def extraction_rollup(spark, d):
    return pages.rollup_blocks(_blocks(spark, d))


def render_markdown(spark, d):
    b = _blocks(spark, d)
    titles = b.select("doc_id", F.concat(F.lit("chat "), F.col("doc_id").cast("string")).alias("title")).distinct()
    return pages.render_markdown(b, titles)


def sidecar(spark, d):
    return pages.sidecar(_blocks(spark, d))


def image_fit(spark, d):
    size = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_partkey") % 5000 + 10).alias("h"))
    fit = pages.fit_image(F.col("w"), F.col("h"))
    return size.select("p_partkey", fit["width"].alias("width"), fit["height"].alias("height"), pages.is_small(F.col("w"), F.col("h")).alias("small"))


def extraction_cache(spark, d):
    docs = documents(spark, d).select("doc_id", F.col("text").alias("content"))
    from veldspar.functions.hashing import content_key

    cache = docs.filter("doc_id % 5 = 0").select(content_key(F.col("content"), "v1").alias("key"), F.lit("done").alias("markdown")).distinct()
    known, fresh = pages.cached_or_new(docs, cache, "v1")
    return known.select("doc_id", F.lit(True).alias("hit")).unionByName(fresh.select("doc_id", F.lit(False).alias("hit")))


def _jobs(spark, d) -> DataFrame:
    """Events as jobs, some of them broken in each way."""
    item = F.struct(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("attachment_id"), F.lit("t").alias("title"))
    full = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 1, "").otherwise(F.col("user_id").cast("string")).alias("user_id"), F.lit("m").alias("message_id"), F.lit("c").alias("chat_id"), F.when(F.col("event_id") % 5 == 2, F.expr("cast(array() as array<struct<attachment_id:string,title:string>>)")).otherwise(F.array(item)).alias("attachments")))
    data = F.when(F.col("event_id") % 5 == 3, "").when(F.col("event_id") % 5 == 4, "{broken").otherwise(full)
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), data.alias("data"), "event_type", "ts", "user_id")


def job_validate(spark, d):
    return jobs.validate(_jobs(spark, d)).select("job_id", "reason")


def job_dlq_split(spark, d):
    good, dead = jobs.split(jobs.validate(_jobs(spark, d)))
    return good.select("job_id", F.lit("done").alias("queue")).unionByName(dead.select("job_id", F.lit("dead").alias("queue")))


def job_out_events(spark, d):
    good, _ = jobs.split(jobs.validate(_jobs(spark, d)))
    return jobs.out_events(good)


def job_status_latest(spark, d):
    states = _jobs(spark, d).select("user_id", F.col("event_type").alias("status"), F.struct("ts", "job_id").alias("at"))
    return jobs.latest(states, "user_id", "at").select("user_id", "status")


def events_by_time(spark, d):
    return jobs.counts_by_time(table(spark, d, "events"))


def event_sessions(spark, d):
    return jobs.sessions(table(spark, d, "events"), "12 hours")


def format_registry(spark, d):
    """Formats of file names made of sources: an unknown extension is a row without a format."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("txt", "csv", "json", "html", "eml", "zip")]), (F.col("doc_id") % 6 + 1).cast("int"))
    known = F.create_map(*[F.lit(x) for pair in readers.FORMATS.items() for x in pair])
    return documents(spark, d).select("doc_id", F.try_element_at(known, ext).alias("format"))


_FEAT = "f as (select user_id as doc_id, event_id as page_index, case when event_id % 7 < 2 then 0 else cast(floor(value) as int) end as chars, event_type <> 'error' as trusted, case when event_id % 7 = 3 then 40 else event_id % 7 end as images, event_id % 100 / 1000 as ink from events)"
_BLK = "b as (select conv_id as doc_id, turn % 3 as page_index, 'page ' || (turn % 3 + 1) as page_label, turn as block_pos, text, role, case when turn % 2 = 0 then 'Latin' else 'Han' end as script from conversations)"

_BARE = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'),"
    " '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), " + S.SPACE + ") || chr(10)"
)


def _cleaned(rows: str, key: str) -> str:
    """The cleaning chain of ``rows`` (key, t) without entities and tables, as ``cleaned``."""
    def subs(text: str, rules: list[tuple[str, str]]) -> str:
        for pattern, new in rules:
            text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
        return text

    plain = "regexp_replace(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), '[\\x00-\\x09\\x0b-\\x1f]', '', 'g')"
    tags = [(r"(?i)<br\s*/?>", "chr(10)"), (r"(?is)<b[^>]*>(.*?)</b>", r"'**\1**'"), (r"<[^>]+>", "''")]
    marks = [(r"\.{5,}", "'...'"), (r"={5,}", "'---'"), (r"_{5,}", "'---'"), (r"-{5,}", "'---'"), (r"\s+([,.;:!?])", r"'\1'"), (r"([(\[{])\s+", r"'\1'"), (r"\s+([)\]}])", r"'\1'")]
    cell = f"list_transform(string_split(trim(s, '|'), '|'), lambda c: {S.strip('c')})"
    table = "(starts_with(s, '|') and ends_with(s, '|'))"
    lines = f"list_transform(string_split({subs(subs(plain, tags), marks)}, chr(10)), lambda s: {S.strip('s')})"
    kept = f"list_filter(l, lambda s: not ({table} and len(list_filter({cell}, lambda c: c <> '')) = 0))"
    even = f"list_transform({kept}, lambda s: case when {table} then '| ' || array_to_string({cell}, ' | ') || ' |' else s end)"
    spaced = f"list_transform({even}, lambda s: {S.strip(subs('s', [('^(#{1,6})([^ #])', chr(39) + chr(92) + '1 ' + chr(92) + '2' + chr(39)), (' {2,}', chr(39) + ' ' + chr(39))]))})"
    joined = subs(f"array_to_string({spaced}, chr(10))", [(r"[ \t]*\n[ \t]*", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")])
    return f"split as (select {key}, {lines} as l from {rows}),\ncleaned as (select {key}, {S.strip(joined)} || chr(10) as t from split)"


QUERIES = {
    "strip_html": (strip_html, f"with x as (select page_id, {_BARE} as t from pages) select page_id, length(t) as chars, md5(t) as digest from x"),
    "html_to_markdown": (html_to_markdown, None),
    "clean_markdown": (
        clean_markdown,
        "with r as (select doc_id, '#Title' || chr(9) || '  x' || chr(13) || chr(10) || regexp_replace(text, ' ([a-zA-Z0-9_]+)\\.', ' <b>\\1</b> ....... ', 'g') || chr(10) || chr(10) || chr(10) || chr(10) || '|  | |' || chr(10) || '| a |b|' || chr(10) || '_______ ( q ) <br/>end' as t from documents),\n"
        + _cleaned("r", "doc_id") + "\nselect doc_id, length(t) as chars, md5(t) as digest from cleaned",
    ),
    "clean_tables": (
        clean_tables,
        "with r as (select doc_id, 'before' || chr(10) || chr(10) || '| a | b |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 1 | x\\|y | & |' || chr(10) || '| 1 | z |  |' || chr(10) || chr(10) || text as t from documents),\n"
        + _cleaned("r", "doc_id") + "\nselect doc_id, t as clean from cleaned",
    ),
    "plain_lines": (
        plain_lines,
        f"with l as (select doc_id, list_filter(list_transform(string_split('# Head' || chr(10) || chr(10) || '## ' || text, chr(10)), lambda s: {S.strip('s')}), lambda s: s <> '') as x from documents)"
        f" select doc_id, md5({S.strip("array_to_string(list_transform(x, lambda s: case when starts_with(s, '#') then " + S.strip("ltrim(s, '#')") + " else s end), chr(10))")}) as digest from l",
    ),
    "page_decision": (
        page_decision,
        S.with_(_FEAT, "g as (select *, max(case when page_index = 0 then (not trusted or images > 30) else false end) over (partition by doc_id) as first, ink >= 0.005 as inked from f)",
                "r as (select *, case when not trusted then 'untrusted_text' when images > 30 then 'image_flood' when first then 'first_page' when chars = 0 and inked then 'no_text' when chars < 50 and inked then 'low_text' end as reason from g)")
        + "select doc_id, page_index, case when reason is not null then 'render' when chars = 0 and images = 0 then 'blank' when images > 0 then 'hybrid' else 'text' end as action, reason from r",
    ),
    "ocr_route": (
        ocr_route,
        "with b as (select event_id, coalesce((['Latin', 'Arabic', 'Han', null])[event_id % 4 + 1], 'Han') as script, event_id % 60 as k from events) select event_id, script, case script when 'Latin' then 'small' when 'Han' then 'cjk' else 'general' end as backend, k > 0 and k < 24 as reuse_probe from b",
    ),
    "extraction_rollup": (
        extraction_rollup,
        S.with_(_BLK, "s as (select doc_id, script, count(*) as n from b where role = 'user' group by all)", "m as (select doc_id, max_by(script, n * 10 + cast(script = 'Latin' as int)) as main_script from s group by doc_id)")
        + "select doc_id, count(*) filter (role = 'user') as ocr_blocks, count(*) filter (role <> 'user') as text_blocks, count(distinct page_index) as pages, any_value(main_script) as main_script from b left join m using (doc_id) group by doc_id",
    ),
    "render_markdown": (
        render_markdown,
        S.with_(_BLK, "w as (select *, row_number() over (partition by doc_id, page_index order by block_pos) = 1 as first from b)")
        + "select doc_id, '# chat ' || doc_id || chr(10) || chr(10) || string_agg(case when first then '### ' || page_label || chr(10) || chr(10) else '' end || text, chr(10) || chr(10) order by page_index, block_pos) as markdown from w group by doc_id",
    ),
    "page_safety_net": (
        page_safety_net,
        S.with_(_FEAT, "k as (select *, not trusted or images > 30 as sick, ink >= 0.005 as inked from f)", "w as (select *, max(case when page_index = 0 then sick else false end) over (partition by doc_id) as first from k)",
                "r as (select *, case when not trusted then 'untrusted_text' when images > 30 then 'image_flood' when first then 'first_page' when chars = 0 and inked then 'no_text' when chars < 50 and inked then 'low_text' end as why from w)")
        + "select doc_id, page_index, case when why is null and page_index % 3 = 0 then case when inked then 'render' else 'blank' end when why is not null then 'render' when chars = 0 and images = 0 then 'blank' when images > 0 then 'hybrid' else 'text' end as action,"
        " case when why is null and page_index % 3 = 0 and inked then 'safety_net_force_render' else why end as reason from r",
    ),
    "visual_density": (visual_density, "select doc_id, length(regexp_replace(md5(text), '[^0-9]', '', 'g')) / 32.0 as density from documents"),
    "reading_order": (reading_order, S.with_(_BLK) + "select doc_id, page_index, block_pos, row_number() over (partition by doc_id, page_index order by length(text) % 50, block_pos) as place from b"),
    "settled_blocks": (
        settled_blocks,
        S.with_(_BLK, "x as (select doc_id, block_pos, text, case when block_pos % 2 = 0 then 'a' else 'b' end as backend, case when block_pos % 3 > 0 then ' probe ' end as probe, ([null, 413, 503, null, 0])[doc_id % 5 + 1] as status from b)",
                "y as (select *, coalesce(status between 400 and 499 and probe is not null and backend <> 'a', false) as refused from x)")
        + "select doc_id, block_pos, case when refused then 'probe' when status is not null then '<!-- OCR failed: status ' || status || ' -->' else trim(text) end as final_text, case when refused then 'a' when status is null then backend end as final_backend, case when not refused and status is not null then 'status ' || status end as error from y",
    ),
    "extraction_histograms": (
        extraction_histograms,
        S.with_(_BLK, "x as (select doc_id, page_index, block_pos, script, case when role <> 'user' then 'native_text' when block_pos % 4 = 0 then 'eu' when block_pos % 4 = 2 then 'asia' else 'default' end as bucket from b)",
                "sc as (select doc_id, script, count(*) as n, min(page_index * 1000 + block_pos) as f from x group by all)", "bu as (select doc_id, bucket, count(*) as n from x group by all)",
                "s1 as (select doc_id, string_agg(script || '=' || n, ',' order by script || '=' || n) as scripts, arg_max(script, n * 100000 - f) as dominant_script from sc group by doc_id)",
                "b1 as (select doc_id, string_agg(bucket || '=' || n, ',' order by bucket || '=' || n) as buckets from bu group by doc_id)")
        + "select doc_id, scripts, buckets, dominant_script from s1 join b1 using (doc_id)",
    ),
    "sidecar_counters": (
        sidecar_counters,
        S.with_(_BLK) + "select doc_id, count(distinct page_index) as pages, count(*) filter (role = 'user') as ocr_blocks, round(sum(length(text) / 8.0), 3) as seconds, arg_max('stage' || (block_pos % 3), {'a': length(text) / 8.0, 'b': 'stage' || (block_pos % 3)}) as slowest from b group by doc_id",
    ),
    "job_statuses": (
        job_statuses,
        "with r as (select conv_id, turn, conv_id % 5 = 0 as bad, conv_id % 3 > 0 or turn % 2 = 0 as told, conv_id % 7 = 0 and turn % 2 = 1 and (conv_id % 3 > 0 or turn % 2 = 0) as failed from conversations),"
        " j as (select conv_id as job_id, bool_or(bad) as bad, count(*) filter (not told) as open, min(turn) filter (failed) as first from r group by conv_id),"
        " k as (select job_id, case when bad then 'missing data' when first is not null then 'bad ' || first end as why, open from j)"
        " select job_id, case when why is not null then 'failed' when open > 0 then 'Extracting' else 'extraction_success' end as status, case when why is null and open > 0 then 'Extracting files' else '' end as ui, why as error_reason, case when why is not null then 'file_extractor' end as current_stage from k",
    ),
    "file_statuses": (
        file_statuses,
        "select conv_id as job_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as idx, cast(turn as varchar) as attachment_id, case when not (conv_id % 3 > 0 or turn % 2 = 0) then 'extracting' when conv_id % 7 = 0 and turn % 2 = 1 then 'failed' else 'done' end as status,"
        " case when (conv_id % 3 > 0 or turn % 2 = 0) and conv_id % 7 = 0 and turn % 2 = 1 then 'bad ' || turn end as error from conversations where conv_id % 5 > 0",
    ),
    "attachment_order": (attachment_order, "select conv_id as job_id, string_agg(role, ',' order by turn desc) as roles from conversations group by conv_id"),
    "sidecar": (
        sidecar,
        S.with_(_BLK) + """select doc_id, '[' || string_agg('{"page_index":' || page_index || ',"block_pos":' || block_pos || ',"type":"text","source":"' || case when role = 'user' then 'ocr' else 'native' end || '","char_count":' || length(text) || ',"script":"' || script || '"}', ',' order by page_index, block_pos) || ']' as blocks from b group by doc_id""",
    ),
    "image_fit": (
        image_fit,
        "with s as (select p_partkey, p_size * 100 as w, p_partkey % 5000 + 10 as h from part), a as (select *, floor(w * least(1.0::double, 1540.0::double / greatest(w, h))) as w1, floor(h * least(1.0::double, 1540.0::double / greatest(w, h))) as h1 from s)"
        " select p_partkey, cast(greatest(floor(w1 * least(1.0::double, sqrt(1500000.0::double / greatest(w1 * h1, 1)))), 1) as bigint) as width, cast(greatest(floor(h1 * least(1.0::double, sqrt(1500000.0::double / greatest(w1 * h1, 1)))), 1) as bigint) as height, w < 32 or h < 32 as small from a",
    ),
    "extraction_cache": (
        extraction_cache,
        "with c as (select distinct text from documents where doc_id % 5 = 0) select doc_id, true as hit from documents where text in (select text from c) union all select min(doc_id), false from documents where text not in (select text from c) group by text",
    ),
    "job_validate": (
        job_validate,
        "select event_id as job_id, case event_id % 5 when 3 then 'missing data' when 4 then 'invalid json' when 1 then 'missing user_id' when 2 then 'no attachments' end as reason from events",
    ),
    "job_dlq_split": (job_dlq_split, "select event_id as job_id, case when event_id % 5 = 0 then 'done' else 'dead' end as queue from events"),
    "job_out_events": (
        job_out_events,
        """select event_id as job_id, '{"job_id":' || event_id || ',"user_id":"' || user_id || '","chat_id":"c","message_id":"m","op":"extracted","attachments":[{"attachment_id":"a' || event_id || '","title":"t"}]}' as data from events where event_id % 5 = 0""",
    ),
    "job_status_latest": (job_status_latest, "select user_id, event_type as status from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"),
    "events_by_time": (events_by_time, "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all"),
    "event_sessions": (
        event_sessions,
        "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end as new from events),"
        " s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)"
        ' select user_id, min(ts) as start, max(ts) + interval 12 hour as "end", count(*) as n from s group by user_id, k',
    ),
    "format_registry": (format_registry, "select doc_id, case doc_id % 6 when 0 then 'text' when 1 then 'csv' when 2 then 'structured' when 3 then 'html' when 4 then 'email' end as format from documents"),
}
