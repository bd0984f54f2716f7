"""SQL that DuckDB runs on the same tables, for the queries that SQL can express."""

from __future__ import annotations

from veldspar.llm import language, licenses, mixing, near_dedup, secrets, url_reputation


def exact_dedup_sql() -> str:
    return r"""
with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by k) as group_size, row_number() over w = 1 as kept, sha256(k) as text_sha256
from n window w as (partition by k order by length(t) desc, doc_id)"""


def _inverse(share: str, points) -> str:
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False)]
    total, before, cases = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(points, points[1:], strict=False), areas, strict=True):
        slope = (w1 - w0) / (t1 - t0)
        need = f"({share} * {total}::double - {before}::double)"
        cases.append((before, f"{t0}::double + 2.0::double * {need} / ({w0}::double + sqrt({w0 * w0}::double + {2.0 * slope}::double * {need}))"))
        before += area
    sql = cases[0][1]
    for start, at in cases[1:]:
        sql = f"case when {share} * {total}::double < {start}::double then {sql} else {at} end"
    return sql


def mixing_sql(weights=(5, 2, 1), epochs: float = 1.5, most: float = 2.0, curriculum=mixing.CURRICULUM) -> str:
    share = "((p + 0.0::double) / nullif(demand, 0))"
    position = "case class " + " ".join(f"when {k} then {_inverse(share, curriculum[k])}" for k in range(len(weights))) + " end"
    position = position.replace("(p + 0.0::double)", "(first + before)::double").replace("nullif(demand, 0)", "nullif(demand, 0)::double")
    return rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(doc_id::varchar, '')) as digest from documents),
s as (select source, sum(size)::bigint as words from d group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as rank from s),
w as (select source, words, rank, rank % {len(weights)} as class, ([{", ".join(f"{float(x)}::double" for x in weights)}])[rank % {len(weights)} + 1] as weight, {most}::double * words as cap from r),
v as (select *, cap / weight as ratio, {epochs}::double * (select sum(words)::bigint from s) as total from w),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, rank rows between current row and unbounded following) as level from v),
c as (select *, ratio <= level as capped from l),
t as (select source, words as source_size, class, case when capped then cap else weight * (select min_by(level, (ratio, rank)) from c where not capped) end as target from c),
x as (select d.*, source_size, class, target, cast(floor(target + 0.5) as bigint) as demand,
  coalesce(sum(size) over (partition by d.source order by digest, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from d join t on d.source is not distinct from t.source),
y as (select *, greatest(0, least(size, demand - before)) as first_taken, greatest(0, least(size, demand - before - source_size)) as second_taken, 0::bigint as first from x)
select doc_id, size, source_size, target, first_taken + second_taken as taken, case when first_taken > 0 then {position} end as position from y"""


def licenses_sql(templates=licenses.TEMPLATES, threshold: float = licenses.THRESHOLD) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, [{', '.join(quote(g) for g in licenses.bigrams_of(text))}])" for name, text in sorted(templates.items()))
    normal = "trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    several = r"lambda u: regexp_matches(u, '\n|\r')"
    places = licenses.anchored(templates, licenses.anchor_words(templates, threshold))
    offsets = ", ".join(f"({quote(name)}, {quote(g)}, {k}, {len(licenses.words_of(templates[name]))})" for name, own in sorted(places.items()) for g, at in own.items() for k in at)
    bigrams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
with t as (select * from (values {rows}) as t(name, grams)),
o as (select * from (values {offsets}) as o(name, gram, k, n)),
u as (select doc_id, unnest(list_distinct(list_transform(list_concat(string_split_regex(coalesce(text, ''), '\n|\r'),
  list_filter(list_concat(string_split_regex(coalesce(text, ''), '\n[ \t\r]*\n'), [coalesce(text, '')]), {several})), lambda u: {normal}))) as unit from documents),
g as (select doc_id, {bigrams} as grams from (select doc_id, string_split(unit, ' ') as w from u)),
ww as (select doc_id, string_split({normal}, ' ') as words from (select doc_id, coalesce(text, '') as u from documents)),
p as (select doc_id, unnest(range(1, len(words))) as p from ww),
m as (select p.doc_id, p, words[p] || ' ' || words[p + 1] as gram from p join ww using (doc_id)),
b as (select distinct doc_id, name, greatest(p - 1 - k, 0) as s, n from m join o using (gram)),
x as (select doc_id, name, {bigrams} as grams from (select doc_id, name, words[s + 1 : s + n] as w from b join ww using (doc_id))),
every as (select g.doc_id, t.name, g.grams, t.grams as own from g, t union all select x.doc_id, t.name, x.grams, t.grams from x join t using (name)),
s as (select doc_id, name, max(2.0 * len(list_intersect(grams, own)) / (len(grams) + len(own))) as dice from every
  where len(grams) between {threshold / (2 - threshold)} * len(own) - 1e-9 and {(2 - threshold) / threshold} * len(own) + 1e-9 group by all),
h as (select doc_id, string_agg(name, ',' order by name) as licenses, count(*) as n, max(dice) as best from s where dice >= {threshold} group by doc_id)
select d.doc_id, coalesce(licenses, '') as licenses, coalesce(n, 0) as n_licenses, coalesce(best, 0)::double as best from documents d left join h using (doc_id)"""


def secrets_sql(scope: int = secrets.SCOPE) -> str:
    """Spans by lengths of what stands before; a weak secret is a run that holds a digit and letters of both cases."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    run = r"[A-Za-z0-9+/_=-]{20,}"
    mixed = lambda x: f"regexp_matches({x}, '[0-9]') and regexp_matches({x}, '[a-z]') and regexp_matches({x}, '[A-Z]')"

    def spans(text: str, pattern: str, kind: str, source: str, keep: str = "true") -> str:
        found, gaps = f"regexp_extract_all({text}, {quote(pattern)})", f"string_split_regex({text}, {quote(pattern)})"
        each = f"select doc_id, f, g, unnest(range(1, len(f) + 1)) as i from (select doc_id, {found} as f, {gaps} as g from {source})"
        start = "cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as int)"
        return f"select doc_id, '{kind}' as kind, a, a + length(v) as b from (select doc_id, {start} as a, f[i] as v from ({each})) where {keep}"

    def masked(text: str, pattern: str, when: str = "true") -> str:
        found, gaps = f"regexp_extract_all({text}, {quote(pattern)})", f"string_split_regex({text}, {quote(pattern)})"
        fill = f"list_transform({found}, lambda x: case when {when} then repeat('{secrets.FILL}', length(x)) else x end)"
        return f"array_to_string(list_transform(list_zip({gaps}, {fill}), lambda z: z[1] || coalesce(z[2], '')), '')"

    value = f"length(regexp_extract(v, {quote(secrets.ASSIGN)}, 1)) >= 8"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
r as (select doc_id, {masked('t', secrets.STRONG)} as t from d),
n0 as (select doc_id, {masked('t', secrets.ENDPOINT)} as t from r),
n as (select doc_id, {masked('t', run, mixed('x'))} as t from n0),
base as ({spans('t', secrets.ASSIGN, 'assign', 'd', value)} union all {spans('t', secrets.ACCESS, 'access', 'd')} union all {spans('t', secrets.HEX, 'hex', 'd')}),
weak as ({spans('t', run, 'linked', 'r', mixed('v'))}),
part as (select * from base where kind <> 'hex' union all {spans('t', secrets.ENDPOINT, 'endpoint', 'r')} union all {spans('t', secrets.IDENTIFIER, 'identifier', 'n')}),
linked as (select w.doc_id, w.kind, w.a, w.b from weak w join part p on p.doc_id = w.doc_id and p.a - w.b <= {scope} and w.a - p.b <= {scope} group by all
  having count(distinct p.kind) >= 2 and count(*) filter (p.kind in ('identifier', 'endpoint')) > 0),
listed as (select *, list_position(['assign', 'access', 'hex', 'linked'], kind) as k, kind || ':' || a || ':' || b as s from (select * from base union all select * from linked)),
told as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(s, ',' order by a, k, b) filter (kind <> 'linked') as base, string_agg(s, ',' order by a, k, b) as spans from listed group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join told using (doc_id)"""


def near_dedup_sql(percent: int = near_dedup.PERCENT, width: int = near_dedup.WIDTH) -> str:
    """Every pair that shares a shingle, and what is reachable by links."""
    return rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= {width} then list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from d),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
pair as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
link as (select a, b from pair where 100 * k >= {percent} * (na + nb - k)),
sym as (select a, b from link union all select b, a from link),
reach as (select a, b from sym union select r.a, l.b from reach r join sym l on r.b = l.a),
lowest as (select a, min(b) as b from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id, doc_id <= coalesce(b, doc_id) as kept from s left join lowest on a = doc_id"""


def language_sql() -> str:
    """The fusion for documents, whose languages have no more rows than the model's sample takes: byte trigrams, a model of all rows, and sums by host."""
    word = 4294967296
    gram = f"((((b0 * 40507 + b1 * 548533 + b2 * 204155619) % {word}) * 668265263) % {word}) >> 16"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, nullif(lower(trim(split_part(split_part(coalesce(lang, ''), '-', 1), '_', 1))), '') as declared, source as host from documents),
hx as (select r, hex(encode(' ' || translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ')) as h from d),
octets as (select r, i, cast('0x' || substr(h, 2 * i + 1, 2) as bigint) as b from (select r, h, unnest(range(0, length(h) // 2)) as i from hx)),
k as (select r, i, case when b between 9 and 13 then 32 else b end as b, case when b between 97 and 122 or b >= 128 then 2 when b between 9 and 13 or b = 32 then 1 else 0 end as kind from octets),
g0 as (select r, b as b0, lead(b) over w as b1, lead(b, 2) over w as b2, kind as k0, lead(kind) over w as k1, lead(kind, 2) over w as k2 from k window w as (partition by r order by i)),
g as (select r, {gram} as bucket from g0 where k0 > 0 and k1 > 0 and k2 > 0 and greatest(k0, k1, k2) = 2),
n as (select declared as l, bucket, count(*) as c from g join d using (r) where declared is not null and t <> '' group by all),
tot as (select l, sum(c)::double as total from n group by l),
tab as (select l, bucket, ln((c + 0.5) / (total + {0.5 * language.BUCKETS})) as x, c / total as share from n join tot using (l)),
low as (select l, ln(0.5 / (total + {0.5 * language.BUCKETS})) as floor from tot),
level as (select l, sum(share * x) as usual, any_value(floor) as floor from tab join low using (l) group by l),
langs as (select l, floor, usual + {language.UNKNOWN_LEVEL} * (floor - usual) as unknown from level),
cnt as (select r, count(*) as n from g group by r),
seen as (select r, l, sum(cast(cast(x as float) as double) - cast(cast(floor as float) as double)) as s from g join tab using (bucket) join low using (l) group by all),
ll as (select cnt.r, langs.l, n, (coalesce(s, 0) + n * cast(cast(floor as float) as double)) as s, unknown from cnt, langs left join seen on seen.r = cnt.r and seen.l = langs.l),
best as (select r, n, arg_max(unknown, s) as u from ll group by r, n),
raw as (
  select d.r, langs.l, coalesce(ll.s * least(ll.n, {language.EVIDENCE}) / ll.n, 0) as x from d cross join langs left join ll on ll.r = d.r and ll.l = langs.l
  union all select d.r, '~', coalesce(u * least(n, {language.EVIDENCE}), 0) from d left join best on best.r = d.r),
e as (select r, l, exp(x - max(x) over (partition by r)) as e from raw),
p as (select r, l, e / sum(e) over (partition by r) as p from e),
pd as (select p.*, d.doc_id, d.declared, d.host from p join d using (r)),
everywhere as (select l, (sum(p) + 1) / (sum(sum(p)) over () + count(*) over ()) as q from p group by l),
dl as (select declared, l, sum(p) as c from pd where declared is not null group by all),
dlog as (select declared, l, ln((c + 1) / (sum(c) over (partition by l) + (select count(distinct declared) from dl))) as x from dl),
hs as (select host, l, sum(p) as c from pd where host is not null group by all),
own as (select pd.*, greatest(coalesce(c, p) - p, 0) as c from pd left join hs using (host, l)),
pri as (select own.*, c / 1.0 as cc, sum(c) over (partition by r) as total, q from own join everywhere using (l)),
logs as (select r, doc_id, pri.l, p, ln(greatest(p, 1e-30)) + coalesce(dlog.x, 0) + ln((cc + {language.HOST_WEIGHT} * q) / (total + {language.HOST_WEIGHT})) as x from pri left join dlog on dlog.declared = pri.declared and dlog.l = pri.l),
mass as (select r, max(x) as top from logs group by r),
post as (select r, doc_id, arg_max(l, x) filter (l <> '~') as lang, arg_max(l, p) filter (l <> '~') as by_text, round(exp(max(x) filter (l <> '~') - any_value(top)) / sum(exp(x - top)), 6) as confidence from logs join mass using (r) group by all)
select post.doc_id, lang, confidence, case when regexp_matches(t, '[A-Za-z]|[^\x00-\x7F]') then by_text end as text_lang,
  not regexp_matches(t, '[A-Za-z]|[^\x00-\x7F]') or confidence < {language.MIN_POSTERIOR} as rejected, not (not regexp_matches(t, '[A-Za-z]|[^\x00-\x7F]') or confidence < {language.MIN_POSTERIOR}) as kept
from post join d using (r)"""


def urls_sql(rules=url_reputation.RULES, max_bad: float = 0.25, z: float = 1.645, low: float = 2.0, high: float = 200.0) -> str:
    two = ", ".join(f"'{s}'" for s in url_reputation.SUFFIXES if s.count(".") == 1)
    labels = "string_split(host, '.')"
    depth = f"case when len({labels}) >= 2 and array_to_string({labels}[-2:], '.') in ({two}) then 2 else 1 end"
    fits = []
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", text, what))
    rule = "case " + " ".join(f"when {c} then '{t}'" for c, t, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{w}'" for c, _, w in fits) + " else by_host end"

    def level(name: str, source: str) -> str:
        return f"""
{name}_a as (select count(*)::double as g, sum(n)::double as total, sum(k)::double as bad, sum(n::double * n) as squares, sum(k::double * k / n) as spread from {source} where n > 0),
{name}_b as (select *, bad / total as mean, total - squares / total as free from {name}_a),
{name}_c as (select *, case when free > 0 then greatest(0.0::double, (spread - bad * bad / total - (g - 1) * mean * (1 - mean)) / free) else 0.0::double end as between_ from {name}_b),
{name} as (select case when g = 0 then 0.5::double else mean end as mean,
  case when g = 0 then {low} when between_ > 0 then least({high}::double, greatest({low}::double, mean * (1 - mean) / between_ - 1)) else {high} end as strength from {name}_c)"""

    return rf"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
told as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
hosts as (select host, count(bad) as n, coalesce(sum(bad), 0) as k, array_to_string({labels}[-({depth}):], '.') as suffix, array_to_string({labels}[-({depth} + 1):], '.') as domain
  from p left join told using (page_id) group by host),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
{level("l1", "suffixes")},{level("l2", "domains")},{level("l3", "hosts")},
sr as (select suffix, (k + l1.strength * l1.mean) / (n + l1.strength) as suffix_rate from suffixes, l1),
dr as (select domain, (k + l2.strength * suffix_rate) / (n + l2.strength) as domain_rate from domains join sr using (suffix), l2),
ab as (select host, k + l3.strength * domain_rate as a, n - k + l3.strength * (1 - domain_rate) as b from hosts join dr using (domain), l3),
rep as (select host, case when a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {max_bad} then 'block' else 'allow' end as by_host from ab)
select page_id, host, path, {rule} as rule, {verdict} as verdict from p left join rep using (host)"""


ORACLES = {
    "op1_mixing": mixing_sql(),
    "op3_secrets": secrets_sql(),
    "op4_language": language_sql(),
    "op7_near_dedup": near_dedup_sql(),
    "op8_licenses": licenses_sql(),
    "op9_exact_dedup": exact_dedup_sql(),
    "op10_urls": urls_sql(),
}
