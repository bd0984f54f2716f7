"""Secret scan: single-pattern spans, and weak candidates linked with what completes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.store import settle

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same matches as AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # likewise of [0-9a-f]+
#: What says enough by itself, so that it neither is a weak secret nor holds one.
STRONG = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"""
#: Parts of a credential that mean little alone. A weak secret is a whole run of its characters, of any length, with a digit and letters of both cases.
WEAK = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"""(?i:user(?:name|_?id)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}|(?:AKIA|ASIA|AROA)[A-Z0-9]{8,}"""
#: The scheme is bounded, as else a long run of letters would be tried from each of them to its end.
ENDPOINT = r"""(?i:[a-z][a-z0-9+.-]{0,20}://[^\s"'<>]{4,}|(?:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?[a-z0-9.-]{4,})"""
#: Code points between a weak secret and the part that completes it.
SCOPE = 400
#: Matches of a text that are summed up at a time, at least.
STRETCH = 32
#: Stands for each character of what has been found; no pattern takes it.
FILL = "<"


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (g, m, v): each match, its length and that of what lies before it since the last one."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    both = F.zip_with(found, F.split(text, pattern, -1), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("v")))
    return F.filter(both, lambda x: x.m.isNotNull())


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points.

    Running lengths of what lies between matches give positions. Appending to an array copies it, so the
    matches are summed in stretches of about the square root of their number, which are then moved to
    where they begin: a text with very many matches costs little more than its share.
    """
    shape = "array<struct<start:int,end:int,value:string>>"
    none = F.expr(f"cast(array() as {shape})")

    def place(items: Column) -> Column:
        size = F.greatest(F.lit(STRETCH), F.ceil(F.sqrt(F.size(items))).cast("int"))
        parts = F.transform(F.sequence(F.lit(1), F.size(items), size), lambda at: F.slice(items, at, size))
        local = F.transform(
            parts,
            lambda part: F.aggregate(
                part,
                F.expr(f"named_struct('at', 0, 'out', cast(array() as {shape}))"),
                lambda s, x: F.struct(
                    (s.at + x.g + x.m).alias("at"),
                    F.concat(s.out, F.array(F.struct((s.at + x.g).alias("start"), (s.at + x.g + x.m).alias("end"), x.v.alias("value")))).alias("out"),
                ),
            ),
        )
        return _once(local, moved)

    def moved(local: Column) -> Column:
        begins = F.aggregate(
            local,
            F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))"),
            lambda s, x: F.struct((s.at + x.at).alias("at"), F.concat(s.out, F.array(s.at)).alias("out")),
            lambda s: s.out,
        )
        shift = lambda x, by: F.transform(x.out, lambda y: F.struct((y.start + by).alias("start"), (y.end + by).alias("end"), y.value.alias("value")))
        return F.flatten(F.zip_with(local, begins, shift))

    return F.when(text.rlike(pattern), _once(_matches(text, pattern), place)).otherwise(none)


def masked(text: Column, pattern: str) -> Column:
    """``text`` with each match filled, so that positions stay."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(FILL), F.length(m)), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def _joined(kinds: list[tuple[str, str]]) -> Column:
    """kind:start:end by start, then by the order given, joined by commas."""
    def tag(k: int, name: str, column: str) -> Column:
        return F.transform(column, lambda x: F.struct(x.start.alias("start"), F.lit(k).alias("k"), x.end.alias("end"), F.lit(name).alias("kind")))

    tagged = [tag(k, name, column) for k, (name, column) in enumerate(kinds)]
    return F.array_join(
        F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ","
    )


def credential_parts(docs: DataFrame) -> DataFrame:
    """The spans of every kind, one row per document: doc_id, key and an array for each kind.

    ``key`` is the digest of the text; rows alike in doc_id and text have the same parts. Weak secrets and endpoints
    are looked for where no strong match stands, and identifiers where neither of these do: no two parts of
    different roles share a character, so nothing completes a secret twice, nor a secret itself. A secret may stand in an endpoint.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda c: F.transform(c, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    value = lambda x: F.regexp_extract(x.value, ASSIGN, 1)
    raw = docs.select(
        "doc_id",
        F.md5(text).alias("key"),
        plain(F.filter(spans(text, ASSIGN), lambda x: F.length(value(x)) >= 8)).alias("assign"),
        plain(spans(text, ACCESS)).alias("access"),
        plain(spans(text, HEX)).alias("hex"),
        masked(text, STRONG).alias("rest"),
    )
    raw = raw.withColumn("weak", plain(spans(F.col("rest"), WEAK)))
    # Without a weak secret no part is of use.
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    where = lambda found: F.when(F.size("weak") > 0, plain(found)).otherwise(none)
    raw = raw.withColumn("endpoint", where(spans(F.col("rest"), ENDPOINT)))
    return raw.withColumn("identifier", where(spans(masked(masked(F.col("rest"), ENDPOINT), WEAK), IDENTIFIER))).drop("rest")


ROLES = ("identifier", "endpoint", "assign", "access")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of weak secrets with the parts of the same document that may complete them.

    A scope reaches ``scope`` code points to both sides of a secret. Parts, and secrets widened by their scope,
    are dealt to every bin of that length that they touch, so an equi-join on (document, bin) finds every
    neighbour. A widened secret is longer than a bin, so in a bin it touches at most one of its ends lies, and of
    each bin and role only the first start and the last end matter. So a secret meets few rows.

    Complementary are an identifier and an endpoint, or either of them and an assignment or an access key. Returns
    doc_id, key, start, end of the secrets that have such a pair in reach. Parts of different roles should not share characters.
    """
    both = parts.filter("size(weak) > 0 and (size(identifier) + size(endpoint)) > 0")
    role = lambda name: F.transform(name, lambda x: F.struct(F.lit(name).alias("role"), x.start.alias("start"), x.end.alias("end")))
    part = both.select("doc_id", "key", F.explode(F.concat(*(role(r) for r in ROLES))).alias("p"))
    touched = lambda first, last: F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope))).alias("bin")
    ends = (
        part.select("doc_id", "key", "p.role", "p.start", "p.end", touched(F.col("p.start"), F.col("p.end")))
        .groupBy("doc_id", "key", "role", "bin")
        .agg(F.min("start").alias("first"), F.max("end").alias("last"))
    )
    secret = both.select("doc_id", "key", F.explode("weak").alias("w")).select("doc_id", "key", "w.start", "w.end").distinct()
    reach = secret.select("*", touched(F.col("start") - scope, F.col("end") + scope))
    near = reach.alias("s").join(
        ends.alias("r"),
        F.col("s.doc_id").eqNullSafe(F.col("r.doc_id"))
        & (F.col("s.key") == F.col("r.key"))
        & (F.col("s.bin") == F.col("r.bin"))
        & (F.col("r.first") - F.col("s.end") <= scope)
        & (F.col("s.start") - F.col("r.last") <= scope),
    )
    has = lambda name: F.max((F.col("r.role") == name).cast("int")).alias(name)
    return (
        near.groupBy("s.doc_id", "s.key", "s.start", "s.end")
        .agg(*[has(r) for r in ROLES])
        .filter("identifier + endpoint >= 1 and identifier + endpoint + assign + access >= 2")
        .select("doc_id", "key", "start", "end")
    )


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Find secrets in every whole text of ``docs`` (doc_id, text).

    Kinds, in this order: assign, access, hex, and linked, a weak candidate that counts
    only as complementary parts lie within ``scope``. Null texts count as empty; empty
    texts have no spans. Every row returns once, repeated ones too, and null ids stay
    null. Returns doc_id, the spans of each kind as arrays, and spans, all of them joined.
    """
    parts = settle(credential_parts(docs))
    linked = link_parts(parts, scope).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("linked")
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    joined = parts.alias("p").join(
        linked.alias("l"), F.col("p.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("p.key") == F.col("l.key")), "left"
    ).select("p.doc_id", "p.assign", "p.access", "p.hex", F.coalesce("l.linked", none).alias("linked"))
    base = [("assign", "assign"), ("access", "access"), ("hex", "hex")]
    return joined.select("*", _joined(base).alias("base"), _joined([*base, ("linked", "linked")]).alias("spans"))
