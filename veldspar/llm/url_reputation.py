"""URL filter: rules by host and path first, then empirical-Bayes host reputation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.store import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Second-level labels under which registries of a country sell names, a selection of the public suffix list (publicsuffix.org).
# ``read_suffixes`` takes the whole list from a copy of it.
SECOND_LEVEL = {
    "ar": ("com", "edu", "gob", "net", "org"),
    "au": ("asn", "com", "edu", "gov", "id", "net", "org"),
    "br": ("com", "edu", "gov", "net", "org"),
    "cn": ("ac", "com", "edu", "gov", "net", "org"),
    "hk": ("com", "edu", "gov", "net", "org"),
    "id": ("ac", "co", "go", "net", "or", "sch", "web"),
    "il": ("ac", "co", "gov", "net", "org"),
    "in": ("ac", "co", "edu", "firm", "gen", "gov", "ind", "net", "nic", "org"),
    "jp": ("ac", "ad", "co", "ed", "go", "gr", "lg", "ne", "or"),
    "kr": ("ac", "co", "go", "ne", "or", "re"),
    "mx": ("com", "edu", "gob", "net", "org"),
    "my": ("com", "edu", "gov", "net", "org"),
    "nz": ("ac", "co", "geek", "gen", "govt", "net", "org", "school"),
    "sg": ("com", "edu", "gov", "net", "org"),
    "th": ("ac", "co", "go", "in", "net", "or"),
    "tr": ("com", "edu", "gen", "gov", "net", "org", "web"),
    "tw": ("com", "edu", "gov", "net", "org"),
    "uk": ("ac", "co", "gov", "ltd", "me", "net", "nhs", "org", "plc", "sch"),
    "za": ("ac", "co", "gov", "net", "org", "web"),
}
SUFFIXES = tuple(f"{second}.{top}" for top, seconds in SECOND_LEVEL.items() for second in seconds)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a parent of it) and starts the path, and its action."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def read_suffixes(lines: Iterable[str]) -> tuple[str, ...]:
    """Suffixes of several labels from the lines of a copy of the public suffix list; rules with wildcards and exceptions are left out."""
    rules = (line.split()[0].lower() for line in lines if line.strip() and not line.startswith("//"))
    return tuple(sorted({r for r in rules if "." in r and r[0] not in "*!"}))


def parents(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host. A suffix in ``suffixes`` that ends the host, the longest, counts; else the last label does."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    depth = F.lit(1)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        tail = F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
        depth = F.when((n >= k) & tail.isin(*[s for s in suffixes if s.count(".") + 1 == k]), k).otherwise(depth)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return last(depth + 1), last(depth)


def _strength(groups: DataFrame, low: float, high: float) -> tuple[float, float]:
    """Mean and prior strength of a level's beta-binomial by the method of moments (one row to the driver)."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    g, total, bad, squares, spread = (
        groups.filter("n > 0")
        .agg(F.count(F.lit(1)), F.sum(n), F.sum(k), F.sum(n * n), F.sum(k * k / n))
        .first()
    )
    if not g:
        return 0.5, low
    mean = bad / total
    noise = mean * (1 - mean)
    free = total - squares / total
    between = max(0.0, (spread - bad * bad / total - (g - 1) * noise) / free) if free > 0 else 0.0
    strength = noise / between - 1 if between > 0 else high
    return mean, min(high, max(low, strength))


def host_reputation(
    hosts: DataFrame, low: float = 2.0, high: float = 200.0, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """Posterior of each host's rate of bad pages.

    ``hosts`` has host, n (labelled pages) and k (bad ones among them). A suffix is shrunk
    towards all pages, a registered domain towards its suffix and a host towards its
    domain, each by a beta prior whose strength comes from the level's own counts.
    Returns host, n, k, rate, lower and upper (``z`` standard deviations off the mean).
    Hosts without labels have their domain's rate; without any labels it is 0.5.
    """
    domain, suffix = parents(F.col("host"), suffixes)
    hosts = settle(hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")))
    domains = settle(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = settle(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    mean, s1 = _strength(suffixes, low, high)
    _, s2 = _strength(domains, low, high)
    _, s3 = _strength(hosts, low, high)
    by_suffix = suffixes.select("suffix", ((F.col("k") + s1 * mean) / (F.col("n") + s1)).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select(
        "domain", ((F.col("k") + s2 * F.col("suffix_rate")) / (F.col("n") + s2)).alias("domain_rate")
    )
    a = F.col("k") + s3 * F.col("domain_rate")
    b = F.col("n") - F.col("k") + s3 * (1 - F.col("domain_rate"))
    rate, sd = F.col("a") / (F.col("a") + F.col("b")), F.sqrt(
        F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1))
    )
    return (
        hosts.join(by_domain, "domain")
        .select("host", "n", "k", a.alias("a"), b.alias("b"))
        .select("host", "n", "k", rate.alias("rate"), (rate - z * sd).alias("lower"), (rate + z * sd).alias("upper"))
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    max_bad: float = 0.25,
    z: float = 1.645,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """Judge the url of every row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, bad) tells of some pages whether they are bad (1) or good (0);
    null ids and null outcomes are ignored, and a page told of twice is bad if it is once.
    A rule that fits gives the verdict; else the url is blocked if the lower posterior
    bound of its host's bad rate exceeds ``max_bad``. Null urls and urls without ``://``
    have empty host and path and share the reputation of the empty host. Every row
    returns once, repeated ones too; null page ids stay null. Other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    told = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        pages.select("page_id", "host")
        .join(told, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    )
    reputation = settle(
        host_reputation(hosts, z=z, suffixes=suffixes).select(
            "host", F.when(F.col("lower") > max_bad, "block").otherwise("allow").alias("by_host")
        )
    )
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    return pages.join(reputation, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.col("by_host")).alias("verdict")
    )
