"""URL filter by empirical-Bayes host reputation (operator 4, built-ins only).

Labelled page outcomes (bad = low quality or toxic) are shrunk level by level:
the rate of a suffix towards the rate of all labelled pages, that of a
registered domain towards its suffix, that of a host towards its domain. The
strength of each prior is fitted from the spread between the units of a level
(method of moments of the beta-binomial). A host is blocked if the lower bound
of its posterior bad rate exceeds ``lift`` times the rate of all labelled pages, so
that a host goes which is worse than the rest beyond doubt, whatever the share of
bad pages; explicit rules come first. The suffix of a host is its last label, or
the last two of ``SUFFIXES``, and its registered domain has one label more.

Defined results: null urls and urls without ``://`` have empty host and path,
follow no rule and take the posterior of the empty host; hosts that no label
reaches take the posterior mean of the nearest level that has one; labels that
are null are ignored; repeated pages are judged one by one and counted one by
one; a bound that equals the limit is allowed; urls of any length; a run of digits
that is no 64-bit number is no document; no labels at all: everything that no rule
blocks is allowed; an empty table gives no rows; columns of any other name are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path); the longest that fits wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

Z = 1.6448536269514722  # one-sided 95 % bound
LIFT = 1.0
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0

# Public suffixes of two labels, under which owners are unrelated.
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr",
            "com.br", "org.br", "com.ar", "com.mx", "com.cn", "com.tw", "com.hk", "com.sg", "com.tr", "co.in", "co.za", "co.il",
            "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app",
            "wordpress.com"]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    last = F.substring_index(host, ".", -2)
    long = last.isin(SUFFIXES)
    return (F.when(long, F.substring_index(host, ".", -3)).otherwise(last),
            F.when(long, last).otherwise(F.substring_index(host, ".", -1)))


def _strength(units: DataFrame, mean: Column) -> float:
    """Prior strength of a level by moments; a single number."""
    w = units.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - mean, F.lit(2))).alias("ss"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("v")).first()
    c = w.n - w.n2 / w.n if w.n else 0.0
    if not w.n or c <= 0 or w.v <= 0:
        return MAX_STRENGTH
    # between-unit variance as a share of the binomial variance
    v = w.v / w.n
    rho = (w.ss - (w.k - 1) * v) / c / v
    return round(min(max(1 / rho - 1, MIN_STRENGTH), MAX_STRENGTH), 6) if rho > 0 else MAX_STRENGTH


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, lower, rate) of every host of ``pages``; ``rate`` is that
    of all labelled pages.

    pages: host, key; outcomes: key, bad (0/1). Counts are aggregated to hosts
    before anything else, so a host with a third of all pages is one row, and
    the upper levels sum host rows. Only the overall rate and the three prior
    strengths, single numbers, reach the driver."""
    domain, suffix = levels(F.col("host"))
    hosts = stored(
        pages.join(outcomes, "key", "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), F.col("n").cast("double").alias("n"),
                F.col("y").cast("double").alias("y")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    # the overall rate starts at one half
    rate = F.lit(((total.y or 0.0) + 0.5) / ((total.n or 0.0) + 1))

    def shrunk(units: DataFrame, prior: Column) -> tuple[Column, float]:
        s = _strength(units.where("n > 0"), prior)
        return (F.col("y") + s * prior) / (F.col("n") + s), s

    sfx = suffixes.select("suffix", shrunk(suffixes, rate)[0].alias("m1"))
    dom = domains.join(sfx, "suffix")
    dom = dom.select("domain", "suffix", shrunk(dom, F.col("m1"))[0].alias("m2"))
    hst = hosts.join(dom, ["domain", "suffix"])
    mean, s = shrunk(hst, F.col("m2"))
    sd = F.sqrt(F.col("m3") * (1 - F.col("m3")) / (F.col("n") + s + 1))
    return hst.withColumn("m3", mean).select(
        "host", F.col("n").cast("long").alias("n"), F.col("y").cast("long").alias("bad"),
        F.round("m3", 6).alias("mean"), F.round(F.greatest(F.col("m3") - Z * sd, F.lit(0.0)), 6).alias("lower"),
        rate.alias("rate"))


def judge(pages: DataFrame, outcomes: DataFrame, key: Column, lift: float = LIFT) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule, verdict, lower."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                     key.alias("key"))
    rep = reputation(p.select("host", "key"), outcomes)
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("lower") > lift * F.col("rate"), "block").otherwise("allow")
    return (p.join(rep.select("host", "lower", "rate"), "host")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, own).alias("verdict"), "lower"))


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """One outcome per labelled document: the mean vote, bad from one half up."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return (labels.select(F.col("doc_id").alias("key"), bad.alias("bad")).where("key is not null and bad is not null")
            .groupBy("key").agg((2 * F.sum("bad") >= F.count("*")).cast("int").alias("bad")))


def page_document(url: Column) -> Column:
    """Number of the document that a page shows: the last run of digits of the
    path; null without one."""
    return F.regexp_extract(path_of(url), r"([0-9]+)[^0-9]*$", 1).try_cast("long")
