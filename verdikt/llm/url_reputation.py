"""URL filtering by rules and by empirical-Bayes host reputation.

Each labelled page is good or bad. A host's rate of good pages gets a beta prior from its registered domain, whose own
rate gets one from its public suffix, and that one from all labelled pages; how strongly each level follows the one
above is estimated from how much the level's rates differ (method of moments). A host is blocked if the posterior
probability that its rate lies below a bar exceeds ``doubt``, that is if its lower posterior bound lies below the bar,
which is a share of the rate of all labelled pages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import CAPITALS, written

#: Common suffixes of two parts under which names are registered, like uk's; a parameter, as the list of all
#: such suffixes changes and isn't part of this library.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn", "co.za", "com.mx")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if the url is null or has no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits. rules: (verdict, host/path-prefix), few."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer one overrides
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without user, port and final dot: what has a reputation."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def domain_of(site: Column, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more; addresses and single labels stand for themselves. suffixes:
    those of two parts; all others have one."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(r"^[0-9.]+$|^\[|^[^.]*$"), site).when(two.isin(*suffixes), F.substring_index(site, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+$|^\[|^[^.]*$"), F.lit("")).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def beta_below(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(rate < x) for beta(a, b): the regularised incomplete beta function by its continued fraction, over arrays."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    log_gamma = np.frompyfunc(__import__("math").lgamma, 1, 1)
    front = np.exp((log_gamma(p + q) - log_gamma(p) - log_gamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / np.maximum(np.abs(1 - (p + q) * y / (p + 1)), tiny) * np.sign(1 - (p + q) * y / (p + 1) + tiny)
    total = d.copy()
    for m in count(1):  # some root of a + b terms
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total *= d * c
        if not np.any(np.abs(d * c - 1) >= 1e-12):
            break
    value = np.clip(front * total, 0, 1)
    return np.where(turned, 1 - value, value)


def _strength(level: DataFrame, parents: int, most: float = 1000.0) -> float:
    """How many observations the parent's rate is worth to a child: 1 at least, most if the level's rates differ by no
    more than chance, 10 if nothing can be told. level: n, k and the parent's pooled rate."""
    n, spread = F.col("n"), F.col("parent_rate") * (1 - F.col("parent_rate"))
    row = level.filter("n > 0").agg(F.sum(n).alias("w"), F.sum(n * n).alias("q"), F.sum(n * (F.col("k") / n - F.col("parent_rate")) ** 2).alias("e"), F.sum(n * spread).alias("v"), F.count("*").alias("g")).first()
    if not row.g or not row.v or row.w - row.q / row.w <= 0:
        return 10.0
    variance = row.v / row.w
    between = (row.e - max(0, row.g - parents) * variance) / (row.w - row.q / row.w)
    share = min(0.5, max(1 / (1 + most), between / variance))
    return (1 - share) / share


def site_reputation(pages: DataFrame, outcomes: DataFrame, bar_share: float = 0.8, doubt: float = 0.05, site: str = "site", suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> DataFrame:
    """One row per site of pages: n, k (labelled, good), prior_mean, posterior_mean, p_below and blocked. The bar is
    bar_share of the pooled rate of good pages.

    pages: page_id and site; outcomes: page_id and good (boolean, nulls take no part). A page with several outcomes counts
    each of them. Counts are summed before they are shuffled, so a site may have any share of the pages; without any
    outcomes all sites share the flat prior.
    """
    labelled = pages.select("page_id", F.col(site).alias("site")).join(outcomes.select("page_id", "good").filter("good IS NOT NULL"), "page_id")
    counts = labelled.groupBy("site").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    sites = pages.select(F.col(site).alias("site")).distinct().join(counts, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    sites = written(sites.withColumn("domain", domain_of(F.col("site"), suffixes)).withColumn("suffix", suffix_of(F.col("domain"))), "sites")
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.count_if(F.col("n") > 0).alias("g")).first()
    top = (whole.k + 1) / (whole.n + 2)

    pooled = lambda level, key: level.filter("n > 0").select(key, (F.col("k") / F.col("n")).alias("parent_rate"))
    of_suffix = _strength(ends.withColumn("parent_rate", F.lit(top)), 1)
    of_domain = _strength(domains.join(pooled(ends, "suffix"), "suffix"), whole.g)
    of_site = _strength(sites.join(pooled(domains, "domain"), "domain"), domains.filter("n > 0").count())

    shrunk = lambda prior, strength: (F.col("k") + strength * prior) / (F.col("n") + strength)
    ends = ends.select("suffix", shrunk(F.lit(top), of_suffix).alias("suffix_mean"))
    domains = domains.join(ends, "suffix").select("domain", shrunk(F.col("suffix_mean"), of_domain).alias("prior_mean"))
    sites = sites.join(domains, "domain").select("site", "n", "k", "prior_mean", shrunk(F.col("prior_mean"), of_site).alias("posterior_mean"))

    @F.pandas_udf("double")
    def below(a: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for good, bad in a:
            yield pd.Series(beta_below(bar_share * top, good.to_numpy(), bad.to_numpy()))

    prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prior_mean"))) * of_site
    return sites.withColumn("p_below", below(F.col("k") + prior, F.col("n") - F.col("k") + of_site - prior)).withColumn("blocked", F.col("p_below") > doubt)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), bar_share: float = 0.8, doubt: float = 0.05, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the site's figures for every row of pages (page_id, url).

    A fitting rule decides; else the reputation does. Null urls and urls without ``://`` have an empty host, which is
    a site like others; urls may be of any length. Repeated rows are judged each; other columns of either table are left out. The sites' table is
    joined by an ordinary equi-join, whose skew (a site with a third of the pages) adaptive execution splits.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("site", site_of(F.col("host")))
    known = site_reputation(seen, outcomes, bar_share, doubt, suffixes=suffixes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return seen.join(known, "site", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("n").alias("site_labelled"), "posterior_mean", "p_below")
