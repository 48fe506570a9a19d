"""URL filters: host rules first, then empirical-Bayes reputation of the host.

Labelled outcomes of pages (good or not) are counted per host, registered domain and suffix.  Each level's counts get a
beta-binomial prior from the level above: the prior mean of a host is the shrunk rate of its registered domain, that of a
domain the shrunk rate of its suffix, that of a suffix the overall rate.  The weight of a prior (its number of pseudo-pages) is
fitted per level by the method of moments, from how far the rates of groups differ beyond chance.  A page is blocked
when a lower bound of its host's posterior rate of good pages is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import chosen
from claimloom.session import materialize

THRESHOLD = 0.5
BOUND_SD = 1.64
MIN_WEIGHT, MAX_WEIGHT = 2.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, else nulls.

    ``rules`` are (verdict, "host/path"): they fit the host and its subdomains where the url's path starts with the rule's.
    """
    def column(of):
        out = None
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
            name, slash, start = rule.partition("/")
            fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
            out = F.when(fits, of(verdict, rule)) if out is None else out.when(fits, of(verdict, rule))
        return out if out is not None else F.lit(None).cast("string")

    return column(lambda verdict, rule: F.lit(rule)), column(lambda verdict, rule: F.lit(verdict))


def _labels(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels) and suffix (last label) of a host."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def prior_weight(groups: DataFrame) -> float:
    """Method of moments over one level (n, good, mean): pseudo-pages of the prior, from the spread of rates beyond binomial chance."""
    n, good, p = F.col("n"), F.col("good"), F.col("mean")
    over, scale = groups.agg(F.sum((good - n * p) ** 2 - n * p * (1 - p)), F.sum(n * (n - 1) * p * (1 - p))).first()
    rho = over / scale if scale else 0.0
    return min(max(1 / rho - 1, MIN_WEIGHT), MAX_WEIGHT) if rho > 0 else MAX_WEIGHT


def _shrunk(groups: DataFrame) -> DataFrame:
    """Posterior beta parameters of one level, whose rows hold n, good and the ``mean`` of the level above."""
    weight = prior_weight(groups)
    return (groups.withColumn("a", F.col("good") + weight * F.col("mean"))
            .withColumn("b", F.col("n") - F.col("good") + weight * (1 - F.col("mean")))
            .withColumn("rate", F.col("a") / (F.col("a") + F.col("b"))))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, rate, bound) of every host of ``outcomes`` (host, good): pages without a label have null ``good``.

    Hosts without labelled pages get what their registered domain and suffix say; without any label at all the rate is 1/2.
    """
    count = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    hosts = materialize(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("bigint")), F.lit(0)).alias("good")), "hosts")
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    n, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    above = lambda df, key: df.select(key, F.col("rate").alias("mean"))
    suffixes = _shrunk(count(hosts, "suffix").withColumn("mean", F.lit((good + 1) / (n + 2))))
    domains = _shrunk(count(hosts, "domain", "suffix").join(above(suffixes, "suffix"), "suffix"))
    judged = _shrunk(hosts.join(above(domains, "domain"), "domain"))
    a, b = F.col("a"), F.col("b")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return judged.select("host", "n", "rate", (F.col("rate") - BOUND_SD * spread).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD,
               id_col: str = "page_id", url_col: str = "url", outcome_id: str = "page_id", good_col: str = "good") -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, bound) of every page.

    ``outcomes`` labels some pages by id; where it repeats an id, one bad label makes the outcome bad, and null labels do not count.
    Null urls and urls without ``://`` have an empty host, which is judged like any other.  Repeated pages are
    judged each; empty tables give empty results; further columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    parts = chosen(pages, page_id=id_col, url=url_col).withColumn("url", F.coalesce("url", F.lit(""))).select("page_id", host.alias("host"), path.alias("path"))
    labels = chosen(outcomes, page_id=outcome_id, good=good_col).where("good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    reputation = host_reputation(parts.join(labels, "page_id", "left").select("host", "good"))
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    return (parts.join(reputation, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(told, F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"), "rate", "bound"))
