"""URL filter: an allow and block list, and Empirical-Bayes reputations of hosts.

Pages have outcomes (good or bad) for some urls. The bad rate of a host is shrunk towards
that of its registered domain, the domain's towards its suffix's, the suffix's towards the
rate of all labelled pages. Each step is a beta-binomial model: children of a level scatter
around their parent's rate with an overdispersion rho that is estimated by moments over
all children of the level, so the prior weighs 1/rho - 1 observations. A host is blocked
when the lower bound of its posterior bad rate is above the limit.

The registered domain is the last two labels of the host, or one more under a suffix of
several labels (`suffixes`).
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.config import keep

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Overdispersion is kept between these bounds, so a prior weighs 1 to 9999 observations.
RHO = (1e-4, 0.5)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?` or `#`, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty for a null url or one without `://`."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fits(rule: str, host: Column, path: Column) -> Column:
    """Does `host/path` rule fit this host or a domain above it, and the path's start?"""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def longest_rule(rules: Iterable[str], host: Column, path: Column) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        found = F.when(fits(rule, host, path), rule).otherwise(found)
    return found


def suffix_of(host: Column, suffixes: Iterable[str] = ()) -> Column:
    """The public suffix: the longest of `suffixes` that ends the host, else its last label."""
    found = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=lambda s: (len(s), s)):
        found = F.when((host == s) | host.endswith("." + s), s).otherwise(found)
    return found


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label before it, or the host if that is all."""
    head = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) > F.length(suffix) + 1,
                  F.concat(F.substring_index(head, ".", -1), F.lit("."), suffix)).otherwise(host)


def _moments(n: Column, s: Column, m: Column) -> list[Column]:
    spread = (s - n * m) * (s - n * m) - n * m * (1 - m)
    return [F.sum(spread).alias("excess"), F.sum(n * (n - 1) * m * (1 - m)).alias("room")]


def _rho(excess, room) -> float:
    return min(max(excess / room, RHO[0]), RHO[1]) if room else RHO[0]


def _shrunk(s: Column, n: Column, mean: Column, weight: float) -> Column:
    return (mean * weight + s) / (F.lit(weight) + n)


def reputations(hosts: DataFrame, max_bad: float, z: float = 1.645) -> DataFrame:
    """Posterior bad rate and verdict of every host.

    `hosts` has one row per host: host, domain, suffix, n (labelled pages) and bad. It should
    be a written table: it is read once per level. Adds `rate` (the posterior mean), `bound`
    (its lower bound, `z` posterior deviations below) and `verdict`. A host without labels
    has its domain's rate and is judged by the prior alone.

    A collect here brings one row of sums to the driver per level, whatever the size.
    """
    up = keep(hosts.groupBy("suffix", "domain").agg(
        F.sum("n").alias("d_n"), F.sum("bad").alias("d_bad")), "domains")
    top = keep(up.groupBy("suffix").agg(F.sum("d_n").alias("s_n"), F.sum("d_bad").alias("s_bad")),
               "suffixes")
    total = top.agg(F.sum("s_n").alias("n"), F.sum("s_bad").alias("bad")).first()
    mean = F.lit((total.bad or 0) / total.n if total.n else 0.0)
    rate = lambda bad, n: F.when(F.col(n) > 0, F.col(bad) / F.col(n)).otherwise(mean)
    rho_s = _rho(*top.agg(*_moments(F.col("s_n"), F.col("s_bad"), mean)).first())
    domains = up.join(top, "suffix")
    rho_d = _rho(*domains.agg(
        *_moments(F.col("d_n"), F.col("d_bad"), rate("s_bad", "s_n"))).first())
    placed = hosts.join(up, ["suffix", "domain"])
    rho_h = _rho(*placed.agg(
        *_moments(F.col("n"), F.col("bad"), rate("d_bad", "d_n"))).first())
    weight = lambda rho: 1 / rho - 1
    priors = domains.select("suffix", "domain", _shrunk(
        F.col("d_bad"), F.col("d_n"),
        _shrunk(F.col("s_bad"), F.col("s_n"), mean, weight(rho_s)), weight(rho_d)).alias("prior"))
    a = F.col("prior") * weight(rho_h) + F.col("bad")
    b = (1 - F.col("prior")) * weight(rho_h) + (F.col("n") - F.col("bad"))
    return (hosts.join(priors, ["suffix", "domain"])
            .withColumn("a", a).withColumn("b", b)
            .withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))
            .withColumn("bound", F.col("rate") - z * F.sqrt(
                F.col("rate") * (1 - F.col("rate")) / (F.col("a") + F.col("b") + 1)))
            .withColumn("verdict", F.when(F.col("bound") > max_bad, "block").otherwise("allow"))
            .drop("a", "b"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, allow: Iterable[str] = (),
                block: Iterable[str] = (), url: str = "url", key: Column | None = None,
                max_bad: float = 0.2, z: float = 1.645, suffixes: Iterable[str] = ()) -> DataFrame:
    """Judge every page by the longest rule that fits its url, else by its host's reputation.

    `outcomes` has `outcome_key` and boolean `bad`; a page's outcomes are those whose key equals
    `key`, an expression over the page's columns. Returns the columns of `pages` (they win over
    those added if names clash) with host, path, rule, verdict, and the host's labelled, rate
    and bound. Every row comes back, repeated ones too.

    Nulls and odd cases: a null url or one without `://` has the empty host and path, which is a
    host of its own for the reputation; null keys, null outcomes and outcomes of unknown pages
    count nowhere; without any label every rate is 0 and every page without a rule is allowed.
    An empty table gives an empty table.

    One host may hold most pages: outcomes are joined by the page's key and counted before
    the shuffle, and the hosts' verdicts are a written table, so its join with the pages is one
    that Spark broadcasts when small and splits when skewed.
    """
    rules = {**dict.fromkeys(allow, "allow"), **dict.fromkeys(block, "block")}
    parsed = pages.select(F.struct("*").alias("page"), host_of(F.col(url)).alias("host"),
                          path_of(F.col(url)).alias("path"),
                          (F.lit(None) if key is None else key).alias("key"))
    known = (outcomes.where(F.col("outcome_key").isNotNull() & F.col("bad").isNotNull())
             .select(F.col("outcome_key").alias("key"), F.col("bad").cast("long").alias("bad")))
    counted = (parsed.select("host", "key").join(known, "key", "left").groupBy("host")
               .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    suffix = suffix_of(F.col("host"), suffixes)
    hosts = keep(counted.withColumn("suffix", suffix)
                 .withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    judged = keep(reputations(hosts, max_bad, z).select(
        "host", "rate", "bound", F.col("n").alias("labelled"), F.col("verdict").alias("judged")),
        "judged")
    rule = longest_rule(rules, F.col("host"), F.col("path"))
    by_rule = F.when(F.col("rule").isin([r for r, v in rules.items() if v == "allow"]), "allow").when(
        F.col("rule").isNotNull(), "block")
    out = (parsed.drop("key").withColumn("rule", rule).join(judged, "host")
           .withColumn("verdict", F.coalesce(by_rule, "judged")))
    added = [c for c in ("host", "path", "rule", "verdict", "labelled", "rate", "bound")
             if c not in pages.columns]
    return out.select(*[F.col("page").getField(c).alias(c) for c in pages.columns], *added)
