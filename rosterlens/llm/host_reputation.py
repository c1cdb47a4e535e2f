"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk through beta-binomial priors: the
host towards its registered domain, the domain towards its suffix, the suffix towards all
pages. The weight of each prior comes from the spread of the level's rates (method of
moments). A host's share of bad pages has a beta posterior; the host is blocked when that posterior's lower
quantile exceeds ``threshold``. The quantile is bisected on the regularised incomplete beta function, a continued fraction
folded over a short sequence; beyond ``NORMAL`` observations the normal form stands for it. Plain DataFrame expressions
throughout; pages meet their host's row in a sort-merge join whose hot keys adaptive execution splits.

Reputation belongs to the host without user, port and trailing dots. An IP address is a domain of its own without a suffix.

A null url, or one without ``://``, has an empty host and path and is judged like any host.
Null labels count for nothing; a page labelled more than once counts once for each row.
Repeated pages are judged each; an empty table gives no rows, and without outcomes every
host has the prior rate of one half and is allowed. Only the named columns are read; others
may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import named, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered. Fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
TAIL = 0.05
#: The normal quantile of TAIL, which stands for the beta posterior's where that counts more than NORMAL observations; it is off by 0.00003 there.
Z = 1.6448536269514722
NORMAL = 10_000.0
#: Terms of the continued fraction and halvings of the interval.
TERMS, HALVINGS = 200, 30
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"


def registered_domain(site: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = "".join(re.escape(x) + "|" for x in sorted(suffixes, key=len, reverse=True))
    named_ = F.coalesce(F.nullif(F.regexp_extract(site, rf"([^.]+\.(?:{two}[^.]+))$", 1), F.lit("")), site)
    return F.when(site.rlike(ADDRESS), site).otherwise(named_)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(ADDRESS), "").otherwise(F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_gamma(x: Column) -> Column:
    """Stirling's series, ten places up."""
    z = x + 10
    up = F.log(x)
    for i in range(1, 10):
        up = up + F.log(x + i)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - up


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function."""
    zero = F.struct(F.lit(1.0).alias("c"), (1 / (1 - (a + b) * x / (a + 1))).alias("d"), (1 / (1 - (a + b) * x / (a + 1))).alias("h"))

    def fold(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        one = _let(F.struct((1 + even / s["c"]).alias("c"), (1 / (1 + even * s["d"])).alias("d"), s["h"].alias("h")), lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (t["h"] * t["c"] * t["d"]).alias("h")))
        return _let(one, lambda t: _let(F.struct((1 + odd / t["c"]).alias("c"), (1 / (1 + odd * t["d"])).alias("d"), t["h"].alias("h")), lambda u: F.struct(u["c"].alias("c"), u["d"].alias("d"), (u["h"] * u["c"] * u["d"]).alias("h"))))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda m: m.cast("double")), zero, fold, lambda s: s["h"])


def beta_cdf(x: Column, a: Column, b: Column, log_beta: Column) -> Column:
    """The regularised incomplete beta function, from the side on which the fraction converges fast."""
    far = x > (a + 1) / (a + b + 2)
    sides = F.when(far, F.struct((1 - x).alias("x"), b.alias("a"), a.alias("b"))).otherwise(F.struct(x.alias("x"), a.alias("a"), b.alias("b")))
    part = lambda s: F.exp(s["a"] * F.log(s["x"]) + s["b"] * F.log(1 - s["x"]) - log_beta) / s["a"] * _fraction(s["x"], s["a"], s["b"])
    return _let(sides, lambda s: F.when(far, 1 - part(s)).otherwise(part(s)))


def beta_quantile(tail: float, a: Column, b: Column) -> Column:
    """Where a beta distribution's function reaches ``tail``, to nine places, by bisection."""

    def halve(s: Column, log_beta: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(beta_cdf(mid, a, b, log_beta) < tail, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return _let(log_gamma(a) + log_gamma(b) - log_gamma(a + b), lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), zero, lambda s, _: halve(s, v), lambda s: (s["lo"] + s["hi"]) / 2))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule (``host/path``), or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: len(x[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _strength(level: DataFrame) -> tuple[float, float]:
    """Overall rate and prior weight (alpha + beta) of a level's rates, by moments."""
    s = level.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("*").cast("double").alias("g"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("double").alias("nn"), F.coalesce(F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")), F.lit(0.0)).alias("q"),
    ).first()
    rate = (s["bad"] + 0.5) / (s["n"] + 1.0)
    if s["n"] == 0:
        return rate, 1.0
    spread = s["q"] - 2 * rate * s["bad"] + rate * rate * s["n"]
    within = rate * (1 - rate)
    room = s["n"] - s["nn"] / s["n"] - (s["g"] - 1)
    rho = (spread - within * (s["g"] - 1)) / (within * room) if room > 0 else 0.01
    rho = min(max(rho, 0.01), 0.99)
    return rate, (1 - rho) / rho


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = THRESHOLD,
    tail: float = TAIL,
    shared_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """Verdict on every page.

    ``outcomes`` has ``page_id`` and ``bad`` (boolean). ``rules`` are pairs of action and
    ``host/path``; ``shared_suffixes`` are those of several labels under which names are registered. Columns: page_id, host, path, rule, verdict, n_labelled, bad_mean, bad_low.
    """
    url = named(url_col)
    pages = pages.select(named(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("site", site_of(F.col("host")))
    marks = outcomes.filter("bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    hosts = pages.select("page_id", "site").join(marks, "page_id").groupBy("site").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("site"), shared_suffixes)).withColumn("suffix", suffix_of(F.col("domain")))
    hosts = stored(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate, k_suffix = _strength(suffixes)
    k_domain, k_host = _strength(domains)[1], _strength(hosts)[1]

    def shrunk(prior: Column, k: float) -> Column:
        return (F.coalesce(F.col("bad"), F.lit(0)) + F.lit(k) * prior) / (F.coalesce(F.col("n"), F.lit(0)) + F.lit(k))

    suffixes = suffixes.select("suffix", shrunk(F.lit(rate), k_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), k_domain).alias("domain_mean"), "suffix_mean")
    every = pages.select("site").distinct().withColumn("domain", registered_domain(F.col("site"), shared_suffixes)).withColumn("suffix", suffix_of(F.col("domain")))
    table = (
        every.join(hosts.select("site", "n", "bad"), "site", "left")
        .join(domains.select("domain", "domain_mean"), "domain", "left")
        .join(suffixes, "suffix", "left")
    )
    prior = F.coalesce(F.col("domain_mean"), F.col("suffix_mean"), F.lit(rate))
    weight = F.coalesce(F.col("n"), F.lit(0)) + F.lit(k_host)
    table = table.select("site", F.coalesce("n", F.lit(0)).alias("n_labelled"), shrunk(prior, k_host).alias("bad_mean"), weight.alias("w"))
    normal = F.col("bad_mean") - Z * F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("w") + 1))
    low = F.when(F.col("w") > NORMAL, normal).otherwise(beta_quantile(tail, F.col("bad_mean") * F.col("w"), (1 - F.col("bad_mean")) * F.col("w")))
    # The bound is that of the mean before it is rounded.
    table = table.withColumn("bad_low", F.round(F.greatest(low, F.lit(0.0)), 6)).drop("w").withColumn("bad_mean", F.round("bad_mean", 6))
    # Stored, so that the join's sides are plain shuffles and a host with many pages is split.
    table = stored(table, "verdicts")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    action = F.lit(None).cast("string")
    for what, name in rules:
        action = F.when(F.col("rule") == name, F.lit(what)).otherwise(action)
    own = F.when(F.col("bad_low") > threshold, "block").otherwise("allow")
    return (
        pages.withColumn("rule", rule)
        .join(table, "site", "left")
        .select("page_id", "host", "path", "rule", F.coalesce(action, own).alias("verdict"), "n_labelled", "bad_mean", "bad_low")
    )


