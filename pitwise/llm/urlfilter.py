"""URL filters by rules and empirical-Bayes host reputation, in DataFrame functions only.

A page is judged by the longest rule that fits its host and path; where none fits,
by its host's reputation.  Labelled page outcomes (good or not) are counted by
host, and shrunk from host to registered domain to suffix to all pages:

* the rate of good pages of each level is the mean of a beta posterior whose
  prior mean is the level above it;
* a level's prior strength M comes from how much its members differ from the
  level above (method of moments of the beta-binomial): with n pages, k of them
  good, and mean m above, ``sum (k - nm)^2 = sum nm(1-m) (1 + (n-1) rho)`` and
  ``M = 1/rho - 1``;
* a host is blocked only if even the upper bound of its posterior is below
  ``least_good``.  The bound holds for every beta distribution: the mean plus the
  lesser of Cantelli's and the sub-Gaussian margin at ``risk``.

So a host with few labelled pages is judged by its domain, one without any by its
domain or suffix alone, and thin evidence blocks nothing.

Defined cases: a url that is null or has no ``://`` has an empty host and path,
and is judged like any host; pages with a null id have no outcome; null outcomes
count nothing; repeated pages count again; no pages give no rows; without any
outcome all hosts have the prior rate of one half and none is blocked.  Columns
named like added ones are replaced.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.storage import cut, fresh

#: Common second-level suffixes under which domains are registered.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz",
                "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")
ADDED = ("host", "path", "rule", "verdict", "good_rate", "good_bound")
#: A host of more than one in so many pages is joined by broadcast: there are at most so many of them.
HOT_SHARE = 1_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for a text without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host/path) that fits, and its verdict; null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's.  Of equally long rules the first
    in code-point order counts."""
    fits, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        cond = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        fits.append(F.when(cond, F.lit(rule)))
        verdicts.append(F.when(cond, F.lit(verdict)))
    none = F.lit(None).cast("string")
    return F.coalesce(*fits, none), F.coalesce(*verdicts, none)


def domain_parts(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user, port and final dot. An address of digits is its own domain."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    last, last2, last3 = (F.substring_index(name, ".", -i) for i in (1, 2, 3))
    two = last2.isin(*second_level)
    digits = name.rlike(r"^[0-9.]+$|^\[")
    return (F.when(digits, name).when(two, last3).otherwise(last2),
            F.when(digits, F.lit("")).when(two, last2).otherwise(last))


def _strength(rows: DataFrame, mean: Column) -> float:
    """Prior strength from members (n, k) of a level and the mean above each."""
    spread = F.pow(F.col("k") - F.col("n") * mean, 2)
    inner = mean * (1 - mean)
    got = rows.where("n > 0").agg(F.sum(spread).alias("s"), F.sum(F.col("n") * inner).alias("a"),
                                  F.sum(F.col("n") * (F.col("n") - 1) * inner).alias("b")).first()
    rho = (got["s"] - got["a"]) / got["b"] if got["b"] else 1.0
    return 1 / min(max(rho, 1e-4), 0.5) - 1


def _shrunk(mean: Column, strength: float) -> Column:
    return (F.col("k") + F.lit(strength) * mean) / (F.col("n") + F.lit(strength))


def _join_unique(rows: DataFrame, table: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once; ``weights`` (key, rows) tells hot keys.

    Keys of more than 1 in HOT_SHARE rows, of which there are at most HOT_SHARE, are broadcast; others are shuffled."""
    total = weights.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(weights.where(F.col("rows") * HOT_SHARE > total).select(key))
    inner = table.join(hot, key, "left_semi")
    return rows.join(F.broadcast(inner), key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def host_reputation(pages: DataFrame, outcomes: DataFrame, risk: float = 0.05, host: str = "host", key: str = "page_id",
                    outcome_key: str = "page_id", good: str = "good") -> DataFrame:
    """One row per host of ``pages``: host, rows, n (labelled), k (good ones), good_rate, good_bound (upper).

    ``outcomes`` has the page's key and 0 or 1 in ``good``; several outcomes of one page all count.
    """
    told = (outcomes.where(F.col(good).isNotNull() & F.col(outcome_key).isNotNull()).groupBy(F.col(outcome_key).alias("id"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(good).cast("long")).alias("k")))
    seen = cut(pages.groupBy(F.col(key).alias("id"), F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("rows")))
    labelled = seen.join(told, "id").groupBy("host").agg(F.sum(F.col("n") * F.col("rows")).alias("n"), F.sum(F.col("k") * F.col("rows")).alias("k"))
    rows = seen.groupBy("host").agg(F.sum("rows").alias("rows")).join(labelled, "host", "left")
    domain, suffix = domain_parts(F.col("host"))
    zero = F.lit(0).cast("long")
    hosts = cut(rows.select("host", "rows", F.coalesce("n", zero).alias("n"), F.coalesce("k", zero).alias("k"),
                            domain.alias("domain"), suffix.alias("suffix")))
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.count(F.lit(1)).alias("rows"), *counts))
    suffixes = cut(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("rows"), *counts))
    n, k = suffixes.agg(F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("k"), zero)).first()
    mean = F.lit((k + 1) / (n + 2))
    suffixes = suffixes.withColumn("above", _shrunk(mean, _strength(suffixes, mean)))
    domains = cut(_join_unique(domains, suffixes.select("suffix", "above"), "suffix", suffixes.select("suffix", "rows")))
    # the names of a suffix and of a domain may be equal (a host of one label), so domains are met with their suffix
    place = F.concat_ws("/", "suffix", "domain")
    mean = F.col("above")
    domains = cut(domains.select(place.alias("place"), "rows", _shrunk(mean, _strength(domains, mean)).alias("above")))
    hosts = cut(_join_unique(hosts.withColumn("place", place), domains.select("place", "above"), "place", domains.select("place", "rows")))
    strength = _strength(hosts, mean)
    rate, weight = _shrunk(mean, strength), F.col("n") + F.lit(strength)
    variance = rate * (1 - rate) / (weight + 1)
    margin = F.least(F.sqrt(variance * ((1 - risk) / risk)), F.sqrt(math.log(1 / risk) / (2 * (weight + 1))))
    return hosts.select("host", "rows", "n", "k", rate.alias("good_rate"), F.least(rate + margin, F.lit(1.0)).alias("good_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), least_good: float = 0.5,
               risk: float = 0.05, key: str = "page_id", url: str = "url", outcome_key: str = "page_id", good: str = "good") -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule (or null), verdict (allow or block), good_rate, good_bound."""
    kept = [c for c in pages.columns if c.lower() not in ADDED]
    host, path = url_parts(F.col(url))
    own, id_, rule_, said_ = fresh(kept + list(ADDED), "own_host", "own_id", "own_rule", "own_verdict")
    reputation = cut(host_reputation(pages.select(F.col(key).alias(id_), host.alias(own)), outcomes, risk, own, id_, outcome_key, good))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    rule, said = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({rule_: rule, said_: said})
    judged = _join_unique(rows, reputation.select("host", "good_rate", "good_bound"), "host", reputation.select("host", "rows"))
    verdict = F.coalesce(F.col(said_), F.when(F.col("good_bound") < least_good, "block").otherwise("allow"))
    return judged.select(*kept, "host", "path", F.col(rule_).alias("rule"), verdict.alias("verdict"), "good_rate", "good_bound")


def keep_allowed(pages: DataFrame, outcomes: DataFrame, **options: object) -> DataFrame:
    """The rows of ``pages`` that are allowed, with their own columns."""
    kept = [c for c in pages.columns if c.lower() not in ADDED]
    verdict, = fresh(kept, "verdict")
    return judge_urls(pages, outcomes, **options).withColumnRenamed("verdict", verdict).where(F.col(verdict) == "allow").select(*kept)
