"""Host reputation by empirical Bayes, and path rules, in DataFrame functions only.

Labelled outcomes of pages are counted per host, registered domain and suffix. The rate of
bad pages of each level is a beta distribution around the mean of the level above; how firmly
a group's members follow its mean (the weight of the prior) is estimated from how much their
rates differ. A host is blocked if the lower bound of its posterior rate is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (as text, and its verdict), or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _posterior(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Posterior mean and variance of each child's rate under its parent's prior.

    children: (child, parent, n, bad); parents: (parent, mean). With the parent's mean m, the
    spread sum n_i (r_i - m)^2 of k rates is expected to be m (1 - m) (k + c (N - k)), where
    1 / (1 + weight) = c; c is held between 1/1001 and 1/2.
    """
    named = parents.select(parent, F.col("mean").alias("m"))
    held = children.join(named, parent)
    rate = F.col("bad") / F.col("n")
    moments = held.groupBy(parent).agg(
        F.count_if(F.col("n") > 0).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * (rate - F.col("m")) ** 2)).alias("spread"),
        F.first("m").alias("m"),
    )
    over = F.col("spread") / (F.col("m") * (1 - F.col("m"))) - F.col("k")
    shared = F.when(F.col("total") > F.col("k"), over / (F.col("total") - F.col("k"))).otherwise(0.0)
    weight = 1 / F.least(F.greatest(F.coalesce(shared, F.lit(0.0)), F.lit(1 / 1001)), F.lit(0.5)) - 1
    weighted = moments.select(parent, "m", weight.alias("w"))
    a = F.col("bad") + F.col("w") * F.col("m")
    whole = F.col("n") + F.col("w")
    mean = a / whole
    return children.join(weighted, parent).select(
        child, "n", mean.alias("mean"), (mean * (1 - mean) / (whole + 1)).alias("variance")
    )


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, n, mean, variance) from (host, n, bad), counts of labelled and of bad pages.

    Ports and user names don't matter for the domain; the suffix is the last label, the
    registered domain the last two.
    """
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", "")
    named = hosts.withColumns(
        {"domain": F.substring_index(bare, ".", -2), "suffix": F.substring_index(bare, ".", -1), "root": F.lit("")}
    )
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("root", F.lit(""))
    root = suffixes.groupBy("root").agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean"))
    by_suffix = _posterior(suffixes, root, "suffix", "root")
    by_domain = _posterior(domains, by_suffix, "domain", "suffix")
    return _posterior(named, by_domain, "host", "domain")


def judged(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    limit: float = 0.5,
    bound: float = 1.645,
) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of `pages`.

    `outcomes`: (page_id, bad boolean); of repeated ids the worst counts, nulls are left out.
    A rule decides if one fits; else the host is blocked if the posterior mean of its bad
    pages less `bound` standard deviations is above `limit`. Null and odd urls have an empty
    host, which is judged like any other. Other columns are not used.
    """
    host, path = parsed(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = (
        parts.join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad"))
    )
    lower = F.col("mean") - bound * F.sqrt("variance")
    blocked = reputation(counted).select("host", (lower > limit).alias("blocked"))
    text, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return parts.join(blocked, "host", "left").select(
        "page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict")
    )
