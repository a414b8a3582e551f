"""URL rules, and empirical-Bayes host reputation where no rule fits.

Labelled page outcomes are counted per host. A host's rate of bad pages has a beta
prior centred on the rate of the rest of its registered domain, which is shrunk to that of
the rest of its suffix, which is shrunk to that of all labelled pages. How strong each
prior is follows from the overdispersion of the counts at that level (beta-binomial
moments), and never exceeds the evidence it rests on. A host is blocked when the lower
bound of its posterior rate is above the threshold.

All work is per host after one aggregation that combines before its shuffle; pages
meet their host's row in one join, which AQE splits when a host is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Overdispersion is held to this range, so a prior is worth between 2 and 999 pages.
LEAST_RHO, MOST_RHO = 0.001, 1 / 3


def url_host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)", 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def _rho(level: DataFrame, p: str) -> float:
    """Overdispersion of counts (n, bad) around the rates in column ``p``."""
    row = level.agg(
        F.sum((F.col("bad") - F.col("n") * F.col(p)) * (F.col("bad") - F.col("n") * F.col(p)) - F.col("n") * F.col(p) * (1 - F.col(p))).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col(p) * (1 - F.col(p))).alias("pairs"),
    ).first()
    rho = row.over / row.pairs if row.pairs else MOST_RHO
    return min(max(rho, LEAST_RHO), MOST_RHO)


def host_reputation(hosts: DataFrame, suffixes: tuple[str, ...] = (), z: float = 1.645) -> DataFrame:
    """``hosts(host, n, bad)`` with posterior mean, sd and lower bound of the bad-page rate.

    The suffix is the last label, or the longest of ``suffixes`` (such as co.uk) that
    fits; the registered domain is one label more. n may be 0: the posterior is then the
    prior. The three priors' strengths are single numbers, read by the driver.
    """
    suffix = F.substring_index("host", ".", -1)
    domain = F.substring_index("host", ".", -2)
    for s in sorted(suffixes, key=len):
        dots = s.count(".") + 1
        fits = (F.col("host") == s) | F.endswith(F.col("host"), F.lit("." + s))
        suffix = F.when(fits, F.lit(s)).otherwise(suffix)
        domain = F.when(fits, F.substring_index("host", ".", -dots - 1)).otherwise(domain)
    hosts = materialize(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    n, bad = F.col("n"), F.col("bad")
    suffixes_ = materialize(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("p", (F.lit(float(total.bad + 1)) - bad) / (F.lit(float(total.n + 2)) - n)), "suffixes")
    # A prior is worth what its level's overdispersion says, but no more than the evidence behind it.
    weight = F.least(F.lit(1 / _rho(suffixes_, "p") - 1), F.lit(float(total.n + 2)) - n)
    up = suffixes_.select("suffix", n.alias("up_n"), bad.alias("up_bad"), weight.alias("up_w"), F.col("p").alias("up_p"))
    # What a suffix, domain or host itself has shown is left out of its prior.
    rest_n, rest_bad = F.col("up_n") - n, F.col("up_bad") - bad
    prior = ((rest_bad + F.col("up_w") * F.col("up_p")) / (rest_n + F.col("up_w"))).alias("p")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(up, "suffix")
    domains = materialize(domains.select("domain", "n", "bad", prior, (rest_n + F.col("up_w")).alias("held")), "domains")
    up = domains.select("domain", n.alias("up_n"), bad.alias("up_bad"), F.least(F.lit(1 / _rho(domains, "p") - 1), F.col("held")).alias("up_w"), F.col("p").alias("up_p"))
    out = hosts.join(up, "domain").select("host", "n", "bad", prior, (rest_n + F.col("up_w")).alias("held"))
    out = materialize(out, "priors")
    w = F.least(F.lit(1 / _rho(out, "p") - 1), F.col("held"))
    out = out.withColumns({"alpha": bad + w * F.col("p"), "beta": n - bad + w * (1 - F.col("p"))})
    size = F.col("alpha") + F.col("beta")
    out = out.withColumns({"mean": F.col("alpha") / size, "sd": F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))})
    return out.withColumn("lower", F.greatest(F.col("mean") - z * F.col("sd"), F.lit(0.0)))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.3, suffixes: tuple[str, ...] = (), z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_rate_lower) for each row of ``pages(page_id, url)``.

    ``rules`` are (verdict, host/path); one fits its host and all subdomains when the
    path starts with the rule's, and the longest (then the first by text) wins.
    ``outcomes(page_id, bad)`` are labelled pages: repeated ids count once, as bad if any is;
    null ids or outcomes count as unlabelled. Null urls, and those without ``://``, have
    empty host and path, and share the empty host's posterior. Repeated pages keep their rows; empty tables are allowed.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path"))
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("labelled_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = rows.select("page_id", "host").join(labelled, F.col("page_id") == F.col("labelled_id"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = host_reputation(counts, suffixes, z)
    hosts = hosts.select("host", F.round("mean", 6).alias("bad_rate"), F.round("lower", 6).alias("bad_rate_lower"), F.when(F.col("lower") > threshold, "block").otherwise("allow").alias("own"))

    # Rules meet hosts by an equality of host suffixes: a host has as many as it has labels.
    listed = spark.createDataFrame([(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for v, r in rules], "rule_host string, rule_path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(ends).alias("rule_host")).join(F.broadcast(listed) if len(rules) <= 100_000 else listed, "rule_host")
    fits = fits.groupBy("host").agg(F.array_sort(F.collect_set(F.struct((-F.length("rule")).alias("order"), "rule", "rule_path", "verdict"))).alias("rules"))
    hosts = materialize(hosts.join(fits, "host", "left").withColumnRenamed("host", "known_host"), "verdicts")
    out = rows.join(hosts, F.col("host") == F.col("known_host"), "left")
    out = out.withColumn("hit", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), 0))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "own").alias("verdict"), "bad_rate", "bad_rate_lower")
