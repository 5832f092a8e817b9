"""URL filters: explicit host and path rules, and an empirical-Bayes reputation of hosts for every other url.

Labelled page outcomes are counted per host. Three beta-binomial levels shrink them: suffix towards all pages, registered domain towards
its suffix, host towards its domain. Each level's prior strength is its children's over-dispersion by moments. A host is blocked when
the lower posterior bound of its share of bad pages passes a threshold.

Everything is DataFrame and SQL functions. Outcomes are summed per host before anything else is shuffled by host, so a host with a third of all
pages is one row; joining the verdict back is an equi join that adaptive execution splits. The reputation tables are joined by key and
never broadcast by hand; only the three prior strengths and the overall mean, four numbers, come to the driver.

A null url or one without :// has an empty host and path; it is judged like a host of its own. Repeated pages are judged each and count each; several label
rows of a page are one outcome, bad if any says so; a label row without values says nothing; without labels every host is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.session import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, host, path prefix)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
Z = 1.645
THRESHOLD = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """Registered domain: the last two labels, or three under a two-letter country code with a short second label (co.uk)."""
    country = host.rlike(r"(^|\.)[a-z]{2,3}\.[a-z]{2}$")
    return F.when(country, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, else nulls."""
    name = verdict = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = name.when(fits, h + p) if name is not None else F.when(fits, h + p)
        verdict = verdict.when(fits, action) if verdict is not None else F.when(fits, action)
    return name, verdict


def _strength(children: DataFrame, low: float = 1.0, high: float = 1000.0) -> float:
    """Prior strength by moments: excess of the children's squared deviation from their parents' mean ``m`` over the binomial one."""
    v = F.col("m") * (1 - F.col("m"))
    got = children.agg(F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2 - F.col("n") * v).alias("over"), F.sum(F.col("n") * (F.col("n") - 1) * v).alias("whole")).first()
    if not got["whole"] or got["over"] is None or got["over"] <= 0:
        return high
    return min(max(got["whole"] / got["over"] - 1, low), high)


def _level(children: DataFrame, key: str) -> DataFrame:
    """(key, m): posterior means of children (key, n, bad, m = parent's mean), the priors of the next level."""
    s = _strength(children)
    return children.select(key, ((s * F.col("m") + F.col("bad")) / (s + F.col("n"))).alias("m"))


def reputations(pages: DataFrame, labels: DataFrame, z: float = Z) -> DataFrame:
    """(host, lower, mean): posterior of the share of bad pages for every host of ``pages`` (page_id, host)."""
    outcome = (labels.select(F.col("doc_id").cast("long").alias("page_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("bad"),
                             F.coalesce(F.col("quality"), F.col("toxic")).isNotNull().alias("known"))
               .filter("known AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad")))
    hosts = (pages.join(outcome, "page_id", "left").groupBy("host")
             .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
             .withColumns({"domain": domain_of(F.col("host")), "suffix": F.substring_index("host", ".", -1)}))
    # One small row per host, written once: the three levels and their strengths all read it.
    hosts = checkpointed(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_pages = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (all_pages["bad"] or 0) / all_pages["n"] if all_pages["n"] else 0.0
    by_suffix = _level(suffixes.withColumn("m", F.lit(overall)), "suffix")
    by_domain = _level(domains.join(by_suffix, "suffix"), "domain")
    under = hosts.join(by_domain, "domain")
    s = _strength(under)
    total = F.col("n") + s
    mean = (s * F.col("m") + F.col("bad")) / total
    judged = under.select("host", "n", "bad", mean.alias("mean"), total.alias("total"))
    return judged.select("host", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))).alias("lower"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, and the reputation it rests on: labelled pages of the host, mean and lower bound of its bad share."""
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    fame = reputations(rows.select("page_id", "host"), labels, z)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return (rows.join(fame, "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(action, F.when(F.col("lower") > threshold, "block").otherwise("allow")).alias("verdict"),
                    F.col("n").alias("n_labelled"), F.round("mean", 6).alias("bad_share"), F.round("lower", 6).alias("bad_lower")))
