"""URL filters: longest-prefix rules first, empirical-Bayes host reputation for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for text without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. Ties of length: the earlier rule."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _fit(level: DataFrame) -> tuple[float, float]:
    """Mean and strength of a beta prior for the rates of `level` (columns n, k), by the moments of the beta-binomial.

    Between-unit variance gives the intra-class correlation rho, strength is 1 / rho - 1, with rho held in [0.001, 0.999].
    Four sums over the level, whatever its size.
    """
    s = level.where("n > 0").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not s["m"]:
        return 0.5, 2.0
    n, k = float(s["n"]), float(s["k"])
    mean = (k + 1) / (n + 2)
    within = mean * (1 - mean)
    free = n - s["nn"] / n - (s["m"] - 1)
    spread = s["kk"] - k * k / n  # sum of n (p - mean)^2
    rho = (spread - within * (s["m"] - 1)) / (within * free) if free > 0 else 0.5
    rho = min(0.999, max(0.001, rho))
    return mean, 1 / rho - 1


def hierarchy(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without its port. The suffix is the longest of `suffixes` (such as
    "co.uk") that the host ends with, else the last label; the domain has one label more, if there is one."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    size = F.lit(1)
    for s in sorted(suffixes, key=lambda s: s.count(".")):
        size = F.when(F.concat(F.lit("."), F.array_join(labels, ".")).endswith("." + s), s.count(".") + 1).otherwise(size)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return last(size + 1), last(size)


def reputation(outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Posterior reputation of every host of `outcomes` (host, good): host, domain, suffix, n, k, mean, low, high.

    `good` is true, false or null (not labelled). Rates shrink from host to registered domain to suffix (see hierarchy()) to
    the overall mean; each level's prior strength is fitted to the spread of the level below it. low and high are mean -/+ z
    standard deviations of the host's beta posterior: a normal approximation, as SQL has no beta quantile to compare with.
    Null hosts count as the empty host. An empty table gives an empty result.
    """
    domain, suffix = hierarchy(F.col("host"), suffixes)
    hosts = (
        outcomes.select(F.coalesce("host", F.lit("")).alias("host"), F.col("good").cast("int").alias("g"))
        .groupBy("host")
        .agg(F.count("g").alias("n"), F.coalesce(F.sum("g"), F.lit(0)).alias("k"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    hosts = materialise(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (_, s_host), (_, s_domain), (mean, s_suffix) = _fit(hosts), _fit(domains), _fit(suffixes)

    def shrunk(prior: Column | float, strength: float) -> Column:
        return (F.col("k") + strength * prior) / (F.col("n") + strength)

    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), s_suffix).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("of_suffix"), s_domain).alias("of_domain"))
    a = F.col("k") + s_host * F.col("of_domain")
    b = F.col("n") - F.col("k") + s_host * (1 - F.col("of_domain"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    scored = hosts.join(domains, "domain").withColumn("mean", a / (a + b))
    return scored.select("host", "domain", "suffix", "n", "k", "mean", (F.col("mean") - z * sd).alias("low"), (F.col("mean") + z * sd).alias("high"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, outcomes: DataFrame | None = None, threshold: float = 0.5, id_col: str = "page_id", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Verdict for every page: the longest fitting rule's, else block where the host's posterior upper bound is below
    `threshold` (surely bad), else allow.

    Labelled outcomes are `outcomes` (host, good) or, without them, the pages that a rule decides: reputation then says how
    the rules judged a host's other pages, nothing beyond them. Null URLs have an empty host and path and are judged by the
    empty host's posterior. Repeated rows are judged each, null ids too; other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    pages = pages.select("*", name.alias("rule"), verdict.alias("_v"))
    seen = outcomes if outcomes is not None else pages.select("host", (F.col("_v") == "allow").alias("good"))
    scores = reputation(seen, suffixes=suffixes).select(F.col("host").alias("_h"), "high", "mean")
    joined = pages.join(scores, F.col("host") == F.col("_h"), "left")
    own = F.when(F.col("high") < threshold, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_v", own).alias("verdict"), F.col("mean").alias("reputation"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ruled AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
          FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
h AS (SELECT host, list_extract(string_split(regexp_replace(host, ':[0-9]*$', ''), '.'), -1) AS suffix,
             CASE WHEN contains(host, '.') THEN regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '([^.]*\.[^.]*)$', 1) ELSE regexp_replace(host, ':[0-9]*$', '') END AS domain,
             count(rv)::DOUBLE AS n, count(*) FILTER (rv = 'allow')::DOUBLE AS k FROM ruled GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
lv AS (SELECT 1 AS l, n, k FROM h UNION ALL SELECT 2, n, k FROM d UNION ALL SELECT 3, n, k FROM s),
sums AS (SELECT l, count(*)::DOUBLE AS m, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk FROM lv WHERE n > 0 GROUP BY l),
mom AS (SELECT *, (k + 1) / (n + 2) AS mean, n - nn / n - (m - 1) AS free FROM sums),
fit AS (SELECT l, mean, 1 / least(0.999, greatest(0.001, CASE WHEN free > 0 THEN (kk - k * k / n - mean * (1 - mean) * (m - 1)) / (mean * (1 - mean) * free) ELSE 0.5 END)) - 1 AS st FROM mom),
ps AS (SELECT suffix, (k + st * mean) / (n + st) AS p FROM s, fit WHERE l = 3),
pd AS (SELECT domain, (k + st * p) / (n + st) AS p FROM d JOIN ps USING (suffix), fit WHERE l = 2),
ab AS (SELECT host, k + st * p AS a, n - k + st * (1 - p) AS b FROM h JOIN pd USING (domain), fit WHERE l = 1),
hi AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS high FROM ab)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN high < 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM ruled JOIN hi USING (host)
"""

QUERIES = {"op5_url_filters": op5}
ORACLE_SQL = {"op5_url_filters": _ORACLE}
