"""Host reputation by empirical Bayes, and rules for hosts and paths: SQL expressions only.

Labelled outcomes of pages (bad or not) are counted by host. The share of bad pages of a host is
shrunk towards that of its registered domain, the domain's towards its suffix, the suffix's towards
all labelled pages: each level is a beta-binomial model whose prior mean is the posterior mean of
the level above and whose prior strength is estimated by the method of moments from the spread of
the level's shares. A host is blocked if the lower bound of its posterior share of bad pages passes
``max_bad``. Hosts without labelled pages have the posterior of what is known above them.

Null or unusable urls have the empty host and path; they form one host like any other. Outcomes
that are null are left out; a page with several outcomes counts each. Urls of any length are read
whole. The suffix of a host is the longest of its endings in a table of suffixes of two or three labels,
else its last label, and the registered domain is the suffix with one label more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgwarden.sources.tables import settle


@dataclass(frozen=True)
class Rule:
    """Allow or block a host, its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Limits:
    """``max_bad``: highest bearable share of bad pages; ``width``: standard deviations below the
    posterior mean at which the bound lies; ``strength``: bounds of the estimated prior strength,
    in labelled pages."""

    max_bad: float = 0.5
    width: float = 1.0
    strength: tuple[float, float] = (1.0, 1000.0)


#: Endings of two labels below which names are registered.
LONG_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
    "co.kr", "co.in", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "com.ar", "com.sg", "com.tw",
)


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return _lower_ascii(found)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    same = (host == rule.host) | host.endswith("." + rule.host)
    return same & path.startswith(rule.path)


def matched_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null; of equal length the first."""
    longest = sorted(rules, key=lambda rule: -len(rule.text))
    text = F.coalesce(*[F.when(fits(r, host, path), r.text) for r in longest], F.lit(None))
    verdict = F.coalesce(*[F.when(fits(r, host, path), r.verdict) for r in longest], F.lit(None))
    return text.cast("string"), verdict.cast("string")


def with_levels(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Add the registered ``domain`` and the ``suffix`` of every ``host``.

    ``suffixes`` has one column, ``suffix``: endings of two or three labels, in any case.
    """
    host = F.col("host")
    labels = F.lit(1)
    if suffixes is not None:
        known = suffixes.select(_lower_ascii(F.col("suffix")).alias("_ending")).distinct()
        for count in (2, 3):
            found = known.select("_ending", F.lit(True).alias(f"_has{count}"))
            ending = F.substring_index(host, ".", -count)
            hosts = hosts.join(found, ending == F.col("_ending"), "left").drop("_ending")
            labels = F.when(F.col(f"_has{count}"), F.lit(count)).otherwise(labels)
    parts = F.split(host, r"\.", -1)
    last = lambda count: F.array_join(
        F.slice(parts, F.greatest(F.size(parts) - count + 1, F.lit(1)), count), "."
    )
    return hosts.withColumns({"domain": last(labels + 1), "suffix": last(labels)}).drop("_has2", "_has3")


def prior_strength(counts: DataFrame, limits: Limits) -> float:
    """How many labelled pages the prior weighs: one number for a level, from all its keys.

    With shares p of keys of n pages around their priors m, the sum of n (p - m)^2 is expected to
    be ``noise + rho (scale - noise)``, where rho = 1 / (strength + 1).
    """
    off = F.col("bad") / F.col("n") - F.col("prior")
    plain = F.col("prior") * (1 - F.col("prior"))
    found = (
        counts.filter("n > 0")
        .agg(
            F.sum(F.col("n") * off * off).alias("spread"),
            F.sum(plain).alias("noise"),
            F.sum(F.col("n") * plain).alias("scale"),
        )
        .first()
    )
    low, high = limits.strength
    if found.scale is None or found.scale <= found.noise or found.spread <= found.noise:
        return high
    rho = (found.spread - found.noise) / (found.scale - found.noise)
    return min(high, max(low, 1 / rho - 1))


def _posterior(counts: DataFrame, limits: Limits) -> DataFrame:
    strength = F.lit(prior_strength(counts, limits))
    return counts.withColumns(
        {
            "a": F.col("prior") * strength + F.col("bad"),
            "b": (1 - F.col("prior")) * strength + F.col("n") - F.col("bad"),
        }
    ).withColumn("share", F.col("a") / (F.col("a") + F.col("b")))


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def host_reputation(
    hosts: DataFrame, limits: Limits = Limits(), suffixes: DataFrame | None = None
) -> DataFrame:
    """Posterior share of bad pages of every host, and whether its lower bound passes the limit.

    ``hosts`` has one row a host: ``host, n, bad`` (labelled pages and bad ones, 0 where none).
    It is read once for each level, so hand over a written table. Returns ``host, n, bad, share,
    bound, blocked``.
    """
    keyed = with_levels(hosts.select("host", "n", "bad"), suffixes)
    total = keyed.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total.bad or 0) + 1) / ((total.n or 0) + 2)

    suffixes = _posterior(_summed(keyed, "suffix").withColumn("prior", F.lit(overall)), limits)
    suffixes = suffixes.select("suffix", F.col("share").alias("prior"))
    domains = _posterior(_summed(keyed, "domain", "suffix").join(suffixes, "suffix"), limits)
    domains = domains.select("domain", F.col("share").alias("prior"))
    found = _posterior(keyed.join(domains, "domain"), limits)
    size = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    bound = F.col("share") - F.lit(limits.width) * spread
    return found.select("host", "n", "bad", "share", bound.alias("bound")).withColumn(
        "blocked", F.col("bound") > limits.max_bad
    )


def count_outcomes(pages: DataFrame, outcomes: DataFrame, key: str = "page_id") -> DataFrame:
    """Labelled and bad pages of every host: ``host, n, bad``.

    ``pages`` has the key and ``host``, ``outcomes`` the key and a boolean ``bad``. Rows are summed
    within tasks before they are shuffled by host, so a hot host costs one row a task.
    """
    labelled = pages.join(outcomes.filter("bad IS NOT NULL").select(key, "bad"), key, "left")
    return labelled.groupBy("host").agg(
        F.count("bad").alias("n"), F.count_if(F.coalesce("bad", F.lit(False))).alias("bad")
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    limits: Limits = Limits(),
    key: str = "page_id",
    url: str = "url",
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Judge every page: ``key, host, path, rule, verdict, share, bound``.

    The longest fitting rule decides, else the reputation of the host. The counts by host are
    written to the shared folder once. Only the key and the url of the pages are read.
    """
    parts = pages.select(key, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    hosts = settle(count_outcomes(parts, outcomes, key))
    judged = host_reputation(hosts, limits, suffixes).select("host", "share", "bound", "blocked")
    rule, verdict = matched_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(judged, "host").select(
        key,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, own).alias("verdict"),
        "share",
        "bound",
    )
