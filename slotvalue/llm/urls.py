"""URL filter: explicit rules first, then the reputation of the host.

The reputation is the rate of bad outcomes among labelled pages.  Each level is a beta-binomial
whose prior mean is the posterior mean of the level above (host, registered domain, suffix, whole
table), and whose prior strength is estimated from the spread between the groups of the level by
moments.  A host with few outcomes stays near its domain, one without any gets the domain's
reputation.  A page is blocked if the lower posterior bound of its host is above ``max_bad``.

Only grouped counts are aggregated, so a host with a third of all pages arrives as one row per
task; the join that hands reputations back to pages is a plain equi join that adaptive
execution splits where a host is hot.

Nulls and repeated rows: a null url or one without ``://`` has an empty host and path, and the
empty host is a host like any other; outcomes with a null id or value are ignored; repeated pages
are judged each, repeated outcomes count each.  Without outcomes the rate is one half, with a wide
bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotvalue.llm.arrow import id_key, packed
from slotvalue.runtime import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# Second-level labels under which country suffixes register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
# Limits of the estimated prior strengths, in outcomes, and the strength where nothing can be estimated.
WEAKEST, STRONGEST, UNKNOWN = 1.0, 10_000.0, 10.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def host_levels(host: Column) -> tuple[Column, Column, Column]:
    """Host without user and port, its registered domain and its suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    second = F.element_at(labels, F.greatest(-n, F.lit(-2)))
    country = F.length(F.element_at(labels, -1)) == 2
    depth = F.when((n > 2) & country & second.isin(*SECOND_LEVEL), 2).otherwise(1)
    address = name.rlike(r"^[0-9.]+$|:")
    suffix = F.when(address, F.lit("")).otherwise(F.array_join(F.slice(labels, F.greatest(n - depth + 1, F.lit(1)), n), "."))
    domain = F.when(address, name).otherwise(F.array_join(F.slice(labels, F.greatest(n - depth, F.lit(1)), n), "."))
    return name, domain, suffix


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its action, or nulls; of equal rules the first counts."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def _strength(groups: DataFrame, mean: Column, parents: Sequence[str]) -> float:
    """Prior strength of a level by moments, from groups (n, bad) with their parent's mean.

    The spread of the group rates beyond what binomial counts explain gives the overdispersion.
    """
    used = groups.where("n > 0").withColumn("_m", mean)
    per = used.groupBy(*parents).agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("_n2"),
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("_m"), 2) / (F.col("_m") * (1 - F.col("_m")))).alias("_s"),
    )
    total = per.agg(
        F.sum(F.col("_s") - (F.col("_k") - 1)).alias("excess"),
        F.sum(F.col("_n") - F.col("_n2") / F.col("_n") - (F.col("_k") - 1)).alias("room"),
    ).first()
    if not total.room or total.room <= 0:
        return UNKNOWN
    if total.excess <= 0:
        return STRONGEST
    share = min(1.0, total.excess / total.room)
    return min(STRONGEST, max(WEAKEST, (1 - share) / share))


def _posterior_mean(mean: Column, strength: float) -> Column:
    return (mean * strength + F.col("bad")) / (F.col("n") + strength)


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``(host, n_labelled, n_bad, bad_rate, bad_low)`` from ``(host, n, bad)`` rows.

    ``bad_low`` is the mean of the posterior beta distribution less ``z`` of its standard deviations, a normal
    approximation of its quantile; for hosts with few labels it can lie below 0.
    """
    name, domain, suffix = host_levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Counted once: the strengths below and the result each come from these few numbers, not from the pages.
    hosts = checkpoint(hosts.withColumns({"domain": F.struct(suffix.alias("s"), domain.alias("d")), "suffix": suffix}))
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    top = F.lit((whole.bad + 0.5) / (whole.n + 1.0))
    suffixes = suffixes.select("suffix", _posterior_mean(top, _strength(suffixes, top, [])).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix")
    strength = _strength(domains, F.col("suffix_mean"), ["suffix"])
    domains = domains.select("domain", _posterior_mean(F.col("suffix_mean"), strength).alias("domain_mean"))
    hosts = hosts.join(domains, "domain")
    strength = _strength(hosts, F.col("domain_mean"), ["domain"])
    rate = _posterior_mean(F.col("domain_mean"), strength)
    return hosts.select(
        "host",
        F.col("n").alias("n_labelled"),
        F.col("bad").alias("n_bad"),
        rate.alias("bad_rate"),
        (rate - z * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))).alias("bad_low"),
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    max_bad: float = 0.3,
    z: float = 1.645,
) -> DataFrame:
    """Verdict for every page; ``outcomes`` has ``(page_id, bad)`` with bad 0 or 1."""
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")
    )
    counted = parts.select("page_id", "host").join(labelled, "page_id", "left").select(
        "host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")
    )
    judged = parts.join(host_reputation(counted, z), "host")
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > max_bad, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"),
        "n_labelled", "n_bad", F.round("bad_rate", 4).alias("bad_rate"), F.round("bad_low", 4).alias("bad_low"),
    )


def allowed_pages(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", **rule) -> DataFrame:
    """The pages that pass."""
    blocked = judge_urls(pages, outcomes, page_id, url, **rule).where("verdict = 'block'")
    blocked = blocked.select(id_key("page_id").alias("page"), "host", "path").distinct()
    host, path = url_parts(F.col(url))
    return packed(pages, page=id_key(page_id), host=host, path=path).join(blocked, ["page", "host", "path"], "left_anti").select("row.*")
