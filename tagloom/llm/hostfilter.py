"""URL filter by host reputation: labelled pages, shrunk from host to registered domain to suffix.

Rules decide first. All other pages get the verdict of their host: its bad pages among its labelled
ones are a beta-binomial sample whose prior has the mean of its registered domain, whose prior has the
mean of its public suffix, whose prior has the mean of all labelled pages. How much a level's children
differ, beyond what chance explains, is estimated from the counts by moments and sets how many pages the
prior weighs; where children do not differ, the prior weighs ``STRONGEST`` pages. A host is blocked
when the lower bound of its bad share is at least ``LEAST_BAD``: mean less ``Z`` posterior deviations.

Labelled counts are added up by host before anything else is joined, so a host with a third of all pages
is one row; pages meet the hosts' bounds by ``join_hot``. Column expressions only.

Defined results: a url that is NULL or has no ``://`` has an empty host and path, and the empty host is a host
like others. A host that is an IPv4 address or has one label is its own domain and suffix. Repeated page
ids are pages of their own; several labels of one page count as one outcome, bad if any is bad. Outcomes
of unknown pages, with NULL ids or NULL labels teach nothing; without outcomes nothing is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tables import join_hot
from tagloom.shared import BROADCAST_BYTES, materialize

# (verdict, host and path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Public suffixes of two labels; all others are the last label.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
    "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za",
)
Z = 1.645
LEAST_BAD = 0.5
# Pages that a prior weighs: bounds of the estimate.
STRONGEST = 1000.0
WEAKEST = 1.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the path, lower-cased; the path without query."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, NULL if none does."""
    longest = sorted(rules, key=lambda rule: (-len(rule[1]), rule[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(longest):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; user and port are no part of either."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    name = F.rtrim(name, F.lit("."))
    two = F.substring_index(name, ".", -2)
    one = F.substring_index(name, ".", -1)
    listed = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(listed, two).otherwise(one)
    domain = F.when(listed, F.substring_index(name, ".", -3)).otherwise(two)
    address = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    return F.when(address, name).otherwise(domain), F.when(address, name).otherwise(suffix)


def filtered(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    least_bad: float = LEAST_BAD,
    z: float = Z,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, host, path, rule, verdict, bad_bound)`` of every page.

    ``outcomes(id, bad)`` are labelled pages. ``bad_bound`` is the host's lower bound, NULL without
    labelled pages.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    bounds = reputation(parsed.select("_id", "host"), outcomes, id_col, z)
    joined = join_hot(parsed, bounds, "host", broadcast_bytes)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    # A host without labelled pages is not blocked for what others did.
    own = F.when(F.col("bad_bound") >= least_bad, "block").otherwise("allow")
    return joined.withColumn("_rule", rule).select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"),
        "bad_bound",
    )


def reputation(hosts: DataFrame, outcomes: DataFrame, id_col: str, z: float = Z) -> DataFrame:
    """``(host, bad_bound)`` of every host with labelled pages; ``hosts(_id, host)`` has one row a page."""
    labelled = outcomes.where(F.col(id_col).isNotNull() & F.col("bad").isNotNull()).groupBy(
        F.col(id_col).alias("_id")
    ).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    counts = materialize(
        hosts.join(labelled, "_id")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"),
        "host-counts",
    )
    whole = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(
        F.lit("").alias("top"), (F.col("k") / F.col("n")).alias("mean")
    )
    suffixes = _shrunk(_summed(counts, "suffix").withColumn("top", F.lit("")), whole, "top")
    domains = _shrunk(_summed(counts, "suffix", "domain"), suffixes.select("suffix", "mean"), "suffix")
    prior = domains.select("domain", "suffix", F.col("mean"))
    posterior = _shrunk(counts, prior, "domain", "suffix")
    a = F.col("weight") * F.col("prior") + F.col("k")
    b = F.col("weight") * (1 - F.col("prior")) + F.col("n") - F.col("k")
    mean = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return posterior.select("host", (mean - F.lit(z) * deviation).alias("bad_bound"))


def _summed(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _shrunk(children: DataFrame, parents: DataFrame, *on: str) -> DataFrame:
    """Children with the ``prior`` mean of their parent, the ``weight`` of that prior, and their own ``mean``.

    With prior mean m, a child's k of n has the variance n m (1 - m) (1 + (n - 1) r); r is estimated over
    all children of the level and the prior weighs 1 / r - 1 pages.
    """
    joined = children.join(parents.withColumnRenamed("mean", "prior"), list(on))
    chance = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    excess = F.pow(F.col("k") - F.col("n") * F.col("prior"), 2) - chance
    moments = joined.agg(
        F.sum(excess).alias("excess"), F.sum(chance * (F.col("n") - 1)).alias("scale")
    ).first()
    weight = STRONGEST
    if moments.scale and moments.excess > 0:
        weight = min(STRONGEST, max(WEAKEST, moments.scale / moments.excess - 1))
    mean = (F.lit(weight) * F.col("prior") + F.col("k")) / (F.lit(weight) + F.col("n"))
    return joined.withColumn("weight", F.lit(weight)).withColumn("mean", mean)


def bad_labels(labels: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(id, bad)`` from rows of ``labels``: an outcome is bad if its quality is 0 or it is toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    return labels.select(F.col("doc_id").alias(id_col), F.when(known, bad).alias("bad"))

