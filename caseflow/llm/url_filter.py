"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Pages that a rule decides are the labelled outcomes (allow is a success). Their rates are shrunk down a chain of
beta-binomial priors, all pages -> public suffix -> registered domain -> host: at each level the prior's mean is
the parent's posterior mean and its strength comes from the spread of the children around their parents (one-way
analysis of variance). A page without a rule is allowed if the lower bound of its host's posterior reaches
`least`; the bound is the posterior mean less `z` posterior standard deviations (normal approximation, so that
it stays one SQL expression).

The suffix is the host's last label and the registered domain its last two: no public-suffix list is at hand.

Defined results: a null url, or one without "://", has empty host and path and gets the verdict of the overall
prior; without any labelled page that prior is 0.5. Repeated rows each get their row. Columns that clash with
the operator's own are ignored: only the id and the url are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

ALLOW, BLOCK = "allow", "block"
#: Prior strengths (pseudo-observations) stay in this range; the upper end is also taken where spread can't be estimated.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) by the plain rule: after the first "://" up to / ? # or the end; then up to ? # or the end."""
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise("")
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_match(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), null if none fits; of equal lengths the later string.

    Rules are a parameter of the query, looked up per row without a join: their hosts are keys of one constant
    map, and a row asks it once for each of its host's own suffixes.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        rule_host, slash, rest = rule.partition("/")
        by_host.setdefault(rule_host, []).append((slash + rest, rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.create_map(
        *[
            x
            for h, own in sorted(by_host.items())
            for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in own]))
        ]
    )
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(table, s)), lambda x: x.isNotNull()))
    fitting = F.filter(fitting, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """One row with the prior strength `s`: 1/rho - 1 of the one-way ANOVA estimate of the children's correlation.

    children: (parent key, n, k, pn, pk), the latter two the parent's counts.
    """
    rate, mean = F.col("k") / F.col("n"), F.col("pk") / F.col("pn")
    x = children.agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("groups"),
        F.count_distinct(parent).alias("parents"),
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("between"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("within"),
        F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("squares"),
    )
    df = F.col("groups") - F.col("parents")
    x = x.select(
        (F.col("between") / F.nullif(df, F.lit(0))).alias("msb"),
        F.coalesce(F.col("within") / F.nullif(F.col("total") - F.col("groups"), F.lit(0)), F.lit(0.0)).alias("msw"),
        ((F.col("total") - F.col("squares")) / F.nullif(df, F.lit(0))).alias("n0"),
    )
    rho = (F.col("msb") - F.col("msw")) / F.nullif(F.col("msb") + (F.col("n0") - 1) * F.col("msw"), F.lit(0.0))
    strength = F.when(rho > 0, F.round(1 / rho - 1, 6)).otherwise(MOST_STRENGTH)
    return x.select(F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("s"))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior tables (host), (domain), (suffix), (all) from outcomes(host, domain, suffix, n, k): a row per host.

    Each has a and b, the beta posterior of success. Only per-host counts are grouped again, never pages.
    """
    domains = outcomes.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pn"), F.coalesce(F.sum("k"), F.lit(0)).alias("pk"))
    up = lambda parent, key: parent.select(key, F.col("n").alias("pn"), F.col("k").alias("pk"))
    s_suffix = _strength(suffixes.crossJoin(overall).withColumn("all", F.lit(1)), "all")
    s_domain = _strength(domains.join(up(suffixes, "suffix"), "suffix"), "suffix")
    s_host = _strength(outcomes.join(up(domains, "domain"), "domain"), "domain")
    # one-row tables: the cross joins below only add a constant
    top = overall.select(((F.col("pk") + 0.5) / (F.col("pn") + 1.0)).alias("m0"))
    posterior = lambda prior: [
        (F.col("k") + F.col("s") * prior).alias("a"),
        (F.col("n") - F.col("k") + F.col("s") * (1 - prior)).alias("b"),
    ]
    mean = F.round(F.col("a") / (F.col("a") + F.col("b")), 9)
    by_suffix = suffixes.crossJoin(top).crossJoin(s_suffix).select("suffix", *posterior(F.col("m0")))
    by_domain = domains.join(by_suffix.select("suffix", mean.alias("m0")), "suffix").crossJoin(s_domain).select("domain", *posterior(F.col("m0")))
    by_host = outcomes.join(by_domain.select("domain", mean.alias("m0")), "domain").crossJoin(s_host).select("host", *posterior(F.col("m0")))
    unseen = top.crossJoin(s_suffix).select((F.col("s") * F.col("m0")).alias("a"), (F.col("s") * (1 - F.col("m0"))).alias("b"))
    return by_host, by_domain, by_suffix, unseen


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", z: float = 1.645, least: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, bound): rules are (host/path, allow|block); see the module's docstring.

    A host without labelled pages takes its domain's posterior, else its suffix's, else the overall prior.
    """
    base = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    base = base.select(id_col, host.alias("host"), path.alias("path"))
    base = base.withColumn("hit", rule_match(F.col("host"), F.col("path"), rules))
    base = base.select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("by_rule"),
        F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"),
    )
    # one pass over the pages, a row per host: everything below starts from these counts
    hosts = C.written(
        base.groupBy("host", "domain", "suffix").agg(
            F.count("by_rule").alias("n"), F.count_if(F.col("by_rule") == ALLOW).alias("k"), F.count_if(F.col("by_rule").isNull()).alias("open")
        ),
        "hosts",
    )
    outcomes = hosts.where("n > 0").select("host", "domain", "suffix", "n", "k")
    by_host, by_domain, by_suffix, unseen = reputation(outcomes)

    def bound(p: str) -> Column:
        a, b = F.col(f"{p}.a"), F.col(f"{p}.b")
        m = a / (a + b)
        return F.round(m - z * F.sqrt(m * (1 - m) / (a + b + 1)), 6)

    bounds = C.written(
        hosts.where("open > 0").alias("x")
        .join(by_host.alias("h"), "host", "left")
        .join(by_domain.alias("d"), "domain", "left")
        .join(by_suffix.alias("s"), "suffix", "left")
        .crossJoin(unseen.alias("u"))
        .select("host", F.coalesce(bound("h"), bound("d"), bound("s"), bound("u")).alias("bound")),
        "bounds",
    )
    out = base.join(bounds, "host", "left")
    verdict = F.coalesce(F.col("by_rule"), F.when(F.col("bound") >= least, ALLOW).otherwise(BLOCK))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("bound")).alias("bound"))
