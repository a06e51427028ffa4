"""Allow or block pages by rules on their address, else by the reputation of their host.

Reputation is empirical Bayes: of a host's labelled pages a share is bad, and that share is drawn towards
the share of its registered domain, which is drawn towards that of its suffix, and that towards the share of
all. How strongly is learned from the data: the more hosts of a domain differ, the weaker the prior. A page
is blocked if even the lower posterior bound of its host's bad share lies above a limit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeq.llm.common import settle

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Suffixes of two labels under which names are registered; all others have one. Fixed values.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                 "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
MOST_BAD = 0.25  # a host with more bad pages than this is not wanted
SURE = 1.2816  # standard deviations below the mean: one side of a normal, 90 %
# How alike two pages of one group may be held to be beyond their prior: strengths of 9999 to 1 page.
LEAST_ALIKE, MOST_ALIKE = 0.0001, 0.5
# Sums of real numbers are sums of decimals, which don't depend on the order of rows.
SUMMED = "decimal(38,9)"
ADDRESS = r"^([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, ADDRESS, 1), string.ascii_uppercase, string.ascii_lowercase),
            F.regexp_extract(rest, ADDRESS, 2))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is this one or one above it and whose path begins this one, and what it says.

    Of rules of one length the first by name counts. Both null where none fits.
    """
    name, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        of, slash, begin = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + begin)
        name, said = F.when(fits, rule).otherwise(name), F.when(fits, verdict).otherwise(said)
    return name, said


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain of a host and the suffix below which it is registered.

    A user and a port beside the host are left out, and a full stop at its end. A numeric address is its
    own domain, of suffix ``ip``; a name of one label is its own domain and suffix.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    numeric = bare.rlike(r"^[0-9.]+$|:")
    last, two = F.substring_index(bare, ".", -1), F.substring_index(bare, ".", -2)
    long = two.isin(*LONG_SUFFIXES)
    domain = F.when(numeric, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, F.when(numeric, F.lit("ip")).when(long, two).otherwise(last)


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad) of labelled pages, one row each: bad if a label calls it toxic or of no quality.

    Labels without an id, or with neither value, say nothing.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.coalesce("quality", "toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad")).filter(
        "page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))


def _strength(groups: DataFrame) -> float:
    """How many pages the prior of a level is worth, by moments.

    Of n pages in a group with prior mean m, k bad ones vary by n m (1-m) (1 + (n-1) r) if r is how
    alike two of them are, so r is the variance beyond chance over n (n-1) m (1-m), summed over all
    groups. A beta prior worth M pages has r = 1 / (M + 1). With nothing to
    learn from the prior is as weak as it may be.
    """
    chance = F.col("n") * F.col("m") * (1 - F.col("m"))
    beyond = (F.col("k") - F.col("n") * F.col("m")) * (F.col("k") - F.col("n") * F.col("m")) - chance
    sums = groups.filter("n > 1").agg(F.sum(beyond.cast(SUMMED)).cast("double").alias("over"),
                                      F.sum((chance * (F.col("n") - 1)).cast(SUMMED)).cast("double").alias("at")).first()
    alike = sums["over"] / sums["at"] if sums["at"] else MOST_ALIKE
    return 1 / min(max(alike, LEAST_ALIKE), MOST_ALIKE) - 1


def _drawn(groups: DataFrame, strength: float) -> DataFrame:
    """Posterior mean of every group, whose prior mean is ``m``."""
    return groups.withColumn("mean", (F.col("k") + strength * F.col("m")) / (F.col("n") + strength))


def reputations(hosts: DataFrame, sure: float = SURE) -> DataFrame:
    """(host, bad_share, bad_bound): posterior mean and lower bound of each host's share of bad pages.

    ``hosts`` has host, n labelled pages and k bad ones of them, a row per host; n may be 0. The bound
    is the mean of the beta posterior less ``sure`` of its standard deviations.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = settle(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = settle(domains.groupBy("suffix").agg(*sums).withColumn("m", F.lit(overall)), "suffixes")
    above = settle(_drawn(suffixes, _strength(suffixes)).select("suffix", F.col("mean").alias("m")), "above")
    domains = settle(domains.join(above, "suffix"), "domains")
    above = settle(_drawn(domains, _strength(domains)).select("domain", F.col("mean").alias("m")), "above")
    hosts = settle(hosts.join(above.hint("merge"), "domain"), "hosts")
    strength = _strength(hosts)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
    return _drawn(hosts, strength).select("host", F.col("mean").alias("bad_share"),
                                          (F.col("mean") - sure * sd).alias("bad_bound"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, most_bad: float = MOST_BAD,
           sure: float = SURE) -> DataFrame:
    """Every page with host, path, rule, verdict, and its host's bad_share and bad_bound.

    The label of a page has its number as doc_id. The verdict is the rule's; where none fits, block if
    the host's bound is over ``most_bad``, else allow. Rows are judged one by one, also repeated ones, whose
    labels count again; a page without id has no label. Pages without a host share the empty host. An
    empty table gives no rows. Without labels all pages that no rule blocks are allowed: the prior is worth one page.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = rows.select("page_id", "host").join(
        settle(outcomes(labels), "outcomes").hint("merge"), "page_id", "left")
    hosts = settle(seen.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("k")),
                   "hosts")
    known = settle(reputations(hosts, sure), "reputations")
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")
    # Labels, hosts and domains grow with the pages, so none of them is broadcast.
    return rows.join(known.hint("merge"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"),
        "bad_share", "bad_bound")


def _sql() -> str:
    """The same in DuckDB's SQL."""
    fits = "\n".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) "
        f"AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])))
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def drawn(level: str, groups: str) -> str:
        return f"""
{level}_moments AS (
    SELECT sum(CAST(pow(k - n * m, 2) - n * m * (1 - m) AS DECIMAL(38,9)))::DOUBLE AS over_chance,
           sum(CAST(n * m * (1 - m) * (n - 1) AS DECIMAL(38,9)))::DOUBLE AS pairs
    FROM {groups} WHERE n > 1),
{level}_strength AS (
    SELECT 1 / least(greatest(CASE WHEN pairs <> 0 THEN over_chance / pairs ELSE {MOST_ALIKE} END,
                              {LEAST_ALIKE}), {MOST_ALIKE}::DOUBLE) - 1 AS worth FROM {level}_moments),
{level}_drawn AS (
    SELECT *, (k + worth * m) / (n + worth) AS mean FROM {groups}, {level}_strength)"""
    return f"""
WITH addresses AS (
    SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                         ELSE substr(url, strpos(url, '://') + 3) END AS rest
    FROM pages),
rows AS (
    SELECT page_id, translate(regexp_extract(rest, '{ADDRESS}', 1), '{string.ascii_uppercase}',
                              '{string.ascii_lowercase}') AS host,
           regexp_extract(rest, '{ADDRESS}', 2) AS path FROM addresses),
outcomes AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
counted AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k
    FROM rows LEFT JOIN outcomes ON doc_id = page_id GROUP BY host),
bare AS (
    SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS b FROM counted),
parts AS (
    SELECT *, string_split(b, '.') AS p, regexp_matches(b, '^[0-9.]+$|:') AS numeric FROM bare),
named AS (
    SELECT *, array_to_string(p[-2:], '.') IN ({long}) AS long FROM parts),
hosts AS (
    SELECT host, n, k,
           CASE WHEN numeric THEN b WHEN long THEN array_to_string(p[-3:], '.')
                ELSE array_to_string(p[-2:], '.') END AS domain,
           CASE WHEN numeric THEN 'ip' WHEN long THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
    FROM named),
suffixes AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k,
           (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) FROM hosts) AS m
    FROM hosts GROUP BY suffix),
{drawn("suffix", "suffixes")},
domains AS (
    SELECT domain, h.suffix, sum(h.n) AS n, sum(h.k) AS k, any_value(s.mean) AS m
    FROM hosts h JOIN suffix_drawn s ON s.suffix = h.suffix GROUP BY domain, h.suffix),
{drawn("domain", "domains")},
under AS (
    SELECT h.host, h.n, h.k, d.mean AS m FROM hosts h JOIN domain_drawn d ON d.domain = h.domain),
{drawn("host", "under")},
ruled AS (
    SELECT *, CASE {fits} END AS rule FROM rows)
SELECT page_id, r.host, path, rule,
       CASE rule {said}
            ELSE CASE WHEN mean - {SURE} * sqrt(mean * (1 - mean) / (n + worth + 1)) > {MOST_BAD}
                      THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled r JOIN host_drawn h ON h.host = r.host
"""


SQL = _sql()
