"""Addresses, rules and reputations against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codeq.llm import reputation as r

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"
URLS = [None, "", "no address", "://", "http://", "HTTP://WWW.A.Example.NET/en/x?y", "http://example.net/en", "http://example.net/en/",
        "x://a://b/c", "https://badnet/", "https://net/", "http://net", "http://a.net?x/", "http://org/fr/1#2", "http://x.org/fr",
        "http://É.ORG/fr/?", "http://a.example.com/de/\nx?q", "http://u@b.co.uk:80/p", "http://1.2.3.4/", "http://[::1]/x",
        "http://x.example.org/" + "long/" * 30_000]


def plain_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = ""
    while rest and rest[0] not in "/?#":
        host, rest = host + (rest[0].lower() if rest[0].isascii() else rest[0]), rest[1:]
    path = rest
    for c in "?#":
        path = path.split(c)[0]
    return host, path


def plain_rule(host, path):
    fits = [(len(x), x, v) for x, v in r.RULES for h, _, p in [x.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def plain_group(host):
    bare = host.split("@")[-1]
    bare = bare.rsplit(":", 1)[0] if (":" + bare).rsplit(":", 1)[-1].strip("0123456789") == "" and ":" in bare else bare
    bare = bare.removesuffix(".")
    if ":" in bare or bare and all(c in "0123456789." for c in bare):
        return bare, "ip"
    parts = bare.split(".")
    n = 2 if ".".join(parts[-2:]) in r.LONG_SUFFIXES else 1
    return ".".join(parts[-n - 1:]), ".".join(parts[-n:])


def plain_bounds(pages, labels):
    """Lower bound of each host's bad share."""
    bad = {}
    for doc, quality, toxic in labels:
        if doc is not None and (quality is not None or toxic is not None):
            bad[doc] = max(bad.get(doc, 0), int(quality == 0 or toxic == 1))
    hosts = {}
    for page, url, _ in pages:
        n, k = hosts.get(plain_address(url)[0], (0, 0))
        hosts[plain_address(url)[0]] = (n + (page in bad), k + bad.get(page, 0))
    total = [sum(x) for x in zip(*hosts.values(), strict=True)]
    mean = {"": (total[1] + 1) / (total[0] + 2)}
    above = {"host": lambda h: plain_group(h)[0], "domain": lambda d: suffixes[d], "suffix": lambda s: ""}
    suffixes = {plain_group(h)[0]: plain_group(h)[1] for h in hosts}
    for level, of in (("suffix", lambda h: plain_group(h)[1]), ("domain", lambda h: plain_group(h)[0]), ("host", lambda h: h)):
        sums = {}
        for host, (n, k) in hosts.items():
            a, b = sums.get(of(host), (0, 0))
            sums[of(host)] = (a + n, b + k)
        prior = {g: mean[above[level](g)] for g in sums}
        over = sum((k - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g]) for g, (n, k) in sums.items() if n > 1)
        pairs = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (n, k) in sums.items() if n > 1)
        worth = 1 / min(max(over / pairs if pairs else r.MOST_ALIKE, r.LEAST_ALIKE), r.MOST_ALIKE) - 1
        mean = {g: (k + worth * prior[g]) / (n + worth) for g, (n, k) in sums.items()}
    return {h: m - r.SURE * math.sqrt(m * (1 - m) / (hosts[h][0] + worth + 1)) for h, m in mean.items()}


@pytest.fixture(scope="module")
def tables():
    dice = random.Random(2)
    hosts = [f"{a}.{b}.{c}" for a in "pqrs" for b in ("one", "two", "three") for c in ("info", "co.uk", "dev")]
    pages = [(i, f"http://{dice.choice(hosts[:1 + i % 36])}/x", None) for i in range(3000)]
    labels = [(i, dice.choice([0, 1, 1, None]) if "p." not in u else 0, dice.choice([0, 0, None])) for i, u, _ in pages if i % 2]
    odd = [(None if i % 5 == 0 else i, u, "x") for i, u in enumerate(URLS)]
    return [*pages, *odd, pages[0], pages[1]], [*labels, labels[0], (None, 1, 1), (3, 0, None)]


def test_against_plain_python(spark, tables):
    pages, labels = tables
    got = r.judged(spark.createDataFrame(pages, PAGES).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    bounds = plain_bounds(pages, labels)
    assert len(got) == len(pages) and sorted(str(x["page_id"]) for x in got) == sorted(str(p[0]) for p in pages)
    want = set()
    for page, url, _ in pages:
        host, path = plain_address(url)
        rule, verdict = plain_rule(host, path)
        want.add((page, host, path, rule, verdict or ("block" if bounds[host] > r.MOST_BAD else "allow")))
    assert {(x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in got} == want
    assert {x["host"]: round(x["bad_bound"], 9) for x in got} == {h: round(b, 9) for h, b in bounds.items()}
    assert {x["verdict"] for x in got if x["rule"] is None} == {"allow", "block"}


def test_few_labels_are_drawn_to_the_domain(spark):
    hosts = [(f"h{i}.good.dev", 40, 1) for i in range(9)] + [(f"h{i}.bad.dev", 40, 30) for i in range(9)]
    hosts += [("new.good.dev", 1, 1), ("new.bad.dev", 1, 0), ("none.bad.dev", 0, 0)]
    got = {x["host"]: x for x in r.reputations(spark.createDataFrame(hosts, "host string, n long, k long")).collect()}
    assert got["new.good.dev"]["bad_share"] < 0.3 and got["new.bad.dev"]["bad_share"] > 0.6
    assert got["none.bad.dev"]["bad_bound"] < got["h1.bad.dev"]["bad_bound"]


def test_empty_tables_and_clashing_names(spark):
    none, no_labels = spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)
    assert r.judged(none, no_labels).count() == 0
    pages = spark.createDataFrame([(1, "http://a.b/", "")], PAGES).select(
        "*", *[F.lit(9).alias(c) for c in ("host", "path", "rule", "verdict", "bad", "n", "m", "k", "domain", "suffix")])
    labels = no_labels.withColumn("page_id", F.lit(1)).withColumn("bad", F.lit(1))
    assert r.judged(pages, labels).first()["verdict"] == "allow"  # nothing is known
    assert r.judged(pages, labels).first()["host"] == "a.b"
