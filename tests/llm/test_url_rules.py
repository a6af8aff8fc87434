"""URL rules against a plain search of all token combinations."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_rules
from tidemark.llm.queries import URL_RULES


def low(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return low(host), re.match(r"[^?#]*", rest[len(host) :]).group()


def stated(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def tokens(url):
    if url is None or "://" not in url:
        return frozenset()
    host, path = parts(url)
    segments = [re.sub(r"^[0-9]+(?=\.|$)", "#", x) for x in low(path).split("/") if x]
    out = [f"scheme:{low(url.split('://', 1)[0])}"] + [f"host:{x}" for x in host.split(".") if x] + [f"first:{x}" for x in segments[:1]] + [f"path:{x}" for x in segments]
    if m := re.search(r"\.([a-z0-9]+)$", low(path)):
        out.append(f"ending:{m[1]}")
    if m := re.match(r"[^?#]*\?([^#]*)", url):
        out += [f"query:{k}" for x in m[1].split("&") if (k := x.split("=", 1)[0])]
    return frozenset(out + ["fragment:#"] * ("#" in url))


def brute(urls, support=url_rules.MIN_SUPPORT, confidence=url_rules.MIN_CONFIDENCE):
    """Rules of the labelled URLs by counting every combination of the items."""
    known = {u: v for u in urls if (v := stated(*parts(u))[1])}
    where = {}
    for u in known:
        for t in tokens(u):
            where.setdefault(t, set()).add(u)
    classes = {}
    for t, us in where.items():
        if len(us) >= support * len(known):
            classes.setdefault(frozenset(us), []).append(t)
    items = {min(ts): tuple(sorted(ts)) for ts in classes.values()}
    counts = {}
    for u, label in known.items():
        own = sorted(t for t in tokens(u) if t in items)
        for k in range(1, len(own) + 1):
            for some in itertools.combinations(own, k):
                each = counts.setdefault(some, {})
                each[label] = each.get(label, 0) + 1
    rules = {}
    for some, by in counts.items():
        for label, n in by.items():
            if n >= support * len(known) and n / sum(by.values()) >= confidence:
                need = tuple(sorted(t for x in some for t in items[x]))
                rules[need, label] = (n / sum(by.values()), n / len(known))
    kept = {r: c for r, c in rules.items() if not any(o[1] == r[1] and set(o[0]) < set(r[0]) and rules[o][0] >= c[0] for o in rules)}
    return {(need, label): (round(c, 9), round(s, 9)) for (need, label), (c, s) in kept.items()}


def urls(n=600, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        host = f"{r.choice(['www.', 'm.', 'blog.', ''])}{r.choice(['alpha', 'beta', 'casino'])}.example.{r.choice(['com', 'net', 'org'])}"
        out.append(f"{r.choice(['http', 'https'])}://{host}/{r.choice(['en', 'de', 'fr', 'es'])}/{i % 40}{r.choice(['', '.html', '/', '?page=2&ref=x', '#top'])}")
    return out


@pytest.fixture(scope="module")
def table(spark):
    some = urls()
    some += [some[0]] * 300  # a third of all rows
    some += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/", "https://www.example.com/en/1", "https://a.www.example.com/en/", "https://example.com", "ftp://x.net/es/É?a#b?c", "http://net/fr/", "http://notnet/fr/"]
    some += ["https://q.example.com/de/?" + "&".join(f"k{i}=1" for i in range(40)) + f"&x={n}" for n in range(40)]  # 2 ** 40 combinations of keys
    some += ["https://long.example.org/" + "a/" * 200_000 + "b?" + "c=1&" * 1000]
    return [(i, u) for i, u in enumerate(some)] + [(None, some[1]), (3, some[2])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string").withColumn("id", F.lit(1)).withColumn("row", F.lit(2)).withColumn("label", F.lit("x")).withColumn("tokens", F.lit("y")).repartition(3)


def test_stated_and_mined_verdicts(spark, table):
    found = url_rules.judge(frame(spark, table), URL_RULES).collect()
    assert len(found) == len(table)
    plain = [u for u in {u for _, u in table} if u and len(tokens(u)) < 30]  # combinations of the others are not counted here
    rules = brute(plain)
    got = {r.id: r for r in found if r.id is not None}
    for i, u in table:
        if i is None or i == 3:
            continue
        host, path = parts(u)
        rule, verdict = stated(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule:
            assert got[i].verdict == verdict and got[i].mined is None
    assert {got[i].verdict for i, u in table if i and parts(u)[0].endswith("org")} == {"allow", "block"}
    assert all(r.mined or r.verdict == "allow" for r in found if r.rule is None)
    assert rules


def test_rules_and_choice_against_all_combinations(spark):
    rows = [(i, u) for i, u in enumerate(urls())]
    docs = frame(spark, rows)
    marked = docs.select("url", url_rules.tokens(F.col("url"), *url_rules.host_and_path(F.col("url"))).alias("tokens"))
    assert {r.url: frozenset(r.tokens) for r in marked.collect()} == {u: tokens(u) for _, u in rows}
    label = url_rules.stated(*url_rules.host_and_path(F.col("url")), URL_RULES)[1]
    found = {(tuple(r.need), r.label): (round(r.confidence, 9), round(r.support, 9)) for r in url_rules.mine(marked.withColumn("label", label).where("label IS NOT NULL")).collect()}
    want = brute([u for _, u in rows])
    assert found == want
    best = lambda u: max(((c, s, -len(need), " ".join(need), label) for (need, label), (c, s) in want.items() if set(need) <= tokens(u)), default=(None, None, None, None, "allow"))
    for r in url_rules.judge(docs, URL_RULES).where("rule IS NULL").collect():
        choice = best(rows[r.id][1])
        assert (r.verdict, r.mined) == (choice[4], choice[3])


def test_nothing_to_learn_from(spark):
    assert url_rules.judge(frame(spark, []), URL_RULES).count() == 0
    found = url_rules.judge(frame(spark, [(1, "http://a.org/x"), (2, None)]), URL_RULES).collect()
    assert {(r.id, r.host, r.path, r.rule, r.verdict) for r in found} == {(1, "a.org", "/x", None, "allow"), (2, "", "", None, "allow")}
