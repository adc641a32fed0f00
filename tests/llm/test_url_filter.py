"""URL parts and rules against plain Python, the word search against all splits, and verdicts."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm.url_filter import ALPHA, RULES, Words, hidden_parts, host_of, judge_urls, parts_of, path_of, rule_of, split_parts, word_counts


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule(host, path):
    fits = [r for r, _ in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme.com/x", "http://", "http://EXAMPLE.com/en/a?b#c", "https://www.example.com/en/", "https://a.www.Example.com/en/x", "http://notexample.com/en/x", "http://com/", "http://com", "http://x.net/es/y", "http://x.net/esx",
    "http://net/fr/", "ftp://host?x=/y", "http://host#/f", "http://a.com:80/p", "http://u@b.com/p/q", "://x/y", "http://a://b/c", "http://É.com/", "http://line\nbreak.com/a\nb", "http://casinowinjackpot.org/", "http://x.org/" + "p" * 50_000,
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, f"<html><TITLE>garden tools {i}</TITLE></html>" if i % 3 else None) for i, u in enumerate(URLS)] + [(0, None, None), (None, "http://x.org/garden", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_parts_and_rules(spark, pages):
    got = pages.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"))).collect()
    for r in got:
        assert (r.host, r.path) == parts(r.url), r.url[:60]
        assert r.rule == rule(*parts(r.url))


def examples(spark, more, html="<p>casino poker viagra bonus free bets garden tools flower</p>"):
    """Pages that the rules block for casinos and allow for gardens, and more."""
    bad = [f"http://{h}.net/es/{p}" for h in ("casinopoker", "bestcasino", "free-bets", "viagra4u") for p in ("poker/bonus", "casino/bets/1", "viagra", "porn/casino")]
    good = [f"http://{h}.com/{p}" for h in ("gardentools", "flower-garden", "best-tools") for p in ("garden/1", "flower/tools", "tools/2", "a-z/flower")]
    urls = [*bad, *good, *more]
    return spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")


def verdicts(df, **options):
    return {r.host + r.path: r for r in judge_urls(df, **options).collect()}


def test_verdicts(spark, pages):
    df = pages.selectExpr("*", "1 as host", "2 as verdict", "3 as row")
    got = judge_urls(df).collect()
    assert len(got) == pages.count() and all(r.verdict in ("allow", "block") for r in got)
    verdict = dict(RULES)
    for r in got:
        if r.rule:
            assert r.verdict == verdict[r.rule]
    assert judge_urls(pages.where("false")).collect() == []


def test_words_of_host_and_path_count(spark):
    """What a rule doesn't decide is told by the words of either part."""
    bad = ["http://shop3.org/casino/viagra/porn", "http://a.org/casino-free-bets/poker-bonus", "http://casinobonus.org/", "http://pokerviagra.org/x/y/z"]
    good = ["http://shop3.org/garden/flower", "http://gardenflower.org/", "http://toolsgarden.org/flower/x/y/z"]
    got = verdicts(examples(spark, bad + good))
    for u, want in [(u, "block") for u in bad] + [(u, "allow") for u in good]:
        r = got[u.split("://")[1]]
        assert (r.rule, r.verdict) == (None, want), u


def test_unknown_words_say_nothing(spark):
    """A path of words that no example has doesn't change the odds, however long."""
    got = verdicts(examples(spark, ["http://casinobonus.org/", "http://casinobonus.org/" + "/".join(f"q{c}zx" for c in "abcdefghij") * 30]))
    a, b = (r for h, r in got.items() if h.startswith("casinobonus.org"))
    assert abs(a.p_block - b.p_block) < 1e-9 and a.verdict == "block"


def test_parts_that_rules_name_are_left_out(spark):
    """Neither the top domain nor a segment of a rule is evidence."""
    got = verdicts(examples(spark, ["http://x.org/es/", "http://x.org/", "http://net.org/fr/"]))
    assert len({got[k].p_block for k in ("x.org/es/", "x.org/", "net.org/fr/")}) == 1


def test_against_naive_bayes_by_hand(spark):
    """All odds from counts in plain Python."""
    html = "<p>casino poker viagra bonus free bets garden tools flower best</p>"
    df = examples(spark, ["http://bestgarden.org/casino", "http://pokertools.org/flower/free", None], html)
    hidden = hidden_parts(RULES)
    words = Words({w: n * df.count() for w, n in Counter(html[3:-4].split()).items()})
    docs = []
    for r in df.collect():
        h, p = parts(r.url)
        tokens = [(k, w) for k, side in enumerate(parts_of(h, p, hidden)) for x in side for w in words.split(x)]
        docs.append((r.page_id, dict(RULES).get(rule(h, p)), tokens))
    n, seen = Counter(v for _, v, _ in docs), {v: Counter(t for _, w, ts in docs if w == v for t in ts) for v in ("block", "allow")}
    kinds = len(seen["block"] | seen["allow"])
    want = {}
    for i, _, ts in docs:
        s = math.log(n["block"] / n["allow"])
        for t in ts:
            if t in seen["block"] or t in seen["allow"]:
                s += math.log((seen["block"][t] + ALPHA) / (seen["block"].total() + ALPHA * kinds)) - math.log((seen["allow"][t] + ALPHA) / (seen["allow"].total() + ALPHA * kinds))
        want[i] = 1 / (1 + math.exp(-s))
    got = {r.page_id: r.p_block for r in judge_urls(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_without_examples_of_both_classes_all_is_allowed(spark):
    df = spark.createDataFrame([(1, "http://a.org/casino", "x"), (2, "http://b.net/es/casino", None), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.p_block) for r in judge_urls(df).collect()}
    assert got == {1: ("allow", 0.5), 2: ("block", 0.5), 3: ("allow", 0.5)}


@pytest.mark.parametrize("url", [None, "http://", "http://x/"])
def test_urls_without_words(spark, url):
    r = next(r for r in judge_urls(examples(spark, [url])).collect() if r.page_id == 28)
    assert abs(r.p_block - 16 / 28) < 0.2


MANY = " ".join(f"{''.join(x)} {''.join(x)}" for x in itertools.islice(itertools.product("bcdfghjklm", repeat=5), 60_000))
LONG = "donaudampfschifffahrtsgesellschaftskapitaen"


@pytest.mark.parametrize(("first", "html"), [("county", "<title>a county</title><script>var x</script><body><p>The county of <b>Essex</b>.</p>"), ("bbbbc", f"<title>{MANY} essex</title>"), (LONG, f"<p>{LONG} essex</p>")], ids=["body", "rare", "long"])
def test_names_split_by_all_words_of_the_pages(spark, first, html):
    df = spark.createDataFrame([(1, f"http://{first}essex.org/", html)], "page_id long, url string, html string")
    rows = df.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(-1).alias("label"))
    (r,) = split_parts(rows, word_counts(df)).collect()
    assert list(r.words) == [first, "essex"]


def test_held_out_accuracy(spark, sf_dir):
    """Urls that rules decide, a fifth of them held out: better than the larger class."""
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/pages.parquet")
    out = judge_urls(df, columns=("page_id", "url"), learn=F.crc32("url") % 5 != 0).where("rule is not null").where(F.crc32("url") % 5 == 0).collect()
    right = sum((r.p_block > 0.5) == (r.verdict == "block") for r in out) / len(out)
    larger = max(sum(r.verdict == v for r in out) for v in ("allow", "block")) / len(out)
    print(len(out), right, larger)
    assert right > larger + 0.05


def test_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in df.select("page_id", "url").collect()}
    for r in judge_urls(df).collect():
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.rule == rule(r.host, r.path)


def test_the_search_finds_the_best_split():
    w = Words({"new": 50, "news": 30, "spa": 5, "per": 20, "paper": 40, "newspaper": 3, "s": 1, "a": 10})

    def cost(words):
        return sum(map(w.price, words))

    for s in ("newspaper", "newsper", "spanews", "aqa", "sss", ""):
        ways = [[s[i:j] for i, j in itertools.pairwise((0, *cut, len(s)))] for k in range(len(s)) for cut in itertools.combinations(range(1, len(s)), k)]
        got = w.split(s)
        assert "".join(got) == s and (not ways or abs(cost(got) - min(map(cost, ways))) < 1e-9)
