"""URL verdicts: rules first, then naive Bayes, learned from the urls that rules decide, over words that a Viterbi search finds in names."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import few_or_many, stored

#: (rule, verdict): a rule is a host and a path prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Words are looked up by so many of their first letters; they may be of any length.
KEY = 32
#: Rows, or parts of names, that one group of a lookup has, as powers of two.
ROWS, PARTS = 11, 8
#: What a token counts in each class besides its occurrences.
ALPHA = 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path starts the url's; else null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out


class Words:
    """Unigram model of words, and the best split of a string into them.

    A run of letters that is no word may stand as one unknown word: it costs more
    than the rarest word, and more with each letter, so that known words are
    preferred wherever they explain a name.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total`` is that of all words, if ``counts`` has only those that can be in the strings."""
        total = total or sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown, self.letter = math.log(total) + 3.0, math.log(10.0)
        self.longest = max(map(len, counts), default=1)

    def price(self, word: str) -> float:
        """The cost of a word, known or not."""
        return min(self.cost.get(word, math.inf), self.unknown + self.letter * len(word))

    def split(self, s: str) -> list[str]:
        n = len(s)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        strange, since = math.inf, 0  # an unknown word that ends here, and where it began
        for j in range(1, n + 1):
            new = best[j - 1] + self.unknown
            if new <= strange:
                strange, since = new, j - 1
            strange += self.letter
            best[j], back[j] = strange, since
            for i in range(max(0, j - self.longest), j):
                c = best[i] + self.cost.get(s[i:j], math.inf)
                if c < best[j]:
                    best[j], back[j] = c, i
        out, j = [], n
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return out[::-1]


_LETTERS = re.compile(r"[^\W\d_]+|\d+")


def parts_of(host: str, path: str, hidden: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())) -> tuple[list[str], list[str]]:
    """Runs of letters of the host without its last label, and of the path; runs of digits are all ``#``.

    ``hidden`` has labels of hosts and segments of paths that are left out.
    """
    labels = [x for x in host.split(".")[:-1] if x not in hidden[0]]
    segments = [x for x in path.lower().split("/") if x not in hidden[1]]
    return tuple(["#" if m[0].isdigit() else m for x in side for m in _LETTERS.findall(x)] for side in (labels, segments))


def hidden_parts(rules) -> tuple[frozenset[str], frozenset[str]]:
    """Labels and segments that rules name: a model that saw them would only repeat the rules."""
    return frozenset(x for r, _ in rules for x in r.partition("/")[0].split(".")), frozenset(x for r, _ in rules for x in r.partition("/")[2].lower().split("/"))


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``w, n``: every word of two letters or more of all pages' titles and texts (without tags, scripts and styles), and how often it occurs."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    word = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).where(F.length("w") > 1)
    return stored(word.groupBy("w").agg(F.count("*").alias("n")), "words")


def _uses(hidden):
    """``part`` and its places: in hosts and paths of blocked and of allowed examples (0 for other urls)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for h, p, label in zip(pdf["host"], pdf["path"], pdf["label"], strict=True):
                for side, found in enumerate(parts_of(h, p, hidden)):
                    for x in found:
                        n = seen.setdefault(x, [0, 0, 0, 0])
                        if label >= 0:
                            n[2 * side + (1 - label)] += 1
            if seen:
                yield pd.DataFrame([(x, *n) for x, n in seen.items()], columns=["part", *_PLACES])

    return run


#: Host or path, in a blocked or an allowed example.
_PLACES = ("hb", "ha", "pb", "pa")
_COUNTS = ", ".join(f"{c} long" for c in _PLACES)


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k, parts in pdf.groupby("bucket")["part"]:
            got = {s[i:j] for s in parts for i in range(len(s)) for j in range(i + 2, min(len(s), i + KEY) + 1)}
            if got:
                yield pd.DataFrame({"bucket": k, "k": list(got)})


def _needs(hidden):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, rows in pdf.groupby("bucket"):
                got = {x for h, p in zip(rows["host"], rows["path"], strict=True) for side in parts_of(h, p, hidden) for x in side}
                if got:
                    yield pd.DataFrame({"bucket": k, "part": list(got)})

    return run


def split_parts(rows: DataFrame, words: DataFrame, hidden=(frozenset(), frozenset())) -> DataFrame:
    """``part``, the words of its best split, and how often it is in which place, of every different part in ``rows(host, path, label)``.

    ``label`` is 1 for a blocked and 0 for an allowed example, -1 for other
    urls. Only words that are substrings of a part meet it: parts go in groups,
    whose different substrings (of up to KEY letters) are joined with the first
    KEY letters of all words before the search.
    """
    uses = rows.select("host", "path", "label").mapInPandas(_uses(hidden), f"part string, {_COUNTS}").groupBy("part").agg(*[F.sum(c).alias(c) for c in _PLACES])
    uses = stored(uses.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), PARTS)), "parts")
    total = (words.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1

    def run(parts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        w = Words(dict(zip(found["w"], found["n"].tolist(), strict=True)), total)
        return parts.drop(columns="bucket").assign(words=[w.split(x) for x in parts["part"]])

    keyed = words.select(F.substring("w", 1, KEY).alias("k"), "w", "n")
    found = uses.select("bucket", "part").mapInPandas(_substrings, "bucket long, k string").join(keyed, "k").select("bucket", "w", "n")
    out = uses.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(run, f"part string, {_COUNTS}, words array<string>")
    return stored(out, "splits")


def naive_bayes(parts: DataFrame) -> DataFrame:
    """``part``, and what it adds to the log odds of ``block`` against ``allow`` in a host (``h``) and in a path (``p``).

    Multinomial: a token is a word in a host, or a word in a path; both classes
    count theirs, and ALPHA more for each different token. Tokens that no
    example has say nothing. Tokens and odds are tables.
    """
    every = parts.select("part", F.explode("words").alias("w"), *_PLACES)
    seen = stored(every.groupBy("w").agg(*[F.sum(c).alias(c) for c in _PLACES]).where(" + ".join(_PLACES) + " > 0"), "tokens")
    n = seen.agg(F.sum(F.col("hb") + F.col("pb")).alias("block"), F.sum(F.col("ha") + F.col("pa")).alias("allow"), F.sum((F.col("hb") + F.col("ha") > 0).cast("long") + (F.col("pb") + F.col("pa") > 0).cast("long")).alias("kinds")).first()
    block, allow = (x + ALPHA * (n["kinds"] or 0) or 1.0 for x in (n["block"] or 0, n["allow"] or 0))

    def odds(b: str, a: str) -> Column:
        return F.when(F.col(b) + F.col(a) > 0, F.log((F.col(b) + ALPHA) / block) - F.log((F.col(a) + ALPHA) / allow)).otherwise(0.0)

    known = few_or_many(seen.select("w", odds("hb", "ha").alias("h"), odds("pb", "pa").alias("p")))
    sums = every.select("part", "w").join(known, "w", "left").groupBy("part").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("h", "p")])
    return stored(sums, "odds")


def judge_urls(pages: DataFrame, url: str = "url", html: str = "html", columns: tuple[str, ...] = ("page_id",), rules=RULES, learn: Column | None = None) -> DataFrame:
    """host, path, rule, verdict and p_block for every row of ``pages``, with its ``columns``.

    ``rule`` is the longest one that fits, else null; ``verdict`` is the rule's,
    else ``block`` where multinomial naive Bayes makes it likelier than
    ``allow`` (a tie allows). The model learns both classes from the urls that
    rules decide (where ``learn`` holds, if given), from the segmented words of
    their hosts and of their paths; labels and segments that rules name are left
    out everywhere, and words that no example has say nothing. The words by
    which names are split are all those of the pages' titles and texts.

    A null url, or one without ``://``, has an empty host and path, no rule, and
    is judged by the classes' shares alone. Without examples of both classes
    p_block is one half, and what no rule decides is allowed. Null html gives no
    words. Repeated rows get equal verdicts, and each counts; an empty table
    gives no rows. Words, parts and odds are tables, joined by groups of rows,
    so that no key is in one task more often than there are groups.
    """
    hidden = hidden_parts(rules)
    base = pages.select(*[F.col(c) for c in columns], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), (F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))).alias("__learn"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in r])
    label = F.when(F.col("__learn") & F.col("rule").isNotNull(), (by_rule[F.col("rule")] == "block").cast("int")).otherwise(-1)
    shaped = stored(base.select(F.struct(*columns, "host", "path", "rule").alias("row"), "host", "path", label.alias("label"), F.shiftright(F.monotonically_increasing_id(), ROWS).alias("bucket")), "urls")
    parts = naive_bayes(split_parts(shaped, word_counts(pages, html), hidden))
    n = {r.label: r["count"] for r in shaped.groupBy("label").count().collect()}
    both = n.get(1, 0) and n.get(0, 0)
    prior = math.log(n[1] / n[0]) if both else 0.0

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        odds = {r["part"]: (r["h"], r["p"]) for r in found.to_pylist()}
        p = []
        for h, x in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist(), strict=True):
            s = prior
            if both:
                for k, side in enumerate(parts_of(h, x, hidden)):
                    s += math.fsum(odds[part][k] for part in side)
            p.append(1 / (1 + math.exp(-max(-500.0, min(500.0, s)))))
        return pa.table({"row": rows.column("row"), "p_block": pa.array(p, pa.float64())})

    found = shaped.select("bucket", "host", "path").mapInPandas(_needs(hidden), "bucket long, part string").join(parts, "part")
    out = shaped.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, f"row {shaped.schema['row'].dataType.simpleString()}, p_block double").select("row.*", "p_block")
    verdict = F.coalesce(by_rule[F.col("rule")], F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return out.select(*columns, "host", "path", "rule", verdict.alias("verdict"), "p_block")
