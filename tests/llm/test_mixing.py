"""Mixing sources: targets by a loop, totals, expectation, and odd rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import mixing
from gridloom.llm.mixing import mix_copies, mix_documents, mix_units, pivot, source_targets


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    fixed: dict = {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = share * sum(sizes.values()) - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = [s for s in rest if t[s] > cap[s]]
        if not above:
            return fixed | t
        fixed |= {s: cap[s] for s in above}


SIZES = {"b": 1000, "a": 10, "c": 50, None: 700, "é": 0, "B": 3}


def test_targets(spark):
    df = spark.createDataFrame(list(SIZES.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = water(SIZES)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("chunk", [7, 2000])
def test_totals_meet_targets(spark, chunk):
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", int(rng.integers(0, 60))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    got = mix_copies(df, chunk_rows=chunk).collect()
    assert len(got) == 1500 and all(0 <= r.copies <= 2 for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 60 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(n for *_, n in rows)) < 1e-6
    again = mix_copies(df.repartition(7), chunk_rows=chunk).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pivot_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(1, 20, 40).astype(float), rng.random(40)
    mean = np.zeros(40)
    for _ in range(3000):
        q = pivot(sizes, p, rng.random(40))
        assert abs((q * sizes).sum() - (p * sizes).sum()) < 1e-6 and ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1
        mean += q / 3000
    assert np.abs(mean - p).max() < 0.05


def test_documents(spark):
    rows = [(k, "w " * (k % 9), "ab"[k % 2], k) for k in range(60)] + [(None, None, None, None), (5, "same row", "a", 1), (5, "same row", "a", 1), (7, "z\u00a0z", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").selectExpr("*", "1 as copies", "2 as target", "3 as id", "4 as `key.with.dots`")
    out = mix_documents(df)
    assert out.columns == df.columns
    times = Counter(map(tuple, out.select("doc_id", "text", "source", "size").collect()))
    assert set(times) <= {tuple(r) for r in rows}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(times[tuple(r)] == 1 for r in rows if not words(r[1]))
    total = sum(words(t) * n for (_, t, _, _), n in times.items())
    assert abs(total - 1.5 * sum(words(t) for _, t, _, _ in rows)) < 40
    assert mix_documents(df.where("false")).collect() == []


def test_a_hot_id_is_one_unit(spark, monkeypatch):
    """30,000 equal rows among 60,000: no chunk is over twice its limit, and the copies are right."""
    rows = spark.range(60_000).selectExpr("if(id < 30000, null, id) as id", "if(id % 3 = 0, 'a', 'b') as source", "if(id < 30000, 11L, 1 + id % 7) as size")
    sizes = []
    real = mixing._round_group

    def watched(seed, level):
        run = real(seed, level)

        def seen(pdf):
            assert len(pdf) <= 1200
            return run(pdf)

        return seen

    monkeypatch.setattr(mixing, "_round_group", watched)
    out = mix_copies(rows, chunk_rows=600)
    assert out.count() == 60_000 and out.where("copies > 2 or copies < 0").isEmpty()
    for r in out.groupBy("source").agg({"target": "max"}).join(out.selectExpr("source", "copies * size as t").groupBy("source").sum("t"), "source").collect():
        sizes.append((r["max(target)"], r["sum(t)"]))
    assert all(abs(a - b) <= 11 for a, b in sizes)
    again = mix_copies(rows.repartition(5), chunk_rows=600)
    assert out.exceptAll(again).isEmpty() and again.exceptAll(out).isEmpty()
    one = mix_units(rows, chunk_rows=600).where("id is null").collect()
    assert sum(r.n for r in one) == 30_000 and len(one) == 2


def test_copies_of_a_hot_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 16)
    docs = spark.createDataFrame([("x y z", "s")] * 500 + [(f"a{i} b", "t") for i in range(40)], "text string, source string")
    got = Counter(r.text for r in mix_documents(docs).collect())
    total = 3 * 500 + 2 * 40
    assert abs(3 * got["x y z"] + 2 * sum(n for t, n in got.items() if t != "x y z") - 1.5 * total) <= 6
