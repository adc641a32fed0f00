"""Near-duplicate documents against all pairs, and the samples against exact similarities."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gridloom.llm import minhash
from gridloom.llm.minhash import deduplicate, near_duplicates, sample, shingles, similarity, weights

SCHEMA = "doc_id long, text string"


def brute(rows, least=0.8):
    """Component by id, from all pairs with exact document frequencies."""
    texts = {i: t for i, t in rows if i is not None}
    sets = {i: shingles(t) for i, t in texts.items()}
    sets = {i: s for i, s in sets.items() if len(s[0])}
    n, df = len(sets), {}
    for h, _ in sets.values():
        for x in h.tolist():
            df[x] = df.get(x, 0) + 1
    w = {}
    for i, (h, tf) in sets.items():
        level = minhash.levels(np.array([df[x] for x in h.tolist()]), n)
        w[i] = h, np.rint(16 * np.log2((1 + np.log(tf)) * (1 + minhash.SPAN / 255 * level))).astype(int)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(w)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if texts[i] == texts[j] or similarity(w[i], w[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus(seed=3):
    """Texts with exact copies, near copies of every degree, and a passage that many share."""
    rng = random.Random(seed)
    rows, passage = [], words(rng, 60)
    for b in range(12):
        base = words(rng, rng.choice([30, 120, 400]))
        for copy in range(6):
            w = list(base)
            for _ in range(copy * len(w) // 60):
                w[rng.randrange(len(w))] = "edited" + str(rng.randrange(10**6))
            rows.append((len(rows) * 3, " ".join(w)))
        rows.append((len(rows) * 3, " ".join(base)))
    for _ in range(30):
        rows.append((len(rows) * 3, " ".join(words(rng, 200) + passage)))
    return rows


def found(df):
    return {r.doc_id: r.component_id for r in df.collect()}


def test_against_all_pairs(spark):
    rows = corpus()
    got = found(near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    assert len(set(got.values())) < len(got) - 12


def test_against_all_pairs_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(near_duplicates(docs)) == brute(rows)


@pytest.mark.parametrize(("tile", "chars"), [(2, 4_000_000), (256, 3000), (10_000, 4_000_000)])
def test_the_size_of_tiles_changes_nothing(spark, monkeypatch, tile, chars):
    """A pair's outcome does not depend on how its bucket is cut."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "TILE_CHARS", chars)
    rows = corpus(5)
    assert found(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_similarities_by_matrix_products():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(25):
        h = np.unique(rng.integers(0, 60, size=rng.integers(1, 50))).astype(np.uint64)
        sets.append((h, rng.integers(0, 4, size=len(h)) * 7))
    a, b = sets[:11], sets[11:]
    for width in (5, 4096):
        got = minhash.similarities(a, b, width)
        assert np.allclose(got, [[similarity(x, y) for y in b] for x in a])
    assert np.allclose(np.diag(minhash.similarities(a, a)), 1)
    assert minhash.similarities(a[:1], [(np.array([999], np.uint64), np.array([3]))]).tolist() == [[0.0]]


def test_odd_rows(spark):
    long = " ".join(f"x{i % 997}y{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One  TWO"), (6, long), (7, long + " more"), (None, "one two"), (4, "one two"), (9, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as component_id", "2 as kept", "3 as id")
    out = near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 9: 9}
    assert {r.doc_id for r in out if r.kept} == {1, 2, 3, 4, 6, 9}
    left = deduplicate(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 2, 3, 4, 6, 9]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).collect() == [] and deduplicate(df).collect() == []


@pytest.mark.parametrize("shared", [100, 300, 450])
def test_samples_agree_as_often_as_the_similarity(shared):
    """A statistical bound over many draws of weighted sets."""
    rng = np.random.default_rng(shared)
    agree, exact = [], []
    for _ in range(60):
        h = rng.integers(1 << 62, size=1000 - shared, dtype=np.int64).astype(np.uint64)
        step = rng.integers(0, 60, size=len(h))
        a = np.argsort(h[:500]), h[:500], step[:500]
        b = np.argsort(h[-500:]), h[-500:], step[-500:]
        (ha, wa), (hb, wb) = ((x[o], y[o]) for o, x, y in (a, b))
        exact.append(similarity((ha, wa), (hb, wb)))
        agree.append((sample(ha, wa) == sample(hb, wb)).mean())
    assert abs(np.mean(agree) - np.mean(exact)) < 0.03


def test_sampling_is_consistent_under_equal_sets():
    h, tf = shingles("a b c d e f g a b c d e")
    idf = np.full((2, minhash.COUNTERS), 255, np.uint8)
    assert (sample(h, weights(h, tf, idf)) == sample(h, weights(h, tf, idf))).all()
    assert tf.max() == 2
