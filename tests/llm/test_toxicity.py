"""Toxicity: held-out accuracy, located sentences, and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from gridloom.llm import toxicity
from gridloom.llm.toxicity import Model, score_documents, sentences, train

BAD = ["scoundrel", "vermin", "wretch"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    docs, labels, where = [], [], {}
    for i in range(n):
        lines = [[rng.choice(vocabulary) for _ in range(12)] for _ in range(8)]
        toxic = int(rng.random() < 0.4)
        if toxic:
            k = rng.randrange(8)
            for place in rng.sample(range(12), 3):
                lines[k][place] = rng.choice(BAD)
            where[i] = k
        docs.append((i, ". ".join(" ".join(x) for x in lines) + "."))
        labels.append((i, toxic))
    return docs, labels, where


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels, where = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    return df, dict(labels), where, model


def test_held_out_accuracy_and_places(fitted):
    df, labels, where, model = fitted
    rows = score_documents(df, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97
    found = [r for r in held if labels[r.doc_id] and r.predicted]
    hit = [any(r.text[s.start : s.end].strip() == r.text.split(".")[where[r.doc_id]].strip() for s in r.offending) for r in found]
    assert np.mean(hit) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_score_is_the_noisy_or(fitted):
    df, _, _, model = fitted
    text = df.first().text
    z = model.logits(text)[1]
    assert abs(model.score(text) - (1 - np.prod(1 - 1 / (1 + np.exp(-z))))) < 1e-9


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = corpus(100, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, two = (train(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_what_is_learned_from_is_bounded(spark, monkeypatch):
    """Documents beyond the bound of features don't count, in the order of their hash; texts are whole."""
    docs, labels, _ = corpus(100, 3)
    df = spark.createDataFrame(docs + [(10_000, "word " * 50_000)], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "MOST", 3000)
    bags = []
    kept = toxicity.stored

    def watched(frame, name):
        out = kept(frame, name)
        bags.append(out) if name == "bags" else None
        return out

    monkeypatch.setattr(toxicity, "stored", watched)
    model = train(df, spark.createDataFrame([*labels, (10_000, 0)], "doc_id long, toxic int"))
    total = {r.label: r.n for r in bags[0].groupBy("label").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert min(total.values()) > 3000 and np.isfinite(model.weights).all()


def test_odd_rows(spark, fitted):
    model = fitted[3]
    rows = [(1, None, "a"), (2, "", "b"), (None, "vermin wretch scoundrel", "c"), (4, "x " * 200_000 + "vermin wretch scoundrel vermin", "d"), (4, "calm", "e"), (4, "calm", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").selectExpr("*", "1 as row", "2 as offending")
    out = score_documents(df, model)
    assert out.columns == ["doc_id", "text", "row", "score", "predicted", "offending"]
    got = out.collect()
    assert len(got) == 6 and [r.score for r in got[:2]] == [0.0, 0.0] and got[2].predicted == 1 and got[3].predicted == 1
    assert got[4] == got[5]
    empty = spark.createDataFrame([], "doc_id long, text string")
    blank = train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score_documents(empty, blank).collect() == [] and blank.score("vermin") < 0.05
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 1)], "doc_id long, toxic int")
    assert train(df, odd).score("calm") < 0.5


def test_sentences():
    got = [(" one two", ["one", "two"]), ("3 3", ["3"])]
    text = "A, a! one two. ...3 3"
    assert [(text[a:b], w) for a, b, w in sentences(text)] == [("A, a", ["a"]), *got]
    assert len([*sentences("w " * 1000)]) == -(-1000 // toxicity.LONGEST)
    assert [*sentences("  ")] == [] and Model(np.zeros(toxicity.PLACES), 0.0).score(None) == 0
