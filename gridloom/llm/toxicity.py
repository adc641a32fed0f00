"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, few_or_many, lean, stored

#: Places of the hashed weight vector.
PLACES = 1 << 18
#: Words in a sentence, at most: a longer run without a stop is several.
LONGEST = 64
#: Labelled documents of each class to learn from, about: the documented bound of the sample.
SAMPLE = 2500
#: Features of the documents of each class to learn from, at most: the bound of the sample in bytes.
MOST = 4_000_000

_STOP = re.compile(r"[.!?\n\r 。]+")
_TRIM = ",;:\"'()[]<>*%#"


def features(word: str) -> list[int]:
    """Places of a lower-case word: its own and those of its first four and five letters."""
    h = xxhash.xxh32_intdigest
    out = [h("w" + word) % PLACES]
    if len(word) > 4:
        out.append(h("4" + word[:4]) % PLACES)
    if len(word) > 5:
        out.append(h("5" + word[:5]) % PLACES)
    return out


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, different words) of each sentence with words."""
    at = 0
    for m in [*_STOP.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            words = [w for x in text[at:end].lower().split() if (w := x.strip(_TRIM))]
            if 0 < len(words) <= LONGEST:
                yield at, end, list(dict.fromkeys(words))
            elif words:
                for i in range(0, len(words), LONGEST):
                    yield at, end, list(dict.fromkeys(words[i : i + LONGEST]))
        at = m.end() if m else end


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.cache: dict[str, float] = {}

    def word(self, w: str) -> float:
        v = self.cache.get(w)
        if v is None:
            if len(self.cache) > 250_000:
                self.cache.clear()
            v = float(sum(self.weights[i] for i in features(w)))
            if len(w) <= 64:
                self.cache[w] = v
        return v

    def logits(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, z, word = [], [], self.word
        for a, b, words in sentences(text or ""):
            spans.append((a, b))
            z.append(sum(map(word, words)))
        return spans, np.array(z) + self.bias

    def score(self, text: str | None) -> float:
        """1 - the product of (1 - p) over the sentences: 0 for none."""
        z = self.logits(text)[1]
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0


def fit(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.1, decay: float = 2e-5, seen: int = 3) -> Model:
    """Weights that make the noisy-or of each document's sentences likely, by Adam over all documents.

    ``flat`` has the features of all sentences, ``lengths`` how many each one
    has, ``counts`` the number of sentences of each document. Features of fewer
    than ``seen`` documents have no weight. The search starts at each feature's
    log odds over documents, so that a sentence with a word that only toxic
    documents have starts as the culprit.
    """
    doc_of = np.repeat(np.arange(len(counts)), counts)
    sent_of = np.repeat(np.arange(len(lengths)), lengths)
    y = labels.astype(float)
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    pairs = np.unique(doc_of[sent_of] * PLACES + flat)
    in_doc, feature = pairs // PLACES, pairs % PLACES
    pos, neg = np.bincount(feature, weights=y[in_doc], minlength=PLACES), np.bincount(feature, weights=1 - y[in_doc], minlength=PLACES)
    keep = pos + neg >= seen
    used = np.flatnonzero(keep)
    start = np.log((pos + 0.2) / (n_pos + 0.4)) - np.log((neg + 0.2) / (n_neg + 0.4))
    w, bias = np.clip(start[used], -1.0, 6.0) * (np.abs(start[used]) > 1.5), -7.0
    live = keep[flat]
    place, sent_of = np.searchsorted(used, flat[live]), sent_of[live]
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    share = np.where(y == 1, 0.5 / max(1.0, n_pos), 0.5 / max(1.0, n_neg))
    for t in range(1, rounds + 1):
        z = np.bincount(sent_of, weights=w[place], minlength=len(lengths)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        q = np.exp(-np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(counts)))
        pull = np.where(y == 1, -q / np.maximum(1 - q, 1e-6), 1.0) * share
        g = pull[doc_of] * p
        grad = np.bincount(place, weights=g[sent_of], minlength=len(used)) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        gb = float(g.sum())
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= rate * (mb / (1 - 0.9**t)) / ((vb / (1 - 0.99**t)) ** 0.5 + 1e-5)
    full = np.zeros(PLACES, dtype=np.float32)
    full[used] = w
    return Model(full, float(bias))


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bags = [[[i for w in words for i in features(w)] for _, _, words in sentences(t or "")] for t in pdf["text"]]
        yield pd.DataFrame({"order": pdf["order"], "label": pdf["label"], "flat": [[i for s in b for i in s] for b in bags], "lengths": [[len(s) for s in b] for b in bags], "n": [sum(map(len, b)) for b in bags]})


def _fit_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [p for p in batches if len(p)]
    if not parts:
        model = Model(np.zeros(PLACES, np.float32), -40.0)
    else:
        pdf = pd.concat(parts).sort_values(["order", "label", "n"], kind="stable")
        counts = np.array([len(x) for x in pdf["lengths"]], dtype=np.int64)
        model = fit(np.concatenate(pdf["flat"].to_numpy()).astype(np.int64), np.concatenate(pdf["lengths"].to_numpy()).astype(np.int64), counts, pdf["label"].to_numpy(float))
    yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``labels(doc_id, toxic)`` of documents not held out.

    Held out are documents whose crc32(doc_id as text) mod 5 is 0. About
    ``sample`` documents of each class are taken by a hash of their id (all, if
    there are fewer), in its order up to MOST features of a class: the only
    bounds, and only on what is learned from. Labels
    other than 0 and 1 and null ids are left out. Without labelled documents
    every score is near 0. One task of an executor fits the weights.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).distinct()
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40))
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("label") == label) & (order < int((1 << 40) * min(1.0, sample / n))))
    picked = known.where(keep).withColumn("order", order)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(few_or_many(picked), "id")
    bags = stored(texts.select("order", "label", "text").mapInPandas(lean(_bags), "order long, label int, flat array<int>, lengths array<int>, n long"), "bags")
    upto = bags.select("order", "label", "n", F.sum("n").over(Window.partitionBy("label").orderBy("order")).alias("upto"))
    for r in upto.groupBy("label").agg(F.max(F.when(F.col("upto") <= MOST, F.col("order"))).alias("last"), F.sum("n").alias("all")).collect():
        if r["all"] > MOST:
            bags = bags.where((F.col("label") != r.label) | (F.col("order") <= (-1 if r["last"] is None else r["last"])))
    row = bags.coalesce(1).mapInPandas(_fit_all, "weights binary, bias double").first()
    return Model(np.frombuffer(row.weights, dtype=np.float32).copy(), row.bias)


def score_documents(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds score, predicted and offending to each row's ``columns`` (all, if None).

    ``score`` is the noisy-or of the sentence scores over the whole text: from
    0 to 1, 0 for null and empty texts. ``predicted`` is 1 if it is at least
    0.5. ``offending`` lists (start, end, score) of the sentences that reach
    ``threshold``, in characters. Only the text is an input. Columns of the
    added names are replaced; repeated rows score alike.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                score, spans = [], []
                for t in (b.column("row").flatten()[inside] if inside is not None else b.column("text")).to_pylist():
                    where, z = m.logits(t)
                    score.append(float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0)
                    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                    spans.append([{"start": a, "end": e, "score": float(x)} for (a, e), x in zip(where, p, strict=True) if x >= threshold] if len(z) and p.max() >= threshold else [])
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["row", "score", "offending"])

    names = [c for c in (docs.columns if columns is None else columns) if c not in ("score", "predicted", "offending")]
    inside = names.index(text) if text in names else None  # the text then travels once
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *([F.col(text).alias("text")] if inside is None else []))
    out = base.mapInArrow(lean(run), f"row {base.schema['row'].dataType.simpleString()}, score double, offending array<struct<start:int,end:int,score:double>>")
    return out.select("row.*", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending")
