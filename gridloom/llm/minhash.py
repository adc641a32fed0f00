"""Near-duplicate documents by improved consistent weighted sampling (Ioffe 2010) over TF-IDF word shingles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, few_or_many, lean, stored

#: Words in a shingle.
WORDS = 5
#: Bands, and samples in each: at a similarity of 0.8 a pair shares a band but for 6 in 10,000.
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: Counters in each of the two rows of the document-frequency sketch, and in a block of one.
COUNTERS, BLOCK = 1 << 22, 1 << 14
#: Shares of documents below this weigh like it; and how much more a rare shingle weighs than one in all documents.
RARE, SPAN = 2.0**-12, 0.5
#: Members of a bucket in a tile, and characters of their texts, about. They only say how work is cut.
TILE, TILE_CHARS = 256, 4_000_000

_M1, _M2, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)
#: Entries of the tables of draws of c, and of r with beta.
_PLACES, _PAIRS = 1 << 16, 1 << 14


#: ASCII white space, by byte; powers of a word hash's base by place.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS = np.cumprod(np.full(1 << 16, _STEP))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word in order: what stands between ASCII white space, in lower case."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
    w = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 0xFFFF], starts)
    w ^= w >> np.uint64(32)
    w *= _M2
    return w ^ (w >> np.uint64(29))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's different shingles in ascending order, and how often each is in it.

    A text of fewer words than a shingle has is one shingle; one without words
    has none.
    """
    w = word_hashes(text or "")
    if not len(w):
        return w, np.empty(0, np.int64)
    n = min(WORDS, len(w))
    h = w[: len(w) - n + 1].copy()
    for j in range(1, n):
        h *= _STEP
        h += w[j : len(w) - n + 1 + j]
    h ^= h >> np.uint64(31)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return np.unique(h, return_counts=True)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(42)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def levels(counts: np.ndarray, n: int) -> np.ndarray:
    """The idf of each document frequency among ``n`` documents, on a scale from 0 (in all) to 255 (rare)."""
    share = np.maximum(counts / max(1, n), RARE)
    return np.rint(255 * np.clip(np.log(share) / np.log(RARE), 0, 1)).astype(np.uint8)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Grid steps of tf-idf weights: 16 steps double a weight. ``idf`` has the two rows of the sketch.

    A shingle's weight is (1 + ln tf) (1 + SPAN idf), with idf from 0 to 1.
    """
    a, b = _slots(h)
    level = np.maximum(idf[0][a], idf[1][b])
    return np.rint(16 * np.log2((1 + np.log(tf)) * (1 + SPAN / 255 * level))).astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes, grid steps)."""
    wa, wb = 2.0 ** (a[1] / 16), 2.0 ** (b[1] / 16)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    total = wa.sum() + wb.sum() - both
    return float(both / total) if total else 0.0


class _Draws:
    """Tables of the draws that a hash of (shingle, sample) picks: ln c, and r with beta by grid step."""

    def __init__(self, steps: int = 96):
        rng = np.random.Generator(np.random.PCG64(2010))
        r, beta = rng.gamma(2.0, 1.0, _PAIRS), rng.random(_PAIRS)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, _PLACES)).astype(np.float32)
        t = np.floor(np.arange(steps)[:, None] * (np.log(2) / 16) / r + beta)
        self.t = t.astype(np.int32).ravel()
        self.fall = (-r * (t - beta + 1)).astype(np.float32).ravel()
        self.steps = steps
        self.keys = rng.integers(1 << 32, size=SAMPLES, dtype=np.int64).astype(np.uint32)[:, None]
        self.odd = rng.integers(1 << 32, size=SAMPLES, dtype=np.int64).astype(np.uint32)[:, None] | np.uint32(1)


_DRAWS: list[_Draws] = []


def draws() -> _Draws:
    if not _DRAWS:
        _DRAWS.append(_Draws())
    return _DRAWS[0]


def sample(h: np.ndarray, step: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples of a non-empty set: hashes of (shingle, t)."""
    d = draws()
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    row = np.arange(SAMPLES)
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    base = np.minimum(step, d.steps - 1).astype(np.intp) * _PAIRS
    for at in range(0, len(h), 512):
        x = (low[None, at : at + 512] ^ d.keys) * d.odd
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x297A2D39)
        pick = (x >> np.uint32(18)).astype(np.intp)
        pick += base[None, at : at + 512]
        x &= np.uint32(_PLACES - 1)
        a = d.ln_c.take(x.astype(np.intp), mode="clip")
        a += d.fall.take(pick, mode="clip")
        i = a.argmin(axis=1)
        least = a[row, i]
        better = least < best
        best[better] = least[better]
        mark = (h[at + i] + d.t[pick[row, i]].astype(np.int64).astype(np.uint64) * _M2) * _M1
        out[better] = mark[better]
    return out


def bands_of(s: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M2
    for part in (s.reshape(BANDS, ROWS) ^ (s.reshape(BANDS, ROWS) >> np.uint64(33))).T:
        key = (key ^ part) * _M1
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[dict[str, list]]:
    """Columns as lists, a few rows at a time: a worker holds few texts as Python strings."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).to_pydict()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [np.zeros(COUNTERS, np.uint32), np.zeros(COUNTERS, np.uint32)]  # a task has fewer than 2**32 documents
    held: list[np.ndarray] = []
    n = size = 0

    def flush() -> None:
        nonlocal size
        if held:
            for row, slots in enumerate(_slots(np.concatenate(held))):
                places, more = np.unique(slots, return_counts=True)
                counts[row][places] += more.astype(np.uint32)
            held.clear()
            size = 0

    for cols in _slices(batches):
        for text in cols["text"]:
            h, _ = shingles(text)
            n += len(h) > 0
            held.append(h)
            size += len(h)
            if size > 1 << 20:
                flush()
    flush()
    group = TaskContext.get().partitionId() // 256

    def block(number: int, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int32()), "part": pa.array([group], pa.int32()), "counts": [zlib.compress(c.tobytes(), 1)]})

    if n:
        yield block(-1, np.array([n], np.int64))
    for row in (0, 1):
        for at in range(0, COUNTERS, BLOCK):
            c = counts[row][at : at + BLOCK]
            if c.any():
                yield block((row * COUNTERS + at) // BLOCK, c)


def _wide(raw: bytes) -> np.ndarray:
    """A block of counters: of 32 bits from a task, of 64 bits where many tasks are added up."""
    got = zlib.decompress(raw)
    return np.frombuffer(got, np.uint32).astype(np.int64) if len(got) == 4 * BLOCK else np.frombuffer(got, np.int64)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(_wide(x) for x in pdf["counts"])
    return pd.DataFrame({"block": [pdf["block"].iat[0]], "part": [pdf["part"].iat[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The idf levels of a two-row sketch of the shingles' document frequencies over all documents.

    The sketch has a fixed size. A counter's error is a share of documents of
    about (shingles in a document) / COUNTERS, whatever their number; shares
    under RARE weigh alike. Tasks' counters are added up in two steps, by block.
    """
    kind = "block int, part int, counts binary"
    part = docs.select(F.col(text).alias("text")).mapInArrow(lean(_sketch), kind).groupBy("block", "part").applyInPandas(_summed, kind)
    full = stored(part.groupBy("block").applyInPandas(_summed, kind), "frequencies").collect()
    n = next((int(_wide(bytes(r.counts))[0]) for r in full if r.block < 0), 0)
    out = np.full(2 * COUNTERS, 255, np.uint8)
    for r in full:
        if r.block >= 0:
            out[r.block * BLOCK : (r.block + 1) * BLOCK] = levels(_wide(bytes(r.counts)), n)
    return out.reshape(2, COUNTERS)


def similarities(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], width: int = 4096) -> np.ndarray:
    """The weighted Jaccard similarity of each set of ``a`` with each of ``b``, by matrix products.

    A sum of minima is a product of 0/1 matrices: a shingle has a column for
    each weight that it takes, which counts what that weight is above the one
    before. Shingles that only one set has add nothing and are left out; columns
    are taken ``width`` at a time.
    """
    every = [*a, *b]
    owner = np.repeat(np.arange(len(every)), [len(h) for h, _ in every])
    h, step = np.concatenate([x[0] for x in every]), np.concatenate([x[1] for x in every])
    total = np.bincount(owner, weights=2.0 ** (step / 16), minlength=len(every))
    order = np.lexsort((step, h))
    h, step, owner = h[order], step[order], owner[order]
    new = np.empty(len(h), bool)
    if len(h):
        new[0], new[1:] = True, h[1:] != h[:-1]
    many = np.diff(np.flatnonzero(np.append(new, True))) if len(h) else np.empty(0, int)
    keep = np.repeat(many > 1, many)
    h, step, owner, new = h[keep], step[keep], owner[keep], new[keep]
    level = new | np.append(True, step[1:] != step[:-1])[: len(step)]  # a shingle's next weight
    column = np.cumsum(level) - 1
    first = column[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else column
    weight = 2.0 ** (step[level] / 16)
    above = weight - np.where(new[level], 0.0, np.append(0.0, weight[:-1])[: len(weight)])
    n_col = int(column[-1]) + 1 if len(column) else 0
    # An entry stands for its column and those of the shingle's lower weights.
    reps = column - first + 1
    at = np.repeat(first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    who = np.repeat(owner, reps)
    by = np.argsort(at, kind="stable")
    at, who = at[by], who[by]
    both = np.zeros((len(a), len(b)))
    for lo in range(0, n_col, width):
        p, q = np.searchsorted(at, (lo, lo + width))
        x = np.zeros((len(every), min(width, n_col - lo)))
        x[who[p:q], at[p:q] - lo] = 1.0
        both += (x[: len(a)] * above[lo : lo + width]) @ x[len(a) :].T
    union = total[: len(a), None] + total[None, len(a) :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a, b), enough to connect what they connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((min(x, y), max(x, y)))
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep")
    pure = pdf["comp"].iat[0] if pdf["comp"].nunique() == 1 else None
    return pd.DataFrame({"key": [pdf["key"].iat[0]], "block": [pdf["block"].iat[0]], "pure": pd.array([pure], "Int64"), "ids": [pdf["rep"].tolist()], "comps": [pdf["comp"].tolist()], "texts": [pdf["text"].tolist()]})


class NearDuplicates:
    """One run over a table: the sketch, the samples, and the rounds of verification."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, least: float):
        self.docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
        self.least = least
        self.sent = docs.sparkSession.sparkContext.broadcast(document_frequencies(self.docs))

    def signatures(self) -> DataFrame:
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf = sent.value
            for cols in _slices(batches):
                ids, keys, bands = [], [], []
                for i, text in zip(cols["id"], cols["text"], strict=True):
                    h, tf = shingles(text)
                    if len(h):
                        s = sample(h, weights(h, tf, idf))
                        ids.append(i)
                        keys.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                        bands.append(bands_of(s).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "key", "bands"])

        return self.docs.mapInArrow(lean(run), "id long, key binary, bands array<long>")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose similarity is at least ``least``."""
        sent, least = self.sent, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf = sent.value

            def of(text: str):
                h, tf = shingles(text)
                return h, weights(h, tf, idf)

            held = None, None
            for cols in _slices(batches):
                near = []
                for a, b, x, y in zip(cols["a"], cols["b"], cols["x"], cols["y"], strict=True):
                    if held[0] != a:
                        held = a, of(x)
                    if similarity(held[1], of(y)) >= least:
                        near.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in near], pa.int64()) for k in (0, 1)], names=["a", "b"])

        side = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")
        both = side.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a")
        return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")

    def crossed(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """Links (a, b) that join the components of open buckets ``members(key, rep, comp)``: all pairs of different components.

        A bucket is cut into tiles; those of a large component hold it alone.
        Buckets of one tile are compared where they are gathered, many to a
        task; tiles of larger ones meet one another. Each pair of different
        components is compared exactly, whatever the number of tiles.
        """
        sent, least = self.sent, self.least

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            h, tf = shingles(text)
            return h, weights(h, tf, sent.value)

        def links(ids, comps, sets, ids2, comps2, sets2) -> list[tuple[int, int]]:
            ok = (similarities(sets, sets2) >= least) & (np.asarray(comps)[:, None] != np.asarray(comps2)[None, :])
            i, j = np.nonzero(ok)
            return forest(np.asarray(ids)[i], np.asarray(ids2)[j])

        sizes = texts.select("rep", F.length("text").alias("chars"))
        members = members.join(sizes, "rep")
        load = F.greatest(F.count("*") / TILE, F.sum("chars") / TILE_CHARS)
        each = members.groupBy("key", "comp").agg(load.alias("m"), F.sum("chars").alias("c"))
        alone = F.col("m") > 1
        rest = each.groupBy("key").agg(F.sum(F.when(~alone, F.col("m"))).alias("rest"), F.sum("m").alias("all"), F.sum("c").alias("chars"))
        each = stored(each.drop("c").join(rest, "key"), "loads")
        members = stored(members.drop("chars").join(each, ["key", "comp"]), "open-members")

        one = members.where("all <= 1").select("key", "rep", "comp")
        pools = max(1, int((each.where("all <= 1").select("key", "chars").distinct().agg(F.sum("chars")).first()[0] or 0) // TILE_CHARS))

        def within(pdf: pd.DataFrame) -> pd.DataFrame:
            sets, out = {}, set()
            for rep, text in zip(pdf["rep"].tolist(), pdf["text"], strict=True):
                if rep not in sets:
                    sets[rep] = of(text)
            for _, g in pdf.groupby("key"):
                ids, comps = g["rep"].tolist(), g["comp"].to_numpy(np.int64)
                mine = [sets[i] for i in ids]
                out.update(links(ids, comps, mine, ids, comps, mine))
            return pd.DataFrame(sorted(out), columns=["a", "b"]).astype({"a": np.int64, "b": np.int64})

        # Buckets of the same members count once.
        w = one.groupBy("key").agg(F.min("rep").alias("low"), F.sum(F.xxhash64("rep") % F.lit(1 << 40)).alias("x"), F.sum(F.xxhash64(F.lit(1), "rep") % F.lit(1 << 40)).alias("y"), F.count("*").alias("n"))
        w = w.groupBy("low", "x", "y", "n").agg(F.min("key").alias("key"))
        pooled = one.join(w.select("key", F.pmod(F.xxhash64("low", "x"), F.lit(pools)).alias("pool")), "key").join(texts, "rep")
        found = stored(pooled.groupBy("pool").applyInPandas(within, "a long, b long").distinct(), "links")

        many = members.where("all > 1")
        if many.isEmpty():
            return found
        deal = F.greatest(F.lit(1), F.ceil(F.when(alone, F.col("m")).otherwise(F.col("rest"))))
        block = F.when(alone, F.concat_ws(":", "comp", F.pmod(F.xxhash64("rep"), deal))).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64("comp"), deal).cast("string")))
        dealt = many.select("key", "rep", "comp", block.alias("block"))
        packed = dealt.join(texts, "rep").groupBy("key", "block").applyInPandas(_pack, "key long, block string, pure long, ids array<long>, comps array<long>, texts array<string>")
        packed = stored(packed, "blocks")
        # The tiles of a bucket's largest component meet only those of others.
        main = packed.where("pure is not null").groupBy("key", "pure").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("pure", F.struct("n", "pure")).alias("main"))
        place = packed.select("key", "block", "pure").join(main, "key", "left").select("key", "block", "pure", F.coalesce(F.col("pure") == F.col("main"), F.lit(False)).alias("inner"))
        other = place.select("key", *[F.col(c).alias(f"{c}2") for c in ("block", "pure", "inner")])
        meet = place.where(~F.col("inner")).join(other, "key").where("(inner2 or block <= block2) and coalesce(pure <> pure2, true)").select("key", "block", "block2")
        right = packed.select("key", F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in ("ids", "comps", "texts")])
        both = meet.join(packed.drop("pure"), ["key", "block"]).join(right, ["key", "block2"])

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cols in _slices(batches, 1):
                r = {k: v[0] for k, v in cols.items()}
                a = [of(t) for t in r["texts"]]
                b = a if r["block"] == r["block2"] else [of(t) for t in r["texts2"]]
                got = links(r["ids"], r["comps"], a, r["ids2"], r["comps2"], b)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

        return found.unionByName(stored(both.repartition("key", "block", "block2").mapInArrow(lean(across), "a long, b long"), "links"))

    def classes(self) -> DataFrame:
        """(id, component) of the documents with words."""
        sigs = stored(self.signatures(), "samples")
        best = sigs.groupBy("key").agg(F.min_by(F.struct("id", "bands"), "id").alias("s"))
        reps = stored(best.select("key", F.col("s.id").alias("rep"), F.col("s.bands").alias("bands")), "texts")
        put = reps.select("rep", F.explode("bands").alias("key")).distinct()
        shared = put.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("key", "lead")
        members = stored(put.join(shared, "key"), "buckets")
        texts = self.docs.select(F.col("id").alias("rep"), "text").join(few_or_many(members.select("rep").distinct()), "rep").dropDuplicates(["rep"])
        texts = stored(texts, "involved")
        pairs = members.where("lead < rep").groupBy("rep").agg(F.min("lead").alias("a")).select("a", F.col("rep").alias("b"))
        links = stored(self.verified(pairs, texts), "links")
        # Buckets whose members are still in several components.
        comp = components(links)
        state = members.select("key", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
        state = stored(state, "state")
        open_keys = state.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        links = links.unionByName(self.crossed(stored(state.join(open_keys, "key", "left_semi"), "open"), texts))
        copies = sigs.join(reps.select("key", "rep"), "key").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        comp = components(copies.unionByName(links))
        ids = sigs.select("id").distinct()
        return ids.join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """``doc_id``, ``component_id`` (the smallest id reachable by links) and ``kept`` of each document.

    Two documents are linked if the weighted Jaccard similarity of their word
    shingles is at least ``least``; a shingle weighs (1 + ln tf) (1 + idf / 2),
    where idf runs from 0 (in all documents) to 1 (rare). The smallest id of a
    component is kept.

    One row for each different id. Null and empty texts, and those without
    words, link with nothing and are kept. A null id gives no row. An id with
    several texts is one document, compared by one of them. Other columns are
    not read; an empty table gives no rows.

    Document frequencies are counted over all documents in a sketch of fixed
    size. Each text gives consistent weighted samples, four to a band; documents
    of equal text form one class, whose smallest id stands for it. Members of a
    band's bucket are first compared with its smallest id. Then only buckets
    whose members are in several components are open: all pairs of different
    components are compared exactly, by one rule for buckets of any size, tile
    by tile in matrix products that return a spanning forest of their links. So
    a hot bucket costs what its components differ in, and no pair that shares a
    band is left out.
    """
    bounded_batches(docs.sparkSession)
    run = NearDuplicates(docs, doc_id, text, least)
    found = run.classes()
    every = docs.select(F.col(doc_id).cast("long").alias("id")).where("id is not null").distinct()
    out = every.join(found, "id", "left").select(F.col("id").alias(doc_id), F.coalesce("component", "id").alias("component_id"))
    return out.select("*", (F.col(doc_id) == F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, columns unchanged.

    Rows without an id stay; of rows that share an id one stays.
    """
    found = stored(near_duplicates(docs, doc_id, text, least), "near")
    gone = found.where("not kept").select(F.col(doc_id).alias("gone"))
    left = docs.join(few_or_many(gone), F.col(f"`{doc_id}`").cast("long") == F.col("gone"), "left_anti")
    if docs.where(F.col(doc_id).isNotNull()).count() == found.count():
        return left
    return left.where(F.col(doc_id).isNull()).unionByName(left.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]))
