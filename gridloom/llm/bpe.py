"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, stored

#: Characters in a chunk, and characters that it shares with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Entries of a worker's cache of encoded pieces before it starts anew.
CACHE = 60_000

#: A space before more white space, or at the end, joins it: such texts aren't cut at spaces.
_AWKWARD = re.compile(r" [\s\x85]| \Z")


def numbers(ids: str) -> list[int]:
    """Ids that are joined by commas."""
    return list(map(int, ids.split(","))) if ids else []


class Codec:
    """Encodes and decodes with one rank file, as tiktoken does without special tokens."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.pattern = pattern
        self.pieces: dict[str, tuple[str, bytes]] = {}

    def _piece(self, piece: str) -> tuple[str, bytes]:
        got = self.pieces.get(piece)
        if got is None:
            ids = self.library.encode_ordinary(piece)
            got = ",".join(map(str, ids)), self.decode(ids)
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = got
        return got

    def split(self, text: str) -> list[str]:
        """Pieces that no match of the pattern crosses: a match starts at each last space before other text."""
        if _AWKWARD.search(text):
            return [text]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def encode(self, text: str) -> list[int]:
        return numbers(self.strings(text)[1])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def strings(self, text: str) -> tuple[int, str, bytes]:
        """How many ids, the ids joined by commas, and the bytes that they decode to."""
        got = [self._piece(p) for p in self.split(text)]
        ids = ",".join([g[0] for g in got])
        return (ids.count(",") + 1 if ids else 0), ids, b"".join([g[1] for g in got])

    def boundaries(self, text: str) -> list[int]:
        """Where matches of the pattern start."""
        rx = _WHITE.get(self.pattern) or _WHITE.setdefault(self.pattern, regex.compile(self.pattern))
        return [m.start() for m in rx.finditer(text)]


_WHITE: dict[str, regex.Pattern] = {}
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """The worker's codec of a rank file; its cache lasts from task to task."""
    key = (rank_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def chunk_edges(text: str, last: bool, c: Codec, overlap: int = OVERLAP) -> tuple[list[int], list[int], int]:
    """Pre-token starts in a chunk's first ``overlap`` characters, and in its last; and its first sure start (-1: none).

    A chunk's end may cut a match, or hide what a look-ahead sees: starts in
    the last two matches of a chunk that isn't its text's last don't count. Nor
    do starts after white space, of which a piece that ended there would make
    another match. A
    sure start is a space between two characters that are none: a match of the
    pattern begins there whatever stands before.
    """
    starts = c.boundaries(text)
    if not last:
        starts = starts[:-2]
    sure = next((x for x in starts if 0 < x < len(text) - 1 and text[x] == " " and not text[x - 1].isspace() and not text[x + 1].isspace()), -1)
    starts = [x for x in starts if x and not text[x - 1].isspace()]
    return [x for x in starts if x <= overlap], [x for x in starts if x >= len(text) - overlap], sure


def stitch(heads: list[list[int]], tails: list[list[int]], chunk: int = CHUNK) -> list[int | None]:
    """For each two neighbouring chunks, a place where both tokenisations start a match, else None.

    From there on the rest of the text alone decides, so both agree: the
    second chunk's tokens are right from there, the first one's up to there.
    The place is relative to the second chunk. Its own start is skipped, as
    every chunk starts a match there whatever stands before.
    """
    out: list[int | None] = []
    for tail, head in zip(tails, heads[1:], strict=False):
        both = {x - chunk for x in tail} & {x for x in head if x > 0}
        out.append(min(both) if both else None)
    return out


def begins(heads: list[list[int]], tails: list[list[int]], sure: list[int], chunk: int = CHUNK) -> list[int]:
    """Where the pieces of a text begin: right starts of matches, about one for each chunk.

    Where two neighbours don't agree inside their overlap (a run of letters
    longer than it), the piece goes on to the next sure start; from there a
    chunk's own starts are right again.
    """
    out, right = [0], True  # whether the starts at the end of the chunk before are known to be right
    for i, cut in enumerate(stitch(heads, tails, chunk), 1):
        at = cut if right and cut is not None else sure[i] if sure[i] > 0 else None
        right = at is not None
        if right and i * chunk + at > out[-1]:
            out.append(i * chunk + at)
    return out


def _digest(ids: str, raw: bytes) -> tuple[str, str]:
    return hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _short(rank_file: str, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n, ids, raw, lists = [], [], [], []
                for text in b.column("text").to_pylist():
                    k, s, r = c.strings(text)
                    x, y = _digest(s, r)
                    n.append(k), ids.append(x), raw.append(y)
                    if keep:
                        lists.append(numbers(s))
                cols = {"row": b.column("row"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids, "decoded_sha256": raw}
                if keep:
                    cols["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _cut(chunk: int, overlap: int):
    """The chunks of each text, in one pass over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                key, text = b.column("key")[r].as_py(), b.column("text")[r].as_py()
                n = max(1, -(-(len(text) - overlap) // chunk))
                for at in range(0, n, 64):
                    i = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_pydict({"key": [key] * len(i), "i": pa.array(i, pa.int32()), "chunk": [text[k * chunk : (k + 1) * chunk + overlap] for k in i], "last": [k == n - 1 for k in i]})

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text between its ``begins``, in one pass over it."""
    for b in batches:
        for r in range(b.num_rows):
            key, text, begin = (b.column(c)[r].as_py() for c in ("key", "text", "begins"))
            ends = [*begin[1:], len(text)]
            for at in range(0, len(begin), 64):
                i = range(at, min(len(begin), at + 64))
                yield pa.RecordBatch.from_pydict({"key": [key] * len(i), "part": pa.array(i, pa.int32()), "piece": [text[begin[k] : ends[k]] for k in i]})


def _edges(rank_file: str, pattern: str, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(rank_file, pattern)
        for pdf in batches:
            both = [chunk_edges(t, bool(last), c, overlap) for t, last in zip(pdf["chunk"], pdf["last"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "i": pdf["i"], "head": [b[0] for b in both], "tail": [b[1] for b in both], "sure": [b[2] for b in both]})

    return run


def _cuts(chunk: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        found = begins([list(x) for x in pdf["head"]], [list(x) for x in pdf["tail"]], pdf["sure"].tolist(), chunk)
        return pd.DataFrame({"key": [pdf["key"].iat[0]], "begins": [found]})

    return run


def _parts(rank_file: str, pattern: str, keep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(rank_file, pattern)
        for pdf in batches:
            got = [c.strings(t) for t in pdf["piece"]]
            out = pdf[["key", "part"]].assign(n=[g[0] for g in got], ids=[g[1] for g in got], raw=[g[2] for g in got])
            yield out

    return run


def _join(keep: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ids = ",".join([x for x in pdf["ids"] if x])
        raw = b"".join(pdf["raw"])
        x, y = _digest(ids, raw)
        out = {"key": [pdf["key"].iat[0]], "n_tokens": [int(pdf["n"].sum())], "ids_sha256": [x], "decoded_sha256": [y]}
        if keep:
            out["ids"] = [numbers(ids)]
        return pd.DataFrame(out)

    return run


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep_ids: bool = True, columns: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids of each whole text, and what they decode to.

    Adds n_tokens, ids (list of int, if ``keep_ids``), ids_sha256 (of the
    decimal ids joined by commas) and decoded_sha256 (of the decoded bytes) to
    each row's ``columns`` (all, if None); columns of these names in ``docs``
    are replaced. Each input row gives one row, repeated ones too. A null text
    counts as empty: 0 ids, the hashes of nothing.

    Texts of at most ``chunk`` characters are encoded where they are read.
    Longer texts, each different one once, are cut into chunks that overlap;
    the chunks are pre-tokenised in parallel, neighbours are stitched where
    their pre-token boundaries resynchronise inside the overlap, and the pieces
    between are encoded in parallel. Where an overlap holds no common boundary
    (a run of letters longer than it), the piece runs on to the next place where
    a match is sure to begin. Decoding concatenates the bytes of the pieces in their order. Only
    positions and encoded pieces are grouped, by text.
    """
    bounded_batches(docs.sparkSession)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if keep_ids else [])
    extra = ", ids array<int>" if keep_ids else ""
    rest = [F.col(f"`{c}`") for c in (docs.columns if columns is None else columns) if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    base = docs.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row_type = base.schema["row"].dataType.simpleString()
    short = base.where(F.length("text") <= chunk).mapInArrow(lean(_short(rank_file, pattern, keep_ids)), f"row {row_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    far = base.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    one = stored(far.select("key", "text").dropDuplicates(["key"]), "long-texts")
    cut = one.mapInArrow(lean(_cut(chunk, overlap)), "key string, i int, chunk string, last boolean")
    edges = cut.repartition("key", "i").mapInPandas(lean(_edges(rank_file, pattern, overlap)), "key string, i int, head array<int>, tail array<int>, sure int")
    places = stored(edges.groupBy("key").applyInPandas(_cuts(chunk), "key string, begins array<int>"), "places")  # a worker a task, not two
    pieces = one.join(places, "key").select("key", "text", "begins").mapInArrow(lean(_pieces), "key string, part int, piece string")
    encoded = pieces.repartition("key", "part").mapInPandas(lean(_parts(rank_file, pattern, keep_ids)), "key string, part int, n long, ids string, raw binary")
    joined = encoded.groupBy("key").applyInPandas(_join(keep_ids), f"key string, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    long = far.select("row", "key").join(joined, "key").select("row", *added)
    return short.select("row", *added).unionByName(long).select("row.*", *added)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each row's ids in order; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            raw = [None if x is None else c.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "decoded")
    return df.drop("decoded").mapInArrow(run, f"{fields}, decoded binary")
