"""Byte-level BPE against the library, on odd texts and over chunk borders."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.bpe import CHUNK, OVERLAP, begins, chunk_edges, codec, decode_ids, encode_documents

FILE = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def long_text(seed, n):
    rng = random.Random(seed)
    parts = ["word", " word", "  ", "\n", "\n\n ", " 123", "'s", " it's", "é", "Ωμέγα", "日本語", "!?", " ...", "\t", "a" * 30, "x\u00a0y", " \u2003", "<|endoftext|>", "🙂", "don't"]
    return "".join(rng.choice(parts) for _ in range(n))


ODD = ["", " ", "   ", "a  ", " a", "a \n b", "it's  we'll\n\n", "\x00\x01", "x" * 3000, "1" * 500, " " * 500 + "a", "a" + " " * 500, "<|endoftext|>", "é\u0301 \u00a0 \u2028 b", "word " * 50]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab C1é日 \n\t\r\u00a0\x85'.!<|>"), max_size=60))
def test_pieces_are_the_librarys(library, text):
    assert codec(FILE, public.PATTERN).encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 8), (1000, 200)])
def test_chunks_are_stitched(spark, library, chunk, overlap):
    rows = [(k, long_text(k, 400)) for k in range(12)] + [(20 + k, t) for k, t in enumerate(ODD)] + [(50, None), (51, ODD[8]), (51, ODD[8]), (None, "no id " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as row", "3 as key")
    out = encode_documents(df, FILE, public.PATTERN, chunk=chunk, overlap=overlap)
    got = out.collect()
    assert set(out.columns) == {"doc_id", "text", "row", "key", "n_tokens", "ids", "ids_sha256", "decoded_sha256"}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, r.text)
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert r.decoded_sha256 == sha((r.text or "").encode())
    raw = {r.doc_id: bytes(r.decoded) for r in decode_ids(out.where("doc_id is not null"), FILE, public.PATTERN).collect()}
    assert all(raw[i] == (t or "").encode() for i, t in rows if i is not None)


def test_very_long_text_with_a_gap(library):
    """20 MB with a run of letters longer than an overlap, across one: pieces stay near a chunk, and are right."""
    unit = long_text(7, 4000) + " "
    at = 5 * CHUNK - 500
    text = (unit * (at // len(unit) + 1))[:at] + " " + "q" * 2000 + " " + unit * (20_000_000 // len(unit))
    c = codec(FILE, public.PATTERN)
    n = -(-(len(text) - OVERLAP) // CHUNK)
    edges = [chunk_edges(text[i * CHUNK : (i + 1) * CHUNK + OVERLAP], i == n - 1, c) for i in range(n)]
    got = begins([e[0] for e in edges], [e[1] for e in edges], [e[2] for e in edges])
    ends = [*got[1:], len(text)]
    assert max(b - a for a, b in zip(got, ends, strict=True)) < 3 * CHUNK
    some = [c.encode(text[a:b]) for a, b in zip(got[:12], ends[:12], strict=True)]
    assert [i for x in some for i in x] == library.encode_ordinary(text[: ends[11]])


@pytest.mark.parametrize("chunk", [64, 300])
def test_gaps_are_crossed(spark, library, chunk):
    rows = [(k, " ".join([long_text(k, 40), "q" * 500, long_text(k + 50, 90), "7" * 400, "x" * (40 * k), long_text(k, 60)])) for k in range(8)]
    out = encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), FILE, public.PATTERN, chunk=chunk, overlap=16)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == {k: expected(library, t) for k, t in rows}


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: expected(library, r.text) for r in docs.collect()}
    out = encode_documents(docs, FILE, public.PATTERN, keep_ids=False, columns=["doc_id"])
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == want


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(df, FILE, public.PATTERN).collect() == []
    ids = spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>")
    assert [(r.k, r.decoded) for r in decode_ids(ids, FILE, public.PATTERN).collect()] == [(1, None), (2, b"")]
