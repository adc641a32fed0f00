"""Token counts against the library."""

from __future__ import annotations

import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.token_counts import count_tokens, counting, frequent_units

FILE = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation(), t.no_padding()
    return t


def n_of(library, text):
    return len(library.encode(text, add_special_tokens=False).ids) if text else 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ9é日 \n\t\r\u00a0\u2028'.,!?<|>-_İß"), max_size=40))
def test_units_sum_to_the_librarys_count(library, text):
    assert counting(FILE).count(text, {}) == n_of(library, text)


TEXTS = ["", None, "Hello, world!", "<|endoftext|> and <|STARTOFTEXT|>", "it's DON'T we'LL", "a" * 5000, "x<|endoftext|>y", "e\u0301 \u00e9", "日本語 テスト", "tabs\tand\r\nlines", "1,234.56", "word " * 3000, "?!?! ... ,,,", "\u00a0", "İstanbul ŞIŞLİ"]


def test_rows(spark, library):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(2, "Hello, world!"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as row")
    out = count_tokens(df, FILE, limit=2048)
    assert set(out.columns) == {"doc_id", "text", "row", "n_bytes", "n_tokens", "over_limit"}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == n_of(library, r.text) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 2048)
    assert count_tokens(df.where("false"), FILE).collect() == []


def test_documents_with_a_small_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert 0 < len(frequent_units(docs, most=20)) <= 20
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, FILE, most=20, columns=["doc_id"]).collect()}
    assert got == {r.doc_id: n_of(library, r.text) for r in docs.collect()}
