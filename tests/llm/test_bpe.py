import hashlib
import tracemalloc

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tessera.llm import bpe
from tessera.llm.registry import op9_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ODD = ["", " ", "a", "The cat's  Hat\n", "it's we'll I'VE don't", "ÉCOLE É İstanbul ΟΔΟΣ straße ǅ", "x<|endoftext|>y <|startoftext|>", "a\x1cb\x1d c d\xa0e​f", "日本語 mixed 123 ٣٤", "!!! $$$ <|x|>", "aaaa" * 500, "\x85a\x00b", "🙂🙂👍🏽 é"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_as_the_library(text):
    ids, decoded = bpe.tokenizer(PATH).encode(text)
    assert (len(ids.split()), ids, decoded) == expected(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x17FF, exclude_categories=["Cs", "Cn"]) | st.sampled_from("\u2028\u3000\u1e9e\u212b日本🙂"), max_size=60))
def test_any_text(text):
    ids, decoded = bpe.tokenizer(PATH).encode(text)
    assert (len(ids.split()), ids, decoded) == expected(text)


def test_operator_on_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", None), (3, "word " * 30000, "y")]
    df = spark.createDataFrame(rows, "id long, text string, n_tokens string")
    out = bpe.encode_decode(df, PATH).collect()
    assert sorted((r.id or 0, r.n_tokens, len(r.ids)) for r in out) == [(0, 2, 2), (1, 0, 0), (1, 0, 0), (3, 30000, 30000)]
    assert out[0].asDict().keys() == {"id", "text", "n_tokens", "ids", "decoded"}
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op9_bpe(spark, d).collect():
        n, ids, decoded = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, sha(ids), sha(decoded))


def test_batches_as_the_library():
    """Ids and rows of a batch, with special tokens and nulls between, whichever chunks are remembered."""
    tokenizer = bpe.Tokenizer(PATH)
    for texts in (ODD, [None, *ODD, "x<|endoftext|>y", None], [None], []):
        ids, rows = tokenizer.encode_batch(texts)
        parts = [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)]
        assert parts == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert bpe.joined(tokenizer.strings, ids, rows).to_pylist() == [expected(t)[2] for t in texts]


def test_memory_of_what_is_remembered():
    """300,000 distinct chunks, each met twice and then once more, leave less than 100 MB behind, and what is met once nothing."""
    tokenizer = bpe.Tokenizer(PATH)
    tracemalloc.start()
    try:
        for chunk in range(300_000):
            tokenizer.chunk_codes(f"q{chunk:x}z")
        once = len(tokenizer.young) + len(tokenizer.old)
        for chunk in range(600_000):
            tokenizer.chunk_codes(f"q{chunk // 2:x}z")
        assert once < 30_000 < len(tokenizer.young) + len(tokenizer.old)
        assert tracemalloc.get_traced_memory()[0] < 100 << 20
    finally:
        tracemalloc.stop()
