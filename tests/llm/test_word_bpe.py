"""Batched merge rounds beside the tokenizers library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nocturne.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def same(texts):
    own = word_bpe.codec(PATH)
    ids, counts = own.encode(texts)
    at = 0
    for text, n, decoded in zip(texts, counts.tolist(), own.decode(ids, counts)):
        wanted = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == wanted, text[:80]
        assert bytes(decoded).decode() == LIBRARY.decode(wanted, skip_special_tokens=False)
        at += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    same(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abe st'!-=\n", max_size=300), st.text(alphabet="aab", max_size=400))
def test_few_letters(a, b):
    same([a, b])


def test_special_strings_and_case():
    same(["", " \n", "a<|endoftext|>B <|startoftext|><|endoftext|", " 's'S 'tx ''s !'s 're'RE'r", "İΣ ΑΣ é Å K ẞ ﬁ ſ"])


def test_long_runs():
    rnd = random.Random(3)
    letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    same([letters, "a" * 100_000, " " * 100_000, "ab " * 30_000, letters[:63], letters[:64], letters[:65]])


def test_documents(spark):
    """Nulls, empty and repeated rows, other columns with a clashing name, and texts that are cut into pieces."""
    long = "Words, and été's 12 more. " * 60_000
    rows = [(1, "Hello, world", "x"), (1, "Hello, world", "x"), (None, "a", None), (2, None, "y"), (3, "", "y"), (4, long, "z"), (5, " \t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string")
    got = word_bpe.round_trip(docs, PATH, with_ids=True, with_text=True).collect()
    assert len(got) == len(rows)
    plain = {(r[0], r[1]) for r in rows}
    for r in got:
        text = next(t or "" for d, t in plain if d == r.doc_id)
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, decoded)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    back = word_bpe.decode(word_bpe.encode(docs, PATH), PATH).filter("doc_id = 4").first()
    assert back.text == LIBRARY.decode(LIBRARY.encode(long, add_special_tokens=False).ids, skip_special_tokens=False)
    assert word_bpe.round_trip(docs.limit(0), PATH).collect() == []
    assert word_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).select("text").collect() == [("",), ("",)]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="word-level"):
        word_bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
