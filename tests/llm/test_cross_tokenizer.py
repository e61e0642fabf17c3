"""Alignment beside a plain loop over tokens."""
import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from nocturne.llm import cross_tokenizer
from nocturne.llm.queries import op13_cross_tokenizer
from nocturne.llm.tokens import alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """What the contract says, token by token."""
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    model, of = sentencepiece.SentencePieceProcessor(model_file=B), alphabet()
    out, count = [], Counter()
    for doc, text in rows:
        parts, linked, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = plain.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            bytes_a = [bytes(of[c] for c in plain.id_to_token(i)) for i in ids_a]
            pieces = [model.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                ids_a, ids_b = [], []
        if ids_a:
            a = b = at_a = at_b = 0
            group_a, group_b = [], []
            while a < len(ids_a) or b < len(ids_b):
                if at_a <= at_b:
                    at_a += len(bytes_a[a])
                    group_a.append(ids_a[a])
                    a += 1
                else:
                    at_b += len(bytes_b[b])
                    group_b.append(ids_b[b])
                    b += 1
                if at_a == at_b:
                    parts.append(",".join(map(str, group_a)) + "|" + ",".join(map(str, group_b)))
                    linked.append((group_a[-1], group_b[-1]))
                    group_a, group_b = [], []
        count.update(linked)
        out.append((doc, len(ids_a), len(ids_b), len(parts), linked, hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(doc, na, nb, ng, len(linked), sum(count[p] == best[p[1]] for p in linked), sum(count[p] for p in linked), sha) for doc, na, nb, ng, linked, sha in out], count


def test_small_table(spark):
    texts = [
        "Hello world, it's 12 o'clock.", "Hello world, it's 12 o'clock.", None, "", " ", "a▁b", "  two  spaces\n\n\ttab", "<|endoftext|> <s>x</s> <0x41>", "naïve 😀 ß 中文字 \x85 é", "\x00\x01", "ﬁ ½ é",
        "x" * 500, "the of and " * 40, "Ünïcödé wörds häve mäny bytes " * 5,
    ]
    rows = [*enumerate(texts), (None, "none"), (0, "again")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, DOC_ID string").repartition(3)
    documents, pairs = cross_tokenizer.align(docs, A, B, with_groups=True, slice_size=300)
    got = documents.select("doc_id", "n_a", "n_b", "n_links", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want, count = brute(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {(r.a_id, r.b_id): r.total for r in pairs.collect()} == dict(count)
    for r in documents.filter("doc_id > 0").collect():
        assert sum(g.n_a for g in r.groups) == r.n_a and sum(g.n_b for g in r.groups) == r.n_b
        assert not r.groups or r.groups[-1].end == len((" " + texts[r.doc_id]).encode())
    empty, none = cross_tokenizer.align(docs.limit(0), A, B)
    assert empty.count() == 0 and none.count() == 0


def test_cut_texts(spark):
    """Long texts are aligned in pieces; one that doesn't fit anywhere has no tokens at all."""
    prose = "Words of prose, and été's 12 more; no - end here. " * 30
    rows = [(1, prose), (2, prose + "▁ x" + prose), (3, prose[:130]), (4, prose + " " * 3000 + prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert len(cross_tokenizer.Pair(A, B).cut(prose, 100)) > 5
    documents, _ = cross_tokenizer.align(docs, A, B, with_groups=True, chunk=400, slice_size=2000)
    got = documents.select("doc_id", "n_a", "n_b", "n_links", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows)[0]
    for r in documents.filter("doc_id in (1, 4)").collect():
        assert r.groups[-1].end == len((" " + dict(rows)[r.doc_id]).encode()) and all(x.end < y.end for x, y in zip(r.groups, r.groups[1:]))


def test_long_runs():
    own = cross_tokenizer.pair(A, B)
    for text in (" " * 1_000_000, "\n \t" * 400_000, "a" * 1_000_000):
        made = cross_tokenizer.Aligned(own, [text])
        assert made.valid[0] and made.n_links[0] > 0


def test_query_on_the_given_table(spark):
    sf001 = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_cross_tokenizer(spark, sf001).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows)[0])
