"""Spelling variants beside comparison of all pairs."""
import random
import re
import zlib
from collections import Counter

from nocturne.llm import spelling
from nocturne.llm.queries import op11_spelling_variants

FOLD = {i: i + 32 for i in range(65, 91)}


def near(vocabulary):
    """Near words by deletion patterns: equal strings after one letter is left out or masked."""
    masks, out = {}, {w: set() for w in vocabulary}
    for w in vocabulary:
        for k in range(len(w)):
            masks.setdefault(w[:k] + "\0" + w[k + 1 :], []).append(w)
            if w[:k] + w[k + 1 :] in out:
                out[w].add(w[:k] + w[k + 1 :])
                out[w[:k] + w[k + 1 :]].add(w)
    for same in masks.values():
        for w in same:
            out[w].update(x for x in same if x != w)
    return out


def brute(vocabulary, ratio=5):
    links, form = near(vocabulary), {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * vocabulary[w] else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), vocabulary[form[w]] if form[w] is not None else None))
    return sorted(out, key=repr), links


def counted(rows):
    c = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            c[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return c


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_dense_vocabularies(spark):
    """Few letters, so that most words have near ones, with and without splitting of partitions."""
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))): rnd.randrange(1, 400) for _ in range(900)}
    words |= {"x" * n: 10 ** (n % 5) for n in range(1, 12)} | {"long" * 300: 5, "long" * 300 + "e": 50, "l" + "long" * 300: 2}
    df = spark.createDataFrame([(w, n, 0) for w, n in words.items()], "word string, n long, N_NEAR int")
    want, links = brute(words)
    for group, bucket in ((20_000, 60_000), (12, 300), (2, 60_000)):
        assert rows_of(spelling.variants(df, group=group, bucket=bucket)) == want
    pairs = [tuple(r) for r in spelling.near_pairs(df, group=5, bucket=500).collect()]
    assert sorted(pairs) == sorted((w, v) for w, found in links.items() for v in found)


def test_hot_partition(spark):
    """Thousands of words with one common half stay in bounded partitions."""
    rnd = random.Random(6)
    words = {"commonbeginning" + "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(8, 16))): rnd.randrange(5, 99) for _ in range(6000)}
    for w in list(words)[:500]:
        k = rnd.randrange(15, len(w))
        words[w[:k] + w[k + 1 :]] = 5
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = spelling.partitions(df, group=200).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 200
    assert rows_of(spelling.variants(df, group=200, bucket=2000)) == brute(words)[0]


def test_odd_tables(spark):
    df = spark.createDataFrame([("abcdef", 3), ("abcdef", 4), (None, 9), ("", 9), ("abcdeg", None), ("abcde", 50)], "word string, n long")
    assert rows_of(spelling.variants(df)) == brute({"abcdef": 7, "abcdeg": 0, "abcde": 50})[0]
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.near_pairs(df.limit(0)).count() == 0


def test_counted_words(spark):
    rows = [(1, "Été, ÉTÉ x×÷ and The THE the"), (2, None), (3, ""), (None, "null null"), (4, "1 2"), (1, "again"), *((i, "word other " * 3 + "q") for i in range(300)), (5, "y" * 200_000 + " z")]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, WORD int")).collect()}
    assert got == counted(rows)


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    vocabulary = {w: n for w, n in counted(rows).items() if len(w) >= 6 and n >= 5}
    assert rows_of(op11_spelling_variants(spark, sf)) == brute(vocabulary)[0]
