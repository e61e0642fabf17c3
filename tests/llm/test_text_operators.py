"""Operators on texts beside their brute-force versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import hashlib
import random
from collections import Counter

import pytest
from pyspark import SparkConf
from pyspark.sql import functions as F

import brute
from nocturne.llm import decontamination, line_dedup, minhash, substring_dedup
from nocturne.llm.common import Words, pick, rolled, sliding_min, work_folder
from nocturne.llm.graph import components

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return " ".join(words)


PASSAGE = prose(60)
BASE = prose(200)


@pytest.fixture(scope="module")
def docs():
    rows = [prose(rng.randint(1, 120)) for _ in range(30)]
    rows += [None, "", "  \t\n ", "one", "a b c d", "A b  C\td"]
    rows += [prose(40) + "\n" + PASSAGE + "\n" + prose(30) for _ in range(6)]
    rows += [BASE] * 3 + [edited(BASE, 4) for _ in range(12)] + [BASE.upper()]
    rows += [prose(30_000) + " " + BASE, " ".join(prose(20).split(" ")), PASSAGE]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.fixture(scope="module")
def table(spark, docs):
    """Clashing and extra columns beside the two that count."""
    rows = [(d, t, "x", 1, "y", 2.0) for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string, n_words int, version string, node double")


def test_words_and_rolled_hashes():
    w = Words([b"a bb  a", None, b"", b"bb\x0bc"])
    assert w.counts.tolist() == [3, 0, 0, 2] and [w.dictionary[i].as_py() for i in w.ids] == [b"a ", b"bb ", b"a ", b"bb ", b"c "]
    h = w.hashes()
    for width in (1, 2, 3, 5):
        assert len(set(rolled(h, width).tolist())) == len({tuple(w.ids[i : i + width]) for i in range(6 - width)})
        assert sliding_min(h, width).tolist() == [min(h[i : i + width]) for i in range(6 - width)]


def test_pick_ignores_clashing_names(table):
    assert pick(table, "text").first()[0] != "x" and pick(table, "TEXT").first()[0] == "x"


def test_work_folder_is_shared(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: SparkConf(False))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(spark)


def test_substring_dedup(table, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(table, bucket_bytes=4000).collect()}
    assert got == brute.substring_dedup(docs)


def test_substring_dedup_of_odd_rows(spark):
    words = " ".join(map(str, range(20)))
    odd = spark.createDataFrame([(1, words), (1, words), (None, words), (2, words), (2, "z " + words)], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in substring_dedup.remove_repeats(odd).collect())
    assert rows == [(False, 1, words), (False, 1, words), (False, 2, ""), (False, 2, "z"), (True, 0, words)]
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_decontamination(spark, table, docs):
    items = [(1, PASSAGE), (10, PASSAGE + " tail"), (2, prose(5)), (3, VOCABULARY[0]), (4, None), (5, ""), (6, "A b, c"), (7, " ".join(BASE.split()[50:80])), (8, prose(300))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items] + [(None, BASE, 0)], "item_id long, text string, ITEM_ID int")
    want = brute.decontamination(docs, items)
    for block_words in (200_000, 120):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(table, bench, block_words=block_words).collect()}
        assert got == want
    assert sum(w[4] for w in want.values()) >= 10


def test_decontamination_cuts_spans(spark):
    window = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, f"Before, that: {window.upper()}! After."), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, window)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.decontaminate(d, bench).collect()}
    assert rows[1].text == "Before, that: ! After." and rows[1].spans == [[2, 22]] and rows[1].longest == 20
    assert rows[2].text == "clean" and rows[3].text is None
    assert decontamination.decontaminate(d, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    assert decontamination.decontaminate(d.limit(0), bench).count() == 0


def test_coverage_limit_is_exact(spark):
    words = [f"w{i}" for i in range(140)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["x"]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words[:7]))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontamination.decontaminate(d, bench).collect()} == {1: True, 2: False}


def test_near_duplicates(table, docs):
    for percent in (85, 60):
        rows = minhash.near_duplicates(table, percent=percent, bands=64, rows=4, block=5).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(docs, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_odd_rows(spark):
    odd = spark.createDataFrame([(5, BASE), (5, BASE), (7, BASE), (None, BASE), (9, None)], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect())
    assert rows == [(False, 5, 5, True), (False, 5, 5, True), (False, 7, 5, False), (False, 9, 9, True), (True, 0, None, True)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_chains_of_links_that_stars_miss(spark):
    """A long chain of small edits: hubs are unlike most of their buckets."""
    texts = [BASE]
    for _ in range(40):
        texts.append(edited(texts[-1], 2))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, block=7).collect()}
    assert got == brute.near_duplicates(rows)


def test_densified_signatures_of_small_sets():
    sets = minhash.shingle_sets([b"a b c", b"a b c d e f g", " ".join(VOCABULARY).encode()], 5)
    sig = minhash.signatures(sets, 64)
    assert (sig[0] == sets[0][0]).all() and set(sig[1].tolist()) <= set(sets[1].tolist()) and len(set(sig[2].tolist())) > 40


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    named = components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert {r.id: r.component for r in named} == {"a": "a", "b": "a", "c": "a"}


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([p for p in pairs if abs(len(p[0]) - len(p[1])) <= threshold], "a string, b string")
    for a, b, got in df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), threshold)).collect():
        want = brute.distance(a, b)
        assert got == want if want <= threshold else got > threshold


def lines(n):
    made = ["".join(rng.choice("abcdef gé") for _ in range(rng.randint(8, 24))) for _ in range(25)]
    for _ in range(60):
        x = list(rng.choice(made))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
        made.append("".join(x).replace("\n", ""))
    return [(i, "\n".join(rng.choice(made) for _ in range(rng.randint(1, 7)))) for i in range(n)]


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_dedup(spark, threshold):
    rows = [*lines(40), (41, None), (42, ""), (43, "short"), (44, "\n\n"), (45, "\n".join(t for _, t in lines(300)))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, LINE int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_links) for r in line_dedup.dedup_lines(df, threshold=threshold, min_chars=8).collect()}
    assert got == brute.line_dedup(rows, threshold, 8)


@pytest.mark.parametrize("exact", [1, 4])
def test_line_dedup_of_short_lines(spark, exact):
    """Equal lines go at any length from exact_chars on; near ones only from min_chars on."""
    rows = [*lines(40), (41, "}\nshort\n\nshort\nshorn"), (42, "}\n\nshort\nabc"), (43, "abc\n}"), (44, "\n\n"), (45, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, threshold=1, min_chars=12, exact_chars=exact).collect()}
    near, seen = brute.line_dedup(rows, 1, 12), set()
    known = {x for _, t in rows for x in (t or "").split("\n") if len(x) >= 12}
    for d, t in rows:
        kept = []
        left = Counter((near[d][0] or "").split("\n"))
        for x in (t or "").split("\n"):
            if x in known:
                left[x] -= (stays := left[x] > 0)
            else:
                stays = len(x) < exact or x not in seen
                seen.add(x)
            if stays:
                kept.append(x)
        assert got[d] == (None if t is None else "\n".join(kept))


def test_line_dedup_of_odd_rows(spark):
    line = "a line that is long enough to be judged by itself"
    odd = spark.createDataFrame([(1, line), (1, line), (2, line + "\nkept"), (None, line)], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_removed) for r in line_dedup.dedup_lines(odd).collect())
    assert rows == [(False, 1, line, 0), (False, 1, line, 0), (False, 2, "kept", 1), (True, 0, line, 0)]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_digest_of_empty_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
