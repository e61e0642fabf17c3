"""Fitted and structural operators: held-out accuracy, recall, exact round trips, planted cases and odd rows."""
import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nocturne.llm import chat, neighbors, packing, quality, toxicity, url_filters
from nocturne.llm.queries import RULES, op6_chat_formatting

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(11)


def halves(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", F.lit("x").alias("HOST"))
    held = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    return docs, labels.filter(~held), labels.filter(held)


def test_quality_on_held_out_labels(spark):
    docs, fitted, held = halves(spark)
    rows = quality.score(docs, fitted).join(held.withColumnRenamed("quality", "label"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.kept == bool(r.label) for r in rows]) >= 0.98


def strength(rows):
    """Prior strength by moments from (n, good, centre) of groups."""
    total = sum(n for n, _, _ in rows)
    noise = [c * (1 - c) for _, _, c in rows]
    between = sum(n * (s / n - c) ** 2 for n, s, c in rows) / total - sum(noise) / total
    return min(1e4, max(1.0, sum(noise) / len(noise) / max(between, 1e-6) - 1))


def test_quality_beside_plain_python(spark):
    """Shares, strengths and posteriors from the text evidence alone; a document counts for no share of its own."""
    docs = spark.createDataFrame(
        [(i, f"Some words about topic {i % 7}, and more of them. " * (1 + i % 5) + "!" * (i % 11), f"host{i % 4 if i < 50 else i}", ["en", "fr", None][i % 3]) for i in range(90)], "doc_id long, text string, source string, lang string"
    )
    truth = {i: int(i % 11 < 5) for i in range(60)}
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(list(truth.items()), "doc_id long, quality int")).collect()}
    prior = np.log(np.mean(list(truth.values())) / (1 - np.mean(list(truth.values()))))
    site = {r.doc_id: (r.source, r.lang or "") for r in docs.collect()}
    good = {d: truth.get(d, r.p_text) for d, r in got.items()}
    group = lambda key: {k: (len(x), sum(x)) for k in {key(d) for d in site} for x in [[good[d] for d in site if key(d) == k]]}
    hosts, paths = group(lambda d: site[d][0]), group(lambda d: site[d])
    centre = sum(good.values()) / len(good)
    host_k = strength([(n, s, centre) for n, s in hosts.values()])
    shrunk = {h: (s + host_k * centre) / (n + host_k) for h, (n, s) in hosts.items()}
    path_k = strength([(n, s, shrunk[h]) for (h, _), (n, s) in paths.items()])
    for d, r in got.items():
        (hn, hs), (n, s) = hosts[site[d][0]], paths[site[d]]
        host = (hs - good[d] + host_k * centre) / (hn - 1 + host_k)
        path = min(1 - 1e-4, max(1e-4, (s - good[d] + path_k * host) / (n - 1 + path_k)))
        evidence = np.log(r.p_text / (1 - r.p_text)) - prior
        want = 1 / (1 + np.exp(-(evidence + np.log(path / (1 - path)))))
        assert (r.host_share, r.path_share, r.quality) == pytest.approx((host, path, want), abs=1e-9)
        if hn == 1:
            assert r.path_share == pytest.approx(centre, abs=1e-9)  # nothing else is known of a site of one document


def test_quality_shrinks_sparse_sites(spark):
    good, bad = "The cat sat on the mat, and then it slept. " * 5, "@@@ ### %%% &&& " * 20
    rows = [(i, good if i % 2 else bad, "mixed", "a") for i in range(40)] + [(i, good, "fine", "a") for i in range(40, 80)] + [(100, None, None, None), (101, "", "fine", "b"), (None, good, "fine", "a"), (40, good, "fine", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(bool(i % 2) or i >= 40), None) for i in range(60)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, n int")
    got = {(r.doc_id, r.host_share): r for r in quality.score(docs, labels).collect()}
    assert len(got) >= 83 and all(0 <= r.quality <= 1 for r in got.values())
    share = {r.doc_id: r.path_share for r in got.values()}
    assert share[1] < share[41] and share[41] > 0.9  # mixed and fine sites
    kept = {r.doc_id: r.kept for r in got.values()}
    assert all(kept[i] == (i % 2 == 1 or i >= 40) for i in range(80))
    none = quality.score(docs, labels.limit(0)).collect()
    assert all(r.quality == pytest.approx(0.5, abs=1e-3) and r.kept for r in none)
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, quality.score(docs, labels)).filter("doc_id < 40").count() == 20


def test_toxicity_on_held_out_labels(spark):
    docs, fitted, held = halves(spark)
    rows = toxicity.grade(docs, toxicity.fit(docs, fitted)).join(held.withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert np.mean([r.toxic == bool(r.label) for r in rows]) >= 0.93
    assert all(r.severity >= r.p_toxic for r in rows) and np.mean([r.severity for r in rows if r.label]) > 5 * np.mean([r.severity for r in rows if not r.label])


def test_toxicity_grades_share_weights(spark):
    rows, labels = [], []
    for i in range(300):
        n = i % 4  # grade: how many of the bad words
        words = [f"w{rng.randrange(200)}" for _ in range(30)] + ["vileness", "vilest", "rottenly"][:n]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, n))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "Vilely, rotten rottenish VILES!"), (None, "x")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 3), (5, None)], "doc_id long, toxic int"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    assert np.mean([got[i].grade == n for i, n in labels]) > 0.9
    assert not got[900].toxic and got[900].severity == got[901].severity and got[902].toxic
    empty = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len(empty.features) == 0 and toxicity.grade(docs, empty).count() == len(rows) + 4
    assert toxicity.grade(docs.limit(0), model).count() == 0


def cosines(x, q):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit[q] @ unit.T


def test_neighbours_recall(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = vectors.toPandas().sort_values("vec_id").reset_index(drop=True)
    q = np.flatnonzero(local.vec_id % 10 == 0)
    s = cosines(np.stack(local.embedding).astype(float), q)
    s[np.arange(len(q)), q] = -2
    best = {int(local.vec_id[i]): set(local.vec_id[np.argsort(-s[k])[:5]]) for k, i in enumerate(q)}
    for block in (512, 16):
        rows = neighbors.nearest(vectors, vectors.filter("vec_id % 10 = 0"), block=block).collect()
        assert sum(r.vec_id in best[r.query_id] for r in rows) >= 0.9 * 5 * len(q) and len(rows) == 5 * len(q)
        assert all(r.score == pytest.approx(s[list(local.vec_id[q]).index(r.query_id), list(local.vec_id).index(r.vec_id)], abs=1e-12) for r in rows)


def test_neighbours_recall_on_groups(spark):
    """Most vectors in tight groups: queries outside them need far more cells than the median vector."""
    r = np.random.default_rng(8)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grouped = np.arange(4000) % 10 < 7
    x[grouped] = x[r.integers(0, 20, grouped.sum()) * 10 + 9] + r.normal(size=(grouped.sum(), 64)) * 0.005
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.arange(0, 4000, 13)
    s = cosines(x, q)
    s[np.arange(len(q)), q] = -2
    best = {int(i): set(np.argsort(-s[n])[:5].tolist()) for n, i in enumerate(q)}
    rows = neighbors.nearest(df, df.filter("vec_id % 13 = 0")).collect()
    assert len(rows) == 5 * len(q)
    for some in (set(q.tolist()), set(q[~grouped[q]].tolist()), set(q[grouped[q]].tolist())):
        recall = sum(r.vec_id in best[r.query_id] for r in rows if r.query_id in some) / (5 * len(some))
        print("recall", len(some), recall)
        assert recall >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, EMBEDDING int")
    got = {}
    for r in neighbors.nearest(df, df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert got == {0: [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)], 1: [(1, 0, 1.0), (2, 2, 1.0), (3, 3, 0.0)], 2: [(1, 0, 1.0), (2, 1, 1.0), (3, 3, 0.0)], 3: [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]}
    assert neighbors.nearest(df.limit(0), df).count() == 0 and neighbors.nearest(df, df.limit(0)).count() == 0


def test_packing_round_trip(spark):
    odd = [None, "", "a", "<|endoftext|> x", "naïve 😀 ß  \x85 tab\t\t\n\n  end ", "x" * 5000, "word " * 3000, "'s I'll don't 12345 ½ ²", "a", "a"]
    rows = list(enumerate(odd)) + [(20 + i, "of the and " * rng.randint(1, 300)) for i in range(60)] + [(20, "of"), (None, "none")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, LENGTH int")
    packed = packing.pack(df, TOKENIZER, capacity=256, with_ids=True).cache()
    plain = Tokenizer.from_file(TOKENIZER)
    want = sorted(tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in rows)
    pieces = packed.toPandas()
    first = pieces[pieces.piece == 0]
    assert len(first) == len(rows) and pieces[pieces.piece > 0].length.eq(256).all()
    joined = []
    for i, t in rows:
        if i not in (20, None):
            own = pieces[pieces.doc_id == i].sort_values("piece")
            assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
            joined.append(tuple(np.frombuffer(b"".join(map(bytes, own.ids)), "<u4").tolist()))
    assert sorted(joined) == sorted(w for w in (tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows if i not in (20, None)))
    total = sum(map(len, want))
    sequences = packing.assemble(packed).collect()
    assert sum(r.length for r in sequences) == total and all(r.length <= 256 and len(r.ids) == r.length for r in sequences)
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
    assert len(sequences) <= -(-total // 256) * 1.05 + 1
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_packing_of_long_white_space(spark):
    """Runs that overflow the fast encoder's stack, alone and inside prose."""
    n = 2_000_000
    texts = [" " * n, "\t" * n, "\n" * n, " \n\t\x0b" * (n // 4), "some prose" + " " * n + "and more", ("a b " + "\n" * 150_000) * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Tokenizer.from_file(TOKENIZER)
    packed = packing.pack(df, TOKENIZER, with_ids=True).toPandas()
    for i, text in enumerate(texts):
        own = packed[packed.doc_id == i].sort_values("piece")
        assert np.array_equal(np.frombuffer(b"".join(map(bytes, own.ids)), "<u4"), [*plain.encode(text, add_special_tokens=False).ids, 0])


def test_fullest_configuration():
    for _ in range(200):
        sizes = sorted({rng.randint(3, 40) for _ in range(4)}, reverse=True)
        counts = [rng.randint(1, 4) for _ in sizes]
        use = packing.fullest(sizes, counts, 60)
        best, sums = 0, {sizes[0]}
        for j, (s, c) in enumerate(zip(sizes, counts)):
            sums = {x + s * k for x in sums for k in range(c - (j == 0) + 1)}
        best = max(x for x in sums if x <= 60)
        assert use[0] >= 1 and all(u <= c for u, c in zip(use, counts)) and sum(u * s for u, s in zip(use, sizes)) == best


def test_plans_are_near_the_bound():
    for top in (300, 1500):
        counts = {n: rng.randint(0, 40) for n in range(1, top)}
        plan = packing.plan_sequences(counts, 2048)
        fill = {}
        for length, _, count, sequence, offset in plan.rows:
            for i in range(count):
                fill.setdefault(sequence + i, []).append((offset, length))
        assert {n: c for n, c in plan.used.items() if c} == {n: c for n, c in counts.items() if c} and len(fill) == plan.sequences
        for parts in fill.values():
            parts.sort()
            assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
        assert plan.sequences <= 1.01 * sum(n * c for n, c in counts.items()) / 2048 + 2


def page(head):
    return f"<html><head>{head}</head><body>x</body></html>"


def test_blocks_follow_links(spark):
    rows = [
        (1, "https://a.net/x", page('<link rel="canonical" href="http://b.com/de/1">')), (2, "http://c.net/y?q=1#f", page("<meta http-equiv='refresh' content=\"0; URL='/z'\">")),
        (3, "http://c.net/z", page("<LINK href=//a.net/x rel=canonical>")), (4, "http://d.org/k", page('<link rel="stylesheet" href="http://b.com/de/1">')),
        (5, "http://e.org/k", page('<link rel="canonical" href="http://b.com/de/1">')), (6, None, None), (7, "no url", None), (8, "http://f.net/a/b.html", page("<link rel=canonical href=c.html>")),
        (9, "http://f.net/a/c.html", ""), (10, "http://X.COM/fr/2?a", page('<link rel="canonical" href="http://g.net/">')), (11, "http://g.net", ""), (12, "mailto://example.org/es/1", ""),
        (12, "http://a.net/x", None), (None, "http://sub.example.org/en/12", None), (13, "http://moved.net/", None),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, Host int")
    moved = spark.createDataFrame([("http://moved.net/", "http://h.com/de/"), (None, "http://h.com/de/")], "source string, target string")
    got = ((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, RULES, moved).collect())
    want = [
        (0, "sub.example.org", "/en/12", "example.org/en/1", "block"), (1, "a.net", "/x", None, "block"), (2, "c.net", "/y", None, "block"), (3, "c.net", "/z", None, "block"),
        (4, "d.org", "/k", "org/", "allow"), (5, "e.org", "/k", "org/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "f.net", "/a/b.html", None, "allow"),
        (9, "f.net", "/a/c.html", None, "allow"), (10, "x.com", "/fr/2", "com/fr/", "allow"), (11, "g.net", "", None, "allow"), (12, "example.org", "/es/1", "example.org/es/", "block"),
        (12, "a.net", "/x", None, "block"), (13, "moved.net", "/", None, "block"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert url_filters.judge(pages.limit(0), RULES).count() == 0


def test_pairs_of_negative_conversations(spark):
    """Conversations 2n and 2n + 1 are a pair on either side of zero; the learned spans come with the result."""
    rows = [(c, 0, "user", "Hi") for c in (-4, -3, -1, 0)] + [(-1, 1, "assistant", "Yes"), (0, 1, "assistant", "No")]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    got = {r.pair_id: r for r in op6_chat_formatting(spark, folder).collect()}
    assert sorted(got) == [-2, -1, 0] and (got[-2].chosen_id, got[-2].rejected_id, got[-2].n_prompt_turns) == (-4, -3, 1)
    assert (got[-1].chosen, got[-1].rejected_learned) == ("", 13) and got[0].chosen_spans == f"{len(say('user', 'Hi')) + 22}-{len(say('user', 'Hi')) + 34}"


def say(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_preferences(spark):
    turns = [
        (0, 0, "user", "Hi"), (0, 1, "assistant", "Hello"), (0, 2, "user", "Why?"), (0, 3, "assistant", "Because."), (1, 1, "assistant", "Hello"), (1, 0, "user", "Hi"), (1, 2, "user", "How?"),
        (2, 0, "user", "Same"), (3, 0, "user", "Same"), (4, 0, None, None), (4, None, "assistant", "late"), (None, 0, "user", "nobody"), (6, 0, "assistant", "é😀"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, TURNS string")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 6, None), (3, 6, None)], "pair_id long, chosen_id long, rejected_id long")
    rows = sorted(chat.format_preferences(df, pairs).collect(), key=lambda r: r.pair_id)
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    a = rows[0]
    assert (a.n_prompt_turns, a.prompt) == (2, say("user", "Hi") + say("assistant", "Hello"))
    assert a.chosen == say("user", "Why?") + say("assistant", "Because.") and a.rejected == say("user", "How?")
    assert [a.chosen[s.first : s.last] for s in a.chosen_spans] == ["Because.<|im_end|>"] and a.rejected_spans == []
    assert (rows[1].n_prompt_turns, rows[1].prompt, rows[1].chosen, rows[1].rejected) == (1, say("user", "Same"), "", "")
    assert (rows[2].n_prompt_turns, rows[2].chosen, rows[2].rejected) == (0, say("", "") + say("assistant", "late"), "")
    assert len(rows) == 5 and rows[3].chosen_spans[0].last - rows[3].chosen_spans[0].first == 12
    assert chat.format_preferences(df.limit(0), pairs).filter("chosen = '' and prompt = ''").count() == 5
    assert chat.format_preferences(df, pairs.limit(0)).count() == 0
