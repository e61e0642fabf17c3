"""Grouping of spelling variants: words of a vocabulary that differ by one edit.

Near words are found by finite-state composition.  The words of a partition are put into a minimised acyclic acceptor; its composition with
a transducer that makes one edit and with the acceptor again has states (place in one word, edit made or not, place in the other).
Before the edit both places are the same state, so the walk goes along the acceptor; after it the walk is the intersection of two states' rests, and
where the two are one state (minimising makes such states one) all their rests follow at once.  Words are numbers: each arc knows how many words come
before it.

Two words at one edit share their first half or the other's length in their last half, half of the shorter length.  So a word stands in the partition of
its first and of its last half, as the shorter and as the longer word of a pair, and the half is what leads from the start to the partition's initial
state.  A partition with too many words is split by the same rule on what its words don't share yet; the part that shares less than the split's beginning
takes only pairs whose edit lies there, so each pair is found once.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import U64, materialize, mix, pick, ranges

BUCKET = 60_000  # rows whose partitions are handled together, on average
GROUP = 20_000  # words of a partition beyond which it is split
LABELS = 1 << 21  # more than there are code points
FAR = 1 << 30


def count_words(docs: DataFrame, *, letters: str = r"a-zÀ-ÿ", typo: int = 199) -> DataFrame:
    """(word, n) of maximal runs of letters of the texts, A-Z lower-cased, after planted misspellings.

    One in ``typo`` pairs of document and run loses a code point: those whose crc32 of `<doc_id>:<run>` is divisible by ``typo`` lose the one numbered crc32
    modulo their length. A null text has no words; a null doc_id counts as an empty string.
    """
    docs = pick(docs, "doc_id", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"([{letters}]+)"), F.lit(1))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    at = F.expr("cast(h % length(run) as int)")
    shorter = F.concat(F.expr(f"substr(run, 1, {'cast(h % length(run) as int)'})"), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % typo == 0, shorter).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# Acceptor and composition


class Acceptor:
    """Minimised acceptor of the strings of several groups, which come sorted by group and code points; a group has its initial state."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, groups: np.ndarray):
        n_groups = int(groups[-1]) + 1 if len(groups) else 0
        offsets = np.cumsum(lengths) - lengths
        node, final = groups.copy(), [np.zeros(n_groups, bool)]
        final[0][groups[lengths == 0]] = True
        levels: list[tuple[np.ndarray, np.ndarray]] = []  # arcs into each depth: parent within its depth, label
        active, depth = np.flatnonzero(lengths > 0), 0
        while len(active):
            parent, label = node[active], codes[offsets[active] + depth]
            new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])))
            child = np.cumsum(new) - 1
            levels.append((parent[new], label[new]))
            node[active] = child
            depth += 1
            ends = lengths[active] == depth
            final.append(np.zeros(int(child[-1]) + 1, bool))
            final[-1][child[ends]] = True
            active = active[~ends]
        # Equal states become one, from the deepest on: a state is its final mark and its arcs to states that are settled.
        register: dict[tuple[int, int], int] = {}
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # new states: final, degree, and their arcs below
        arcs: list[tuple[np.ndarray, np.ndarray]] = []
        below = np.zeros(0, np.int64)
        for d in range(len(final) - 1, -1, -1):
            marks, n = final[d], len(final[d])
            parent, label = levels[d] if d < len(levels) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            degree = np.bincount(parent, minlength=n)
            sums = []
            for seed in (U64(0x51ED270B35AE7F2D), U64(0xA0761D6478BD642F)):
                arc = mix((label.astype(U64) << U64(40)) + below.astype(U64) + seed)
                total = np.concatenate(([U64(0)], np.cumsum(arc, dtype=U64)))
                upto = np.concatenate(([0], np.cumsum(degree)))
                sums.append((mix(total[upto[1:]] - total[upto[:-1]] + seed) + marks.astype(U64)).tolist())
            first = len(register)
            state = np.fromiter((register.setdefault(k, len(register)) for k in zip(*sums)), np.int64, n)
            fresh = np.unique(state, return_index=True)
            made = fresh[1][fresh[0] >= first]  # one node of each new state, in the order of the states
            kept.append((marks[made], degree[made], made))
            start = np.cumsum(degree) - degree
            which = ranges(start[made], degree[made])
            arcs.append((label[which], below[which]))
            below = state
        self.initial = below
        self.final = np.concatenate([k[0] for k in kept])
        self.degree = np.concatenate([k[1] for k in kept])
        self.first = np.cumsum(self.degree) - self.degree
        self.label, self.to = (np.concatenate([a[i] for a in arcs]).astype(np.int64) for i in (0, 1))
        owner = np.repeat(np.arange(len(self.final)), self.degree)
        self.keys = owner * LABELS + self.label
        # Words below each state; states come after those that their arcs reach.
        self.words, self.skip = np.zeros(len(self.final), np.int64), np.zeros(len(self.label), np.int64)
        at = 0
        for k in kept:
            n = len(k[0])
            lo, hi = (int(self.first[at]), int(self.first[at + n - 1] + self.degree[at + n - 1])) if n else (0, 0)
            many = self.words[self.to[lo:hi]]
            before = np.concatenate(([0], np.cumsum(many)))
            start = self.first[at : at + n] - lo
            self.words[at : at + n] = self.final[at : at + n] + before[start + self.degree[at : at + n]] - before[start]
            self.skip[lo:hi] = before[:-1] - np.repeat(before[start], self.degree[at : at + n]) + np.repeat(self.final[at : at + n], self.degree[at : at + n])
            at += n

    def near(self, first: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of words (numbers) of one group at exactly one edit, each pair once, whose common beginning is shorter than the group's ``reach``.

        ``first`` is the number of each group's first word. Of the places where a letter of a run of equal ones can be left out the last one counts.
        """
        at, word, left, depth = self.initial, first, reach, 0
        p = q = i = j = not_next = np.zeros(0, np.int64)
        while len(at) or len(p):
            new: list[tuple] = []
            if len(p):
                done = (p == q) & (not_next < 0)
                many = self.words[p[done]]
                if len(many):
                    yield ranges(i[done], many), ranges(j[done], many)
                p, q, i, j, not_next = (x[~done] for x in (p, q, i, j, not_next))
                ends = self.final[p] & self.final[q]
                if ends.any():
                    yield i[ends], j[ends]
                swap = self.degree[p] > self.degree[q]
                p, q, i, j = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, j, i), np.where(swap, i, j)
                row, arc = np.repeat(np.arange(len(p)), self.degree[p]), ranges(self.first[p], self.degree[p])
                free = self.label[arc] != not_next[row]
                row, arc = row[free], arc[free]
                key = q[row] * LABELS + self.label[arc]
                other = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[other] == key if len(key) else np.zeros(0, bool)
                row, arc, other = row[hit], arc[hit], other[hit]
                new.append((self.to[arc], self.to[other], i[row] + self.skip[arc], j[row] + self.skip[other], np.full(len(arc), -1)))
            if len(at):
                some = left > depth
                at, word, left = at[some], word[some], left[some]
                many = self.degree[at]
                row, arc = np.repeat(np.arange(len(at)), many), ranges(self.first[at], many)
                place = word[row] + self.skip[arc]
                new.append((self.to[arc], at[row], place, word[row], self.label[arc]))  # a letter more
                behind = np.cumsum(many)[row] - 1 - np.arange(len(arc))  # arcs of the same state after this one
                one = np.repeat(np.arange(len(arc)), behind)
                two = ranges(np.arange(len(arc)) + 1, behind)
                new.append((self.to[arc[one]], self.to[arc[two]], place[one], place[two], np.full(len(one), -1)))  # another letter
                at, word, left = self.to[arc], place, left[row]
                depth += 1
            p, q, i, j, not_next = (np.concatenate(x) for x in zip(*new))


def _bucket(pairs: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        words, counts, keys = table["word"].to_pylist(), table["n"].to_numpy(), table["key"].to_pylist()
        lo, tail, least, before = (table[c].to_numpy().astype(np.int64) for c in ("lo", "tail", "least", "before"))
        rests = [w[a : len(w) - b] for w, a, b in zip(words, lo.tolist(), tail.tolist())]
        order = np.array(sorted(range(len(words)), key=lambda k: (keys[k], rests[k])), np.int64)
        words, sorted_keys = [words[k] for k in order], [keys[k] for k in order]
        starts = [k for k in range(len(order)) if not k or sorted_keys[k] != sorted_keys[k - 1]]
        group = np.zeros(len(order), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        codes = np.frombuffer("".join(rests[k] for k in order).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.array([len(rests[k]) for k in order], np.int64)
        counts, head = counts[order], order[starts]
        sizes, shortest = np.array([len(w) for w in words]), least[order]
        found = Acceptor(codes, lengths, group).near(np.array(starts), before[head] - lo[head])
        rank = np.empty(len(order), np.int64)
        best_first = np.array(sorted(range(len(order)), key=lambda k: (-counts[k], words[k])), np.int64)
        rank[best_first] = np.arange(len(order))
        many, best, links = np.zeros(len(order), np.int64), np.full(len(order), len(order)), []
        for i, j in found:
            own = np.minimum(sizes[i], sizes[j]) == shortest[i]  # two of the longer words meet in another partition
            i, j = i[own], j[own]
            if pairs:
                links.append((i, j))
                continue
            one, two = np.concatenate((i, j)), np.concatenate((j, i))
            many += np.bincount(one, minlength=len(order))
            np.minimum.at(best, one, rank[two])
        column = pa.array(words, pa.string())
        if pairs:
            i, j = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in links)]) for k in (0, 1))
            return pa.table({"word": column.take(pa.array(np.concatenate((i, j)))), "near": column.take(pa.array(np.concatenate((j, i))))})
        some = np.flatnonzero(many)
        form = best_first[best[some]]
        return pa.table({"word": column.take(pa.array(some)), "n_near": many[some], "form": column.take(pa.array(form)), "form_n": counts[form]})

    return run


# Partitions


def _halved(rows: DataFrame) -> DataFrame:
    """Two rows for each: by the first and by the last half of what its partition doesn't share yet."""
    half = F.expr("(least - lo - tail) div 2").cast("int")
    first = F.struct((F.col("lo") + half).alias("lo"), F.col("tail").alias("tail"), F.col("before").alias("before"))
    last = F.struct(F.col("lo").alias("lo"), (F.col("tail") + half).alias("tail"), F.least(F.col("before"), F.col("lo") + half).alias("before"))
    return rows.select("word", "n", "least", F.explode(F.array(first, last)).alias("x")).select("word", "n", "least", "x.*")


def _keyed(rows: DataFrame) -> DataFrame:
    shared = F.expr("substr(word, 1, lo)"), F.expr("substr(word, length(word) - tail + 1)")
    return rows.withColumn("key", F.concat_ws(":", "least", "lo", "tail", "before", *shared))


def partitions(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, least, lo, tail, before, key): the partitions that a word stands in, none with more than ``group`` words that can still be split."""
    length = F.length("word")
    rows = vocabulary.filter(length > 0).select("word", "n", F.explode(F.array(length, length - 1)).alias("least"))
    rows = rows.filter("least > 0").select("*", F.lit(0).alias("lo"), F.lit(0).alias("tail"), F.lit(FAR).alias("before"))
    rows = _keyed(_halved(rows))
    parts = []
    while True:
        rows = materialize(rows)
        hot = materialize(rows.filter("least - lo - tail > 1").groupBy("key").count().filter(F.col("count") > group).select(F.col("key").alias("hot")))
        parts.append(rows.join(hot, rows["key"] == hot["hot"], "left_anti"))
        if hot.isEmpty():
            break
        rows = _keyed(_halved(rows.join(hot, rows["key"] == hot["hot"], "left_semi")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _composed(vocabulary: DataFrame, pairs: bool, schema: str, group: int, bucket: int) -> DataFrame:
    rows = partitions(vocabulary, group)
    buckets = max(1, -(-4 * vocabulary.count() // bucket))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket(pairs), schema)


def near_pairs(vocabulary: DataFrame, *, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, near), both ways round: words of (word, n) that differ by exactly one inserted, deleted or replaced code point."""
    return _composed(_clean(vocabulary), True, "word string, near string", group, bucket)


def _clean(vocabulary: DataFrame) -> DataFrame:
    """Words once each, with their counts added up."""
    rows = pick(vocabulary, "word", "n").filter("word is not null and word != ''")
    return materialize(rows.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")))


def variants(vocabulary: DataFrame, *, ratio: int = 5, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that has at least ``ratio`` times the word's n, else null; root
    is where following the forms ends, the word itself if it has none. n_near counts near words. Repeated words are one with the sum of their n; null and empty words are left
    out; other columns are ignored; an empty table gives an empty table. ``ratio`` is 2 or more, so that forms never go round.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more")
    words = _clean(vocabulary)
    found = _composed(words, False, "word string, n_near long, form string, form_n long", group, bucket)
    start = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("form_n"))
    every = start.unionByName(found.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", "form", "form_n"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    near = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    strong: Column = -F.col("best.less") >= ratio * F.col("n")
    judged = near.select("word", "n", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    judged = materialize(judged)
    most = judged.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(max(most, 2), ratio)) + 1  # a chain's n grows by the ratio at each step
    roots = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):  # each pass doubles how far a root is
        nearer = roots.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        roots = materialize(roots.join(nearer, roots["root"] == nearer["via"], "left").select("word", F.coalesce("beyond", "root").alias("root")))
    ends = roots.select(F.col("word").alias("of"), "root")
    joined = judged.join(ends, judged["word"] == ends["of"], "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
