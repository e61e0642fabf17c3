"""Plain Python versions of the operators, for small tables."""
import hashlib
import re
from collections import Counter

SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def low(text):
    return (text or "").translate(LOWER)


def substring_dedup(docs, width=13):
    """{doc_id: (n_words, n_removed, kept text)} of (doc_id, text) with distinct ids."""
    words = {d: SPACED.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def decontamination(docs, items, width=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, found = ALNUM.findall(low(t)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if got := windows.get(tuple(w[j : j + n])):
                    found |= got
                    hit[j : j + n] = [1] * n
        h = sum(hit)
        out[d] = (len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w))
    return out


def near_duplicates(docs, percent=85, size=5):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) with distinct ids."""
    sets = {}
    for d, t in docs:
        w = SPACED.findall(low(t))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    where, up = {}, {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for k in s:
            where.setdefault(k, []).append(d)
    for d, s in sets.items():
        for e, n in Counter(e for k in s for e in where[k] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_dedup(docs, threshold=1, min_chars=32, exact_chars=None):
    """{doc_id: (text, n_lines, n_removed, n_links)} of (doc_id, text) with distinct ids."""
    first = {}
    for d, t in sorted(docs):
        for i, line in enumerate((t or "").split("\n")):
            if t is not None and len(line) >= (min_chars if exact_chars is None else exact_chars):
                first.setdefault(line, (d, i))
    known, late, links = sorted((x for x in first if len(x) >= min_chars), key=len), set(), Counter()
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if len(b) > len(a) + threshold:
                break
            if distance(a, b) <= threshold:
                late.add(max(a, b, key=first.get))
                links[a] += 1
                links[b] += 1
    out = {}
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(lines) if x not in first or (first[x] == (d, i) and x not in late)]
        out[d] = (None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept), sum(links[x] for x in lines))
    return out
