"""Encoding and decoding with a word-level BPE file, in batched merge rounds.

The distinct words of a batch lie in one flat array of symbols.  A round looks up the rank of every pair of neighbours by binary
search over the sorted pair keys, finds the lowest rank of each word and merges all its places at once; words without a pair
that merges are done.  Because a symbol is made by one merge only, whose parts are made by earlier ones (checked when a file is
read), this gives what merging one place after the other gives.

In a word longer than any token a pair may be merged as soon as no pair within the length of the longest token ranks lower: what
would take one of its symbols away must grow out of such a pair.  So long words are merged in many places a round.

Normalising and splitting follow the file.  Which characters are letters, numbers and white space is asked of the tokenizers
library, whose tables differ from Python's.
"""
from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from nocturne.llm.common import binary, pick, ranges, slices, sliding_min

PIECE = 1 << 20  # characters after which a long text is cut at the next space
NONE = 1 << 40  # rank of a pair that doesn't merge

#: Characters that Python and the library normalise alike: in these, NFC changes nothing and lower case goes character by character.
COMMON = [*range(0x300), *range(0x2010, 0x2060)]
#: Lower case of one of them (dotted I) is outside.
KNOWN = [*COMMON, *range(0x300, 0x370)]


def _class(name: str, codes: Iterable[int]) -> str:
    """The characters of a class of the library among the given ones, as ranges of a character set."""
    split = pre_tokenizers.Split(Regex(rf"\p{{{name}}}" if len(name) == 1 and name.isupper() else name), "removed", invert=True)
    every = "".join(chr(c) for c in codes if not 0xD800 <= c < 0xE000)
    found = sorted({ord(c) for at in range(0, len(every), 1 << 14) for run, _ in split.pre_tokenize_str(every[at : at + (1 << 14)]) for c in run})
    out, at = [], 0
    while at < len(found):
        end = at
        while end + 1 < len(found) and found[end + 1] == found[end] + 1:
            end += 1
        out.append(f"\\U{found[at]:08x}-\\U{found[end]:08x}")
        at = end + 1
    return "".join(out)


class Codec:
    """One file. ``encode`` and ``decode`` take and give whole batches."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("unk_token", "dropout", "byte_fallback", "continuing_subword_prefix", "ignore_merges"))
        plain = plain and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and spec["decoder"] is None
        plain = plain and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a word-level BPE file of the kind this codec runs")
        self.rule = steps[0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files write as themselves
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)])
        self.last = np.array([vocabulary[letters[b] + end] for b in range(256)])
        merges = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        born = np.full(self.size, -1)
        born[merges[:, 2]] = np.arange(len(merges))
        rank = np.arange(len(merges))
        if len(np.unique(merges[:, 2])) < len(merges) or (born[merges[:, 0]] >= rank).any() or (born[merges[:, 1]] >= rank).any():
            raise ValueError(f"{path} makes a token by several merges or before its parts")
        keys = merges[:, 0] * self.size + merges[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), merges[:, 2]
        span = np.ones(self.size, np.int64)
        for a, b, c in merges.tolist():
            span[c] = span[a] + span[b]
        self.reach = int(span.max(initial=1))
        words = [""] * self.size
        for token, i in [*vocabulary.items(), *self.special.items()]:
            words[i] = token
        self.tokens = pa.array([f"{w} " for w in words], pa.large_string()).cast(pa.large_binary())
        self.usual, self.common = self._pattern(KNOWN), re.compile(f"[{''.join(map(re.escape, map(chr, COMMON)))}]*")

    def _pattern(self, codes) -> re.Pattern:
        classes = {n: _class(n, codes) for n in ("L", "N", r"\s")}
        return re.compile(self.rule.replace(r"\p{L}", classes["L"]).replace(r"\p{N}", classes["N"]).replace(r"\s", classes[r"\s"]))

    @functools.cached_property
    def any(self) -> re.Pattern:
        """The splitting rule for all characters (built when a text first needs it)."""
        return self._pattern(range(0x110000))

    def words(self, text: str) -> list[str]:
        """Words in the order of the text; the string of a special token is one."""
        if self.common.fullmatch(text):
            pattern, change = self.usual, str.lower
        else:
            pattern, change = self.any, self.library.normalizer.normalize_str
        if not self.cut.search(text):
            return pattern.findall(change(text))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*pattern.findall(change(text[at : m.start()])), m.group()]
            at = m.end()
        return out + pattern.findall(change(text[at:]))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def merge(self, symbols: np.ndarray, counts: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and how many each word has. ``near``: look for lower ranks within reach only, else in the whole word."""
        word = np.repeat(np.arange(len(counts)), counts)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NONE)  # of the pair that starts here
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NONE
            sizes = np.diff(np.append(starts, len(symbols)))
            if over.any():
                ended = np.repeat(over, sizes)
                done.append((word[ended], symbols[ended]))
                word, symbols, rank = word[~ended], symbols[~ended], rank[~ended]
                lowest, sizes = lowest[~over], sizes[~over]
                if not len(symbols):
                    break
            if near:
                pad = np.full(self.reach, NONE)
                low = sliding_min(np.concatenate((pad, rank, pad)), 2 * self.reach + 1)
            else:
                low = np.repeat(lowest, sizes)
            take = (rank == low) & (rank < NONE)
            # Equal pairs that overlap (a run of one symbol) are merged from the left, as far as the run is free from its start on.
            run = np.cumsum(np.concatenate(([True], rank[1:] != rank[:-1]))) - 1
            first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            at = np.arange(len(symbols))
            stop = np.minimum.reduceat(np.where(take, len(symbols), at), first)
            take &= (at < stop[run]) & ((at - first[run]) % 2 == 0)
            left = np.flatnonzero(take)
            symbols[left] = self.made[rank[left]]
            stays = np.ones(len(symbols), bool)
            stays[left + 1] = False
            new = np.cumsum(stays)[left] - 1
            symbols, word, rank = symbols[stays], word[stays], rank[stays]
            near_new = np.zeros(len(symbols), bool)
            near_new[new] = True
            near_new[new[new > 0] - 1] = True
            changed = np.flatnonzero(near_new)
            rank[changed] = NONE
            changed = changed[changed < len(symbols) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(counts))

    def encode_distinct(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word, flat, and how many each has."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, where, data = words.buffers()
        offsets = np.frombuffer(where, np.int64, len(words) + 1, words.offset * 8)
        raw = np.frombuffer(data, np.uint8)
        sizes = np.diff(offsets)
        special = pc.index_in(words, pa.array(list(self.special), pa.large_string())).to_numpy(zero_copy_only=False) if self.special else np.full(len(words), np.nan)
        named = ~np.isnan(special)
        long = ~named & (sizes > 2 * self.reach)
        short = ~named & ~long
        ids, counts, order = [], np.zeros(len(words), np.int64), []
        for chosen, near in ((short, False), (long, True)):
            which = np.flatnonzero(chosen)
            symbols = self.inner[raw[ranges(offsets[which], sizes[which])]]
            ends = np.cumsum(sizes[which]) - 1
            symbols[ends] = self.last[raw[offsets[which + 1] - 1]]
            merged, counts[which] = self.merge(symbols, sizes[which], near)
            ids.append(merged)
            order.append(which)
        which = np.flatnonzero(named)
        counts[which] = 1
        ids.append(np.array([*self.special.values(), 0])[special[which].astype(np.int64)])
        order.append(which)
        flat, order = np.concatenate(ids), np.concatenate(order)
        at = np.zeros(len(words), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ranges(at, counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each has."""
        words, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.words(text)
            sizes[i] = len(found)
            words += found
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        ids, counts = self.encode_distinct(coded.dictionary)
        which = coded.indices.to_numpy().astype(np.int64)
        many = counts[which]
        totals = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(sizes)))]
        return ids[ranges((np.cumsum(counts) - counts)[which], many)], np.diff(totals)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """UTF-8 text of each run of ids: the tokens with a space between them."""
        joined = self.tokens.take(pa.array(ids))
        data = memoryview(joined.buffers()[2] or b"")
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
        return [data[a : max(a, b - 1)] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _cut(text: str) -> Iterator[str]:
    """The text in pieces that end with a space; words and what is normalised together never cross one."""
    at = 0
    while len(text) - at > PIECE:
        end = text.find(" ", at + PIECE)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def _batches(texts: list[bytes | None], limit: int = 8 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """(number of the text, piece) lists of about ``limit`` characters."""
    which, pieces, size = [], [], 0
    for i, raw in enumerate(texts):
        for piece in _cut((raw or b"").decode(errors="replace")):
            which.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= limit:
                yield which, pieces
                which, pieces, size = [], [], 0
    if pieces:
        yield which, pieces


def _round_trip(path: str, with_ids: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches):
            n = batch.num_rows
            total, ids_hash, text_hash = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            kept, texts = [[] for _ in range(n)], [[] for _ in range(n)]
            for which, pieces in _batches(binary(batch.column("text"))):
                ids, counts = own.encode(pieces)
                small = ids.astype("<u4")
                at = 0
                for i, many, text in zip(which, counts.tolist(), own.decode(ids, counts)):
                    if many:
                        part = small[at : at + many]
                        ids_hash[i].update(part.data)
                        if total[i]:
                            text_hash[i].update(b" ")
                        text_hash[i].update(text)
                        total[i] += many
                        if with_ids:
                            kept[i].append(part)
                        if with_text:
                            texts[i].append(bytes(text))
                    at += many
            out = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array([h.hexdigest() for h in ids_hash]), pa.array([h.hexdigest() for h in text_hash])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array([np.concatenate([np.zeros(0, "<u4"), *k]).astype(np.int32) for k in kept], pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                out.append(pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def round_trip(docs: DataFrame, path: str, *, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every document, by a word-level BPE file.

    A null or empty text, or one of white space, has no ids and decodes to an empty text. Rows with equal or null doc_ids each get
    their row; an empty table gives an empty table; other columns, also ones whose names differ in case only, are left out. Strings of special tokens are those tokens, as in the library. Bytes that aren't
    UTF-8 are read as U+FFFD. Long texts are cut at spaces, so a task holds some 8 MB of text at a time, or one longer run without spaces.
    """
    docs = pick(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(_round_trip(path, with_ids, with_text), schema + ", ids array<int>" * with_ids + ", decoded string" * with_text)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return round_trip(docs, path, with_ids=True).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); no or null ids give an empty text, and null ids inside are left out. An id outside the file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = [np.array([i for i in x or [] if i is not None], np.int64) for x in batch.column("ids").to_pylist()]
            texts = own.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bytes(t) for t in texts], pa.binary()).cast(pa.string())], ["doc_id", "text"])

    encoded = pick(encoded, "doc_id", "ids")
    return encoded.mapInArrow(run, f"doc_id {encoded.schema[0].dataType.simpleString()}, text string")
