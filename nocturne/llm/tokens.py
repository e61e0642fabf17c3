"""Byte-level BPE files run by tiktoken where that gives the ids of the tokenizers library."""
from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import tiktoken
from tokenizers import Tokenizer

#: The splitting rule of byte-level files (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: tiktoken's splitter keeps a stack entry for each character of a white-space run, and a run of a million overflows it.
#: Texts with a run this long go to the tokenizers library, which has no such limit and gives the same ids.
LONG_SPACE = 100_000
_long_space = re.compile(rf"\s{{{LONG_SPACE}}}")


def alphabet() -> dict[str, int]:
    """The byte for each of the 256 characters in which byte-level files write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_ranks(path: str) -> tuple[dict[bytes, int] | None, list[str]]:
    """(bytes and id of each token, special strings) of a byte-level BPE file whose merges rank as their ids do; None for others."""
    spec = json.loads(Tokenizer.from_file(path).to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    simple = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not spec.get("normalizer") and model["type"] == "BPE"
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if not simple:
        return None, special
    vocabulary = model["vocab"]
    ranked = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if None in ranked or any(a >= b for a, b in zip(ranked, ranked[1:])):
        return None, special
    of = alphabet()
    ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return (ranks if all(bytes([b]) in ranks for b in range(256)) else None), special


@functools.cache
def encoder(path: str, plain: bool = False) -> Callable[[str], list[int]]:
    """A function from text to ids, those of the tokenizers library for this file.

    A byte-level BPE whose merges rank as their ids do is run by tiktoken, several times faster; texts that hold a special token's string
    or a very long run of white space, and any other kind of file, go through tokenizers itself. With ``plain`` a special token's string is
    text like any other.
    """
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    slow = lambda text: library.encode(text, add_special_tokens=False).ids
    ranks, special = byte_ranks(path)
    if ranks is None:
        return slow
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if not plain and any(t in text for t in special) or len(text) > LONG_SPACE and _long_space.search(text):
            return slow(text)
        return fast(text)

    return encode
