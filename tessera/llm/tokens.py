"""Byte-level BPE ids of whole texts.

A text goes through tiktoken where the file's merges are ranked by id, as then both
libraries give the same ids; else through tokenizers itself, as do the rare texts whose
runs of white space (about a million characters) exhaust tiktoken's pattern engine.
The file's added tokens are split off first, as tokenizers does: where one stands in a
text, it is one id. Nothing is cached: with many distinct words, looking them up costs
more than merging them again.
"""

from __future__ import annotations

import json

import numpy as np

#: The byte-level pre-tokenizer's published pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for 256 and up, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """A tiktoken encoding of the file's vocabulary, or None if ids don't follow the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("ignore_merges"):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    letters = byte_letters()
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 > len(model["vocab"]):
        return None
    added = spec["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class BpeIds:
    """``ids(text)``: little-endian unsigned 32-bit ids as tokenizers gives them with ``add_special_tokens=False``; ``counted(text)``: how many."""

    def __init__(self, path: str):
        self._path, self._slow, self._ranked = path, None, ranked(path)

    def _library(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
        return self._slow

    def _encode(self, text: str) -> np.ndarray:
        if self._ranked:
            try:
                return self._ranked.encode_to_numpy(text, allowed_special="all")
            except ValueError as e:  # raised before any id is given
                if "backtracking" not in str(e):
                    raise
        return np.array(self._library().encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> bytes:
        return self._encode(text).astype("<u4", copy=False).tobytes()

    def counted(self, text: str) -> int:
        return len(self._encode(text))


_loaded: dict[str, BpeIds] = {}


def bpe(path: str) -> BpeIds:
    """One encoder for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = BpeIds(path)
    return _loaded[path]
