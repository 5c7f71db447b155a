"""Words of a batch of texts as arrays: found by a table of byte classes, numbered exactly, hashed once for each different word."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD, GAP, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text whose arrays are held at once; a text is cut only where a break stands.
SPAN_BYTES = 4 << 20


def byte_classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte: ``gaps`` end a word, ``breaks`` end a piece as well, all others belong to words."""
    out = np.zeros(256, np.uint8)
    out[list(gaps)] = GAP
    out[list(breaks)] = BREAK
    return out


@dataclass
class Words:
    """Words in the order of the texts."""

    row: np.ndarray  #: the text's place in the batch
    code: np.ndarray  #: the word's place in ``vocabulary``
    length: np.ndarray  #: bytes
    raw: np.ndarray  #: the words' bytes without anything between them
    vocabulary: pa.Array
    start: np.ndarray  #: bytes of the span before it
    kind: np.ndarray  #: the class of each byte of the span
    first: np.ndarray  #: where texts begin in the span

    @cached_property
    def piece(self) -> np.ndarray:
        """Equal for neighbours that no break and no end of a text parts."""
        new = self.kind == BREAK
        new[self.first] = True
        return np.cumsum(new, dtype=np.int32)[self.start]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """XXH64 of each different word."""
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))


def spans(texts: pa.Array, classes: np.ndarray, size: int = SPAN_BYTES, lower: bool = True):
    """:class:`Words` of spans of some ``size`` bytes; null has no words. A span ends with a text or at a break."""
    held = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    if len(held) == 0 or ends[-1] == ends[0]:
        return
    data = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    at = 0
    while at < len(data):
        upto = min(at + size, len(data))
        if upto < len(data):
            text_end = int(ends[np.searchsorted(ends, upto)])
            upto = text_end if text_end - upto <= size else _next_break(data, classes, upto, text_end)
        found = _words(data[at:upto], np.clip(ends - at, 0, upto - at), classes, lower)
        if found is not None:
            yield found
        at = upto


def _next_break(data: np.ndarray, classes: np.ndarray, start: int, stop: int) -> int:
    for a in range(start, stop, SPAN_BYTES):
        found = np.flatnonzero(classes[data[a : min(a + SPAN_BYTES, stop)]] == BREAK)
        if len(found):
            return a + int(found[0]) + 1
    return stop


def _words(data: np.ndarray, ends: np.ndarray, classes: np.ndarray, lower: bool) -> Words | None:
    if lower:
        data = _LOWER[data]
    kind = classes[data]
    inside = kind == WORD
    first = np.unique(ends[:-1])
    first = first[first < len(data)]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    if len(start) == 0:
        return None
    raw = data[inside]
    # a word ends where the next begins in ``raw``
    place = np.cumsum(inside, dtype=np.int64)[start] - 1
    bounds = np.append(place, len(raw))
    encoded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
    many = np.diff(np.searchsorted(start, ends))  # words of each text
    return Words(np.repeat(np.arange(len(many)), many), encoded.indices.to_numpy().astype(np.int64), np.diff(bounds), raw, encoded.dictionary, start, kind, first)
