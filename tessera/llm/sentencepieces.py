"""SentencePiece BPE encoding with original byte spans, and decoding.

Normalisation walks the text and replaces, at each place, the longest prefix
that the model's compiled character map has (a double-array trie), recording for
every byte of the result where in the original it comes from. Only bytes that can begin an
entry are tried; what lies between them is taken over at once. The normalised text is cut
at spaces, which no piece of the vocabulary crosses, and each distinct cut is
merged best score first with byte fallback: the new cuts of a batch all together, a
step of every cut at a time, over a table of the pairs that make a piece; very long ones by a
heap. Each piece is projected through the alignment to a byte span of the original.

Everything is own work; the sentencepiece library is used in the tests alone.

Defined results: a null or empty text has no pieces and decodes to the empty text;
texts are encoded whole, in time that grows as n log n; repeated rows are encoded
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, map_texts, texts

SPACE = "▁"
#: Cuts whose ids a worker remembers.
CACHE_WORDS = 400_000
#: Characters of a cut that is merged together with others, at most.
_LONGEST = 64
#: Characters of new cuts that are merged together, at most, on average.
_TOGETHER = 2_000_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_CUTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def fields(blob: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, blob[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, blob[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes, and the replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self.first = np.zeros(256, bool)  # bytes that begin an entry
        if self.units:
            root = self._offset(self.units[0])
            for b in range(256):
                self.first[b] = root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """The replacement at ``at`` and how many bytes it takes; without an entry, the character itself."""
        units, node, best = self.units, 0, None
        if units:
            node ^= self._offset(units[0])
            for i in range(at, len(raw)):
                node ^= raw[i]
                if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                    break
                unit = units[node]
                node ^= self._offset(unit)
                if unit >> 8 & 1:
                    best = units[node] & 0x7FFFFFFF, i + 1 - at
        if best:
            start = best[0]
            return self.texts[start : self.texts.index(b"\0", start)], best[1]
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at : at + n], n

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer = dict(x for n, v in parts if n == 2 for x in fields(v))
        normal = dict(x for n, v in parts if n == 3 for x in fields(v))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models")
        self.map = CharacterMap(normal.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        self.pieces, self.scores, self.types = [], [], []
        for n, v in parts:
            if n == 1:
                p = dict(fields(v))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, _NORMAL))
        if {_USER, _UNUSED} & set(self.types) or trainer.get(24):
            raise ValueError("user-defined or unused pieces and suffix white space aren't supported")
        self.fallback = bool(trainer.get(35))
        self.unknown = self.types.index(_UNKNOWN)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == _NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == _BYTE}
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        if not self.escape or any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids) or not self.fallback:
            raise ValueError("a piece reaches across white space: this vocabulary can't be cut there")
        self._cache: dict[str, list[int]] = {}
        self._raw = [bytes([int(p[3:5], 16)]) if t == _BYTE else p.encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self._width = np.array([len(r) for r in self._raw], np.int64)
        self._decimal = [str(i) for i in range(len(self.pieces))]
        self._pairs()

    def _pairs(self) -> None:
        """The sorted table of symbol pairs that make a piece: rank of the piece (0 has the best score) and its symbol.

        A symbol is the id of a piece, or beyond them a character that only longer pieces have.
        """
        symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        order = {v: k for k, v in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        rows = [(symbols[p[:k]] << 32 | symbols[p[k:]], order[self.scores[i]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(sorted(rows) or [(-1, 0, 0)], np.int64)
        self._pair, self._rank, self._made = (np.ascontiguousarray(table[:, k]) for k in range(3))
        self._char = np.full(0x110000, -1, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self._char[ord(c)] = i

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the original byte it comes from."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.squeeze:
            return self._squeezed(raw)
        one = np.frombuffer(raw, np.uint8)
        at, parts, sources = 0, [SPACE.encode()] * self.dummy, [np.zeros(len(SPACE.encode()) * self.dummy, np.int64)]

        def plain(upto: int) -> None:
            """Take over what has no entry; a space becomes the mark."""
            if upto > at:
                parts.append(raw[at:upto].replace(b" ", SPACE.encode()))
                sources.append(np.repeat(np.arange(at, upto), np.where(one[at:upto] == 32, len(SPACE.encode()), 1)))

        for i in np.flatnonzero(self.map.first[one]).tolist():
            if i < at:
                continue
            got, n = self.map.longest(raw, i)
            if got == raw[i : i + n]:
                continue  # an entry that changes nothing, or none
            plain(i)
            made = got.replace(b" ", SPACE.encode())
            parts.append(made)
            sources.append(np.full(len(made), i, np.int64))
            at = i + n
        plain(len(raw))
        return b"".join(parts).decode(), np.concatenate([*sources, [len(raw)]])

    def _squeezed(self, raw: bytes) -> tuple[str, np.ndarray]:
        """As :meth:`normalise` where runs of spaces become one and outer ones go: character by character."""
        mark, at, out, align = SPACE.encode(), 0, bytearray(), []
        while at < len(raw):
            got, n = self.map.longest(raw, at)
            if got != b" ":
                break
            at += n
        if at == len(raw):
            return "", np.zeros(1, np.int64)
        if self.dummy:
            out += mark
            align += [at] * len(mark)
        spaced = True
        while at < len(raw):
            got, n = self.map.longest(raw, at)
            while spaced and got.startswith(b" "):
                got = got[1:]
            if got:
                made = got.replace(b" ", mark)
                out += made
                align += range(at, at + n) if made == raw[at : at + n] else [at] * len(made)
                spaced = got.endswith(b" ")
            at += n
        end = len(raw)
        while out.endswith(mark):
            del out[-len(mark) :]
            end = align[len(out)]
            del align[len(out) :]
        return out.decode(), np.array([*align, end], np.int64)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of what each pair makes; the rank of a pair that makes nothing is beyond all others."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._pair, key), len(self._pair) - 1)
        there = (self._pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self._rank[at], 1 << 30), self._made[at]

    def _merged_together(self, cuts: list[str]) -> list[list[int]]:
        """Ids of many cuts: every step merges the best pair, the leftmost of equals, of each cut that still has one."""
        length = np.fromiter(map(len, cuts), np.int64, len(cuts))
        text = "".join(cuts)
        symbol = self._char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        # symbols of a cut lie side by side in rows of the flat arrays; `nothing` parts cuts
        cut = np.repeat(np.arange(len(cuts)), length)
        place = np.arange(len(symbol))
        nothing = 1 << 30
        rank, made = self._looked_up(symbol, np.append(symbol[1:], -1))
        rank[np.append(cut[1:] != cut[:-1], True)] = nothing
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            start = np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            merging = best >> 32 < nothing
            if not merging.all():
                size = np.diff(np.append(start, len(symbol)))
                over = np.repeat(~merging, size)
                done.append((place[over], symbol[over]))
                keep = ~over
                shift = np.cumsum(keep) - 1
                best = shift[best[merging] & 0xFFFFFFFF]
                symbol, cut, place, rank, made = (x[keep] for x in (symbol, cut, place, rank, made))
                if not len(symbol):
                    break
            else:
                best = best & 0xFFFFFFFF
            symbol[best] = made[best]
            rank[best] = rank[best + 1]  # whether a symbol of the same cut follows is told by the pair that goes
            keep = np.ones(len(symbol), bool)
            keep[best + 1] = False
            at = best - np.arange(len(best))
            symbol, cut, place, rank, made = (x[keep] for x in (symbol, cut, place, rank, made))
            for i in (at, at[at > 0] - 1):
                i = i[np.append(cut, -1)[i + 1] == cut[i]]
                rank[i], made[i] = self._looked_up(symbol[i], symbol[i + 1])
            last = np.append(cut, -1)[at + 1] != cut[at]
            rank[at[last]] = nothing
        places, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (place, symbol)
        order = np.argsort(places, kind="stable")
        places, symbols = places[order], symbols[order]
        ends = np.cumsum(length)
        bounds = np.searchsorted(places, ends).tolist()
        odd = (symbols < 0) | (symbols >= len(self.pieces))
        strange = set(np.searchsorted(ends, places[odd], "right").tolist())
        values, out, a = symbols.tolist(), [], 0
        for i, b in enumerate(bounds):
            out.append(self._with_bytes(cuts[i], places[a:b] - (ends[i] - length[i]), values[a:b]) if i in strange else values[a:b])
            a = b
        return out

    def _with_bytes(self, cut: str, places: np.ndarray, symbols: list[int]) -> list[int]:
        """A cut's ids where some symbols are no pieces: those become bytes."""
        ids: list[int] = []
        for at, i in zip(places.tolist(), symbols, strict=True):
            ids += [i] if 0 <= i < len(self.pieces) else [self.bytes[b] for b in cut[at].encode()]
        return ids

    def _merge(self, cut: str) -> list[str]:
        """Adjacent symbols merge best score first, then leftmost, until no pair is a piece."""
        symbols: list[str | None] = list(cut)
        after = [*range(1, len(cut)), -1]
        prior = [*range(-1, len(cut) - 1)]
        heap: list = []

        def offer(a: int, b: int):
            if a >= 0 and b >= 0:
                pair = symbols[a] + symbols[b]
                i = self.ids.get(pair)
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], a, b, pair))

        for i in range(len(cut) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, pair = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, None
            after[a] = after[b]
            if after[b] >= 0:
                prior[after[b]] = a
            offer(prior[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def _encode_cut(self, cut: str) -> list[int]:
        ids: list[int] = []
        for s in self._merge(cut):
            i = self.ids.get(s)
            ids += [i] if i is not None else [self.bytes[b] for b in s.encode()]
        return ids

    def _surface(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if self.types[i] == _BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            kind = self.types[i]
            out.append("" if kind == _CONTROL else self.unk_surface if kind == _UNKNOWN else self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def _learn(self, cuts: set[str]) -> None:
        """Remember the ids of these cuts."""
        if len(self._cache) + len(cuts) > CACHE_WORDS:
            self._cache.clear()
        held, size = [], 0
        for cut in cuts:
            if len(cut) > _LONGEST:
                self._cache[cut] = self._encode_cut(cut)
                continue
            held.append(cut)
            size += len(cut)
            if size >= _TOGETHER:
                self._cache.update(zip(held, self._merged_together(held), strict=True))
                held, size = [], 0
        if held:
            self._cache.update(zip(held, self._merged_together(held), strict=True))

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """For each text ids, and begin and end of every piece in the original bytes."""
        normal = [self.normalise(t) for t in texts]
        cuts = [_CUTS.findall(n) for n, _ in normal]
        new = set().union(*cuts) - self._cache.keys()
        if new:
            if len(self._cache) + len(new) > CACHE_WORDS:
                new = set().union(*cuts)  # what is known is forgotten
            self._learn(new)
        out = []
        for own, (_, align) in zip(cuts, normal, strict=True):
            ids = [*chain.from_iterable(map(self._cache.__getitem__, own))]
            lengths = self._width[np.array(ids, np.int64)]
            ends = np.cumsum(lengths)
            out.append((ids, align[ends - lengths], align[ends]))
        for cut in [c for c in new if len(c) > _LONGEST]:
            del self._cache[cut]
        return out

    def encode_aligned(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and begin and end of every piece in the original bytes."""
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        return self.encode_aligned(text)[0]

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end): the piece's bytes in the original text."""
        ids, begins, ends = self.encode_aligned(text)
        return list(zip(ids, begins.tolist(), ends.tolist(), strict=True))

    def written(self, ids: list[int]) -> str:
        return ",".join(map(self._decimal.__getitem__, ids))

    def decode_encoded(self, ids: list[int]) -> str:
        """``decode`` of ids that ``encode`` gave: their bytes are whole characters, and none is unknown or control."""
        return self.finish(b"".join(map(self._raw.__getitem__, ids)).decode())

    def finish(self, surface: str) -> str:
        """Joined surfaces as text: the leading mark of the dummy prefix goes, the others become spaces."""
        if (self.dummy or self.squeeze) and surface.startswith(SPACE):
            surface = surface[1:]
        return surface.replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        return self.finish(self._surface(ids))


_loaded: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _digests(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            every = texts(batch.column("text"))
            for text, (ids, begins, ends) in zip(every, m.encode_all(every), strict=True):
                decoded = m.decode_encoded(ids)
                made = (len(ids), _sha(m.written(ids)), _sha(decoded), zlib.crc32(np.stack([begins, ends], 1).astype("<i8").tobytes()), decoded == text)
                for column, value in zip(columns, made, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "round_trip"])

    return run


def _pieces(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            rows = m.encode_all(texts(batch.column("text")))
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array([m.decode_encoded(r[0]) for r in rows], pa.string())], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, begins, ends, decoded``: pieces with their byte spans in the original, and the round trip."""
    docs = docs.select("doc_id", "text")
    ints = T.ArrayType(T.IntegerType())
    return map_texts(docs, _pieces(path), T.StructType([docs.schema["doc_id"], *(T.StructField(c, ints) for c in ("ids", "begins", "ends")), T.StructField("decoded", T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return map_texts(docs, _digests(public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, round_trip boolean")
