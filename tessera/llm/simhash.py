"""SimHash near-deduplication with bit-sliced comparison.

1. A row-local pass gives each document its 64-bit fingerprint.
2. Equal fingerprints collapse to one node before anything is compared, so copies
   never make pairs.
3. Two fingerprints within ``radius`` bits agree on at least ``m - radius`` of ``m``
   blocks of bits; each choice of that many blocks is a bucket key. ``m`` follows
   the number of nodes, so that buckets stay small at any size.
4. In a bucket the fingerprints lie as bit planes, 64 rows to a word. Differences
   are counted for a whole word at a time by carry-save bitwise counters, and
   words in which all rows have exceeded the radius are abandoned. Only what joins
   two so far separate parts of a bucket is emitted: fewer links than members.
   A bucket with more than ``TILE`` members is dealt to pairs of tiles.
5. Components of the links give each document the smallest reachable id.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle of what is there; null ids take
part, but are never a component's id unless it has no other; repeated rows share
a node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, join_one, keep_rows, map_texts, materialize, schema_of, shuffle_partitions, texts
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Members of a bucket that one task compares.
TILE = 20_000
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; only A-Z are lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0
    h, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return h(line, seed)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    return majority(np.fromiter((h(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.fromiter(map(fingerprint, texts(batch.column("text"))), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit r of word w of plane b is bit b of value 64 w + r."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _count(differ, live: np.ndarray, radius: int) -> np.ndarray:
    """Bits of ``live`` whose rows differ in at most ``radius`` planes; ``differ(b, words)`` gives plane b's differences.

    A carry-save counter of a few bits is kept for all rows of a word at once; ``over``
    holds the rows beyond the radius. Words without a row left are given up every eight planes.
    """
    width = radius.bit_length()
    out, words = np.zeros_like(live), np.arange(live.shape[-1])
    over = ~live
    count = [np.zeros_like(live) for _ in range(width)]
    for b in range(64):
        carry = differ(b, words)
        for i in range(width):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over |= carry
        if b % 8 == 7:
            above, equal = np.zeros_like(over), np.full_like(over, _ONES)
            for i in reversed(range(width)):  # is the count above the radius?
                if radius >> i & 1:
                    equal &= count[i]
                else:
                    above |= equal & count[i]
                    equal &= ~count[i]
            over |= above
            alive = (over != _ONES).reshape(-1, over.shape[-1]).any(0)
            if not alive.any():
                return out
            if alive.sum() * 2 < len(words):
                words, over = words[alive], over[..., alive]
                count = [c[..., alive] for c in count]
    out[..., words] = ~over
    return out


def _rows(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def near_in_runs(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``radius`` bits apart among rows with equal keys (rows sorted by key), by the distance of the rows."""
    planes, n, left, right = bit_planes(values), len(values), [], []
    for lag in range(1, n):
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[: n - lag] = keys[:-lag] == keys[lag:]
        if not same.any():
            break
        skip, shift = divmod(lag, 64)

        def differ(b, words, skip=skip, shift=shift):
            plane = np.append(planes[b][skip:], np.zeros(skip + 1, np.uint64))
            other = plane[words] if shift == 0 else plane[words] >> np.uint64(shift) | plane[words + 1] << np.uint64(64 - shift)
            return planes[b][words] ^ other

        hits = _rows(_count(differ, np.packbits(same, bitorder="little").view("<u8"), radius), n)
        left.append(hits)
        right.append(hits + lag)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def near_all(asked: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """For each value asked a mask of the ``n`` values in ``planes`` that are near it."""
    flip = np.where(asked[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1), _ONES, np.uint64(0))
    live = np.zeros(planes.shape[1] * 64, np.uint8)
    live[:n] = 1
    live = np.broadcast_to(np.packbits(live, bitorder="little").view("<u8"), (len(asked), planes.shape[1])).copy()
    return _count(lambda b, w: planes[b][w][None, :] ^ flip[:, b][:, None], live, radius)


def parts_of_run(values: np.ndarray, radius: int = RADIUS, block: int = 64) -> np.ndarray:
    """For each value of a long run the position of one member of its part.

    Parts grow by search: members found are compared, a block at a time, with what
    no part has yet, so a part of any size costs one comparison with the rest.
    """
    part = np.full(len(values), -1, np.int64)
    rest = np.arange(len(values))
    while len(rest):
        seed, queue = rest[0], rest[:1]
        part[seed] = seed
        rest = rest[1:]
        while len(queue) and len(rest):
            asked, queue = queue[:block], queue[block:]
            planes = bit_planes(values[rest])
            near = np.bitwise_or.reduce(near_all(values[asked], planes, len(rest), radius), axis=0)
            found = _rows(near, len(rest))
            if len(found):
                part[rest[found]] = seed
                queue = np.concatenate([queue, rest[found]])
                rest = np.delete(rest, found)
    return part


def _bucket_links(radius: int, long_run: int = 64):
    """Links that join the parts of each bucket; rows arrive sorted by ``key, fp``."""

    def of(keys: np.ndarray, values: np.ndarray):
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        length = np.diff(np.append(start, len(keys)))
        each = np.repeat(length, length)
        u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        short = (each > 1) & (each <= long_run)
        k, x = keys[short], values[short]
        a, b = near_in_runs(k, x, radius)
        if len(a):
            root = np.arange(len(x))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(i), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    u.append(x[j : j + 1])
                    v.append(x[i : i + 1])
        for s, n in zip(start[length > long_run], length[length > long_run], strict=True):
            part = parts_of_run(values[s : s + n], radius)
            child = np.flatnonzero(part != np.arange(n))
            u.append(values[s : s + n][child])
            v.append(values[s : s + n][part[child]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (u, v)], names=["u", "v"])

    def run(batches):
        keys, values = [], []
        held = None
        for batch in batches:
            k, x = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if held is not None and len(k) and k[-1] == held and k[0] == held:
                keys.append(k)
                values.append(x)
                continue
            keys.append(k)
            values.append(x)
            k, x = np.concatenate(keys), np.concatenate(values)
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut:
                yield of(k[:cut], x[:cut])
            keys, values, held = [k[cut:]], [x[cut:]], k[-1] if len(k) else None
        if keys:
            yield of(np.concatenate(keys), np.concatenate(values))

    return run


def block_masks(nodes: int, radius: int = RADIUS) -> list[int]:
    """Masks of bits of which any two fingerprints within the radius agree on at least one whole."""
    m = radius + 2
    while m < radius + 4 and 64 * (m - radius) // m < nodes.bit_length() - 2:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: links between different fingerprints of column ``fp`` that leave no two within the radius in separate components."""
    spark = nodes.sparkSession
    count = nodes.count()
    masks = block_masks(count, radius)
    keyed = nodes.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))).alias("key"))
    hot = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    if not hot.isEmpty():
        tile = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.xxhash64("key", F.least(t, tile), F.greatest(t, tile)))
        keyed = keyed.join(hot, keyed["key"] == hot["hot_key"], "left").select("fp", F.explode(F.when(F.col("tiles").isNull(), F.array("key")).otherwise(pairs)).alias("key"))
    n = max(shuffle_partitions(spark), -(-count * len(masks) // 2_000_000))
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(radius), "u long, v long")


def _rooted(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` of every row, and ``fp, copies, least, root`` of every fingerprint: its rows, their least id and its component's name."""
    prints = materialize(map_texts(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long"))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    joined = components(links(nodes.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return prints, nodes.join(joined, "fp", "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    prints, rooted = _rooted(docs, radius)
    rooted = materialize(rooted)
    # a component or a fingerprint may hold most rows: both joins spread such keys
    several = materialize(rooted.groupBy("root").agg(F.min("least").alias("smallest"), F.count("*").alias("members")).filter("members > 1"))
    named = join_one(rooted, several, "root", "members").select("fp", "copies", F.coalesce("smallest", "least").alias("component_id"))
    return join_one(prints, materialize(named), "fp", "copies", "inner").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame, rows: DataFrame, rooted: DataFrame, keyed) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, null after all others, then the smallest key.

    ``rows`` has ``doc_id, key`` of every row, ``rooted`` ``key, copies, least, root`` of every key;
    ``keyed`` appends the key as ``_row_key``.
    """
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key", "copies")).alias("f")
    chosen = rooted.groupBy("root").agg(first).select(F.col("f.least").alias("_least"), F.col("f.key").alias("key"), F.col("f.copies").alias("copies"), F.lit(True).alias("_chosen"))
    kept = F.col("_chosen").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_least"))
    decided = join_one(rows, materialize(chosen), "key", "copies").select("doc_id", "key", kept.alias("keep"))
    return keep_rows(docs, materialize(decided), keyed)


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            prints = np.fromiter(map(fingerprint, texts(batch.column("text"))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, "_row_key"])

    return map_texts(docs, run, schema_of(docs, T.StructField("_row_key", T.LongType())))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group, columns unchanged: the smallest id, or a row without one if the group has no other."""
    prints, rooted = _rooted(docs, radius)
    return keep_one_each(docs, prints.withColumnRenamed("fp", "key"), materialize(rooted.withColumnRenamed("fp", "key")), _with_fingerprint)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
