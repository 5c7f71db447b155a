"""SimHash near-deduplication at a similarity of shingle sets: the wide form of :mod:`.simhash`.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles
is at least 0.8; a component of the links is one group. Fingerprints of such texts differ
in some ten bits of 64, so no choice of whole blocks of bits finds them all, as the
narrow form's buckets do. Here minimal hashes of the sets bring texts together, their
fingerprints are compared bit-sliced, and what is near is verified.

1. A row-local pass gives each text its sorted set of 64-bit shingle hashes, its
   fingerprint and the keys of ``BANDS`` bands of ``ROWS`` minimal hashes. Equal sets
   are one node. A pair at 0.8 has no band in common with a chance of
   (1 - 0.8**5)**32, three in a million.
2. Each node is tied to the least one of each of its bands; what hangs together is a
   *family*, so that a text goes to one place only, however many bands it shares.
3. In a family each fingerprint is compared with all others at once: carry-save counters over
   bit planes abandon words in which all exceed ``RADIUS`` bits, which a pair at 0.8 does with a
   chance of under one in a hundred thousand. What is near, and not yet in the same
   part, is verified on the whole sets. The family's centre, the node nearest to the majority of
   the fingerprints' bits, asks first, as it is likely to be the original of the others. Only links that join
   two parts are returned: fewer than the family has nodes.

A family beyond ``TILE`` nodes or ``TILE_BYTES`` of sets is dealt to pairs of tiles.

Defined results: words are those of :mod:`.simhash`; null and empty texts are one
node; fewer words than a shingle make one shingle of what is there; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_one, map_texts, materialize, schema_of, shuffle_partitions, texts
from .components import components
from .repeats import shingle_hashes
from .simhash import _rows, bit_planes, keep_one_each, majority, near_all

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: At 0.8 fingerprints differ in 9.7 bits on average (standard deviation 2.9; 12 and 3.1 for sets of a few shingles).
RADIUS = 26
BANDS, ROWS = 32, 5
#: Nodes, and bytes of their sets, that are compared with one another at a time.
TILE, TILE_BYTES = 4_000, 32 << 20
#: Bytes of sets that a task is sent, on average.
TASK_BYTES = 64 << 20
#: Shingles that are looked up at a time.
_TOGETHER = 4_000_000
#: Nodes of families that are broadcast, at most (some 60 bytes each); beyond that they are joined by a shuffle.
BROADCAST_NODES = 500_000
_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of all shingles, ascending."""
    words = text.encode().lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))][: len(words)], np.uint64)
    return np.unique(shingle_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), SHINGLE))


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band's minimal hashes; nothing for an empty set."""
    if len(shingles) == 0:
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[i : i + 512, None] ^ _FLIP) * _TIMES).min(0))
    numbered = np.concatenate([np.arange(BANDS, dtype=np.uint64)[:, None], least.reshape(BANDS, ROWS)], 1)
    return shingle_hashes(numbered.ravel(), ROWS + 1)[:: ROWS + 1]


_DESCRIBED = "doc_id long, key long, size int, fp long, bands array<long>"


def _described(batches):
    """Bands only where the task sees a set for the first time: copies carry nothing."""
    seen: set = set()
    for batch in batches:
        columns: list[list] = [[] for _ in range(4)]
        for text in texts(batch.column("text")):
            s = shingle_set(text)
            key = _key(s)
            new = key not in seen
            seen.add(key)
            for column, value in zip(columns, (key, len(s), majority(s) if new and len(s) else 0, bands(s).view(np.int64) if new else None), strict=True):
                column.append(value)
        prints = np.array(columns[2], np.uint64).view(np.int64)
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(prints), pa.array(columns[3], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], names=["doc_id", "key", "size", "fp", "bands"])


def _sets(batches):
    """Key and shingles of each set that the task sees, once."""
    seen: set = set()
    for batch in batches:
        keys, sets = [], []
        for text in texts(batch.column("text")):
            s = shingle_set(text)
            key = _key(s)
            if key not in seen:
                seen.add(key)
                keys.append(key)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "shingles"])


def _with_key(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys = [_key(shingle_set(x)) for x in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "_row_key"])

    return map_texts(docs, run, schema_of(docs, T.StructField("_row_key", T.LongType())))


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Can sets of these sizes be similar enough?"""
    return np.minimum(a, b) * SIMILAR[1] >= np.maximum(a, b) * SIMILAR[0]


def _centre(prints: np.ndarray) -> int:
    """The position of the fingerprint that is nearest to the majority of the bits."""
    ones = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    most = np.packbits(ones * 2 > len(prints), bitorder="little").view("<u8")[0]
    return int(np.bitwise_count(prints ^ most).argmin())


def _similar(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are similar enough to ``own``?"""
    length = np.array([len(o) for o in others], np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(length) - length)
    return both * SIMILAR[1] >= (length + len(own) - both) * SIMILAR[0]


def family_links(prints: np.ndarray, sets: list[np.ndarray], tile: np.ndarray, cross: bool) -> list[tuple[int, int]]:
    """Positions of verified pairs that join the parts of a family; with ``cross`` only pairs from different tiles are compared."""
    n, out = len(prints), []
    root, size, planes = np.arange(n), np.array([len(s) for s in sets], np.int64), bit_planes(prints)
    order = np.argsort(np.bitwise_count(prints ^ prints[_centre(prints)]), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for at in range(0, n, 64):
        asked = order[at : at + 64]
        for i, mask in zip(asked.tolist(), near_all(prints[asked], planes, n, RADIUS), strict=True):
            j = _rows(mask, n)
            j = j[(rank[j] > rank[i]) & (root[j] != root[i]) & _possible(size[j], size[i])]
            if cross:
                j = j[tile[j] != tile[i]]
            while len(j):
                some = j[: max(1, int(np.searchsorted(np.cumsum(size[j]), _TOGETHER)))]
                for k in some[_similar(sets[i], [sets[k] for k in some])].tolist():
                    if root[k] != root[i]:
                        root[root == root[k]] = root[i]
                        out.append((i, k))
                j = j[len(some) :]
                j = j[root[j] != root[i]]
    return out


def _links_in_families(batches):
    """``u, v`` of the links in each bucket. Rows come sorted by ``bucket, key``; a node may come several times."""

    def linked(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        key = rows.column("key").to_numpy()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        if len(new) < 2:
            return None
        rows, key = rows.take(pa.array(new)), key[new]
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        pairs = family_links(rows.column("fp").to_numpy().view(np.uint64), sets, rows.column("tile").to_numpy(), rows.column("cross")[0].as_py())
        if not pairs:
            return None
        a, b = (key[[p[s] for p in pairs]] for s in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column("bucket")[-1].as_py() != bucket[a]:
                if (made := linked(held)) is not None:
                    yield made
                held = []
            held.append(batch.slice(a, b - a))
    if held and (made := linked(held)) is not None:
        yield made


def similar_groups(docs: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of every row, and ``key, copies, least, root`` of every set: its rows, their least id and its component's name."""
    described = materialize(map_texts(docs.select("doc_id", "text"), _described, _DESCRIBED))
    new = F.when(F.col("bands").isNotNull(), F.struct("size", "fp", "bands"))
    nodes = materialize(described.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(new).alias("f")).select("key", "least", "copies", "f.*"))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    least = materialize(banded.groupBy("band").agg(F.min("key").alias("v"), F.count("*").alias("n")).filter("n > 1"))
    ties = join_one(banded, least, "band", "n", "inner").select(F.col("key").alias("u"), "v").filter("u != v").distinct()
    tied = components(ties)
    family = tied.select(F.col("u").alias("key"), F.col("v").alias("family")).unionByName(tied.select(F.col("v").alias("key"), F.col("v").alias("family")).distinct())
    kin = materialize(family.join(nodes.select("key", "size", "fp"), "key"))
    weight = kin.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    large = materialize(weight.select("family", tiles.alias("tiles")).filter("tiles > 1"))  # one row for a tile of nodes or more
    placed = kin.join(F.broadcast(large), "family", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    pair = lambda t: F.struct(F.xxhash64("family", F.least(t, F.col("tile")), F.greatest(t, F.col("tile"))).alias("bucket"), (t != F.col("tile")).alias("cross"))
    placed = placed.select("key", "fp", "tile", F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair).alias("pairs"))
    sent = kin.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("size") * 8), F.lit(0)).alias("bytes")).first()
    placed = F.broadcast(placed) if sent.n <= BROADCAST_NODES else placed
    held = map_texts(docs.select("text"), _sets, "key long, shingles binary").join(placed, "key").select("key", "fp", "tile", "shingles", F.explode("pairs").alias("p"))
    n = max(shuffle_partitions(docs.sparkSession), -(-sent.bytes // TASK_BYTES))
    dealt = held.select("key", "fp", "tile", "p.*", "shingles").repartition(n, "bucket").sortWithinPartitions("bucket", "key")
    joined = components(materialize(map_texts(dealt, _links_in_families, "u long, v long", "shingles")))
    rooted = nodes.join(joined.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").select("key", "copies", "least", F.coalesce("root", "key").alias("root"))
    return described.select("doc_id", "key"), materialize(rooted)


def keep_one_similar(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each group, columns unchanged: the smallest id, or a row without one if the group has no other."""
    rows, rooted = similar_groups(docs, tile)
    return keep_one_each(docs, rows, rooted, _with_key)
