"""MinHash near-deduplication by an LSH forest.

Two texts are linked if the Jaccard similarity of their sets of two-word shingles is at least 0.8;
a component of the links is one group.

1. A row-local pass gives each text its set and a signature of ``ORDERS`` labels of ``DEEP`` minimal
   hashes, a byte each. Equal sets are one node from here on, so copies never make pairs.
2. Each label is one order of all nodes: sorted by it, nodes with a long common prefix are neighbours.
   A *region* is a run of nodes whose labels have the first ``SHALLOW`` bytes in common; where more than
   ``DENSE`` nodes have them, it is one of those that have all ``DEEP`` in common. Of regions with the
   same nodes in several orders one stays. A pair at 0.8 shares no region
   with a chance of (1 - 0.8**5)**40, one in ten million, among dense ones of (1 - 0.8**6)**40, five in a million.
3. In a region signatures are compared whole: a pair is *near* if ``NEAR`` of its bytes agree
   (a pair at 0.8 falls short with a chance of under one in ten million). No region is cut: one beyond ``TILE`` nodes
   is dealt to pairs of tiles.
4. Near pairs that span each region, found from its centre outwards, are verified on the whole sets:
   at most one for each node of a region. What they join is a part.
5. Nodes that are still near a node of another part are put together - each goes to one place with its set -
   and compared exactly, until all are joined or found different.

So what is sent grows with the near pairs found in step 4 and with the nodes left for step 5, not with pairs of a group.

Defined results: words are runs without ASCII white space, only A-Z are lower-cased; fewer words than a shingle
make one shingle of what is there; a text without words has an empty set and is linked with nothing; null ids take
part, but are never a component's id unless it has no other; repeated rows share a node; texts are read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, join_one, map_texts, materialize, shuffle_partitions, small_or_shuffled
from .components import components
from .words import byte_classes, spans

SHINGLE = 2
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
ORDERS, DEEP, SHALLOW = 40, 6, 5
#: Nodes of a region from which on deeper prefixes part it.
DENSE = 64
#: Bytes of two signatures that agree at least, where the sets may be similar enough.
NEAR = 156
#: Nodes, and bytes of their sets, that are compared with one another at a time.
TILE, TILE_BYTES = 4_000, 32 << 20
#: Bytes of sets that a task is sent, on average.
TASK_BYTES = 64 << 20
#: Digests that a task remembers.
SEEN = 200_000
CLASSES = byte_classes(b" \t\n\x0b\x0c\r")
_RANDOM = np.random.default_rng(13)
_FLIP = _RANDOM.integers(0, 1 << 32, ORDERS * DEEP, np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, ORDERS * DEEP, np.uint32) | np.uint32(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct 64-bit hashes of the shingles of each text, ascending."""
    out = [np.empty(0, np.uint64)] * len(texts)
    for w in spans(texts, CLASSES):  # no class is a break, so a span ends with a text
        own = w.hashes()[w.code]
        edge = np.flatnonzero(np.append(True, w.row[1:] != w.row[:-1]))
        h = np.zeros(max(len(own) - shingle + 1, 0), np.uint64)
        for i in range(shingle):
            h = (h ^ (h >> np.uint64(29))) * _ODD + own[i : i + len(h)]
        h = (h ^ (h >> np.uint64(32))) * _ODD
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(own)], strict=True):
            if b - a >= shingle:
                out[w.row[a]] = np.unique(h[a : b - shingle + 1])
            else:
                out[w.row[a]] = np.array([xxhash.xxh64_intdigest(own[a:b].tobytes(), b - a)], np.uint64)
    return out


def signature(shingles: np.ndarray) -> bytes:
    """A byte of each minimal hash, by order and depth."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(ORDERS * DEEP, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(short), 256):
        np.minimum(least, ((short[i : i + 256, None] ^ _FLIP) * _TIMES).min(0), out=least)
    return ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


_DESCRIBED = [("row", T.LongType()), ("hash", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("size", T.LongType()), ("signature", T.BinaryType())]


def _described(shingle: int):
    """The signature only where the task sees a set for the first time: copies carry nothing."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column("text"), shingle):
                d = _digest(s) if len(s) else (None, None)
                rows.append((*d, len(s), signature(s) if len(s) and d not in seen else None))
                seen.add(d)
            if len(seen) > SEEN:
                seen.clear()
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("hash"), *made], names=["doc_id", *(k for k, _ in _DESCRIBED)])

    return run


def _sets(shingle: int):
    """Digest and set of each text, once a task."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            keys, sets = [], []
            for s in shingle_sets(batch.column("text"), shingle):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    keys.append(d)
                    sets.append(s.tobytes())
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sets, pa.binary())], names=["d1", "d2", "shingles"])

    return run


def _agreeing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.count_nonzero(many == one, axis=1)


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Can sets of these sizes be similar enough?"""
    return np.minimum(a, b) * SIMILAR[1] >= np.maximum(a, b) * SIMILAR[0]


def _from_centre(signatures: np.ndarray) -> np.ndarray:
    """Positions, those first that agree most with the commonest byte of each place."""
    common = np.array([np.bincount(c).argmax() for c in signatures.T], np.uint8)
    return np.argsort(-_agreeing(common, signatures), kind="stable")


def _similar(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are similar enough to ``own``?"""
    length = np.array([len(o) for o in others], np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(length) - length)
    return both * SIMILAR[1] >= (length + len(own) - both) * SIMILAR[0]


def spanning(signatures: np.ndarray, size: np.ndarray, part: np.ndarray, tile: np.ndarray | None) -> list[tuple[int, int]]:
    """Positions of near pairs from different parts (and tiles, if given) that join all whom such pairs join."""
    out, n = [], len(signatures)
    if (part == part[0]).all():
        return out
    root, alone = np.arange(n), len(np.unique(part)) == n
    for i in (order := _from_centre(signatures)):
        j = order[root[order] != root[i]] if alone and tile is None else order
        j = j[(part[j] != part[i]) & (root[j] != root[i]) & _possible(size[j], size[i])]
        if tile is not None:
            j = j[tile[j] != tile[i]]
        for k in j[_agreeing(signatures[i], signatures[j]) >= NEAR].tolist() if len(j) else ():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                out.append((int(i), k))
    return out


def verified(signatures: np.ndarray, sets: list[np.ndarray], part: np.ndarray, tile: np.ndarray | None) -> list[tuple[int, int]]:
    """Positions of similar pairs that join the parts of a family; exact, but for pairs that aren't near."""
    out, root, size = [], np.unique(part, return_inverse=True)[1], np.array([len(s) for s in sets], np.int64)
    for i in (order := _from_centre(signatures)):
        j = order[(root[order] != root[i]) & _possible(size[order], size[i])]
        if tile is not None:
            j = j[tile[j] != tile[i]]
        j = j[_agreeing(signatures[i], signatures[j]) >= NEAR] if len(j) else j
        while len(j):
            some = j[: max(1, int(np.searchsorted(np.cumsum(size[j]), 1 << 20)))]
            for k in some[_similar(sets[i], [sets[k] for k in some])].tolist():
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    out.append((int(i), k))
            j = j[len(some) :]
            j = j[root[j] != root[i]]
    return out


def _in_groups(pairs_of, key: str):
    """Runs ``pairs_of(rows)`` over the rows of each ``key``, which come together, sorted by ``key, node``; a node may come several times."""

    def linked(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        node = rows.column("node").to_numpy()
        new = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        if len(new) < 2:
            return None
        pairs = pairs_of(rows.take(pa.array(new)))
        if not pairs:
            return None
        node = node[new]
        a, b = (node[[p[s] for p in pairs]] for s in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            group = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and at != group[a]:
                    if (made := linked(held)) is not None:
                        yield made
                    held = []
                held.append(batch.slice(a, b - a))
                at = group[a]
        if held and (made := linked(held)) is not None:
            yield made

    return run


def _bytes(rows: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), np.uint8).reshape(len(rows), -1)


def _tiles(rows: pa.Table):
    return rows.column("tile").to_numpy() if rows.column("cross")[0].as_py() else None


def _region_pairs(rows: pa.Table):
    return spanning(_bytes(rows, "signature"), rows.column("size").to_numpy(), rows.column("part").to_numpy(), _tiles(rows))


def _family_pairs(rows: pa.Table):
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    return verified(_bytes(rows, "signature"), sets, rows.column("part").to_numpy(), _tiles(rows))


def _verify(batches):
    """The pairs whose sets are similar enough."""
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("a", "b"))
        keep = [bool(_similar(x, [y])[0]) for x, y in zip(a, b, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _dealt(rows: DataFrame, group: str, tiles) -> DataFrame:
    """``rows`` with a ``bucket`` for each pair of tiles that a row takes part in; ``tiles`` is the number of its group's."""
    tile = F.pmod(F.xxhash64("node", F.lit(5)), F.col("_tiles")).cast("int")
    pair = lambda t: F.struct(F.xxhash64(F.col(group), F.least(t, F.col("tile")), F.greatest(t, F.col("tile"))).alias("bucket"), (t != F.col("tile")).alias("cross"))
    placed = rows.withColumn("_tiles", tiles).withColumn("tile", tile)
    return placed.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), pair))).select(*rows.columns, "tile", "_p.bucket", "_p.cross")


def regions(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """``region, node, n``: the runs of two nodes or more of every order, each set of nodes once; written."""
    label = F.expr(f"transform(sequence(0, {ORDERS - 1}), i -> struct(xxhash64(i, substring(signature, {DEEP} * i + 1, {SHALLOW})) as high, xxhash64(i, substring(signature, {DEEP} * i + 1, {DEEP}), 1) as low))")
    keyed = nodes.select("node", F.explode(label).alias("l")).select("node", "l.high", "l.low")
    high = materialize(keyed.groupBy("high").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n")))
    members = materialize(join_one(keyed, high, "high", "rows", "inner"))
    crowded = members.filter(F.col("n") > dense)
    low = materialize(crowded.groupBy("low").agg(F.count("*").alias("n")).filter("n > 1").withColumn("rows", F.col("n")))
    shallow = members.filter(F.col("n") <= dense).select(F.col("high").alias("region"), "node", "n")
    deep = join_one(crowded.select("low", "node"), low, "low", "rows", "inner").select(F.col("low").alias("region"), "node", "n")
    both = materialize(shallow.unionByName(deep))
    same = both.groupBy("region").agg(F.first("n").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("s"))
    once = materialize(same.groupBy("n", "x", "s").agg(F.min("region").alias("region")).select("region", F.col("n").alias("rows")))
    return materialize(join_one(both, once, "region", "rows", "inner"))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, dense: int = DENSE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, d1, d2, size`` of every row, and ``d1, d2, copies, least, root`` of every set: its rows, their least id and its component's name."""
    spark = docs.sparkSession
    read = docs.select("doc_id", "text").withColumns({"row": F.monotonically_increasing_id(), "hash": F.xxhash64("text")})
    described = materialize(map_texts(read, _described(shingle), T.StructType([docs.schema["doc_id"], *(T.StructField(*f) for f in _DESCRIBED)])))
    key = ["d1", "d2"]
    nodes = materialize(described.filter("d1 is not null").groupBy(*key).agg(F.min("row").alias("node"), F.min("hash").alias("hash"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("signature").alias("signature")))
    members = regions(nodes.select("node", "signature"), dense)
    active = materialize(members.select("node").distinct().join(nodes.select("node", "hash", *key, "size", "signature"), "node"))
    placed = small_or_shuffled(active.select("node", "size", "signature"))
    partitions = max(shuffle_partitions(spark), -(-members.count() // 200_000))

    def near(parts: DataFrame | None) -> DataFrame:
        """Near pairs that span the regions, or what is left of them."""
        rows = members if parts is None else members.join(small_or_shuffled(parts), "node", "left")
        rows = rows.withColumn("part", F.col("node") if parts is None else F.coalesce("part", "node"))
        if parts is not None:
            several = materialize(rows.groupBy("region").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.first("n").alias("rows")).filter("a != b").select("region", "rows"))
            rows = join_one(rows, several, "region", "rows", "inner")
        dealt = _dealt(rows, "region", F.ceil(F.col("n") / tile).cast("int")).join(placed, "node")
        dealt = dealt.select("bucket", "cross", "tile", "node", "part", "size", "signature").repartition(partitions, "bucket").sortWithinPartitions("bucket", "node")
        return materialize(dealt.mapInArrow(_in_groups(_region_pairs, "bucket"), "u long, v long").distinct())

    first = near(None)
    asked = small_or_shuffled(active.select("node", "hash", *key))
    touched = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(asked.join(touched, "node"))
    # a set is made again from a text that had it; the digest says that it is the one
    texts = docs.select("text").withColumn("hash", F.xxhash64("text")).join(small_or_shuffled(wanted.select("hash").distinct()), "hash", "left_semi").select("text")
    found = map_texts(texts, _sets(shingle), "d1 long, d2 long, shingles binary").join(small_or_shuffled(wanted.select("node", *key)), key)
    sets = materialize(found.groupBy("node").agg(F.first("shingles").alias("shingles")))
    side = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name))
    links = materialize(map_texts(first.join(side("v", "b"), "v").join(side("u", "a"), "u"), _verify, "u long, v long", "a"))
    joined = components(links)
    parts = materialize(joined.select(F.col("u").alias("node"), F.col("v").alias("part")))

    families = components(near(parts))
    family = families.select(F.col("u").alias("node"), F.col("v").alias("family")).unionByName(families.select(F.col("v").alias("node"), F.col("v").alias("family")).distinct())
    kin = materialize(family.join(small_or_shuffled(active.select("node", "size")), "node").join(small_or_shuffled(parts), "node", "left").withColumn("part", F.coalesce("part", "node")))
    many = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    weight = materialize(kin.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes")).select("family", F.col("n").alias("rows"), many.alias("tiles")))
    sent = kin.agg(F.coalesce(F.sum(F.col("size") * 8), F.lit(0)).alias("bytes")).first().bytes
    rows = _dealt(join_one(kin, weight, "family", "rows", "inner"), "family", F.col("tiles"))
    dealt = rows.join(placed.select("node", "signature"), "node").join(sets, "node").select("bucket", "cross", "tile", "node", "part", "signature", "shingles")
    dealt = dealt.repartition(max(shuffle_partitions(spark), -(-sent // TASK_BYTES)), "bucket").sortWithinPartitions("bucket", "node")
    rest = map_texts(dealt, _in_groups(_family_pairs, "bucket"), "u long, v long", "shingles")
    whole = components(joined.unionByName(materialize(rest)))
    rooted = nodes.join(small_or_shuffled(whole.select(F.col("u").alias("node"), F.col("v").alias("root"))), "node", "left").select(*key, "copies", "least", F.coalesce("root", "node").alias("root"))
    return described.select("doc_id", *key, "size"), materialize(rooted)


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    rows, rooted = similar_groups(docs, shingle)
    # a component or a set may hold most rows: both joins spread such keys
    several = materialize(rooted.groupBy("root").agg(F.min("least").alias("smallest"), F.count("*").alias("members")).filter("members > 1"))
    named = materialize(join_one(rooted, several, "root", "members").select("d1", "d2", "copies", F.coalesce("smallest", "least").alias("component_id")))
    linked = join_one(rows.filter("d1 is not null"), named, ["d1", "d2"], "copies", "inner").select("doc_id", "size", "component_id")
    every = linked.unionByName(rows.filter("d1 is null").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
