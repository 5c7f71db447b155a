"""The first rows of many groups at once, by counts instead of sorts; and an order that is a permutation, without a sort.

:func:`first_rows` narrows the key's range in all groups together: one pass counts the rows of each group by the next
``DIGITS`` bits of the key, and the bucket that holds the group's last wanted row is what the next pass counts.
It ends when these buckets are small: only their rows are ranked. Ids up to some billions take one pass or two.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.tables import written

#: Bits of the key that one pass counts by.
DIGITS = 12
#: Rows of a group's last bucket that are ranked.
RANKED = 100_000
#: Groups whose state is broadcast (some 60 bytes each).
BROADCAST_GROUPS = 500_000


def _shifted(key: str, bits: str) -> Column:
    return F.expr(f"shiftright({key}, {bits})")  # of a signed number: the order stays


def _narrowed(rows: DataFrame, state: DataFrame, key: str, ranked: int) -> DataFrame:
    """``state`` (_g, _left, _n) with ``_bits, _at``: the last wanted row of a group is among those whose key without its lowest ``_bits`` is ``_at``.

    ``_left`` rows of them are wanted, of ``_n``. ``rows`` has ``_g`` and the key.
    """
    small = F.broadcast if state.count() <= BROADCAST_GROUPS else lambda df: df
    seen = rows.join(small(state.select("_g")), "_g").groupBy("_g").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    width = F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi"))))  # bits in which keys of the group differ, at least 1
    state = written(state.join(seen, "_g").select("_g", "_left", "_n", F.least(width, F.lit(63)).cast("int").alias("_bits"), F.lit(None).cast("long").alias("_at")))
    while True:
        open_ones = state.filter((F.col("_bits") > 0) & ((F.col("_n") > ranked) | F.col("_at").isNull()))
        if open_ones.isEmpty():
            return state
        held = rows.join(small(open_ones.withColumn("_next", F.greatest(F.lit(0), F.col("_bits") - DIGITS))), "_g").filter(F.col("_at").isNull() | (_shifted(key, "_bits") == F.col("_at")))
        counts = held.groupBy("_g", _shifted(key, "_next").alias("_b")).agg(F.count("*").alias("_c"), F.first("_next").alias("_next"), F.first("_left").alias("_left"))
        until = F.sum("_c").over(Window.partitionBy("_g").orderBy("_b"))  # at most 2 ** DIGITS rows a group, or as many as it has keys
        last = counts.withColumn("_until", until).filter((F.col("_until") >= F.col("_left")) & (F.col("_until") - F.col("_c") < F.col("_left")))
        last = last.select("_g", (F.col("_left") - F.col("_until") + F.col("_c")).alias("_left"), F.col("_c").alias("_n"), F.col("_next").alias("_bits"), F.col("_b").alias("_at"))
        settled = state.join(open_ones.select("_g"), "_g", "left_anti")
        state = written(settled.unionByName(last))


def first_rows(df: DataFrame, group: Column, wanted: DataFrame, key: Column, ties: list[Column], name: str = "selected", ranked: int = RANKED) -> DataFrame:
    """``df`` with the boolean ``name``: is the row among the first of its group, by ``key`` (a whole number), then ``ties``, then a hash of the row?

    ``wanted`` has ``_g`` and ``_want``, the number of rows of each group; a group that isn't there has none.
    Each group gets exactly its number, or all its rows if there are fewer, however often keys and rows repeat.
    """
    plain = [F.col(f.name) if not isinstance(f.dataType, (T.MapType, T.VariantType)) else F.to_json(f.name) for f in df.schema.fields]
    rows = df.withColumns({"_g": group, "_k": key.cast("long"), "_h": F.xxhash64(*plain)})
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n")).join(wanted, "_g").filter("_want > 0")
    sizes = written(sizes.select("_g", F.col("_want").cast("long").alias("_want"), "_n"))
    small = F.broadcast if sizes.count() <= BROADCAST_GROUPS else lambda df: df
    whole, partly = sizes.filter("_want >= _n").select("_g", F.lit(True).alias("_whole")), sizes.filter("_want < _n").select("_g", F.col("_want").alias("_left"), "_n")
    state = _narrowed(rows.select("_g", "_k"), partly, "_k", ranked)
    marked = rows.join(small(whole), "_g", "left").join(small(state.select("_g", "_left", "_bits", "_at")), "_g", "left")
    bucket = _shifted("_k", "_bits")
    place = F.when(F.col("_whole"), -1).when(F.col("_at").isNull(), 1).when(bucket < F.col("_at"), -1).when(bucket > F.col("_at"), 1).otherwise(0)
    marked = marked.withColumn("_place", place)
    inside = marked.filter("_place = 0").withColumn(name, F.row_number().over(Window.partitionBy("_g").orderBy("_k", *ties, "_h")) <= F.col("_left"))
    out = marked.filter("_place != 0").withColumn(name, F.col("_place") < 0).unionByName(inside)
    return out.drop("_g", "_k", "_h", "_whole", "_left", "_bits", "_at", "_place")


# ---- an order without a sort

def numbered(df: DataFrame, order: list[str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """``df`` with dense numbers from 0 in ``order``, in two levels: ranges of rows, then places in a range. No task gets more than a range."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_c"))  # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place - 1).drop("_part", "_before")


#: Rounds of the permutation's network.
ROUNDS = 6


def permuted(number: Column, count: int, seed: int) -> Column:
    """The place of ``number`` (0 to ``count - 1``) in a permutation that the seed picks: a balanced Feistel network over the next even number of bits, walked until it is inside.

    A number is outside with a chance of under three in four, so that the walk is short; as the network is a bijection, so is the walk's end.
    """
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    mixed = lambda x, i: F.xxhash64(x, F.lit(seed), F.lit(i)).bitwiseAND(low)

    def once(x: Column) -> Column:
        pair = F.struct(F.shiftright(x, half).alias("l"), x.bitwiseAND(low).alias("r"))
        swap = lambda p, i: F.struct(p["r"].alias("l"), p["l"].bitwiseXOR(mixed(p["r"], i)).alias("r"))
        got = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, swap)
        return F.shiftleft(got["l"], half).bitwiseOR(got["r"])

    # with over a quarter of the numbers inside, 128 steps miss one in 10**16 even at the least; what is then still outside is an error
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(128)), once(number.cast("long")), lambda x, _: F.when(x < count, x).otherwise(once(x)))
    return F.when(walk < count, walk).otherwise(F.raise_error(F.lit("the permutation's walk didn't end")).cast("long"))


def shuffled(df: DataFrame, key: str, seed: int = 42, blocks: str | None = None, first: list | None = None) -> DataFrame:
    """``df`` with ``place``: a random order that depends on the keys and the seed alone, whatever the partitions. ``key`` must be unique.

    With ``blocks`` the rows of each block stay together: blocks come in the order of ``first``, and those it doesn't name in a random one.
    """
    total = df.count()
    if blocks is None:
        return numbered(df, [key]).withColumn("place", permuted(F.col("number"), total, seed)).drop("number")
    rank = {b: i for i, b in enumerate(first or [])}
    sizes = sorted(((r[0], r[1]) for r in df.groupBy(blocks).agg(F.count("*")).collect()), key=lambda b: (rank.get(b[0], len(rank)), hash_of(seed, b[0])))  # one row a block
    before, parts = 0, F.lit(None).cast("long")
    within = numbered(df.withColumn("_block", F.coalesce(F.col(blocks).cast("string"), F.lit(""))), ["_block", key]).drop("_block")
    starts, at = {}, 0
    for b, n in sorted(sizes, key=lambda b: "" if b[0] is None else str(b[0])):
        starts[b], at = at, at + n
    for b, n in sizes:
        own = permuted(F.col("number") - starts[b], n, seed + 1) + before
        parts = F.when(F.col(blocks).eqNullSafe(F.lit(b)), own).otherwise(parts)
        before += n
    return within.withColumn("place", parts).drop("number")


def hash_of(seed: int, value) -> int:
    """A number that orders blocks at random."""
    return zlib.crc32(f"{seed}-{value}".encode())
