"""Sharding by sampled splitters: near-equal bytes in contiguous key ranges.

1. A light table (key, size, digest; no text) is written once.
2. Keys are sampled with a chance in proportion to their size, by hash, and
   equal keys are counted, not listed: a key that a third of the rows have is one
   sample with a large weight. Weighted quantiles of the sample are the splitters:
   on the driver those of ``COARSE`` ranges at most, from a sample whose size follows the number of
   ranges, not the input; inside each of these, by a window over a finer
   sample, those of as many ranges as its rows make necessary.
3. Records go to ranges by binary search in the splitters. Ranges are counted
   exactly; one with more than ``overfull`` times the intended rows is subdivided
   by a spread of its rows, so that no task ever sorts more than its share.
4. Running sums inside the ranges, and over the ranges in two levels, give each
   record its exact place in the whole order, so its shard (by bytes) and its slot.

Everything is a DataFrame expression. Defined results: a null text has no bytes
(its size is 8) and the digest of an empty one; null keys come first; equal keys
and repeated rows are dealt in the order of the written table; an empty table gives
an empty result; other columns are ignored. Rows are dealt one by one: equal texts may
lie in different shards, as the law of near-equal bytes asks no more of them than of others.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize, small_or_shuffled

SHARDS = 24
#: Rows meant for a range; ranges follow the input.
RANGE_ROWS = 200_000
#: Ranges for each shard at least.
LEAST_RANGES = 4
#: Ranges whose splitters the driver chooses, at most.
COARSE = 1024
#: Samples for each range, on average.
OVERSAMPLE = 16
OVERFULL = 2.0
SEED = 11


def _sample(light: DataFrame, total: int, ranges: int, *kept: str) -> DataFrame:
    """About ``ranges * OVERSAMPLE`` keys, drawn in proportion to their rows' sizes, with their weights."""
    chance = F.col("size") * F.lit(ranges * OVERSAMPLE / max(total, 1))
    draw = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return light.filter(F.col("key").isNotNull() & (draw < chance)).groupBy(*kept, "key").agg(F.sum(F.greatest(chance, F.lit(1.0))).alias("weight"))


def splitters(light: DataFrame, total: int, ranges: int) -> list[int]:
    """Weighted quantiles of a size-weighted key sample of about ``ranges * OVERSAMPLE`` keys."""
    got = sorted((r.key, r.weight) for r in _sample(light, total, ranges).collect())
    whole, seen, out = sum(w for _, w in got), 0.0, []
    for key, weight in got:
        if seen >= whole * (len(out) + 1) / ranges:
            out.append(key)
        seen += weight
    return out


def finer_splitters(placed: DataFrame, total: int, ranges: int, most: int) -> DataFrame:
    """``range, bounds``: splitters inside each range of over ``most`` rows, by windows over a finer sample."""
    parts = placed.groupBy("range").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("range", F.ceil(F.col("n") / most).alias("parts"))
    by_key = Window.partitionBy("range").orderBy("key")
    seen = F.coalesce(F.sum("weight").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("weight").over(Window.partitionBy("range"))
    sampled = _sample(placed, total, ranges, "range").join(F.broadcast(parts), "range")  # one row a coarse range
    bucket = sampled.withColumn("bucket", F.floor(seen * F.col("parts") / whole)).groupBy("range", "bucket").agg(F.min("key").alias("key")).filter("bucket > 0")
    return bucket.groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("bounds"))


def _search(table: Column, longest: int, key: Column) -> Column:
    """How many of the ascending ``table`` are at most ``key``: binary search; null goes first."""
    step, steps = 1 << max(longest.bit_length() - 1, 0), []
    while step and longest:
        steps.append(F.lit(step))
        step >>= 1
    if not steps:
        return F.lit(0)
    found = F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when((at + s <= F.size(table)) & (F.get(table, at + s - 1) <= key), at + s).otherwise(at))
    return F.when(key.isNull() | table.isNull(), 0).otherwise(found)


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", range_rows: int = RANGE_ROWS, overfull: float = OVERFULL, coarse: int = COARSE) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; ``key`` is an integer column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = materialize(docs.select("doc_id", F.col(key).cast("long").alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("spread")))
    stats = light.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = max(LEAST_RANGES * shards, -(-stats.rows // range_rows))
    few = min(coarse, ranges)
    bounds = splitters(light, stats.bytes, few)
    placed = light.withColumn("range", _search(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), len(bounds), F.col("key")))
    most = max(1, int(overfull * max(stats.rows / ranges, 1)))
    if few < ranges:
        finer = materialize(finer_splitters(placed, stats.bytes, ranges, most))
        longest = finer.agg(F.coalesce(F.max(F.size("bounds")), F.lit(0))).first()[0]
        placed = placed.join(F.broadcast(finer), "range", "left").withColumn("part", _search(F.col("bounds"), longest, F.col("key"))).drop("bounds")  # one row a coarse range, a number for range_rows rows
    else:
        placed = placed.withColumn("part", F.lit(0))
    cuts = materialize(placed.groupBy("range", "part").agg(F.count("*").alias("n")).select("range", "part", F.ceil(F.col("n") / most).cast("int").alias("pieces")))
    placed = placed.join(small_or_shuffled(cuts), ["range", "part"]).withColumn("piece", F.pmod(F.xxhash64("spread"), F.col("pieces")).cast("int"))
    counts = materialize(placed.groupBy("range", "part", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("b")))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over the coarse ranges
    total = counts.groupBy("range").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    total = total.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"))
    within = Window.partitionBy("range").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(F.broadcast(total), "range").select("range", "part", "piece", (F.col("n0") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("rows_before"), (F.col("b0") + F.coalesce(F.sum("b").over(within), F.lit(0))).alias("bytes_before"))
    inside = Window.partitionBy("range", "part", "piece").orderBy("key", "spread")
    middle = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    ranked = materialize(
        placed.join(small_or_shuffled(materialize(before)), ["range", "part", "piece"]).select(
            "doc_id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(stats.bytes, 1))))).cast("int").alias("shard"),
            (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
        )
    )
    first = ranked.groupBy("shard").agg(F.min("place").alias("first"))
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))  # one row a shard


def _free(name: str, columns: list[str]) -> str:
    while name in map(str.lower, columns):
        name += "_"
    return name


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet under ``shard=N`` folders, in slot order (``shard_=N`` if there is a column ``shard``).

    Rows alike in id, size and digest - copies under one id, or without one - are dealt to the places of
    their like in any order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = {k: _free(f"_{k}", docs.columns) for k in ("size", "crc", "like", "slot")}
    folder = _free("shard", docs.columns)
    own = docs.withColumn(names["size"], (F.octet_length(text) + 8).cast("long")).withColumn(names["crc"], F.crc32(F.encode(text, "UTF-8")))
    own = own.withColumn(names["like"], F.row_number().over(Window.partitionBy("doc_id", names["size"], names["crc"]).orderBy(F.lit(0))))
    places = shard(docs, shards).withColumn("like", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("shard", "slot")))
    places = places.select(F.col("doc_id").alias("p_id"), F.col("size").alias("p_size"), F.col("text_crc32").alias("p_crc"), F.col("like").alias("p_like"), F.col("shard").alias(folder), F.col("slot").alias(names["slot"]))
    same = own["doc_id"].eqNullSafe(places["p_id"]) & (own[names["size"]] == places["p_size"]) & (own[names["crc"]] == places["p_crc"]) & (own[names["like"]] == places["p_like"])
    joined = own.join(places, same).select(*(own[c] for c in docs.columns), places[folder], places[names["slot"]])
    joined.repartitionByRange(folder, names["slot"]).sortWithinPartitions(folder, names["slot"]).drop(names["slot"]).write.partitionBy(folder).parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
