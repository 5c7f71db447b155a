"""Connected components of a table of links, without a driver-side graph.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond"): each is an aggregated minimum and a join. Every step is
written to the shared folder, so the plan never grows and a lost executor
costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_one, materialize


def _with_least(links: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Every link with the least neighbour ``m`` of its ``u``, and ``u, m`` alone; a hub's links are spread over tasks."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if small:
        return links.join(F.broadcast(least.drop("n")), "u"), least
    least = materialize(least)
    return join_one(links, least, "u", "n", "inner"), least


def _large_star(links: DataFrame, small: bool) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, _ = _with_least(both, small)
    return joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame, small: bool) -> DataFrame:
    joined, least = _with_least(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``u, v`` for each linked node ``u`` that isn't its component's least node ``v``.

    ``links`` has long columns ``u`` and ``v`` without nulls; loops and repeated links do no harm.
    """
    now = materialize(links.select("u", "v").filter("u != v").distinct())
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state.n == 0 or tuple(state) == mark:
            return now
        mark = tuple(state)
        small = 2 * state.n <= BROADCAST_ROWS  # a node has a link, so there are at most twice as many nodes
        now = materialize(_small_star(_large_star(now, small), small))
