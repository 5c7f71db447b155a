"""Budgeted splitting of markup on intervals: the pieces of :func:`tessera.operators.xmljson.chunks` without a tree and without a fold.

Sizes are differences of places. An element is *split* if it exceeds the budget and has children: then all elements around it
exceed it too, so no level waits for another. The children of a split element, each with the text that follows it, are its
items; one that is too big alone stands apart and parts the others into *runs*. In a run the next start after each item is the first
that no longer fits, found by a search in the running sum, and the starts are what the first item reaches,
found by doubling the steps. So an element with millions of children is spread over tasks in every step.

Defined results: a document that isn't well-formed has no pieces; one without a unit is one piece; texts beside children stay with
the child before them; sizes are code points of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.tables import written

from .elements import BLOCK, elements, inside, parsed, running


def reached(steps: DataFrame, keys: list[str], first: DataFrame) -> DataFrame:
    """The items (``keys``, ``item``) that ``first`` reaches by ``next``: ``steps`` has ``keys, item, next``, null at the end.

    Each round doubles the length of a step, so their number is the logarithm of the longest chain.
    """
    got, hop = first.select(*keys, "item"), written(steps.select(*keys, "item", "next").filter("next is not null"))
    while True:
        more = got.join(hop, [*keys, "item"]).select(*keys, F.col("next").alias("item"))
        got = written(got.unionByName(more).distinct())
        ahead = hop.select(*keys, F.col("item").alias("next"), F.col("next").alias("_next"))
        hop = written(hop.join(ahead, [*keys, "next"]).select(*keys, "item", F.col("_next").alias("next")))
        if hop.isEmpty():
            return got


def packed(items: DataFrame, keys: list[str], order: str, size: str, room: str, block: int = BLOCK) -> DataFrame:
    """``items`` with ``start``: as many as fit into ``room`` one after the other, an item that doesn't fit alone by itself; ``order`` of each group's first."""
    summed = written(running(items, keys, order, {"_end": (F.sum, F.col(size))}, block=block))
    ends = summed.select(*keys, (F.col("_end") * 2).alias("_at"), F.col(order).alias("_item"), F.lit(None).cast("long").alias("item"))
    asked = summed.select(*keys, ((F.col("_end") - F.col(size) + F.greatest(F.col(room), F.col(size))) * 2 + 1).alias("_at"), F.lit(None).cast("long").alias("_item"), F.col(order).alias("item"))
    # the first item that ends beyond the room; one of size 0 at the very end of the room still fits
    steps = running(ends.unionByName(asked), keys, "_at", {"next": (F.min, F.col("_item"))}, backwards=True, block=block).filter("item is not null")
    first = summed.groupBy(*keys).agg(F.min(order).alias("item"))
    starts = reached(steps, keys, first).withColumn("_start", F.col("item"))
    marked = summed.join(starts.withColumnRenamed("item", order), [*keys, order], "left").drop("_end")
    return running(marked, keys, order, {"start": (F.max, F.col("_start"))}, block=block).drop("_start")


def _kept(own: DataFrame, block: int) -> DataFrame:
    """Elements to which the way from the root leads: none on it, nor they themselves, are ``barred``."""
    steps = own.select("key", "pos", F.col("barred").cast("int").alias("by")).unionByName(own.select("key", F.col("end_pos").alias("pos"), -F.col("barred").cast("int")).toDF("key", "pos", "by"))
    total = running(steps.groupBy("key", "pos").agg(F.sum("by").alias("by")), ["key"], "pos", {"bars": (F.sum, F.col("by"))}, block=block)
    return own.join(total.filter("bars = 0").select("key", "pos"), ["key", "pos"], "left_semi").filter("not barred")


def pieces(df: DataFrame, key: str, text: str, budget: int, units: list[str] | None = None, html: bool = False, block: int = BLOCK) -> DataFrame:
    """``key, seq, piece, path``: well-formed pieces within the budget, in document order; ``path`` are the tags around the piece's element.

    With ``units`` pieces are elements of these tags and what is gathered inside them; an element of another tag is only looked into.
    """
    whole = parsed(df, key, text, html, block)
    own = elements(whole)
    unit: Column = F.col("tag").isin(*units) if units else F.lit(True)
    inner = own.groupBy("key", F.col("parent").alias("pos")).agg(F.min("begin").alias("first"), F.count("*").alias("children"))
    own = own.join(inner, ["key", "pos"], "left").withColumns({"children": F.coalesce("children", F.lit(0)), "unit": unit})
    own = written(own.withColumn("split", (F.col("end") - F.col("begin") > budget) & (F.col("children") > 0)))
    # where the next sibling begins, or the parent's end tag
    above = own.select("key", F.col("pos").alias("parent"), F.col("unit").alias("p_unit"), F.col("split").alias("p_split"), F.col("closing").alias("p_closing"), (F.lit(budget) - F.col("opened") + F.col("begin") - F.col("end") + F.col("closing")).alias("room"))
    follows = running(own.filter("parent is not null").select("key", "parent", "pos", "begin"), ["key", "parent"], "pos", {"_n": (F.sum, F.lit(1))}, block=block)
    after = follows.select("key", "parent", (F.col("_n") - 1).alias("_n"), F.col("begin").alias("next"))
    follows = follows.join(after, ["key", "parent", "_n"], "left").select("key", "pos", "next")
    placed = own.join(above, ["key", "parent"], "left").join(follows, ["key", "pos"], "left").withColumn("next", F.coalesce("next", "p_closing"))
    need = F.col("next") - F.col("begin")
    alone = (need > F.col("room")) & ((need > budget) | (F.col("children") > 0))
    placed = placed.withColumn("alone", F.coalesce(alone, F.lit(False)))
    barred = F.col("parent").isNotNull() & F.col("p_unit") & ~(F.col("p_split") & F.col("alone"))
    placed = written(placed.withColumn("barred", F.coalesce(barred, F.lit(False))))
    entered = written(_kept(placed, block).select("key", "pos", "tag", "level", "begin", "opened", "closing", "end", "end_pos", "unit", "split"))
    single = entered.filter("unit and not split").select("key", F.col("pos").alias("element"), F.col("begin").alias("a"), F.col("end").alias("b"), F.lit(False).alias("shell"))

    shells = entered.filter("unit and split")
    kids = placed.join(shells.select("key", F.col("pos").alias("parent")), ["key", "parent"], "left_semi")
    lead = shells.join(inner, ["key", "pos"]).filter("first > opened").select("key", F.col("pos").alias("parent"), F.col("pos").alias("at"), F.col("opened").alias("a"), F.col("first").alias("b"), F.lit(False).alias("apart"))
    gathered = kids.filter("not alone").select("key", "parent", F.col("pos").alias("at"), F.col("begin").alias("a"), F.col("next").alias("b"), F.lit(False).alias("apart"))
    beside = kids.filter("alone").select("key", "parent", F.col("pos").alias("at"), F.col("end").alias("a"), F.col("next").alias("b"), F.lit(True).alias("apart"))
    items = running(lead.unionByName(gathered).unionByName(beside), ["key", "parent"], "at", {"run": (F.sum, F.col("apart").cast("int"))}, block=block).filter("b > a")
    items = items.join(above.select("key", "parent", "room"), ["key", "parent"]).withColumns({"size": F.col("b") - F.col("a"), "at": F.col("at").cast("long")})
    groups = packed(items, ["key", "parent", "run"], "at", "size", "room", block).groupBy("key", F.col("parent").alias("element"), "run", "start").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cut = written(single.unionByName(groups.select("key", "element", "a", "b", F.lit(True).alias("shell"))))
    none = whole.filter("level = 1 and tag is not null").join(cut.select("key").distinct(), "key", "left_anti").select("key", F.col("pos").alias("element"), F.col("begin").alias("a"), F.col("end").alias("b"), F.lit(False).alias("shell"))
    cut = cut.unionByName(none)

    around = inside(own.select("key", "pos", "end_pos", "level", "tag"), cut.select("key", F.col("element").alias("pos")).distinct().join(own.select("key", "pos", "level"), ["key", "pos"]))
    tags = around.join(own.select("key", F.col("pos").alias("ancestor"), "tag"), ["key", "ancestor"]).groupBy("key", F.col("descendant").alias("element")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("ancestor", "tag")))["tag"], "/").alias("path"))
    named = cut.join(own.select("key", F.col("pos").alias("element"), "begin", "opened", "closing", "end"), ["key", "element"]).join(tags, ["key", "element"], "left")
    source = df.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    part = lambda a, b: F.expr(f"substring(_text, {a} + 1, {b} - {a})")
    made = F.when(F.col("shell"), F.concat(part("begin", "opened"), part("a", "b"), part("closing", "end"))).otherwise(part("a", "b"))
    numbered = running(named, ["key"], "a", {"seq": (F.sum, F.lit(1))}, block=block)
    return numbered.join(source, "key").select("key", F.col("seq").cast("long").alias("seq"), made.alias("piece"), F.coalesce("path", F.lit("")).alias("path"))
