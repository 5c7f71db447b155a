"""Deep merge of JSON fragments path by path, without gathering a document's fragments anywhere.

Fragments are taken apart level by level: what a document's fragments have at one path is a *slot*. The objects that lead in a
slot are exploded into the slots of their members, all documents at once; what is left in a slot - a single value, or what makes a
list - waits. Then slots are put together, the deepest first, in blocks, so that a path with very many values is spread over tasks.

The merge is that of :func:`tessera.operators.xmljson.combined`: objects by key, lists one after the other, what else meets in a
list, equal attributes (``@name``) once unless ``legacy``. The order of members is left open.

Defined results: a fragment that doesn't parse is passed over, as is one with a key twice; a document whose fragments all are is ``{}``;
a single list stands for its items; ``order`` must be a whole number that is unique in a document; null is a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import written

from .elements import quoted

#: Values that are joined in one step.
BLOCK = 10_000
#: Slots whose state is broadcast.
BROADCAST_SLOTS = 200_000
_SEPARATOR = "\x01"


def _kind(value: str):
    return F.substring(F.schema_of_variant(value), 1, 6)


def _exploded(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``_pos, _key, _value`` of each member or item."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(value).outer()).toDF("_pos", "_key", "_value"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SLOTS else df


def _first(fragments: DataFrame) -> DataFrame:
    """``key, path, ord, value`` of the whole fragments; a single list gives its items."""
    rows = fragments.select("key", F.lit("").alias("path"), F.col("ord").cast("long").alias("ord"), F.try_parse_json("text").alias("value")).filter("value is not null")
    rows = written(rows.withColumn("kind", _kind("value")))
    alone = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("kind").alias("k")).filter("n = 1 and k like 'ARRAY%'").select("key"))
    several = rows.join(_small(alone), "key", "left_anti")
    items = _exploded(rows.join(_small(alone), "key", "left_semi"), "value").select("key", "path", F.col("_pos").cast("long").alias("ord"), F.col("_value").alias("value"))
    return several.unionByName(items.withColumn("kind", _kind("value")))


def merged(fragments: DataFrame, legacy: bool = False, block: int = BLOCK) -> DataFrame:
    """``key, json``: the fragments (``key, ord, text``) of each key as one document."""
    slot = ["key", "path"]
    now, levels = written(_first(fragments)), []
    while not now.isEmpty():
        held = F.when(F.col("kind") != "OBJECT", F.col("ord"))
        attribute = F.element_at(F.split("path", _SEPARATOR), -1).startswith("@") & F.lit(not legacy)
        text = F.when(attribute, F.to_json("value"))
        stats = now.groupBy(*slot).agg(F.count("*").alias("n"), F.min(held).alias("stop"), F.min("ord").alias("one"), F.coalesce(F.min(text) == F.max(text), F.lit(False)).alias("same"))
        now = now.join(_small(written(stats)), slot).filter("not same or ord = one").withColumn("n", F.when(F.col("same"), 1).otherwise(F.col("n")))
        lead = (F.col("n") > 1) & (F.col("kind") == "OBJECT") & (F.col("stop").isNull() | (F.col("ord") < F.col("stop")))
        marked = written(now.withColumn("lead", lead))
        leads = marked.filter("lead").groupBy(*slot).agg(F.count("*").alias("leads"))
        marked = written(marked.join(_small(written(leads)), slot, "left").withColumn("lead", F.coalesce(F.col("lead") & (F.col("leads") > 1), F.lit(False))).select(*slot, "ord", "value", "kind", "n", "lead"))
        levels.append(marked)
        inner = _exploded(marked.filter("lead"), "value").filter("_key is not null")
        now = written(inner.select("key", F.concat("path", F.lit(_SEPARATOR), "_key").alias("path"), "ord", F.col("_value").alias("value")).withColumn("kind", _kind("value")))
    made = None
    for marked in reversed(levels):
        # what waits in a slot, its lists without their brackets; the merged object comes where its first part stood
        text = F.when((F.col("n") > 1) & (F.col("kind") == "ARRAY<"), F.expr("substring(to_json(value), 2, length(to_json(value)) - 2)")).otherwise(F.to_json("value"))
        waiting = marked.filter("not lead").select(*slot, "ord", (F.col("n") == 1).alias("single"), text.alias("text"))
        starts = marked.filter("lead").groupBy(*slot).agg(F.min("ord").alias("ord"), (F.count("*") == F.max("n")).alias("single"))
        if made is not None:
            parent = F.regexp_replace("path", f"{_SEPARATOR}[^{_SEPARATOR}]*$", "")
            members = made.select("key", parent.alias("path"), F.element_at(F.split("path", _SEPARATOR), -1).alias("name"), "text")
            members = members.withColumn("text", F.concat(quoted(F.col("name")), F.lit(":"), "text")).withColumn("ord", F.xxhash64("name"))
            objects = _joined(members, [*slot], "name", block, F.pmod("ord", F.lit(64)))
            starts = starts.join(objects, slot, "left").withColumn("text", F.concat(F.lit("{"), F.coalesce("text", F.lit("")), F.lit("}")))
        else:
            starts = starts.withColumn("text", F.lit("{}"))
        every = waiting.unionByName(starts.select(*slot, "ord", "single", "text"))
        single = every.filter("single").select(*slot, "text")
        lists = _joined(every.filter("not single and text != ''"), slot, "ord", block, F.floor(F.col("ord") / block))
        empty = every.filter("not single").select(*slot).distinct().join(lists, slot, "left").select(*slot, F.concat(F.lit("["), F.coalesce("text", F.lit("")), F.lit("]")).alias("text"))
        made = written(single.unionByName(empty))
    keys = fragments.select("key").distinct()
    if made is None:
        return keys.select("key", F.lit("{}").alias("json"))
    return keys.join(made.select(F.col("key").alias("_key"), "text"), F.col("key").eqNullSafe(F.col("_key")), "left").select("key", F.coalesce("text", F.lit("{}")).alias("json"))


def _joined(rows: DataFrame, keys: list[str], order: str, block: int, part) -> DataFrame:
    """``keys, text``: the texts of a group in order, joined by commas in two steps. Names are sorted within parts that their hash picks: an object has no order."""
    inner = rows.withColumn("_part", part).groupBy(*keys, "_part").agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, "text")))["text"], ",").alias("text"))
    return inner.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_part", "text")))["text"], ",").alias("text"))
