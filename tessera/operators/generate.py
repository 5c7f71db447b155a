"""Paired documents: deterministic, format-tagged XML with the JSON it stands for.

All draws come from an md5 of (seed, id, place), so any partitioning gives the same rows, and other engines
can follow. The names of a document are drawn once, in a projection of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import draw, draw_int, pick

from .formats import CLASSES, DIFFICULTY, EXPERIMENTS, FORMATS, LEVELS, Draw, names_of
from .markup import Node, cat, obj

SECOND = [f for f, x in FORMATS.items() if x.family == "second"]


def active_formats(asked: list[str] | None = None, exclude: list[str] = (), experiment: str | None = None) -> list[str]:
    """The formats to draw from; an unknown name or none left is an error."""
    names = asked if asked is not None else [f for part in EXPERIMENTS[experiment] for f in part] if experiment else SECOND
    unknown = sorted({*names, *exclude} - FORMATS.keys())
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    names = [f for f in dict.fromkeys(names) if f not in exclude]
    if not names:
        raise ValueError("no active format")
    return names


def allocation(total: int, easy: float = 0.3, medium: float = 0.4) -> dict[str, int]:
    """Rows by difficulty; what rounding leaves goes to hard."""
    a, b = int(total * easy), int(total * medium)
    return {"easy": a, "medium": b, "hard": total - a - b}


def _levelled(rows: DataFrame, table: str, seed: int, structured: bool, i: str = "ex_id", suffix: Column | None = None) -> DataFrame:
    """The draws that a document's size and names depend on, once for each row."""
    i = F.col(i)
    at = lambda k: F.coalesce(*(F.when(F.col("difficulty") == d, DIFFICULTY[table][d][k]) for d in LEVELS))
    between = lambda low, high, place: at(low) + draw_int(seed, at(high) - at(low) + 1, i, F.lit(place))
    return rows.withColumns({"_n": between(0, 1, "n"), "_sub": between(2, 3, "sub"), "_depth": at(4), "_option": at(5), "_names": names_of(seed, i, structured, suffix)})


def _drawn(seed: int, i: str = "ex_id", inner: Node | None = None, first: Column | None = None, last: Column | None = None) -> Draw:
    return Draw(seed, F.col(i), F.col("difficulty"), F.col("_n"), F.col("_sub"), F.col("_depth"), F.col("_option"), F.col("_names"), inner, first, last)


def _built(names: list[str], d: Draw, chosen: Column) -> Column:
    """``xml, tag, js, prolog`` of the chosen format: one struct a format."""
    made = []
    for f in names:
        root, prolog = FORMATS[f].build(d), FORMATS[f].prolog
        made.append(F.when(chosen == f, F.struct(root.xml.alias("xml"), cat(root.key).alias("tag"), root.js.alias("js"), cat(prolog(d) if prolog else "").alias("prolog"))))
    return F.coalesce(*made)


def _tags(names: list[str], chosen: Column) -> Column:
    return F.coalesce(*(F.when(chosen == f, F.array(*map(F.lit, FORMATS[f].tags))) for f in names))


def _pairs(rows: DataFrame, names: list[str], seed: int, structured: bool, table: str) -> DataFrame:
    made = _levelled(rows, table, seed, structured).withColumn("_made", _built(names, _drawn(seed), F.col("format_id")))
    question = F.concat("_made.prolog", "_made.xml")
    answer = cat('{"', F.col("_made.tag"), '":', F.col("_made.js"), "}")
    return made.select("ex_id", question.alias("question"), answer.alias("answer"), "format_id", _tags(names, F.col("format_id")).alias("tags"), "difficulty")


def generate(spark: SparkSession, total: int, formats: list[str] | None = None, seed: int = 42, curriculum: bool = False, exclude: list[str] = (), experiment: str | None = None, distribution: tuple[float, float] = (0.3, 0.4), structured: bool = True, table: str = "second") -> DataFrame:
    """``ex_id, question, answer, format_id, tags, difficulty``; ids follow difficulty, and with ``curriculum`` the order of rows is theirs, else a hash's (``shuffle_key``)."""
    names = active_formats(formats, exclude, experiment)
    n = allocation(total, *distribution)
    i = F.col("ex_id")
    level = F.when(i < n["easy"], "easy").when(i < n["easy"] + n["medium"], "medium").otherwise("hard")
    rows = spark.range(total).withColumnRenamed("id", "ex_id").withColumn("difficulty", level).withColumn("format_id", pick(names, seed, i, F.lit("format")))
    out = _pairs(rows, names, seed, structured, table)
    return out if curriculum else out.withColumn("shuffle_key", draw(seed, i))


def in_order(df: DataFrame, curriculum: bool = False) -> DataFrame:
    """The rows sorted: by difficulty and id, or by their shuffle key."""
    rank = F.coalesce(*(F.when(F.col("difficulty") == d, k) for k, d in enumerate(LEVELS)))
    return df.orderBy(rank, "ex_id") if curriculum else df.orderBy("shuffle_key", "ex_id")


def generate_by_class(spark: SparkSession, total: int, classes: dict[str, list[str]] = CLASSES, seed: int = 42, distribution: tuple[float, float] = (0.33, 0.34), structured: bool = True) -> DataFrame:
    """As :func:`generate`, with formats of their own for each difficulty, taken in turn."""
    n, i = allocation(total, *distribution), F.col("ex_id")
    starts = {"easy": 0, "medium": n["easy"], "hard": n["easy"] + n["medium"]}
    level = F.when(i < starts["medium"], "easy").when(i < starts["hard"], "medium").otherwise("hard")
    turn = lambda d: F.get(F.array(*map(F.lit, classes[d])), F.pmod(i - starts[d], F.lit(len(classes[d]))).cast("int"))
    rows = spark.range(total).withColumnRenamed("id", "ex_id").withColumn("difficulty", level)
    rows = rows.withColumn("format_id", F.coalesce(*(F.when(F.col("difficulty") == d, turn(d)) for d in LEVELS)))
    return _pairs(rows, active_formats([f for d in LEVELS for f in classes[d]]), seed, structured, "mixed")


#: Formats that may hold another document beside their own children; and those that can't stand inside one,
#: as namespaces, instructions and entities are declared on or before the root.
WRAPPERS = [f for f in SECOND if FORMATS[f].wraps and FORMATS[f].nests]
NOT_NESTED = [f for f in SECOND if not FORMATS[f].nests or f in ("DeeplyNested", "AttributePromotedKeyValueList")]


def generate_nested(spark: SparkSession, total: int, max_depth: int = 4, seed: int = 42) -> DataFrame:
    """``ex_id, question, answer, format_id, tags, difficulty, depth``: equal numbers of each depth, the remainder at the largest.

    A document of depth d is a wrapper that holds a document of depth d - 1 as its first or its last child; its
    format is ``NestedLd(wrapper,child)``. Names end in the layer, so that none clash. All layers of all documents are built as rows
    of one table, with a mark for what they hold, and put together in a fold.
    """
    if max_depth < 1:
        raise ValueError("a depth is at least 1")
    i, per_level = F.col("ex_id"), max(1, total // max_depth)
    base = [f for f in SECOND if f not in NOT_NESTED]
    rows = spark.range(total).withColumnRenamed("id", "ex_id").withColumn("depth", F.least(F.lit(max_depth), F.floor(i / per_level) + 1).cast("int")).withColumn("difficulty", F.lit("medium"))
    layers = rows.withColumn("layer", F.explode(F.sequence(F.lit(1), F.col("depth")))).withColumn("_id", F.concat_ws("/", "ex_id", "layer"))
    chosen = lambda names: pick(names, seed, F.col("_id"), F.lit("format"))
    layers = layers.withColumn("format_id", F.when(F.col("layer") == 1, chosen(base)).otherwise(chosen(WRAPPERS)))
    layers = _levelled(layers, "second", seed, True, "_id", F.concat(F.lit("_"), "layer"))
    first, holds = draw_int(seed, 2, F.col("_id"), F.lit("slot")) == 0, F.col("layer") > 1
    drawn = _drawn(seed, "_id", Node(F.lit(_XML), F.lit(_TAG), F.lit(_JS)), holds & first, holds & ~first)
    layers = layers.select("ex_id", "depth", "layer", "format_id", _built(base, drawn, F.col("format_id")).alias("made"))
    gathered = layers.groupBy("ex_id", "depth").agg(F.array_sort(F.collect_list(F.struct("layer", "format_id", "made.xml", "made.tag", "made.js"))).alias("layers"))

    def wrap(held: Column, outer: Column) -> Column:
        put = lambda text, mark, part: F.replace(text, F.lit(mark), held[part])
        name = cat("NestedL", outer["layer"].cast("string"), "(", outer["format_id"], ",", held["format_id"], ")")
        return F.struct(outer["layer"].alias("layer"), name.alias("format_id"), put(outer["xml"], _XML, "xml").alias("xml"), outer["tag"].alias("tag"), put(put(outer["js"], _TAG, "tag"), _JS, "js").alias("js"))

    whole = gathered.select("ex_id", "depth", F.aggregate(F.slice("layers", 2, max_depth), F.get("layers", 0), wrap).alias("m"))
    answer = obj(Node(F.col("m.xml"), F.col("m.tag"), F.col("m.js")).member)
    return whole.select("ex_id", F.col("m.xml").alias("question"), answer.alias("answer"), "m.format_id", F.array().cast("array<string>").alias("tags"), F.lit("medium").alias("difficulty"), "depth")


#: Marks for what a wrapper holds.
_XML, _TAG, _JS = "\u0001", "\u0002", "\u0003"


def nested_id(depth: int, wrapper: Column, child: Column) -> Column:
    """``NestedLd(wrapper,child)``."""
    return cat(f"NestedL{depth}(", wrapper, ",", child, ")")


def wrapped_id(child: Column) -> Column:
    """``Nested(child)``."""
    return cat("Nested(", child, ")")


def list_id(children: Column) -> Column:
    """``ListOfNested(a,b)`` of an array of formats: different ones, in order."""
    return cat("ListOfNested(", F.array_join(F.array_sort(F.array_distinct(children)), ","), ")")


def constituents(format_id: Column) -> Column:
    """The base formats that a nested format's name is made of; a plain format is its own."""
    return F.array_distinct(F.regexp_extract_all(format_id, F.lit("([A-Za-z]+)(?![A-Za-z0-9(])"), F.lit(1)))


def nested_holdout(df: DataFrame, holdout: list[str]) -> DataFrame:
    """``split``: test if any of the row's base formats is held out, else train."""
    held = F.arrays_overlap(constituents(F.col("format_id")), F.array(*map(F.lit, holdout)).cast("array<string>"))
    return df.withColumn("split", F.when(held, "test").otherwise("train"))
