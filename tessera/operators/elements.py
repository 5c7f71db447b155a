"""Markup as a relation: tokens, an interval for each element, structural joins and conversion to JSON level by level.

Everything is an expression or a join of the JVM. :func:`to_json` folds short XML documents in their rows. A document's text is taken apart by one
regular expression. Depth and place of a token are sums over what comes before it, the end of an element the nearest
end tag of its level after it, its parent the nearest start tag of the level above before it: all of them are running
sums, minima or maxima, which :func:`running` computes in blocks, so that a document of any width is spread over tasks.

Defined results: a null or empty text has no tokens and no elements; a text that isn't well-formed keeps its tokens and
is named by :func:`faults`; comments, declarations and instructions are tokens, but no elements. In HTML a start tag
without an end tag is an element without content and an end tag without a start tag is passed over. Offsets are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.tables import written

#: Elements of HTML without an end tag, and those whose content is raw text.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style")
#: The five entities that XML has by itself.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Tokens that are summed up in one window.
BLOCK = 10_000
#: Tokens of a range that a structural join compares.
RANGE = 256
#: Characters ``<`` of a document that is folded in its own row: it has at most twice as many tokens and one more.
ROW = 256

_OTHER = r"""<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|<\?(?s:.*?)\?>|<![^>]*>"""
_TAG = r"""</?[A-Za-z_][^\s/>"']*+[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_RAW = "|".join(rf"<{x}(?:\s[^>]*)?>(?s:.*?)</{x}\s*>" for x in RAW)
XML_TOKEN = f"{_OTHER}|{_TAG}|[^<]+|<"
HTML_TOKEN = f"{_OTHER}|(?i:{_RAW})|{_TAG}|[^<]+|<"
_ATTRIBUTE = r"""([^\s=/>"'<]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

_NAME = r"""[^ \t\r\n/<>"'=]"""
#: A document that single characters take apart: ``<`` and ``>`` only around tags, comments and instructions, ``"`` only around values,
#: which follow one space and a name and neither begin with a space nor end with an equals sign; no references and sections.
PLAIN = rf"""^[^<>"]*+(?:<(?:[A-Za-z_]{_NAME}*+(?: {_NAME}++="(?! )[^"<>]*+(?<!=)")*+(?: ?/)?>|/[A-Za-z_]{_NAME}*+>|!--[^<>]*--(?<!<!-{{2,3}})>|\?[^<>]*\?(?<!<\?)>|![A-Za-z][^<>]*+>)[^<>"]*+)*+\z"""
#: What such a document has none of: references, white space that XML doesn't know and other control characters.
_OTHERS = r"[&\x00-\x08\x0b\x0c\x0e-\x1f\x{85}\x{a0}]"


def _cut(text: Column, html: bool) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HTML_TOKEN if html else XML_TOKEN), F.lit(0))


def _tag(token: Column, html: bool) -> Column:
    name = F.regexp_extract(token, r"^</?([A-Za-z_][^\s/>]*)", 1)
    return F.nullif(F.lower(name) if html else name, F.lit(""))


def _sort(token: Column, tag: Column, html: bool) -> Column:
    whole = token.endswith("/>") | (tag.isin(*VOID, *RAW) if html else F.lit(False))
    return (
        F.when(tag.isNull() & token.startswith("<![CDATA["), "cdata").when(tag.isNull() & token.startswith("<!"), "declaration")
        .when(tag.isNull() & token.startswith("<?"), "instruction").when(tag.isNull(), "text")
        .when(token.startswith("</"), "end").when(whole, "leaf").otherwise("start")
    )


def _blank(token: Column) -> Column:
    return F.trim(F.translate(token, "\t\n\r", "   ")) == ""


def tokens(df: DataFrame, key: str, text: str, html: bool = False) -> DataFrame:
    """``key, pos, token, kind, tag, sort``: ``kind`` is 1 for a start tag, -1 for an end tag, else 0; ``sort`` says what it is."""
    cut = df.select(F.col(key).alias("key"), F.posexplode(_cut(F.col(text), html)).alias("pos", "token"))
    rows = cut.withColumn("tag", _tag(F.col("token"), html))
    rows = rows.withColumn("sort", _sort(F.col("token"), F.col("tag"), html))
    return rows.withColumn("kind", F.when(F.col("sort") == "start", 1).when(F.col("sort") == "end", -1).otherwise(0)).select("key", "pos", "token", "kind", "tag", "sort")


def running(rows: DataFrame, keys: list[str], order: str, made: dict[str, tuple], backwards: bool = False, block: int = BLOCK) -> DataFrame:
    """``rows`` with running aggregates, the row itself included: ``made`` gives (``F.sum``, ``F.min`` or ``F.max``, column) by name.

    A group is cut into blocks of ``order``: each is one window, what comes before a block is a window over the blocks' totals.
    """
    part = rows.withColumn("_block", F.floor(F.col(order) / block))
    for name, (_, column) in made.items():
        part = part.withColumn(f"_{name}", column)
    direction = F.desc if backwards else F.asc
    inside = Window.partitionBy(*keys, "_block").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy(*keys, "_block").agg(*(fn(f"_{name}").alias(f"_{name}") for name, (fn, _) in made.items()))
    before = totals.select(*keys, "_block", *(fn(f"_{name}").over(earlier).alias(f"_b_{name}") for name, (fn, _) in made.items()))
    out = part.select("*", *(fn(f"_{name}").over(inside).alias(f"_i_{name}") for name, (fn, _) in made.items())).join(before, [*keys, "_block"])
    both = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.min: F.least, F.max: F.greatest}
    return out.select(*rows.columns, *(both[fn](F.col(f"_i_{name}"), F.col(f"_b_{name}")).alias(name) for name, (fn, _) in made.items()))


def _under(level: Column, providers: DataFrame, askers: DataFrame, block: int) -> DataFrame:
    """``askers`` (key, pos, level, ...) with ``parent``: the place of the nearest start tag of the level above before them."""
    given = providers.select("key", (F.col("level") + 1).alias("level"), "pos", F.col("pos").alias("_start"))
    rows = askers.withColumn("_start", F.lit(None).cast("int")).withColumn("_asks", F.lit(True)).unionByName(given, allowMissingColumns=True)
    return running(rows, ["key", "level"], "pos", {"parent": (F.max, F.col("_start"))}, block=block).filter("_asks").drop("_asks", "_start")


def mended(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Tokens of which a start tag without an end tag is a ``leaf`` and an end tag without a start tag a ``stray`` without a tag.

    Tags are matched with those of their own name: a start tag with the next end tag of the same depth among them.
    """
    tags = running(rows.filter("kind != 0"), ["key", "tag"], "pos", {"_d": (F.sum, F.col("kind"))}, block=block).withColumn("_l", F.col("_d") + F.when(F.col("kind") == 1, 0).otherwise(1))
    own = ["key", "tag", "_l"]
    tags = running(tags, own, "pos", {"_before": (F.max, F.when(F.col("kind") == 1, F.col("pos")))}, block=block)
    tags = running(tags, own, "pos", {"_after": (F.min, F.when(F.col("kind") == -1, F.col("pos")))}, backwards=True, block=block)
    lone = tags.filter("(kind = 1 and _after is null) or (kind = -1 and _before is null)").select("key", "pos", F.lit(True).alias("_lone"))
    marked = rows.join(lone, ["key", "pos"], "left")
    sort = F.when(F.col("_lone") & (F.col("kind") == 1), "leaf").when(F.col("_lone"), "stray").otherwise(F.col("sort"))
    return marked.select("key", "pos", "token", F.when(F.col("_lone"), 0).otherwise(F.col("kind")).alias("kind"), F.when(sort != "stray", F.col("tag")).alias("tag"), sort.alias("sort"))


def _placed(df: DataFrame, key: str, text: str, html: bool, block: int) -> DataFrame:
    rows = tokens(df, key, text, html)
    rows = running(mended(rows, block) if html else rows, ["key"], "pos", {"depth": (F.sum, F.col("kind")), "end": (F.sum, F.length("token"))}, block=block)
    return rows.withColumn("begin", F.col("end") - F.length("token")).withColumn("level", F.col("depth") + F.when(F.col("kind") == 1, 0).otherwise(1))


def nodes(df: DataFrame, key: str, text: str, html: bool = False, block: int = BLOCK) -> DataFrame:
    """Elements and texts: ``key, pos, sort, tag, level, parent, begin, opened, closing, end, token, end_pos, end_tag``.

    ``opened`` and ``closing`` are the end of the start tag and the begin of the end tag; ``pos`` and ``end_pos`` are the places of both tags.
    """
    return _nodes_of(_placed(df, key, text, html, block), block)


def _nodes_of(placed: DataFrame, block: int) -> DataFrame:
    closer = F.when(F.col("sort") == "end", F.struct("pos", "begin", "end", "tag"))
    marks = running(placed.filter("sort not in ('declaration', 'instruction', 'stray')"), ["key", "level"], "pos", {"closer": (F.min, closer)}, backwards=True, block=block)
    own = marks.filter("sort != 'end'").withColumn("_c", F.when(F.col("kind") == 1, F.col("closer")))
    own = own.select(
        "key", "pos", "sort", "tag", "level", "begin", F.col("end").alias("opened"), F.coalesce("_c.begin", "end").alias("closing"), F.coalesce("_c.end", "end").alias("end"), "token",
        F.when(F.col("kind") == 1, F.col("_c.pos")).otherwise(F.col("pos")).alias("end_pos"), F.when(F.col("kind") == 1, F.col("_c.tag")).otherwise(F.col("tag")).alias("end_tag"),
    )
    return _under(F.col("level"), own.filter("sort = 'start'"), own, block)


def parsed(df: DataFrame, key: str, text: str, html: bool = False, block: int = BLOCK) -> DataFrame:
    """:func:`nodes` of the well-formed documents, written."""
    placed = written(_placed(df, key, text, html, block))
    found = written(_nodes_of(placed, block))
    return found.join(_faults_of(df.select(F.col(key).alias("key")), placed, found).filter("fault is null"), "key", "left_semi")


def elements(found: DataFrame) -> DataFrame:
    """The elements among :func:`nodes`."""
    return found.filter("tag is not null")


def faults(df: DataFrame, key: str, text: str, html: bool = False, block: int = BLOCK) -> DataFrame:
    """``key, fault`` of every document: null, or why it isn't well-formed."""
    placed = _placed(df, key, text, html, block)
    return _faults_of(df.select(F.col(key).alias("key")), placed, _nodes_of(placed, block))


def _faults_of(keys: DataFrame, placed: DataFrame, found: DataFrame) -> DataFrame:
    depth = placed.groupBy("key").agg(F.min("depth").alias("least"), F.sum("kind").alias("open"), F.max((F.col("token") == "<").cast("int")).alias("stray"))
    shape = found.groupBy("key").agg(
        F.count_if((F.col("level") == 1) & F.col("tag").isNotNull()).alias("roots"), F.count_if((F.col("level") == 1) & F.col("tag").isNull() & ~_blank(F.col("token"))).alias("beside"),
        F.count_if((F.col("sort") == "start") & ~F.col("tag").eqNullSafe(F.col("end_tag"))).alias("crossed"),
    )
    fault = (
        F.when(F.col("stray") == 1, "a stray <").when(F.col("least") < 0, "an end tag without a start")
        .when(F.col("crossed") > 0, "a start tag without its end").when(F.col("open") != 0, "a start tag without its end")
        .when(F.coalesce("roots", F.lit(0)) == 0, "no element").when(F.col("roots") > 1, "several roots").when(F.col("beside") > 0, "text beside the root")
    )
    return keys.distinct().join(depth, "key", "left").join(shape, "key", "left").select("key", fault.alias("fault"))


# ---- structural joins

def inside(outer: DataFrame, inner: DataFrame, size: int = RANGE) -> DataFrame:
    """Pairs of an element of ``outer`` and one of ``inner`` within it: ``key, ancestor, descendant, levels``.

    An interval takes part in every range of ``size`` tokens that it covers, an inner element in the one where it begins, so only
    what shares a range is compared.
    """
    a = outer.select("key", F.col("pos").alias("ancestor"), F.col("end_pos").alias("_end"), F.col("level").alias("_level"), F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor(F.col("end_pos") / size))).alias("_range"))
    d = inner.select("key", F.col("pos").alias("descendant"), F.col("level").alias("_inner"), F.floor(F.col("pos") / size).alias("_range"))
    pairs = a.join(d, ["key", "_range"]).filter((F.col("descendant") > F.col("ancestor")) & (F.col("descendant") < F.col("_end")))
    return pairs.select("key", "ancestor", "descendant", (F.col("_inner") - F.col("_level")).alias("levels"))


def nearest(outer: DataFrame, inner: DataFrame, size: int = RANGE) -> DataFrame:
    """``key, descendant, ancestor``: the innermost element of ``outer`` around each of ``inner`` that has one."""
    return inside(outer, inner, size).groupBy("key", "descendant").agg(F.max("ancestor").alias("ancestor"))


def slices(df: DataFrame, key: str, text: str, chosen: DataFrame) -> DataFrame:
    """``key, pos, fragment``: the markup of each chosen element."""
    return chosen.select("key", "pos", "begin", "end").join(df.select(F.col(key).alias("key"), F.col(text).alias("_text")), "key").select("key", "pos", F.expr("substring(_text, begin + 1, end - begin)").alias("fragment"))


def simple(found: DataFrame) -> DataFrame:
    """Elements without grandchildren, with their number of children: ``key, pos, tag, children``."""
    own = elements(found)
    kids = own.groupBy("key", "parent").agg(F.count("*").alias("children"))
    counted = own.join(kids.withColumnRenamed("parent", "pos"), ["key", "pos"], "left").select("key", "pos", "tag", "parent", F.coalesce("children", F.lit(0)).alias("children"))
    grand = counted.filter("children > 0 and parent is not null").select("key", F.col("parent").alias("pos")).distinct()
    return counted.join(grand, ["key", "pos"], "left_anti").select("key", "pos", "tag", "children")


# ---- values

def unescaped(text: Column) -> Column:
    """The five entities of XML and references by number as what they stand for; others stay."""
    parts = F.split(text, "&")

    def read(p: Column) -> Column:
        name, rest = F.regexp_extract(p, r"^(#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6}|[a-z]{2,4});", 1), F.regexp_replace(p, "^[^;]*;", "")
        number = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        known = reduce(lambda w, e: w.when(name == e[0], F.concat(F.lit(e[1]), rest)), ENTITIES.items(), F.when(name.startswith("#"), F.concat(char, rest)))
        return known.otherwise(F.concat(F.lit("&"), p))

    return F.when(F.contains(text, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, 2_000_000_000), read), ""))).otherwise(text)


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def attributes(token: Column) -> Column:
    """Names and values of a start tag, in order."""
    head = F.regexp_replace(token, r"^<[^\s/>]*", "")
    pick = lambda m: F.struct(F.regexp_extract(m, _ATTRIBUTE, 1).alias("name"), unescaped(F.regexp_replace(F.regexp_extract(m, _ATTRIBUTE, 2), r"""^["']|["']$""", "")).alias("value"))
    return F.transform(F.regexp_extract_all(head, F.lit(_ATTRIBUTE), F.lit(0)), pick)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")


def _object(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def _member(name: Column, value: Column) -> Column:
    return F.concat(quoted(name), F.lit(":"), value)


def _leaf(members: Column, text: Column, scalar) -> Column:
    """JSON of an element without children, of its attributes and its text."""
    return (
        F.when(F.size(members) == 0, F.when(text == "", "null").otherwise(scalar(text)))
        .otherwise(_object(F.when(text == "", members).otherwise(F.concat(members, F.array(_member(F.lit("#text"), scalar(text)))))))
    )


def _inner(members: Column, some: Column) -> Column:
    """JSON of an element of its attributes, and its children and texts in order."""
    tags = F.array_distinct(F.transform(F.filter(some, lambda k: k.tag.isNotNull()), lambda k: k.tag))
    texts = F.exists(some, lambda k: k.tag.isNull())
    of = lambda t: F.transform(F.filter(some, lambda k: k.tag == t), lambda k: k.value)
    grouped = F.transform(tags, lambda t: _member(t, F.when(F.size(of(t)) == 1, F.element_at(of(t), 1)).otherwise(F.concat(F.lit("["), F.array_join(of(t), ","), F.lit("]")))))
    content = F.concat(F.lit("["), F.array_join(F.transform(some, lambda k: F.when(k.tag.isNull(), k.value).otherwise(_object(F.array(_member(k.tag, k.value))))), ","), F.lit("]"))
    return F.when(texts, _object(F.concat(members, F.array(_member(F.lit("#content"), content))))).otherwise(_object(F.concat(members, grouped)))


def _value(members: Column, text: Column, some: Column, scalar) -> Column:
    return F.when(~F.exists(some, lambda k: k.tag.isNotNull()), _leaf(members, text, scalar)).otherwise(_inner(members, some))


def _literal(sort: Column, token: Column) -> Column:
    return F.when(sort == "cdata", F.substring(token, F.lit(10), F.length(token) - 12)).otherwise(unescaped(token))


def _scalar(booleans: bool):
    return (lambda t: F.when(t.isin("true", "false"), t).otherwise(quoted(t))) if booleans else quoted


def _members(token: Column) -> Column:
    return F.transform(attributes(token), lambda a: _member(F.concat(F.lit("@"), a["name"]), quoted(a["value"])))


def _let(value: Column, made) -> Column:
    """``made(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _folded(text: Column, booleans: bool) -> Column:
    """JSON of an XML document, null if it isn't well-formed."""
    plain = ~text.rlike(_OTHERS) & text.rlike(PLAIN)
    return F.when(plain, _by_text(text, booleans)).otherwise(_by_token(text, _scalar(booleans)))


def _by_text(text: Column, booleans: bool) -> Column:
    """As :func:`_by_token` for a :data:`PLAIN` document, which becomes JSON as a text: Spark interprets a fold, so that few and short steps count.

    Attributes and elements without children are replaced in all of the text. An element that has its value is ``\\1"tag":\\2value\\4``
    from then on. The fold is over the other tags; its state is the text up to there, null after a fault.
    """
    lit, rest, space = F.lit, F.lit(2_000_000_000), " \t\r\n"
    bare = lambda x: F.btrim(x, lit(space))
    name = lambda tag: F.substring_index(F.substring_index(tag, ">", 1), " ", 1)

    def replaced(x: Column, *pairs: tuple[str, str]) -> Column:
        return reduce(lambda x, p: F.replace(x, lit(p[0]), lit(p[1])), pairs, x)

    def mixed(pieces: Column) -> Column:
        told = lambda x: F.when(x != "", F.concat(lit('"'), x, lit('"')))
        kid = lambda p: F.when(F.contains(p, lit("\1")), F.concat(lit("{"), replaced(F.substring_index(p, "\1", -1), ("\2", "")), lit("}")))
        items = F.flatten(F.transform(pieces, lambda p: F.array(told(bare(F.substring_index(p, "\1", 1))), kid(p))))
        return F.concat(lit('"#content":['), F.array_join(items, ","), lit("]"))

    def grouped(kids: Column) -> Column:
        tags = F.array_distinct(F.transform(kids, lambda k: F.substring_index(k, "\2", 1)))
        listed = lambda t, own: F.concat(t, lit("["), F.replace(F.array_join(own, ","), F.concat(t, lit("\2")), lit("")), lit("]"))
        return F.array_join(F.transform(tags, lambda t: _let(F.filter(kids, lambda k: F.substring_index(k, "\2", 1) == t), lambda own: F.when(F.size(own) == 1, replaced(own[0], ("\2", ""))).otherwise(listed(t, own)))), ",")

    def value(element: Column) -> Column:
        begun, content = F.substring_index(element, ">", 1), F.substring_index(element, ">", -1)
        members = F.when(F.contains(begun, lit(" ")), F.concat(lit('"@'), F.substring(begun, F.instr(begun, " ") + 1, rest), lit(","))).otherwise("")
        kids = F.transform(F.filter(F.split(content, "\4"), lambda p: F.contains(p, lit("\1"))), lambda p: F.substring_index(p, "\1", -1))
        inside = F.when(content.rlike(rf"(?:^|\x04)[{space}]*+[^\x01]"), mixed(F.split(content, "\4"))).otherwise(_let(kids, grouped))
        return F.concat(lit("{"), members, inside, lit("}"))

    def take(s: Column, part: Column) -> Column:
        def close(element: Column) -> Column:
            fits = F.contains(element, lit(">")) & (name(element) == F.substring(name(part), 2, rest))
            made = F.concat(F.substring(s, lit(1), F.length(s) - F.length(element) - 1), lit('\1"'), name(element), lit('":\2'), value(element), lit("\4"), F.substring_index(part, ">", -1))
            return F.when(fits, made)

        return F.when(part.startswith("/"), _let(F.substring_index(s, "<", -1), close)).otherwise(F.concat(s, lit("<"), part))

    x = F.when(F.contains(text, lit("<!")) | F.contains(text, lit("<?")), F.regexp_replace(text, "<[!?][^<>]*+>", "")).otherwise(text)
    x = replaced(x, (" />", "/>"), ('" ', '","@'), ('="', '":"'))
    x = F.regexp_replace(x, r"<([^ /<>]++)([^<>]*)/>", "<$1$2></$1>")
    x = F.regexp_replace(x, rf"<([^ /<>]++) ([^<>]*+)>[{space}]*+([^<>]*?)[{space}]*+</\1>", '\1"$1":\2{"@$2,"#text":"$3"}\4')
    x = F.regexp_replace(x, rf"<([^ /<>]++)>[{space}]*+([^<>\x01]*?)[{space}]*+</\1>", '\1"$1":\2"$2"\4')
    x = replaced(x, (',"#text":""}\4', "}\4"), ('\2""\4', "\2null\4"))
    if booleans:
        x = replaced(x, *((f'{before}"{word}"{after}', before + word + after) for word in ("true", "false") for before, after in (("\2", "\4"), (',"#text":', "}\4"))))
    found = F.aggregate(F.split(x, "<"), lit(""), take)
    made = F.get(F.regexp_extract_all(found, lit(rf"^<[{space}]*+\x01([^\x01\x04<]*+)\x04[{space}]*+\z"), lit(1)), lit(0))
    return F.concat(lit("{"), replaced(made, ("\2", ""), ("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")), lit("}"))


_OPEN = "struct<open:array<struct<tag:string,members:array<string>,kids:array<struct<tag:string,value:string,plain:string>>>>,text:string,bad:boolean>"


def _by_token(text: Column, scalar) -> Column:
    """JSON of an XML document, null if it isn't well-formed: a fold over its tokens, whose state has the elements that are open.

    The first of them stands for the document. An element gets its value at its end, when it becomes a child of the one before.
    ``text`` is what was read since the last tag.
    """
    none, no_text = F.lit(None).cast("string"), F.lit("")
    no_kids, no_members = F.array().cast("array<struct<tag:string,value:string,plain:string>>"), F.array().cast("array<string>")
    entry = lambda tag, members, kids: F.array(F.struct(tag.alias("tag"), members.alias("members"), kids.alias("kids")))
    child = lambda tag, value, plain: F.array(F.struct(tag.alias("tag"), value.alias("value"), plain.alias("plain")))
    state = lambda items, own, bad: F.struct(items.alias("open"), own.alias("text"), bad.alias("bad"))
    members = lambda token: F.when(F.contains(token, F.lit("=")), _members(token)).otherwise(no_members)

    def take(s: Column, t: Column) -> Column:
        items, own, n = s["open"], s["text"], F.size(s["open"])
        top, above, rest = F.element_at(items, -1), F.element_at(items, -2), lambda k: F.slice(items, F.lit(1), n - k)
        kids = F.when(own == "", top["kids"]).otherwise(_let(_stripped(own), lambda x: F.when(x == "", top["kids"]).otherwise(F.concat(top["kids"], child(none, quoted(x), x)))))
        at_text = F.when((n == 1) | (t["token"] == "<"), state(items, own, ~_blank(t["token"]))).otherwise(state(items, F.concat(own, _literal(t["sort"], t["token"])), s["bad"]))
        before = F.when(own == "", items).otherwise(F.concat(rest(1), entry(top["tag"], top["members"], kids)))
        at_start = state(F.concat(before, entry(t["tag"], members(t["token"]), no_kids)), no_text, s["bad"])
        leaf = child(t["tag"], _let(members(t["token"]), lambda m: _leaf(m, no_text, scalar)), none)
        at_leaf = state(F.concat(rest(1), entry(top["tag"], top["members"], F.concat(kids, leaf))), no_text, s["bad"])
        bare = F.when(F.size(top["kids"]) == 0, _let(_stripped(own), lambda x: _leaf(top["members"], x, scalar))).otherwise(_let(kids, lambda some: _inner(top["members"], some)))
        closed = state(F.concat(rest(2), entry(above["tag"], above["members"], F.concat(above["kids"], child(t["tag"], bare, none)))), no_text, s["bad"])
        at_end = F.when((n == 1) | (top["tag"] != t["tag"]), state(items, own, F.lit(True))).otherwise(closed)
        return (
            F.when(s["bad"], s).when(t["sort"].isin("text", "cdata"), at_text).when(t["sort"] == "start", at_start)
            .when(t["sort"] == "leaf", at_leaf).when(t["sort"] == "end", at_end).otherwise(s)
        )

    def root(s: Column) -> Column:
        found = F.element_at(s["open"], 1)["kids"]
        good = ~s["bad"] & (F.size(s["open"]) == 1) & (F.size(found) == 1)
        return F.when(good, _let(F.element_at(found, 1), lambda k: _object(F.array(_member(k["tag"], k["value"])))))

    cut = F.transform(_cut(text, False), lambda t: F.struct(t.alias("token"), F.when(t.startswith("<"), _tag(t, False)).alias("tag")))
    cut = F.transform(cut, lambda t: F.struct(t["token"].alias("token"), t["tag"].alias("tag"), _sort(t["token"], t["tag"], False).alias("sort")))
    begin = state(entry(none, no_members, no_kids), no_text, F.lit(False)).cast(_OPEN)
    return F.aggregate(cut, begin, take, root)


def to_json(df: DataFrame, key: str, text: str, html: bool = False, booleans: bool = True, block: int = BLOCK, fold: int = 8, row: int = ROW) -> DataFrame:
    """``key, json`` of every well-formed document.

    XML with at most ``row`` characters ``<`` is folded in its row, where its tokens are, so that none of them is shuffled or
    written; what is written is the JSON, so that a document is folded once however often the result is read. Wider documents
    and HTML, whose lone tags need all of a document, are folded level by level by :func:`values`.
    """
    wide, short = df, None
    if not html:
        few = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("<"), F.lit(""))), F.lit(0)) <= row
        whole = written(df.select(F.col(key).alias("key"), F.when(~few, F.col(text)).alias("text"), F.when(few, _folded(F.col(text), booleans)).alias("json")))
        wide, short = whole.filter("text is not null").drop("json"), whole.filter("json is not null").drop("text")
        if wide.isEmpty():
            return short
        key, text = "key", "text"
    roots = values(parsed(wide, key, text, html, block), html, booleans, block, fold).filter("parent is null")
    made = roots.select("key", _object(F.array(_member(F.col("tag"), F.col("value")))).alias("json"))
    return made if short is None else short.unionByName(made)


def values(found: DataFrame, html: bool = False, booleans: bool = True, block: int = BLOCK, fold: int = 8) -> DataFrame:
    """``key, pos, parent, tag, value``: each element of :func:`parsed` documents as JSON, by a fold over the levels, the deepest first, one aggregate a level.

    Attributes are ``@name``, equal tags a list, an empty element null, text beside children ``#content`` in order; texts that
    a comment parts are one. The tables of every ``fold`` levels are written, so that a plan doesn't grow with the depth.
    Hints, promotion and instructions are left to :func:`tessera.operators.xmljson.convert`.
    """
    literal, scalar = _literal(F.col("sort"), F.col("token")), _scalar(booleans)
    beside = running(found, ["key", "level"], "pos", {"after": (F.max, F.when(F.col("tag").isNotNull(), F.col("pos")))}, block=block)
    texts = beside.filter("sort in ('text', 'cdata') and parent is not null").groupBy("key", "parent", "level", "after").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", literal.alias("text")))).alias("t"))
    texts = texts.withColumn("text", _stripped(F.array_join("t.text", ""))).filter("text != ''")  # what only a comment parts is one
    raw = F.lit(html) & F.col("tag").isin(*RAW) & F.col("token").contains("</")
    kept = F.when(raw, F.regexp_extract("token", r"(?s)^<[^>]*>(.*)</[^<>]*>$", 1)).otherwise(F.lit(""))
    head = F.when(raw, F.regexp_extract("token", r"^<[^>]*>", 0)).otherwise(F.col("token"))
    own = written(found.filter("tag is not null").select("key", "pos", "parent", "level", "tag", _members(head).alias("members"), _stripped(kept).alias("kept")))
    texts = written(texts.select("key", "level", F.col("parent").alias("pos"), F.struct(F.col("pos").alias("at"), F.lit(None).cast("string").alias("tag"), quoted(F.col("text")).alias("value"), F.col("text").alias("plain")).alias("k")))
    levels = own.agg(F.max("level").alias("n")).first().n or 0
    done, every = None, []
    for level in range(levels, 0, -1):
        parts = texts.filter(F.col("level") == level + 1).select("key", "pos", "k")
        if done is not None:
            parts = parts.unionByName(done.select("key", F.col("parent").alias("pos"), F.struct(F.col("pos").alias("at"), "tag", "value", F.lit(None).cast("string").alias("plain")).alias("k")))
        kids = parts.groupBy("key", "pos").agg(F.sort_array(F.collect_list("k")).alias("kids"))
        rows = own.filter(F.col("level") == level).join(kids, ["key", "pos"], "left")
        text = F.concat("kept", F.coalesce(F.element_at("kids", 1)["plain"], F.lit("")))
        some = F.coalesce("kids", F.array().cast("array<struct<at:int,tag:string,value:string,plain:string>>"))
        done = rows.select("key", "pos", "parent", "tag", _value(F.col("members"), text, some, scalar).alias("value"))
        if (levels - level) % fold == fold - 1 and level > 1:
            done = written(done)
        every.append(done)
    return reduce(DataFrame.unionByName, every) if every else own.select("key", "pos", "parent", "tag", F.lit(None).cast("string").alias("value"))
