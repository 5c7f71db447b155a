"""Documents from templates, without a format: flat, nested, deep ones; XML from JSON; employee lists.

A template is a function from a :class:`~tessera.operators.formats.Draw` to the root node, by generation of the
templates. Attributes are plain members in the first two; the third describes a document as JSON, from which its XML is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import draw, draw_int, pick, skewed_high

from .formats import LETTERS, WORDS, Draw, names_of, random_text
from .markup import Attr, Node, Text, cat, document, hollow, joined, leaf, many, node, obj, quoted, tagged

MOST_ITEMS, MOST_PARTS = 10, 5
DIGITS = LETTERS + "0123456789"


class T0(Draw):
    """Draws with the templates' values and skewed lengths."""

    def value(self, *place) -> Column:
        return random_text(self.seed, DIGITS, 3, 8, *self._place(place))

    def length(self, low: int, high: int, *place) -> Column:
        """Skewed towards the upper end."""
        unit = draw_int(self.seed, 1 << 20, *self._place(place)) / (1 << 20)
        return F.greatest(F.lit(low), skewed_high(low, high, unit)).cast("int")

    def count(self, low: int, high: int, *place) -> Column:
        return (low + draw_int(self.seed, high - low + 1, *self._place(place))).cast("int")


def _fields(d: T0, tag: Column | str, low: int, high: int, first: int) -> Node:
    """An object of ``low`` to ``high`` different fields."""
    n = d.count(low, high, "fields")
    return node(tag, [leaf(d.name(first + k), d.value("f", F.lit(k))).only(n > k) for k in range(high)])


def _root(*kids: Node) -> Node:
    """The templates' JSON has no root: only what is inside it."""
    made = node("root", list(kids))
    return Node(made.xml, "root", made.js)


def _rows(n: Column, tag: Text, each: Callable[[Column], Node], always_list: bool = True) -> Node:
    return many(n, tag, each)


TEMPLATES: dict[str, dict[str, Callable[[T0], Node]]] = {"v0": {}, "v1.5": {}, "v2": {}}


def template(version: str):
    def add(fn):
        TEMPLATES[version][fn.__name__.removeprefix("_").removesuffix("_15").removesuffix("_2")] = fn
        return fn

    return add


@template("v0")
def flat_object(d):
    made = _fields(d, "root", 2, 5, 1)
    return Node(made.xml, "root", made.js)


def _listed(d, outer: Text, n: Column, item: Text) -> Node:
    """A container whose JSON is the list itself."""
    rows = many(n, item, lambda k: leaf(item, d.value(k)))
    return Node(tagged(outer, rows.xml), outer, rows.js)


@template("v0")
def simple_list(d):
    return _root(_listed(d, d.name(1), d.length(2, MOST_ITEMS, "n"), d.name(2)))


@template("v0")
def singleton_list(d):
    return _root(_listed(d, d.name(1), F.lit(1), d.name(2)))


@template("v0")
def nested_object(d):
    return _root(_fields(d, d.name(1), 2, 4, 2))


@template("v0")
def list_of_objects(d):
    three = d.count(2, 3, "keys") == 3
    rows = many(d.length(2, MOST_ITEMS, "n"), "item", lambda k: node("item", [leaf(d.name(1), d.value(k, "a")), leaf(d.name(2), d.value(k, "b")), leaf(d.name(3), d.value(k, "c")).only(three)]))
    return _root(Node(tagged("items", rows.xml), "items", rows.js))


@template("v0")
def mixed_siblings_with_list(d):
    return _root(node("data", [leaf("timestamp", d.value("t")), many(d.length(3, MOST_ITEMS, "n"), "point", lambda k: leaf("point", d.number(1, 100, k)))]))


@template("v0")
def attributes_and_children(d):
    return _root(node("person", [leaf("name", d.value("n")), leaf("city", d.value("c"))], [Attr("id", d.value("i"))], at=""))


def _with_text(tag: Text, attr: Text, value: Column, text: Column) -> Node:
    return Node(tagged(tag, text, [Attr(attr, value)]), tag, cat('{"', attr, '":', quoted(value), ',"#text":', quoted(text), "}"))


@template("v0")
def attributes_and_text(d):
    return _root(_with_text("product", "sku", d.value("s"), cat(d.value("a"), " ", d.value("b"))))


@template("v0")
def self_closing_with_attributes(d):
    return _root(hollow("link", [Attr("type", "external"), Attr("href", cat("http://", d.value("h"), ".com"))], at=""))


@template("v0")
def deep_nesting_mixed(d):
    def team(k):
        return node("team", [many(d.count(2, 5, k, "m"), "member", lambda j: leaf("member", d.value(k, j)))], [Attr("lead", d.value(k, "lead"))], at="")

    department = node("department", [node("teams", [many(d.count(2, 4, "teams"), "team", team)])], [Attr("name", d.word("dep"))], at="")
    return _root(node("organization", [department], [Attr("id", d.value("org"))], at=""))


@template("v0")
def hard_deep_and_wide_safely(d):
    def section(k, j):
        return node("section", [many(d.length(1, MOST_PARTS - 2, k, j, "e"), "entry", lambda e: leaf("entry", d.value(k, j, e)))], [Attr("title", d.word(k, j, "t"))], at="")

    def report(k):
        return node("report", [many(d.length(2, MOST_PARTS - 1, k, "s"), "section", lambda j: section(k, j))], [Attr("id", d.value(k, "id"))], at="")

    return _root(node("reports", [many(d.length(2, MOST_PARTS, "r"), "report", report)]))


@template("v1.5")
def easy_flat_15(d):
    made = _fields(d, "root", 2, 6, 1)
    return Node(made.xml, "root", made.js)


@template("v1.5")
def easy_list(d):
    return _root(many(d.count(2, 6, "n"), "item", lambda k: leaf("item", d.value(k))))


@template("v1.5")
def med_nested_15(d):
    return _root(_fields(d, d.name(1), 2, 5, 2))


@template("v1.5")
def med_obj_array(d):
    return _root(many(d.count(2, 6, "n"), "item", lambda k: node("item", [leaf("id", d.value(k, "i")), leaf("value", d.value(k, "v"))])))


@template("v1.5")
def hard_attr(d):
    return _root(_with_text("person", "id", d.value("i"), d.value("n")), many(d.count(2, 6, "n"), "tag", lambda k: hollow("tag", [Attr("value", d.value(k))], at="")))


@template("v1.5")
def hard_deep(d):
    return _root(many(d.count(1, 3, "g"), "group", lambda k: node("group", [many(d.count(1, 3, k, "u"), "user", lambda j: node("user", [leaf("name", d.value(k, j))]))])))


@template("v1.5")
def test_singleton_array(d):
    return _root(many(F.lit(1), "item", lambda k: leaf("item", d.value(k))))


@template("v1.5")
def test_attr_order_variation(d):
    return _root(hollow("person", [Attr("name", d.value("n")), Attr("id", d.value("i"))], at=""))


@template("v1.5")
def test_cdata_entity(d):
    raw = cat(d.value("a"), " & ", d.value("b"))
    return _root(Node(tagged("data", cat("<![CDATA[", raw, "]]>")), "data", quoted(raw)), leaf("text", "Test &lt; &amp; &gt;", '"Test < & >"'))


@template("v1.5")
def test_optional_element(d):
    return _root(leaf("optional", d.value("o")).only(d.chance(0.5, "there")))


@template("v1.5")
def test_nested_obj_array(d):
    return _root(node(d.name(1), [many(d.count(2, 6, "n"), "item", lambda k: _with_text("item", "id", d.value(k), d.value(k)))]))


@template("v1.5")
def test_deep_nested_attributes(d):
    users = many(d.count(1, 5, "n"), "user", lambda k: hollow("user", [Attr("id", d.value(k, "i")), Attr("role", d.word(k, "r"))], at=""))
    return _root(node("group", [users], [Attr("id", d.value("g"))], at=""))


def _described(members: dict[str, Column | None], there: dict[str, Column] | None = None) -> Column:
    """An object from names to JSON text."""
    there = there or {}
    return obj(*(F.when(there[k], cat(f'"{k}":', v)) if k in there else cat(f'"{k}":', v) for k, v in members.items()))


def _items(name: Text, n: Column, each: Callable[[Column], Column]) -> Column:
    """The builder's form of a list under a container."""
    return cat('{"#item_name":"', name, '","#items":[', joined(n, each, ","), "]}")


def _of_root(js: Column) -> Node:
    return Node(F.lit(None).cast("string"), "root", js)


def _named(key: Column, value: Column) -> Column:
    return cat('{"', key, '":', value, "}")


@template("v2")
def easy_flat_2(d):
    return _of_root(_named(d.name(1), quoted(d.value("v"))))


@template("v2")
def simple_list_2(d):
    return _of_root(_described({"items": _items("item", d.count(2, 6, "n"), lambda k: quoted(d.value(k)))}))


@template("v2")
def med_nested_2(d):
    return _of_root(_named(d.name(1), _named(d.name(2), quoted(d.value("v")))))


def _user(d, keys: list[str], *place) -> Column:
    key = d.pick(keys, *place, "key")
    return cat('{"name":"', d.word(*place, "name"), '","', key, '":"', F.when(key == "@uuid", d.ident(*place)).otherwise(d.value(*place)), '"}')


@template("v2")
def med_obj_array_varied_id(d):
    return _of_root(_described({"users": _items("user", d.count(2, 6, "n"), lambda k: _user(d, ["@id", "@key", "@uuid", "@name"], k))}))


@template("v2")
def hard_deep_varied_id(d):
    def group(k):
        return cat('{"', d.pick(["@id", "@name"], k, "gk"), '":"', d.word(k, "g"), '","users":', _items("user", d.count(2, 6, k, "n"), lambda j: _user(d, ["@id", "@key", "@uuid"], k, j)), "}")

    return _of_root(_described({"groups": _items("group", d.count(1, 3, "g"), group)}))


@template("v2")
def flat_list_of_objects(d):
    each = lambda k: cat('{"@name":"project_id.', d.word(k), '","@type":"', d.pick(["table", "join", "view"], k, "t"), '","@status":"', d.pick(["active", "inactive"], k, "s"), '"}')
    return Node(F.lit(None).cast("string"), cat(d.name(1), "s"), _items(d.name(1), d.count(2, 6, "n"), each))


@template("v2")
def diverse_attributes(d):
    return _of_root(_named(d.name(1), _described({"@status": quoted(d.pick(["ok", "error", "pending"], "s")), "@priority": d.number(1, 5, "p"), "@enabled": d.boolean("e"), "@name": quoted(d.word("n"))})))


@template("v2")
def test_mixed_content(d):
    return _of_root(_described({"file": _described({"@id": d.number(100, 999, "i"), "@active": F.lit("true"), "value": quoted(cat(d.word("v"), ".txt"))})}))


@template("v2")
def test_optional_list(d):
    return _of_root(_described({"data": _described({"@id": quoted(d.value("i")), "notes": _items("note", d.count(2, 6, "n"), lambda k: quoted(d.value(k)))}, {"notes": d.chance(0.5, "there")})}))


@template("v2")
def test_empty_object(d):
    return _of_root(F.lit("{}"))


@template("v2")
def test_empty_tag_from_null(d):
    return _of_root(F.lit('{"config":null}'))


@template("v2")
def test_self_closing_from_empty_dict(d):
    return _of_root(F.lit('{"meta":{}}'))


@template("v2")
def test_boolean_attribute(d):
    return _of_root(_described({"status": _described({"@active": d.boolean("a")})}))


def _scalar(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def build_xml(described: str, indent: int | None = 2) -> str:
    """XML of a JSON description with exactly one root key.

    ``@name`` is an attribute, ``#item_name`` and ``#items`` a list, a list without them one of ``item``,
    nothing an empty element.
    """
    top = json.loads(described)
    if not isinstance(top, dict) or len(top) != 1:
        raise ValueError("a description has exactly one root key")
    out: list[str] = []
    todo: list[tuple] = [(0, *top.popitem())]
    while todo:
        depth, tag, value = todo.pop()
        pad = "" if indent is None else "\n" * bool(out) + " " * (indent * depth)
        if tag is None:  # an end tag
            out.append(pad + value)
            continue
        attributes, kids = "", None
        if isinstance(value, dict):
            if "#item_name" in value and "#items" in value:
                kids = [(value["#item_name"], v) for v in value["#items"]]
            else:
                attributes = "".join(f' {k[1:]}="{escape(_scalar(v))}"' for k, v in value.items() if k.startswith("@"))
                kids = [(k, v) for k, v in value.items() if not k.startswith("@")] or None
        elif isinstance(value, list):
            kids = [("item", v) for v in value]
        if kids is None:
            out.append(f"{pad}<{tag}{attributes} />" if isinstance(value, dict) else f"{pad}<{tag}>{escape(_scalar(value))}</{tag}>")
            continue
        out.append(f"{pad}<{tag}{attributes}>")
        todo.append((depth, None, f"</{tag}>"))
        todo += [(depth + 1, k, v) for k, v in reversed(kids)]
    return "".join(out)


def plain_lists(described: str) -> str:
    """The description with ``#item_name`` containers as the plain lists that they stand for."""

    def plain(value):
        if isinstance(value, dict):
            return [plain(v) for v in value["#items"]] if "#items" in value else {k: plain(v) for k, v in value.items()}
        return [plain(v) for v in value] if isinstance(value, list) else value

    return json.dumps(plain(json.loads(described)), ensure_ascii=False, separators=(",", ":"))


def _written(batches):
    for b in batches:
        texts = b.column("answer").to_pylist()
        xml = [build_xml(t) if q is None else q for q, t in zip(b.column("question").to_pylist(), texts, strict=True)]
        columns = [pa.array(xml, pa.string()) if n == "question" else c for n, c in zip(b.schema.names, b.columns, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)


def _from_templates(rows: DataFrame, version: str, seed: int) -> DataFrame:
    """``ex_id, template, question, answer`` of rows with ``ex_id, template``."""
    held = rows.withColumn("_names", names_of(seed, F.col("ex_id"), False))
    d = T0(seed, F.col("ex_id"), F.lit("medium"), F.lit(3), F.lit(3), F.lit(3), F.lit(0.5), F.col("_names"))
    made = []
    for name, fn in TEMPLATES[version].items():
        root = fn(d)
        answer = document(root)[1] if version == "v2" else root.js
        made.append(F.when(F.col("template") == name, F.struct(root.xml.alias("question"), answer.alias("answer"))))
    out = held.withColumn("_made", F.coalesce(*made)).select("ex_id", "template", "_made.question", "_made.answer")
    return out.mapInArrow(_written, out.schema) if version == "v2" else out


def _ids(spark: SparkSession, total: int) -> DataFrame:
    return spark.range(total).withColumnRenamed("id", "ex_id")


def generate_uniform(spark: SparkSession, total: int = 750, version: str = "v0", seed: int = 42) -> DataFrame:
    """Each row from a template drawn at random."""
    return _from_templates(_ids(spark, total).withColumn("template", pick([*TEMPLATES[version]], seed, F.col("ex_id"), F.lit("template"))), version, seed)


def generate_equal(spark: SparkSession, each: int = 25, version: str = "v1.5", seed: int = 42, leave_out: tuple[str, ...] = ("test_cdata_entity",)) -> DataFrame:
    """The same number from each template, with a key to shuffle by."""
    names = [t for t in TEMPLATES[version] if t not in leave_out]
    rows = _ids(spark, each * len(names)).withColumn("template", F.get(F.array(*map(F.lit, names)), F.floor(F.col("ex_id") / each).cast("int")))
    return _from_templates(rows, version, seed).withColumn("shuffle_key", draw(seed, F.col("ex_id")))


def generate_pools(spark: SparkSession, total: int = 750, each_test: int = 25, version: str = "v2", seed: int = 42) -> DataFrame:
    """``each_test`` of every test template, the rest drawn from the others; too small a total is an error."""
    tests = [t for t in TEMPLATES[version] if t.startswith("test_")]
    main = [t for t in TEMPLATES[version] if t not in tests]
    rest = total - each_test * len(tests)
    if rest < len(main):
        raise ValueError(f"at least {len(main) + each_test * len(tests)} rows are needed")
    i = F.col("ex_id")
    of_test = F.get(F.array(*map(F.lit, tests)), F.floor((i - rest) / each_test).cast("int"))
    rows = _ids(spark, total).withColumn("template", F.when(i < rest, pick(main, seed, i, F.lit("template"))).otherwise(of_test))
    return _from_templates(rows, version, seed).withColumn("shuffle_key", draw(seed, i))


FIRST = ["Ada", "Ben", "Cleo", "Dina", "Emil", "Fay", "Gus", "Hana", "Ivo", "Jana", "Kai", "Lena", "Milo", "Nora", "Otto", "Pia"]
LAST = [w.capitalize() for w in WORDS]
#: List sizes taken in turn.
SIZES = ((1, 3), (4, 8), (9, 15))


def generate_employees(spark: SparkSession, total: int = 500, seed: int = 42) -> DataFrame:
    """``ex_id, input, output``: small, medium and large lists of different names in turn, with irregular white space in three block styles."""
    i = F.col("ex_id")
    low, high = (F.get(F.array(*(F.lit(s[k]) for s in SIZES)), F.pmod(i, F.lit(3)).cast("int")) for k in (0, 1))
    at = lambda k: draw_int(seed, len(FIRST) * len(LAST), i, k, F.lit("name"))
    name = lambda x: F.concat_ws(" ", F.get(F.array(*map(F.lit, FIRST)), F.floor(x / len(LAST)).cast("int")), F.get(F.array(*map(F.lit, LAST)), F.pmod(x, F.lit(len(LAST))).cast("int")))
    rows = _ids(spark, total).withColumn("n", (low + draw_int(seed, high - low + 1, i, F.lit("n"))).cast("int"))
    rows = rows.withColumn("names", F.slice(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: name(at(k)))), F.lit(1), F.col("n")))
    spaces = lambda least, most, *place: F.repeat(F.lit(" "), (least + draw_int(seed, most - least + 1, i, *place)).cast("int"))

    def block(who: Column, k: Column) -> Column:
        p = lambda x: (k, F.lit(x))
        field, base, end = cat("<fullName>", who, "</fullName>"), spaces(0, 8, *p("base")), spaces(0, 8, *p("end"))
        style = draw_int(seed, 3, i, *p("style"))
        expanded = cat(base, "<employee>\n", base, spaces(1, 12, *p("in")), field, "\n", end, "</employee>")
        return F.when(style == 0, cat(base, "<employee>", field, "</employee>")).when(style == 1, expanded).otherwise(cat(base, "<employee>", field, "\n", end, "</employee>"))

    line = lambda place: F.when(draw_int(seed, 10, i, F.lit(place)) > 2, "\n").otherwise("")
    gap = draw_int(seed, 3, i, F.lit("gap"))  # line feeds between blocks, the same in all of a document
    body = F.transform("names", lambda who, k: cat(F.when(k > 0, F.repeat(F.lit("\n"), gap.cast("int"))).otherwise(""), block(who, k)))
    xml = cat("<employeeList>", line("start"), F.array_join(body, ""), line("stop"), spaces(0, 4, F.lit("tail")), "</employeeList>")
    js = cat('{"employeeList":{"employee":[', F.array_join(F.transform("names", lambda who: cat('{"fullName":"', who, '"}')), ","), "]}}")
    return rows.select("ex_id", xml.alias("input"), js.alias("output"))


def with_xml(df: DataFrame, column: str, name: str = "xml", indent: int | None = 2) -> DataFrame:
    """``df`` with the XML that each description in ``column`` stands for; a description that isn't one is null."""

    def made(text: str | None) -> str | None:
        try:
            return build_xml(text or "", indent)
        except ValueError:
            return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([made(x) for x in b.column(column).to_pylist()], pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
