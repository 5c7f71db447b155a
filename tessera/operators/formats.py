"""The document formats. Each is a function from a :class:`Draw` to the root node.

``FORMATS`` holds them by name with their tags. Names, tags and difficulty ranges are fixed values:
data sets refer to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import draw, draw_int, pick

from .markup import Attr, Node, Text, cat, hollow, leaf, lit, many, mixed, node, obj, quoted, tagged

#: Fixed values. Items of a list, of an inner list, depth of nesting and chance of an option, by generator and difficulty.
DIFFICULTY = {
    "first": {"easy": (0, 4, 0, 2, 2, 0.1), "medium": (1, 9, 1, 4, 3, 0.5), "hard": (2, 20, 2, 8, 5, 0.9)},
    "second": {"easy": (2, 4, 2, 3, 2, 0.1), "medium": (2, 9, 2, 4, 3, 0.5), "hard": (3, 20, 3, 8, 5, 0.9)},
    "nested": {"easy": (1, 4, 1, 2, 2, 0.1), "medium": (1, 9, 1, 4, 3, 0.5), "hard": (2, 20, 2, 8, 5, 0.9)},
    "mixed": {"easy": (2, 4, 1, 2, 2, 0.1), "medium": (5, 9, 2, 4, 3, 0.5), "hard": (10, 20, 4, 8, 5, 0.9)},
}
LEVELS = ("easy", "medium", "hard")
WORDS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heron", "islet", "jetty", "knoll", "larch", "maple", "north", "ocean", "plain"]
#: Structured element names; a document takes different ones.
VOCABULARY = [*WORDS, "quarry", "ridge", "shore", "thorn", "upland", "valley", "willow", "yarrow", "zenith", "brook", "cliff", "dune", "field", "harbor"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
NAMES = 12


def random_text(seed: int, alphabet: str, low: int, high: int, *place: Column) -> Column:
    """``low`` to ``high`` characters of the alphabet."""
    n = low + draw_int(seed, high - low + 1, *place, F.lit("len"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: F.substring(F.lit(alphabet), (draw_int(seed, len(alphabet), *place, k) + 1).cast("int"), F.lit(1))), "")


def random_name(seed: int, *place: Column) -> Column:
    """A prefix and one to three parts joined by one of ``-._``, 20 characters at most; always a valid XML name."""
    parts = F.transform(F.sequence(F.lit(1), (1 + draw_int(seed, 3, *place, F.lit("parts"))).cast("int")), lambda k: random_text(seed, LETTERS, 2, 6, *place, k, F.lit("part")))
    return F.regexp_replace(F.left(cat(random_text(seed, LETTERS, 2, 4, *place, F.lit("head")), "_", F.replace(F.array_join(parts, "|"), F.lit("|"), pick(["-", ".", "_"], seed, *place, F.lit("joint")))), F.lit(20)), "[-._]$", "x")


def sample(options: list[str], k: int, seed: int, *place: Column) -> Column:
    """``k`` different options in the order of a hash; more than there are is an error."""
    if k > len(options):
        raise ValueError("a sample can't be larger than what it is taken from")
    keyed = F.transform(F.array(*map(F.lit, options)), lambda w: F.struct(draw(seed, *place, w).alias("h"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["w"]), 1, k)


def names_of(seed: int, i: Column, structured: bool = True, suffix: Column | None = None) -> Column:
    """``NAMES`` different element names of a document."""
    if structured:
        out = sample(VOCABULARY, NAMES, seed, i, F.lit("names"))
    else:
        drawn = F.transform(F.sequence(F.lit(1), F.lit(NAMES + 6)), lambda k: random_name(seed, i, k, F.lit("name")))
        spare = F.array(*(F.lit(f"n_{LETTERS[j]}") for j in range(NAMES)))
        out = F.slice(F.array_distinct(F.concat(drawn, spare)), 1, NAMES)
    return out if suffix is None else F.transform(out, lambda n: F.concat(n, suffix))


def name_map(keys: list[str], names: Column) -> Column:
    """Logical names to chosen ones."""
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.slice(names, 1, len(keys)))


@dataclass(frozen=True)
class Draw:
    """What a format draws from: any place gives the same value each time it is asked."""

    seed: int
    i: Column
    level: Column
    n: Column
    sub: Column
    depth: Column
    chance_of_option: Column
    names: Column
    #: A document to hold, and where it stands first and where last among the root's children.
    inner: Node | None = None
    inner_first: Column | None = None
    inner_last: Column | None = None

    def name(self, k: int) -> Column:
        return F.get(self.names, F.lit(k))

    def _place(self, place) -> list[Column]:
        return [self.i, *(F.lit(p) if isinstance(p, str) else p for p in place)]

    def word(self, *place) -> Column:
        return pick(WORDS, self.seed, *self._place(place))

    def pick(self, options: list[str], *place) -> Column:
        return pick(options, self.seed, *self._place(place))

    def number(self, low: int, high: int, *place) -> Column:
        return (low + draw_int(self.seed, high - low + 1, *self._place(place))).cast("string")

    def chance(self, p: float | Column, *place) -> Column:
        return draw_int(self.seed, 1 << 20, *self._place(place)) < (F.lit(p) if isinstance(p, float) else p) * (1 << 20)

    def option(self, *place) -> Column:
        """The option of medium and hard documents."""
        return (self.level != "easy") & self.chance(self.chance_of_option, *place)

    def ident(self, *place) -> Column:
        h = draw(self.seed, *self._place(place))
        return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))

    def sentence(self, *place) -> Column:
        words = F.transform(F.sequence(F.lit(1), F.lit(3) + draw_int(self.seed, 4, *self._place(place)).cast("int")), lambda k: self.word(*place, "s", k))
        return cat(F.array_join(words, " "), ".")

    def uri(self, *place) -> Column:
        return cat("urn:", self.word(*place, "u"), ":", self.word(*place, "v"))

    def boolean(self, *place) -> Column:
        return F.when(self.chance(0.5, *place), "true").otherwise("false")

    def root(self, kids: list[Node], attrs: list[Attr] = (), at: str = "@", more: list[Column] = ()) -> Node:
        if self.inner is not None:
            kids = [self.inner.only(self.inner_first), *kids, self.inner.only(self.inner_last)]
        return node(self.name(0), kids, attrs, at, more)


@dataclass(frozen=True)
class Format:
    tags: tuple[str, ...]
    build: Callable[[Draw], Node]
    prolog: Callable[[Draw], Text] | None = None
    #: The generation of generators that it belongs to.
    family: str = "second"
    #: Can hold another document beside its own children.
    wraps: bool = True
    #: Can stand inside another document; what is declared on or before the root can't.
    nests: bool = True


FORMATS: dict[str, Format] = {}


def register(name: str, *tags: str, **options):
    def add(fn):
        FORMATS[name] = Format(tags, fn, **options)
        return fn

    return add


@register("SingleField", "simple_kv", "nested_object", wraps=False)
def single_field(d: Draw) -> Node:
    return d.root([leaf(d.name(1), F.when(d.chance(0.3, "numeric"), d.number(1, 9999, "v")).otherwise(d.word("v")))])


@register("AttributedEntity", "attribute_to_kv", wraps=False)
def attributed_entity(d: Draw) -> Node:
    return hollow(d.name(0), [Attr(d.name(1), d.word("a")), Attr(d.name(2), d.word("b"))])


@register("BasicEntity", "simple_kv", "attribute_to_kv", "merged_object")
def basic_entity(d: Draw) -> Node:
    return d.root([leaf(d.name(2), d.word("c"))], [Attr(d.name(1), d.ident("a"))])


@register("PropertyList", "list_of_values", "nested_object")
def property_list(d: Draw) -> Node:
    return d.root([many(d.n, d.name(1), lambda k: leaf(d.name(1), d.word(k)))])


@register("ListOfSimpleEntities", "list_of_objects", "simple_kv", "nested_object")
def simple_entities(d: Draw) -> Node:
    return d.root([many(d.n, d.name(1), lambda k: node(d.name(1), [leaf(d.name(2), d.word(k, "a")), leaf(d.name(3), d.number(1, 500, k, "b"))]))])


@register("OrderedMixedContent", "mixed_content", "attribute_to_kv", "simple_kv", "nested_object", wraps=False)
def mixed_content(d: Draw) -> Node:
    more = d.level != "easy"
    tail = cat(" ", d.sentence("t3"))
    last = Node(tail, "", quoted(F.trim(tail))).only(more)
    return mixed(d.name(0), [cat(d.sentence("t1"), " "), leaf(d.name(2), d.word("c")), cat(" ", d.sentence("t2"), " "), leaf(d.name(3), d.number(100, 500, "e")).only(more), last], [Attr(d.name(1), d.ident("a"))])


_HINTS = {"object": "{}", "list": "[]", "string": '""', "boolean": "false"}


@register("HintedEmptyNode", "type_casting", "attribute_to_kv")
def hinted(d: Draw) -> Node:
    hint = (d.level == "easy") | d.chance(0.5, "hint")
    kind, plain = d.pick([*_HINTS], "kind"), d.word("type")
    value = F.coalesce(*(F.when(kind == k, v) for k, v in _HINTS.items()))
    told = Attr("type", F.when(hint, kind).otherwise(plain))
    other = Attr("id", d.ident("id"), hint & (d.level == "hard"))
    field = Node(tagged(d.name(1), None, [told, other]), d.name(1), F.when(hint, value).otherwise(cat('{"@type":"', plain, '"}')))
    return d.root([leaf(d.name(2), d.word("sibling")).only(d.level != "easy"), field])


@register("SpecialValues", "simple_kv", "type_casting", "empty_element_to_null")
def special_values(d: Draw) -> Node:
    return d.root([hollow(d.name(1)), leaf(d.name(2), "true", "true"), leaf(d.name(3), "false", "false"), Node(tagged(d.name(4), ""), d.name(4), lit("null"))])


@register("NamespacedObject", "namespace_handling", "attribute_to_kv", "simple_kv", nests=False)
def namespaced(d: Draw) -> Node:
    tag = cat(d.name(1), ":", d.name(2))
    return d.root([leaf(tag, d.word("v"))], [Attr(cat("xmlns:", d.name(1)), d.uri("ns"))])


@register("HeterogeneousList", "list_of_objects", "list_of_values", "mixed_content")
def heterogeneous(d: Draw) -> Node:
    def item(k: Column) -> Node:
        plain, a, b = d.chance(0.5, k, "plain"), leaf(d.name(1), d.word(k)), node(d.name(1), [leaf(d.name(2), d.word(k))])
        return Node(F.when(plain, a.xml).otherwise(b.xml), d.name(1), F.when(plain, a.js).otherwise(b.js))

    return d.root([many(d.n, d.name(1), item)])


@register("CDataField", "cdata_section", "simple_kv", wraps=False)
def cdata(d: Draw) -> Node:
    body = cat("<p>", d.sentence("v"), "</p>")
    return d.root([Node(tagged(d.name(1), cat("<![CDATA[", body, "]]>")), d.name(1), quoted(body))])


_TARGETS = ["page-layout", "render-hint", "print-order", "cache-policy", "link-base", "spell-check"]


def _instruction(d: Draw) -> tuple[Column, Column, Column]:
    """Target, data and data as JSON text."""
    pairs = d.chance(0.5, "pairs")
    data = lambda q: cat(d.word("k1"), "=", q, d.word("f"), ".txt", q, " ", d.word("k2"), "=", q, d.word("w"), q)
    return d.pick(_TARGETS, "target"), F.when(pairs, data('"')).otherwise(d.sentence("pi")), F.when(pairs, data('\\"')).otherwise(d.sentence("pi"))


@register("ProcessingInstructionNode", "processing_instruction", nests=False, wraps=False, prolog=lambda d: cat("<?", _instruction(d)[0], " ", _instruction(d)[1], "?>"))
def instructed(d: Draw) -> Node:
    target, _, data = _instruction(d)
    return d.root([leaf(d.name(1), "content")], more=[cat('"_processing_instructions":[{"', target, '":"', data, '"}]')])


def _entities(d: Draw) -> Column:
    return cat("<!DOCTYPE ", d.name(0), ' [<!ENTITY company "', d.word("c1"), " and ", d.word("c2"), '"><!ENTITY year "', d.number(1980, 2024, "y"), '">]>\n')


@register("EntityReferenceField", "simple_kv", nests=False, wraps=False, prolog=_entities)
def entity_reference(d: Draw) -> Node:
    made = quoted(cat("Copyright © ", d.number(1980, 2024, "y"), " ", d.word("c1"), " and ", d.word("c2")))
    return d.root([leaf(d.name(1), "Copyright © &year; &company;", made)])


@register("AttributePromotedKeyValueList", "attribute_to_kv", "merged_object", "list_of_objects", wraps=False)
def promoted(d: Draw) -> Node:
    """Two attributes a row become one member each - the last of equal keys stays -; three stay attributes."""
    three = (d.level != "easy") & d.chance(0.4, "three")
    item = lambda k: hollow(d.name(1), [Attr(d.name(2), d.word(k, "k")), Attr(d.name(3), d.number(1, 500, k, "v")), Attr(d.name(4), d.word(k, "x"), three)])
    rows = many(d.n, d.name(1), item)
    pairs = F.transform(F.sequence(F.lit(1), d.n.cast("int")), lambda k: F.struct(d.word(k, "k").alias("k"), d.number(1, 500, k, "v").alias("v")))
    last = F.filter(pairs, lambda p, at: ~F.exists(F.slice(pairs, at + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    flat = cat("{", F.array_join(F.transform(last, lambda p: cat('"', p["k"], '":"', p["v"], '"')), ","), "}")
    return Node(tagged(d.name(0), rows.xml), d.name(0), F.when(three, obj(rows.member)).otherwise(flat))


@register("ListOfAttributedEntities", "list_of_objects", "attribute_to_kv")
def attributed_entities(d: Draw) -> Node:
    def item(k: Column) -> Node:
        more = (d.level != "easy") & d.chance(0.5, k, "more")
        return hollow(d.name(1), [Attr(d.name(2), d.word(k, "a")), Attr(d.name(3), d.word(k, "b")), Attr("optional_attr", d.number(0, 1, k, "o"), more)])

    return d.root([many(d.n, d.name(1), item)])


@register("ListOfLists", "list_of_objects", "list_of_values", "nested_object")
def list_of_lists(d: Draw) -> Node:
    def day(k: Column) -> Node:
        return node(d.name(1), [many(d.sub, d.name(2), lambda j: leaf(d.name(2), d.word(k, j)))], [Attr(d.name(3), d.word(k, "day"))])

    return d.root([many(d.n, d.name(1), day)])


@register("DeeplyNested", "nested_object", "simple_kv", wraps=False)
def deeply_nested(d: Draw) -> Node:
    v, levels = d.word("v"), F.sequence(F.lit(1), (d.depth - 1).cast("int"))
    opened = F.array_join(F.transform(levels, lambda k: cat("<", F.get(d.names, k), ">")), "")
    closed = F.array_join(F.transform(F.reverse(levels), lambda k: cat("</", F.get(d.names, k), ">")), "")
    js = F.array_join(F.transform(levels, lambda k: cat('{"', F.get(d.names, k), '":')), "")
    field = leaf(d.name(8), v)
    return Node(tagged(d.name(0), cat(opened, field.xml, closed)), d.name(0), cat(js, obj(field.member), F.repeat(F.lit("}"), (d.depth - 1).cast("int"))))


@register("ListOfNamespacedEntities", "list_of_objects", "namespace_handling", "attribute_to_kv", nests=False)
def namespaced_entities(d: Draw) -> Node:
    tag, inner = cat(d.name(1), ":", d.name(2)), cat(d.name(1), ":", d.name(3))
    return d.root([many(d.n, tag, lambda k: node(tag, [leaf(inner, d.word(k))], [Attr(d.name(4), d.ident(k))]))], [Attr(cat("xmlns:", d.name(1)), d.uri("ns"))])


@register("AttributedPropertyList", "attribute_to_kv", "list_of_values", "merged_object")
def attributed_property_list(d: Draw) -> Node:
    attrs = [Attr(d.name(1), d.word("a")), Attr(d.name(2), d.number(1, 100, "b")), Attr(d.name(3), F.initcap(d.boolean("c")), d.option("third"))]
    return d.root([many(d.n, d.name(4), lambda k: leaf(d.name(4), d.word(k)))], attrs)


@register("ListWithSpecialValues", "list_of_values", "type_casting")
def special_list(d: Draw) -> Node:
    def item(k: Column) -> Node:
        kind = draw_int(d.seed, 4, d.i, k, F.lit("kind"))
        kind = F.when(d.level == "easy", F.when(kind < 2, 0).otherwise(1)).otherwise(kind)  # words and nulls alone
        word = d.word(k)
        body = F.when(kind == 0, word).when(kind == 2, "true").when(kind == 3, "false").otherwise("")
        return Node(tagged(d.name(1), body), d.name(1), F.when(kind == 0, quoted(word)).when(kind == 1, "null").otherwise(body))

    return d.root([many(d.n, d.name(1), item)])


@register("NestedAttributedEntity", "nested_object", "attribute_to_kv", "merged_object")
def nested_attributed(d: Draw) -> Node:
    attrs = [Attr(d.name(2), d.word("a")), Attr(d.name(3), d.boolean("b")), Attr(d.name(4), d.ident("o"), d.option("more"))]
    return d.root([node(d.name(1), [leaf(d.name(5), d.word("g"))], attrs)])


@register("ListOfObjectsWithSpecialValues", "list_of_objects", "type_casting", "empty_element_to_null")
def special_objects(d: Draw) -> Node:
    def item(k: Column) -> Node:
        flag, noted = d.boolean(k, "flag"), ~d.chance(d.chance_of_option, k, "null")
        notes = Node(tagged(d.name(4), F.when(noted, d.sentence(k)).otherwise("")), d.name(4), F.when(noted, quoted(d.sentence(k))).otherwise("null"))
        return node(d.name(1), [leaf(d.name(2), d.word(k)), leaf(d.name(3), flag, flag), notes])

    return d.root([many(d.n, d.name(1), item)])


@register("NamespacedAttributes", "attribute_to_kv", "namespace_handling", nests=False)
def namespaced_attributes(d: Draw) -> Node:
    two, hard = d.level != "easy", d.level == "hard"
    spaces = [Attr(cat("xmlns:", d.name(1)), d.uri("n1")), Attr(cat("xmlns:", d.name(2)), cat(d.uri("n2"), ":2"), two)]
    attrs = [Attr(cat(d.name(1), ":", d.name(3)), d.ident("a")), Attr(cat(d.name(2), ":", d.name(4)), d.word("b"), two), Attr(d.name(5), F.initcap(d.boolean("r")), hard)]
    return d.root([leaf(d.name(6), d.sentence("f"))], [*spaces, *attrs])


@register("ListOfMixedContentObjects", "list_of_objects", "mixed_content")
def mixed_objects(d: Draw) -> Node:
    def item(k: Column) -> Node:
        rich, plain = d.option(k, "rich"), leaf(d.name(1), d.sentence(k))
        full = mixed(d.name(1), ["Start text. ", leaf(d.name(2), d.word(k)), " End text."])
        return Node(F.when(rich, full.xml).otherwise(plain.xml), d.name(1), F.when(rich, full.js).otherwise(plain.js))

    return d.root([many(d.n, d.name(1), item)])


@register("MixedPropertyGroup", "merged_object", "list_of_values", "simple_kv", "attribute_to_kv")
def mixed_group(d: Draw) -> Node:
    few = 2 + draw_int(d.seed, 3, d.i, F.lit("few"))
    singles = [leaf(d.name(3), d.number(100, 200, "s1")), leaf(d.name(4), d.word("s2")).only((d.level != "easy") & d.chance(0.5, "second"))]
    return d.root([many(few, d.name(2), lambda k: leaf(d.name(2), d.word(k))), *singles], [Attr(d.name(1), d.ident("a"))])


@register("AttributedObjectWithSpecialValues", "merged_object", "type_casting", "attribute_to_kv")
def special_object(d: Draw) -> Node:
    return d.root([leaf(d.name(2), "true", "true"), hollow(d.name(3))], [Attr(d.name(1), d.ident("a"))])


# ---- formats of the first and the mixed generator; attributes are plain members there, and text may become a number or a boolean

@register("AdvancedMixedContent", "mixed_content", "attribute_to_kv", "simple_kv", "namespace_handling", family="first", wraps=False, nests=False)
def advanced_mixed(d: Draw) -> Node:
    more, number = d.level != "easy", d.number(100, 500, "n")
    texts = [d.sentence("t1"), d.sentence("t2")]
    second, last = leaf(cat(d.name(2), "2"), number, number).only(more), d.sentence("t3")
    xml = tagged(d.name(0), cat(texts[0], " ", tagged(d.name(2), d.word("c")), " ", texts[1], " ", second.text, F.when(more, cat(" ", last)).otherwise("")), [Attr(d.name(1), d.ident("a"))])
    values = cat('"', d.name(3), '":[', F.array_join(F.array_compact(F.array(*map(quoted, texts), F.when(more, quoted(last)))), ","), "]")
    return Node(xml, d.name(0), obj(Attr(d.name(1), d.ident("a")).member(""), values, leaf(d.name(2), d.word("c")).member, second.member))


@register("SimplifiedListOfComplexEntities", "list_of_objects", "nested_object", family="mixed")
def simplified_entities(d: Draw) -> Node:
    return d.root([many(d.n, d.name(1), lambda k: node(d.name(1), [leaf(d.name(2), cat(d.word(k, "f"), " ", d.word(k, "l")))]))])


@register("ObjectWithList", "nested_object", "list_of_values", family="mixed")
def object_with_list(d: Draw) -> Node:
    return d.root([node(d.name(1), [many(d.n, d.name(2), lambda k: leaf(d.name(2), d.word(k)))])])


@register("SimpleList", "list_of_values", family="mixed")
def simple_list(d: Draw) -> Node:
    return d.root([many(d.n, d.name(1), lambda k: leaf(d.name(1), d.word(k)))])


@register("MixedFields", "simple_kv", "list_of_values", family="mixed")
def mixed_fields(d: Draw) -> Node:
    return d.root([leaf(d.name(1), d.sentence("f")), many(d.n, d.name(2), lambda k: leaf(d.name(2), d.word(k)))])


@register("Dictionary", "multi_kv", family="mixed", wraps=False)
def dictionary(d: Draw) -> Node:
    field = lambda k: leaf(cat(F.get(d.names, F.pmod(k, F.lit(NAMES)).cast("int")), "_", k.cast("string")), d.word(k))
    members = F.array_join(F.transform(F.sequence(F.lit(1), d.n.cast("int")), lambda k: field(k).member), ",")
    xml = F.array_join(F.transform(F.sequence(F.lit(1), d.n.cast("int")), lambda k: field(k).xml), "")
    return Node(tagged(d.name(0), xml), d.name(0), cat("{", members, "}"))


@register("ListOfComplexEntities", "list_of_objects", "attribute_to_kv", "boolean_casting", "numeric_casting", family="mixed", nests=False)
def complex_entities(d: Draw) -> Node:
    def item(k: Column) -> Node:
        flag, stock = d.boolean(k, "flag"), d.number(0, 500, k, "n")
        return node(d.name(1), [leaf(d.name(4), d.sentence(k)), leaf(d.name(5), stock, stock)], [Attr(d.name(2), F.left(d.ident(k), F.lit(8))), Attr(d.name(3), flag, js=flag)], at="")

    return d.root([many(d.n, d.name(1), item)])


@register("NestedConfig", "nested_object", "attribute_to_kv", "empty_element_to_bool", family="mixed", nests=False)
def nested_config(d: Draw) -> Node:
    active = d.boolean("active")
    return d.root([hollow(d.name(1), [Attr(d.name(3), active, js=active)], at=""), node(d.name(2), [leaf(d.name(4), cat(d.word("p1"), "/", d.word("p2")))]), node(d.name(5), [hollow(d.name(6), js="true")]).only(d.chance(d.chance_of_option, "more"))])


@register("EmptyElement", "simple_kv", "empty_element_to_null", "nested_object", family="mixed")
def empty_element(d: Draw) -> Node:
    return d.root([leaf(d.name(1), d.word("f")), hollow(d.name(2))])


@register("MixedContent", "attribute_to_kv", "simple_kv", family="mixed", nests=False)
def plain_mixed(d: Draw) -> Node:
    return d.root([leaf(d.name(2), d.word("c"))], [Attr(d.name(1), F.upper(F.left(d.ident("p"), F.lit(7))))], at="")


#: Named experiments as (formats to train on, formats held out).
EXPERIMENTS = {
    "master_curriculum": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "OrderedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "ProcessingInstructionNode", "EntityReferenceField", "HintedEmptyNode", "AttributePromotedKeyValueList", "ListOfAttributedEntities"],
        ["ListOfLists", "DeeplyNested", "ListOfNamespacedEntities"],
    ),
    "easy_master_curriculum": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "OrderedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "ProcessingInstructionNode", "EntityReferenceField", "HintedEmptyNode", "AttributePromotedKeyValueList", "ListOfAttributedEntities"],
        ["NestedAttributedEntity", "ListWithSpecialValues", "AttributedPropertyList", "ListOfObjectsWithSpecialValues", "NamespacedAttributes", "ListOfMixedContentObjects"],
    ),
    "easy_master_curriculum_2": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "OrderedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "ProcessingInstructionNode", "EntityReferenceField", "HintedEmptyNode", "AttributePromotedKeyValueList", "ListOfAttributedEntities"],
        ["NestedAttributedEntity", "ListWithSpecialValues", "AttributedPropertyList", "ListOfObjectsWithSpecialValues", "NamespacedAttributes", "ListOfMixedContentObjects", "MixedPropertyGroup", "AttributedObjectWithSpecialValues"],
    ),
    "easy_master_curriculum_3": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "OrderedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "ProcessingInstructionNode", "EntityReferenceField", "HintedEmptyNode", "AttributePromotedKeyValueList", "ListOfAttributedEntities", "MixedPropertyGroup", "AttributedPropertyList"],
        ["ListWithSpecialValues", "NamespacedAttributes", "ListOfMixedContentObjects", "AttributedObjectWithSpecialValues"],
    ),
    "foundations_plus_composition": (
        ["SingleField", "AttributedEntity", "PropertyList", "SpecialValues", "HintedEmptyNode", "NamespacedObject", "OrderedMixedContent", "CDataField", "ProcessingInstructionNode", "EntityReferenceField", "BasicEntity", "ListOfSimpleEntities", "ListOfAttributedEntities", "AttributedPropertyList", "MixedPropertyGroup", "AttributePromotedKeyValueList", "HeterogeneousList", "NestedAttributedEntity"],
        ["ListWithSpecialValues", "AttributedObjectWithSpecialValues", "NamespacedAttributes", "ListOfNamespacedEntities", "ListOfMixedContentObjects"],
    ),
    "nested_master_curriculum": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "OrderedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "EntityReferenceField", "HintedEmptyNode", "AttributePromotedKeyValueList", "ListOfAttributedEntities"],
        ["ListOfLists", "DeeplyNested", "ListOfNamespacedEntities"],
    ),
    "nested_easy_master_curriculum": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "OrderedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "EntityReferenceField", "HintedEmptyNode", "AttributePromotedKeyValueList", "ListOfAttributedEntities"],
        ["NestedAttributedEntity", "ListWithSpecialValues", "AttributedPropertyList", "ListOfObjectsWithSpecialValues", "NamespacedAttributes", "ListOfMixedContentObjects"],
    ),
    "easy_master_curriculum_2_nested": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "OrderedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "ProcessingInstructionNode", "EntityReferenceField", "HintedEmptyNode", "AttributePromotedKeyValueList", "ListOfAttributedEntities", "DeeplyNested"],
        ["NestedAttributedEntity", "ListWithSpecialValues", "AttributedPropertyList", "ListOfObjectsWithSpecialValues", "NamespacedAttributes", "ListOfMixedContentObjects"],
    ),
    "first_master_curriculum": (
        ["SingleField", "AttributedEntity", "BasicEntity", "PropertyList", "ListOfSimpleEntities", "AdvancedMixedContent", "SpecialValues", "NamespacedObject", "HeterogeneousList", "CDataField", "ProcessingInstructionNode", "EntityReferenceField", "AttributePromotedKeyValueList", "ListOfAttributedEntities"],
        ["ListOfLists", "DeeplyNested", "ListOfNamespacedEntities"],
    ),
    "nested_lists_with_dict": (
        ["PropertyList", "SimplifiedListOfComplexEntities", "ObjectWithList", "Dictionary"],
        ["ListOfLists"],
    ),
    "shape_combination": (
        ["SingleField", "SimpleList"],
        ["MixedFields"],
    ),
    "comprehensive_mix": (
        ["BasicEntity", "EmptyElement", "MixedContent", "PropertyList", "DeeplyNested", "NestedConfig", "SimpleList"],
        ["ListOfComplexEntities"],
    ),
    "nested_lists": (
        ["PropertyList", "SimplifiedListOfComplexEntities"],
        ["ListOfLists"],
    ),
    "nested_lists_easy": (
        ["PropertyList", "SimplifiedListOfComplexEntities", "ObjectWithList"],
        ["ListOfLists"],
    ),
}
#: Formats by intrinsic difficulty.
CLASSES = {"easy": ["BasicEntity", "EmptyElement", "MixedContent"], "medium": ["PropertyList", "DeeplyNested"], "hard": ["ListOfComplexEntities", "NestedConfig", "ListOfLists"]}
