"""XML to JSON, budgeted splitting, reassembly, indentation and tag search. Trees have no relational form: these run document
by document in Arrow batches, without recursion, so documents may nest as deeply as they like.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import parses, repair_json

DECLARATION = '<?xml version="1.0" encoding="utf-8"?>\n'
#: What an empty element with such a ``type`` stands for.
HINTS = {"object": "{}", "list": "[]", "string": '""', "boolean": "false"}


def _local(tag: str, prefixes: dict[str, str]) -> str:
    if tag.startswith("{"):
        uri, name = tag[1:].split("}")
        return f"{prefixes[uri]}:{name}" if prefixes.get(uri) else name
    return tag


def _parse(text: str):
    """Root, namespaces and instructions before the root. The parser itself refuses entities that expand beyond measure."""
    parser = ET.XMLPullParser(("start-ns", "start", "pi"))
    parser.feed(text)
    parser.close()
    prefixes, notes, root = {}, [], None
    for kind, item in parser.read_events():
        if kind == "start-ns":
            prefixes.setdefault(item[1], item[0])
        elif kind == "pi":
            notes.append(item.text)
        elif root is None:
            root = item
    return root, prefixes, notes


def _bottom_up(root: ET.Element) -> list[ET.Element]:
    """All elements, children before parents."""
    order, todo = [], [root]
    while todo:
        order.append(todo.pop())
        todo.extend(order[-1])
    return order[::-1]


@dataclass(frozen=True)
class Style:
    """How JSON is written: with compact or spaced separators, and other scripts as they are or escaped."""

    comma: str = ","
    colon: str = ":"
    ascii: bool = False

    def text(self, x: str) -> str:
        return json.dumps(x, ensure_ascii=self.ascii)

    def object(self, members: dict[str, str]) -> str:
        return "{" + self.comma.join(self.text(k) + self.colon + v for k, v in members.items()) + "}"

    def array(self, items: list[str]) -> str:
        return "[" + self.comma.join(items) + "]"


COMPACT = Style()
SPACED = Style(", ", ": ", True)


def _scalar(text: str, booleans: bool, numbers: bool, style: Style) -> str:
    if booleans and text in ("true", "false"):
        return text
    if numbers and re.fullmatch(r"-?(0|[1-9][0-9]{0,17})", text):
        return text
    return style.text(text)


def _promoted(e: ET.Element) -> bool:
    """Are there several children, all of one tag, empty, with the same two attributes?"""
    first = e[0]
    return len(e) > 1 and all(c.tag == first.tag and len(c) == 0 and not (c.text or "").strip() and len(c.attrib) == 2 and c.attrib.keys() == first.attrib.keys() for c in e)


def convert(text: str | None, booleans: bool = True, numbers: bool = False, promote: bool = False, style: Style = COMPACT) -> str | None:
    """One document as JSON; null if it isn't well-formed.

    Attributes are ``@name``, two or more equal tags a list, an empty element null or what its ``type`` says, text
    beside children ``#content`` in order, instructions before the root ``_processing_instructions``.
    ``numbers`` makes whole numbers of text; ``promote`` makes rows of two attributes one object, the last of equal keys staying.
    """
    try:
        root, prefixes, notes = _parse(text or "")
    except ET.ParseError:
        return None
    name = {}  # of each tag and attribute, once
    of = lambda tag: name.get(tag) or name.setdefault(tag, _local(tag, prefixes))
    scalar = lambda x: _scalar(x, booleans, numbers, style)
    values: dict[ET.Element, dict[str, str] | str] = {}
    written = lambda v: v if isinstance(v, str) else style.object(v)
    for e in _bottom_up(root):
        own = {f"@{of(k)}": style.text(v) for k, v in e.attrib.items()}
        if e is root:
            own = {f"@xmlns:{p}": style.text(u) for u, p in prefixes.items() if p} | own
        inside = (e.text or "").strip()
        tails = [(c.tail or "").strip() for c in e]
        if len(e) == 0:
            hint = HINTS.get(e.attrib.get("type", ""))
            if hint and not inside:
                values[e] = hint if booleans or hint != "false" else style.text("false")
            elif not own:
                values[e] = scalar(inside) if inside else "null"
            else:
                values[e] = own | ({"#text": scalar(inside)} if inside else {})
        elif inside or any(tails):
            content = [style.text(inside)] if inside else []
            for c, tail in zip(e, tails, strict=True):
                content.append(style.object({of(c.tag): written(values.pop(c))}))
                content += [style.text(tail)] if tail else []
            values[e] = own | {"#content": style.array(content)}
        elif promote and not own and _promoted(e):
            rows = [[*c.attrib.values()] for c in e]
            values[e] = {k: style.text(v) for k, v in rows}
        else:
            groups: dict[str, list[str]] = {}
            for c in e:
                groups.setdefault(of(c.tag), []).append(written(values.pop(c)))
            values[e] = own | {k: v[0] if len(v) == 1 else style.array(v) for k, v in groups.items()}
    value = values[root]
    if notes:
        told = [(n.split(None, 1) + [""])[:2] for n in notes]
        beside = value if isinstance(value, dict) else {} if value == "null" else {"#text": value}
        value = beside | {"_processing_instructions": style.array([style.object({k: style.text(v)}) for k, v in told])}
    return style.object({of(root.tag): written(value)})


# ---- splitting

def size_of(text: str) -> int:
    return len(text)


@dataclass
class Outline:
    """A document written once, with the place of every element in it: any subtree is a slice of the text."""

    text: str = ""
    tags: list[str] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)
    #: End of the start tag, begin of the end tag, end; all of an empty element are its end.
    opened: list[int] = field(default_factory=list)
    closing: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    spaces: dict[str, str] = field(default_factory=dict)

    def piece(self, a: int, b: int) -> str:
        """A slice, declaring the prefixes that it uses: its first tag must be an element's start."""
        return self.declared(self.text[a:b])

    def declared(self, made: str) -> str:
        used = {p for x in _PREFIXES.findall(made) for p in x if p} & self.spaces.keys() if self.spaces else ()
        if not used:
            return made
        at = _HEAD.match(made).end()
        return made[:at] + "".join(f" xmlns:{p}={quoteattr(self.spaces[p])}" for p in sorted(used) if f" xmlns:{p}=" not in made) + made[at:]


_HEAD = re.compile(r"<[^\s/>]+")
_PREFIXES = re.compile(r"<([\w.-]+):|\s([\w.-]+):[\w.-]+=")


def outline(text: str) -> Outline:
    root, prefixes, _ = _parse(text)
    out, parts, at = Outline(spaces={p: u for u, p in prefixes.items() if p}), [], 0

    def add(x: str) -> None:
        nonlocal at
        parts.append(x)
        at += len(x)

    todo: list = [(root, -1)]
    while todo:
        item, parent = todo.pop()
        if isinstance(item, str):  # text between elements, or the end of the element
            if parent >= 0:
                out.closing[parent] = at
                add(item)
                out.end[parent] = at
            else:
                add(item)
            continue
        i, tag = len(out.tags), _local(item.tag, prefixes)
        attrs = {_local(k, prefixes): v for k, v in item.attrib.items()}
        out.tags.append(tag)
        out.attributes.append(attrs)
        out.children.append([])
        if parent >= 0:
            out.children[parent].append(i)
        out.begin.append(at)
        head = f"<{tag}" + "".join(f" {k}={quoteattr(v)}" for k, v in attrs.items())
        empty = len(item) == 0 and not item.text
        add(head + ("/>" if empty else ">"))
        for places in (out.opened, out.closing, out.end):
            places.append(at)
        if empty:
            continue
        add(escape(item.text or ""))
        todo.append((f"</{tag}>", i))
        for c in reversed(item):
            if c.tail:
                todo.append((escape(c.tail), -1))
            todo.append((c, i))
    out.text = "".join(parts)
    return out


def chunks(text: str | None, budget: int, size: Callable[[str], int] = size_of, unit: Callable[[str, dict], bool] | None = None, declaration: bool = False) -> list[tuple[str, str]]:
    """(piece, path of its element's ancestors) within the budget, in document order.

    What fits stays whole. Of an element that doesn't, its children - with the text that follows them - are gathered, as many as
    fit, inside the element's own start and end tag; a child that is too big alone is split in its turn, and one
    without children stands alone however big it is. With ``unit``, a function of tag and attributes, pieces
    are units and what is gathered inside them; an element that is none is only looked into. A malformed document has no pieces;
    one without any unit is a piece as a whole.
    """
    try:
        doc = outline(text or "")
    except ET.ParseError:
        return []
    first = DECLARATION if declaration else ""
    out: list[tuple[str, str]] = []
    todo: list[tuple] = [(0, "")]  # an element to place, or a finished piece
    while todo:
        v, path = todo.pop()
        if isinstance(v, str):
            out.append((v, path))
            continue
        inner = f"{path}/{doc.tags[v]}" if path else doc.tags[v]
        if unit and not unit(doc.tags[v], doc.attributes[v]):
            todo += [(c, inner) for c in reversed(doc.children[v])]
            continue
        whole = first + doc.piece(doc.begin[v], doc.end[v])
        if size(whole) <= budget or not doc.children[v]:
            out.append((whole, path))
            continue
        head, tail = doc.text[doc.begin[v] : doc.opened[v]], doc.text[doc.closing[v] : doc.end[v]]
        kids = doc.children[v]
        ends = [*(doc.begin[k] for k in kids[1:]), doc.closing[v]]
        items = [(None, doc.opened[v], doc.begin[kids[0]])] * (doc.begin[kids[0]] > doc.opened[v]) + [(k, doc.begin[k], e) for k, e in zip(kids, ends, strict=True)]
        room, made, gathered = budget - size(first + doc.declared(head + tail)), [], []

        def close() -> None:
            if gathered:
                body = doc.text[gathered[0][1] : gathered[-1][2]]
                made.append((first + doc.declared(head + body + tail), path))
                gathered.clear()

        used = 0
        for k, a, b in items:
            need = size(doc.text[a:b])
            if need > room and k is not None and (need > budget or doc.children[k]):
                close()
                made.append((k, inner))
                used = 0
                if b > doc.end[k]:  # the text that follows it starts the next piece
                    gathered.append((None, doc.end[k], b))
                    used = size(doc.text[doc.end[k] : b])
                continue
            if used + need > room:
                close()
                used = 0
            gathered.append((k, a, b))
            used += need
        close()
        todo += reversed(made)
    return out or [(first + doc.piece(0, len(doc.text)), "")]


# ---- putting together

def combined(values: list, clash: str = "collect", legacy: bool = False):
    """Any number of JSON values as one: objects by key, lists one after the other.

    What else meets is collected in a list, or with ``clash="last"`` gives way to the last. Equal attributes (``@name``)
    of objects are one unless ``legacy``: pieces of one element repeat them.
    """
    if clash == "last":
        kind = type(values[-1]) if isinstance(values[-1], (dict, list)) else None
        at = next((i for i in range(len(values), 0, -1) if type(values[i - 1]) is not kind), 0)
        values = values[at:] if kind else values[-1:]
    lead = next((i for i, v in enumerate(values) if not isinstance(v, dict)), len(values))
    out = values[0]
    if lead > 1:
        by_key: dict[str, list] = {}
        for v in values[:lead]:
            for k, x in v.items():
                by_key.setdefault(k, []).append(x)
        if not legacy:
            for k, x in by_key.items():
                if k.startswith("@") and all(type(y) is type(x[0]) and y == x[0] for y in x):
                    del x[1:]
        out = {k: combined(x, clash, legacy) for k, x in by_key.items()}
    if max(lead, 1) == len(values):
        return out
    listed = [*out] if isinstance(out, list) else [out]
    for v in values[max(lead, 1) :]:
        listed += v if isinstance(v, list) else [v]
    return listed


def stitched(fragments: list[str | None], legacy: bool = False) -> str:
    """JSON texts as one; what doesn't parse is passed over; a single list stands for its items; nothing is ``{}``."""
    values = []
    for text in fragments:
        try:
            values.append(json.loads(text or ""))
        except (ValueError, RecursionError):
            continue
    if len(values) == 1 and isinstance(values[0], list):
        values = values[0]
    return json.dumps(combined(values, legacy=legacy) if values else {}, ensure_ascii=False, separators=(",", ":"))


def overlaid(fragments: list[str | None]) -> str:
    """JSON texts as one, later scalars in place of earlier ones; one that doesn't parse leaves ``__error_N`` with its text."""
    values, failed = [], {}
    for i, text in enumerate(fragments):
        try:
            values.append(json.loads(text or ""))
        except (ValueError, RecursionError):
            failed[f"__error_{i}"] = text
    out = combined(values, "last") if values else {}
    if failed:
        out = (out if isinstance(out, dict) else {"#value": out}) | failed
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


# ---- indentation and search

def indented(text: str | None, step: int = 2) -> str | None:
    """The document on lines of their own, mixed content as it is; a malformed one unchanged."""
    try:
        doc = outline(text or "")
    except ET.ParseError:
        return text
    out, todo = [], [(0, 0)]
    while todo:
        v, depth = todo.pop()
        pad = " " * (step * depth)
        if isinstance(v, str):
            out.append(pad + v)
            continue
        kids = doc.children[v]
        edges = [doc.opened[v], *(x for k in kids for x in (doc.begin[k], doc.end[k])), doc.closing[v]]
        if not kids or any(doc.text[a:b].strip() for a, b in zip(edges[::2], edges[1::2], strict=True)):
            out.append(pad + doc.text[doc.begin[v] : doc.end[v]].strip())
            continue
        out.append(pad + doc.text[doc.begin[v] : doc.opened[v]])
        todo.append((doc.text[doc.closing[v] : doc.end[v]], depth))
        todo += [(k, depth + 1) for k in reversed(kids)]
    if doc.spaces:
        out[0] = doc.declared(doc.text)[: len(doc.declared(doc.text)) - len(doc.text) + doc.opened[0]] if len(out) > 1 else doc.declared(out[0])
    return "\n".join(out)


def unevenly_indented(text: str | None, noise: str) -> str | None:
    """Line feeds and a number of spaces, drawn from the hex digits of ``noise``, after tags that other tags follow; text stays as it is."""
    at = iter(range(1 << 62))
    width = lambda: int(noise[next(at) % len(noise)], 16) % 9
    return text and re.sub(r">\s*(?=<)(?!</[^>]*>\s*$)", lambda _: ">\n" + " " * width(), text)


def found(text: str | None, tag: str) -> list[str]:
    """Every element of that tag, with a declaration, outer ones before inner ones."""
    try:
        doc = outline(text or "")
    except ET.ParseError:
        return []
    return [DECLARATION + doc.piece(doc.begin[v], doc.end[v]) for v in range(1, len(doc.tags)) if doc.tags[v] == tag]


def is_simple(text: str | None) -> bool | None:
    """Has no child of the root children of its own? Null for a malformed document."""
    try:
        doc = outline(text or "")
    except ET.ParseError:
        return None
    return not any(doc.children[c] for c in doc.children[0])


# ---- DataFrame forms

def _rows(column: str, name: str, fn, arrow):
    def run(batches):
        for b in batches:
            made = pa.array([fn(x) for x in b.column(column).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, name])

    return run


def _mapped(df: DataFrame, column: str, name: str, fn, kind: T.DataType, arrow) -> DataFrame:
    return df.mapInArrow(_rows(column, name, fn, arrow), T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def to_json(df: DataFrame, column: str, name: str = "json", booleans: bool = True, **options) -> DataFrame:
    """``df`` with each document of ``column`` converted; malformed ones are null, never an error."""
    return _mapped(df, column, name, lambda x: convert(x, booleans, **options), T.StringType(), pa.string())


def split_documents(df: DataFrame, column: str, budget: int, size: Callable[[str], int] = size_of, unit: Callable[[str, dict], bool] | None = None, declaration: bool = False) -> DataFrame:
    """One row a chunk: ``chunk_seq, chunk, path`` beside the other columns."""
    if budget <= 50:
        raise ValueError("a budget must be over 50")
    kind = T.ArrayType(T.StructType([T.StructField("chunk", T.StringType()), T.StructField("path", T.StringType())]))
    arrow = pa.list_(pa.struct([("chunk", pa.string()), ("path", pa.string())]))
    pieces = lambda x: [{"chunk": c, "path": p} for c, p in chunks(x, budget, size, unit, declaration)]
    return _mapped(df, column, "_chunks", pieces, kind, arrow).select(*df.columns, F.posexplode("_chunks").alias("chunk_seq", "c")).select(*df.columns, "chunk_seq", "c.chunk", "c.path")


def _fragments(df: DataFrame, key: str, order: str, fragment: str, repair: bool) -> DataFrame:
    text = F.col(fragment)
    if repair:
        text = F.coalesce(F.when(parses(text), text), repair_json(text), text)
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("f")))), lambda s: s["f"]).alias("_fragments"))


def stitch(df: DataFrame, key: str, order: str, fragment: str, repair: bool = True, legacy: bool = False) -> DataFrame:
    """Fragments of each key merged in order: as they are, else mended, else passed over. A document's fragments meet in one task."""
    return _mapped(_fragments(df, key, order, fragment, repair), "_fragments", "json", lambda x: stitched(x or [], legacy), T.StringType(), pa.string()).drop("_fragments")


def overlay(df: DataFrame, key: str, order: str, fragment: str) -> DataFrame:
    """Fragments of each key merged in order, later scalars in place of earlier ones."""
    return _mapped(_fragments(df, key, order, fragment, False), "_fragments", "json", lambda x: overlaid(x or []), T.StringType(), pa.string()).drop("_fragments")


def pretty(df: DataFrame, column: str, name: str = "pretty", step: int = 2) -> DataFrame:
    return _mapped(df, column, name, lambda x: indented(x, step), T.StringType(), pa.string())


def uneven(df: DataFrame, column: str, noise: Column, name: str = "uneven") -> DataFrame:
    """``noise`` is a hex digest a row, as :func:`tessera.functions.columns.draw` gives it."""
    struct = df.withColumn("_pair", F.struct(F.col(column).alias("x"), noise.alias("n")))
    return _mapped(struct, "_pair", name, lambda p: unevenly_indented(p["x"], p["n"]), T.StringType(), pa.string()).drop("_pair")


def find_elements(df: DataFrame, column: str, tag: str) -> DataFrame:
    """One row an element: ``element_seq, element`` beside the other columns."""
    made = _mapped(df, column, "_found", lambda x: found(x, tag), T.ArrayType(T.StringType()), pa.list_(pa.string()))
    return made.select(*df.columns, F.posexplode("_found").alias("element_seq", "element"))


def element(tag: str, body: Column, **attributes: Column) -> Column:
    """``<tag a="..">body</tag>`` as a string expression; text must be escaped already."""
    parts = [F.lit(f"<{tag}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k}="'), v, F.lit('"')]
    return F.concat(*parts, F.lit(">"), body, F.lit(f"</{tag}>"))
