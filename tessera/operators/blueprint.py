"""Blueprint chunking: a document becomes a tree of records, some with a small piece of XML; the pieces are converted
one by one, and the records put the results together again.

Records of a document, in pre-order: ``node`` (an element that was descended into), ``attributes`` (some of a node's
attributes, where all together are too many), ``batch`` (equal children under a wrapper) and ``leaf`` (an
element without children, whatever its size).

Defined results: a null or malformed document has no records; one that nests too deeply for the interpreter's JSON writer is put together as null; text beside child elements and instructions before the
root aren't carried; a piece without a result, or with one that doesn't parse, counts as ``{}`` and in ``n_missing``.
A namespace is declared on the root and on each piece that uses it.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .xmljson import _local, _parse, size_of

#: Values of ``type`` that stand for an empty value; such an attribute isn't put into a piece of its own.
EMPTY_HINTS = ("object", "list", "string", "boolean")
WRAPPER = "wrapper"
_RECORD = "array<struct<seq:int,parent:int,tag:string,kind:string,attributes:map<string,string>,n:int,chunk:string>>"
_ARROW = pa.list_(pa.struct([("seq", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("kind", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("n", pa.int32()), ("chunk", pa.string())]))


@dataclass(frozen=True)
class Limits:
    """Sizes at which attributes and batches of children are cut; a batch must stay under ``children``.

    With ``whole`` an element that isn't larger is one piece, whatever is in it.
    """

    children: int = 50
    attributes: int = 20
    whole: int | None = None


class _Writer:
    """Elements as text, under the document's own prefixes."""

    def __init__(self, prefixes: dict[str, str]):
        self._prefixes = prefixes

    def name(self, tag: str) -> str:
        return _local(tag, self._prefixes)

    def attributes(self, pairs) -> str:
        return "".join(f" {self.name(k)}={quoteattr(v)}" for k, v in pairs)

    def _inner(self, e: ET.Element) -> str:
        parts, todo = [], [e]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            name = self.name(x.tag)
            head = f"<{name}{self.attributes(x.attrib.items())}"
            if len(x) == 0 and not x.text:
                parts.append(f"{head}/>")
                continue
            parts.append(f"{head}>{escape(x.text or '')}")
            todo.append(f"</{name}>")
            for c in reversed(x):
                todo += [escape(c.tail or ""), c]
        return "".join(parts)

    def declared(self, names) -> str:
        used = {n.partition(":")[0] for n in names if ":" in n}
        return "".join(f" xmlns:{p}={quoteattr(u)}" for u, p in self._prefixes.items() if p in used)

    def names(self, e: ET.Element):
        return (self.name(x) for d in e.iter() for x in (d.tag, *d.attrib))

    def piece(self, e: ET.Element) -> str:
        text, at = self._inner(e), len(self.name(e.tag)) + 1
        return text[:at] + self.declared(self.names(e)) + text[at:]

    def wrapped(self, elements: list[ET.Element]) -> str:
        return f"<{WRAPPER}{self.declared(n for e in elements for n in self.names(e))}>{''.join(map(self._inner, elements))}</{WRAPPER}>"

    def hollow(self, tag: str, pairs) -> str:
        name = self.name(tag)
        return f"<{name}{self.declared([name, *(self.name(k) for k, _ in pairs)])}{self.attributes(pairs)}/>"


def _greedy(items: list, written: Callable[[list], str], limit: int, size) -> list[list]:
    """Runs of items; one is closed when the next item would take what is written over the limit."""
    runs: list[list] = []
    for item in items:
        if runs and size(written([*runs[-1], item])) <= limit:
            runs[-1].append(item)
        else:
            runs.append([item])
    return runs


def records(text: str | None, limits: Limits = Limits(), size=size_of) -> list[dict]:
    try:
        root, prefixes, _ = _parse(text or "")
        return _records(root, prefixes, limits, size)
    except (ET.ParseError, RecursionError):
        return []


def _records(root: ET.Element, prefixes: dict[str, str], limits: Limits, size) -> list[dict]:
    writer, out = _Writer(prefixes), []
    spaces = [(f"xmlns:{p}", u) for u, p in prefixes.items() if p]

    def add(parent, tag, kind, attributes=(), n=1, chunk=None) -> int:
        out.append({"seq": len(out), "parent": parent, "tag": tag, "kind": kind, "attributes": list(attributes), "n": n, "chunk": chunk})
        return len(out) - 1

    todo: list[tuple] = [(root, None)]  # elements to descend into, and batches, which are records as they are
    while todo:
        item, parent = todo.pop()
        if isinstance(item, dict):
            add(parent, **item)
            continue
        tag, pairs = writer.name(item.tag), list(item.attrib.items())
        own = spaces if item is root else []
        if limits.whole is not None and len(item) and not own and size(writer.piece(item)) <= limits.whole:
            add(parent, tag, "leaf", chunk=writer.piece(item))
            continue
        if len(item) == 0:
            if own:  # the root's declarations are a record of their own kind only if it is all there is
                at = add(parent, tag, "node", own)
                add(at, tag, "leaf", n=0, chunk=writer.piece(item))
            else:
                add(parent, tag, "leaf", chunk=writer.piece(item))
            continue
        apart = [p for p in pairs if not (p[0] == "type" and p[1] in EMPTY_HINTS)]
        if not apart or size(writer.hollow(item.tag, pairs)) <= limits.attributes:
            apart = []
        inline = [(writer.name(k), v) for k, v in pairs if not apart or (k, v) not in apart]
        at = add(parent, tag, "node", [*own, *inline])
        for run in _greedy(apart, lambda x, t=item.tag: writer.hollow(t, x), limits.attributes, size):
            add(at, tag, "attributes", n=len(run), chunk=writer.hollow(item.tag, run))
        groups: dict[str, list] = {}
        for c in item:
            groups.setdefault(c.tag, []).append(c)
        below: list[tuple] = []
        for name, group in groups.items():
            for run in _greedy(group, writer.wrapped, limits.children, size):
                piece = writer.wrapped(run)
                if size(piece) < limits.children:
                    below.append(({"tag": writer.name(name), "kind": "batch", "n": len(run), "chunk": piece}, at))
                else:
                    below += [(c, at) for c in run]
        todo += reversed(below)
    return out


def _result(record: dict, declared: set[str]):
    """What a piece's JSON holds under its key, without the declarations that it only repeats; and whether there is anything."""
    try:
        got = json.loads(record["json"] or "")
    except ValueError:
        return None, False
    key = WRAPPER if record["kind"] == "batch" else record["tag"]
    if not isinstance(got, dict):
        return got, True
    if key not in got:
        return None, False
    value = got[key]
    if isinstance(value, dict) and declared & value.keys():
        value = {k: v for k, v in value.items() if k not in declared}
        value = None if not value else value["#text"] if value.keys() == {"#text"} else value
    return value, True


def rebuilt(rows: list[dict]) -> tuple[str | None, int]:
    """The document's JSON from its records with their results, children before parents; and the pieces without a result."""
    if not rows:
        return None, 0
    rows = sorted(rows, key=lambda r: r["seq"])
    declared = {f"@{k}" for k, _ in rows[0]["attributes"] or () if k.startswith("xmlns:")}
    children: list[list[dict]] = [[] for _ in rows]
    for r in rows[1:]:
        children[r["parent"]].append(r)
    values: list = [None] * len(rows)
    missing = 0
    for r in reversed(rows):
        if r["kind"] != "node":
            value, there = _result(r, declared)
            missing += not there
            values[r["seq"]] = value if there else {}
            continue
        own: dict = {f"@{k}": v for k, v in r["attributes"] or ()}
        lists: dict[str, list] = {}
        for c in children[r["seq"]]:
            value = values[c["seq"]]
            if c["kind"] == "attributes" or (c["kind"] == "leaf" and c["n"] == 0):
                own |= value if isinstance(value, dict) else {} if value is None else {"#text": value}
            elif c["kind"] == "batch":
                for k, v in (value if isinstance(value, dict) else {}).items():
                    lists.setdefault(k, []).extend(v if c["n"] > 1 and isinstance(v, list) else [v])
            else:
                lists.setdefault(c["tag"], []).append(value)
        values[r["seq"]] = own | {k: v if len(v) > 1 else v[0] for k, v in lists.items()}
    try:
        return json.dumps({rows[0]["tag"]: values[0]}, ensure_ascii=False, separators=(",", ":")), missing
    except RecursionError:
        return None, missing


def blueprint(df: DataFrame, key: str, column: str, limits: Limits = Limits(), size=size_of) -> DataFrame:
    """``key, seq, parent, tag, kind, attributes, n, chunk``: one row a record; ``chunk`` is null for nodes."""

    def run(batches):
        for b in batches:
            made = [records(x, limits, size) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(made, _ARROW)], names=[key, "_records"])

    docs = df.select(key, column)
    schema = T.StructType([docs.schema[key], T.StructField("_records", T._parse_datatype_string(_RECORD))])
    return docs.mapInArrow(run, schema).select(key, F.inline("_records"))


def reassemble(records: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``key, json, n_missing`` from a :func:`blueprint` and ``key, seq, json`` of its pieces. A document's records meet in one task."""

    def run(batches):
        for b in batches:
            made = [rebuilt(x) for x in b.column("_records").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=[key, "json", "n_missing"])

    joined = records.drop("chunk").join(results.select(key, "seq", "json"), [key, "seq"], "left")
    grouped = joined.groupBy(key).agg(F.collect_list(F.struct("seq", "parent", "tag", "kind", "attributes", "n", "json")).alias("_records"))
    schema = T.StructType([grouped.schema[key], T.StructField("json", T.StringType()), T.StructField("n_missing", T.LongType())])
    return grouped.mapInArrow(run, schema)


def convert_by_pieces(df: DataFrame, key: str, column: str, infer: Callable[[DataFrame], DataFrame], limits: Limits = Limits(), size=size_of) -> DataFrame:
    """Split, convert each piece and reassemble. ``infer`` adds ``json`` to rows with ``chunk``."""
    parts = blueprint(df, key, column, limits, size)
    return reassemble(parts, infer(parts.filter("chunk IS NOT NULL").select(key, "seq", "chunk")), key)


def hollow_piece(e: ET.Element, prefixes: dict[str, str]) -> str:
    """An element's tag and attributes alone."""
    return _Writer(prefixes).hollow(e.tag, list(e.attrib.items()))


def entity_piece(e: ET.Element, prefixes: dict[str, str]) -> str:
    """An element whole if no child has children of its own; else with its children emptied."""
    if not any(len(c) for c in e):
        return _Writer(prefixes).piece(e)
    bare = ET.Element(e.tag, e.attrib)
    bare.text = e.text
    for c in e:
        ET.SubElement(bare, c.tag, c.attrib).text = None if len(c) else c.text
    return _Writer(prefixes).piece(bare)
