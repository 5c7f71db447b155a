"""XML and the JSON it stands for, built together as string expressions.

A :class:`Node` is an element with its text and its JSON value; helpers put nodes together, so that a document
is described once. Text is taken to be free of characters that need escaping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def lit(x: Text) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def cat(*parts: Text) -> Column:
    return F.concat(*map(lit, parts))


def quoted(x: Text) -> Column:
    return cat('"', x, '"')


def joined(n: Column, each: Callable[[Column], Column], between: str = "") -> Column:
    """``each(1)`` to ``each(n)``, joined."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), each), between)


@dataclass(frozen=True)
class Node:
    xml: Column
    key: Text
    js: Column
    #: Whether it is there; None is always.
    there: Column | None = None

    def only(self, there: Column) -> Node:
        return replace(self, there=there)

    @property
    def text(self) -> Column:
        return self.xml if self.there is None else F.when(self.there, self.xml).otherwise("")

    @property
    def member(self) -> Column:
        made = cat('"', self.key, '":', self.js)
        return made if self.there is None else F.when(self.there, made)


@dataclass(frozen=True)
class Attr:
    name: Text
    value: Text
    there: Column | None = None
    js: Text | None = None
    #: False for a hint that the JSON doesn't show.
    shown: bool = True

    @property
    def text(self) -> Column:
        made = cat(" ", self.name, '="', self.value, '"')
        return made if self.there is None else F.when(self.there, made).otherwise("")

    def member(self, at: str) -> Column:
        made = cat('"', at, self.name, '":', self.js if self.js is not None else quoted(self.value))
        return made if self.there is None else F.when(self.there, made)


def obj(*members: Column) -> Column:
    """An object of the members that aren't null."""
    return cat("{", F.array_join(F.array_compact(F.array(*members)), ",") if members else "", "}")


def tagged(tag: Text, body: Text | None, attrs: list[Attr] = ()) -> Column:
    head = cat("<", tag, *(a.text for a in attrs))
    return cat(head, "/>") if body is None else cat(head, ">", body, "</", tag, ">")


def leaf(tag: Text, value: Text, js: Text | None = None) -> Node:
    return Node(tagged(tag, value), tag, quoted(value) if js is None else lit(js))


def hollow(tag: Text, attrs: list[Attr] = (), js: Text | None = None, at: str = "@") -> Node:
    """An element without content: null, or its attributes."""
    value = lit(js) if js is not None else obj(*(a.member(at) for a in attrs if a.shown)) if attrs else F.lit("null")
    return Node(tagged(tag, None, attrs), tag, value)


def node(tag: Text, kids: list[Node], attrs: list[Attr] = (), at: str = "@", more: list[Column] = ()) -> Node:
    """Attributes, then children by their keys; ``more`` are members that have no element."""
    return Node(tagged(tag, cat(*(k.text for k in kids)) if kids else "", attrs), tag, obj(*(a.member(at) for a in attrs if a.shown), *(k.member for k in kids), *more))


def many(n: Column, tag: Text, each: Callable[[Column], Node]) -> Node:
    """``n`` children of one tag: a list."""
    return Node(joined(n, lambda k: each(k).xml), tag, cat("[", joined(n, lambda k: each(k).js, ","), "]"))


def mixed(tag: Text, content: list[Node | Text], attrs: list[Attr] = (), at: str = "@") -> Node:
    """Text and children in order, as ``#content``; a list item may be left out by its node's condition."""
    parts = [c.text if isinstance(c, Node) else lit(c) for c in content]
    items = [c if isinstance(c, Node) else Node(lit(c), "", quoted(F.trim(lit(c)))) for c in content]
    shown = [F.when(c.there if c.there is not None else F.lit(True), c.js if isinstance(c.key, str) and not c.key else obj(replace(c, there=None).member)) for c in items]
    listed = cat('"#content":[', F.array_join(F.array_compact(F.array(*shown)), ","), "]")
    return Node(tagged(tag, cat(*parts), attrs), tag, obj(*(a.member(at) for a in attrs), listed))


def document(root: Node, prolog: Text = "") -> tuple[Column, Column]:
    return cat(prolog, root.xml), obj(root.member)
