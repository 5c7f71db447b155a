import json
import re
import xml.etree.ElementTree as ET
from random import Random

import pytest
from pyspark.sql import functions as F

from tessera.operators import elements as E
from tessera.operators import xmljson as X


def document(rng, depth=0, deepest=6):
    """A random document: attributes, repeated tags, texts beside children, references, comments, sections."""
    tag = rng.choice(["a", "b", "item", "x-1", "ns.y"])
    own = "".join(f' {k}={q}{v}{q}' for k, q, v in rng.sample([("id", '"', "7 &amp; &#233;"), ("v", "'", 'say "x"'), ("e", '"', ""), ("z", '"', "a>b")], rng.randint(0, 3)))
    if rng.random() < 0.15:
        return f"<{tag}{own}/>"
    text = lambda: rng.choice(["", "", " \n", "word", " true ", "true", "1 &lt; 2 &amp;amp; &#x1F600;", "é ü", "<!-- c -->x<!-- <d> -->y", "<![CDATA[<raw> & ]]>", "\t\"q\"\\ "])
    kids = [document(rng, depth + 1, deepest) + text() for _ in range(rng.randint(0, 4 if depth < deepest else 0))]
    return f"<{tag}{own}>{text()}{''.join(kids)}</{tag}>"


BROKEN = {"<a><b></a></b>": "a start tag without its end", "</a><a/>": "an end tag without a start", "<a>": "a start tag without its end", "<a/><b/>": "several roots", "<a/>text": "text beside the root", "": "no element", "x": "no element", "<a>1 < 2</a>": "a stray <"}


@pytest.fixture(scope="module")
def documents():
    rng = Random(5)
    rows = [(i, rng.choice(["", '<?xml version="1.0"?>\n', "<!-- first -->", "<!DOCTYPE a>"]) + document(rng) + rng.choice(["", "\n", "<!-- last -->"])) for i in range(120)]
    deep = "<d>" * 40 + "x" + "</d>" * 40
    wide = "<w>" + "".join(f'<r n="{i}">{i}</r>' for i in range(3000)) + "</w>"
    return [*rows, (500, deep), (501, wide), *((600 + i, x) for i, x in enumerate(BROKEN)), (700, None)]


@pytest.fixture(scope="module")
def frame(spark, documents):
    return spark.createDataFrame(documents, "id long, xml string")


def tree(text):
    """(tag, level, place of the parent) of every element in order, by the standard parser."""
    out, todo = [], [(ET.fromstring(text), 1, None)]
    while todo:
        e, level, parent = todo.pop()
        out.append((e.tag, level, parent))
        todo += [(c, level + 1, len(out) - 1) for c in reversed(e)]
    return out


@pytest.mark.parametrize("block", [3, 10_000])
def test_elements_equal_the_parser(spark, frame, documents, block):
    rows = E.elements(E.nodes(frame, "id", "xml", block=block)).collect()
    for i, text in documents:
        if text is None or text in BROKEN:
            continue
        own = sorted((r for r in rows if r.key == i), key=lambda r: r.pos)
        place = {r.pos: n for n, r in enumerate(own)}
        assert [(r.tag, r.level, place.get(r.parent)) for r in own] == tree(text), text
        for r in own[:50]:
            assert ET.fromstring(text[r.begin : r.end]).tag == r.tag and text[r.begin : r.opened] == r.token


@pytest.mark.parametrize("block", [2, 10_000])
def test_faults(spark, frame, documents, block):
    found = {r.key: r.fault for r in E.faults(frame, "id", "xml", block=block).collect()}
    assert found == {i: BROKEN.get(t, "no element") if t is None or t in BROKEN else None for i, t in documents}


@pytest.mark.parametrize("block", [50, 10_000])
def test_json_equals_convert(spark, frame, documents, block):
    found = {r.key: r.json for r in E.to_json(frame, "id", "xml", block=block, fold=3).collect()}
    texts = {i: t for i, t in documents if t is not None and t not in BROKEN}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        expected = X.convert(text)
        assert json.loads(found[i]) == json.loads(expected), text
        assert found[i] == expected or "\\" in expected


def test_html(spark):
    page = '<!DOCTYPE html><HTML><head><meta charset=utf-8><title>T &amp; U</title><script>if (a < b) "</p>"; </script></head><body><p class=x>One<br>two</p><p/></body></html>'
    frame = spark.createDataFrame([(1, page)], "id long, html string")
    assert E.faults(frame, "id", "html", html=True).first().fault is None
    assert json.loads(E.to_json(frame, "id", "html", html=True).first().json) == {"html": {
        "head": {"meta": {"@charset": "utf-8"}, "title": "T & U", "script": 'if (a < b) "</p>";'}, "body": {"p": [{"@class": "x", "#content": ["One", {"br": None}, "two"]}, None]},
    }}


def test_structural_joins(spark, frame, documents):
    own = E.elements(E.nodes(frame, "id", "xml"))
    pairs = {(r.key, r.ancestor, r.descendant): r.levels for size in (4,) for r in E.inside(own, own, size).collect()}
    assert pairs == {(r.key, r.ancestor, r.descendant): r.levels for r in E.inside(own, own, 10_000).collect()}
    rows = [r for r in own.collect() if r.key < 500]
    by = {(r.key, r.pos): r for r in rows}
    above = {}
    for r in rows:
        p = by.get((r.key, r.parent))
        while p is not None:
            above[r.key, p.pos, r.pos] = r.level - p.level
            p = by.get((p.key, p.parent))
    assert {k: v for k, v in pairs.items() if k[0] < 500} == above
    items = own.filter("tag = 'item'")
    near = {(r.key, r.descendant): r.ancestor for r in E.nearest(items, own, 8).collect() if r.key < 500}
    assert near == {(k, d): max(a for kk, a, dd in above if (kk, dd) == (k, d) and by[k, a].tag == "item") for k, d in {(k, d) for k, a, d in above if by[k, a].tag == "item"}}
    found = sorted((r.key, r.fragment) for r in E.slices(frame, "id", "xml", items).collect() if r.key < 500)
    assert len(found) == sum(len(ET.fromstring(t).findall(".//item")) + (ET.fromstring(t).tag == "item") for i, t in documents if i < 500)
    assert all(re.match("<item", f) for _, f in found)
    simple = {(r.key, r.pos) for r in E.simple(E.nodes(frame, "id", "xml")).collect() if r.key < 500}
    kids = {k: [r for r in rows if (r.key, r.parent) == k] for k in by}
    assert simple == {k for k in by if not any(kids[c.key, c.pos] for c in kids[k])}


def test_empty(spark, frame):
    none = frame.limit(0)
    assert E.nodes(none, "id", "xml").count() == E.faults(none, "id", "xml").count() == E.to_json(none, "id", "xml").count() == 0


def test_json_in_a_row_equals_json_by_levels(spark, frame):
    odd = ["<a>\xa0</a>", "<a/>\xa0", "<a> </a> \n", "<a><![CDATA[ ]]></a>", "<a/><![CDATA[ ]]>", "<a>x<?p?>y<b/>z<!-- --></a>", "<?p?>", "</a>", "<a></b>", "<a", "<a><b/><c/><b>true</b></a>", "<a>&#32;x&bad;&#0;</a>", "<a/>&#32;", "<a b='1'/>" * 2]
    some = frame.filter("id not in (500, 501)").unionByName(spark.createDataFrame([(800 + i, x) for i, x in enumerate(odd)], "id long, xml string"))
    by_level = {r.key: r.json for r in E.to_json(some, "id", "xml", row=-1).collect()}
    assert len(by_level) > 120
    for row in (20, 1_000_000):  # some documents of either kind, and all in their rows
        rows = E.to_json(some, "id", "xml", row=row).collect()
        assert len(rows) == len(by_level) and {r.key: r.json for r in rows} == by_level


def test_short_documents_are_not_shuffled(spark):
    """tokens of short documents were shuffled and written several times, which took more disk than there was at 6 GB."""
    shop = spark.range(2000).selectExpr("id", "concat('<o n=\"', id, '\"><l>', id, '</l><l/>text</o>') AS xml")
    made = E.to_json(shop, "id", "xml")
    assert made.filter("key = 7").first().json == '{"o":{"@n":"7","#content":[{"l":"7"},{"l":null},"text"]}}'
    assert made.count() == 2000
    assert not re.search("Exchange|Window|Generate|Join", made._jdf.queryExecution().executedPlan().toString())


def plain(rng, depth=0):
    """A random document without references and sections, with faults now and then."""
    tag = rng.choice(["a", "b", "item", "x-1", "n:z", "true"])
    own = "".join(f' {k}="{v}"' for k, v in rng.sample([("id", "7 é"), ("v", ""), ("e", "a=b c"), ("z-1", "x/"), ("q", " a"), ("y", "b="), ("n:u", "\\n"), ("t", "li\nne"), ("r", "$1 '")], rng.choice([0, 0, 1, 3])))
    if rng.random() < 0.2:
        return f"<{tag}{own}{rng.choice(['/', ' /', ''])}>"
    text = lambda: rng.choice(["", "", "", " \n", "word", " true ", "false", "é \U0001f600", "x<!-- c -->y", 'a\n<!-- "q" -->\tb', "back\\slash $1", "{a:b},", "a=b", "it's", "<?pi a?>", "null"])
    kids = [plain(rng, depth + 1) + text() for _ in range(rng.randint(0, 4 if depth < 4 else 0))]
    return f"<{tag}{own}>{text()}{''.join(kids)}</{tag}>"


def test_plain_documents_as_text_equal_those_by_tokens(spark):
    rng = Random(3)
    odd = ["<a/ >", "<a\t/>", "<a></b>", "a</a>", "a>b</a>", "<a/></a>", "<a/>\xa0", "<a/>x", "<a/><a/>", "<!---->\n<a/>", "<!---><a/>-->", "<?>?><a/>", "<!DOCTYPE a><a/>", '<a b="1"c="2"/>', '<a  b="1"/>', '<a b="" c="\1">\2</a>', "", None]
    frame = spark.createDataFrame([(x,) for x in [*odd, *(plain(rng) for _ in range(600))]], "xml string").repartition(4)
    x = F.col("xml")
    for booleans in (True, False):
        rows = frame.select("xml", (~x.rlike(E._OTHERS) & x.rlike(E.PLAIN)).alias("plain"), E._folded(x, booleans).alias("a"), E._by_token(x, E._scalar(booleans)).alias("b")).collect()
        assert all(r.a == r.b for r in rows)
        assert min(sum(bool(r.plain) is p and (r.b is None) is n for r in rows) for p in (True, False) for n in (True, False)) > 5  # each kind occurs


def test_plain_documents_are_not_folded_by_tokens(spark, monkeypatch):
    """a step for every token took half a millisecond a document, and as often as the result was read."""
    monkeypatch.setattr(E, "_by_token", lambda text, scalar: F.lit(None).cast("string"))
    shop = spark.range(300).selectExpr("id", "concat('<o n=\"', id, '\"><s>F</s><!-- l --><l><i p=\"1\" n=\"2\">', id, '</i><i/></l>text</o>') AS xml")
    made = E.to_json(shop, "id", "xml")
    assert {r.key: r.json for r in made.collect()} == {i: f'{{"o":{{"@n":"{i}","#content":[{{"s":"F"}},{{"l":{{"i":[{{"@p":"1","@n":"2","#text":"{i}"}},null]}}}},"text"]}}}}' for i in range(300)}
    assert "aggregate(" not in made._jdf.queryExecution().executedPlan().toString()
