import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import blueprint as B
from tessera.operators import curation as U
from tessera.operators import generate as G
from tessera.operators import scoring as S
from tessera.operators import xmljson as X
from tessera.sources import datasets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "xml, want",
    [
        ("<r><a>007</a><a>x</a></r>", {"r": {"a": ["007", "x"]}}),
        ('<r k="1"><a/><b>true</b></r>', {"r": {"@k": "1", "a": None, "b": True}}),
        ("<r>one<b>2</b>three</r>", {"r": {"#content": ["one", {"b": "2"}, "three"]}}),
        ('<r xmlns:p="u"><p:c>v</p:c></r>', {"r": {"@xmlns:p": "u", "p:c": "v"}}),
        ('<r><f type="list"/><g type="other"/></r>', {"r": {"f": [], "g": {"@type": "other"}}}),
        ("<?go now?><r><a>1</a></r>", {"r": {"a": "1", "_processing_instructions": [{"go": "now"}]}}),
        ('<!DOCTYPE r [<!ENTITY e "z">]><r><a>&e;</a></r>', {"r": {"a": "z"}}),
        ("<r/>", {"r": None}),
        ("<r><a></r>", None),
        (None, None),
    ],
)
def test_convert(xml, want):
    got = X.convert(xml)
    assert (json.loads(got) if got else None) == want


def test_chunks_fit_and_stitch(spark):
    leaves = "".join(f"<item><name>n{i}</name><size>{i}</size></item>" for i in range(40))
    doc = f'<shop id="7">{leaves}</shop>'
    parts = [p for p, _ in X.chunks(doc, 200)]
    assert len(parts) > 5 and all(len(p) <= 200 for p in parts)
    df = X.to_json(spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "doc long, seq int, chunk string"), "chunk")
    got = json.loads(X.stitch(df, "doc", "seq", "json").first().json)
    assert got["shop"]["item"] == json.loads(X.convert(doc))["shop"]["item"]
    assert X.chunks("<a><b", 100) == [] and X.chunks(f"<a><b>{'x' * 300}</b></a>", 100) == [(f"<b>{'x' * 300}</b>", "a")]


def test_merges():
    assert X.combined([{"a": 1, "b": {"c": 1}}, {"a": 1, "b": {"d": 2}}]) == {"a": [1, 1], "b": {"c": 1, "d": 2}}
    assert X.combined([[1], 2]) == [1, 2] and X.combined([1, [2]]) == [1, 2] and X.combined([1, {"a": 1}, {"b": 2}]) == [1, {"a": 1}, {"b": 2}]
    assert X.combined([{"a": 1}, {"b": 2}, 3]) == [{"a": 1, "b": 2}, 3]
    assert X.combined([{"@k": 1}, {"@k": 1}]) == {"@k": 1} and X.combined([{"@k": 1}, {"@k": 1}], legacy=True) == {"@k": [1, 1]} and X.combined([{"@k": 1}, {"@k": 2}]) == {"@k": [1, 2]}
    assert X.combined([{"a": 1, "b": [1]}, {"a": 2, "b": [2]}], "last") == {"a": 2, "b": [1, 2]} and X.combined([[1], {"a": 1}, {"a": 2}], "last") == {"a": 2}
    assert X.stitched(['[{"a":1},{"a":2}]']) == '{"a":[1,2]}' and X.stitched(["x", None]) == "{}"


@pytest.mark.parametrize(
    "broken, want",
    [('{"a": 1}', {"a": 1}), ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}), ('{"a": [1, 2,], }', {"a": [1, 2]}), ('{"a": "}"', {"a": "}"}), ('{"a": 1}/>', {"a": 1}), ('{k="v"}', {"k": "v"}), ("not json", None)],
)
def test_repair(spark, broken, want):
    got = one(spark, C.repair_json(F.lit(broken)))
    assert (json.loads(got) if got else None) == want


def test_columns(spark):
    assert one(spark, C.minify(F.lit(" \n a  b\nc "))) == "abc"
    assert one(spark, C.mask_labels(C.pad_truncate(F.array(F.lit(5), F.lit(6)), 4))) == [5, 6, -100, -100]
    assert one(spark, C.attention_mask(F.array(F.lit(5), F.lit(6)), 3)) == [1, 1, 0]
    assert one(spark, C.unmask_labels(F.array(F.lit(-100), F.lit(6)))) == [0, 6]
    assert one(spark, C.greedy_groups(F.array(*map(F.lit, ["aaa", "bb", "c", "dddddddd", "e"])), 5)) == [0, 0, 1, 2, 3]
    assert one(spark, C.instruct_prompt(F.lit("do"), F.lit(""))) == "### Instruction:\ndo\n"
    assert one(spark, C.prefix_keys(F.create_map(F.lit("a"), F.lit("b")))) == {"@a": "b"}


def test_bins(spark):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "length int")
    count = lambda xs: {r.complexity: r.n for r in U.with_bins(frame(xs), "length", U.bin_edges(frame(xs), "length")).groupBy("complexity").agg(F.count("*").alias("n")).collect()}
    assert count([4, 4, 4]) == {0: 3}
    assert count([1] * 6 + [5, 9]) == {0: 6, 1: 1, 2: 1} or count([1] * 6 + [5, 9])[0] >= 6
    with pytest.raises(ValueError):
        U.bin_edges(frame([]), "length")


def test_hints_and_split(spark):
    rows = spark.createDataFrame([(i, i % 3, f"s{i % 2}") for i in range(50)], "ex_id long, complexity int, stratum string")
    leaked = [r.ex_id for r in U.hint_leak(rows, 0.2).filter("leaked").collect()]
    assert sorted(leaked) == [i for i in range(50) if i % 3 == 0][:10]
    with pytest.raises(ValueError):
        U.hint_leak(rows, 1.0)
    for parts in (1, 7):
        split = U.stratified_split(rows.repartition(parts)).groupBy("stratum", "split").count().collect()
        assert {(r.stratum, r.split): r["count"] for r in split} == {("s0", "test"): 5, ("s1", "test"): 5, ("s0", "train"): 20, ("s1", "train"): 20}
    lonely = rows.withColumn("stratum", F.when(F.col("ex_id") == 0, "x").otherwise("y"))
    assert U.stratified_split(lonely).filter("split = 'test'").count() == 10


def test_epochs():
    assert U.epochs_equal(16, 3) == [6, 5, 5] and U.epochs_weighted(16, [5, 6, 5]) == [5, 6, 5]
    with pytest.raises(ValueError):
        U.epochs_weighted(4, [0, 0])


@pytest.mark.parametrize("structured", [True, False])
def test_formats_pair_up(spark, structured):
    rows = X.to_json(X.to_json(G.generate(spark, 400, structured=structured), "question"), "question", "promoted", promote=True).collect()
    for r in rows:
        made = r.promoted if r.format_id == "AttributePromotedKeyValueList" else r.json
        assert json.loads(made) == json.loads(r.answer), (r.format_id, r.difficulty)
    assert {r.format_id for r in rows} == set(G.SECOND) and len(G.SECOND) == 26


def test_other_formats(spark):
    """Formats of the other generators: well-formed on both sides, with the values of the XML in the JSON."""
    names = [f for f, x in G.FORMATS.items() if x.family != "second"]
    rows = X.to_json(G.generate(spark, 200, names, table="mixed"), "question").collect()
    leaves = lambda v: [y for x in (v.values() if isinstance(v, dict) else v) for y in leaves(x)] if isinstance(v, (dict, list)) else [v]
    for r in rows:
        a, b = (sorted(str(x).lower() for x in leaves(json.loads(t)) if x is not None and x is not True) for t in (r.json, r.answer))
        assert a == b or r.format_id in ("NestedConfig", "ListOfComplexEntities"), r
    assert {r.format_id for r in rows} == set(names)


def test_generation_ignores_partitions(spark):
    rows = lambda p: sorted(map(tuple, G.generate(spark, 60, ["PropertyList", "HintedEmptyNode"]).repartition(p).drop("tags").collect()))
    assert rows(1) == rows(9)
    for bad in ({"formats": ["none"]}, {"formats": ["CDataField"], "exclude": ["CDataField"]}, {"exclude": ["none"]}):
        with pytest.raises(ValueError):
            G.generate(spark, 10, **bad)
    ordered = G.in_order(G.generate(spark, 30, ["SingleField"], curriculum=True), curriculum=True).collect()
    assert [r.ex_id for r in ordered] == list(range(30)) and [r.difficulty for r in ordered] == ["easy"] * 9 + ["medium"] * 12 + ["hard"] * 9
    assert [r.ex_id for r in G.in_order(G.generate(spark, 30, ["SingleField"])).collect()] != list(range(30))


def test_datasets(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"dataset": [{"question": "<a/>", "answer": "{}", "tags": ["t"]}, {"question": "q"}]}))
    rows = datasets.read_dataset(spark, str(path)).orderBy("ex_id").collect()
    assert [(r.ex_id, r.question, r.tags) for r in rows] == [(0, "<a/>", ["t"]), (1, "q", None)]
    path.write_text(json.dumps({"dataset": []}))
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, str(path))
    path.write_text(json.dumps({"c1": '{"a":1}', "c2": "{"}))
    assert datasets.read_output_map(spark, str(path)).count() == 2
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("other",)], "name string")
    assert datasets.latest_checkpoint(names).first().latest == "checkpoint-10"


def test_scoring(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "c"), (None, None)], "p string, t string")
    assert S.exact_match(df, "p", "t").first().exact_match == round(2 / 3, 9)
    assert [r.p for r in S.mismatches(df, "p", "t").collect()] == ["b"] and not S.accepted(df, "p", "t")
    out = S.infer(df.coalesce(1), "t", lambda: lambda xs: [f"{len(xs)}:{x}" for x in xs], batch=2).collect()
    assert [r.output for r in out] == ["2:a", "2:c", "1:None"]
    with pytest.raises(Exception, match="1 answers to 2 questions"):
        S.infer(df.coalesce(1), "t", lambda: lambda xs: xs[:1], batch=2).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("limits", [B.Limits(), B.Limits(10, 5), B.Limits(10_000, 10_000)])
@pytest.mark.parametrize(
    "xml",
    [
        '<r xmlns:p="u"><p:c>v</p:c><p:c/><q p:k="1">' + "<z>1</z>" * 30 + "</q></r>",
        '<r xmlns:p="u" p:a="1">t</r>',
        '<r a="1" b="2"><a>x</a><b><c k="v"/></b><a>y</a></r>',
        '<r><f type="list"/><f type="list"/><g>&lt;&amp;</g></r>',
        '<r k="&quot;&lt;"><a/></r>',
        "<r/>",
        "<r>t</r>",
    ],
)
def test_blueprint_gives_what_the_whole_document_does(xml, limits):
    rows = B.records(xml, limits)
    assert B.rebuilt([r | {"json": X.convert(r["chunk"])} for r in rows]) == (X.convert(xml), 0)


def test_blueprint_pieces():
    assert B.records(None) == B.records("<a") == []
    shop = "<shop>" + "".join(f"<item>{i}</item>" for i in range(9)) + "<note><line>" + "x" * 60 + "</line></note></shop>"
    rows = B.records(shop)
    assert [r["kind"] for r in rows] == ["node", "batch", "batch", "batch", "batch", "batch", "node", "leaf"]
    assert sum(r["n"] for r in rows if r["kind"] == "batch") == 9
    assert all(len(r["chunk"]) < 50 for r in rows if r["kind"] == "batch")
    apart = [r for r in B.records('<r one="1111111111" two="2222222222" type="list"><a/></r>') if r["kind"] == "attributes"]
    assert [r["chunk"] for r in apart] == ['<r one="1111111111"/>', '<r two="2222222222"/>']


def test_blueprint_counts_missing_results(spark):
    docs = spark.createDataFrame([(1, "<r><a>1</a><b>2</b></r>"), (2, None), (3, "<r><"), (4, "<r/>")], "k int, x string")
    infer = lambda parts: X.to_json(parts, "chunk").withColumn("json", F.when(F.col("chunk").contains("<b>"), "{,").otherwise(F.col("json")))
    got = {r.k: (r.json, r.n_missing) for r in B.convert_by_pieces(docs, "k", "x", infer).collect()}
    assert got == {1: ('{"r":{"a":"1"}}', 1), 4: ('{"r":null}', 0)}


def test_nested_documents(spark):
    made = X.to_json(G.generate_nested(spark, 101, 3), "question", "converted").collect()
    assert [sum(r.depth == d for r in made) for d in (1, 2, 3)] == [33, 33, 35]
    assert all(json.loads(r.converted) == json.loads(r.answer) for r in made)
    assert all(r.format_id.count("NestedL") == r.depth - 1 for r in made)
    with pytest.raises(ValueError):
        G.generate_nested(spark, 10, 0)


def test_nested_holdout(spark):
    rows = spark.createDataFrame([("NestedL3(PropertyList,NestedL2(BasicEntity,CDataField))",), ("CDataField",), ("NestedL2(PropertyList,BasicEntity)",), (None,)], "format_id string")
    assert one(spark, G.constituents(F.lit(rows.first().format_id))) == ["PropertyList", "BasicEntity", "CDataField"]
    assert [r.split for r in G.nested_holdout(rows, ["CDataField"]).collect()] == ["test", "test", "train", "train"]


def test_blueprint_of_deep_documents_and_whole_elements():
    deep = "<a>" * 3000 + "</a>" * 3000
    assert B.rebuilt([r | {"json": X.convert(r["chunk"])} for r in B.records(deep)])[0] in (None, X.convert(deep))
    xml = "<r>" + "".join(f"<e><n>{i}</n><m>{'x' * 20}</m></e>" for i in range(6)) + "</r>"
    rows = B.records(xml, B.Limits(whole=70))
    assert [r["kind"] for r in rows] == ["node"] + ["leaf"] * 6
    assert B.rebuilt([r | {"json": X.convert(r["chunk"])} for r in rows]) == (X.convert(xml), 0)


def test_pieces_of_an_element():
    import xml.etree.ElementTree as ET

    e = ET.fromstring('<r k="1"><a>x</a><b><c>y</c></b></r>')
    assert B.hollow_piece(e, {}) == '<r k="1"/>' and B.entity_piece(e, {}) == '<r k="1"><a>x</a><b/></r>'
    assert B.entity_piece(e[1], {}) == "<b><c>y</c></b>"
