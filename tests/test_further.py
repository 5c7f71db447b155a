import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import curation as U
from tessera.operators import formats as O
from tessera.operators import generate as G
from tessera.operators import scoring as S
from tessera.operators import serving as V
from tessera.operators import templates as M
from tessera.operators import xmljson as X
from tessera.sources import datasets
from tessera.streaming import documents as D


def examples(spark, n=200):
    """Formats of different sizes, two tags, three lengths."""
    rows = [(i, "x" * (10 + 37 * i % 90), "y", f"F{min(i % 10, 4)}", [f"t{i % 2}"]) for i in range(n)]
    return spark.createDataFrame(rows, "ex_id long, question string, answer string, format_id string, tags array<string>")


def test_curate_with_formats(spark):
    rows = examples(spark)
    out = U.curate(rows, hints=0.25, holdout=["F0"])
    train, test = U.parts(out)
    assert out.count() == 200 and train.count() + test.count() == 200 and test.count() == 40
    unseen = {r.ex_id: r.complexity for r in U.complexity_of(rows).filter("format_id = 'F0'").collect()}
    leaked = sorted(unseen, key=lambda i: (unseen[i], i))[: round(0.25 * len(unseen))]
    assert {r.ex_id for r in train.filter("format_id = 'F0'").collect()} <= set(leaked)
    assert {r.ex_id for r in test.filter("format_id = 'F0'").collect()} >= set(unseen) - set(leaked)
    best = U.best_holdout(U.holdout_search(U.format_stats(U.complexity_of(rows)))).first().formats
    auto = U.curate(rows)
    assert {r.split for r in auto.filter(F.col("format_id").isin(*best)).collect()} == {"test"}
    with pytest.raises(ValueError):
        U.curate(rows, hints=1.0)
    with pytest.raises(ValueError):
        U.curate(rows.filter("format_id = 'F0'"))  # no proper subset of one format
    with pytest.raises(ValueError):
        U.curate(rows.filter("false"))


def test_curate_when_the_holdout_fills_the_test(spark):
    """No more rows are taken from the pool, and all of it is for training."""
    out = U.curate(examples(spark), test_size=0.1, holdout=["F4"])
    assert {(r.format_id == "F4", r.split) for r in out.collect()} == {(True, "test"), (False, "train")}


def test_curate_without_formats(spark):
    rows = examples(spark).drop("format_id")
    assert Counter(r.split for r in U.curate(rows).collect()) == {"test": 40, "train": 160}
    plain = U.curate(rows.drop("tags"))
    assert Counter(r.split for r in plain.collect()) == {"test": 40, "train": 160}
    for size, side in ((0, "train"), (1, "test")):
        assert {r.split for r in U.curate(rows, test_size=size).collect()} == {side}
    few = examples(spark, 7)
    assert Counter(r.split for r in U.curate(few, force_complexity_split=True).collect()) == {"test": 2, "train": 5}
    with pytest.raises(ValueError):
        U.curate(few, force_complexity_split=True, on_small_stratum="error")


def test_curate_nested(spark):
    rows = examples(spark).withColumn("format_id", G.nested_id(2, F.lit("PropertyList"), F.when(F.col("ex_id") % 5 == 0, "CDataField").otherwise("BasicEntity")))
    got = U.curate(rows, nested_holdout=["CDataField"], hints=0.1)
    assert Counter((r.ex_id % 5 == 0, r.split) for r in got.collect()) == {(True, "test"): 36, (True, "train"): 4, (False, "train"): 160}
    with pytest.raises(ValueError):
        U.curate(rows)


def test_nth_smallest(spark):
    values = [-5, 0, 3, 3, 2**40, -(2**40), 2**63 - 1, -(2**63), 65536, 65535]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [U.nth_smallest(df, "v", n + 1) for n in range(len(values))] == sorted(values)


def test_many_formats_and_tags(spark):
    """More tags than bits in a number; every subset's score as by hand."""
    rows = spark.createDataFrame([("a", 3, [f"t{i}" for i in range(80)], [0]), ("b", 2, [f"t{i}" for i in range(70)], [0, 1]), ("c", 5, [], [2])], "format_id string, n long, tags array<string>, complexities array<int>")
    got = {tuple(r.formats): r.score for r in U.holdout_search(rows).collect()}
    assert got[("a",)] == round(10 + abs(0.3 - 0.2) + 0.02, 9) and got[("b",)] == round(abs(0.2 - 0.2) + 0.01, 9) and got[("a", "b")] == round(80 + 0.3 + 0.01, 9)
    assert U.best_holdout(U.holdout_search(rows)).first().formats == ["b"]


def test_weights_need_a_phase_each():
    with pytest.raises(ValueError):
        U.epochs_weighted(16, [1, 2], phases=3)


def test_datasets_written_and_read_again(spark, tmp_path):
    rows = examples(spark, 30).withColumn("answer", F.when(F.col("ex_id") != 3, F.lit('"é\n')))
    for name, frame in (("one", rows.coalesce(1)), ("many", rows.repartition(4))):
        datasets.write_dataset(frame, str(tmp_path / name))
        back = datasets.read_dataset(spark, str(tmp_path / name)).orderBy("ex_id").collect()
        assert [(r.ex_id, r.question, r.answer, r.format_id, r.tags) for r in back] == [tuple(r) for r in rows.orderBy("ex_id").collect()]
    datasets.write_dataset(rows, str(tmp_path / "lines"), as_lines=True)
    assert spark.read.json(str(tmp_path / "lines")).count() == 30
    curated = U.curate(rows, force_complexity_split=True)
    datasets.write_test(curated.drop("complexity"), str(tmp_path / "test"))
    assert datasets.read_dataset(spark, str(tmp_path / "test")).count() == curated.filter("split = 'test'").count()
    pair = datasets.read_pair(spark, str(tmp_path / "one"), str(tmp_path / "test"))
    assert Counter(r.split for r in pair.collect())["train"] == 30
    wrong = spark.createDataFrame([("a", "a"), ("b", "c"), (None, "d")], "p string, t string")
    datasets.write_mismatches(wrong, "p", "t", str(tmp_path / "wrong"))
    assert sorted(json.loads(r.value)[1] for r in spark.read.text(str(tmp_path / "wrong")).collect()) == ["c", "d"]
    both = tmp_path / "both.json"
    both.write_text(json.dumps({"train": [{"question": "a"}, {"question": "b"}]}))
    assert [(r.split, r.question) for r in datasets.read_split(spark, str(both)).orderBy("ex_id").collect()] == [("train", "a"), ("train", "b")]
    assert datasets.dataset_path("d", "x", 5) == "d/tagged_dataset_exp_x_5_grammar_compact.json"
    assert datasets.from_rows(spark, [{"question": "q"}]).first().ex_id == 0
    xml = tmp_path / "d.xml"
    xml.write_text('<all><row k="1"><a>x</a></row><row k="2"><a>y</a></row></all>')
    assert sorted(r.a for r in datasets.read_xml(spark, str(xml), "row").collect()) == ["x", "y"]


def test_streams_answer_what_batches_do(spark, tmp_path):
    rows = spark.createDataFrame([(1, "<a> <b>1</b>\n</a>"), (2, "<a>"), (3, None), (4, "")], "k long, input_text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = D.converted(D.read_documents(spark, str(tmp_path / "in"), "k long, input_text string"))
    D.write_responses(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r.k: (r.status, r.response) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (200, '{"output":"{\\"a\\":{\\"b\\":\\"1\\"}}"}'), 2: (500, '{"error":"not well-formed"}'), 3: (400, '{"error":"missing input_text"}'), 4: (400, '{"error":"missing input_text"}')}
    assert {r.k: (r.status, r.response) for r in V.converted(rows).collect()} == got


def test_serving_in_groups(spark):
    docs = [(i, "<r>" + "".join(f"<e><n>{j}</n></e>" for j in range(30)) + "</r>") for i in range(3)]
    made = V.served(spark.createDataFrame(docs, "k int, x string"), "k", "x", V.simulator(malformed=0.0))
    assert all((r.json, r.n_missing) == (X.convert(docs[0][1]), 0) for r in made.collect())
    spoiled = V.served(spark.createDataFrame(docs, "k int, x string"), "k", "x", V.simulator(malformed=1.0)).collect()
    assert all(r.n_missing > 0 for r in spoiled)
    one = V.single(spark.createDataFrame([("a",), (None,)], "x string"), "x", lambda: lambda t: f"{t}!").collect()
    assert [r.output for r in one] == ["a!", "None!"]


def test_deep_and_mixed_documents():
    deep = "<a>" * 5000 + "x" + "</a>" * 5000
    assert X.convert(deep).count('"a"') == 5000
    assert len(X.chunks(deep, 1000)) >= 1 and X.indented("<a><b>1</b></a>") == "<a>\n  <b>1</b>\n</a>"
    mixed = "<r>lead<a>1</a>tail" + "<b>2</b>" * 40 + "<c><d>" + "z" * 200 + "</d>after</c>end</r>"
    pieces = X.chunks(mixed, 120)
    text = "".join("".join(x for x in __import__("xml.etree.ElementTree", fromlist=["x"]).fromstring(p).itertext()) for p, _ in pieces)
    assert text == "lead1tail" + "2" * 40 + "z" * 200 + "afterend"
    many = "<!DOCTYPE r [" + "".join(f'<!ENTITY e{i} "v{i}">' for i in range(20)) + "]><r>&e19;</r>"
    assert X.convert(many) == '{"r":"v19"}'
    bomb = "<!DOCTYPE r [<!ENTITY a0 'aaaaaaaaaa'>" + "".join(f"<!ENTITY a{i} '{f'&a{i - 1};' * 10}'>" for i in range(1, 10)) + "]><r>&a9;</r>"
    assert X.convert(bomb) is None
    spaced = '<r xmlns:p="u"><p:a p:k="1">' + "y" * 90 + "</p:a><b/></r>"
    assert all(X.convert(p) for p, _ in X.chunks(spaced, 100))
    assert X.unevenly_indented(None, "0") is None and json.loads(X.convert(X.unevenly_indented("<a><b>x  y</b><c/></a>", "93f1"))) == {"a": {"b": "x  y", "c": None}}


def test_split_by_any_size(spark):
    doc = "<s>" + "".join(f"<w>{'a ' * (i % 5 + 1)}</w>" for i in range(30)) + "</s>"
    rows = X.split_documents(spark.createDataFrame([(doc,), (None,), ("<x",)], "x string"), "x", 60, size=lambda t: len(t.split()))
    assert all(len(r.chunk.split()) <= 60 for r in rows.collect())
    with pytest.raises(ValueError):
        X.split_documents(rows, "x", 50)
    assert [X.is_simple(t) for t in ("<a><b/></a>", "<a><b><c/></b></a>", "<a>", "<a/>")] == [True, False, None, True]


def test_columns_of_names_and_values(spark):
    got = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert got(C.coerced(F.lit('a"b'))) == '"a\\"b"' and got(C.coerced(F.lit(None).cast("string"))) == "null" and got(C.coerced(F.lit("007"))) == "7"
    assert got(C.promoted_values(F.array(F.lit("1")))) == "1" and got(C.promoted_values(F.array(F.lit("1"), F.lit('"x"')))) == '[1,"x"]'
    assert got(F.size(C.token_strings(F.lit(" a  b\tc ")))) == 3 and got(C.token_count(F.lit("ab c"), lambda x: F.size(F.split(x, " ")))) == 2
    assert got(O.name_map(["root", "item"], F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == {"root": "a", "item": "b"}
    with pytest.raises(ValueError):
        O.sample(["a"], 2, 1, F.lit(1))
    assert got(G.list_id(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "ListOfNested(a,b)" and got(G.wrapped_id(F.lit("a"))) == "Nested(a)"


def test_templates(spark):
    for made in (M.generate_uniform(spark, 60), M.generate_equal(spark, 4), M.generate_pools(spark, 120, 15)):
        for r in made.collect():
            assert json.loads(X.convert(r.question)) is not None and json.loads(r.answer) is not None, r
    with pytest.raises(ValueError):
        M.generate_pools(spark, 100, 25)
    with pytest.raises(ValueError):
        M.build_xml('{"a":1,"b":2}')
    assert M.build_xml('{"a":{"@x":true,"b":[1,null],"c":{}}}') == '<a x="true">\n  <b>\n    <item>1</item>\n    <item></item>\n  </b>\n  <c />\n</a>'
    assert M.with_xml(spark.createDataFrame([("[]",), (None,)], "d string"), "d").filter("xml IS NOT NULL").count() == 0
    lists = M.generate_employees(spark, 9).collect()
    assert [1 <= len(json.loads(r.output)["employeeList"]["employee"]) <= 15 for r in lists] == [True] * 9
    for r in lists:
        names = [e["fullName"] for e in json.loads(r.output)["employeeList"]["employee"]]
        made = json.loads(X.convert(r.input))["employeeList"]["employee"]
        assert [e["fullName"] for e in (made if isinstance(made, list) else [made])] == names


def test_evaluation(spark):
    rows = spark.createDataFrame([([1, 2, 99], [1, 2, 3]), ([4, -100], [4, 0])], "p array<int>, r array<int>")
    assert tuple(S.evaluate(rows, "p", "r", lambda ids: F.array_join(ids.cast("array<string>"), " "), 4).first()) == (1.0, 2)
    longest = S.model_columns(spark.createDataFrame([("a bb", "c"), ("a b c", "")], "input_text string, target_text string"), lambda x: F.transform(F.split(x, " "), F.length), None).collect()
    assert [r.input_ids for r in longest] == [[1, 2, 0], [1, 1, 1]] and longest[0].labels == [1, -100, -100]
