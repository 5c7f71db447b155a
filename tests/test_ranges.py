import json
import random

import pytest

from tessera.sources import datasets as D
from tessera.sources import ranges as R


def example(rng, i):
    odd = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ":", "é", " ", "\n", "a", '"dataset": [{']) for _ in range(rng.randint(0, 30)))
    return {"question": odd(), "answer": odd(), "format_id": f"f{i}", "tags": [odd() for _ in range(rng.randint(0, 3))]}


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_any_range_gives_the_same(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [example(rng, i) for i in range(60)]
    more = [example(rng, 100 + i) for i in range(5)]
    files = {
        "a.json": json.dumps({"about": {"a": {"b": 1}, "c": [1, {"x": 2}]}, "dataset": rows, "tail": "}]\\"}, ensure_ascii=False, indent=2 if size == 64 else None),
        "b.json": " \n" + json.dumps(more, separators=(",", ":")),
    }
    if size == 5:
        files = {"a.json": json.dumps({"k\"[": [], "dataset": rows[:3], "n": None}), "b.json": "[]"}
        rows, more = rows[:3], []
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = R.read_lists(spark, str(tmp_path), size).filter("list in ('dataset', '')").orderBy("ex_id").collect()
    assert [json.loads(r.text) for r in got] == rows + more


def test_lists_by_name_and_breaks(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"train": [{"question":"1"},7,{"question":"2"}], "test":[{"question":"3"}]}')
    rows = R.read_examples(spark, str(tmp_path / "x.json"), ("train", "test"), 10).orderBy("ex_id").collect()
    assert [(r.ex_id, r.split, r.question) for r in rows] == [(0, "train", "1"), (1, "train", "2"), (2, "test", "3")]
    (tmp_path / "y.json").write_text('{"dataset": [{"question":"1"},{"question":"2"')
    assert [r.question for r in R.read_examples(spark, str(tmp_path / "y.json"), size=9).collect()] == ["1"]
    (tmp_path / "z.json").write_text('{"dataset": []}')
    with pytest.raises(ValueError, match="no examples"):
        R.read_examples(spark, str(tmp_path / "z.json"))


def test_several_tasks_read_and_write_one_object(spark, tmp_path):
    frame = spark.range(5000).selectExpr("id as ex_id", "concat('q\"', id, repeat('x', 100)) as question", "if(id % 3 = 0, null, 'a') as answer", "'f' as format_id", "array('t') as tags").repartition(7)
    path = str(tmp_path / "whole.json")
    R.write_object(frame, path)
    whole = json.loads((tmp_path / "whole.json").read_text())
    assert [r["question"][:8] for r in whole["dataset"]][:3] == ['q"0xxxxx', 'q"1xxxxx', 'q"2xxxxx'] and len(whole["dataset"]) == 5000 and whole["dataset"][0]["answer"] is None
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["whole.json"]
    back = R.read_examples(spark, path, size=100_000)
    assert R._ranges(spark, path, 100_000).rdd.getNumPartitions() > 5
    columns = ["ex_id", "question", "answer", "format_id", "tags"]
    assert back.select(columns).exceptAll(frame.select(columns)).count() == 0 and back.count() == 5000
    assert D.read_dataset(spark, path).select(columns).exceptAll(back.select(columns)).count() == 0
    with pytest.raises(FileExistsError):
        R.write_object(frame, path)
    R.write_object(frame.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"dataset": []}
