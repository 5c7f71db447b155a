import json
import random

import pytest

from tessera.operators import merging as M
from tessera.operators import xmljson as X


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.35:
        return rng.choice([1, "x", None, True, 2.5, "é\n\"", ""])
    if kind < 0.55:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: value(rng, depth + 1) for k in rng.sample(["a", "b", "@id", "c.d", "e f"], rng.randint(0, 4))}


@pytest.mark.parametrize(("legacy", "block"), [(False, 10_000), (True, 2)])
def test_equals_the_merge(spark, legacy, block):
    rng = random.Random(6)
    rows = [(k, i, json.dumps(value(rng, 0 if rng.random() < 0.2 else -1) if rng.random() < 0.1 else {n: value(rng, 1) for n in rng.sample(["a", "b", "@id", "c.d"], rng.randint(0, 4))})) for k in range(120) for i in range(rng.randint(1, 6))]
    rows += [(500, 0, "{broken"), (501, 0, None), (502, 0, '{"a":1}'), (502, 1, "nope"), (503, 0, "[]"), (504, 0, '[{"a":1},{"a":2}]'), (505, 0, "[1]"), (505, 1, "2"), (506, 0, "7"), (507, 0, "{}"), (507, 1, "{}")]
    rows += [(508, i, json.dumps({"@k": "same", "v": [i], "w": {"x": i}})) for i in range(300)]
    got = {r.key: json.loads(r.json) for r in M.merged(spark.createDataFrame(rows, "key long, ord long, text string"), legacy, block).collect()}
    for key in {k for k, _, _ in rows}:
        assert got[key] == json.loads(X.stitched([t for k, _, t in rows if k == key], legacy)), key


def test_empty(spark):
    assert M.merged(spark.createDataFrame([], "key long, ord long, text string")).count() == 0
