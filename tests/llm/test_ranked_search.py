import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ranked_search as r

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    many, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * many // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, n, x[3], -x[0]) for n, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, row int, q int, t string"),
        spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, term int, s int"),
    )


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    stem = np.array([f"{a}{b}" for a in ("the", "Of", "élan", "x", "9", "naïve") for b in ("", "ing", "Ü", "7", "ab")])
    weight = 1 / np.arange(1, len(stem) + 1)
    text = lambda m: " ".join(rng.choice(stem, m, p=weight / weight.sum()))
    docs = [(i, text(int(m))) for i, m in enumerate(rng.integers(0, 60, 300))]
    docs += [(i, docs[7][1]) for i in range(1000, 1040)] + [(None, docs[3][1]), (None, None), (5, docs[9][1]), (5, docs[9][1]), (2000, text(20_000)), (2001, ""), (2002, "\x00-_@ ")]
    items = [(i, text(int(m))) for i, m in enumerate(rng.integers(1, 25, 30))] + [(50, None), (51, ""), (52, "nowhere else"), (3, "the 9 the"), (3, "x"), (None, "élan"), (None, "OF")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 50, 400])
def test_equals_scoring_everything(spark, rows, k):
    got = [tuple(x) for x in r.top_documents(*tables(spark, *rows), k).collect()]
    assert sorted(got, key=str) == brute(*rows, k)


def test_shuffle_joins_and_split_lists(spark, rows, monkeypatch):
    monkeypatch.setattr(r, "VOCABULARY", 3)
    monkeypatch.setattr(r, "LIST_ROWS", 20)
    monkeypatch.setattr(r, "LISTS", 0)
    monkeypatch.setattr("tessera.llm.common.BROADCAST_ROWS", 0)
    got = [tuple(x) for x in r.top_documents(*tables(spark, *rows), 10).collect()]
    assert sorted(got, key=str) == brute(*rows, 10)


def test_empty(spark, rows):
    docs, items = rows
    none, some = tables(spark, docs, items)
    assert r.top_documents(none.limit(0), some, 10).count() == 0
    assert r.top_documents(none, some.limit(0), 10).count() == 0
