import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lsh_forest as f


def shingles(text, k=2):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k=2):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def families(seed, many=12, members=30, words=120, edits=(0, 14)):
    """Texts around originals with some words changed, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklm"), 5))
    rows = []
    for g in range(many):
        base = [word() for _ in range(int(rng.integers(3, words)))]
        for i in range(members):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(*edits))):
                w[at] = word()
            rows.append((1000 * g + i, " ".join(w).title() if i % 3 else "\t\n".join(w)))
    return rows


def test_equals_brute_force(spark, docs_of, corpus):
    rows = [r for r in corpus if r[0] != 500] + families(1)
    got = sorted((tuple(r) for r in f.near_groups(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("tile,dense", [(7, 3), (4000, 2)])
def test_dense_regions_and_tiles(spark, docs_of, monkeypatch, tile, dense):
    rows = families(2, 3, 60, 80, (0, 20)) + [(None, "a b c"), (9, "a b c"), (9, "a b c"), (None, None), (3, " "), (5, "A"), (4, "a")]
    groups = f.similar_groups
    monkeypatch.setattr(f, "similar_groups", lambda docs, shingle: groups(docs, shingle, dense, tile))
    monkeypatch.setattr("tessera.llm.common.BROADCAST_ROWS", 0)
    got = sorted((tuple(r) for r in f.near_groups(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark, docs_of):
    assert f.near_groups(docs_of([(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in f.near_groups(docs_of([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        n = 2000
        both, own = round(n * share), (n - round(n * share)) // 2
        x = rng.integers(0, 1 << 63, both + 2 * own, np.uint64)
        a, b = np.sort(x[: both + own]), np.sort(np.append(x[:both], x[both + own :]))
        agree = (np.frombuffer(f.signature(a), np.uint8) == np.frombuffer(f.signature(b), np.uint8)).mean()
        assert abs(agree - share) < 0.12


def test_sets_of_long_texts_and_batches():
    texts = pa.array(["a b " * 1_500_000, None, "x", "", "p q r", "Q r"])
    sets = f.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 0, 1, 0, 2, 1] and np.isin(sets[5], sets[4]).all()
