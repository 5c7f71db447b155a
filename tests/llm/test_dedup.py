import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import components
from tessera.llm.exact_dedup import exact_groups, golomb_decode, golomb_encode, keep_one

SPACE = re.compile("[\x20\x09-\x0d]")


@pytest.mark.parametrize("low_bits", [0, 1, 7, 20])
def test_golomb_round_trip(low_bits):
    rng = np.random.default_rng(low_bits)
    for n in (0, 1, 2, 50, 3000):
        x = np.unique(rng.integers(0, max(4 * n, 4) << low_bits, n)).astype(np.uint64)
        assert golomb_decode(golomb_encode(x, low_bits), len(x), low_bits).tolist() == x.tolist()


def test_exact_groups(spark, docs_of, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    want = Counter()
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            want[m[2], best[2], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()] += 1
    for parts in (1, 5):
        rows = exact_groups(docs_of(corpus).repartition(parts)).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.is_best, r.sha.hex()) for r in rows) == want


def test_keep_one(spark, docs_of, corpus):
    kept = keep_one(docs_of(corpus).repartition(3))
    assert kept.columns == docs_of([]).columns
    rows = kept.collect()
    norms = [SPACE.sub("", r.text or "") for r in rows]
    assert len(norms) == len(set(norms)) == len({SPACE.sub("", t or "") for _, t in corpus})


def test_keep_one_decides_by_text_where_ids_are_null_or_repeated(spark, docs_of):
    rows = [(1, "a b c"), (None, "a b c"), (None, "q r s"), (None, "x y z"), (None, "x y z"), (None, "x yz "), (5, "d e f"), (5, "g h i"), (4, "d e f"), (None, "v w"), (6, "vw"), (7, "m n"), (7, "mn ")]
    kept = Counter((r.doc_id, SPACE.sub("", r.text)) for r in keep_one(docs_of(rows).repartition(3)).collect())
    assert kept == Counter([(1, "abc"), (None, "qrs"), (None, "xyz"), (5, "ghi"), (4, "def"), (None, "vw"), (7, "mn")])


def test_negative_ids_and_empty_table(spark, docs_of):
    rows = [(-5, "a b"), (3, "ab"), (-(2**62), "a b"), (2**62, "q"), (1, "q")]
    got = {r.doc_id: r.keep_id for r in exact_groups(docs_of(rows)).collect()}
    assert got == {-5: -(2**62), 3: -(2**62), -(2**62): -(2**62), 2**62: 1, 1: 1}
    assert exact_groups(docs_of([])).count() == 0 and keep_one(docs_of([])).count() == 0


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(rows):
    prints = [(i, brute_print(t or "")) for i, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                    new, old = sorted((label[a], label[b]))
                    label = [new if x == old else x for x in label]
                    changed = True
    least = {}
    for (i, _), k in zip(prints, label, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return Counter((i, p, least.get(k)) for (i, p), k in zip(prints, label, strict=True))


def test_near_groups(spark, docs_of, corpus):
    rows = simhash.near_groups(docs_of(corpus).repartition(3)).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in rows) == brute_components(corpus)
    assert simhash.near_groups(docs_of([])).count() == 0


def test_keep_first(spark, docs_of, corpus):
    labels = brute_components(corpus)
    kept = [r.doc_id for r in simhash.keep_first(docs_of(corpus)).collect()]
    assert Counter(kept) == Counter({c for _, _, c in labels})


def test_keep_first_decides_by_row_where_ids_are_null_or_repeated(spark, docs_of):
    rng = np.random.default_rng(8)
    a, b, c, d, e = (" ".join(f"w{rng.integers(10**6)}" for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (None, c), (2, d), (2, e), (1, d), (3, e), (2, e)]
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_first(docs_of(rows).repartition(3)).collect())
    assert kept == Counter([(None, a), (None, b), (1, c), (1, d), (2, e)])


@pytest.mark.parametrize("hot", [False, True])
def test_links_connect_all_within_the_radius(spark, hot, monkeypatch):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for s in np.repeat(seeds[:40], 6)]
    dense = [int(seeds[0]) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(400)]
    values = sorted({*(int(s) for s in seeds), *near, *dense})
    if hot:
        monkeypatch.setattr(simhash, "TILE", 50)
    x = np.array(values, np.uint64)
    label = np.arange(len(x))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= 4):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = simhash.links(nodes).collect()
    mine = np.arange(len(x))
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    for r in found:
        a, b = mine[at[r.u]], mine[at[r.v]]
        mine[mine == max(a, b)] = min(a, b)
    assert mine.tolist() == label.tolist()


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    label = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.u: r.v for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {a: b for a, b in label.items() if a != b}
