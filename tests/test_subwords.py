import random

import pytest

from tessera.operators import scoring as G
from tessera.operators import subwords as W


def plain(word, ranks):
    """The merges as they are defined: the leftmost pair of the lowest rank, again and again."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def ranks():
    rng = random.Random(1)
    out = {bytes([b]): b for b in range(256)}
    pool = [bytes([b]) for b in b"abcd e\xc3\xa9"]
    while len(out) < 500:
        pair = rng.choice(pool) + rng.choice(pool)
        if pair not in out and len(pair) < 9:
            out[pair] = len(out)
            pool.append(pair)
    return out


def test_merges_equal_the_definition(ranks):
    rng = random.Random(2)
    for _ in range(400):
        word = "".join(rng.choice("abcd eé") for _ in range(rng.randint(0, 40))).encode()
        if word not in ranks:
            assert W.merged(word, ranks) == plain(word, ranks)
    assert b"".join(W.merged(b"abca" * 20_000, ranks)) == b"abca" * 20_000


@pytest.mark.parametrize("small", [200_000, 0])
def test_counts(spark, ranks, monkeypatch, small):
    import regex

    monkeypatch.setattr(W, "SMALL", small)
    monkeypatch.setattr(W, "HOT_DOCUMENTS", 3)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["ab", " ", "cd é", "\n\n ", "don't ", "12", "!?", " ", "a" * 30]) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(100, None), (101, ""), (None, "ab cd"), (5, "dd")]
    pattern = regex.compile(W.PATTERN.removeprefix("(?U)"))
    expected: dict = {}
    for i, text in rows:
        expected[i] = expected.get(i, 0) + sum(len(W.merged(w.encode(), ranks)) for w in pattern.findall(text or ""))
    got = {r.key: r.tokens for r in W.token_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text", ranks).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in expected.items() if k is not None}


def test_counts_equal_a_library(spark):
    tiktoken, paths = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = W.read_ranks(str(paths.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=paths.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(0, "The quick brown fox, it's 12 o'clock…\n\n  naïve Straße 😀"), (1, "x" * 500 + " " * 40 + "tab\there "), (2, "l'été où ça 日本語テキスト")]
    got = {r.key: r.tokens for r in W.token_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text", ranks).collect()}
    assert got == {i: len(library.encode_ordinary(t)) for i, t in rows}


def test_batches_by_padded_tokens(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 31, 200]))]) for i in range(300)] + [(900, None), (901, [1] * 5000)]
    frame = spark.createDataFrame(rows, "id long, ids array<int>")
    got = G.token_batches(frame, "ids", 400, partitions=3).collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in rows)
    batches: dict = {}
    for r in got:
        own = r.ids or []
        assert r.padded == own + [0] * (r.width - len(own)) and r.mask == [1] * len(own) + [0] * (r.width - len(own))
        batches.setdefault(r.batch, []).append(r)
    for held in batches.values():
        assert held[0].width == max(len(r.ids or []) for r in held) and (len(held) == 1 or len(held) * held[0].width <= 400)
    real = sum(len(x or []) for _, x in rows)
    assert sum(r.width for r in got) < 1.4 * real and len(rows) * 5000 > 50 * real


def test_answers_by_tokens(spark):
    rows = [(i, list(range(1, i % 13 + 1))) for i in range(200)]
    asked = G.infer_by_tokens(spark.createDataFrame(rows, "id long, ids array<int>"), "ids", lambda: lambda batch: [str(sum(x)) for x in batch], 64)
    assert sorted((r.id, r.output) for r in asked.collect()) == [(i, str(sum(x))) for i, x in rows] and asked.columns == ["id", "ids", "output"]
