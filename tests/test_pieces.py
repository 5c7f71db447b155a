from random import Random

import pytest

from tessera.operators import pieces as P
from tessera.operators import xmljson as X


def document(rng, deepest=5, depth=0):
    tag = rng.choice(["a", "bb", "item"])
    own = "".join(f' {k}="{"v" * rng.randint(0, 12)}"' for k in rng.sample(["id", "k"], rng.randint(0, 2)))
    text = lambda: rng.choice(["", "", "word ", "&lt;1&gt; and more of it", "é" * 40])
    return f"<{tag}{own}>{text()}{''.join(document(rng, deepest, depth + 1) + text() for _ in range(rng.randint(0, 7 if depth < deepest else 0)))}</{tag}>"


@pytest.fixture(scope="module")
def rows():
    rng = Random(3)
    texts = [document(rng, rng.randint(0, 4)) for _ in range(60)]
    texts += ["<w>" + "".join(f"<r>{'x' * (i % 17)}</r>" for i in range(2000)) + "</w>", "<a><b></a>", "<a/>", "<d>" * 30 + "x" * 300 + "</d>" * 30]
    return [(i, X.outline(t).text if i not in (61,) else t) for i, t in enumerate(texts)] + [(100, None), (101, "")]


@pytest.mark.parametrize(("budget", "units", "block"), [(60, None, 10_000), (200, None, 7), (200, ["item"], 10_000), (90, ["bb", "item"], 50)])
def test_equals_the_fold(spark, rows, budget, units, block):
    frame = spark.createDataFrame(rows, "id long, xml string")
    got: dict = {}
    for r in sorted(P.pieces(frame, "id", "xml", budget, units, block=block).collect(), key=lambda r: (r.key, r.seq)):
        got.setdefault(r.key, []).append((r.piece, r.path))
        assert r.seq == len(got[r.key])
    for i, text in rows:
        assert got.get(i, []) == X.chunks(text, budget, unit=(lambda tag, _: tag in units) if units else None), (i, text)


def test_packed_takes_what_fits(spark):
    rng = Random(8)
    rows = [(g, i, rng.randint(1, 9), 3 * g) for g in range(12) for i in range(rng.randint(1, 80))]
    frame = spark.createDataFrame(rows, "g int, i long, size long, room long")
    got = {(r.g, r.i): r.start for r in P.packed(frame, ["g"], "i", "size", "room", block=5).collect()}
    used, start = 0, None
    for g, i, size, room in rows:
        if i == 0 or used + size > room:
            used, start = 0, i
        used += size
        assert got[g, i] == start


def test_chains(spark):
    steps = spark.createDataFrame([(0, i, i + 3 if i + 3 < 1000 else None) for i in range(1000)], "g int, item long, next long")
    found = P.reached(steps, ["g"], spark.createDataFrame([(0, 1)], "g int, item long"))
    assert sorted(r.item for r in found.collect()) == list(range(1, 1000, 3))
