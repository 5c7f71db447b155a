import re
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import collocations as c
from tessera.llm.words import byte_classes, spans


def brute(rows, least, longest=5, top=2000, percent=100):
    """(lang, rank, phrase, a, l, r, n, score) straight from the definition."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        dropped = {p[i : i + j] for p, a in cand.items() for j in range(2, len(p)) for i in range(len(p) - j + 1) if 100 * a >= percent * counts[p[i : i + j]]}
        got = []
        for p, a in cand.items():
            if p in dropped:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(got)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "x", 2) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, words int, phrase string, f long")


def prose(seed=3):
    rng = np.random.default_rng(seed)
    stem = np.array(["the", "of", "ÀB", "New", "York", "City", "straße", "x_y", "a-b", "😀", "q", "zz"])
    weight = np.array([9, 8, 2, 5, 5, 4, 2, 1, 1, 2, 3, 3]) / 45
    gaps = np.array([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "!", "\r\n"])
    text = lambda m: "".join(w + g for w, g in zip(rng.choice(stem, m, p=weight), rng.choice(gaps, m), strict=True))
    rows = [(str(rng.choice(["en", "de", "und"])) if i % 7 else None, text(int(rng.integers(0, 300)))) for i in range(60)]
    return [*rows, ("en", None), ("en", ""), (None, None), ("fr", "\n \t."), ("de", "rep " * 2000), ("en", "new york city " * 90), ("en", "new york city " * 90), ("long", "lost and found\x0b" * 30_000)]


def test_equals_brute_force(spark):
    rows = prose()
    for least, top, percent in ((5, 2000, 100), (30, 10, 60), (300, 2000, 100)):
        got = sorted(tuple(r) for r in c.collocations(frame(spark, rows), least, top=top, percent=percent).collect())
        assert got == brute(rows, least, top=top, percent=percent)


def test_narrow_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "BITS", (8, 8))
    monkeypatch.setattr(c, "BLOCK", 64)
    rows = prose(4)
    assert sorted(tuple(r) for r in c.collocations(frame(spark, rows), 9).collect()) == brute(rows, 9)


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(c, "BROADCAST_COUNTS", 0)
    rows = prose(5)
    assert sorted(tuple(r) for r in c.collocations(frame(spark, rows), 9).collect()) == brute(rows, 9)


def test_empty(spark):
    assert c.collocations(frame(spark, []).limit(0)).count() == 0
    assert c.collocations(frame(spark, [("en", None), (None, "a b")])).count() == 0


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 123_456_789_012_345_678, 987_654_321_098_765, 3_000_000_019, 7_000_000_003  # noqa: E741
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(f"{c._SCORE} as score").first()
    assert got.score == 1000 * a * n // (l * r)


def test_spans_cut_at_breaks():
    import pyarrow as pa

    texts = pa.array(["", "a b.c d", None, "e " * 500 + "\n" + "f " * 700, "g", "", "h\ti"])
    classes = byte_classes(b" \t", b".\n")
    for size in (1, 7, 100, 1 << 20):
        words, pieces, last = [], 0, None
        for x in spans(texts, classes, size):
            names = x.vocabulary.to_pylist()
            for row, piece, code in zip(x.row.tolist(), x.piece.tolist(), x.code.tolist(), strict=True):
                words.append((row, names[code].decode()))
                pieces += (row, piece, id(x)) != last
                last = (row, piece, id(x))
        expected = [(i, w) for i, t in enumerate(texts.to_pylist()) for w in re.findall("[^ \t.\n]+", t or "")]
        assert words == expected and pieces >= 6
