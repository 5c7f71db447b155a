import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import licences, repeats, sentencepieces, sharding, token_counts
from tessera.llm.packing import default_tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- repeated passages

def brute_repeats(rows, least):
    docs = sorted({(i, t) for i, t in rows}, key=str)
    words = [WORD.findall(t or "") for _, t in docs]
    seen = defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])].add(d)
    out = Counter()
    for d, w in enumerate(words):
        covered = [False] * len(w)
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                covered[i : i + least] = [True] * least
        starts = [i for i in range(len(w)) if covered[i] and (i == 0 or not covered[i - 1])]
        for s in starts:
            e = s
            while e < len(w) and covered[e]:
                e += 1
            out[docs[d][0], s, e] += 1
    return out


def spans(spark, docs_of, rows, **kw):
    return Counter((r.doc_id, r.begin_word, r.end_word) for r in repeats.repeated_spans(docs_of(rows).repartition(3), **kw).collect())


def test_repeats_on_the_corpus(spark, docs_of, corpus):
    assert spans(spark, docs_of, corpus) == brute_repeats(corpus, 50)


def test_repeats_of_odd_contexts(spark, docs_of):
    """Short passages of a small alphabet, so that the best neighbours to the left and to the right differ."""
    rng = random.Random(9)
    stock = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 40))] for _ in range(14)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 7)) for w in rng.choice(stock))) for i in range(120)]
    assert spans(spark, docs_of, rows, least=20, gram=4, window=12) == brute_repeats(rows, 20)
    assert repeats.repeated_spans(docs_of([])).count() == 0


def test_one_passage_in_most_documents(spark, docs_of):
    rng = random.Random(10)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(60)
    rows = [(i, f"{prose(rng.randrange(70))} {passage} {prose(rng.randrange(70))}" if i % 3 else prose(100)) for i in range(150)]
    assert spans(spark, docs_of, rows) == brute_repeats(rows, 50)


def test_passage_whole_at_one_place_of_two_documents_and_cut_at_another(spark, docs_of):
    rng = random.Random(13)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(60):
        passage = prose(60)
        rows.append((2 * k, f"{prose(40)} {passage} {prose(40)}"))
        rows.append((2 * k + 1, f"{prose(40)} {passage} {prose(40)} {' '.join(passage.split()[20:])} {prose(40)}"))
    assert spans(spark, docs_of, rows) == brute_repeats(rows, 50)


def test_documents_whose_keys_collide(spark, docs_of, monkeypatch):
    """Keys that documents have in common are told apart by a second hash."""
    rng = random.Random(17)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(70)
    rows = [(1, f"{prose(20)} {passage}"), (2, f"{passage} {prose(20)}"), (3, prose(80)), (1, None), (None, passage)]
    plain, seen = F.xxhash64, []

    def colliding(*columns):
        if isinstance(columns[0], str) and columns[0] == "doc_id":
            seen.append(1)
            return F.lit(7).cast("long")
        return plain(*columns)

    monkeypatch.setattr(repeats.F, "xxhash64", colliding)
    got = repeats.repeated_spans(docs_of(rows)).collect()
    assert seen and Counter((r.doc_id, r.begin_word, r.end_word) for r in got) == brute_repeats(rows, 50)


# ---- sharding

def check_shards(rows, out, shards):
    want = Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    total, largest = sum(sizes.values()), max((8 + len((t or "").encode()) for _, t in rows), default=0)
    assert all(abs(sizes[k] - total / shards) <= largest for k in range(shards))


def test_sharding(spark, docs_of, corpus):
    check_shards(corpus, sharding.shard(docs_of(corpus)).collect(), 24)
    assert sharding.shard(docs_of([])).count() == 0


def test_sharding_by_a_hot_key_and_repeated_rows(spark, docs_of):
    rows = [(5, "x" * (i % 7)) for i in range(900)] + [(i, "y" * 30) for i in range(900)] + [(None, None)] * 300 + [(7, "same")] * 900
    check_shards(rows, sharding.shard(docs_of(rows), shards=8, range_rows=50).collect(), 8)


def test_sharding_in_two_levels(spark, docs_of):
    """Splitters inside the coarse ranges, a hot key and null keys."""
    rng = random.Random(15)
    rows = [(rng.randrange(5000) if i % 3 else 77, "z" * rng.randrange(50)) for i in range(3000)] + [(None, "n")] * 200
    out = sharding.shard(docs_of(rows).repartition(3), shards=6, range_rows=20, coarse=4)
    check_shards(rows, out.collect(), 6)
    plain = [(i, "") for i in range(2000)]  # without hot keys shards are contiguous key ranges, but for the ranges at their borders
    got = sorted((r.doc_id, r.shard) for r in sharding.shard(docs_of(plain), shards=6, range_rows=20, coarse=4).collect())
    assert all(s == i * 6 // 2000 for i, s in got if 60 < i % (2000 / 6) < 270)
    assert sharding.shard(docs_of([]), coarse=4).count() == 0


def test_binary_search(spark):
    for bounds in ([-5, 0, 3, 3, 10], [], [1]):
        table = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
        got = spark.range(-8, 14).select("id", sharding._search(table, len(bounds), F.col("id")).alias("n")).collect()
        assert all(r.n == sum(b <= r.id for b in bounds) for r in got)


def test_write_shards(spark, docs_of, tmp_path):
    rows = [(i, "x" * (i % 9)) for i in range(60)] + [(None, "q")] * 5 + [(None, None), (7, "xxxxxxx"), (7, "other")]
    docs = docs_of(rows).withColumn("shard", F.lit("own")).withColumn("_slot", F.lit(1))
    sharding.write_shards(docs, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert set(docs.columns) | {"shard_"} == set(back.columns) and back.select("shard_").distinct().count() == 3


# ---- sentencepiece

@pytest.fixture(scope="module")
def models():
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.mark.parametrize(("longest", "together", "words"), [(64, 2_000_000, 400_000), (0, 1, 10), (5, 40, 30)])
def test_ids_and_decoding_equal_the_library(models, corpus, monkeypatch, longest, together, words):
    """Cuts merged together, by the heap, and by both, with a cache that is cleared all the time."""
    mine, library = models
    for name, value in (("_LONGEST", longest), ("_TOGETHER", together), ("CACHE_WORDS", words)):
        monkeypatch.setattr(sentencepieces, name, value)
    mine._cache.clear()
    rng = random.Random(11)
    odd = ["", " ", "  a", "a  ", "a  b", "\n", "a\nb", " \n ", "▁", "▁▁a ▁", "x ▁", "\t\ttab", "é😀漢字 ㎞", "<s> </s> <0x41>", "   ", "a" * 500, " x y", "1234 56", "é"]
    odd += ["".join(rng.choice(" ▁\nabet漢é😀1.") for _ in range(rng.randrange(40))) for _ in range(1500)]
    for text in [t or "" for _, t in corpus] + odd:
        ids = mine.encode(text)
        assert ids == library.encode(text), repr(text[:60])
        assert mine.decode(ids) == mine.decode_encoded(ids) == library.decode(ids), repr(text[:60])
    assert [x[0] for x in mine.encode_all(odd)] == library.encode(odd)


def test_spans_cover_the_original(models):
    mine, _ = models
    for text in ("The quick  brown\nfox é😀 jumps", " lead", "漢字 and ▁"):
        raw, pieces = text.encode(), mine.encode_spans(text)
        assert pieces[0][1] == 0 and pieces[-1][2] == len(raw)
        assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))
        for i, a, b in pieces[1:]:
            if mine.types[i] == 1:
                assert mine.pieces[i].replace("▁", " ").encode() in (raw[a:b], raw[a:b].replace("▁".encode(), b" "))


def small_map(entries):
    """A character map compiled as a double-array trie: node positions are found by trial."""
    trie: dict = {}
    for k in entries:
        node = trie
        for b in k:
            node = node.setdefault(b, {})
        node[None] = k
    texts, at = b"", {}
    for k, v in entries.items():
        at[k] = len(texts)
        texts += v + b"\0"
    units: dict = {}
    taken, bases = {0}, set()

    def place(node, pos, label):
        for base in range(1, 1 << 20):
            slots = [base ^ (0 if b is None else b) for b in node]
            if base not in bases and not taken & set(slots) and (pos ^ base) < 1 << 21:
                break
        bases.add(base)  # a child's slot names its parent only if no two nodes have one base
        taken.update(slots)
        units[pos] = (pos ^ base) << 10 | (None in node) << 8 | label
        for b, child in node.items():
            if b is None:
                units[base] = at[child] | 1 << 31
            else:
                place(child, base ^ b, b)

    place(trie, 0, 0)
    size = (max(units) | 255) + 1
    return struct.pack("<I", 4 * size) + b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size)) + texts


def test_longest_prefix_normalisation(models, monkeypatch):
    mine, _ = models
    entries = {"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"[ab]", b"abc": b"X", "　".encode(): b" ", b"q": b""}
    monkeypatch.setattr(mine, "map", sentencepieces.CharacterMap(small_map(entries)))
    rng = random.Random(12)
    for text in ["abcab", "aab ﬁ　x", "qqq", "q"] + ["".join(rng.choice("abcq ﬁ　é") for _ in range(12)) for _ in range(300)]:
        want, align, i, raw = "▁", [0, 0, 0], 0, text.encode()
        while i < len(raw):
            k = max((k for k in entries if raw.startswith(k, i)), key=len, default=None)
            n = len(k) if k else len(raw[i:].decode()[0].encode())
            made = (entries[k] if k else raw[i : i + n]).decode().replace(" ", "▁")
            want += made
            align += [i] * len(made.encode()) if k or made == "▁" else range(i, i + n)
            i += n
        got, mapped = mine.normalise(text)
        assert got == want and mapped.tolist() == [*align, len(raw)]


def test_sentencepiece_documents(spark, docs_of, corpus, models):
    import public_tokenizers

    rows = sentencepieces.encode_documents(docs_of(corpus), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == Counter((i, tuple(models[1].encode(t or "")), models[1].decode(models[1].encode(t or ""))) for i, t in corpus)
    assert sentencepieces.encode_documents(docs_of([]), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# ---- token counts

def test_histogram_and_limits(spark, docs_of, corpus):
    t = Tokenizer.from_file(default_tokenizer())
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in corpus]
    sums = token_counts.suffix_sums(token_counts.histogram(docs_of(corpus), default_tokenizer()))
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for n, r in got.items():
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_total) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
        assert (r.docs_up_to, r.docs) == (sum(x <= n for x in lengths), len(lengths))
    limits = [0, 1, 100, 512, 1024, 4096, 10**7]
    for r in token_counts.at_limits(sums, limits).collect():
        assert (r.docs_over, r.truncated_total) == (sum(x > r.context for x in lengths), sum(min(x, r.context) for x in lengths))
    ordered = sorted(lengths)
    for r in token_counts.quantiles(sums, [0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == next(x for x in ordered if sum(y <= x for y in ordered) / len(ordered) >= r.share - 1e-9)
    assert token_counts.suffix_sums(token_counts.histogram(docs_of([]), default_tokenizer())).count() == 0


# ---- licences

def test_held_out_accuracy_and_calibration():
    model = licences.train()
    data = licences.variations(777, 3)
    probs = np.array([model.probabilities(t) for t, _ in data])
    own = np.array([[k in o for k in range(len(licences.FAMILIES))] for _, o in data])
    several = own.sum(1) > 1
    best = np.where(probs.max(1) >= 0.5, probs.argmax(1), -1)
    assert (best == np.where(own.any(1), own.argmax(1), -1))[~several].mean() > 0.97
    assert ((probs >= 0.5) == own).all(1)[several].mean() > 0.85
    told = probs >= licences.MIN_PROBABILITY
    assert own[told].mean() > 0.98 and told[own].mean() > 0.9  # what is told is right, and most is told
    for low, high in ((0.5, 0.8), (0.8, 0.95), (0.95, 1.0)):
        some = (probs >= low) & (probs < high)
        assert abs(own[some].mean() - probs[some].mean()) < 0.15


def test_no_text_without_a_telling_word_is_a_licence():
    model = licences.train()
    words, bound = set(licences.telling_words(model)), np.array(model.bias)
    for g, w in model.weights.items():
        if not set(g.split()) & words:
            bound = bound + np.maximum(w, 0)
    assert (1 / (1 + np.exp(-bound / model.temperature)) < licences.MIN_PROBABILITY).all()


#: Notices whose wording, wrapping or frame isn't in the training texts, with their family.
UNSEEN = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:": "mit",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.": "bsd",
    "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.": "gpl",
    " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.": "lgpl",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "isc",
    "You may use this library under the terms of the LGPL, version 2.1.": "lgpl",
    "Licensed under the Eclipse Public License 2.0": "epl",
    "// SPDX-License-Identifier: BSD-2-Clause": "bsd",
    "/* SPDX-License-Identifier: LGPL-2.1-only */": "lgpl",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "The text is licensed under CC BY-SA 4.0 and may be copied.": "cc-by-sa",
}
UNKNOWN = ["This package uses the Artistic License 2.0.", "Licensed under the Academic Free License.", "The tool is distributed under the Wibble Public License 4.0.", "He obtained a license for the software from the public library.", "The code is dual licensed, ask the copyright holder."]


def test_unseen_notices_and_unknown_licences(spark, docs_of):
    texts = [*UNSEEN, *UNKNOWN]
    rows = [(i, "He went to the house.\nIt was late.\n\n" + t + "\n\nShe left it there.") for i, t in enumerate(texts)]
    got = defaultdict(set)
    for r in licences.licence_paragraphs(docs_of(rows)).filter("confirmed").collect():
        got[r.doc_id].add(r.family)
        assert r.paragraph >= 3
    assert [got[i] for i in range(len(rows))] == [*({f} for f in UNSEEN.values()), *(set() for _ in UNKNOWN)]


#: Notices of two licences, in one line or paragraph.
BOTH = {
    "Dual licensed under MIT OR Apache-2.0": {"mit", "apache"},
    "// SPDX-License-Identifier: MIT OR Apache-2.0": {"mit", "apache"},
    "/* SPDX-License-Identifier: GPL-2.0-only OR BSD-3-Clause */": {"gpl", "bsd"},
    "Licensed under either of Apache License, Version 2.0\nor MIT license at your option.": {"mit", "apache"},
    "Released under Apache-2.0.": {"apache"},
}


def test_two_licences_at_once(spark, docs_of):
    got = defaultdict(set)
    for r in licences.licence_paragraphs(docs_of(list(enumerate(BOTH)))).collect():
        got[r.doc_id].add(r.family)
    assert [got[i] for i in range(len(BOTH))] == [*BOTH.values()]


def brute_units(text):
    """(number of the first line, lines, text, block) of paragraphs and of the lines of longer ones."""
    block, held, out = 0, [], []
    for i, line in enumerate([*text.lower().split("\n"), ""]):
        if line.strip(" \t\r\x0b\x0c"):
            held.append((i, line))
            continue
        if len(held) > 1:
            out.append((held[0][0], len(held), "\n".join(x for _, x in held), block))
        out += [(j, 1, x, block) for j, x in held]
        held, block = [], block + 1
    return out


def test_scan_equals_the_classifier(spark, docs_of, corpus):
    model = licences.train()
    some = [n for f in licences.TEXTS for n in licences.notices(f)]
    texts = [*(t for _, t in corpus), "\n".join(some[::3]) + "\nplain words\n", "\n\n".join(some[1::3]), *licences.ORDINARY, *UNSEEN, *UNKNOWN, *BOTH, "\n".join(t for t, _ in licences.variations(5, 1)[::7]), "odd \x01 license \x02 under\nthe MIT license"]
    rows = [*enumerate(texts), (None, some[0]), (None, some[0]), (3, some[0])]
    want = Counter()
    for i, t in rows:
        judged = []
        for first, n, unit, block in brute_units((t or "").replace("\x01", " ").replace("\x02", " ")):
            for k in np.flatnonzero(model.probabilities(unit) >= licences.MIN_PROBABILITY).tolist():
                family, own = licences.FAMILIES[k], licences.grams(unit)
                share = max(len(licences.grams(x) & own) / len(licences.grams(x)) for x in licences.notices(family))
                if share:
                    judged.append((block, family, n == 1, round(share, 6) >= licences.MIN_SIMILARITY, first, n))
        for block, family, line, ok, first, n in judged:
            same = [j for j in judged if j[:2] == (block, family)]
            if any(j[2] and j[3] for j in same):
                chosen = line and ok
            else:
                chosen = not line if any(not j[2] for j in same) else True
            if chosen:
                want[i, first, n, family, ok] += 1
    got = Counter((r.doc_id, r.paragraph, r.n_lines, r.family, r.confirmed) for r in licences.licence_paragraphs(docs_of(rows)).collect())
    assert got == want, (got - want, want - got)
    assert sum(c for (_, _, _, _, ok), c in want.items() if ok) >= 200
    assert licences.licence_paragraphs(docs_of([])).count() == 0
