from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def brute_kept(rows):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                new, old = sorted((label[a], label[b]))
                label = [new if x == old else x for x in label]
    groups = {}
    for (i, t), k in zip(rows, label, strict=True):
        groups.setdefault(k, []).append((i is None, i or 0))
    return Counter(None if min(g)[0] else min(g)[1] for g in groups.values())


@pytest.mark.parametrize("tile", [4_000, 3])
def test_near_dedup_stage(spark, docs_of, tile, monkeypatch):
    from tessera.llm import similar

    rng = np.random.default_rng(14)
    prose = lambda n: [f"w{rng.integers(10**6)}" for _ in range(n)]
    rows = []
    for k in range(12):  # near copies from 0.6 to 0.98, more than a radius of 4 of 64 bits finds
        words = prose(int(rng.integers(60, 300)))
        rows.append((100 * k, " ".join(words)))
        for j in range(1, 7):
            other = list(words)
            for at in rng.choice(len(words) // 10, j, replace=False):
                other[10 * at] = f"x{rng.integers(10**6)}"
            rows.append((100 * k + j if k else None, " ".join(other)))
    rows += [(5000, ""), (None, None), (5001, "one"), (5002, "One"), (5003, "a b c"), (None, "only this"), (None, "only that")]
    keep = lambda d: similar.keep_one_similar(d, tile)
    monkeypatch.setattr(corpus_pipeline, "keep_one_similar", keep)
    kept = corpus_pipeline.near_dedup(spark, docs_of(rows).repartition(3), "")
    assert kept.columns == docs_of([]).columns
    assert Counter(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_near_dedup_of_an_empty_table(spark, docs_of):
    assert corpus_pipeline.near_dedup(spark, docs_of([]), "").count() == 0


def test_links_of_a_family_of_many_degrees():
    """Texts at 0.5 to 0.95 of each other: parts are those of all similar pairs, and links are fewer than texts."""
    from tessera.llm import similar, simhash

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 160, np.uint64)
    sets = [np.unique(np.where(rng.random(160) < share, rng.integers(0, 1 << 63, 160, np.uint64), base)) for share in rng.uniform(0.02, 0.3, 150)]
    prints = np.array([simhash.majority(s) for s in sets], np.uint64)
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if label[a] != label[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                new, old = sorted((label[a], label[b]))
                label = [new if x == old else x for x in label]
    for tiles, cross in ((1, False), (2, True)):
        tile = np.arange(len(sets)) % tiles
        found = similar.family_links(prints, sets, tile, cross)
        assert len(found) < len(sets)
        if not cross:
            mine = list(range(len(sets)))
            for a, b in found:
                new, old = sorted((mine[a], mine[b]))
                mine = [new if x == old else x for x in mine]
            assert mine == label and 1 < len(set(label)) < len(sets)
        else:
            assert found and all(tile[a] != tile[b] for a, b in found)


def brute_pipeline(rows):
    """Ids, texts and places in the original table of what the first four stages keep."""
    import zstandard

    from tessera.llm import pii, quality

    compressor = zstandard.ZstdCompressor(level=3)
    kept = [(i, t) for i, t in rows if quality.measure(t or "", compressor)[9]]  # too few texts of a length for fitted bands
    groups = {}
    for i, t in kept:
        groups.setdefault("".join((t or "").split(" ")).replace("\n", ""), []).append((-len(t or ""), i is None, i or 0, t))
    kept = [(None if g[1] else g[2], g[3]) for g in map(min, groups.values())]
    kept = [(i, t) for i, t in kept]
    stays = brute_kept(kept)
    return stays, {t: pii.mask(t, [s for part in pii.find(t) for s in part]) for _, t in kept}


def test_pipeline_on_nulls_repeats_and_clashes(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm.packing import default_tokenizer

    rng = np.random.default_rng(21)
    stems = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(stems, n))
    base = [prose(int(n)) for n in rng.integers(60, 300, 24)]
    rows = list(enumerate(base)) + [(100 + i, base[i].replace(" ", "  ", 1)) for i in range(4)]  # exact copies but for a space
    rows += [(200 + i, base[4 + i] + " zz") for i in range(4)]  # near copies
    rows += [(None, base[9]), (None, prose(70)), (None, prose(80)), (5, prose(90)), (5, prose(100)), (6, base[6]), (None, None), (300, ""), (301, "short text")]
    rows += [(400, prose(60) + " mail a.b@c.de or +1 222 333 4444 " + prose(60)), (401, "x " * 400), (402, prose(4000))]
    docs = docs_of(rows).drop("sha").withColumn("bands", F.lit(1)).withColumn("_measured", F.lit("m"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    stays, masked = brute_pipeline(rows)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces, lengths = Counter(), {}
    for r in out:
        pieces[r.doc_id] += r.length
        lengths.setdefault(r.doc_id, Counter())[r.doc_tokens] += r.length
    tokenizer = Tokenizer.from_file(default_tokenizer())
    count = lambda t: len(tokenizer.encode(masked[t], add_special_tokens=False).ids) + 1
    assert set(pieces) == set(stays)
    own = Counter()  # documents by id and tokens: a document's pieces add up to its tokens
    for i, c in lengths.items():
        for tokens, n in c.items():
            assert n % tokens == 0
            own[i] += n // tokens
    assert own == stays
    for i, t in rows:
        if i is not None and Counter(x for x, _ in rows)[i] == 1 and stays[i]:
            assert pieces[i] == count(t)


def test_pipeline_on_an_empty_table(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
