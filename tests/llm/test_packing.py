import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import END_ID, default_tokenizer, nnls, pack, patterns, plan
from tessera.llm.tokens import BpeIds


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(plain, corpus):
    ours = BpeIds(default_tokenizer())
    odd = ["a  b", " a", "a ", "a\n\nb", "a\nb", "it's don't’s", "x y z", "1 2 3.14 a1b", "　", "a \n b", "tab\t x", "…a …b", "\x1c a\x85b c", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|endoftext|", "x" + " " * 1_100_000 + "y", "\n" * 1_000_500]
    for text in [t or "" for _, t in corpus] + odd:
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == plain(text), repr(text[:80])


def test_every_id_in_one_piece_and_sequences_gapless(spark, docs_of, corpus, plain):
    rows = pack(docs_of(corpus), default_tokenizer(), keep_ids=True).collect()
    got = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    want = defaultdict(list)
    for i, t in corpus:
        want[i] += [*plain(t or ""), END_ID]
    for i, pieces in got.items():
        assert sum(len(p[1]) for p in pieces) == len(want[i])
        assert sorted(x for p in pieces for x in p[1]) == sorted(want[i])
        if len({p[2] for p in pieces}) == 1 and sum(len(p[1]) for p in pieces) == pieces[0][2]:
            assert [x for p in sorted(pieces) for x in p[1]] == want[i]
    assert set(got) == set(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist()
        assert sum(n for _, n in s) <= 1024


def test_empty_table(spark, docs_of):
    assert pack(docs_of([]), default_tokenizer()).count() == 0


def test_plan_uses_every_length_once_and_pads_little():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 1025, 50_000), minlength=1025)
    runs = plan(counts)
    assert {(int(a), int(b)) for a, b in runs[:, :2]} and (np.bincount(runs[:, 0], minlength=1025) > 0).tolist() == (counts > 0).tolist()
    total = int((counts * np.arange(1025)).sum())
    ends = [runs[runs[:, 0] == n] for n in range(1, 1025)]
    for n, r in enumerate(ends, 1):  # ranks of a length are covered from 0 on
        if counts[n]:
            assert r[0, 1] == 0 and (np.diff(r[:, 1]) > 0).all() and r[-1, 1] < counts[n]
    sequences = runs[:, 2].max() + 1
    assert sequences <= 1.02 * total / 1024 + 1


def test_least_squares_against_a_dense_solver():
    shape = patterns(12)
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 9, len(shape)).astype(float)
    dense = np.zeros((12, len(shape)))
    for j, p in enumerate(shape):
        for v in p[p > 0]:
            dense[v, j] += 1
    x = nnls(shape, dense @ truth, 3000)
    assert (x >= 0).all() and np.abs(dense @ x - dense @ truth).max() < 1e-3
