"""Packing token sequences by non-negative least squares over a length histogram.

1. One pass encodes every document, closes it with an end id and cuts it into
   full windows and a remainder. A partition numbers its pieces by length as it
   goes, so that no shuffle is needed to rank them.
2. The histogram of remainders (at most ``window - 1`` numbers, whatever the
   input) goes to the driver. All pairs and triples of lengths that fill a window
   exactly are enumerated; non-negative least squares finds how often to use
   each; the counts are rounded within what is there, and what remains is packed
   greedily, longest first with the best fit.
3. The plan is a short list of runs: for a length, ranks ``a..b`` go to sequences
   ``s..`` at one offset. Each piece looks up its rank.

Defined results: a null or empty text is one piece with the end id alone; texts are
encoded whole; repeated rows are packed one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, map_texts, materialize, texts
from .tokens import bpe

WINDOW = 1024
END_ID = 0
NNLS_STEPS = 400


def patterns(window: int) -> np.ndarray:
    """All ascending pairs and triples of lengths with sum ``window``; pairs have 0 as the third."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    triples = np.stack([a, b, c], -1)[(a <= b) & (b <= c)]
    half = np.arange(1, window // 2 + 1)
    pairs = np.stack([half, window - half, np.zeros_like(half)], -1)
    return np.concatenate([pairs, triples])


def nnls(shape: np.ndarray, target: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative repeat counts of the patterns, least squares against ``target``, by accelerated projected gradient.

    A pattern's column has its lengths' multiplicities; it is never built: products are gathers and ``bincount``.
    """
    size = len(target)
    flat = shape.ravel()

    def forward(x):
        out = np.bincount(flat, np.repeat(x, shape.shape[1]), size)
        out[0] = 0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[shape].sum(1)

    v = np.ones(len(shape))
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(shape))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - target) / (norm * 1.02))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(shape: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[list[int], int]]:
    """Whole repeat counts, largest first, within ``left``, which is reduced by them."""
    out = []
    for i in np.argsort(-x, kind="stable"):
        want = int(x[i] + 0.5)
        if want == 0:
            break
        lengths = [int(v) for v in shape[i] if v]
        kinds, times = np.unique(lengths, return_counts=True)
        n = min(want, int((left[kinds] // times).min()))
        if n > 0:
            left[kinds] -= n * times
            out.append((lengths, n))
    return out


def greedy(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Longest first, then always the longest that still fits; equal sequences are counted, not listed."""
    out = []
    while True:
        there = np.flatnonzero(left)
        if len(there) == 0:
            return out
        free, lengths, used = window, [], np.zeros_like(left)
        while True:
            fits = there[(there <= free) & (left[there] > used[there])]
            if len(fits) == 0:
                break
            best = int(fits[-1])
            lengths.append(best)
            used[best] += 1
            free -= best
        kinds = np.flatnonzero(used)
        n = int((left[kinds] // used[kinds]).min())
        left -= n * used
        out.append((lengths, n))


def plan(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset), sorted, from ``counts[length]``."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    full, left[window] = int(left[window]), 0
    shape = patterns(window)
    used = left[shape]
    used[shape == 0] = 1
    shape = shape[(used > 0).all(1)]
    layout = rounded(shape, nnls(shape, left.astype(float)), left) if len(shape) else []
    layout += greedy(left, window)
    if full:
        layout.append(([window], full))
    ranks, sequence, runs = np.zeros(window + 1, np.int64), 0, []
    for lengths, n in layout:
        offset = 0
        for length in lengths:
            runs.append((length, ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def _cut(path: str, window: int, keep_ids: bool):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder, part, ranks = bpe(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64).tolist()
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            payload = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                ids = encoder.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    for column, value in zip(rows, (doc_id, start, length, zlib.crc32(piece), total, ranks[length]), strict=True):
                        column.append(value)
                    ranks[length] += 1
                    if keep_ids:
                        payload.append(np.frombuffer(piece, "<u4").astype(np.int32))
            n = len(rows[0])
            made = [pa.array(np.full(n, part, np.int32)), *(pa.array(r, pa.int64()) for r in rows)]
            yield pa.RecordBatch.from_arrays(made + [pa.array(payload, pa.list_(pa.int32()))] * keep_ids, names=["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local"] + ["ids"] * keep_ids)

    return run


def _placed(runs: np.ndarray, keep_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches):
        stride = np.int64(1) << np.int64(50)
        keys = runs[:, 0] * stride + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * stride + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset``."""
    ids = ", ids array<int>" * keep_ids
    pieces = materialize(map_texts(docs.select("doc_id", "text"), _cut(tokenizer, window, keep_ids), f"part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long{ids}"))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = np.zeros(window + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[r.length] = r.n
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("local") + F.col("before"))
    return ranked.mapInArrow(_placed(plan(counts, window), keep_ids), f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long{ids}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
