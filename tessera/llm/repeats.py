"""Repeated passages by sparse suffix arrays at minimiser positions.

1. Of every ``window`` successive ``gram``-word shingles the least hash is retained.
   A passage of ``least`` words that two documents share has the same retained
   positions in both, the first within its first ``window`` words.
2. Retained hashes that only one document has are dropped by a key-only aggregate.
3. For the rest the suffix - the next ``least`` words as 32-bit word hashes - and the
   ``window - 1`` words before it are cut from the texts. Suffixes are range-sorted
   over the whole corpus; each is compared with its neighbours from other documents,
   and the match extended to the left and the right. Ties in the sort go by document
   and position, so a passage that a third of all documents share is spread over tasks.
4. The best neighbour to the right isn't always the best to the left. Suffixes
   whose beginning is found at three or more places, and whose match stops within the
   context, and those at the edge of a task, are resolved exactly: they, and all
   with the same beginning, are grouped on the hashes of every ``least``-word
   window around them.
5. Spans are merged document by document.

Defined results: words are separated by ASCII white space; null, empty and short
texts have no spans; texts are read whole; rows with the same id and text are one
document, so they don't repeat each other; repetition inside one document doesn't
count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, documents, join_one, map_texts, materialize, shuffle_partitions, texts

LEAST = 50
GRAM = 8
WINDOW = 32
#: Suffixes that a task sorts and compares, on average.
TASK_SUFFIXES = 100_000


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` successive words."""
    mixed = _mixed(words.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x100000001B3) + mixed[j : j + len(out)]
    return _mixed(out)


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the leftmost of equals) of every window."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    found = []
    for at in range(0, len(hashes) - window + 1, 1 << 16):  # in blocks, as a text may be very long
        least = hashes[at : at + (1 << 16) + window - 1]
        where, width = np.arange(len(least)), 1
        while width < window:  # least of `width` successive hashes, and its place
            k = min(width, window - width)
            later = least[k:] < least[:-k]
            least, where, width = np.where(later, least[k:], least[:-k]), np.where(later, where[k:], where[:-k]), width + k
        found.append(where[np.append(True, where[1:] != where[:-1])] + at)
    return np.unique(np.concatenate(found))


def _retained(least: int, gram: int, window: int):
    def run(batches):
        for batch in batches:
            keys, at, hashes = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), texts(batch.column("text")), strict=True):
                words = word_hashes(text)
                if len(words) >= least:
                    h = shingle_hashes(words, gram)
                    p = minimisers(h, window)
                    keys.append(np.full(len(p), key, np.int64))
                    at.append(p)
                    hashes.append(h[p].view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hashes))], names=["key", "pos", "hash"])

    return run


def _contexts(least: int, window: int):
    """Suffix and preceding words (nearest first) of each listed position, as big-endian hashes; 0 pads, as hashes are never it."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text, at in zip(batch.column("key").to_pylist(), texts(batch.column("text")), batch.column("at").to_pylist(), strict=True):
                words = np.maximum(word_hashes(text), 1)
                padded = np.concatenate([np.zeros(window - 1, np.uint32), words, np.zeros(least, np.uint32)]).astype(">u4")
                for p in sorted(at):
                    out[0].append(key)
                    out[1].append(p)
                    out[2].append(padded[p + window - 1 : p + window - 1 + least].tobytes())
                    out[3].append(padded[p : p + window - 1][::-1].tobytes())
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), names=["key", "pos", "suffix", "before"])

    return run


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading equal words, row by row, up to the first padding."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, width).astype(np.uint32)


def _compared(least: int, window: int):
    """kind 0: a match ``[begin, end)``; kind 1: the beginning ``head`` of a suffix that needs the exact way."""
    head_words = least - window + 1
    names = ["kind", "key", "begin", "end", "head"]

    def run(batches):
        held = [b for b in batches if len(b)]  # a task's share of the sorted suffixes, bounded by TASK_SUFFIXES on average
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, pos = table.column("key").to_numpy(), table.column("pos").to_numpy().astype(np.int64)
        n = len(key)
        suffix, before = _matrix(table.column("suffix"), least), _matrix(table.column("before"), window - 1)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        begun = suffix[:, head_words - 1] != 0
        same = np.append(False, (suffix[1:, :head_words] == suffix[:-1, :head_words]).all(1))
        group = np.cumsum(~same) - 1
        rows_in = np.bincount(group)[group]
        edge = (group == 0) | (group == group[-1])  # others of the group may be in the next task
        left, right, reach = (np.zeros(n, np.int64) for _ in range(3))
        match = np.zeros(n, bool)
        for other in (first[run_of] - 1, np.append(first, n)[run_of + 1]):
            there = (other >= 0) & (other < n)
            i, j = np.flatnonzero(there), other[there]
            r, l = _agree(suffix[i], suffix[j]), _agree(before[i], before[j])  # noqa: E741
            reach[i] = np.maximum(reach[i], r)
            long = r + l >= least
            match[i] |= long
            left[i] = np.maximum(left[i], np.where(long, l, 0))
            right[i] = np.maximum(right[i], np.where(long, r, 0))
        # a third document, or another place of the second, may agree further where a neighbour stops within the context
        whole = match & (left == window - 1) & (right == reach)
        open_ = begun & (edge | (reach >= head_words) & (rows_in > 2) & ~whole)
        heads = shingle_hashes(suffix[open_, :head_words].ravel(), head_words)[::head_words].view(np.int64) if open_.any() else np.empty(0, np.int64)
        heads = np.unique(heads)
        m, h = int(match.sum()), len(heads)
        zeros = lambda k: np.zeros(k, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([zeros(m), zeros(h) + 1]).astype(np.int32)), pa.array(np.concatenate([key[match], zeros(h)])), pa.array(np.concatenate([(pos - left)[match], zeros(h)])), pa.array(np.concatenate([(pos + right)[match], zeros(h)])), pa.array(np.concatenate([zeros(m), heads]))],
            names=names,
        )

    return run


def _headed(least: int, window: int):
    """Each row's head, beside the row."""
    head_words = least - window + 1

    def run(batches):
        for b in batches:
            suffix = _matrix(b.column("suffix"), least)[:, :head_words]
            heads = shingle_hashes(np.ascontiguousarray(suffix).ravel(), head_words)[::head_words].view(np.int64) if len(suffix) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads)], names=[*b.schema.names, "head"])

    return run


def _windows(least: int, window: int):
    """Hashes of all whole ``least``-word windows that a row's context covers and its position lies in."""

    def run(batches):
        for b in batches:
            key, pos = b.column("key").to_numpy(), b.column("pos").to_numpy().astype(np.int64)
            words = np.concatenate([_matrix(b.column("before"), window - 1)[:, ::-1], _matrix(b.column("suffix"), least)], axis=1)
            absent = np.concatenate([np.zeros((len(words), 1), np.int64), np.cumsum(words == 0, 1)], 1)
            whole = (absent[:, least:] - absent[:, :-least]) == 0
            flat = shingle_hashes(words.ravel(), least) if len(words) else np.empty(0, np.uint64)  # also across rows; those aren't looked up
            row, t = np.nonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(pos[row] - (window - 1) + t), pa.array(flat[row * words.shape[1] + t].view(np.int64))], names=["key", "begin", "hash"])

    return run


def _shared(rows: DataFrame, column: str) -> DataFrame:
    """The written ``rows`` whose ``column`` another document has too; a value that very many have is spread over tasks."""
    counted = rows.groupBy(column).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("rows")).filter("a < b").select(column, "rows")
    return join_one(rows, materialize(counted), column, "rows", "inner")


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key``: one key for rows alike in id and text, and different ones for all others.

    Keys are 64-bit hashes; the few that documents of different second hashes have in common - some ten in
    2 * 10**10 documents - are replaced by those.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("second"))
    clash = materialize(hashed.groupBy("key").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a < b").select("key"))
    if clash.isEmpty():
        return hashed.drop("second")
    marked = hashed.join(F.broadcast(clash.withColumn("clash", F.lit(True))), "key", "left")
    return marked.select("doc_id", "text", F.when(F.col("clash"), F.xxhash64("key", "second")).otherwise(F.col("key")).alias("key"))


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, begin_word, end_word`` of every merged span of at least ``least`` words that another document has too."""
    if least - gram + 1 < window or least - window + 1 < gram:
        raise ValueError("a passage must hold a whole window of shingles, and a suffix's beginning a whole shingle")
    spark, keyed = docs.sparkSession, _keyed(docs)
    retained = materialize(map_texts(keyed.select("key", "text"), _retained(least, gram, window), "key long, pos int, hash long"))
    wanted = _shared(retained, "hash").groupBy("key").agg(F.collect_set("pos").alias("at"))  # a document's own positions
    one_each = keyed.join(wanted, "key").dropDuplicates(["key"]).select("key", "text", "at")
    suffixes = materialize(map_texts(one_each, _contexts(least, window), "key long, pos int, suffix binary, before binary"))
    n = max(shuffle_partitions(spark), -(-suffixes.count() // TASK_SUFFIXES))
    ordered = suffixes.repartitionByRange(n, "suffix", "key", "pos").sortWithinPartitions("suffix", "key", "pos")
    found = materialize(ordered.mapInArrow(_compared(least, window), "kind int, key long, begin long, end long, head long"))
    heads = materialize(found.filter("kind = 1").select("head").distinct())
    headed = suffixes.mapInArrow(_headed(least, window), "key long, pos int, suffix binary, before binary, head long")
    if heads.count() <= BROADCAST_ROWS:
        doubtful = headed.join(F.broadcast(heads), "head", "left_semi")
    else:
        doubtful = join_one(headed, materialize(headed.groupBy("head").agg(F.count("*").alias("rows")).join(heads, "head", "left_semi")), "head", "rows", "inner")
    windows = materialize(doubtful.mapInArrow(_windows(least, window), "key long, begin long, hash long"))
    exact = _shared(windows, "hash").select("key", "begin", (F.col("begin") + least).alias("end"))
    spans = found.filter("kind = 0").select("key", "begin", "end").unionByName(exact)
    # spans that overlap or touch are one: a new one begins beyond all earlier ends
    earlier = Window.partitionBy("key").orderBy("begin", "end")
    reach = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (reach < F.col("begin"))).cast("int"))
    numbered = marked.withColumn("span", F.sum("new").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    per_key = numbered.groupBy("key", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("span")
    ids = keyed.select("doc_id", "key").distinct()
    return ids.join(per_key, "key").select("doc_id", F.col("begin").alias("begin_word"), F.col("end").alias("end_word"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).withColumn("n_words", F.col("end_word") - F.col("begin_word"))
