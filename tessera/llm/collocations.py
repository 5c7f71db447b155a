"""Phrase collocation mining: merged count-min sketches, then exact counts of what survives them.

1. Each task counts the hashes of all phrases of one to ``longest`` words in a sketch of
   ``DEPTH`` rows of one-byte counters that stop at 255. Sketches are cut into blocks, blocks
   are added up over tasks, and of each counter only one bit remains: has it reached
   ``min_count``? A counter holds at least what each of its phrases has, so no
   frequent phrase fails the test.
2. The second pass counts exactly, by the phrase itself, what passes: a phrase all of whose parts
   pass as well. Parts of a frequent phrase are at least as frequent, so that loses nothing,
   and the counts of all parts that scores need are among them. Counts are added up
   in a span, in a task and after the shuffle; tasks are few and large, so that most is added up before it.
3. Cuts are joined with the counts of both their parts; scores are exact (decimals).
   A candidate is subsumed by one a word longer if by any (the counts of those between lie between),
   so the two longest parts of each candidate are all that is compared.

The sketch has a counter for each ``1 / CELLS_PER_BYTE`` bytes of text, within ``BITS``: beyond
the upper bound more phrases survive and are counted, and no result changes.
The bits that go to all tasks are at most 32 MB.

Defined results: a null text is empty; a null language is ``und``, together with rows that
say so; repeated rows and ids count again; texts are read whole (in spans that end at a break);
an empty table or one without a frequent phrase gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, map_texts, materialize, shuffle_partitions
from .words import Words, byte_classes, spans

MIN_COUNT, LONGEST, TOP, SUBSUMED_PERCENT = 100, 5, 2000, 100
DEPTH = 2
#: Powers of two of a row's counters, at least and at most.
BITS = (16, 27)
#: Counters of a row for each byte of text: some 50 phrases a counter.
CELLS_PER_BYTE = 1 / 64
#: Counters in a block that is sent.
BLOCK = 1 << 18
#: Different phrases whose counts a task holds.
HELD_ROWS = 400_000
#: Rows of counts (some 100 bytes each) that are broadcast.
BROADCAST_COUNTS = 200_000
CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Exact while ``1000 * a * n`` has at most 38 digits; beyond that Spark raises an error.
_SCORE = "(1000BD * cast(cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) as decimal(34, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * odd) >> np.uint64(64 - bits)).astype(np.uint32) for odd in _ODD[:DEPTH]]


def _languages(batch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The batch's languages, each row's place among them, and their hashes."""
    coded = batch.column("lang").fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    return names, coded.indices.to_numpy().astype(np.int64), np.array([xxhash.xxh64_intdigest(x, 7) for x in names], np.uint64)


def _longer(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    return _mixed(h * np.uint64(31) + own)


def _sketched(bits: int, longest: int):
    def run(batches):
        sketch, step = np.zeros((DEPTH, 1 << bits), np.uint8), min(BLOCK, 1 << bits)
        for batch in batches:
            _, lang, seeds = _languages(batch)
            for w in spans(batch.column("text"), CLASSES):
                own = w.hashes()[w.code]
                h = _mixed(own ^ seeds[lang[w.row]])
                for k in range(1, longest + 1):
                    if k > 1:
                        h = _longer(h[:-1], own[k - 1 :])
                    if len(h) == 0:
                        break
                    here = h[w.piece[: len(h)] == w.piece[k - 1 :]]
                    for row, cells in zip(sketch, _cells(here, bits), strict=True):
                        cells.sort()
                        new = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else cells
                        at = cells[new]
                        row[at] = np.minimum(row[at] + np.diff(np.append(new, len(cells))), 255).astype(np.uint8)
        for d in range(DEPTH):
            for b in range(0, 1 << bits, step):
                block = sketch[d, b : b + step]
                if block.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([(d << bits | b) // step], pa.int64()), "cells": pa.array([block.tobytes()], pa.binary())})

    return run


def _reached(least: int):
    """A bit for each counter of a block, from the block's rows, which come together."""

    def run(batches):
        at, held = None, None
        pack = lambda: pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "bits": pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())})
        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                own = np.frombuffer(cells.as_buffer(), np.uint8).astype(np.uint16)
                if block == at:
                    held = np.minimum(held + own, 255)
                else:
                    if at is not None:
                        yield pack()
                    at, held = block, own
        if at is not None:
            yield pack()

    return run


def merged_sketch(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """The width of a row as a power of two, and a bit for each counter that has reached ``min_count``; at most ``2 ** BITS[1] / 4`` bytes."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = min(max(int(size * CELLS_PER_BYTE).bit_length(), BITS[0]), BITS[1])
    # a sketch for each core: what is sent follows the input by the sketch's size alone
    read = docs.select("lang", "text").coalesce(spark.sparkContext.defaultParallelism)
    blocks = map_texts(read, _sketched(bits, longest), "block long, cells binary")
    dealt = blocks.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block")
    out, step = np.zeros(DEPTH << bits >> 3, np.uint8), min(BLOCK, 1 << bits) >> 3
    for block, packed in dealt.mapInArrow(_reached(min(min_count, 255)), "block long, bits binary").collect():  # of a bounded size
        out[block * step : (block + 1) * step] = np.frombuffer(packed, np.uint8)
    return bits, out


def _passing(h: np.ndarray, bits: int, reached: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for d, cells in enumerate(_cells(h, bits)):
        at = cells.astype(np.int64) + (d << bits)
        out &= (reached[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _phrases(w: Words, joined: np.ndarray, start: np.ndarray, first: np.ndarray, k: int) -> pa.Array:
    """The phrases of ``k`` words that begin with the words at ``first``, separated by single spaces."""
    a = start[first]
    size = start[first + k - 1] + w.length[first + k - 1] - a
    bounds = np.append(0, np.cumsum(size))
    at = np.arange(bounds[-1], dtype=np.int32) + np.repeat((a - bounds[:-1]).astype(np.int32), size)
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(joined[at])]).cast(pa.string())


def _counted(bits: int, reached, longest: int):
    """(lang, phrase, words, c) of every phrase that passes, by spans; without words (0) the number of all words of the language."""

    def run(batches):
        bitmap = reached.value
        for batch in batches:
            names, lang, seeds = _languages(batch)
            named = pa.array(names, pa.string())
            for w in spans(batch.column("text"), CLASSES):
                own, of = w.hashes()[w.code], lang[w.row]
                words = np.bincount(of, minlength=len(names))
                some = np.flatnonzero(words)
                yield _rows(named.take(pa.array(some)), pa.nulls(len(some), pa.string()), 0, words[some])
                start = np.cumsum(w.length + 1) - (w.length + 1)
                joined = np.full(int(w.length.sum()) + len(start), 32, np.uint8)
                filled = np.ones(len(joined), bool)
                filled[start + w.length] = False
                joined[filled] = w.raw
                many = len(w.vocabulary)
                # place: words at which a phrase of k words begins that passes; group: which one it is; h: its hash
                place = np.arange(len(own))
                h, group = _mixed(own ^ seeds[of]), of * many + w.code
                for k in range(1, longest + 1):
                    if k > 1:
                        both = np.flatnonzero(place[1:] == place[:-1] + 1)
                        place, h, group = place[both], h[both], group[both]
                        there = w.piece[place] == w.piece[place + k - 1]
                        place, h, group = place[there], h[there], group[there]
                        last = place + k - 1
                        h, group = _longer(h, own[last]), group * many + w.code[last]
                    passing = _passing(h, bits, bitmap)
                    place, h, group = place[passing], h[passing], group[passing]
                    if len(place) == 0:
                        break
                    group, different = pd.factorize(group)
                    first = np.empty(len(different), np.int64)
                    first[group[::-1]] = place[::-1]
                    yield _rows(named.take(pa.array(of[first])), _phrases(w, joined, start, first, k), k, np.bincount(group))

    return run


def _summed(run):
    """What ``run`` yields, added up by phrase within the task as far as ``HELD_ROWS`` different ones."""

    def of(batches):
        held, fresh = [], 0
        for part in run(batches):
            held.append(part)
            fresh += len(part)
            if fresh >= HELD_ROWS // 2:
                held, fresh = [*_added_up(held)], 0
                if sum(map(len, held)) >= HELD_ROWS:
                    yield from held
                    held = []
        yield from _added_up(held)

    return of


def _added_up(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not parts:
        return []
    keys = ["lang", "phrase", "words"]
    table = pa.Table.from_batches(parts).group_by(keys).aggregate([("c", "sum")])
    return table.rename_columns([*keys, "c"]).combine_chunks().to_batches(max_chunksize=50_000)


def _rows(lang: pa.Array, phrase: pa.Array, k: int, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(lang), k, np.int32)), pa.array(count.astype(np.int64))], names=["lang", "phrase", "words", "c"])


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, words, f``: the exact count of every phrase that occurs ``min_count`` times; with 0 words a language's number of words."""
    bits, reached = merged_sketch(docs, min_count, longest)
    held = docs.sparkSession.sparkContext.broadcast(reached)
    read = docs.select("lang", "text").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)  # larger tasks add up more
    counted = map_texts(read, _summed(_counted(bits, held, longest)), "lang string, phrase string, words int, c long")
    return materialize(counted.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f")).filter((F.col("f") >= min_count) | (F.col("words") == 0)))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by the lowest score of their cuts, without those that a longer one with ``percent`` of their count holds."""
    counts = frequent_phrases(docs, min_count, longest)
    small = counts.count() <= BROADCAST_COUNTS
    sized = F.broadcast if small else lambda df: df
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), cut)
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda name, count: sized(counts.filter("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(count)))
    cuts = materialize(cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]))
    held = lambda count: (F.col("words") > 2) & (100 * F.col("a") >= percent * F.col(count))
    inside = cuts.filter((F.col("k") == F.col("words") - 1) & held("l")).select("lang", F.col("first").alias("phrase")).unionByName(cuts.filter((F.col("k") == 1) & held("r")).select("lang", F.col("rest").alias("phrase"))).distinct()
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    scored = cuts.join(sized(total), "lang").withColumn("score", F.expr(_SCORE))
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).join(inside, ["lang", "phrase"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = least.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same over the driver's tables.
OP11_SQL = r"""
with recursive texts as (
  select coalesce(lang, 'und') as lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, [x for x in regexp_split_to_array(piece, '[ \t]+') if x <> ''] as w
  from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\x0C\r]')) as piece from texts)
), totals as (
  select lang, sum(len(w))::hugeint as n from pieces group by lang
), counts as (
  select lang, k, phrase, count(*)::hugeint as f
  from (select lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase from pieces, range(1, 6) t(k) where len(w) >= k)
  group by all having count(*) >= 100
), cuts as (
  select c.lang, c.k as words, c.phrase, c.f as a, j, array_to_string(string_split(c.phrase, ' ')[:j], ' ') as first, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') as rest
  from counts c, range(1, 5) t(j) where j < c.k
), scored as (
  select u.*, x.f as l, y.f as r, n, (1000 * a * n) // (x.f * y.f) as score
  from cuts u join counts x on x.lang = u.lang and x.phrase = first and x.k = j join counts y on y.lang = u.lang and y.phrase = rest and y.k = words - j join totals t on t.lang = u.lang
), inside as (
  select distinct lang, unnest([first, rest]) as phrase, unnest([l, r]) as f, a, unnest([j = words - 1, j = 1]) as longest, words from scored
), least as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from least
  where not exists (select 1 from inside i where i.lang = least.lang and i.phrase = least.phrase and i.longest and i.words > 2 and 100 * i.a >= 100 * i.f)
) where rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
