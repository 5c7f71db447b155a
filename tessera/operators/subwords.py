"""Subword counts by ranked merges: different words are counted first, each is merged once, and the sizes are joined back.

Words are cut out by the published pattern of byte-level encodings, in the JVM; the number of different words grows much slower
than the text. Words that stand in many documents are broadcast, the others are joined by a shuffle, so no task gets a hot word whole.

Defined results: a null or empty text has no tokens; rows with one key are one document; texts are read whole.
"""

from __future__ import annotations

import base64
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.tables import written

#: Fixed value: the published pattern; white space as Unicode has it.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a word from which on it is broadcast, and the words that are broadcast whatever their documents.
HOT_DOCUMENTS, SMALL = 100_000, 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``: some tens of thousands."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The word's tokens: of all neighbours the pair of the lowest rank is merged, the leftmost of equal ones first, until none has a rank."""
    if word in ranks or len(word) < 2:
        return [word] if word else []
    end, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # of the symbol that begins at a place
    live = [True] * len(word)

    def offer(a: int) -> None:
        b = end[a]
        if b < len(word) and (rank := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(len(word)):
        offer(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not live[a] or end[a] != b or not live[b] or end[b] != c:
            continue  # one of the two has been merged meanwhile
        end[a], live[b] = c, False
        if c < len(word):
            before[c] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, at = [], 0
    while at < len(word):
        out.append(word[at : end[at]])
        at = end[at]
    return out


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, word, n``: how often each word stands in each document."""
    cut = df.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("word"))
    return cut.groupBy("key", "word").agg(F.count("*").alias("n"))


def word_sizes(found: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``word, documents, size``: each different word of :func:`words` once, with its number of tokens."""
    held = found.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for batch in batches:
            sizes = [len(merged(w.encode(), held.value)) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=["word", "documents", "size"])

    return found.groupBy("word").agg(F.count("*").alias("documents")).mapInArrow(run, "word string, documents long, size long")


def token_counts(df: DataFrame, key: str, text: str, ranks: dict[bytes, int]) -> DataFrame:
    """``key, tokens`` of every document."""
    found = written(words(df, key, text))
    sizes = written(word_sizes(found, ranks))
    if sizes.count() <= SMALL:
        sized = found.join(F.broadcast(sizes.select("word", "size")), "word")
    else:
        hot = F.broadcast(sizes.filter(F.col("documents") > HOT_DOCUMENTS).select("word", "size"))
        rest = sizes.filter(F.col("documents") <= HOT_DOCUMENTS).select("word", "size")
        sized = found.join(hot, "word").unionByName(found.join(hot.select("word"), "word", "left_anti").join(rest, "word"))
    counts = sized.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"))
    return df.select(F.col(key).alias("key")).distinct().join(counts.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").select("key", F.coalesce("tokens", F.lit(0)).alias("tokens"))
