"""Token counts for every context limit from one exact length histogram.

Documents are encoded once and counted by length; the histogram is the only thing
that is ever shuffled (a task sends one row for each length it has seen). Suffix
sums over it answer, for any limit L, how many documents and tokens are at or
beyond L, what remains when documents are cut at L, and quantiles. The sums have
two levels - within blocks of ``BLOCK`` lengths, and over blocks - so no task sees
the whole histogram, however long documents get.

Defined results: a null or empty text has length 0; texts are encoded whole;
repeated rows count each; an empty table has an empty histogram; other columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, map_texts, materialize, texts
from .packing import default_tokenizer
from .tokens import bpe

BLOCK = 64


def _lengths(path: str):
    def run(batches):
        encoder = bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoder.counted(t) for t in texts(batch.column("text"))], pa.int64())], names=["n_tokens"])

    return run


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``n_tokens, n_docs``."""
    return map_texts(docs.select("text"), _lengths(tokenizer), "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens of documents of L or more, the corpus cut at L, how many documents are up to L, and how many there are."""
    hist = materialize(hist.select("n_tokens", "n_docs"))
    block = F.floor(F.col("n_tokens") / BLOCK)
    rows = hist.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.select("block", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("tokens_later"), F.sum("d").over(Window.partitionBy(F.lit(1))).alias("docs"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    docs_ge = F.col("docs_later") + F.sum("n_docs").over(inside)
    tokens_ge = F.col("tokens_later") + F.sum("tokens").over(inside)
    out = rows.join(later, "block").select("n_tokens", "n_docs", docs_ge.alias("docs_at_least"), tokens_ge.alias("tokens_at_least"), "docs", "all_tokens")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        (F.col("docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"), "docs",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context, docs_over, truncated_total``: what each limit leaves, from the suffix sums alone."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    whole = sums.agg(F.max("truncated_total")).first()[0] or 0
    # the first length beyond the limit carries the sums of everything from there on
    beyond = sums.join(F.broadcast(asked), sums["n_tokens"] > asked["context"]).groupBy("context").agg(F.max("docs_at_least").alias("over"), F.max("tokens_at_least").alias("tokens_over"))
    return asked.join(beyond, "context", "left").select("context", F.coalesce("over", F.lit(0)).alias("docs_over"), (F.lit(whole) - F.coalesce("tokens_over", F.lit(0)) + F.col("context") * F.coalesce("over", F.lit(0))).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that so many documents don't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(asked), sums["docs_up_to"] / sums["docs"] >= asked["share"]).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(documents(spark, sf_dir), default_tokenizer()))
