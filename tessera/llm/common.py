"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space bytes; ``bytes.split()`` and this set agree.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the table, never
    a recomputation. Only light tables (keys, digests, flags) go through here.
    The folder is removed when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a worker is handed at once; with Spark's 10,000 a batch of long texts is several copies of many megabytes.
BATCH_ROWS = 1_000
#: Bytes of text that are Python objects at once; a longer text stands alone.
BATCH_BYTES = 16 << 20


def _slices(batches, column: str):
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)), 0
        while at < len(ends):
            most = (ends[at - 1] if at else 0) + BATCH_BYTES
            upto = max(at + 1, int(np.searchsorted(ends, most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def map_texts(docs: DataFrame, fn, schema, column: str = "text") -> DataFrame:
    """``docs.mapInArrow(fn, schema)`` with batches that are bounded in rows and in bytes of ``column``.

    The bound on rows is a setting of the session, which the plan takes up when it
    runs: it is lowered where it is higher.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs.mapInArrow(lambda batches: fn(_slices(batches, column)), schema)


#: Rows of two numbers that are broadcast (some 32 MB); a larger table is joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, with a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows of one key that a task is given at most; keys with more are joined by a broadcast.
HOT_ROWS = 100_000


def join_one(big: DataFrame, small: DataFrame, key: str, rows: str, how: str = "left", whole: int = BROADCAST_ROWS) -> DataFrame:
    """``big`` joined with the written table ``small``, which has one row a key and says in column ``rows`` how many rows of ``big`` have it.

    A table of up to ``whole`` rows is broadcast whole. Of a larger one the keys with over ``HOT_ROWS``
    rows are - there is at most one for each ``HOT_ROWS`` rows of ``big`` - so that no
    task of the shuffle join gets more than its share.
    """
    if whole and small.count() <= whole:
        return big.join(F.broadcast(small.drop(rows)), key, how)
    hot = F.broadcast(small.filter(F.col(rows) > HOT_ROWS).drop(rows))
    rest = small.filter(F.col(rows) <= HOT_ROWS).drop(rows)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(rest, key, how))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema_of(df: DataFrame, *extra: T.StructField) -> T.StructType:
    """The input's own schema followed by ``extra``."""
    return T.StructType([*df.schema.fields, *extra])


def texts(column) -> list[str]:
    """An Arrow string column as Python strings; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def keep_rows(docs: DataFrame, decided: DataFrame, keyed) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps, and one of those alike in id and key; columns unchanged.

    ``decided`` is a written table with ``doc_id``, ``key`` and ``keep`` of every row. An id
    decides where all its rows go one way; else, ids being null or repeated, the key does:
    ``keyed(docs)`` appends it as column ``_row_key``, and is asked of those rows alone.
    """
    columns, own = docs.columns, F.col("doc_id").isNull()
    by_id = materialize(decided.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("keep").alias("any")).filter("n > 1 or not any").select(F.col("doc_id").alias("_id"), "any"))
    null = by_id.filter("_id is null").first()
    listed = small_or_shuffled(by_id.filter("_id is not null"))
    plain = docs.filter(~own).join(listed, F.col("doc_id") == F.col("_id"), "left_anti")
    if null is None:
        plain = plain.unionByName(docs.filter(own))
    if by_id.filter("any").isEmpty():
        return plain
    mixed = docs.filter(~own).join(small_or_shuffled(by_id.filter("any and _id is not null")), F.col("doc_id") == F.col("_id"), "left_semi")
    if null is not None and null["any"]:
        mixed = mixed.unionByName(docs.filter(own))
    held = materialize(decided.join(small_or_shuffled(by_id.filter("any")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").filter("keep").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct())
    kept = keyed(mixed).join(small_or_shuffled(held), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key")), "left_semi")
    return plain.unionByName(kept.dropDuplicates(["doc_id", "_row_key"]).select(*columns))
