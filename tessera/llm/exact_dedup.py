"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every input partition hashes its texts and sends each owner of a range of
   hashes its distinct hashes, sorted and Golomb-Rice coded (about
   ``log2(1/false-positive rate) + 2`` bits a hash).
2. An owner decodes what all partitions sent, marks the hashes it has from more
   than one of them, and answers each sender with a bitmap.
3. Partitions read their bitmaps; only *suspects* - texts whose short hash has
   come up elsewhere, or twice within the partition - are shuffled, and verified
   byte by byte: they are grouped on the normalised text itself.

A group of any size is harmless: a partition sends a hash once however often it
has it, and the verification aggregates map-side, so that a task forwards one
row for each distinct text.

Defined results: a null text counts as empty; all empty texts are one group; a
null ``doc_id`` sorts after every other; repeated rows (same id and text) are
members of their group like any others; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, documents, join_one, keep_rows, map_texts, materialize, schema_of, shuffle_partitions, texts

#: Hashes an owner decodes at a time, at most, on average. Owners are as few as that allows, so that
#: messages are long and the code saves something: there are never more messages than hashes.
OWNER_HASHES = 4_000_000
#: Bits of a hash beyond log2(rows): a false suspect has a chance of 2**-SPARE_BITS.
SPARE_BITS = 10
#: Duplicated hashes are broadcast up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_HASHES = 2_000_000

_UNIT = Decimal(1 << 64)
_NULL_ID = Decimal(1 << 63)
_SIGNED = "kind int, part int, doc_id long, n_chars long, sha binary, fp long, owner int, n int, low_bits int, payload binary"


def golomb_encode(sorted_values: np.ndarray, low_bits: int) -> bytes:
    """Golomb-Rice code of the gaps of ascending distinct integers: unary quotients, then fixed-width remainders."""
    if len(sorted_values) == 0:
        return b""
    gaps = np.diff(sorted_values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(low_bits)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    shifts = np.arange(low_bits, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, low])).tobytes()


def golomb_decode(blob: bytes, n: int, low_bits: int) -> np.ndarray:
    """The ``n`` integers of :func:`golomb_encode`."""
    if n == 0:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    # the n-th set bit of the stream ends the unary part: every quotient has one
    ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = bits[ends[-1] + 1 : ends[-1] + 1 + n * low_bits].reshape(n, low_bits).astype(np.uint64)
    remainders = (low << np.arange(low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(low_bits)) + remainders, dtype=np.uint64)


def normalised(text: str) -> bytes:
    """UTF-8 of the text without ASCII white space."""
    return text.encode().translate(None, ASCII_SPACE)


def _short(digest: bytes, hash_bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - hash_bits)


def _fingerprints(hash_bits: int, owners: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        mine: list[np.ndarray] = []
        for batch in batches:
            raw = texts(batch.column("text"))
            shas = [hashlib.sha256(normalised(x)).digest() for x in raw]
            fps = np.fromiter((_short(s, hash_bits) for s in shas), np.int64, len(shas))
            mine.append(np.unique(fps))
            n = len(raw)
            none = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(shas, pa.binary()), pa.array(fps), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.binary())],
                names=_NAMES,
            )
        if not mine:
            return
        own = np.unique(np.concatenate(mine)).astype(np.uint64)
        span = (1 << hash_bits) // owners + 1
        cuts = np.searchsorted(own, np.arange(owners + 1, dtype=np.uint64) * np.uint64(span))
        rows = []
        for owner, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                low_bits = max(0, int(span // (b - a)).bit_length() - 1)
                rows.append((owner, int(b - a), low_bits, golomb_encode(own[a:b] - np.uint64(owner * span), low_bits)))
        m = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, np.int32)), pa.array(np.full(m, part, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), *(pa.array([r[i] for r in rows], pa.int32()) for i in range(3)), pa.array([r[3] for r in rows], pa.binary())],
            names=_NAMES,
        )

    return run


_NAMES = [x.split()[0] for x in _SIGNED.split(", ")]


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmap for each sender: which of its hashes another sender has too."""
    sent = [golomb_decode(r.payload, r.n, r.low_bits) for r in pdf.itertuples()]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    shared = values[counts > 1]
    maps = [np.packbits(np.isin(s, shared)).tobytes() for s in sent]
    return pd.DataFrame({"part": pdf.part, "owner": pdf.owner, "n": pdf.n, "low_bits": pdf.low_bits, "payload": pdf.payload, "bitmap": maps})


def _received(hash_bits: int, owners: int):
    span = (1 << hash_bits) // owners + 1

    def run(batches):
        for b in batches:
            for owner, n, low_bits, blob, bitmap in zip(*(b.column(c).to_pylist() for c in ("owner", "n", "low_bits", "payload", "bitmap")), strict=True):
                marked = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
                hits = golomb_decode(blob, n, low_bits)[marked].astype(np.int64) + owner * span
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64())], names=["fp"])

    return run


def _suspect_texts(hash_bits: int):
    def run(batches):
        for batch in batches:
            raw = texts(batch.column("text"))
            norm = [normalised(x) for x in raw]
            shas = [hashlib.sha256(x).digest() for x in norm]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([_short(s, hash_bits) for s in shas], pa.int64()), pa.array(shas, pa.binary()), pa.array(norm, pa.binary())],
                names=["doc_id", "n_chars", "fp", "sha", "norm"],
            )

    return run


def exact_groups(docs: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """Every row's group of equal texts: ``doc_id, n_chars, sha, keep_id, group_size, is_best``.

    ``keep_id`` has the most code points in the original text, then the smallest
    id; ``is_best`` marks the rows that attain both (several, if rows are repeated).
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = docs.count() if expected_rows is None else expected_rows
    hash_bits = min(62, max(16, rows.bit_length() + SPARE_BITS))
    owners = max(shuffle_partitions(spark), -(-rows // OWNER_HASHES))
    sent = materialize(map_texts(docs, _fingerprints(hash_bits, owners), _SIGNED))
    light = sent.filter("kind = 0").select("doc_id", "n_chars", "sha", "fp", "part")
    answers = sent.filter("kind = 1").select("part", "owner", "n", "low_bits", "payload").groupBy("owner").applyInPandas(_answer, "part int, owner int, n int, low_bits int, payload binary, bitmap binary")
    answers = materialize(answers)  # else owner and receiver run in one task, with a Python worker each
    across = answers.mapInArrow(_received(hash_bits, owners), "fp long")
    within = light.groupBy("part", "fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    suspects = materialize(across.unionByName(within).distinct())
    held = suspects if suspects.count() > BROADCAST_HASHES else F.broadcast(suspects)
    # best = code points, then the smaller id, as one number, so that the aggregate keeps fixed-width buffers
    rank = F.col("n_chars").cast("decimal(38,0)") * F.lit(_UNIT)
    own_id = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(_NULL_ID))
    best = (rank - own_id).cast("decimal(38,0)")
    verified = (
        map_texts(docs, _suspect_texts(hash_bits), "doc_id long, n_chars long, fp long, sha binary, norm binary")
        .join(held, "fp", "left_semi")
        .withColumn("best", best)
        .groupBy("sha", "norm")
        .agg(F.max("best").alias("best"), F.count("*").alias("group_size"))
        .select("sha", "best", "group_size")
    )
    groups = (
        verified.groupBy("sha")
        .agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"), F.count("*").alias("variants"))
        .withColumn("group_size", F.when(F.col("variants") > 1, F.raise_error(F.lit("two different texts share a SHA-256")).cast("long")).otherwise(F.col("group_size")))
        .filter("group_size > 1")
        .select("sha", F.col("best").alias("g_best"), "group_size", F.col("group_size").alias("members"))
    )
    own = light.withColumn("best", best)
    return (
        join_one(own, materialize(groups), "sha", "members")
        .select("doc_id", "n_chars", "sha", "best", F.coalesce("g_best", "best").alias("g_best"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
        .withColumn("is_best", F.col("best") == F.col("g_best"))
        .withColumn("keep_key", (_split_id(F.col("g_best"))))
        .withColumn("keep_id", F.when(F.col("keep_key") < F.lit(_NULL_ID), F.col("keep_key").cast("long")))
        .select("doc_id", "n_chars", "sha", "keep_id", "group_size", "is_best")
    )


def _split_id(best):
    """The id in a ``chars * 2**64 - id`` key: -best modulo 2**64, brought into [-2**63, 2**63]."""
    unit = F.lit(_UNIT)
    r = F.pmod(-best, unit).cast("decimal(38,0)")
    return F.when(r > F.lit(_NULL_ID), r - unit).otherwise(r)


def _with_digest(docs: DataFrame) -> DataFrame:
    """SHA-256 and number of code points as ``_row_key``."""

    def run(batches):
        for batch in batches:
            raw = texts(batch.column("text"))
            keys = [hashlib.sha256(normalised(x)).digest() + len(x).to_bytes(8, "big") for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "_row_key"])

    return map_texts(docs, run, schema_of(docs, T.StructField("_row_key", T.BinaryType())))


def keep_one(docs: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns unchanged."""
    key = F.concat("sha", F.unhex(F.lpad(F.hex("n_chars"), 16, "0")))
    decided = exact_groups(docs, expected_rows).select("doc_id", key.alias("key"), F.col("is_best").alias("keep"))
    return keep_rows(docs, materialize(decided), _with_digest)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", F.col("is_best").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
