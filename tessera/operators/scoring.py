"""Batch map and scoring: a model over a column, exact match, mismatches, tokenised training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import columns as C


def exact_match(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.col(prediction).eqNullSafe(F.col(reference)).cast("double")), 9).alias("exact_match"), F.count("*").alias("n"))


def mismatches(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    return df.filter(~F.col(prediction).eqNullSafe(F.col(reference)))


def with_results(df: DataFrame, results: DataFrame, key: str, name: str, default: str = "{}") -> DataFrame:
    """``df`` with each row's result, or the default where there is none."""
    return df.join(results.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def zipped(predictions: DataFrame, references: DataFrame, batch: str = "batch", position: str = "pos") -> DataFrame:
    """Two tables joined by the place of a row in its batch; what has no partner has a null."""
    return predictions.join(references, [batch, position], "full_outer")


def accepted(df: DataFrame, prediction: str, reference: str, threshold: float = 0.8) -> bool:
    """Is the share of exact matches over the threshold?"""
    return (exact_match(df, prediction, reference).first().exact_match or 0.0) > threshold


def infer(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 12, name: str = "output") -> DataFrame:
    """An injected model over a column, in order and in groups of ``batch`` that run on across what Arrow hands over; ``make`` is called once a task.

    A model that gives another number of answers than it was asked is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = make(), pd.DataFrame()

        def answered(rows: pd.DataFrame) -> pd.DataFrame:
            asked = rows[column].tolist()
            got = model(asked)
            if len(got) != len(asked):
                raise ValueError(f"{len(got)} answers to {len(asked)} questions")
            return rows.assign(**{name: got})

        for f in frames:
            held = pd.concat([held, f], ignore_index=True) if len(held) else f
            while len(held) >= batch:
                yield answered(held.iloc[:batch])
                held = held.iloc[batch:]
        if len(held):
            yield answered(held)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def token_batches(df: DataFrame, ids: str, budget: int, pad: int = 0, partitions: int | None = None) -> DataFrame:
    """``df`` with ``batch, width, padded, mask``: rows of like length together, each batch as many as fit ``budget`` places when all are padded to its longest.

    Rows are dealt by ranges of length and sorted in them, so that a batch pads little, whatever the longest row of the table; a row longer than
    the budget is a batch by itself. ``batch`` is unique; its numbers depend on the partitions, the rows' padding to their batch doesn't lose any.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.size(ids), F.lit(0))
    sized = df.withColumn("_size", F.greatest(size, F.lit(0))).repartitionByRange(n, "_size", F.xxhash64(*(F.col(c) for c in df.columns))).sortWithinPartitions("_size")
    sized = sized.withColumn("_part", F.spark_partition_id().cast("long"))

    def run(batches):
        number, used, widest, at = 0, 0, 0, None
        for frame in batches:
            marks = []
            for part, length in zip(frame["_part"], frame["_size"], strict=True):
                if at != part or (used and (used + 1) * max(widest, length, 1) > budget):
                    number, used, widest, at = number + 1, 0, 0, part
                used, widest = used + 1, max(widest, length)
                marks.append((int(part) << 40) + number)
            yield frame.assign(batch=marks)

    marked = sized.mapInPandas(run, T.StructType([*sized.schema.fields, T.StructField("batch", T.LongType())]))
    width = F.max("_size").over(Window.partitionBy("batch"))  # at most ``budget`` places
    whole = marked.withColumn("width", width).drop("_part")
    own = F.coalesce(ids, F.array().cast(df.schema[ids].dataType))
    return whole.withColumns({"padded": F.concat(own, F.array_repeat(F.lit(pad).cast(df.schema[ids].dataType.elementType), F.col("width") - F.col("_size"))), "mask": F.concat(F.array_repeat(F.lit(1), F.col("_size")), F.array_repeat(F.lit(0), F.col("width") - F.col("_size")))}).drop("_size")


def infer_by_tokens(df: DataFrame, ids: str, make: Callable[[], Callable[[list[list[int]]], list[str]]], budget: int, pad: int = 0, name: str = "output") -> DataFrame:
    """``df`` with an injected model's answers, asked in :func:`token_batches`; columns and rows are ``df``'s, in no set order: sort by a key of your own."""
    ready = token_batches(df, ids, budget, pad).repartition("batch").sortWithinPartitions("batch")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = make(), None

        def answered(rows: pd.DataFrame) -> pd.DataFrame:
            asked = [list(map(int, x)) for x in rows["padded"]]
            got = model(asked)
            if len(got) != len(asked):
                raise ValueError(f"{len(got)} answers to {len(asked)} questions")
            return rows.drop(columns=["batch", "width", "padded", "mask"]).assign(**{name: got})

        for f in frames:
            held = pd.concat([held, f], ignore_index=True) if held is not None else f
            whole = held["batch"] != held["batch"].iloc[-1] if len(held) else held["batch"].astype(bool)
            for _, rows in held[whole].groupby("batch", sort=False):
                yield answered(rows)
            held = held[~whole]
        if held is not None and len(held):
            for _, rows in held.groupby("batch", sort=False):
                yield answered(rows)

    return ready.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def evaluate(df: DataFrame, prediction: str, reference: str, decode: Callable[[Column], Column], vocabulary: int, pad: int = 0, ignore: int = -100) -> DataFrame:
    """``exact_match, n`` of predicted and true ids: masked places become padding, ids outside the vocabulary are clipped, both sides are decoded.

    A prediction that is a struct counts by its first field.
    """
    predicted = F.col(f"{prediction}.{df.schema[prediction].dataType.names[0]}") if isinstance(df.schema[prediction].dataType, T.StructType) else F.col(prediction)
    text = lambda ids: decode(C.clip_ids(C.unmask_labels(ids, pad, ignore), vocabulary))
    return exact_match(df.select(text(predicted).alias("p"), text(F.col(reference)).alias("r")), "p", "r")


def training_columns(df: DataFrame) -> DataFrame:
    """``input_text, target_text`` beside the originals."""
    return df.withColumns({"input_text": F.col("question"), "target_text": F.col("answer")})


#: What only curation needs.
CURATION_COLUMNS = ("question", "answer", "format_id", "tags", "complexity", "num_tags", "difficulty")


def model_columns(df: DataFrame, encode: Callable[[Column], Column], length: int | None = 512, limit: int = 512, pad: int = 0, ignore: int = -100) -> DataFrame:
    """``input_ids, attention_mask, labels`` of ``input_text, target_text``; the columns of curation go.

    With ``length`` all are padded to it, else to the longest of the table.
    """
    ids = df.withColumns({"_x": F.slice(encode(F.col("input_text")), 1, limit), "_y": F.slice(encode(F.col("target_text")), 1, limit)})
    if length is None:
        length = ids.agg(F.coalesce(F.greatest(F.max(F.size("_x")), F.max(F.size("_y"))), F.lit(0))).first()[0]
    made = ids.withColumns({"input_ids": C.pad_truncate(F.col("_x"), length, pad), "attention_mask": C.attention_mask(F.col("_x"), length), "labels": C.mask_labels(C.pad_truncate(F.col("_y"), length, pad), pad, ignore)})
    return made.drop("_x", "_y", "input_text", "target_text", *CURATION_COLUMNS)


def decode_request(data: Column, body: Column) -> Column:
    """Bytes of ``data``, else of ``body``, as text."""
    return F.coalesce(F.decode(data, "UTF-8"), F.decode(body, "UTF-8"))
