"""Requests and responses as columns: what servers take and give, for batches and streams alike. A bad row has an ``error`` and never ends the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import minify

from .blueprint import Limits, blueprint, reassemble
from .scoring import infer
from .xmljson import size_of, to_json

#: What a generation request has where it says nothing.
DEFAULTS = {"max_tokens": 128, "temperature": 0.7, "top_p": 0.95}


def text_requests(df: DataFrame, column: str = "input_text") -> DataFrame:
    """``status, error`` beside the rows: 400 where the text is missing or empty."""
    missing = F.coalesce(F.col(column), F.lit("")) == ""
    return df.withColumn("error", F.when(missing, f"missing {column}")).withColumn("status", F.when(missing, 400).otherwise(200))


def _decoded(data: Column) -> Column:
    """Bytes as text, null where they aren't UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def micro_batch(df: DataFrame, data: str = "data", body: str = "body") -> DataFrame:
    """``text`` beside the rows: bytes of ``data``, else of ``body``; rows without either, or with bytes that aren't text, have an ``error``."""
    kinds = dict(df.dtypes)
    each = lambda c: _decoded(F.col(c)) if kinds[c] == "binary" else F.col(c)
    empty = lambda c: F.col(c).isNull() | (F.octet_length(F.col(c)) == 0)
    text = F.when(~empty(data), each(data)).otherwise(F.when(~empty(body), each(body)))
    return df.withColumn("text", text).withColumn("error", F.when(F.col("text").isNull(), F.when(empty(data) & empty(body), "no input").otherwise("not text")))


def stringified(df: DataFrame, data: str = "data", body: str = "body") -> DataFrame:
    """``text`` of every row: ``data``, else ``body``, else ``None`` spelled out; nothing is passed over."""
    each = lambda c: F.when(F.length(F.col(c).cast("string")) > 0, F.col(c).cast("string"))
    return df.withColumn("text", F.coalesce(each(data), each(body), F.lit("None")))


def generation_requests(df: DataFrame) -> DataFrame:
    """``prompt, max_tokens, temperature, top_p, stop`` with the defaults where a column or a value is missing."""
    column = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    kinds = {"max_tokens": "int", "temperature": "double", "top_p": "double"}
    made = df.withColumns({c: F.coalesce(column(c, k), F.lit(DEFAULTS[c]).cast(k)) for c, k in kinds.items()})
    return made.withColumn("stop", F.coalesce(column("stop", "array<string>"), F.array().cast("array<string>")))


def cut_at_stop(text: Column, stop: Column) -> Column:
    """A generated text up to the first of the stop strings."""
    places = F.filter(F.transform(stop, lambda s: F.instr(text, s)), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.left(text, F.array_min(places) - 1)).otherwise(text)


def response(output: Column, error: Column) -> Column:
    """``{"output": ..}`` or ``{"error": ..}`` as JSON."""
    return F.when(error.isNotNull(), F.to_json(F.struct(error.alias("error")))).otherwise(F.to_json(F.struct(output.alias("output")), {"ignoreNullFields": "false"}))


def prediction(text: Column) -> Column:
    """``{"prediction": text}``."""
    return F.struct(text.alias("prediction"))


def predictions(df: DataFrame, batch: str, order: str, text: str, bare: bool = False) -> DataFrame:
    """A batch's answers as one JSON list, in order: of ``{"prediction": ..}``, or with ``bare`` of texts."""
    item = F.col(text) if bare else prediction(F.col(text))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))), lambda s: s["v"])
    return df.groupBy(batch).agg(F.to_json(listed).alias("response"))


def converted(df: DataFrame, column: str = "input_text", **options) -> DataFrame:
    """Requests with ``output, status, error`` and ``response``: the text minified and converted; 400 without text, 500 where it isn't well-formed."""
    asked = text_requests(df, column)
    out = to_json(asked.withColumn("_minified", minify(F.col(column))), "_minified", "output", **options).drop("_minified")
    failed = F.col("error").isNull() & F.col("output").isNull()
    out = out.withColumn("status", F.when(failed, 500).otherwise(F.col("status"))).withColumn("error", F.when(failed, "not well-formed").otherwise(F.col("error")))
    return out.withColumn("response", response(F.col("output"), F.col("error")))


def served(df: DataFrame, key: str, column: str, make: Callable[[], Callable[[list[str]], list[str]]], limits: Limits = Limits(), size=size_of, batch: int = 12) -> DataFrame:
    """``key, json, n_missing``: each document in pieces, the pieces through an injected batch model in groups of ``batch``, and put together."""
    records = blueprint(df, key, column, limits, size)
    asked = records.filter("chunk IS NOT NULL").select(key, "seq", "chunk")
    return reassemble(records, infer(asked, "chunk", make, batch, "json"), key)


def simulator(seed: int = 7, malformed: float = 0.1) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A stand-in for a model: converts each piece, and spoils a share of the answers, which ones depending on the piece alone."""

    def make():
        import hashlib

        from .xmljson import convert

        def answer(piece: str) -> str:
            spoiled = int(hashlib.md5(f"{seed}-{piece}".encode()).hexdigest()[:7], 16) < malformed * (1 << 28)
            made = convert(piece)
            return '{"error":"not well-formed"}' if made is None else made[:-1] + ",}" if spoiled else made

        return lambda pieces: [answer(p) for p in pieces]

    return make


def single(df: DataFrame, column: str, make: Callable[[], Callable[[str], str]], name: str = "output") -> DataFrame:
    """An injected model that answers one text at a time; ``make`` is called once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            yield f.assign(**{name: [model(x) for x in f[column]]})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
