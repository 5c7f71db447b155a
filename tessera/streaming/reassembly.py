"""Stateful reassembly of a stream: pieces of documents in any order, a document given out when it is whole or when its time is over.

Each document is a key with its own state: the pieces so far by place, the number that it will have, and its deadline in
event time. A piece that comes again is dropped; a document with all pieces is given out at once; one whose deadline passes the
watermark is given out with ``default`` in place of what is missing. Given-out documents are remembered until ``remember`` after their
deadline, so that what comes late or again doesn't open them anew. State lives in the state store with the query's checkpoint:
a restart goes on where the last batch ended, and a lost executor costs a reload.

Defined results: a piece without a document, place or time, or whose place is outside its document, is dropped; a null text
counts as ``default``; of different texts for one place the first stays; the number of pieces is the largest that any piece tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the session must be set to before a query starts: state as a key-value store, which is needed for maps and timers.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SCHEMA = "key string, pieces array<string>, missing int, complete boolean"


class Reassembly(StatefulProcessor):
    """State of one document; times are milliseconds of event time."""

    def __init__(self, timeout: int, remember: int, default: str):
        self.timeout, self.remember, self.default = timeout, remember, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "seq int", "text string")
        self.known = handle.getValueState("known", "total int, held int, deadline long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.known.get()
        total, held, deadline, done = state if state else (0, 0, 0, False)
        for frame in rows:
            if done:
                continue
            for seq, many, text, time in zip(frame["seq"], frame["total"], frame["text"], frame["time"], strict=True):
                total = max(total, int(many))
                if not deadline:
                    deadline = int(time) + self.timeout
                    self.handle.registerTimer(deadline)
                if not self.pieces.containsKey((int(seq),)):
                    self.pieces.updateValue((int(seq),), (self.default if text is None else text,))
                    held += 1
        if not done and total and held >= total:
            yield self._given(key, total)
            done = True
            self.pieces.clear()
        if deadline:
            self.known.update((total, held, deadline, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.known.get()
        if not state:
            return
        total, held, deadline, done = state
        if not done:
            yield self._given(key, total)
            self.pieces.clear()
            self.known.update((total, held, deadline, True))
        if expiredTimerInfo.getExpiryTimeInMs() >= deadline + self.remember:
            self.known.clear()
        else:
            self.handle.registerTimer(deadline + self.remember)

    def _given(self, key, total: int) -> pd.DataFrame:
        found = {k[0]: v[0] for k, v in self.pieces.iterator()}
        pieces = [found.get(i, self.default) for i in range(total)]
        missing = sum(i not in found for i in range(total))
        return pd.DataFrame({"key": [key[0]], "pieces": [pieces], "missing": [missing], "complete": [missing == 0]})

    def close(self) -> None:
        pass


def reassembled(stream: DataFrame, key: str, seq: str, total: str, text: str, time: str, timeout: str = "10 minutes", remember: str = "1 hour", default: str = "{}") -> DataFrame:
    """``key, pieces, missing, complete``: each document of a stream of pieces once; ``time`` is the pieces' event time, which must have a watermark.

    ``seq`` runs from 0; ``total`` is the number of the document's pieces. Timeouts are measured from the time of a document's first piece.
    """
    spark = stream.sparkSession
    for name, value in CONF.items():
        if spark.conf.get(name, None) != value:
            raise ValueError(f"{name} must be {value}")
    ms = lambda span: int(pd.Timedelta(span).total_seconds() * 1000)
    own = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("int").alias("seq"), F.col(total).cast("int").alias("total"), F.col(text).alias("text"), F.col(time).alias("_event"), F.unix_millis(F.col(time)).alias("time"))
    own = own.filter("key is not null and seq >= 0 and seq < total and time is not null")
    return own.groupBy("key").transformWithStateInPandas(Reassembly(ms(timeout), ms(remember), default), SCHEMA, outputMode="Append", timeMode="EventTime")


def merged(whole: DataFrame, combine=None) -> DataFrame:
    """``key, output, missing, complete``: the pieces of :func:`reassembled` documents put together, by default as a JSON list."""
    put = combine or (lambda pieces: F.concat(F.lit("["), F.array_join(pieces, ","), F.lit("]")))
    return whole.select("key", put(F.col("pieces")).alias("output"), "missing", "complete")


def answer_stream(spark: SparkSession, pieces: DataFrame, path: str, checkpoint: str):
    """What is whole or over, appended as Parquet; ends when all that has arrived is worked through."""
    return pieces.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
