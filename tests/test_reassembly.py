from datetime import datetime, timedelta

import pytest

from tessera.streaming import reassembly as R

START = datetime(2026, 1, 1)
SCHEMA = "doc string, seq int, total int, text string, ts timestamp"


@pytest.fixture(scope="module")
def stateful(spark):
    for name, value in R.CONF.items():
        spark.conf.set(name, value)
    yield spark
    for name in R.CONF:
        spark.conf.unset(name)


def piece(doc, seq, total, minute, text="same"):
    return (doc, seq, total, f'"{doc}{seq}"' if text == "same" else text, START + timedelta(minutes=minute))


def test_any_order_lost_late_repeated_and_restart(stateful, tmp_path):
    spark, source, out, checkpoint = stateful, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def arrive(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", "1 minute")
        query = R.answer_stream(spark, R.merged(R.reassembled(stream, "doc", "seq", "total", "text", "ts", "10 minutes", "30 minutes")), out, checkpoint)
        assert query.awaitTermination(240)
        return {r.key: (r.output, r.missing, r.complete) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    # whole in any order; a repeated piece; a piece without a place; a null text
    got, n = arrive(piece("a", 2, 3, 0), piece("a", 0, 3, 0), piece("b", 0, 2, 1), piece("b", 0, 2, 1), piece("a", 1, 3, 1), piece("z", 9, 2, 1), piece("c", 0, 1, 1, None), (None, 0, 1, "x", START))
    assert got == {"a": ('["a0","a1","a2"]', 0, True), "c": ("[{}]", 0, True)} and n == 2
    # after a restart: what is known of b stays; what comes again doesn't open a anew
    got, n = arrive(piece("a", 1, 3, 2), piece("d", 1, 3, 3), piece("b", 0, 2, 4, '"other"'))
    assert n == 2
    got, n = arrive(piece("b", 1, 2, 5))
    assert got["b"] == ('["b0","b1"]', 0, True) and n == 3
    # the watermark passes the deadline of d, which has lost two pieces
    got, n = arrive(piece("e", 0, 2, 20))
    got, n = arrive(piece("e", 1, 2, 21))
    assert got["d"] == ('[{},"d1",{}]', 2, False) and got["e"] == ('["e0","e1"]', 0, True) and n == 5
    # a piece that is too late changes nothing
    got, n = arrive(piece("d", 0, 3, 21))
    assert n == 5


def test_needs_the_state_store(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' as doc", "0 as seq", "1 as total", "'x' as text", "timestamp as ts").withWatermark("ts", "1 minute")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="providerClass"):
        R.reassembled(stream, "doc", "seq", "total", "text", "ts")
    if old in R.CONF.values():
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
