"""Large JSON files by byte ranges, and one valid JSON object written by many tasks.

A file's one object (``{"dataset": [...], ...}``, or a bare list) is read in ranges. Where a range begins, two things must be
known: is the place inside a string, and how deep is it? A first pass tells for each range how many quotes it has and how far it goes
up or down from either state; sums over the ranges - one row each - give every range its state, and the second pass cuts
out the objects that begin in it, reading on until the last of them ends. So a file of any size is read by as many tasks as it has ranges.

Files are opened by tasks through pyarrow's file systems (local, HDFS, S3 and others by their URI).

Defined results: of lists under top-level keys the objects are read, whatever the white space; what isn't an object in such a list is
passed over; strings may hold brackets and escapes; a file that breaks off gives the objects that end in it; no objects at all is an error
only for :func:`read_examples`.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.selection import numbered
from tessera.tables import written

from .datasets import EXAMPLE

RANGE_BYTES = 64 << 20
#: Bytes before a range that are looked at for backslashes and for a list's key, and those read at a time beyond its end.
BEFORE, MORE = 1 << 16, 4 << 20


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where quotes stand that no backslash escapes; the backslashes before the first byte are thought to be none."""
    slash = data == 0x5C
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.where(slash, -1, place))  # the latest byte that is none
    run = np.append(0, (place - last)[:-1])  # backslashes right before each byte
    return np.flatnonzero((data == 0x22) & (run % 2 == 0))


def _depths(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Steps of depth (1, -1, 0) by byte, outside strings, and where strings are, a range beginning ``inside`` one or not."""
    marks = np.zeros(len(data), np.int8)
    marks[_quotes(data)] = 1
    string = (np.cumsum(marks, dtype=np.int64) + inside) % 2 == 1
    step = np.zeros(len(data), np.int8)
    step[((data == 0x7B) | (data == 0x5B)) & ~string] = 1
    step[((data == 0x7D) | (data == 0x5D)) & ~string] = -1
    return step, string


def _read(file, begin: int, end: int) -> tuple[np.ndarray, int]:
    """The bytes from ``begin`` to ``end``, beginning earlier where backslashes run into them; and how many of them are before."""
    start = max(0, begin - BEFORE)
    file.seek(start)
    data = np.frombuffer(file.read(end - start), np.uint8)
    before = begin - start
    while before and data[before - 1] == 0x5C:
        before -= 1
    return data[before:], begin - start - before


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``file, begin, end, length, number``: one row a range, in the order of the files."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    cut = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("begin"))
    rows = cut.withColumn("end", F.least(F.col("begin") + size, "length")).collect()  # a row for each range of bytes
    rows = sorted((r.file, r.begin, r.end, r.length) for r in rows)
    made = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file string, begin long, end long, length long, number long")
    return made.repartitionByRange(max(1, len(rows)), "number")


def _summaries(batches):
    """Each range's parity of quotes, and its step of depth when it begins outside or inside a string."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            with _open(r["file"]) as file:
                data, before = _read(file, r["begin"], r["end"])
            odd = int((_quotes(data) >= before).sum()) % 2
            rows.append((r["number"], odd, *(int(_depths(data, s)[0][before:].sum(dtype=np.int64)) for s in (False, True))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["number", "odd", "outer", "inner"])


def _key_before(data: np.ndarray, at: int) -> str:
    """The member's name before the bracket at ``at``, or nothing."""
    head = data[:at].tobytes().rstrip()
    if not head.endswith(b":"):
        return ""
    head = head[:-1].rstrip()
    quotes = _quotes(np.frombuffer(head, np.uint8))
    return json.loads(head[quotes[-2] :]) if len(quotes) > 1 else ""


def _objects(batches):
    """``number, place, list, text``: the objects of lists that begin in a range. A row without a text names the list in which the range ends; ``list`` is null before the first."""
    for batch in batches:
        for r in batch.to_pylist():
            found: list[tuple] = []
            with _open(r["file"]) as file:
                data, before = _read(file, r["begin"], r["end"])
                step, string = _depths(data, r["inside"])
                depth = r["depth"] + np.cumsum(step, dtype=np.int64)
                base = 1 if r["bare"] else 2
                opens = step == 1
                tops = np.flatnonzero(opens & (depth == base))
                tops = tops[tops >= before]
                starts = np.flatnonzero(opens & (depth == base + 1) & (data == 0x7B))
                starts = starts[starts >= before]
                ends = np.flatnonzero((step == -1) & (depth == base))
                names = []
                for t in tops:
                    lead, at = data, t
                    if not r["bare"] and t < 4096 and r["begin"]:  # the name may stand before the range
                        file.seek(max(0, r["begin"] - BEFORE))
                        lead = np.frombuffer(file.read(r["begin"] - before - max(0, r["begin"] - BEFORE)) + data[: t + 1].tobytes(), np.uint8)
                        at = len(lead) - 1
                    names.append(("" if r["bare"] else _key_before(lead, at)) if data[t] == 0x5B else None)
                own = np.searchsorted(tops, starts, "right") - 1
                stop = np.searchsorted(ends, starts)
                for a, t, e in zip(starts.tolist(), own.tolist(), stop.tolist(), strict=True):
                    text = data[a : ends[e] + 1].tobytes() if e < len(ends) else _rest(file, r["end"], r["length"], data[a:])
                    if text is not None:
                        found.append((a, names[t] if t >= 0 else None, t >= 0, text))
            kept = [f for f in found if not f[2] or f[1] is not None]
            told = [(i, name, known, text.decode()) for i, (_, name, known, text) in enumerate(kept)]
            told.append((len(kept), names[-1] if len(names) else None, bool(len(names)), None))
            yield pa.RecordBatch.from_arrays([pa.array([r["number"]] * len(told), pa.int64()), pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.string()), pa.array([t[2] for t in told], pa.bool_()), pa.array([t[3] for t in told], pa.string())], names=["number", "place", "list", "known", "text"])


def _rest(file, at: int, length: int, head: np.ndarray) -> bytes | None:
    """An object that goes on beyond the range: the bytes to its end, or None if the file ends before."""
    parts = [head.tobytes()]
    while True:
        data = np.frombuffer(b"".join(parts), np.uint8)
        depth = np.cumsum(_depths(data, False)[0], dtype=np.int64)
        end = np.flatnonzero(depth == 0)
        if len(end):
            return data[: end[0] + 1].tobytes()
        if at >= length:
            return None
        file.seek(at)
        parts.append(file.read(min(max(MORE, len(data)), length - at)))
        at += len(parts[-1])


def read_lists(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """``list, ex_id, text``: the objects of every list of the files, by the list's name (empty for a bare list), numbered in their order over all lists and files."""
    ranges = written(_ranges(spark, path, size))
    told = {r.number: r for r in ranges.mapInArrow(_summaries, "number long, odd long, outer long, inner long").collect()}  # a row a range
    states, last, inside, depth, bare = [], None, False, 0, False
    for r in sorted(ranges.collect(), key=lambda r: r.number):
        if r.file != last:
            last, inside, depth = r.file, False, 0
            with _open(r.file) as file:
                bare = file.read(4096).lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"["
        states.append((*r, inside, depth, bare))
        depth += told[r.number].inner if inside else told[r.number].outer
        inside ^= bool(told[r.number].odd)
    if not states:
        return spark.createDataFrame([], "list string, ex_id long, text string")
    ready = spark.createDataFrame(states, "file string, begin long, end long, length long, number long, inside boolean, depth long, bare boolean").repartitionByRange(len(states), "number")
    rows = written(ready.mapInArrow(_objects, "number long, place long, list string, known boolean, text string"))
    ends = rows.filter("text is null").join(ranges.select("number", "file"), "number")
    before = F.last(F.when(F.col("known"), F.struct("list")), ignorenulls=True).over(Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    ends = ends.select("number", before["list"].alias("_list"))
    named = rows.filter("text is not null").join(F.broadcast(ends), "number").withColumn("list", F.when(F.col("known"), F.col("list")).otherwise(F.col("_list"))).filter("list is not null")
    return numbered(named.select("list", "number", "place", "text"), ["number", "place"], "ex_id").select("list", "ex_id", "text")


def read_examples(spark: SparkSession, path: str, lists: tuple[str, ...] = ("dataset", ""), size: int = RANGE_BYTES) -> DataFrame:
    """``ex_id, question, answer, ...``: the examples of the named lists, in ranges of ``size`` bytes; of several lists ``split`` says which. Nothing at all is an error."""
    rows = read_lists(spark, path, size).filter(F.col("list").isin(*lists))
    if rows.isEmpty():
        raise ValueError(f"no examples in {path}")
    made = rows.select("ex_id", F.col("list").alias("split"), F.from_json("text", EXAMPLE).alias("e")).select("ex_id", "split", "e.*")
    return made if len([x for x in lists if x]) > 1 else made.drop("split")


def write_object(df: DataFrame, path: str, order: str = "ex_id", key: str = "dataset") -> None:
    """One file with one valid JSON object: a list of ``df``'s rows in order under ``key``, nulls kept.

    Tasks write their rows as parts in a folder beside; the parts are then copied one after the other, a buffer at a time, and the file gets its name when it
    is whole: it is there entirely or not at all. A file that is there already is an error.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target, folder = place(path), f"{path}._{uuid.uuid4().hex}"
    system = target.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    columns = [c for c in df.columns if c != order]
    ordered = df.repartitionByRange(order).sortWithinPartitions(order)
    ordered.select(F.concat(F.lit(","), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("value")).write.text(f"{folder}/parts")
    parts = sorted(s.getPath().toString() for s in system.listStatus(place(f"{folder}/parts")) if s.getPath().getName().startswith("part-") and s.getLen())
    out = system.create(place(f"{folder}/whole"))
    put = lambda text: out.write(bytearray(text.encode()))
    put(json.dumps({key: []})[:-2] + "\n")
    for i, part in enumerate(parts):
        source = system.open(place(part))
        if i == 0:
            source.read()  # every row begins with a comma, but the first
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        source.close()
    put("]}")
    out.close()
    if not system.rename(place(f"{folder}/whole"), target):
        raise OSError(f"{path} can't be written")
    system.delete(place(folder), True)
