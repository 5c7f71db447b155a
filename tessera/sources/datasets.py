"""Dataset files: one JSON object with a list of examples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "struct<question:string,answer:string,format_id:string,tags:array<string>,context:string,input:string,output:string>"


def _exploded(spark: SparkSession, path: str, key: str) -> DataFrame:
    raw = spark.read.schema(f"{key} array<{EXAMPLE}>").json(path, multiLine=True)
    return raw.select(F.posexplode(key).alias("ex_id", "e")).select(F.col("ex_id").cast("long"), "e.*")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """``ex_id`` is the place in the list; of a folder of files the lists follow each other in the order of the files. Nothing at all is an error.

    Only the lengths of the lists, one number a file, are gathered to number the rows.
    """
    raw = spark.read.schema(f"dataset array<{EXAMPLE}>").json(path, multiLine=True).select("dataset", F.col("_metadata.file_path").alias("file"))
    lengths = sorted((r.file, r.n) for r in raw.select("file", F.coalesce(F.size("dataset"), F.lit(0)).alias("n")).collect())
    if not sum(max(n, 0) for _, n in lengths):
        raise ValueError(f"no examples in {path}")
    starts, at = [], 0
    for file, n in lengths:
        starts.append((file, at))
        at += max(n, 0)
    out = raw.select("file", F.posexplode("dataset").alias("place", "e"))
    if len(starts) == 1:
        return out.select(F.col("place").cast("long").alias("ex_id"), "e.*")
    return out.join(F.broadcast(spark.createDataFrame(starts, "file string, start long")), "file").select((F.col("place") + F.col("start")).alias("ex_id"), "e.*")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A file with the keys train and test, either of which may be missing."""
    parts = [_exploded(spark, path, k).withColumn("split", F.lit(k)) for k in ("train", "test")]
    return parts[0].unionByName(parts[1])


def read_output_map(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id, json`` of an object that maps ids to JSON texts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("chunk_id", "json"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@")
    return (reader.schema(schema) if schema else reader).load(path)


def read_pair(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Two dataset files, their rows marked by ``split``."""
    parts = [read_dataset(spark, path).withColumn("split", F.lit(k)) for k, path in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


def from_rows(spark: SparkSession, rows: list[dict], schema: str = "question string, answer string, format_id string, tags array<string>") -> DataFrame:
    """Rows at hand as examples; ``ex_id`` is their place."""
    made = [(i, *(r.get(c) for c in (x.split()[0] for x in schema.split(", ")))) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, f"ex_id long, {schema}")


def write_dataset(df: DataFrame, path: str, as_lines: bool = False, order: str = "ex_id", key: str = "dataset") -> None:
    """A folder that :func:`read_dataset` reads: files of one JSON object with a list of examples each, nulls kept.

    Every partition writes an object of its own, its rows in order, so that no task sees them all; a table that fits one partition
    makes one object. With ``as_lines`` one example a line.
    """
    columns = [c for c in df.columns if c != order]
    if as_lines:
        df.select(*columns).write.option("ignoreNullFields", "false").json(path)
        return
    ordered = df.repartitionByRange(order).sortWithinPartitions(order) if order in df.columns else df
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

    def run(batches):
        first = True
        for b in batches:
            texts = b.column(0).to_pylist()
            if texts:
                head = "" if not first else f'{{"{key}": [\n'
                yield pa.RecordBatch.from_arrays([pa.array([(head if i == 0 else "") + ("" if first and i == 0 else ", ") + t for i, t in enumerate(texts)])], names=["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    ordered.select(line.alias("value")).mapInArrow(run, "value string").write.text(path)


def write_test(df: DataFrame, path: str, **options) -> None:
    """The test rows of a curated table alone."""
    write_dataset(df.filter("split = 'test'").drop("split"), path, **options)


def write_mismatches(df: DataFrame, prediction: str, reference: str, path: str) -> None:
    """``[prediction, truth]`` of each row where they differ, one a line."""
    df.filter(~F.col(prediction).eqNullSafe(F.col(reference))).select(F.to_json(F.array(prediction, reference)).alias("value")).write.text(path)


def dataset_path(folder: str, experiment: str, rows: int, names: str = "structured", style: str = "compact", **more: str) -> str:
    """A path that says what is in it."""
    told = "".join(f"_{k}-{v}" for k, v in sorted(more.items()))
    return f"{folder}/tagged_dataset_exp_{experiment}_{rows}_{'grammar' if names == 'structured' else 'uuid'}_{style}{told}.json"


def latest_checkpoint(df: DataFrame, name: str = "name") -> DataFrame:
    """The name with the largest number after ``checkpoint-``."""
    n = F.regexp_extract(name, r"^checkpoint-(\d+)$", 1)
    return df.filter(n != "").agg(F.max_by(name, n.cast("long")).alias("latest"))
