"""Quality rules: compression bands.

The zstandard ratio (raw bytes / compressed bytes) of the whole document and of
each fixed-size chunk must lie inside a band that depends on the length:
above it the text repeats itself more than prose of its length does, below it the text
doesn't compress, as noise and encoded payloads don't. Bands are of two sorts, and a
document must be inside both:

- *Fixed* ones, wide, that hold for any corpus. A document is rejected when its whole
  ratio leaves its band, or when more than ``max_bad_chunks`` of its chunks leave the chunk
  band. Every byte lies in a chunk: bytes after the last full chunk are judged in one
  that ends with the text, and a text shorter than a chunk is one, with a band for its length.
- *Fitted* ones: for each half-octave of length the median ratio of all documents that pass the
  base rules, and around it some robust standard deviations (from the median
  absolute deviation); likewise for the chunks. Only different pairs of length and
  compressed size count, so a group of copies has no more weight than one text. Each
  class takes in its neighbours', with a weight that falls to ``1 / pooled`` a half-octave, so that one with many
  texts goes by its own and one with few by those next to it, at any size of the table.

One scan measures each row and writes the measures; the fit is a histogram of some
thousand rows, and the verdict an expression over the measures.

Defined results: a null or empty text has no words and fails the base rules; texts
of any length are read whole; repeated rows and ids are judged one by one; an
empty table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_texts, materialize, schema_of, texts


@dataclass(frozen=True)
class Bands:
    """(bytes from, lowest ratio, highest ratio), ascending; the last band that starts at or below the length holds.

    The limits leave room around ordinary prose: its ratio rises with the length
    from under 1 to about 2.6, while repeated text exceeds 3 from some 200 bytes
    on and random characters of a 64-letter alphabet stay near 1.33.
    """

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 4.0), (128, 0.0, 2.6), (256, 1.1, 3.0), (512, 1.25, 3.2), (1024, 1.35, 3.5), (4096, 1.4, 4.0), (16384, 1.45, 5.0))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.35, 4.0)
    #: As ``whole``, for a text shorter than a chunk: between prose and prose with a half of base64.
    short: tuple[tuple[int, float, float], ...] = ((0, 0.0, 4.0), (192, 1.13, 4.0), (256, 1.2, 4.0), (384, 1.27, 4.0), (512, 1.33, 4.0), (768, 1.43, 4.0), (1024, 1.5, 4.0), (1536, 1.6, 4.0))
    max_bad_chunks: float = 0.25
    #: Fitted bands: robust standard deviations above and below the median, and at least so much of it.
    above: tuple[float, float] = (3.5, 0.05)
    below: tuple[float, float] = (6.0, 0.1)
    chunk_above: tuple[float, float] = (6.0, 0.3)
    chunk_below: tuple[float, float] = (6.0, 0.12)
    #: Chunks outside the fitted band that a document may have.
    max_odd_chunks: float = 0.1
    #: A neighbouring class of length counts one in so many, up to ``reach`` classes away.
    pooled: int = 16
    reach: int = 4
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


BANDS = Bands()
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
#: name, type of what :func:`measure` returns; ``kept`` is the verdict of the base rules and the fixed bands.
FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("ratio", T.DoubleType()), ("n_chunks", T.LongType()), ("n_bad_chunks", T.LongType()), ("kept", T.BooleanType()), ("n_bytes", T.LongType()), ("packed", T.LongType()), ("length_class", T.IntegerType()), ("chunks", T.ArrayType(T.IntegerType()))]
_STRUCT = T.StructType([T.StructField(k, t) for k, t in FIELDS])
_ARROW = {T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ArrayType: pa.list_(pa.int32())}
#: Length classes: half-octaves up to 2**32 bytes.
CLASSES = 65


def length_class(n: int) -> int:
    """``floor(2 * log2(n))``, exactly."""
    b = max(n, 1).bit_length() - 1
    return 2 * b + (n * n >= 1 << (2 * b + 1))


def repeated_words(words: list) -> int:
    """Words inside any 3-word window that is found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    add = seen.add
    twice = {w for w in windows if w in seen or add(w)}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measure(text: str, compressor, bands: Bands = BANDS) -> tuple:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    n, repeat = len(words), repeated_words(words)
    failed = n < bands.min_words or 100 * repeat > bands.max_repeat_percent * n
    ratio, chunks, bad, packed, sizes = 1.0, 0, 0, 0, []
    if raw:
        size = bands.chunk_bytes
        packed = len(compressor.compress(raw))
        ratio = len(raw) / packed
        starts = [*range(0, len(raw) - size + 1, size), *([len(raw) - size] if len(raw) > size and len(raw) % size else [])]
        sizes = [len(compressor.compress(raw[i : i + size])) for i in starts]
        bad = sum(not bands.chunk[0] <= size / p <= bands.chunk[1] for p in sizes)
        if not starts:
            _, low, high = next(b for b in reversed(bands.short) if len(raw) >= b[0])
            bad = int(not low <= ratio <= high)
        chunks = len(starts) or 1
    _, low, high = next(b for b in reversed(bands.whole) if len(raw) >= b[0])
    kept = not failed and low <= ratio <= high and bad <= bands.max_bad_chunks * chunks
    counts = n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat
    return *counts, failed, ratio, chunks, bad, kept, len(raw), packed, length_class(len(raw)), sizes


def _measured(bands: Bands, keep_columns: bool, name: str):
    def run(batches):
        compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=True)
        for batch in batches:
            got = [measure(x, compressor, bands) for x in texts(batch.column("text"))]
            made = pa.StructArray.from_arrays([pa.array([g[i] for g in got], _ARROW[type(t)]) for i, (_, t) in enumerate(FIELDS)], [k for k, _ in FIELDS])
            own, names = (batch.columns, batch.schema.names) if keep_columns else ([batch.column("doc_id")], ["doc_id"])
            yield pa.RecordBatch.from_arrays([*own, made], names=[*names, name])

    return run


def fit(measured: DataFrame, name: str, bands: Bands = BANDS) -> tuple[dict[int, tuple[float, float]], tuple[float, float]]:
    """Fitted limits of the ratio by length class, and of a chunk's, from the written measures of all documents that pass the base rules."""
    own = measured.select(f"{name}.*").filter(~F.col("base_failed"))
    pairs = materialize(own.groupBy("n_bytes", "packed").agg(F.min("length_class").alias("k"), F.min("chunks").alias("chunks")))
    whole = pairs.select("k", F.round(F.col("n_bytes") / F.col("packed"), 3).alias("r"))
    inside = pairs.select(F.lit(-1).alias("k"), F.explode("chunks").alias("p")).select("k", F.round(F.lit(float(bands.chunk_bytes)) / F.col("p"), 3).alias("r"))
    hist = materialize(whole.unionByName(inside).groupBy("k", "r").agg(F.count("*").alias("n")))
    step = F.explode(F.sequence(F.lit(-bands.reach), F.lit(bands.reach))).alias("d")
    near = hist.filter("k >= 0").select("*", step).select((F.col("k") + F.col("d")).alias("k"), "r", (F.col("n") * F.pow(F.lit(bands.pooled), bands.reach - F.abs("d"))).cast("long").alias("n"))
    hist = materialize(near.filter("k >= 0").unionByName(hist.filter("k < 0")).groupBy("k", "r").agg(F.sum("n").alias("n")))
    middle = hist.groupBy("k").agg(F.percentile("r", 0.5, F.col("n")).alias("mid"))
    spread = hist.join(F.broadcast(middle), "k").groupBy("k").agg(F.first("mid").alias("mid"), F.percentile(F.abs(F.col("r") - F.col("mid")), 0.5, F.col("n")).alias("mad"))
    out = {}
    for r in spread.collect():  # one row a length class
        sigma = 1.4826 * r.mad
        above, below = (bands.chunk_above, bands.chunk_below) if r.k < 0 else (bands.above, bands.below)
        out[r.k] = r.mid - max(below[0] * sigma, below[1] * r.mid), r.mid + max(above[0] * sigma, above[1] * r.mid)
    return out, out.pop(-1, (0.0, float("inf")))


def verdict(name: str, limits: dict[int, tuple[float, float]], chunk: tuple[float, float], bands: Bands = BANDS) -> Column:
    """Inside the fixed and the fitted bands."""
    of = lambda field: F.col(f"{name}.{field}")
    low, high = (F.get(F.array(*(F.lit(float(limits.get(k, (0.0, 1e18))[side])) for k in range(CLASSES))), of("length_class")) for side in (0, 1))
    size = float(bands.chunk_bytes)
    odd = F.size(F.filter(of("chunks"), lambda p: ~(F.lit(size) / p).between(F.lit(chunk[0]), F.lit(min(chunk[1], 1e18)))))
    return of("kept") & of("ratio").between(F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1e18))) & (odd <= bands.max_odd_chunks * F.size(of("chunks")))


def _light(docs: DataFrame, bands: Bands) -> DataFrame:
    """``doc_id`` and the measures ``m`` of every row, written."""
    docs = docs.select("doc_id", "text")
    return materialize(map_texts(docs, _measured(bands, False, "m"), T.StructType([docs.schema["doc_id"], T.StructField("m", _STRUCT)])))


def compression_report(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """``doc_id`` with the base counts, the ratio, the chunk counts and the verdict of every row."""
    made = _light(docs, bands)
    plain = [k for k, t in FIELDS if k not in ("kept", "packed", "length_class", "chunks")]
    return made.select("doc_id", *(f"m.{k}" for k in plain), verdict("m", *fit(made, "m", bands), bands).alias("kept"))


def keep_good(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged. Rows are measured twice rather than written with their texts."""
    name = "_measured"
    while name in map(str.lower, docs.columns):
        name += "_"
    limits = fit(_light(docs, bands), "m", bands)
    made = map_texts(docs, _measured(bands, True, name), schema_of(docs, T.StructField(name, _STRUCT)))
    return made.filter(verdict(name, *limits, bands)).drop(name)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_report(documents(spark, sf_dir))
