"""Curation: difficulty bins, format holdouts, hint leakage, stratified splits, curriculum phases.

Plan-time decisions use aggregates of a few rows. Ranks are never taken over a single
partition: :func:`ranked` counts a bounded number of buckets first, then ranks inside each;
:func:`nth_smallest` finds a threshold by counts alone.

:func:`curate` goes from examples to train and test rows in one call.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.columns import content_length, draw
from tessera.tables import written

from .generate import constituents
from .selection import first_rows


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank in each group by (bucket, order) in two levels: bucket counts, then rows of one bucket."""
    marked = df.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = marked.join(counts, keys)
    return joined.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + F.col("_before")).drop("_bucket", "_before")


def bin_edges(df: DataFrame, length: str, bins: int = 3) -> list[float]:
    """Distinct interpolated quantiles of the length; fewer than two edges become [min, max + 1]."""
    shares = [i / bins for i in range(bins + 1)]
    row = df.agg(F.percentile(length, F.array(*map(F.lit, shares))).alias("e")).first()
    if row.e is None:
        raise ValueError("no examples")
    edges = sorted(set(row.e))
    return edges if len(edges) > 1 else [edges[0], edges[0] + 1]


def with_bins(df: DataFrame, length: str, edges: list[float], bins: int = 3) -> DataFrame:
    """``complexity``: how many edges the length reaches, less one, clamped; collapsed edges keep the number of bins."""
    reached = sum(((F.col(length) >= e).cast("int") for e in edges[1:]), F.lit(0))
    return df.withColumn("complexity", F.least(F.lit(bins - 1), reached))


def with_fixed_bins(df: DataFrame, length: str, only_if_missing: bool = False) -> DataFrame:
    """0 under the lower quartile, 1 up to the upper, else 2. With ``only_if_missing`` rows keep their complexity if every one has it."""
    if only_if_missing and "complexity" in df.columns and df.filter(F.col("complexity").isNull()).isEmpty():
        return df
    low, high = df.agg(F.percentile(length, F.array(F.lit(0.25), F.lit(0.75)))).first()[0] or (0, 0)
    return df.withColumn("complexity", F.when(F.col(length) < low, 0).when(F.col(length) <= high, 1).otherwise(2))


def format_stats(df: DataFrame) -> DataFrame:
    """Count, share, tags and complexities of each format."""
    total = df.count()
    tags = df.select("format_id", F.explode("tags").alias("t")).groupBy("format_id").agg(F.array_sort(F.collect_set("t")).alias("tags"))
    stats = df.groupBy("format_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("complexity")).alias("complexities"))
    return stats.join(tags, "format_id", "left").select("format_id", "n", F.round(F.col("n") / total, 6).alias("proportion"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "complexities")


def with_difficulty(df: DataFrame, bins: int = 3, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """alpha * complexity over its range + beta * number of tags over the largest."""
    most = max(df.agg(F.max(F.size(F.coalesce("tags", F.array().cast("array<string>"))))).first()[0] or 0, 1)
    n = F.size(F.coalesce("tags", F.array().cast("array<string>")))
    return df.withColumn("num_tags", n).withColumn("difficulty", alpha * F.col("complexity") / max(bins - 1, 1) + beta * n / most)


def all_tags(df: DataFrame) -> DataFrame:
    """``tags``: the different tags of all examples, in order."""
    return df.select(F.explode("tags").alias("t")).agg(F.array_sort(F.collect_set("t")).alias("tags"))


#: Bits of a mask in one number.
_WORD = 62


def _unions(sets: list[list], all_: list, has: list[Column]) -> list[Column]:
    """For each word of the set's bits: those of the formats that ``has`` takes."""
    at = {x: i for i, x in enumerate(all_)}
    words = []
    for w in range(0, max(len(all_), 1), _WORD):
        bits = [sum(1 << (at[x] - w) for x in s if w <= at[x] < w + _WORD) for s in sets]
        words.append(_or([F.when(h, F.lit(b)).otherwise(F.lit(0)).cast("long") for h, b in zip(has, bits, strict=True)]))
    return words


def holdout_search(stats: DataFrame, test_size: float = 0.2, size_only: bool = False) -> DataFrame:
    """Every proper subset of the formats with its score, as a bit mask over formats in order of their names.

    Score: tags that only the subset has + distance of its share from ``test_size`` +
    0.01 for each complexity level it lacks. Subsets are a distributed range of integers; per-format facts are constants.
    """
    rows = sorted(stats.collect(), key=lambda r: r.format_id)  # one row a format
    n = len(rows)
    if n < 2:
        raise ValueError("no proper subset of one format")
    if n > 40:
        raise ValueError("2**40 subsets and more aren't searched")
    tags = sorted({t for r in rows for t in r.tags})
    levels = sorted({c for r in rows for c in r.complexities})
    total = sum(r.n for r in rows)
    has = [F.shiftright(F.col("mask"), i).bitwiseAND(1) == 1 for i in range(n)]
    count = sum((F.when(h, r.n).otherwise(0) for h, r in zip(has, rows, strict=True)), F.lit(0))
    score = F.abs(count / total - test_size)
    if not size_only:
        inside, outside = (_unions([r.tags for r in rows], tags, x) for x in (has, [~h for h in has]))
        leak = sum((F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in zip(inside, outside, strict=True)), F.lit(0))
        there = sum((F.bit_count(w) for w in _unions([r.complexities for r in rows], levels, has)), F.lit(0))
        score = leak + score + (len(levels) - there) * 0.01
    masks = stats.sparkSession.range(1, (1 << n) - 1).withColumnRenamed("id", "mask")
    names = F.filter(F.array(*(F.when(h, r.format_id) for h, r in zip(has, rows, strict=True))), lambda x: x.isNotNull())
    return masks.select("mask", F.round(score, 9).alias("score"), names.alias("formats"))


def _or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def best_holdout(scored: DataFrame) -> DataFrame:
    """The least score; ties go to fewer formats, then to the first names: the lowest bits of the mask."""
    return scored.orderBy("score", F.bit_count("mask"), F.reverse(F.lpad(F.bin("mask"), 64, "0")).desc()).limit(1)


def by_format(df: DataFrame, holdout: list[str]) -> DataFrame:
    """``split``: test for rows of the held-out formats, else train."""
    return df.withColumn("split", F.when(F.col("format_id").isin(*holdout), "test").otherwise("train"))


def without(df: DataFrame, leaving: DataFrame, key: str = "ex_id") -> DataFrame:
    """The rows whose key isn't among those that leave; equal rows under other keys stay."""
    return df.join(leaving.select(key).distinct(), key, "left_anti")


def head(df: DataFrame, order: str = "ex_id", n: int = 40) -> DataFrame:
    """The first rows, for a quick evaluation."""
    return df.orderBy(order).limit(n)


def batch_number(groups: list[str], order: str, size: int = 12) -> Column:
    """Consecutive groups of ``size`` rows in each of ``groups``."""
    return F.floor((F.row_number().over(Window.partitionBy(*groups).orderBy(order)) - 1) / size)


def nth_smallest(df: DataFrame, column: str, n: int) -> int:
    """The ``n``-th smallest of a column of integers, from 1: four counts of 2**16 buckets each, no sort."""
    value = F.col(column).cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    known, left = 0, n
    for shift in (48, 32, 16, 0):
        bucket = F.shiftrightunsigned(value, shift).bitwiseAND(0xFFFF)
        within = df if shift == 48 else df.filter(F.shiftrightunsigned(value, shift + 16) == known)
        for r in within.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect():  # at most 2**16 rows
            if left <= r.n:
                known = known << 16 | r.b
                break
            left -= r.n
        else:
            raise ValueError("there are fewer rows")
    return known - (1 << 63)


def hint_leak(test: DataFrame, share: float, only_level: int | None = None) -> DataFrame:
    """``leaked``: the first ``round(share * N)`` rows by complexity, then id; with ``only_level`` those of that complexity alone."""
    if not 0 <= share < 1:
        raise ValueError("the share of hints must be in [0, 1)")
    counts = {r.complexity: r.n for r in test.groupBy("complexity").agg(F.count("*").alias("n")).collect()}  # one row a level
    quota, wanted = round(share * sum(counts.values())), []
    for level in sorted(counts) if only_level is None else [only_level]:
        wanted.append((level, min(quota, counts.get(level, 0))))
        quota -= wanted[-1][1]
    wanted = test.sparkSession.createDataFrame(wanted, "_g int, _want long")  # one row a level
    return first_rows(test, F.col("complexity"), wanted, order_key(test, "ex_id"), [F.col("ex_id")], "leaked")


def order_key(df: DataFrame, column: str) -> Column:
    """A whole number in the order of the column: a whole number itself, else the first seven bytes of the text."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(F.conv(F.hex(F.substring(F.rpad(F.encode(F.col(column).cast("string"), "UTF-8"), 7, F.unhex(F.lit("00"))), 1, 7)), 16, 10).cast("long"), F.lit(-1))


def stratum(df: DataFrame, tagged: bool = True) -> DataFrame:
    """``stratum``: complexity and sorted tags; without tags the complexity alone."""
    level = F.col("complexity").cast("string")
    return df.withColumn("stratum", F.concat_ws("_", level, F.array_join(F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))), "-")) if tagged else level)


def quotas(df: DataFrame, tests: int) -> DataFrame:
    """``stratum, n, quota``: each stratum's part of ``tests`` rows by largest remainder, ties going to the first names."""
    sizes = df.groupBy("stratum").agg(F.count("*").alias("n"))
    total = df.count()
    exact = F.lit(tests) * F.col("n")
    parts = written(sizes.withColumn("whole", F.floor(exact / total)).withColumn("rest", exact % total))
    extra = tests - (parts.agg(F.sum("whole")).first()[0] or 0)
    one = df.sparkSession.createDataFrame([(0, extra)], "_g int, _want long")
    more = first_rows(parts, F.lit(0), one, -F.col("rest"), [F.col("stratum")], "more")
    return more.select("stratum", "n", (F.col("whole") + F.col("more").cast("int")).alias("quota"))


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, tests: int | None = None, on_small_stratum: str = "fallback") -> DataFrame:
    """``split``: each stratum gives its part of ``tests`` (else ceil(test_size * N)) rows, by largest remainder, in the order of a hash.

    A stratum of one row, or fewer test or train rows than strata, falls back to an unstratified split, or is an error with ``"error"``.
    """
    sizes = df.groupBy("stratum").agg(F.count("*").alias("n")).agg(F.count("*").alias("strata"), F.min("n").alias("least"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    tests = -int(-test_size * sizes.total // 1) if tests is None else tests
    fallback = not sizes.strata or sizes.least < 2 or min(tests, sizes.total - tests) < sizes.strata
    if fallback and on_small_stratum == "error":
        raise ValueError("a stratum is too small to be split")
    drawn = df.withColumn("_draw", draw(seed, F.col("ex_id")))
    key = F.conv(F.substring("_draw", 1, 15), 16, 10).cast("long")
    if fallback:
        group, wanted = F.lit(0), df.sparkSession.createDataFrame([(0, tests)], "_g int, _want long")
    else:
        group, wanted = F.col("stratum"), quotas(df, tests).select(F.col("stratum").alias("_g"), F.col("quota").alias("_want"))
    chosen = first_rows(drawn, group, wanted, key, [F.col("_draw"), F.col("ex_id")], "_test")
    return chosen.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_draw", "_test")


def divided(df: DataFrame, share: float, seed: int, tests: int | None, on_small_stratum: str) -> DataFrame:
    """``split`` of all rows: nothing or all of them where the share says so, else stratified."""
    if share <= 0 or share >= 1:
        return df.withColumn("split", F.lit("train" if share <= 0 else "test"))
    tagged = "tags" in df.columns and (row := df.select("tags").first()) is not None and row.tags is not None and len(row.tags) > 0
    return stratified_split(stratum(df, tagged), share, seed, tests, on_small_stratum).drop("stratum")


def complexity_of(df: DataFrame, bins: int = 3) -> DataFrame:
    """``complexity`` by quantiles of the longer side's length; an empty table is an error."""
    length = content_length(F.col("question"), F.col("answer") if "answer" in df.columns else None)
    held = df.withColumn("_length", length)
    edges = bin_edges(held, "_length", bins)
    return with_bins(held, "_length", edges, 1 if len(edges) == 2 and edges[1] == edges[0] + 1 else bins).drop("_length")


def curate(df: DataFrame, test_size: float = 0.2, seed: int = 42, bins: int = 3, hints: float = 0.0, holdout: list[str] | None = None, nested_holdout: list[str] | None = None, force_complexity_split: bool = False, size_only: bool = False, only_level: int | None = None, on_small_stratum: str = "fallback") -> DataFrame:
    """The examples (``ex_id, question, answer[, format_id, tags]``) with ``complexity`` and ``split``.

    - With formats, and unless ``force_complexity_split``: the rows of held-out formats - those named, else the best
      subset of :func:`holdout_search` - are for the test; ``hints`` of them, the easiest first, move to the pool. The pool gives the test
      what it still lacks of ``round(test_size * N)`` rows, by strata; the rest is for training.
    - With nested formats: rows with a base format of ``nested_holdout`` are for the test, but for the hints, which move to the training rows.
    - Else a stratified split of everything.
    """
    if not 0 <= hints < 1:
        raise ValueError("the share of hints must be in [0, 1)")
    rows = complexity_of(df, bins)
    formats = "format_id" in df.columns and not force_complexity_split
    first = df.select("format_id").first() if formats else None
    if first is None or first.format_id is None:
        return divided(rows, test_size, seed, None, on_small_stratum)
    if "NestedL" in first.format_id or nested_holdout is not None:
        if not nested_holdout:
            raise ValueError("nested formats need the base formats to hold out")
        held = F.arrays_overlap(constituents(F.col("format_id")), F.array(*map(F.lit, nested_holdout)))
        test = hint_leak(rows.filter(held), hints, only_level)
        return rows.filter(~held).withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.when(F.col("leaked"), "train").otherwise("test")).drop("leaked"))
    if holdout is None:
        holdout = best_holdout(holdout_search(format_stats(rows), test_size, size_only)).first().formats
    unseen = hint_leak(rows.filter(F.col("format_id").isin(*holdout)), hints, only_level)
    pool = rows.filter(~F.col("format_id").isin(*holdout)).unionByName(unseen.filter("leaked").drop("leaked"))
    kept = unseen.filter("not leaked").drop("leaked")
    need, size = max(0, round(test_size * rows.count()) - kept.count()), pool.count()
    return divided(pool, need / size if size else 0, seed, min(need, size), on_small_stratum).unionByName(kept.withColumn("split", F.lit("test")))


def parts(curated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows."""
    return curated.filter("split = 'train'").drop("split"), curated.filter("split = 'test'").drop("split")


def split_report(df: DataFrame) -> DataFrame:
    """Rows by complexity and split, with totals."""
    return df.cube("complexity", "split").agg(F.count("*").alias("n"))


def slices(df: DataFrame, phases: int = 3) -> DataFrame:
    """``phase, tau, cumulative, slice``: rows at or under (k + 1) / K, and the new ones of each phase; one pass."""
    taus = [(k + 1) / phases for k in range(phases)]
    r = df.agg(*(F.count_if(F.col("difficulty") <= F.lit(t)).alias(f"c{k}") for k, t in enumerate(taus))).first()
    cumulative = [r[f"c{k}"] for k in range(phases)]
    rows = [(k, t, c, c - p) for k, (t, (p, c)) in enumerate(zip(taus, pairwise([0, *cumulative]), strict=True))]
    return df.sparkSession.createDataFrame(rows, "phase int, tau double, cumulative long, slice long")


def epochs_equal(total: int, phases: int) -> list[int]:
    base, extra = divmod(total, phases)
    return [base + (k < extra) for k in range(phases)]


def epochs_weighted(total: int, weights: list[float], phases: int | None = None) -> list[int]:
    if phases is not None and len(weights) != phases:
        raise ValueError("one weight for each phase")
    if sum(weights) == 0:
        raise ValueError("weights add up to nothing")
    return [max(1, round(total * w / sum(weights))) for w in weights]


def phase_subsets(df: DataFrame, phases: int = 3) -> DataFrame:
    """Each row once for every phase that includes it."""
    taus = F.array(*(F.struct(F.lit(k).alias("phase"), F.lit((k + 1) / phases).alias("tau")) for k in range(phases)))
    return df.withColumn("p", F.explode(F.filter(taus, lambda t: F.col("difficulty") <= t["tau"]))).withColumn("phase", F.col("p.phase")).drop("p")
