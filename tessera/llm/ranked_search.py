"""Ranked lexical search: TPUT (three-phase uniform threshold) over term-partitioned postings.

A pass over the documents writes the postings of the terms that are asked for. With the counts that it
brings they get their whole contributions to a score and are written again, dealt by
term - a long list over several partitions - and in each partition best first. Then, for all items at once:

1. The ``k`` best postings of each list are fetched. The sums of what a document has among an
   item's heads are at most its score, so the ``k``-th best of them, ``low``, is a bound from below.
2. A document whose score is at least ``low`` has a contribution of ``low / m`` in one of
   the item's ``m`` lists at least, so all postings from that threshold on are fetched. Their sums raise the bound;
   what a list that was not fetched for a document can add is less than the threshold and at most the list's best.
   Fetched postings meet by document, in a row that no other task needs, so that items are summed up there.
3. For documents whose sum and rest reach the bound the remaining contributions are looked up.

All sums and bounds are integers, so ties at the bound stay in; the result is that of scoring everything.

Defined results: a null text has no term and takes no part in counts; each row is a document, so a repeated id
may rank twice; equal scores go by id, null after all others; rows of one item id (null is one) are one item
with the terms of all; an item without a term that any document holds has no rows; texts are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, join_one, map_texts, materialize, shuffle_partitions, small_or_shuffled
from .words import byte_classes, spans

BEST = 50
#: Terms that every task is sent; with more, the postings of all terms are written and joined with those asked for.
VOCABULARY = 500_000
#: Pairs of item and term that every task is sent (some 64 MB); with more, sums are made by a join.
LISTS = 2_000_000
#: Sums of a document and an item that are held at once.
CELLS = 1 << 20
#: Postings of a list that go to one partition, on average; a longer list goes to several.
LIST_ROWS = 100_000
#: Postings of a partition, on average.
PARTITION_ROWS = 2_000_000
#: All but ASCII digits, ASCII letters and what isn't ASCII.
CLASSES = byte_classes(b"", bytes(b for b in range(128) if not chr(b).isalnum()))


def _terms(batches):
    """``item_id, term`` of every item, each term once a batch."""
    for batch in batches:
        rows, names = [], []
        for w in spans(batch.column("text"), CLASSES):
            pairs = np.unique(w.row * len(w.vocabulary) + w.code)
            rows.append(pairs // len(w.vocabulary))
            names.append(w.vocabulary.take(pa.array(pairs % len(w.vocabulary))).cast(pa.string()))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(np.concatenate(rows))), pa.concat_arrays(names)], names=["item_id", "term"])


def _postings(asked):
    """Postings of the terms asked for, or of all, and a row without a term for each batch: the documents with a term and the number of their terms."""

    def run(batches):
        index: dict[bytes, int] = {term: i for i, (term, _) in enumerate(asked.value)} if asked else {}
        numbers = np.array([t for _, t in asked.value], np.int64) if asked else None
        for batch in batches:
            n, found = np.zeros(len(batch), np.int64), [np.empty(0, np.int64)]
            if asked is None:
                index = {}
            for w in spans(batch.column("text"), CLASSES):
                n += np.bincount(w.row, minlength=len(batch))
                names = w.vocabulary.to_pylist()
                own = np.fromiter((index.get(x, -1) for x in names) if asked else (index.setdefault(x, len(index)) for x in names), np.int64, len(names))[w.code]
                hit = own >= 0
                found.append(own[hit] * len(batch) + w.row[hit])
            pairs, tf = np.unique(np.concatenate(found), return_counts=True)
            at = pairs % max(len(batch), 1)
            term = pa.array(numbers[pairs // max(len(batch), 1)]) if asked else pa.array(list(index), pa.binary()).cast(pa.string()).take(pa.array(pairs // max(len(batch), 1)))
            taken = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(taken), batch.column("doc_id").take(taken), term, pa.array(tf.astype(np.int64)), pa.array(n[at])], names=["row", "doc_id", "t", "tf", "n"])
            one = pa.nulls(1)
            yield pa.RecordBatch.from_arrays([one.cast(pa.int64()), one.cast(batch.schema.field("doc_id").type), one.cast(term.type), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["row", "doc_id", "t", "tf", "n"])

    return run


def _raw_postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``row, doc_id, t, tf, n``: written."""
    spark, read = docs.sparkSession, docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    schema = lambda kind: T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("t", kind), T.StructField("tf", T.LongType()), T.StructField("n", T.LongType())])
    if vocabulary.count() <= VOCABULARY:
        asked = spark.sparkContext.broadcast([(r.term.encode(), r.t) for r in vocabulary.collect()])
        return materialize(map_texts(read, _postings(asked), schema(T.LongType())))
    every = materialize(map_texts(read, _postings(None), schema(T.StringType())))
    own = every.filter("t is not null").withColumnRenamed("t", "term").join(vocabulary, "term").select("row", "doc_id", "t", "tf", "n")
    return materialize(own.unionByName(every.filter("t is null").withColumn("t", F.col("t").cast("long"))))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``t, s, row, doc_id``: the contribution ``s`` of term ``t`` to the score of each document, dealt by term, best first; written."""
    raw = _raw_postings(docs, vocabulary)
    total = raw.filter("t is null").agg(F.sum("tf").alias("docs"), F.sum("n").alias("terms")).first()
    many, terms = total.docs or 0, max(total.terms or 0, 1)
    held = raw.filter("t is not null")
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * many + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = materialize(held.groupBy("t").agg(F.count("*").alias("df")).select("t", "df", F.ceil(F.col("df") / LIST_ROWS).cast("int").alias("parts"), weight.alias("w")))
    length = f"(50 + (50 * n * {many}L) div {terms}L)"
    scored = join_one(held, weights, "t", "df", "inner").withColumn("s", F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {length}))")).filter("s > 0")
    n = max(shuffle_partitions(docs.sparkSession), -(-held.count() // PARTITION_ROWS))
    dealt = scored.repartition(n, "t", F.pmod(F.xxhash64("row"), F.col("parts")))
    return materialize(dealt.sortWithinPartitions("t", F.desc("s")).select("t", "s", "row", "doc_id"))


def _kth(sums: DataFrame, k: int, value: str, name: str) -> DataFrame:
    """``q`` and its ``k``-th largest ``value``, where there are so many."""
    order = Window.partitionBy("q").orderBy(F.desc(value))
    return sums.select("q", value).withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k).groupBy("q").agg(F.max(F.when(F.col("_at") == k, F.col(value))).alias(name))


def _joined_candidates(held: DataFrame, lists: DataFrame, rests: DataFrame, k: int) -> DataFrame:
    """``q, row, doc_id, p, most``: sums of what is fetched, and what the scores can be at most, of the documents that may be among the ``k`` best."""
    fetched = held.join(lists, "t").filter("s >= least")
    sums = fetched.groupBy("q", "row").agg(F.sum("s").alias("p"), F.sum("rest").alias("seen"), F.first("doc_id").alias("doc_id"))
    sums = materialize(sums.join(small_or_shuffled(rests), "q").withColumn("most", F.expr("p + rests - seen")).filter("most >= low").select("q", "row", "doc_id", "p", "most", "low"))
    raised = materialize(_kth(sums, k, "p", "raised"))
    return sums.join(small_or_shuffled(raised), "q", "left").filter(F.col("most") >= F.greatest("low", F.coalesce("raised", F.lit(0)))).select("q", "row", "doc_id", "p", "most")


def _summed(lists, rests):
    """For a batch of documents with their fetched postings: pieces of (rows from, ``p``, ``most``), a column an item. Sums stay under 2**53, so doubles are exact."""
    t, q, least, rest = lists
    terms, begin = np.unique(t, return_index=True)
    begin = np.append(begin, len(t))

    def of(batch):
        values, ends = batch.column("postings").flatten(), batch.column("postings").value_lengths().to_numpy()
        term, s = (values.field(i).to_numpy() for i in (0, 1))
        step = max(1, CELLS // max(len(rests), 1))
        bounds = np.append(0, np.cumsum(ends))
        for a in range(0, len(ends), step):
            b = min(a + step, len(ends))
            own = np.searchsorted(terms, term[bounds[a] : bounds[b]])
            many = begin[own + 1] - begin[own]
            at = np.arange(many.sum()) + np.repeat(begin[own] - (np.cumsum(many) - many), many)
            got = np.repeat(s[bounds[a] : bounds[b]], many)
            row = np.repeat(np.repeat(np.arange(b - a), ends[a:b]), many)
            enough = got >= least[at]
            at, cell = at[enough], (row * len(rests) + q[at])[enough]
            p, seen = (np.bincount(cell, x, (b - a) * len(rests)).astype(np.int64).reshape(b - a, -1) for x in (got[enough], rest[at]))
            yield a, p, np.where(p > 0, p + rests - seen, 0)

    return of


def _best_sums(held, k: int):
    """The ``k`` largest sums of each item among the task's documents."""

    def run(batches):
        *lists, rests, _ = held.value
        summed, best = _summed(lists, rests), np.zeros((k, len(rests)), np.int64)
        for batch in batches:
            for _, p, _ in _summed_of(summed, batch):
                best = np.partition(np.concatenate([best, p]), -k, axis=0)[-k:]
        rank, q = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(best[rank, q])], names=["i", "p"])

    return run


def _summed_of(summed, batch):
    return summed(batch) if len(batch) else ()


def _reaching(held, raised):
    def run(batches):
        *lists, rests, names = held.value
        summed, least = _summed(lists, rests), raised.value
        for batch in batches:
            for a, p, most in _summed_of(summed, batch):
                row, q = np.nonzero((most >= least) & (p > 0))
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(p[row, q]), pa.array(most[row, q])], names=["q", "row", "doc_id", "p", "most"])

    return run


def _candidates(held: DataFrame, lists: DataFrame, rests: DataFrame, k: int) -> DataFrame:
    """As :func:`_joined_candidates`, for lists that fit in every task: fetched postings are brought together by document, not by pair of item and document."""
    spark = held.sparkSession
    known = rests.orderBy("q").collect()  # one row an item; like ``lists`` under ``LISTS``
    names, low = (np.array([r[c] for r in known], np.int64) for c in ("q", "low"))
    own = lists.orderBy("t", "q").toArrow()
    t, q, least, rest = (own.column(c).to_numpy() for c in ("t", "q", "least", "rest"))
    shared = spark.sparkContext.broadcast((t, np.searchsorted(names, q), least, rest, np.array([r.rests for r in known], np.int64), names))
    wanted = F.broadcast(lists.groupBy("t").agg(F.min("least").alias("least")))
    fetched = held.join(wanted, "t").filter("s >= least").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("t", "s")).alias("postings"))
    fetched = materialize(fetched)
    best = fetched.select("postings").coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(_best_sums(shared, k), "i long, p long")
    for r in _kth(best.withColumnRenamed("i", "q"), k, "p", "raised").filter("raised is not null").collect():
        low[r.q] = max(low[r.q], r.raised)
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("row", T.LongType()), held.schema["doc_id"], T.StructField("p", T.LongType()), T.StructField("most", T.LongType())])
    return fetched.mapInArrow(_reaching(shared, spark.sparkContext.broadcast(low)), schema)


def top_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``docs`` for each item (``item_id, text``) with a score above 0."""
    asked = materialize(map_texts(items.select("item_id", "text"), _terms, T.StructType([items.schema["item_id"], T.StructField("term", T.StringType())])).distinct())
    named = materialize(asked.select("item_id").distinct().withColumn("q", F.monotonically_increasing_id()))
    vocabulary = materialize(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    sized = small_or_shuffled(named).withColumnRenamed("item_id", "_id")
    lists = asked.join(small_or_shuffled(vocabulary), "term").join(sized, F.col("item_id").eqNullSafe(F.col("_id"))).select("q", "t")
    held = postings(docs, vocabulary)

    # 1: heads
    heads = materialize(held.withColumn("_at", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "row"))).filter(F.col("_at") <= k).select("t", "s", "row", "_at"))
    lists = materialize(lists.join(heads.filter("_at = 1").select("t", F.col("s").alias("most")), "t"))
    from_heads = heads.join(small_or_shuffled(lists.select("q", "t")), "t").groupBy("q", "row").agg(F.sum("s").alias("p"))
    bounds = lists.groupBy("q").agg(F.count("*").alias("m")).join(_kth(from_heads, k, "p", "low"), "q", "left")
    bounds = materialize(bounds.select("q", F.coalesce("low", F.lit(0)).alias("low"), F.greatest(F.lit(1), F.expr("coalesce(low, 0) div m")).alias("least")))

    # 2: all postings from the threshold on; ``rest``: what the lists that weren't fetched can add at most
    whole = materialize(lists.join(small_or_shuffled(bounds), "q").withColumn("rest", F.least(F.col("least") - 1, "most")))
    rests = materialize(whole.groupBy("q").agg(F.sum("rest").alias("rests"), F.first("low").alias("low")))
    open_lists = whole.filter("most >= least").select("q", "t", "least", "rest")
    candidates = materialize((_candidates if whole.count() <= LISTS else _joined_candidates)(held, open_lists, rests, k))

    # 3: the candidates' contributions below the threshold
    open_ones = small_or_shuffled(candidates.filter("most > p").select("q", "row"))
    below = small_or_shuffled(whole.filter("rest > 0").select("q", "t", "least"))
    looked_up = held.select("t", "s", "row").join(open_ones, "row").join(below, ["q", "t"]).filter("s < least").groupBy("q", "row").agg(F.sum("s").alias("added"))
    scores = candidates.join(looked_up, ["q", "row"], "left").withColumn("score", F.col("p") + F.coalesce("added", F.lit(0)))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(small_or_shuffled(named), "q").select("item_id", "rank", "doc_id", "score")


#: The same over the driver's tables.
OP12_SQL = r"""
with terms as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from documents
), whole as (
  select count(*) filter (len(ws) > 0) as docs, sum(len(ws))::bigint as terms from terms
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from benchmark
), held as (
  select r, doc_id, term, any_value(n) as n, count(*) as tf
  from (select r, doc_id, len(ws)::bigint as n, unnest(ws) as term from terms) where term in (select term from asked) group by r, doc_id, term
), weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from held, whole group by term
), scored as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from asked join held using (term) join weights using (term), whole group by item_id, r, doc_id
)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
) where rank <= 50
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
