"""Queries that choose and order rows of many groups at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import merging as M
from tessera.operators import scoring as G
from tessera.operators import selection as S
from tessera.operators import subwords as W

from .registry import query, table


@query("""WITH q AS (SELECT lang, source, CAST(ceil(0.1 * count(*)) AS BIGINT) AS n FROM documents GROUP BY 1, 2), r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS k FROM documents)
SELECT doc_id, k <= n AS chosen FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source""")
def shortest_tenths(spark, sf):
    """Of each language and source the shortest tenth of the documents: all groups' thresholds at once."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    group = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    wanted = docs.groupBy(group.alias("_g")).agg(F.ceil(F.lit(0.1) * F.count("*")).alias("_want"))
    return S.first_rows(docs, group, wanted, F.col("n_chars"), [F.col("doc_id")], "chosen").select("doc_id", "chosen")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS number FROM events")
def numbered_events(spark, sf):
    """Dense numbers of the events in order of time, in two levels."""
    return S.numbered(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "number")


@query()
def shuffled_documents(spark, sf):
    """Documents in a random order that is a permutation of their ids' ranks: no sort but that of the ids, the same for any partitions."""
    return S.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 42).select("doc_id", "place")


@query()
def shuffled_in_blocks(spark, sf):
    """The same inside each language, languages in a set order first."""
    return S.shuffled(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 42, blocks="lang", first=["en", "de"]).select("doc_id", "lang", "place")


@query()
def subword_counts(spark, sf):
    """Tokens of every document by ranked merges of its different words."""
    import public_tokenizers

    ranks = W.read_ranks(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return W.token_counts(table(spark, sf, "documents"), "doc_id", "text", ranks).withColumnRenamed("key", "doc_id")


@query("SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS BIGINT) AS answer FROM conversations")
def answers_by_tokens(spark, sf):
    """Turns of conversations, asked of a model in batches of like length: it tells the number of real places, which padding must not change."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""), lambda x: (F.crc32(x) % 30_000 + 1).cast("int")).alias("ids"))
    asked = G.infer_by_tokens(rows, "ids", lambda: lambda batch: [str(sum(x > 0 for x in ids)) for ids in batch], 4096)
    return asked.select("conv_id", "turn", F.col("output").cast("long").alias("answer"))


@query()
def padding_by_batch(spark, sf):
    """Places that padding to the longest of the batch adds, and those that padding to the longest of the table would."""
    rows = table(spark, sf, "conversations").select(F.split(F.coalesce("text", F.lit("")), r"\s+").alias("words")).select(F.transform("words", lambda x: F.length(x)).alias("ids"))
    sized = G.token_batches(rows, "ids", 4096)
    real, widest = F.sum(F.size("ids")), F.max("width")
    return sized.agg(F.count_distinct("batch").alias("batches"), real.alias("places"), (F.sum("width") - real).alias("padding"), (F.count("*") * widest - real).alias("padding_of_table"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, string_agg(json_extract_string(props, '$.k'), ',' ORDER BY event_id) AS k FROM events GROUP BY 1")
def merged_props(spark, sf):
    """The properties of each user's events as one object, in order of the events: the values of ``k`` as a list, or alone."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("props").alias("text"))
    whole = M.merged(events)
    items = F.from_json(F.regexp_replace(F.get_json_object("json", "$.k"), r"^([^\[].*)$", "[$1]"), "array<string>")
    return whole.select(F.col("key").alias("user_id"), F.size(items).cast("long").alias("n"), F.array_join(items, ",").alias("k"))
