"""All queries over the driver's tables, by name, with SQL of the same meaning.

``documents`` stands for the examples: text is the question, lang the format, and the
tags are the language, and the labels where there are any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import blueprint as B
from tessera.operators import curation as U
from tessera.operators import generate as G
from tessera.operators import scoring as S
from tessera.operators import xmljson as X
from tessera.sources import datasets as D

from .registry import ORACLE_SQL, QUERIES, fixture, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

def examples(spark: SparkSession, sf: str) -> DataFrame:
    """``ex_id, format_id, length, complexity, tags``."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ex_id"), F.col("lang").alias("format_id"), C.content_length(F.col("text")).alias("length"))
    labels = table(spark, sf, "labels")
    tagged = docs.join(labels, docs["ex_id"] == labels["doc_id"], "left").select("ex_id", "format_id", "length", F.array_compact(F.array(F.concat(F.lit("lang_"), "format_id"), F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("tags"))
    return U.with_bins(tagged, "length", U.bin_edges(docs, "length"))


_EDGES = "l AS (SELECT doc_id AS ex_id, lang AS format_id, length(coalesce(text, '')) AS length FROM documents), e AS (SELECT list_sort(list_distinct(quantile_cont(length, [0.0, 1.0/3, 2.0/3, 1.0]))) AS edges FROM l)"
_BINS = f"{_EDGES}, b AS (SELECT l.*, least(2, greatest(0, len(list_filter(edges, lambda x: x <= length)) - 1)) AS complexity FROM l, e)"
_EX = f"{_BINS}, x AS (SELECT b.*, list_filter(['lang_' || format_id, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda t: t IS NOT NULL) AS tags FROM b LEFT JOIN labels ON ex_id = doc_id)"


@query(f"WITH {_BINS} SELECT CAST(complexity AS INTEGER) AS complexity, count(*) AS n, min(length) AS shortest, max(length) AS longest FROM b GROUP BY complexity")
def complexity_bins(spark, sf):
    docs = table(spark, sf, "documents").select(C.content_length(F.col("text")).alias("length"))
    return U.with_bins(docs, "length", U.bin_edges(docs, "length")).groupBy("complexity").agg(F.count("*").alias("n"), F.min("length").cast("long").alias("shortest"), F.max("length").cast("long").alias("longest"))


@query(f"WITH {_EDGES} SELECT generate_subscripts(edges, 1) - 1 AS i, round(unnest(edges), 6) AS edge FROM e")
def bin_edges(spark, sf):
    docs = table(spark, sf, "documents").select(C.content_length(F.col("text")).alias("length"))
    return spark.createDataFrame(list(enumerate(U.bin_edges(docs, "length"))), "i long, edge double").withColumn("edge", F.round("edge", 6))


@query("WITH l AS (SELECT length(coalesce(text, '')) AS n FROM documents), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM l) SELECT CASE WHEN n < a THEN 0 WHEN n <= b THEN 1 ELSE 2 END AS complexity, count(*) AS n FROM l, q GROUP BY 1")
def complexity_p25_p75(spark, sf):
    docs = table(spark, sf, "documents").select(C.content_length(F.col("text")).alias("length"))
    return U.with_fixed_bins(docs, "length").groupBy("complexity").agg(F.count("*").alias("n"))


@query(f"WITH {_EX} SELECT format_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS proportion, list_sort(list_distinct(flatten(list(tags)))) AS tags, list_sort(list_distinct(list(CAST(complexity AS INTEGER)))) AS complexities FROM x GROUP BY format_id")
def format_stats(spark, sf):
    return U.format_stats(examples(spark, sf))


@query(f"WITH {_EX} SELECT ex_id, CAST(len(tags) AS INTEGER) AS num_tags, round(0.5 * complexity / 2 + 0.5 * len(tags) / (SELECT greatest(max(len(tags)), 1) FROM x), 6) AS difficulty FROM x")
def difficulty_score(spark, sf):
    return U.with_difficulty(examples(spark, sf)).select("ex_id", "num_tags", F.round("difficulty", 6).alias("difficulty"))


_STATS = f"{_EX}, s AS (SELECT format_id, count(*) AS n, list_distinct(flatten(list(tags))) AS tags, list_distinct(list(complexity)) AS cs, row_number() OVER (ORDER BY format_id) - 1 AS i FROM x GROUP BY format_id), k AS (SELECT count(*) AS k, sum(n) AS total FROM s), m AS (SELECT unnest(range(1, CAST(1 << k AS BIGINT) - 1)) AS mask FROM k), j AS (SELECT mask, s.*, (mask >> i) & 1 AS member FROM m, s)"
_SCORED = _STATS + ", a AS (SELECT mask, list_sort(list(format_id) FILTER (member = 1)) AS formats, sum(n) FILTER (member = 1) AS cnt, flatten(list(tags) FILTER (member = 1)) AS mine, flatten(list(tags) FILTER (member = 0)) AS other, len(list_distinct(flatten(list(cs) FILTER (member = 1)))) AS nc FROM j GROUP BY mask)"


@query(f"WITH {_SCORED} SELECT mask, round(len(list_filter(list_distinct(mine), lambda t: NOT list_contains(other, t))) + abs(cnt / total - 0.2) + ((SELECT count(DISTINCT complexity) FROM x) - nc) * 0.01, 9) AS score, formats FROM a, k")
def holdout_search(spark, sf):
    return U.holdout_search(U.format_stats(examples(spark, sf)))


@query(f"WITH {_SCORED} SELECT mask, round(abs(cnt / total - 0.2), 9) AS score, formats FROM a, k ORDER BY score, len(formats), formats LIMIT 1")
def holdout_best_by_size(spark, sf):
    return U.best_holdout(U.holdout_search(U.format_stats(examples(spark, sf)), size_only=True))


@query("SELECT lang IN ('fr', 'de') AS held_out, count(*) AS n FROM documents GROUP BY 1")
def holdout_partition(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "format_id")
    return U.by_format(docs, ["fr", "de"]).groupBy((F.col("split") == "test").alias("held_out")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT doc_id, 'NestedL2(' || lang || ',' || CASE WHEN doc_id % 3 = 0 THEN 'es' ELSE 'fr' END || ')' AS f FROM documents) SELECT doc_id, f AS format_id, lang_of = 'es' OR other = 'es' AS held_out FROM (SELECT *, split_part(split_part(f, '(', 2), ',', 1) AS lang_of, rtrim(split_part(f, ',', 2), ')') AS other FROM d)")
def holdout_overlap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", G.nested_id(2, F.col("lang"), F.when(F.col("doc_id") % 3 == 0, "es").otherwise("fr")).alias("format_id"))
    return G.nested_holdout(d, ["es"]).select("doc_id", "format_id", (F.col("split") == "test").alias("held_out"))


@query(f"WITH {_EX}, t AS (SELECT *, row_number() OVER (ORDER BY complexity, ex_id) AS r, count(*) OVER () AS n FROM x WHERE format_id IN ('fr', 'de')) SELECT ex_id, r <= round_even(0.2 * n, 0) AS leaked FROM t")
def hint_leak(spark, sf):
    return U.hint_leak(examples(spark, sf).filter(F.col("format_id").isin("fr", "de")), 0.2).select("ex_id", "leaked")


@query(f"WITH {_EX} SELECT complexity || '_' || array_to_string(list_sort(tags), '-') AS stratum, count(*) AS n FROM x GROUP BY 1")
def strata_counts(spark, sf):
    return U.stratum(examples(spark, sf)).groupBy("stratum").agg(F.count("*").alias("n"))


@query(f"""WITH {_EX}, s AS (SELECT ex_id, format_id AS stratum, md5('42-' || ex_id) AS h FROM x), c AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1), t AS (SELECT ceil(0.2 * sum(n)) AS tests, sum(n) AS total FROM c),
q AS (SELECT stratum, floor(tests * n / total) AS base, row_number() OVER (ORDER BY tests * n / total - floor(tests * n / total) DESC, stratum) AS o, tests FROM c, t), z AS (SELECT stratum, base + CASE WHEN o <= tests - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT s.*, row_number() OVER (PARTITION BY stratum ORDER BY h, ex_id) AS k FROM s) SELECT ex_id, stratum, CASE WHEN k <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN z USING (stratum)""")
def stratified_split(spark, sf):
    return U.stratified_split(examples(spark, sf).select("ex_id", F.col("format_id").alias("stratum"))).select("ex_id", "stratum", "split")


@query(f"WITH {_EX} SELECT CAST(complexity AS INTEGER) AS complexity, CASE WHEN format_id IN ('fr') THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM x GROUP BY CUBE (1, 2)")
def split_report(spark, sf):
    return U.split_report(examples(spark, sf).withColumn("split", F.when(F.col("format_id") == "fr", "test").otherwise("train")))


_DIFF = f"{_EX}, f AS (SELECT ex_id, 0.5 * complexity / 2 + 0.5 * len(tags) / (SELECT greatest(max(len(tags)), 1) FROM x) AS d FROM x), p AS (SELECT unnest([0, 1, 2]) AS phase)"


@query(f"WITH {_DIFF}, c AS (SELECT phase, count(*) FILTER (d <= (phase + 1) / 3) AS cumulative FROM f, p GROUP BY phase) SELECT phase, cumulative, cumulative - coalesce(lag(cumulative) OVER (ORDER BY phase), 0) AS slice FROM c")
def curriculum_slices(spark, sf):
    return U.slices(U.with_difficulty(examples(spark, sf))).select("phase", "cumulative", "slice")


@query(f"WITH {_DIFF}, c AS (SELECT phase, count(*) FILTER (d <= (phase + 1) / 3) AS n FROM f, p GROUP BY phase), s AS (SELECT phase, n - coalesce(lag(n) OVER (ORDER BY phase), 0) AS s FROM c) SELECT phase, CAST(greatest(1, round_even(16 * s / (SELECT sum(s) FROM s), 0)) AS INTEGER) AS epochs FROM s")
def curriculum_epochs(spark, sf):
    got = U.slices(U.with_difficulty(examples(spark, sf))).orderBy("phase").collect()
    return spark.createDataFrame(list(enumerate(U.epochs_weighted(16, [r["slice"] for r in got]))), "phase int, epochs int")


@query(f"WITH {_DIFF} SELECT phase, count(*) AS n, sum(ex_id) AS ids FROM f, p WHERE d <= (phase + 1) / 3 GROUP BY phase")
def curriculum_subsets(spark, sf):
    return U.phase_subsets(U.with_difficulty(examples(spark, sf))).groupBy("phase").agg(F.count("*").alias("n"), F.sum("ex_id").cast("decimal(38,0)").alias("ids"))


@query("SELECT o_orderkey, ['small', 'medium', 'large'][o_orderkey % 3 + 1] AS size_class FROM orders")
def class_cycle(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.in_turn(["small", "medium", "large"], F.col("o_orderkey")).alias("size_class"))


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 12 AS batch FROM events")
def batch_groups(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", U.batch_number(["user_id"], "event_id", 12).alias("batch"))


@query("""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: {'g': 0, 'used': length(l)}) AS lines FROM documents),
r AS (SELECT doc_id, list_reduce(lines, lambda a, l: {'g': a['g'] + CASE WHEN a['used'] > 0 AND a['used'] + l['used'] > 500 THEN 1 ELSE 0 END, 'used': CASE WHEN a['used'] > 0 AND a['used'] + l['used'] > 500 THEN l['used'] ELSE a['used'] + l['used'] END}) AS z, len(lines) AS n FROM d) SELECT doc_id, z['g'] + 1 AS groups, n AS lines FROM r""")
def greedy_line_packing(spark, sf):
    g = C.greedy_groups(F.split("text", "\n"), 500)
    return table(spark, sf, "documents").select("doc_id", g.alias("g")).select("doc_id", (F.element_at("g", -1) + 1).alias("groups"), F.size("g").cast("long").alias("lines"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9_.:-]*)', 1)) AS tag FROM pages")
def tags_in_order(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(C.tag_counts(F.col("html"))).alias("tag"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9_.:-]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n FROM t GROUP BY tag")
def tag_groups(spark, sf):
    return tags_in_order(spark, sf).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hrefs FROM pages")
def attr_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("hrefs"))


@query(r"SELECT page_id, replace(replace(regexp_replace(html, '^\s+|\s+$', '', 'g'), chr(10), ''), '  ', '') AS minified FROM pages")
def minify_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.minify(F.col("html")).alias("minified"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM documents")
def xml_escape(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(C.xml_escape(F.col("text"))).alias("escaped"))


@query("""SELECT r_regionkey, '<region name="' || r_name || '">' || string_agg('<nation>' || n_name || '</nation>', '' ORDER BY n_name) || '</region>' AS xml FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""")
def nation_xml(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    kids = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda n: X.element("nation", C.xml_text(n))), "").alias("kids"))
    return r.join(kids, "r_regionkey").select("r_regionkey", X.element("region", F.col("kids"), name=F.col("r_name")).alias("xml"))


@query("""SELECT r_regionkey, '{"region":{"@name":"' || r_name || '","nation":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']}}' AS json FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""")
def xml_to_json(spark, sf):
    return X.to_json(nation_xml(spark, sf), "xml").select("r_regionkey", "json")


@query("SELECT r_regionkey, unnest(list_sort(list(n_name))) AS nation FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def xml_roundtrip(spark, sf):
    parsed = nation_xml(spark, sf).select("r_regionkey", F.from_xml("xml", "nation array<string>").alias("x"))
    return parsed.select("r_regionkey", F.explode("x.nation").alias("nation"))


@query("SELECT r_regionkey, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def chunk_and_stitch(spark, sf):
    pieces = X.split_documents(nation_xml(spark, sf), "xml", 80)
    texts = X.to_json(pieces, "chunk").select("r_regionkey", "chunk_seq", "json")
    whole = X.stitch(texts, "r_regionkey", "chunk_seq", "json").withColumnRenamed("json", "whole")
    n = F.from_json("whole", "region struct<nation array<string>>")
    return whole.select("r_regionkey", F.size(n["region"]["nation"]).cast("long").alias("nations"))


@query("""SELECT r_regionkey, '{"region":{"@name":"' || r_name || '","nation":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']}}' AS json, 0 AS n_missing FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""")
def blueprint_stitch(spark, sf):
    """Documents cut by a blueprint, converted piece by piece and put together again."""
    return B.convert_by_pieces(nation_xml(spark, sf), "r_regionkey", "xml", lambda parts: X.to_json(parts, "chunk")).withColumn("n_missing", F.col("n_missing").cast("int"))


@query("SELECT event_id, props AS mended FROM events")
def json_repair(spark, sf):
    broken = F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 3 == 1, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(",}"))).otherwise(F.concat("props", F.lit("/>")))
    return table(spark, sf, "events").select("event_id", C.repair_json(broken).alias("mended"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) > 1 AS is_list, list_sort(list(event_id)) AS ids FROM events GROUP BY user_id, event_type")
def collision_promote(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count("*") > 1).alias("is_list"), F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("SELECT n_regionkey AS region, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_regionkey")
def reconstruct_tree(spark, sf):
    leaves = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    return table(spark, sf, "nation").join(leaves, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS c FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT o_orderkey, coalesce('{\"n\":' || c || '}', '{}') AS result FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")
def results_left_default(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.struct(F.count("*").alias("n"))).alias("result"))
    return S.with_results(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", "result")


@query(r"SELECT round(avg(CASE WHEN replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ''), '  ', '') = text THEN 1.0 ELSE 0.0 END), 9) AS exact_match, count(*) AS n FROM documents")
def exact_match(spark, sf):
    return S.exact_match(table(spark, sf, "documents").withColumn("p", C.minify(F.col("text"))), "p", "text")


@query("SELECT doc_id FROM documents WHERE replace(text, chr(10), '') <> text")
def mismatches(spark, sf):
    return S.mismatches(table(spark, sf, "documents").withColumn("p", F.replace("text", F.lit("\n"), F.lit(""))), "p", "text").select("doc_id")


@query("SELECT conv_id, turn, concat_ws(' ', role, text) AS prefixed, '### Instruction:' || chr(10) || role || chr(10) || CASE WHEN coalesce(text, '') = '' THEN '' ELSE '### Context:' || chr(10) || text || chr(10) END AS prompt FROM conversations")
def instruct_prompt(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", C.context_prefix(F.col("role"), F.col("text")).alias("prefixed"), C.instruct_prompt(F.col("role"), F.col("text")).alias("prompt"))


@query("SELECT doc_id, length(coalesce(text, '')) AS n_chars_counted, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n_pieces FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.token_count(F.col("text")).cast("long").alias("n_chars_counted"), F.size(C.token_strings(F.col("text"))).cast("long").alias("n_pieces"))


@query("SELECT vec_id, [CASE WHEN t = 0 THEN -100 ELSE t END for t in list_concat(ids[1:6], [0, 0])] AS labels, [greatest(0, least(4, t)) for t in ids] AS clipped FROM (SELECT vec_id, [CAST(i * label % 7 - 1 AS INTEGER) for i in [1, 2, 3, 4, 5, 6]] AS ids FROM embeddings)")
def pad_mask_clip(spark, sf):
    ids = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: i * F.col("label") % 7 - 1)
    return table(spark, sf, "embeddings").select("vec_id", C.mask_labels(C.pad_truncate(ids, 8)).alias("labels"), C.clip_ids(ids, 5).alias("clipped"))


@query("SELECT conv_id, turn, coalesce(text, role) AS decoded FROM conversations")
def request_decode(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", S.decode_request(F.encode("text", "UTF-8"), F.encode("role", "UTF-8")).alias("decoded"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 40")
def head_eval(spark, sf):
    return U.head(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


@query("SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 0) GROUP BY lang")
def bag_union_minus(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return U.without(d, d.filter("doc_id % 5 = 0"), "doc_id").unionByName(d.filter("doc_id % 2 = 0")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7-' || doc_id), doc_id) AS place FROM documents")
def shuffle_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", C.draw(7, F.col("doc_id")).alias("h"))
    return U.ranked(d, [], F.substring("h", 1, 3), [F.col("h"), F.col("doc_id")], "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("SELECT max_by('checkpoint-' || event_id, event_id) AS latest FROM events WHERE event_id % 7 <> 0")
def latest_checkpoint(spark, sf):
    names = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("other-"), "event_id")).otherwise(F.concat(F.lit("checkpoint-"), "event_id"))
    return D.latest_checkpoint(table(spark, sf, "events").select(names.alias("name")))


_DRAW = "('0x' || substr(md5('42-' || i || '-{}'), 1, 7))::BIGINT"
_LEVEL = "CASE WHEN i < 900 THEN 'easy' WHEN i < 2100 THEN 'medium' ELSE 'hard' END"


@fixture(f"SELECT {G.SECOND!r}[1 + {_DRAW.format('format')} % {len(G.SECOND)}] AS format_id, {_LEVEL} AS difficulty, count(*) AS n, 0 AS different FROM (SELECT unnest(range(3000)) AS i) GROUP BY 1, 2")
def generated_pairs(spark, sf):
    """Rows by format and difficulty as drawn; and every generated XML, converted, equals the JSON it was generated with."""
    made = X.to_json(X.to_json(G.generate(spark, 3000), "question", "plain"), "question", "promoted", promote=True)
    converted = F.when(F.col("format_id") == "AttributePromotedKeyValueList", F.col("promoted")).otherwise(F.col("plain"))
    same = F.coalesce(F.try_parse_json(converted).cast("string") == F.try_parse_json("answer").cast("string"), F.lit(False))
    return made.groupBy("format_id", "difficulty").agg(F.count("*").alias("n"), F.count_if(~same).cast("int").alias("different"))


@fixture(f"SELECT {_LEVEL} AS difficulty, count(*) AS n, min(i) AS first_id FROM (SELECT unnest(range(3000)) AS i) GROUP BY 1")
def difficulty_allocation(spark, sf):
    return G.generate(spark, 3000, ["SingleField"]).groupBy("difficulty").agg(F.count("*").alias("n"), F.min("ex_id").alias("first_id"))


@fixture("SELECT least(4, i // 200 + 1) AS depth, count(*) AS n, 0 AS different, 0 AS rebuilt_differently FROM (SELECT unnest(range(800)) AS i) GROUP BY 1")
def nested_pairs(spark, sf):
    """Nested documents by depth: converted whole, and by pieces where they have no mixed content, they equal the JSON they were generated with."""
    made = X.to_json(G.generate_nested(spark, 800), "question", "converted")
    mixed = F.col("format_id").contains("Mixed")
    pieces = B.convert_by_pieces(made.filter(~mixed), "ex_id", "question", lambda parts: X.to_json(parts, "chunk")).select("ex_id", F.col("json").alias("pieced"))
    both = made.join(pieces, "ex_id", "left")
    parsed = lambda c: F.try_parse_json(F.col(c)).cast("string")
    odd = ~mixed & ~parsed("pieced").eqNullSafe(parsed("answer"))
    return both.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"), F.count_if(~parsed("converted").eqNullSafe(parsed("answer"))).cast("int").alias("different"), F.count_if(odd).cast("int").alias("rebuilt_differently"))
