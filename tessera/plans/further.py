"""More queries: curation end to end, requests and responses, splitting and merging of fixtures, generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import blueprint as B
from tessera.operators import curation as U
from tessera.operators import formats as O
from tessera.operators import generate as G
from tessera.operators import scoring as S
from tessera.operators import serving as V
from tessera.operators import templates as M
from tessera.operators import xmljson as X

from .catalogue import _EX, examples, nation_xml
from .registry import fixture, query, table, values

# ---- curation


def _tagged(spark, sf):
    """Documents as examples: ``ex_id, question, format_id, tags``."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ex_id"), F.col("text").alias("question"), F.col("lang").alias("format_id"))
    return docs.join(examples(spark, sf).select("ex_id", "tags"), "ex_id")


def _divided(rows: str, tests: str) -> str:
    """SQL of a stratified split of ``rows`` (ex_id, complexity, tags) with its fallback: ``ex_id, split``."""
    return f"""s AS (SELECT ex_id, complexity || '_' || array_to_string(list_sort(tags), '-') AS stratum, md5('42-' || ex_id) AS h FROM {rows}), c AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT CAST({tests} AS BIGINT) AS tests, sum(n) AS total, count(*) AS strata, min(n) AS least FROM c), f AS (SELECT *, least < 2 OR least(tests, total - tests) < strata AS plain FROM t),
q AS (SELECT stratum, (tests * n) // total AS base, row_number() OVER (ORDER BY (tests * n) % total DESC, stratum) AS o, tests FROM c, f), z AS (SELECT stratum, base + CASE WHEN o <= tests - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
k AS (SELECT s.*, row_number() OVER (PARTITION BY stratum ORDER BY h, ex_id) AS k, row_number() OVER (ORDER BY h, ex_id) AS g FROM s),
d AS (SELECT ex_id, CASE WHEN CASE WHEN plain THEN g <= tests ELSE k <= quota END THEN 'test' ELSE 'train' END AS split FROM k JOIN z USING (stratum), f)"""


@query(f"""WITH {_EX}, u AS (SELECT *, row_number() OVER (ORDER BY complexity, ex_id) <= round_even(0.1 * count(*) OVER (), 0) AS leaked FROM x WHERE format_id = 'fr'),
pool AS (SELECT ex_id, complexity, tags FROM x WHERE format_id <> 'fr' UNION ALL SELECT ex_id, complexity, tags FROM u WHERE leaked),
{_divided("pool", "(SELECT greatest(0, round_even(0.2 * count(*), 0)) FROM x) - (SELECT count(*) FROM u WHERE NOT leaked)")}
SELECT ex_id, split FROM d UNION ALL SELECT ex_id, 'test' FROM u WHERE NOT leaked""")
def curated_formats(spark, sf):
    """A held-out format, hints of it to the pool, and what the test still lacks from the pool by strata."""
    return U.curate(_tagged(spark, sf), holdout=["fr"], hints=0.1).select("ex_id", "split")


@query(f"WITH {_EX}, {_divided('x', '(SELECT ceil(0.2 * count(*)) FROM x)')} SELECT ex_id, split FROM d")
def curated_strata(spark, sf):
    return U.curate(_tagged(spark, sf), force_complexity_split=True).select("ex_id", "split")


@query(f"WITH {_EX}, u AS (SELECT ex_id, row_number() OVER (ORDER BY complexity, ex_id) <= round_even(0.2 * count(*) OVER (), 0) AS leaked FROM x WHERE format_id = 'de' OR ex_id % 4 = 0) SELECT x.ex_id, CASE WHEN leaked IS NULL OR leaked THEN 'train' ELSE 'test' END AS split FROM x LEFT JOIN u USING (ex_id)")
def curated_nested(spark, sf):
    """Nested formats with a held-out base format; the easiest fifth of its rows goes to the training rows."""
    rows = _tagged(spark, sf).withColumn("format_id", G.nested_id(2, F.col("format_id"), F.when(F.col("ex_id") % 4 == 0, "de").otherwise("xx")))
    return U.curate(rows, hints=0.2, nested_holdout=["de"]).select("ex_id", "split")


@query(f"WITH {_EX} SELECT list_sort(list_distinct(flatten(list(tags)))) AS tags FROM x")
def all_tags(spark, sf):
    return U.all_tags(examples(spark, sf))


@query(f"WITH {_EX}, h AS (SELECT ex_id, row_number() OVER (ORDER BY complexity, ex_id) <= round_even(0.3 * (SELECT count(*) FROM x WHERE format_id = 'es'), 0) AND complexity = 0 AS leaked FROM x WHERE format_id = 'es') SELECT ex_id, leaked FROM h")
def hints_of_easiest(spark, sf):
    """The older rule: hints come from the lowest bin alone."""
    return U.hint_leak(examples(spark, sf).filter("format_id = 'es'"), 0.3, only_level=0).select("ex_id", "leaked")


@query("WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM d) SELECT doc_id, CASE WHEN n < a THEN 0 WHEN n <= b THEN 1 ELSE 2 END AS complexity FROM d, q")
def missing_complexity(spark, sf):
    """One row without complexity, and all are computed anew."""
    docs = table(spark, sf, "documents").select("doc_id", C.content_length(F.col("text")).alias("length"), F.when(F.col("doc_id") != 1, 7).alias("complexity"))
    return U.with_fixed_bins(docs, "length", only_if_missing=True).select("doc_id", "complexity")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n, n_chars FROM documents WHERE n_chars IS NOT NULL) SELECT CAST(n // 3 AS BIGINT) AS place, n_chars AS value FROM r WHERE r = n // 3")
def nth_smallest(spark, sf):
    docs = table(spark, sf, "documents").filter("n_chars IS NOT NULL")
    n = docs.count() // 3
    return spark.range(1).select(F.lit(n).cast("long").alias("place"), F.lit(U.nth_smallest(docs, "n_chars", n)).cast("long").alias("value"))


@query("SELECT doc_id, coalesce(text, '') AS input_text, lang AS target_text FROM documents")
def training_columns(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("question"), F.col("lang").alias("answer"), F.lit(1).alias("complexity"))
    return S.training_columns(rows).drop(*S.CURATION_COLUMNS)


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(coalesce(text, ''), ' ')[:6], lambda w: length(w)) AS x, list_transform(string_split(role, 'e'), lambda w: length(w)) AS y FROM conversations)
SELECT conv_id, turn, list_concat(x, [0 for i in range(8 - len(x))]) AS input_ids, [CASE WHEN i < len(x) THEN 1 ELSE 0 END for i in range(8)] AS attention_mask, [CASE WHEN v = 0 THEN -100 ELSE v END for v in list_concat(y, [0 for i in range(8 - len(y))])] AS labels FROM t""")
def model_columns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("input_text"), F.translate("role", "e", " ").alias("target_text"))
    return S.model_columns(c, lambda x: F.transform(F.split(x, " "), F.length), 8, 6)


@query("""WITH t AS (SELECT vec_id, [greatest(0, least(9, CASE WHEN v = -100 THEN 0 ELSE v END)) for v in [label, vec_id % 12, -100]] AS p, [greatest(0, least(9, v)) for v in [label, vec_id % 13, 0]] AS r FROM embeddings) SELECT round(avg(CASE WHEN p = r THEN 1.0 ELSE 0.0 END), 9) AS exact_match, count(*) AS n FROM t""")
def evaluate_ids(spark, sf):
    """Masked places, ids outside the vocabulary, a prediction that is a struct."""
    v, i = F.col("label").cast("int"), F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(F.struct(F.array(v, (i % 12).cast("int"), F.lit(-100)).alias("ids"), F.lit("x").alias("more")).alias("p"), F.array(v, (i % 13).cast("int"), F.lit(0)).alias("r"))
    return S.evaluate(rows, "p", "r", lambda ids: F.array_join(ids.cast("array<string>"), " "), 10)


# ---- requests, responses

@query("SELECT conv_id, turn, CASE WHEN coalesce(t, '') = '' THEN 400 ELSE 200 END AS status, CASE WHEN coalesce(t, '') = '' THEN 'missing text' END AS error FROM (SELECT *, CASE WHEN turn % 3 <> 0 THEN text END AS t FROM conversations)")
def text_requests(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 3 != 0, F.col("text")))
    return V.text_requests(c, "text").select("conv_id", "turn", "status", "error")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN props END AS text, CASE event_id % 4 WHEN 2 THEN 'not text' WHEN 3 THEN 'no input' END AS error FROM events")
def micro_batch(spark, sf):
    """Bytes in ``data``, in ``body``, bytes that aren't text, and neither."""
    kind, raw = F.col("event_id") % 4, lambda c: F.encode(c, "UTF-8")
    rows = table(spark, sf, "events").select("event_id", F.when(kind == 0, raw("event_type")).when(kind == 2, F.unhex(F.lit("FFFE41"))).alias("data"), F.when(kind == 1, raw("props")).alias("body"))
    return V.micro_batch(rows).select("event_id", "text", "error")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE 'None' END AS text FROM events")
def stringified(spark, sf):
    kind = F.col("event_id") % 3
    rows = table(spark, sf, "events").select("event_id", F.when(kind == 0, F.col("event_type")).alias("data"), F.when(kind == 1, F.col("event_id")).alias("body"))
    return V.stringified(rows).select("event_id", "text")


@query("SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 100 ELSE 128 END AS INTEGER) AS max_tokens, 0.7 AS temperature, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 0.95 END AS top_p, len(CASE WHEN event_id % 3 = 0 THEN ['x'] ELSE [] END) AS stops FROM events")
def generation_requests(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("prompt"), F.when(e % 2 == 0, e % 100).alias("max_tokens"), F.when(e % 5 == 0, 0.5).alias("top_p"), F.when(e % 3 == 0, F.array(F.lit("x"))).alias("stop"))
    return V.generation_requests(rows).select("event_id", "max_tokens", "temperature", "top_p", F.size("stop").cast("long").alias("stops"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN split_part(event_type, 'e', 1) ELSE event_type END AS text FROM events")
def cut_at_stop(spark, sf):
    stops = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select("event_id", V.cut_at_stop(F.col("event_type"), stops).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CAST(json_object('error', role) AS VARCHAR) ELSE CAST(json_object('output', role) AS VARCHAR) END AS response FROM conversations")
def responses(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", V.response(F.col("role"), F.when(F.col("turn") % 3 == 0, F.col("role"))).alias("response"))


@query("SELECT conv_id, '[' || string_agg(CAST(json_object('prediction', role) AS VARCHAR), ',' ORDER BY turn) || ']' AS response FROM conversations GROUP BY conv_id")
def prediction_lists(spark, sf):
    return V.predictions(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, '[' || string_agg('\"' || role || '\"', ',' ORDER BY turn) || ']' AS response FROM conversations GROUP BY conv_id")
def bare_lists(spark, sf):
    return V.predictions(table(spark, sf, "conversations"), "conv_id", "turn", "role", bare=True)


@query("WITH e AS (SELECT user_id, event_type AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events), o AS (SELECT user_id, event_type AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS pos FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (p IS DISTINCT FROM r) AS different FROM e FULL JOIN o USING (user_id, pos) GROUP BY user_id")
def zipped(spark, sf):
    """Two lists joined by place."""
    e = table(spark, sf, "events")
    p = e.select("user_id", F.col("event_type").alias("p"), U.batch_number(["user_id"], "event_id", 1).alias("pos"))
    r = e.withColumn("_o", -F.col("event_id")).select("user_id", F.col("event_type").alias("r"), U.batch_number(["user_id"], "_o", 1).alias("pos"))
    z = S.zipped(p, r, "user_id", "pos")
    return z.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(~F.col("p").eqNullSafe(F.col("r"))).alias("different"))


# ---- columns

@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'null' WHEN 2 THEN CAST(n_nationkey AS VARCHAR) WHEN 3 THEN '"' || n_name || '"' ELSE '"1.5"' END AS js FROM nation""")
def coerced(spark, sf):
    k = F.col("n_nationkey")
    text = F.when(k % 5 == 0, "true").when(k % 5 == 1, "").when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, F.col("n_name")).otherwise("1.5")
    return table(spark, sf, "nation").select("n_nationkey", C.coerced(text).alias("js"))


@query("SELECT user_id, event_type, CASE WHEN count(*) = 1 THEN min('{\"k\":' || event_id || '}') ELSE '[' || string_agg('{\"k\":' || event_id || '}', ',' ORDER BY event_id) || ']' END AS value FROM events GROUP BY 1, 2")
def promoted_values(spark, sf):
    kept = F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit('{"k":'), "event_id", F.lit("}")).alias("v"))))
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(C.promoted_values(F.transform(kept, lambda s: s["v"])).alias("value"))


@query("SELECT n_nationkey, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'second' ELSE 'first' END AS b FROM nation")
def merged_map(spark, sf):
    a = F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("first"))
    b = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("second"))).otherwise(F.create_map().cast("map<string,string>"))
    m = C.merged_map(a, b)
    return table(spark, sf, "nation").select("n_nationkey", m["a"].alias("a"), m["b"].alias("b"))


@query("SELECT c_custkey, left(c_name, 20) AS cut, 'u' || left(md5('3-' || c_custkey), 7) AS name FROM customer")
def short_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.left(F.col("c_name")).alias("cut"), C.prefix_name(3, F.col("c_custkey")).alias("name"))


@query("SELECT p_partkey, CAST(floor(3 + 17 * sqrt((p_partkey % 100) / 100.0)) AS BIGINT) AS n FROM part")
def skewed_lengths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.skewed_high(3, 20, (F.col("p_partkey") % 100) / 100.0).alias("n"))


@query("""SELECT n_nationkey, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<n>' || n_name || '</n>' AS xml FROM nation""")
def declared(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", C.with_declaration(X.element("n", C.xml_text(F.col("n_name")))).alias("xml"))


# ---- XML and JSON

#: Documents and the JSON that they stand for.
FIXTURES = [
    ("repeated leaves", "<list><item>a</item><item>b</item><item>c</item></list>", '{"list":{"item":["a","b","c"]}}'),
    ("list of objects", '<r><e id="1"><n>x</n></e><e id="2"><n>y</n></e></r>', '{"r":{"e":[{"@id":"1","n":"x"},{"@id":"2","n":"y"}]}}'),
    ("repeated tag in one entity", "<r><e><t>1</t><t>2</t><u>3</u></e></r>", '{"r":{"e":{"t":["1","2"],"u":"3"}}}'),
    ("dotted and hyphenated names", '<zone-style><format attr="a" my.value="b"/></zone-style>', '{"zone-style":{"format":{"@attr":"a","@my.value":"b"}}}'),
    ("entities in an attribute", '<a b="x &quot;y&quot; &amp; z"/>', '{"a":{"@b":"x \\"y\\" & z"}}'),
    ("unclosed tag", "<a><b></a> tail", None),
    ("instruction and empty element", "<?php x?><r><f/></r>", '{"r":{"f":null,"_processing_instructions":[{"php":"x"}]}}'),
    ("attribute, scalar, repeated and empty child", '<r k="v"><s>1</s><t>a</t><t/></r>', '{"r":{"@k":"v","s":"1","t":["a",null]}}'),
    ("empty item of a list", "<l><i>x</i><i/><i>y</i></l>", '{"l":{"i":["x",null,"y"]}}'),
    ("bare root", "<r/>", '{"r":null}'),
    ("same tag inside itself", '<zone id="1"><zone id="2"/><zone id="3"/></zone>', '{"zone":{"@id":"1","zone":[{"@id":"2"},{"@id":"3"}]}}'),
    ("root that begins with a digit", "<1a/>", None),
    ("mixed content", "<p>one <b>two</b> three</p>", '{"p":{"#content":["one",{"b":"two"},"three"]}}'),
    ("namespaces", '<r xmlns:x="urn:x"><x:a x:k="1">v</x:a></r>', '{"r":{"@xmlns:x":"urn:x","x:a":{"@x:k":"1","#text":"v"}}}'),
    ("character data", "<r><c><![CDATA[a < b]]></c></r>", '{"r":{"c":"a < b"}}'),
    ("declared entity", '<!DOCTYPE r [<!ENTITY e "text">]><r><a>&e;</a></r>', '{"r":{"a":"text"}}'),
    ("type hints", '<r><a type="object"/><b type="list"/><c type="string"/><d type="boolean"/></r>', '{"r":{"a":{},"b":[],"c":"","d":false}}'),
    ("booleans and digits", "<r><a>true</a><b>false</b><c>12</c></r>", '{"r":{"a":true,"b":false,"c":"12"}}'),
    ("nothing", None, None),
]


@fixture(f"SELECT name, js FROM {values([(n, j) for n, _, j in FIXTURES], 'name, js')}")
def xml_fixtures(spark, sf):
    return X.to_json(spark.createDataFrame([(n, x) for n, x, _ in FIXTURES], "name string, xml string"), "xml", "js").drop("xml")


@fixture("""SELECT * FROM (VALUES ('{"p": {"k": 1, "j": "\\u00e9"}}', '{"p":{"k":1,"j":"é"}}')) v(spaced, promoted)""")
def xml_dialects(spark, sf):
    """Rows of two attributes as one object, whole numbers, and JSON with spaces and escapes."""
    one = spark.createDataFrame([('<p><i n="k" v="1"/><i n="j" v="é"/></p>', "<p><k>1</k><j>é</j></p>")], "rows string, plain string")
    made = X.to_json(X.to_json(one, "rows", "promoted", promote=True), "plain", "spaced", numbers=True, style=X.SPACED)
    return made.select("spaced", F.replace("promoted", F.lit('"1"'), F.lit("1")).alias("promoted"))


#: Broken texts and what becomes of them.
BROKEN = [
    ("valid", '{"a": 1}', '{"a": 1}'),
    ("attribute", '{"a": {data-id="5"}}', '{"a": {"data-id": "5"}}'),
    ("attribute with spaces", '{id = "5"}', '{"id": "5"}'),
    ("bare word", '{item "x": 1, "y": 2}', '{"item": { "x": 1, "y": 2}}'),
    ("tag end", '{"a":"b"} />', '{"a":"b"} '),
    ("open brackets", '{"a":[1,{"b":2', '{"a":[1,{"b":2}]}'),
    ("comma before a closer", '{"a":[1,],}', '{"a":[1]}'),
    ("comma inside a string", '{"k":"a, }b"', '{"k":"a, }b"}'),
    ("quotes inside a string", '{"a":"x\\"y, }"', '{"a":"x\\"y, }"}'),
    ("doubled commas", '{"a": {taborder="true", "name": 1}}', None),
    ("no JSON", "nonsense", None),
    ("nothing", None, None),
]


@fixture(f"SELECT name, mended FROM {values([(n, m) for n, _, m in BROKEN], 'name, mended')}")
def repair_fixtures(spark, sf):
    return spark.createDataFrame([(n, x) for n, x, _ in BROKEN], "name string, x string").select("name", C.repair_json(F.col("x")).alias("mended"))


#: Fragments of one document in order, and what they come to.
MERGES = [
    ("objects", ['{"a":1}', '{"b":{"c":2}}', '{"b":{"d":3}}'], '{"a":1,"b":{"c":2,"d":3}}'),
    ("lists", ["[1]", "[2,3]"], "[1,2,3]"),
    ("list and scalar", ['{"a":[1]}', '{"a":2}'], '{"a":[1,2]}'),
    ("scalar and list", ['{"a":1}', '{"a":[2]}'], '{"a":[1,2]}'),
    ("equal scalars", ['{"a":1}', '{"a":1}'], '{"a":[1,1]}'),
    ("shell attributes", ['{"r":{"@id":"7","x":1}}', '{"r":{"@id":"7","x":2}}'], '{"r":{"@id":"7","x":[1,2]}}'),
    ("one list", ['[{"a":1},{"b":2}]'], '{"a":1,"b":2}'),
    ("mended", ['{"a":1', '{"b":2,}'], '{"a":1,"b":2}'),
    ("passed over", ["nonsense", '{"a":1}', None], '{"a":1}'),
    ("nothing", [None], "{}"),
]


@fixture(f"SELECT name, js FROM {values([(n, j) for n, _, j in MERGES], 'name, js')}")
def merge_fixtures(spark, sf):
    rows = [(n, i, t) for n, texts, _ in MERGES for i, t in enumerate(texts)]
    return X.stitch(spark.createDataFrame(rows, "name string, i int, t string"), "name", "i", "t").withColumnRenamed("json", "js")


@fixture("""SELECT * FROM (VALUES ('a', '{"x":{"y":2,"z":1},"l":[1,2]}'), ('b', '{"x":1,"__error_1":"bad"}')) v(name, js)""")
def overlaid(spark, sf):
    """Later scalars in place of earlier ones; what doesn't parse leaves a mark."""
    rows = [("a", 0, '{"x":{"y":1,"z":1},"l":[1]}'), ("a", 1, '{"x":{"y":2},"l":[2]}'), ("b", 0, '{"x":1}'), ("b", 1, "bad")]
    return X.overlay(spark.createDataFrame(rows, "name string, i int, t string"), "name", "i", "t").withColumnRenamed("json", "js")


def _lines_xml(spark, sf):
    """Each document as XML, a line an element."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: X.element("p", C.xml_escape(x)))
    return table(spark, sf, "documents").select("doc_id", X.element("doc", F.array_join(lines, ""), id=F.col("doc_id").cast("string")).alias("xml"))


@query("SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS lines, 0 AS too_big FROM documents")
def budgeted_split(spark, sf):
    """Every line is in one piece; only a piece of one line is beyond the budget."""
    pieces = X.split_documents(_lines_xml(spark, sf), "xml", 600)
    n = F.size(F.regexp_extract_all("chunk", F.lit("(<p>|<p/>)"), F.lit(1)))
    return pieces.groupBy("doc_id").agg(F.sum(n).alias("lines"), F.count_if((n > 1) & (F.length("chunk") > 600)).cast("int").alias("too_big"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_seq, md5('<?xml version=\"1.0\" encoding=\"utf-8\"?>' || chr(10) || CASE WHEN l = '' THEN '<p/>' ELSE '<p>' || replace(replace(replace(l, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' END) AS chunk, 'doc' AS path FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)")
def unit_split(spark, sf):
    """Units alone, each with a declaration and the path above it."""
    pieces = X.split_documents(_lines_xml(spark, sf), "xml", 60, unit=lambda tag, attributes: tag == "p", declaration=True)
    return pieces.select("doc_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.md5("chunk").alias("chunk"), "path")


@query("""SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1 AS element_seq, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<nation>' || n_name || '</nation>' AS element FROM region JOIN nation ON r_regionkey = n_regionkey""")
def found_elements(spark, sf):
    return X.find_elements(nation_xml(spark, sf), "xml", "nation").select("r_regionkey", F.col("element_seq").cast("long").alias("element_seq"), "element")


@query("""SELECT r_regionkey, '<region name="' || r_name || '">' || string_agg(chr(10) || '  <nation>' || n_name || '</nation>', '' ORDER BY n_name) || chr(10) || '</region>' AS pretty, true AS same FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""")
def indentation(spark, sf):
    """Even indentation, and documents with an uneven one that stand for the same JSON."""
    xml = X.pretty(nation_xml(spark, sf), "xml")
    noisy = X.to_json(X.uneven(xml, "xml", C.draw(5, F.col("r_regionkey"))), "uneven", "b")
    return X.to_json(noisy, "xml", "a").select("r_regionkey", "pretty", (F.col("a") == F.col("b")).alias("same"))


@query("WITH t AS (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9_.:-]*)', 1) AS tags FROM pages), u AS (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM t) SELECT page_id, tag, list(pos ORDER BY pos) AS places, min(pos) AS first_place FROM u GROUP BY 1, 2")
def children_by_tag(spark, sf):
    """A node's children by tag: ordered lists, and where each tag is first seen."""
    tags = table(spark, sf, "pages").select("page_id", F.posexplode(C.tag_counts(F.col("html"))).alias("pos", "tag"))
    return tags.groupBy("page_id", "tag").agg(F.array_sort(F.collect_list(F.col("pos").cast("long"))).alias("places"), F.min("pos").cast("long").alias("first_place"))


@query("""SELECT r_regionkey, '{"region":{"@name":"' || r_name || '","nation":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) || ']}}' AS json, 0 AS n_missing FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name""")
def served_by_pieces(spark, sf):
    """Pieces go through a batch model in groups of twelve."""
    return V.served(nation_xml(spark, sf), "r_regionkey", "xml", V.simulator(malformed=0.0), B.Limits(60, 20)).withColumn("n_missing", F.col("n_missing").cast("int"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 200 ELSE 500 END AS status, CASE WHEN page_id % 2 = 0 THEN '{\"output\":\"{\\\"p\\\":\\\"' || page_id || '\\\"}\"}' ELSE '{\"error\":\"not well-formed\"}' END AS response FROM pages")
def converted_requests(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<p> "), "page_id", F.when(F.col("page_id") % 2 == 0, "</p>").otherwise("</q>")).alias("input_text"))
    return V.converted(rows).select("page_id", "status", "response")


# ---- generators

_I = "(SELECT unnest(range({})) AS i)"
_DRAW = "('0x' || substr(md5('42-' || i || '-{}'), 1, 7))::BIGINT"


def _templates(df):
    made = X.to_json(df, "question", "js")
    bad = F.col("js").isNull() | F.try_parse_json("answer").isNull()
    return made.groupBy("template").agg(F.count("*").alias("n"), F.count_if(bad).cast("int").alias("malformed"))


@fixture(f"SELECT {[*M.TEMPLATES['v0']]!r}[1 + {_DRAW.format('template')} % {len(M.TEMPLATES['v0'])}] AS template, count(*) AS n, 0 AS malformed FROM {_I.format(750)} GROUP BY 1")
def uniform_templates(spark, sf):
    return _templates(M.generate_uniform(spark))


@fixture(f"SELECT unnest({[t for t in M.TEMPLATES['v1.5'] if t != 'test_cdata_entity']!r}) AS template, 25 AS n, 0 AS malformed")
def equal_templates(spark, sf):
    return _templates(M.generate_equal(spark)).withColumn("n", F.col("n").cast("int"))


_MAIN, _TESTS = [t for t in M.TEMPLATES["v2"] if not t.startswith("test_")], [t for t in M.TEMPLATES["v2"] if t.startswith("test_")]


@fixture(f"SELECT CASE WHEN i < {750 - 25 * len(_TESTS)} THEN {_MAIN!r}[1 + {_DRAW.format('template')} % {len(_MAIN)}] ELSE {_TESTS!r}[1 + (i - {750 - 25 * len(_TESTS)}) // 25] END AS template, count(*) AS n, 0 AS malformed FROM {_I.format(750)} GROUP BY 1")
def pooled_templates(spark, sf):
    return _templates(M.generate_pools(spark))


@fixture(f"SELECT i AS ex_id, [1, 4, 9][1 + i % 3] + {_DRAW.format('n')} % [3, 5, 7][1 + i % 3] AS employees, true AS same FROM {_I.format(300)}")
def employee_lists(spark, sf):
    """Sizes in turn; the XML has the names of the JSON, however it is laid out."""
    made = M.generate_employees(spark, 300)
    inside = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    a, b = inside("input", "<fullName>([^<]*)<"), inside("output", '"fullName":"([^"]*)"')
    return made.select("ex_id", F.size(a).cast("long").alias("employees"), ((a == b) & (F.size(F.array_distinct(a)) == F.size(a))).alias("same"))


@fixture("SELECT CASE WHEN i < 99 THEN 'easy' WHEN i < 201 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN i < 99 THEN ['BasicEntity', 'EmptyElement', 'MixedContent'][1 + i % 3] WHEN i < 201 THEN ['PropertyList', 'DeeplyNested'][1 + (i - 99) % 2] ELSE ['ListOfComplexEntities', 'NestedConfig', 'ListOfLists'][1 + (i - 201) % 3] END AS format_id, count(*) AS n FROM (SELECT unnest(range(300)) AS i) GROUP BY 1, 2")
def formats_by_class(spark, sf):
    return G.generate_by_class(spark, 300).groupBy("difficulty", "format_id").agg(F.count("*").alias("n"))


@fixture(f"SELECT i AS ex_id, list_transform(list_sort(list_transform({O.VOCABULARY!r}, lambda w: {{'h': md5('42-' || i || '-names-' || w), 'w': w}}))[1:{O.NAMES}], lambda s: s['w']) AS names FROM {_I.format(200)}")
def structured_names(spark, sf):
    """Different names for each document, drawn without putting any back."""
    return spark.range(200).select(F.col("id").alias("ex_id"), O.names_of(42, F.col("id")).alias("names"))


@fixture(f"SELECT i AS ex_id, {O.NAMES} AS different, true AS valid, true AS short FROM {_I.format(200)}")
def random_names(spark, sf):
    rows = spark.range(200).select(F.col("id").alias("ex_id"), O.names_of(42, F.col("id"), False).alias("names"))
    return rows.select("ex_id", F.size(F.array_distinct("names")).alias("different"), F.forall("names", lambda n: n.rlike("^[a-z]+_?[a-z._-]*[a-z]$")).alias("valid"), F.forall("names", lambda n: F.length(n) <= 20).alias("short"))


@fixture(f"SELECT * FROM {values([(e, 'train' if k == 0 else 'test', f) for e, sides in O.EXPERIMENTS.items() for k, side in enumerate(sides) for f in side], 'experiment, side, format_id')}")
def experiments(spark, sf):
    """The formats that each experiment draws from; those held out make the test."""
    rows = [(e, f) for e in O.EXPERIMENTS for f in G.active_formats(experiment=e)]
    held = {e: sides[1] for e, sides in O.EXPERIMENTS.items()}
    split = lambda e: U.by_format(spark.createDataFrame([r for r in rows if r[0] == e], "experiment string, format_id string"), held[e])
    return reduce(lambda a, b: a.unionByName(b), map(split, O.EXPERIMENTS)).withColumnRenamed("split", "side")


@fixture("""SELECT * FROM (VALUES ('{"a":{"@k":true,"b":null,"l":{"#item_name":"i","#items":[1,{"@x":"<"}]}}}', '<a k="true"><b></b><l><i>1</i><i x="&lt;" /></l></a>', '{"a":{"@k":true,"b":null,"l":[1,{"@x":"<"}]}}')) v(described, xml, plain)""")
def xml_of_json(spark, sf):
    described = '{"a":{"@k":true,"b":null,"l":{"#item_name":"i","#items":[1,{"@x":"<"}]}}}'
    made = M.with_xml(spark.createDataFrame([(described,)], "described string"), "described", indent=None)
    return made.withColumn("xml", F.replace("xml", F.lit("\n"), F.lit(""))).withColumn("plain", F.lit(M.plain_lists(described)))
