"""Queries over markup as a relation: element tables, structural joins, values by level, pieces within a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import elements as E
from tessera.operators import pieces as P

from .registry import query, table

_VOID = ", ".join(f"'{x}'" for x in E.VOID)
_RAW = ", ".join(f"'{x}'" for x in E.RAW)
_PATTERN = (E.HTML_TOKEN.replace("*+", "*")).replace("'", "''")
#: Tokens of the pages with depth and place; elements and texts with the place of their end; parents.
_TOKENS = f"""k AS (SELECT page_id, unnest(range(len(x)))::INT AS pos, unnest(x) AS token FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{_PATTERN}') AS x FROM pages)),
n AS (SELECT *, nullif(lower(regexp_extract(token, '^</?([A-Za-z_][^\\s/>]*)', 1)), '') AS tag FROM k),
s AS (SELECT *, CASE WHEN tag IS NULL AND starts_with(token, '<![CDATA[') THEN 'cdata' WHEN tag IS NULL AND starts_with(token, '<!') THEN 'declaration' WHEN tag IS NULL AND starts_with(token, '<?') THEN 'instruction' WHEN tag IS NULL THEN 'text' WHEN starts_with(token, '</') THEN 'end' WHEN ends_with(token, '/>') OR tag IN ({_VOID}, {_RAW}) THEN 'leaf' ELSE 'start' END AS sort FROM n),
s1 AS (SELECT *, sum(CASE sort WHEN 'start' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) + CASE sort WHEN 'start' THEN 0 ELSE 1 END AS l FROM s WHERE sort IN ('start', 'end')),
s2 AS (SELECT page_id, pos, max(CASE sort WHEN 'start' THEN pos END) OVER (PARTITION BY page_id, tag, l ORDER BY pos) AS before, min(CASE sort WHEN 'end' THEN pos END) OVER (PARTITION BY page_id, tag, l ORDER BY pos DESC) AS after FROM s1),
s3 AS (SELECT s.* REPLACE (CASE WHEN sort = 'start' AND after IS NULL THEN 'leaf' WHEN sort = 'end' AND before IS NULL THEN 'stray' ELSE sort END AS sort, CASE WHEN sort <> 'end' OR before IS NOT NULL THEN tag END AS tag) FROM s LEFT JOIN s2 USING (page_id, pos)),
d AS (SELECT *, CASE sort WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END AS kind FROM s3),
p AS (SELECT *, sum(kind) OVER w AS depth, sum(length(token)) OVER w AS stop, depth + CASE kind WHEN 1 THEN 0 ELSE 1 END AS level FROM d WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
m AS (SELECT *, first(CASE WHEN sort = 'end' THEN {{'pos': pos, 'stop': stop, 'tag': tag, 'begin': stop - length(token)}} END IGNORE NULLS) OVER (PARTITION BY page_id, level ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM p WHERE sort NOT IN ('declaration', 'instruction', 'stray')),
e AS (SELECT page_id, pos, sort, tag, level, token, stop - length(token) AS begin, CASE kind WHEN 1 THEN coalesce(c.stop, stop) ELSE stop END AS stop, stop AS opened, CASE kind WHEN 1 THEN coalesce(c.begin, stop) ELSE stop END AS closing, CASE kind WHEN 1 THEN c.pos ELSE pos END AS end_pos, CASE kind WHEN 1 THEN c.tag ELSE tag END AS end_tag FROM m WHERE sort <> 'end'),
f AS (SELECT e.*, (SELECT max(o.pos) FROM e o WHERE o.page_id = e.page_id AND o.sort = 'start' AND o.level = e.level - 1 AND o.pos < e.pos) AS parent FROM e)"""

#: Of the pages that are well-formed: a and b say which, x are their elements.
_GOOD = f"""a AS (SELECT page_id, min(depth) AS least, sum(kind) AS open, max(CAST(token = '<' AS INT)) AS stray FROM p GROUP BY 1),
b AS (SELECT page_id FROM e GROUP BY 1 HAVING count(*) FILTER (level = 1 AND tag IS NOT NULL) = 1 AND count(*) FILTER (level = 1 AND tag IS NULL AND trim(translate(token, chr(9) || chr(10) || chr(13), '   ')) <> '') = 0 AND count(*) FILTER (sort = 'start' AND end_tag IS DISTINCT FROM tag) = 0),
x AS (SELECT f.* FROM f JOIN b USING (page_id) JOIN a USING (page_id) WHERE tag IS NOT NULL AND least >= 0 AND open = 0 AND stray = 0)"""


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html")


def _nodes(spark, sf):
    return E.nodes(_pages(spark, sf), "page_id", "html", html=True)


@query(f"WITH {_TOKENS} SELECT page_id, pos, parent, CAST(level AS BIGINT) AS level, tag, CAST(begin AS BIGINT) AS \"begin\", CAST(stop AS BIGINT) AS \"end\" FROM f WHERE tag IS NOT NULL")
def page_elements(spark, sf):
    """Every element of every page with its parent, level and place."""
    return E.elements(_nodes(spark, sf)).select(F.col("key").alias("page_id"), "pos", "parent", F.col("level").cast("long").alias("level"), "tag", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


@query(f"""WITH {_TOKENS}, a AS (SELECT page_id, min(depth) AS least, sum(kind) AS open, max(CAST(token = '<' AS INT)) AS stray FROM p GROUP BY 1),
b AS (SELECT page_id, count(*) FILTER (level = 1 AND tag IS NOT NULL) AS roots, count(*) FILTER (level = 1 AND tag IS NULL AND trim(translate(token, chr(9) || chr(10) || chr(13), '   ')) <> '') AS beside, count(*) FILTER (sort = 'start' AND end_tag IS DISTINCT FROM tag) AS crossed FROM e GROUP BY 1)
SELECT pages.page_id, CASE WHEN stray = 1 THEN 'a stray <' WHEN least < 0 THEN 'an end tag without a start' WHEN crossed > 0 OR open <> 0 THEN 'a start tag without its end' WHEN coalesce(roots, 0) = 0 THEN 'no element' WHEN roots > 1 THEN 'several roots' WHEN beside > 0 THEN 'text beside the root' END AS fault
FROM pages LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id)""")
def page_faults(spark, sf):
    """Why a page isn't well-formed, if it isn't."""
    return E.faults(_pages(spark, sf), "page_id", "html", html=True).withColumnRenamed("key", "page_id")


@query(f"WITH {_TOKENS} SELECT page_id, s3.sort, s.tag, count(*) AS n FROM s3 JOIN s USING (page_id, pos) WHERE s.sort <> s3.sort GROUP BY ALL")
def lone_tags(spark, sf):
    """Start tags without an end tag and end tags without a start tag, by page."""
    rows = E.tokens(_pages(spark, sf), "page_id", "html", html=True)
    told = E.mended(rows).select("key", "pos", F.col("sort").alias("now"))
    return rows.filter("kind != 0").join(told, ["key", "pos"]).filter("now != sort").groupBy(F.col("key").alias("page_id"), F.col("now").alias("sort"), "tag").agg(F.count("*").alias("n"))


@query(f"""WITH {_TOKENS}, x AS (SELECT * FROM f WHERE tag IS NOT NULL)
SELECT i.page_id, i.pos, max(o.pos) AS ancestor, max_by(o.tag, o.pos) AS tag FROM x i JOIN x o ON o.page_id = i.page_id AND o.pos < i.pos AND i.pos < o.end_pos WHERE i.tag = 'a' AND o.tag IN ('nav', 'article', 'div', 'footer', 'body') GROUP BY 1, 2""")
def nearest_sections(spark, sf):
    """The section that each link of a page stands in."""
    own = E.elements(_nodes(spark, sf))
    outer = own.filter(F.col("tag").isin("nav", "article", "div", "footer", "body"))
    found = E.nearest(outer, own.filter("tag = 'a'"))
    return found.join(outer.select("key", F.col("pos").alias("ancestor"), "tag"), ["key", "ancestor"]).select(F.col("key").alias("page_id"), F.col("descendant").alias("pos"), "ancestor", "tag")


@query(f"WITH {_TOKENS}, x AS (SELECT * FROM f WHERE tag IS NOT NULL) SELECT i.page_id, o.tag AS ancestor, i.tag AS descendant, CAST(i.level - o.level AS BIGINT) AS levels, count(*) AS n FROM x i JOIN x o ON o.page_id = i.page_id AND o.pos < i.pos AND i.pos < o.end_pos GROUP BY ALL")
def contained_tags(spark, sf):
    """How often an element of one tag stands in one of another, and how deep."""
    own = E.elements(_nodes(spark, sf))
    pairs = E.inside(own, own)
    tag = lambda end: own.select("key", F.col("pos").alias(end), F.col("tag").alias(f"{end}_tag"))
    named = pairs.join(tag("ancestor"), ["key", "ancestor"]).join(tag("descendant"), ["key", "descendant"])
    return named.groupBy(F.col("key").alias("page_id"), F.col("ancestor_tag").alias("ancestor"), F.col("descendant_tag").alias("descendant"), F.col("levels").cast("long").alias("levels")).agg(F.count("*").alias("n"))


@query(f"""WITH {_TOKENS}, x AS (SELECT * FROM f WHERE tag IS NOT NULL), c AS (SELECT page_id, parent, count(*) AS children FROM x GROUP BY 1, 2), y AS (SELECT x.*, coalesce(children, 0) AS children FROM x LEFT JOIN c ON c.page_id = x.page_id AND c.parent = x.pos)
SELECT page_id, pos, tag, children FROM y WHERE NOT EXISTS (SELECT 1 FROM y g WHERE g.page_id = y.page_id AND g.parent = y.pos AND g.children > 0)""")
def simple_elements(spark, sf):
    """Elements of the pages without grandchildren."""
    return E.simple(_nodes(spark, sf)).withColumnRenamed("key", "page_id")


@query(f"WITH {_TOKENS} SELECT page_id, pos, substr(html, CAST(begin AS BIGINT) + 1, CAST(stop - begin AS BIGINT)) AS fragment FROM f JOIN pages USING (page_id) WHERE tag = 'p'")
def paragraph_fragments(spark, sf):
    """The markup of every paragraph: what a search for ``.//p`` finds."""
    return E.slices(_pages(spark, sf), "page_id", "html", _nodes(spark, sf).filter("tag = 'p'")).withColumnRenamed("key", "page_id")




def order_documents(spark, sf):
    """``o_orderkey, xml``: an order with its lines as a document of three levels."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("n")).alias("line"))
    made = lambda x: F.struct(x["l_linenumber"], F.format_string('<line part="%d" n="%d">%d</line>', x["l_partkey"], x["l_linenumber"], x["n"]).alias("x"))
    lines = lines.groupBy("o_orderkey").agg(F.array_join(F.sort_array(F.transform(F.collect_list("line"), made))["x"], "").alias("lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(lines, "o_orderkey")
    return orders.select("o_orderkey", F.concat(F.lit('<order key="'), "o_orderkey", F.lit('"><status>'), "o_orderstatus", F.lit("</status><!-- lines --><lines>"), "lines", F.lit("</lines><note/>"), "o_orderpriority", F.lit("</order>")).alias("xml"))


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, list('{"@part":"' || l_partkey || '","@n":"' || l_linenumber || '","#text":"' || CAST(l_quantity AS BIGINT) || '"}' ORDER BY l_linenumber, '<line part="' || l_partkey || '" n="' || l_linenumber || '">' || CAST(l_quantity AS BIGINT) || '</line>') AS x FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"order":{"@key":"' || o_orderkey || '","#content":[{"status":"' || o_orderstatus || '"},{"lines":{"line":' || CASE len(x) WHEN 1 THEN x[1] ELSE '[' || array_to_string(x, ',') || ']' END || '}},{"note":null},"' || o_orderpriority || '"]}}' AS json FROM orders JOIN l USING (o_orderkey)""")
def order_json(spark, sf):
    """Order documents as JSON: short ones folded in their rows, wide ones level by level."""
    return E.to_json(order_documents(spark, sf), "o_orderkey", "xml").withColumnRenamed("key", "o_orderkey")


_BUDGET = 600


@query(f"""WITH RECURSIVE {_TOKENS}, {_GOOD},
c AS (SELECT page_id, parent AS pos, min(begin) AS first, count(*) AS children FROM x GROUP BY 1, 2),
y AS (SELECT x.*, coalesce(children, 0) AS children, first, stop - begin > {_BUDGET} AND coalesce(children, 0) > 0 AS split, lead(begin) OVER (PARTITION BY x.page_id, parent ORDER BY x.pos) AS sibling FROM x LEFT JOIN c USING (page_id, pos)),
z AS (SELECT y.*, coalesce(u.split, false) AS p_split, {_BUDGET} - (u.opened - u.begin) - (u.stop - u.closing) AS room, coalesce(y.sibling, u.closing) AS next, coalesce(next - y.begin > room AND (next - y.begin > {_BUDGET} OR y.children > 0), false) AS alone FROM y LEFT JOIN y u ON u.page_id = y.page_id AND u.pos = y.parent),
i AS (SELECT page_id, pos AS parent, pos AS place, opened AS a, first AS b, 0 AS apart FROM z WHERE split AND first > opened UNION ALL SELECT page_id, parent, pos, CASE WHEN alone THEN stop ELSE begin END, next, CAST(alone AS INT) FROM z WHERE p_split),
r AS (SELECT *, sum(apart) OVER (PARTITION BY page_id, parent ORDER BY place) AS run FROM i),
t AS (SELECT r.*, z.room FROM r JOIN (SELECT page_id, pos AS parent, {_BUDGET} - (opened - begin) - (stop - closing) AS room FROM z) z USING (page_id, parent) WHERE b > a),
g AS (SELECT *, row_number() OVER w AS k, sum(b - a) OVER w AS until FROM t WINDOW w AS (PARTITION BY page_id, parent, run ORDER BY place)),
h AS (SELECT page_id, parent, run, k FROM g WHERE k = 1 UNION ALL SELECT g.page_id, g.parent, g.run, (SELECT min(o.k) FROM g o WHERE o.page_id = g.page_id AND o.parent = g.parent AND o.run = g.run AND o.until > g.until - (g.b - g.a) + greatest(g.room, g.b - g.a)) FROM h JOIN g USING (page_id, parent, run, k) WHERE h.k IS NOT NULL),
q AS (SELECT g.page_id, g.parent AS pos, min(a) AS a, max(b) AS b FROM (SELECT g.*, (SELECT max(h.k) FROM h WHERE h.page_id = g.page_id AND h.parent = g.parent AND h.run = g.run AND h.k <= g.k) AS start FROM g) g GROUP BY g.page_id, g.parent, run, start),
v AS (SELECT page_id, a, substr(html, CAST(begin AS BIGINT) + 1, CAST(opened - begin AS BIGINT)) || substr(html, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) || substr(html, CAST(closing AS BIGINT) + 1, CAST(stop - closing AS BIGINT)) AS piece, pos FROM q JOIN z USING (page_id, pos) JOIN pages USING (page_id)
UNION ALL SELECT page_id, begin, substr(html, CAST(begin AS BIGINT) + 1, CAST(stop - begin AS BIGINT)), pos FROM z JOIN pages USING (page_id) WHERE NOT split AND (parent IS NULL OR (p_split AND alone)))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a) AS seq, piece, coalesce((SELECT string_agg(o.tag, '/' ORDER BY o.pos) FROM z o JOIN z w ON w.page_id = o.page_id AND w.pos = v.pos WHERE o.page_id = v.page_id AND o.pos < w.pos AND w.pos < o.end_pos), '') AS path FROM v""")
def page_pieces(spark, sf):
    """Pages as pieces of 600 characters, split on intervals."""
    return P.pieces(_pages(spark, sf), "page_id", "html", _BUDGET, html=True).withColumnRenamed("key", "page_id")


@query(f"""WITH {_TOKENS}, {_GOOD}, r AS (SELECT page_id, pos, parent, tag, sort, token, level FROM x WHERE tag IN ('li', 'a') AND parent IS NOT NULL),
t AS (SELECT page_id, parent, string_agg(token, '' ORDER BY pos) AS text FROM f WHERE sort = 'text' GROUP BY 1, 2)
SELECT a.page_id, a.pos, '{{"@href":' || to_json(regexp_extract(a.token, 'href="([^"]*)"', 1)) || ',"#text":' || to_json(trim(t.text)) || '}}' AS json FROM r a JOIN r l ON l.page_id = a.page_id AND l.pos = a.parent AND l.tag = 'li' JOIN t ON t.page_id = a.page_id AND t.parent = a.pos WHERE a.tag = 'a'""")
def link_json(spark, sf):
    """The links in lists of the pages, out of the pages' JSON by level."""
    own = E.parsed(_pages(spark, sf), "page_id", "html", html=True)
    links = E.values(own, html=True).filter("tag = 'a'").select("key", "pos", "parent", "value")
    items = E.elements(own).filter("tag = 'li'").select("key", F.col("pos").alias("parent"))
    return links.join(items, ["key", "parent"], "left_semi").select(F.col("key").alias("page_id"), "pos", F.col("value").alias("json"))
