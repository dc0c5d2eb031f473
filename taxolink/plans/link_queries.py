"""Link passes, mapping joins and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolink.functions import text as T
from taxolink.operators import aggregate as A
from taxolink.operators import graph as G
from taxolink.operators import joins as J
from taxolink.operators import links as L
from taxolink.operators import match as M
from taxolink.plans.registry import query, table


def _edges(spark, sf, n_parts=None):
    """Orders and parts as nodes, lineitem as the mapping between them."""
    pairs = J.mapping_pairs(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")
    link = J.LinkPass("orders_parts", "orders", "parts")
    return J.link_pass(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "part"), "p_partkey", pairs, link, n_parts)


@query("""
WITH e AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part))
SELECT fw, count(*) AS n_links FROM (SELECT 'orders' AS fw FROM e UNION ALL SELECT 'parts' FROM e) GROUP BY fw""")
def link_pass_counts(spark, sf):
    return J.link_counts(_edges(spark, sf))


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part))
SELECT fw, count(*) AS n_links FROM (SELECT 'orders' AS fw FROM e UNION ALL SELECT 'parts' FROM e) GROUP BY fw""")
def link_pass_distinct(spark, sf):
    n_parts = J.parts(2 * table(spark, sf, "lineitem").count())
    return J.link_counts(_edges(spark, sf, n_parts), distinct=True, n_parts=n_parts)


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS src_id, string_agg(DISTINCT '[[P-' || l_partkey || ']]', ' ' ORDER BY '[[P-' || l_partkey || ']]') AS links
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_orderkey""")
def link_lists(spark, sf):
    pairs = J.mapping_pairs(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")
    edges = J.link_pass(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "part"), "p_partkey", pairs, J.LinkPass("op", "orders", "parts", write_to="source", prefix="P-"))
    return A.link_lists(edges).select(F.col("src_id").cast("string").alias("src_id"), F.array_join("links", " ").alias("links"))


@query("""
SELECT c.c_custkey, c.c_name, n.n_name, r.r_name FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def left_enrich(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    got = J.join_keep_left(J.join_keep_left(table(spark, sf, "customer"), nation, ["c_nationkey"]), region, ["n_regionkey"])
    return got.select("c_custkey", "c_name", "n_name", "r_name")


@query("""
SELECT s.s_suppkey AS suppkey, p.p_brand, n.n_name, count(*) AS n FROM supplier s
LEFT JOIN lineitem l ON s.s_suppkey = l.l_suppkey LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY ALL""")
def bridge_chain(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey"))
    bridge = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("partkey"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), "p_brand")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return J.bridge_chain(s, (bridge, ["suppkey"]), (part, ["partkey"]), (nation, ["nationkey"])).groupBy("suppkey", "p_brand", "n_name").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def premerge(spark, sf):
    return J.premerge(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders"), "c_custkey", "o_custkey", "o_orderkey")


@query("""
SELECT a.c_custkey AS key_ctrl, b.c_custkey AS key_assess, 'AA-' || a.c_custkey AS merge_key
FROM customer a LEFT JOIN customer b ON a.c_custkey = b.c_custkey AND b.c_custkey % 3 <> 0""")
def key_normalize_join(spark, sf):
    n = table(spark, sf, "customer")
    left = n.select(F.col("c_custkey").alias("key"), F.format_string("AA-%02d", "c_custkey").alias("code"))
    right = n.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.concat(F.lit("AA-"), "c_custkey").alias("ref"))
    return J.join_on_derived(left, right, T.normalize_id(F.col("code")), T.normalize_id(F.col("ref")), ("_ctrl", "_assess")).select("key_ctrl", "key_assess", "merge_key")


@query("""
SELECT p_partkey, l.l_orderkey FROM part LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON p_partkey = l.l_partkey""")
def label_join(spark, sf):
    labels = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit(" P"), "l_partkey").alias("label")).distinct()
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("P"), "p_partkey", F.lit("  ")).alias("name"))
    return J.label_join(part, labels, "name", "label").select("p_partkey", "l_orderkey")


@query("""
SELECT 'part' AS fw, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')
UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')""")
def unmapped(spark, sf):
    """Parts and orders that the mapping of returned open lines lacks."""
    pairs = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'O'").select(F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id"))
    part = J.unmapped(table(spark, sf, "part"), "p_partkey", pairs, "right_id").select(F.lit("part").alias("fw"), "id")
    return part.unionByName(J.unmapped(table(spark, sf, "orders"), "o_orderkey", pairs).select(F.lit("order").alias("fw"), "id"))


@query("""
SELECT 'customer' AS fw, count(*) AS n, count(c_mktsegment) AS with_segment FROM customer
UNION ALL SELECT 'supplier', count(*), 0 FROM supplier""")
def mapping_stack(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return J.stack([("customer", c), ("supplier", s)]).groupBy("fw").agg(F.count("*").alias("n"), F.count("segment").alias("with_segment"))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS left_id, count(*) AS n, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts
FROM lineitem GROUP BY l_orderkey""")
def multi_map(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("source_row", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    got = A.multi_map(rows, "l_orderkey", "l_partkey", "source_row")
    return got.select("left_id", F.size("right_ids").cast("long").alias("n"), F.array_join("right_ids", ",").alias("parts"))


@query("""
SELECT l_orderkey AS order_id, l_partkey AS part_id, count(*) AS n FROM lineitem GROUP BY ALL""")
def multi_value_mapping(spark, sf):
    """Right cells hold many ids in markup; ids are extracted before the join."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    n = J.parts(li.count())
    cells = li.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("P-"), "l_partkey", F.lit(' [part](u "t")'))), "<br><br>").alias("cell"))
    pairs = J.mapping_pairs(cells, "l_orderkey", "cell", id_pattern=r"P-\d+").repartition(n, "left_id")
    got = J.mapped_edges(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id")).repartition(n, "id"), "id", pairs)
    ids = got.select(F.col("src_id").cast("long").alias("order_id"), F.substring("dst_id", 3, 20).cast("long").alias("part_id"))
    return ids.repartition(n, "order_id", "part_id").groupBy("order_id", "part_id").agg(F.count("*").alias("n"))


@query("""
SELECT DISTINCT o_custkey AS src_id, CAST(o_orderkey AS VARCHAR) AS dst_id FROM orders""")
def related_ids(spark, sf):
    """Comma lists of related ids become one edge per id."""
    cells = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ", ").alias("related"))
    return J.related(cells, "o_custkey", "related")


@query("""
SELECT p_name AS left_id, p_partkey AS right_id FROM part""")
def match_exact(spark, sf):
    """The distinct names against the padded names of all parts."""
    p = table(spark, sf, "part")
    names = p.select(F.col("p_name").alias("id"), F.col("p_name").alias("value")).distinct()
    return M.match(names, p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("value")), "exact")


@query("""
WITH t AS (SELECT l_orderkey AS id, list(DISTINCT p_brand) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
s AS (SELECT DISTINCT p_brand FROM part)
SELECT s.p_brand AS left_id, t.id AS right_id FROM s JOIN t ON list_contains(t.v, s.p_brand)""")
def match_array(spark, sf):
    part = table(spark, sf, "part")
    lists = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_set("p_brand"), ", ").alias("value"))
    return M.match(part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("value")).distinct(), lists, "array-contains")


@query("""
WITH p AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS w FROM part)
SELECT w AS left_id, p_partkey AS right_id FROM p JOIN part ON regexp_matches(p_type, '^' || w || '\\b')""")
def match_regex(spark, sf):
    part = table(spark, sf, "part")
    word = F.split("p_type", " ")[0]
    patterns = part.select(word.alias("id"), F.concat(F.lit("^"), word, F.lit(r"\b")).alias("value")).distinct()
    return M.match(patterns, part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("value")), "regex")


_JACCARD = """
WITH v AS (SELECT DISTINCT p_name AS value FROM part),
s AS (SELECT value, list_distinct(regexp_split_to_array(lower(trim(value)), '[^\\p{L}\\p{N}]+')) AS t FROM v),
j AS (SELECT a.value AS left_id, b.value AS right_id, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM s a JOIN s b ON true)
"""


@query(_JACCARD + "SELECT left_id, right_id, round(i / (n - i), 6) AS score FROM j WHERE i / (n - i) >= 1.0 / 3 - 1e-12")
def match_jaccard(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("value")).distinct()
    return M.match(v, v, "jaccard", threshold=1 / 3 - 1e-12).withColumn("score", F.round("score", 6))


@query()
def match_seqratio(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("value")).distinct()
    return M.match(v, v, "seqratio", threshold=0.7).withColumn("score", F.round("score", 6))


@query("""
WITH v AS (SELECT DISTINCT p_name AS value FROM part),
broken AS (SELECT value || ' x' AS target FROM v),
s AS (SELECT value, list_distinct(regexp_split_to_array(lower(value), '[^\\p{L}\\p{N}]+')) AS t FROM v),
b AS (SELECT target, list_distinct(regexp_split_to_array(lower(target), '[^\\p{L}\\p{N}]+')) AS t FROM broken),
j AS (SELECT b.target AS left_id, s.value AS suggestion, len(list_intersect(b.t, s.t)) / (len(b.t) + len(s.t) - len(list_intersect(b.t, s.t))) AS score FROM b JOIN s ON true)
SELECT left_id, suggestion, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, suggestion DESC) AS k FROM j WHERE score >= 0.4) WHERE k = 1""")
def nearest(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_name").alias("value")).distinct()
    broken = v.select(F.concat("value", F.lit(" x")).alias("id"), F.concat("value", F.lit(" x")).alias("value"))
    return M.nearest(broken, v).withColumn("score", F.round("score", 6))


@query("""
WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS target FROM pages)
SELECT target, count(*) AS n_links FROM e WHERE target NOT IN (SELECT regexp_extract(url, '/(\\w+)(\\?|$)', 1) FROM pages WHERE page_id % 2 = 0) GROUP BY target""")
def broken_links(spark, sf):
    """Pages as notes: their links are rendered as wiki links and looked up among note names."""
    pages = table(spark, sf, "pages")
    notes = pages.select(F.col("page_id").alias("path"), F.regexp_replace("html", r'href="/([^"]+)"', "[[$1]]").alias("text"))
    nodes = pages.where("page_id % 2 = 0").select(F.regexp_extract("url", r"/(\w+)(\?|$)", 1).alias("name"))
    rendered = notes.withColumn("text", F.concat_ws("\n", F.regexp_extract_all("text", F.lit(r"\[\[[^\]]+\]\]"), F.lit(0))))
    return L.broken_links(rendered, nodes).groupBy("target").agg(F.count("*").alias("n_links"))


@query("""
SELECT page_id AS path, count(*) AS n_links, count(DISTINCT t) AS n_targets FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS t FROM pages) GROUP BY page_id""")
def note_links(spark, sf):
    notes = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.concat_ws("\n", F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1)), lambda x: F.concat(F.lit("[["), x, F.lit("|a]]")))).alias("text"))
    return L.wikilinks(notes).groupBy("path").agg(F.count("*").alias("n_links"), F.count_distinct("target").alias("n_targets"))


@query("""
SELECT event_id AS path, 'fw' AS framework, CAST(user_id AS VARCHAR) AS target, event_type AS kind, CAST(event_id % 7 AS VARCHAR) AS weight FROM events""")
def typed_links(spark, sf):
    notes = table(spark, sf, "events").select(F.col("event_id").alias("path"), F.format_string('text\nfw.maps:: [[%d|user]] {"kind": "%s", "weight": "%d"} more\n', "user_id", "event_type", F.col("event_id") % 7).alias("text"))
    got = L.typed_links(notes)
    return got.select("path", F.regexp_extract("field", r"^(\w+)", 1).alias("framework"), "target", F.col("json")["kind"].alias("kind"), F.col("json")["weight"].alias("weight"))


@query("""
SELECT event_id AS path, CAST(user_id AS VARCHAR) AS target, 'explicit' AS kind, event_type AS weight, 'd' AS note FROM events""")
def priority_merge(spark, sf):
    """An explicit value wins over an object at a key, which wins over one at the root; note defaults fill the rest."""
    text = 'fw:: [[%d]] {"kind": "root", "weight": "root"}\nfw.a:: [[%d]] {"kind": "leaf", "weight": "%s"}\nfw.kind:: [[%d]] "explicit"\nfw.note:: "d"\n'
    notes = table(spark, sf, "events").select(F.col("event_id").alias("path"), F.format_string(text, "user_id", "user_id", "event_type", "user_id").alias("text"))
    got = L.merged_values(L.link_values(L.typed_links(notes)))
    return got.select("path", "target", F.col("props")["kind"].alias("kind"), F.col("props")["weight"].alias("weight"), F.col("props")["note"].alias("note"))


@query("SELECT l_orderkey AS src_id, l_partkey AS dst_id, count(*) AS n FROM lineitem WHERE l_partkey = 17 GROUP BY ALL")
def leaf(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    return L.inbound(edges, 17).groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT c_nationkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 'R' || n_regionkey AS folder, count(*) AS n_links FROM e GROUP BY n_regionkey
UNION ALL SELECT 'R' || n_regionkey || '/N' || c_nationkey, count(*) FROM e GROUP BY ALL""")
def folder(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    paths = c.select(F.col("c_custkey").alias("node_id"), F.array(F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), "c_nationkey")).alias("path"))
    return L.inbound_below(table(spark, sf, "orders").select(F.col("o_custkey").alias("dst_id")), paths)


@query("SELECT 'part' AS dst_fw, l_partkey AS dst_id, count(*) AS n_links FROM lineitem GROUP BY l_partkey")
def inbound_global(spark, sf):
    return L.inbound_by_framework(table(spark, sf, "lineitem").select(F.lit("part").alias("dst_fw"), F.col("l_partkey").alias("dst_id")))


@query("""
SELECT l_orderkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 4) AS a, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 4) AS n, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS r
FROM lineitem GROUP BY l_orderkey""")
def pivot(spark, sf):
    got = L.pivoted(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", ["A", "N", "R"])
    return got.select("l_orderkey", *(F.round(k, 4).alias(k.lower()) for k in "ANR"))


@query("""
SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(max(o_totalprice), 2) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def property_view(spark, sf):
    return L.view(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority"), F.col("o_orderstatus") == "F", ["priority"], n=F.count("*"), mean=F.round(F.avg("o_totalprice"), 2), top=F.round(F.max("o_totalprice"), 2))


@query("""
SELECT c_custkey AS start, l_partkey AS "end", 2 AS hops, count(*) AS n_paths FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def chain(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("left_id"), F.col("o_orderkey").alias("right_id"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id"))
    return G.chain(a, b).select("start", "end", "hops", "n_paths")


_RELATION = "CASE {0} % 4 WHEN 0 THEN 'equal' WHEN 1 THEN 'subset' WHEN 2 THEN 'superset' ELSE 'none' END"


@query(f"""
WITH a AS (SELECT o_custkey AS l, o_orderkey AS r, {_RELATION.format('o_orderkey')} AS rel FROM orders),
b AS (SELECT l_orderkey AS l, l_partkey AS r, {_RELATION.format('l_partkey')} AS rel FROM lineitem)
SELECT rel AS relation, count(*) AS n, round(sum(c), 4) AS confidence FROM (
  SELECT CASE WHEN a.rel = 'equal' THEN b.rel WHEN b.rel = 'equal' THEN a.rel WHEN a.rel = b.rel AND a.rel IN ('subset', 'superset') THEN a.rel
    WHEN a.rel = 'subset' AND b.rel = 'none' THEN 'none' WHEN a.rel = 'none' AND b.rel = 'superset' THEN 'none' ELSE 'unknown' END AS rel, CAST(0.45 AS DOUBLE) AS c
  FROM a JOIN b ON a.r = b.l) GROUP BY rel""")
def compose(spark, sf):
    rel = lambda c: F.element_at(F.array(*map(F.lit, ("equal", "subset", "superset", "none"))), (F.col(c) % 4 + 1).cast("int"))
    make = lambda df, l, r, conf: df.select(F.col(l).alias("left_id"), F.col(r).alias("right_id"), rel(r).alias("relation"), F.lit(conf).alias("confidence"), F.current_date().alias("dated"))
    got = G.compose(make(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 0.9), make(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 0.5))
    return got.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("SELECT o_orderkey AS via, count(*) AS n_derived FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def blast_radius(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("left_id"), F.col("o_orderkey").alias("right_id"), F.lit("equal").alias("relation"), F.lit(1.0).alias("confidence"), F.lit(None).cast("date").alias("dated"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id"), F.lit("equal").alias("relation"), F.lit(1.0).alias("confidence"), F.lit(None).cast("date").alias("dated"))
    return G.blast_radius(G.compose(a, b))
