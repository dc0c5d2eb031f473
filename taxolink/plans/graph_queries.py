"""Integrity, coverage, versions, evidence, note tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taxolink.functions import text as T
from taxolink.operators import evidence as E
from taxolink.operators import graph as G
from taxolink.operators import notes as N
from taxolink.operators import versions as V
from taxolink.plans.registry import query, table
from taxolink.sources import sinks as S
from taxolink.streaming import jobs as J
from taxolink.streaming import timers as TM


def _shared(spark, name):
    """A new folder below the one all executors share."""
    return f"{G.shared_root(spark)}/taxolink-{uuid.uuid4().hex}/{name}"


@query("SELECT o_orderkey AS src_id, o_custkey AS dst_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def dangling(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("src_id"), F.col("o_custkey").alias("dst_id"))
    return G.dangling(edges, table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("node_id")))


@query("SELECT o_orderkey AS node_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orphans(spark, sf):
    """Orders that no returned line links to."""
    return G.orphans(table(spark, sf, "orders").select(F.col("o_orderkey").alias("node_id")), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("dst_id")))


@query("""
WITH e AS (SELECT 'S' || l_suppkey AS src_id, 'P' || l_partkey AS dst_id FROM lineitem UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.src_id = e.dst_id AND f.dst_id = e.src_id)""")
def asymmetric(spark, sf):
    """Suppliers link to their parts, and parts back unless all lines of the pair were returned."""
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src_id"), F.concat(F.lit("P"), "l_partkey").alias("dst_id"), "l_returnflag")
    return G.asymmetric(li.select("src_id", "dst_id").unionByName(li.where("l_returnflag <> 'R'").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))))


@query("""
SELECT l_orderkey AS src_id, l_partkey AS dst_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 30 DAY GROUP BY ALL""")
def stale(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src_id"), F.concat(F.lit("p"), "l_partkey").alias("dst_id"), F.col("l_shipdate").alias("checked"))
    nodes = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("changed"))
    cut = lambda c: F.substring(c, 2, 20).cast("long").alias(c)
    return G.stale(edges, nodes).select(cut("src_id"), cut("dst_id")).groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


@query("""
SELECT lang, source, count(*) AS n_nodes, count(l.doc_id) AS n_linked, round(count(l.doc_id) / count(*), 6) AS share
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def coverage(spark, sf):
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "lang", "source")
    return G.coverage(nodes, table(spark, sf, "labels").select(F.col("doc_id").alias("dst_id")), ["lang", "source"])


@query("""
SELECT n1.r AS src_fw, count(*) FILTER (n2.r = 'r0') AS r0, count(*) FILTER (n2.r = 'r1') AS r1, count(*) FILTER (n2.r = 'r2') AS r2, count(*) FILTER (n2.r = 'r3') AS r3, count(*) FILTER (n2.r = 'r4') AS r4
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT c_custkey, 'r' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) n1 ON o_custkey = c_custkey
JOIN (SELECT s_suppkey, 'r' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) n2 ON l_suppkey = s_suppkey GROUP BY n1.r""")
def matrix(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("r"))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r").alias("src_fw"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r").alias("dst_fw"))
    edges = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return G.matrix(edges, [f"r{i}" for i in range(5)])


@query("""
WITH c AS (SELECT 'R' || n_regionkey AS a, 'R' || n_regionkey || '.' || c_nationkey AS b, 'R' || n_regionkey || '.' || c_nationkey || '.' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)
SELECT a AS ancestor, count(*) AS n FROM c GROUP BY a UNION ALL SELECT b, count(*) FROM c GROUP BY b UNION ALL SELECT c, count(*) FROM c GROUP BY c""")
def roll_up(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = c.select(F.col("c_custkey").alias("node_id"), T.cumulative_path(F.concat(F.lit("R"), F.concat_ws(".", "n_regionkey", "c_nationkey", "c_custkey"))).alias("path"))
    return G.roll_up(nodes, table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.count("*").alias("n")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def level_totals(spark, sf):
    return G.level_totals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""
SELECT -1 - n_nationkey AS id, -1 - n_nationkey AS component FROM nation UNION ALL SELECT c_custkey, -1 - c_nationkey FROM customer
UNION ALL SELECT 1000000000000 + o_orderkey, -1 - c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def graph_components(spark, sf):
    """Orders, their customers and the customers' nations: every component has one nation, whose id is least."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("src_id"), (F.lit(-1) - F.col("c_nationkey")).cast("long").alias("dst_id"))
    o = table(spark, sf, "orders").select((F.lit(10**12) + F.col("o_orderkey")).alias("src_id"), F.col("o_custkey").alias("dst_id"))
    nodes = c.select("src_id").unionByName(o.select("src_id")).unionByName(table(spark, sf, "nation").select((F.lit(-1) - F.col("n_nationkey")).cast("long").alias("src_id")))
    return G.components(spark, c.unionByName(o), nodes.select(F.col("src_id").alias("id")))


@query("""
WITH o AS (SELECT 'O' || o_orderkey AS a, 'C' || o_custkey AS b, 'N' || c_nationkey AS c, 'R' || n_regionkey AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT a AS start, a AS node, 0 AS hops FROM o UNION ALL SELECT a, b, 1 FROM o UNION ALL SELECT a, c, 2 FROM o UNION ALL SELECT a, d, 3 FROM o UNION ALL SELECT a, 'top', 4 FROM o""")
def reachable(spark, sf):
    """From every order by its customer, nation and region to the top, and from there round in a cycle."""
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src_id"), F.concat(F.lit(b), y).alias("dst_id"))
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    regions = n.select(F.concat(F.lit("R"), "n_regionkey").alias("src_id"), F.lit("top").alias("dst_id")).distinct()
    e = edge(o, "O", "o_orderkey", "C", "o_custkey").unionByName(edge(c, "C", "c_custkey", "N", "c_nationkey")).unionByName(edge(n, "N", "n_nationkey", "R", "n_regionkey")).unionByName(regions).unionByName(regions.select(F.col("dst_id").alias("src_id"), F.lit("top").alias("dst_id")))
    return G.reachable(spark, e, o.select(F.concat(F.lit("O"), "o_orderkey").alias("id")))


_CUT = "1997-01-01"


def _snapshots(spark, sf):
    """Orders before a date, and all orders but some, with altered status."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    old = o.where(F.col("o_orderdate") < _CUT)
    new = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return old, new.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 13 == 0, "Z").otherwise(F.col("o_orderpriority")))


_OLD_NEW = f"""
WITH old AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{_CUT}'),
new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 13 = 0 THEN 'Z' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 11 <> 0)
"""


@query(_OLD_NEW + """
SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey, CASE WHEN old.o_orderkey IS NULL THEN 'added' WHEN new.o_orderkey IS NULL THEN 'removed' WHEN s <> o_orderstatus THEN 'type_changed' ELSE 'properties_changed' END AS change
FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey WHERE old.o_orderkey IS NULL OR new.o_orderkey IS NULL OR s <> o_orderstatus OR p <> o_orderpriority""")
def node_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    return V.node_diff(old, new, "o_orderkey", ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query(_OLD_NEW + """
SELECT coalesce(old.o_orderkey, new.o_orderkey) AS src_id, coalesce(old.o_custkey, new.o_custkey) AS dst_id, CASE WHEN old.o_orderkey IS NULL THEN 'added' WHEN new.o_orderkey IS NULL THEN 'removed' ELSE 'type_changed' END AS change
FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey AND old.o_custkey = new.o_custkey WHERE old.o_orderkey IS NULL OR new.o_orderkey IS NULL OR s <> o_orderstatus""")
def edge_diff(spark, sf):
    side = lambda df: df.select(F.col("o_orderkey").alias("src_id"), F.col("o_custkey").alias("dst_id"), F.col("o_orderstatus").alias("relation"))
    return V.edge_diff(*map(side, _snapshots(spark, sf)))


@query("""
SELECT c_custkey AS node_id, c_nationkey AS old_parent, (c_nationkey + 1) % 25 AS new_parent FROM customer WHERE c_custkey % 5 = 0""")
def moved_nodes(spark, sf):
    c = table(spark, sf, "customer")
    side = lambda parent: c.select(F.col("c_custkey").alias("src_id"), parent.alias("dst_id"), F.lit("parent").alias("relation"))
    return V.moved(V.edge_diff(side(F.col("c_nationkey")), side(F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")))))


@query("""
WITH p AS (SELECT DISTINCT l_partkey AS old_id, l_suppkey AS new_id FROM lineitem)
SELECT new_id AS id, 'merge' AS kind, count(*) AS n FROM p GROUP BY new_id HAVING count(*) > 1 UNION ALL SELECT old_id, 'split', count(*) FROM p GROUP BY old_id HAVING count(*) > 1""")
def reshaped(spark, sf):
    return V.reshaped(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("old_id"), F.col("l_suppkey").alias("new_id")))


@query("""
SELECT o_orderkey AS node_id, o_orderstatus AS fw, CASE WHEN o_orderkey % 2 = 0 THEN 'added' ELSE 'removed' END AS change,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 'auto' WHEN o_orderkey % 2 = 1 THEN 'review' ELSE 'keep' END AS strategy FROM orders""")
def strategies(spark, sf):
    changes = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("fw"), F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 2 == 0, "added").otherwise("removed").alias("change"))
    rules = spark.createDataFrame([("F", None, "added", "auto"), (None, None, "removed", "review"), (None, None, None, "keep")], "fw string, node_id long, change string, strategy string")
    return V.strategies(changes, rules)


@query(_OLD_NEW + """
SELECT o_orderkey, o_orderstatus, 'old' AS valid_from, CASE WHEN NOT EXISTS (SELECT 1 FROM new WHERE new.o_orderkey = old.o_orderkey AND s = o_orderstatus) THEN 'now' END AS valid_to FROM old
UNION ALL SELECT o_orderkey, s, 'now', NULL FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE new.o_orderkey = old.o_orderkey AND s = o_orderstatus)""")
def scd2(spark, sf):
    old, new = _snapshots(spark, sf)
    history = old.select("o_orderkey", "o_orderstatus", F.lit("old").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    return V.scd2(history, new.select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], F.lit("now"))


@query(_OLD_NEW + """
SELECT o_orderkey, o_orderstatus FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT o_orderkey, s FROM new""")
def scd1(spark, sf):
    old, new = (x.select("o_orderkey", "o_orderstatus") for x in _snapshots(spark, sf))
    return V.scd1(old, new, "o_orderkey")


@query("""
SELECT user_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events
  WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)) WHERE k = 1""")
def replay(spark, sf):
    e = table(spark, sf, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    return V.replay(e, "user_id", ["event_type", F.round("value", 6).alias("value")], ["ts", "event_id"], F.lit(low + (high - low) / 2), "ts")


@query("""
SELECT l_orderkey AS src_id, l_partkey AS dst_id, count(*) AS n FROM lineitem WHERE l_partkey % 10 = 0 GROUP BY ALL""")
def review_queue(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    changes = table(spark, sf, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("node_id"), F.lit("removed").alias("change"))
    return V.review_queue(edges, changes).where("end = 'dst_id'").groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


_FRESH = "CASE WHEN l_shipdate < TIMESTAMP '1997-06-01' THEN 'expired' WHEN l_shipdate - INTERVAL 30 DAY <= TIMESTAMP '1997-06-01' THEN 'stale' ELSE 'fresh' END"


def _evidence(spark, sf):
    e = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return e.withColumn("freshness", E.freshness(F.date_sub("day", 90), F.col("day"), F.to_date(F.lit("1997-06-01"))))


@query(f"SELECT {_FRESH.replace('l_shipdate', 'date_trunc(chr(100)||chr(97)||chr(121), l_shipdate)')} AS freshness, count(*) AS n FROM lineitem GROUP BY 1")
def freshness(spark, sf):
    return _evidence(spark, sf).groupBy("freshness").agg(F.count("*").alias("n"))


@query(f"""
SELECT l_returnflag, l_linestatus, freshness, count(*) AS n FROM (SELECT *, {_FRESH.replace('l_shipdate', "date_trunc('day', l_shipdate)")} AS freshness FROM lineitem) WHERE freshness <> 'fresh' GROUP BY ALL""")
def work_queue(spark, sf):
    return E.work_queue(_evidence(spark, sf), ["l_returnflag", "l_linestatus"])


@query("""
SELECT l_returnflag IN ('A', 'N') AND l_quantity < 45 AS valid, count(*) AS n FROM lineitem GROUP BY 1""")
def evidence_checks(spark, sf):
    e = table(spark, sf, "lineitem").withColumn("reviewer", F.when(F.col("l_quantity") < 45, "x"))
    good, bad = E.checked(e, ["reviewer"], {"l_returnflag": ["A", "N"]})
    return good.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT l_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(l_partkey AS VARCHAR))) AS h, string_agg(l_orderkey, ',' ORDER BY l_linenumber, l_orderkey) AS orders FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || format('{:x}', (('0x' || h[17])::INT & 3) | 8) || h[18:20] || '-' || h[21:32] AS id, orders FROM h""")
def interchange(spark, sf):
    got = E.interchange(table(spark, sf, "lineitem"), "l_partkey", ["l_orderkey"], "l_linenumber", "6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    return got.select("l_partkey", "id", F.array_join(F.transform(F.from_json("components", "array<struct<l_orderkey:long>>"), lambda x: x["l_orderkey"].cast("string")), ",").alias("orders"))


_MAPPING = N.NoteMapping(base="vault", levels=["region", "nation"], frontmatter={"c_name": "name", "c_mktsegment": "segment"}, links=["related"], body={"c_mktsegment": "quote"}, title="c_name", framework="customers", version="1")


def _notes(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.concat(F.lit("R/"), "n_regionkey").alias("region"), F.col("n_name").alias("nation"), "c_name", "c_mktsegment", F.concat_ws(",", "c_mktsegment", "n_name").alias("related"), F.col("c_custkey").alias("row"))
    return N.render(rows, _MAPPING, "row", "customer.parquet")


_PATH = "'vault/R-' || n_regionkey || '/' || n_name || '/' || c_name || '.md'"


@query(f"""
SELECT {_PATH} AS path, 'row-' || c_custkey AS node_id, c_name AS name, c_mktsegment AS segment, '[[' || c_mktsegment || ']]|[[' || n_name || ']]' AS related, '## c_mktsegment' || chr(10) || '> ' || c_mktsegment AS body
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def note_table(spark, sf):
    n = _notes(spark, sf)
    head = F.from_json("frontmatter", "struct<properties: map<string,string>, related: array<string>>")
    return n.select("path", "node_id", head["properties"]["name"].alias("name"), head["properties"]["segment"].alias("segment"), F.array_join(head["related"], "|").alias("related"), "body")


def _conflict(spark, sf, mode):
    n = _notes(spark, sf).select("path", "fw", "body", "source_row")
    old = n.where("source_row % 2 = 0").withColumn("body", F.lit("old"))
    return N.write_plan(n, old, mode)


def _conflict_sql(body, status):
    return f"""SELECT {_PATH} AS path, {body} AS body, CASE WHEN c_custkey % 2 = 0 THEN '{status}' ELSE 'created' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey"""


_NEW_BODY = "'## c_mktsegment' || chr(10) || '> ' || c_mktsegment"
_KEPT_BODY = f"CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE {_NEW_BODY} END"


@query(_conflict_sql(_KEPT_BODY, "skipped"))
def conflict_skip(spark, sf):
    notes, results = _conflict(spark, sf, "skip")
    return notes.select("path", "body").join(results, "path")


@query(_conflict_sql(_NEW_BODY, "replaced"))
def conflict_replace(spark, sf):
    notes, results = _conflict(spark, sf, "replace")
    return notes.select("path", "body").join(results, "path")


@query(_conflict_sql(_KEPT_BODY, "error"))
def conflict_error(spark, sf):
    notes, results = _conflict(spark, sf, "error")
    return notes.select("path", "body").join(results, "path")


@query("""
SELECT c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'mine' END AS own, c_name AS name FROM customer""")
def conflict_merge(spark, sf):
    c = table(spark, sf, "customer")
    new = c.select(F.col("c_custkey").alias("path"), F.create_map(F.lit("name"), "c_name").alias("props"))
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path"), F.create_map(F.lit("name"), F.lit("was"), F.lit("own"), F.lit("mine")).alias("props"))
    notes, _ = N.write_plan(new, old, "merge")
    return notes.select("path", F.col("props")["own"].alias("own"), F.col("props")["name"].alias("name"))


@query(f"SELECT n_name AS fw, {_PATH} AS path, {_NEW_BODY} AS body FROM customer JOIN nation ON c_nationkey = n_nationkey")
def note_sink(spark, sf):
    """Notes written with one folder per framework over an older set, and read back: a full refresh."""
    out = _shared(spark, "notes")
    notes = _notes(spark, sf).withColumn("fw", F.element_at(F.split("path", "/"), -2))
    S.write_notes(notes.withColumn("body", F.lit("old")), out)
    S.write_notes(notes, out)
    return spark.read.parquet(out).select("fw", "path", "body")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('week', ts), event_id) AS k FROM events) WHERE k = 1")
def incremental_ingest(spark, sf):
    """Events arrive in files by week, one week a batch; the first of each user is kept."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    src, out = _shared(spark, "in"), _shared(spark, "out")
    weeks = [r["m"] for r in e.select(F.date_trunc("week", "ts").alias("m")).distinct().orderBy("m").collect()]  # a batch for each
    for m in weeks:
        e.where(F.date_trunc("week", "ts") == F.lit(m)).write.mode("append").parquet(src)
        J.ingest_new(J.file_stream(spark, src, e.schema), out, "user_id", ["event_id"], f"{out}-checkpoint").awaitTermination()
    return J.ingested(spark, out, e.schema).select("event_id", "user_id", "event_type")


def _run(spark, made, keys):
    """Run a stream to a folder of the changes of each batch; the last row of each key."""
    out = _shared(spark, "changes")
    J.run_to_folder(made, out, f"{out}-checkpoint").awaitTermination()
    return J.latest(spark, out, made.schema, keys)


@query("SELECT event_type AS fw, count(*) AS n_links FROM events GROUP BY event_type")
def running_counts(spark, sf):
    stream = J.file_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema).select(F.col("event_type").alias("fw"))
    return _run(spark, J.running_counts(stream, ["fw"]), ["fw"])


@query("SELECT date_trunc('day', ts) AS start, event_type AS fw, count(*) AS n_links FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    stream = J.file_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("fw"))
    return _run(spark, J.windowed_counts(stream, "ts", ["fw"]), ["start", "fw"])


@query("""
WITH n AS (SELECT user_id, max(ts) AS changed, arg_max(CAST(ts AS DATE) + CAST(event_id % 90 AS INTEGER) - 20, ts) AS expires, CAST(max(ts) AS DATE) AS today FROM events GROUP BY user_id)
SELECT user_id, changed, CASE WHEN expires < today THEN 'expired' WHEN expires - 30 <= today THEN 'stale' ELSE 'fresh' END AS freshness FROM n""")
def streaming_freshness(spark, sf):
    """Evidence as a stream: the newest event of each user says how fresh the user's evidence is."""
    stream = J.file_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("collected"), F.date_add(F.to_date("ts"), (F.col("event_id") % 90 - 20).cast("int")).alias("expires"))
    return _run(spark, J.freshness_changes(stream, "user_id", "collected", "expires", "ts"), ["user_id"])


@query("""
WITH n AS (SELECT user_id, max(ts) AS last, arg_max(CAST(ts AS DATE) + CAST(event_id % 90 AS INTEGER) - 20, ts) AS expires FROM events GROUP BY user_id),
w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
t AS (SELECT user_id, last, expires, CAST(expires AS TIMESTAMP) - INTERVAL 30 DAY AS stale_at, CAST(expires AS TIMESTAMP) + INTERVAL 1 DAY AS expired_at, mark FROM n, w)
SELECT user_id, CASE WHEN expires < CAST(greatest(last, mark) AS DATE) THEN 'expired' WHEN expires - 30 <= CAST(greatest(last, mark) AS DATE) THEN 'stale' ELSE 'fresh' END AS freshness,
  CASE WHEN expired_at > last AND expired_at <= mark THEN expired_at WHEN stale_at > last AND stale_at <= mark THEN stale_at ELSE last END AS changed FROM t""")
def freshness_timers(spark, sf):
    """The same evidence, but its freshness goes on changing while the watermark passes: the last change of each user."""
    stream = J.file_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("collected"), F.date_add(F.to_date("ts"), (F.col("event_id") % 90 - 20).cast("int")).alias("expires"))
    made, out = TM.freshness_timeline(stream, "user_id", "collected", "expires", "ts"), _shared(spark, "changes")
    TM.run_timeline(made, out, f"{out}-checkpoint").awaitTermination()
    return J.latest(spark, out, made.schema, ["user_id"], ["changed"])
