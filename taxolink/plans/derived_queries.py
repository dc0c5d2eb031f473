"""Chains of mappings, changes of shape, patterns and order by other columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from taxolink.operators import graph as G
from taxolink.operators import intervals as I
from taxolink.operators import match as M
from taxolink.operators import ordered as O
from taxolink.operators import profile as P
from taxolink.operators import versions as V
from taxolink.plans import table_queries as TQ
from taxolink.plans.registry import query, table
from taxolink.sources import note_files as NF
from taxolink.sources import note_store as S
from taxolink.sources import readers as R
from taxolink.sources import variants as VR
from taxolink.streaming import jobs as J
from taxolink.streaming import keyed as K

_REL = "['equal', 'subset', 'superset', 'none'][{0} % 4 + 1]"
#: Four layers, as in sheets that map one framework to the next: nations, customers, orders, parts.
_LAYERS = f"""
WITH RECURSIVE m AS (
  SELECT l, r, rel, max(c) AS c FROM (
    SELECT 'N' || c_nationkey AS l, 'C' || c_custkey AS r, {_REL.format('c_custkey')} AS rel, 1 - (c_custkey % 10) / 20 AS c FROM customer
    UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, {_REL.format('o_orderkey')}, 1 - (o_orderkey % 10) / 20 FROM orders
    UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey, {_REL.format('l_partkey')}, 1 - (l_partkey % 10) / 20 FROM lineitem) GROUP BY l, r, rel),
walk AS (
  SELECT l, r, rel, c, 1 AS hops, CAST([] AS VARCHAR[]) AS via FROM m
  UNION ALL
  SELECT w.l, m.r, CASE WHEN w.rel = 'equal' THEN m.rel WHEN m.rel = 'equal' THEN w.rel WHEN w.rel = m.rel AND w.rel IN ('subset', 'superset') THEN w.rel ELSE 'none' END,
    w.c * m.c, w.hops + 1, list_append(w.via, w.r)
  FROM walk w JOIN m ON w.r = m.l
  WHERE w.rel = 'equal' OR m.rel = 'equal' OR (w.rel = m.rel AND w.rel IN ('subset', 'superset')) OR (w.rel = 'subset' AND m.rel = 'none') OR (w.rel = 'none' AND m.rel = 'superset')),
best AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY l, r, rel ORDER BY c DESC, hops, via) = 1)
"""


#: Layers by the place of their letter.
_LETTERS = "NCOP"
#: Digits that a number in an id may have.
_DIGITS = 15


def _shift(digits):
    """The power of ten that moves a number of so many digits to the left end."""
    return F.get(F.array(*(F.lit(10**n).cast("long") for n in range(_DIGITS, -1, -1))), digits)


def _coded(letter, number):
    """The id of ``letter`` and ``number`` as one long that sorts as the text of both does: place of the letter, digits moved to the left end, how many they are."""
    digits = F.octet_length(number.cast("string"))
    code = _LETTERS.index(letter) * 2**54 + number * _shift(digits) * 16 + digits
    return F.when(number.between(0, 10**_DIGITS - 1), code).when(number.isNotNull(), F.raise_error(F.lit(f"no number of up to {_DIGITS} digits"))).cast("long")


def _text(code):
    """The id that ``_coded`` made a number of."""
    rest = code.bitwiseAND(2**54 - 1)
    return F.concat(F.substring(F.lit(_LETTERS), (F.shiftright(code, 54) + 1).cast("int"), F.lit(1)), F.call_function("div", F.shiftright(rest, 4), _shift(rest.bitwiseAND(15).cast("int"))))


def _layers(spark, sf):
    """The mappings of all layers; ids are coded as longs, as chains deal, compare and sort them in every round."""
    rel = lambda c: F.element_at(F.array(*map(F.lit, ("equal", "subset", "superset", "none"))), (F.col(c) % 4 + 1).cast("int"))
    side = lambda df, a, x, b, y: table(spark, sf, df).select(_coded(a, F.col(x)).alias("left_id"), _coded(b, F.col(y)).alias("right_id"), rel(y).alias("relation"), (1 - (F.col(y) % 10) / 20).alias("confidence"))
    return side("customer", "N", "c_nationkey", "C", "c_custkey").unionByName(side("orders", "C", "o_custkey", "O", "o_orderkey")).unionByName(side("lineitem", "O", "l_orderkey", "P", "l_partkey"))


@query(_LAYERS + "SELECT l AS src_id, r AS dst_id, rel AS relation, round(c, 6) AS confidence, hops, array_to_string(via, ' ') AS via FROM best")
def relation_chains(spark, sf):
    """What chains of any length from nations to parts say, with the most confident way to each."""
    got = G.derive(spark, _layers(spark, sf))
    return got.select(_text(F.col("src_id")).alias("src_id"), _text(F.col("dst_id")).alias("dst_id"), "relation", F.round("confidence", 6).alias("confidence"), "hops", F.array_join(F.transform("via", _text), " ").alias("via"))


@query(_LAYERS + "SELECT v AS via, count(*) AS n_derived FROM (SELECT unnest(list_distinct(via)) AS v FROM best) GROUP BY v")
def chain_radius(spark, sf):
    """How much of what is derived rests on each customer and order."""
    return G.blast_radius(G.derive(spark, _layers(spark, sf))).select(_text(F.col("via")).alias("via"), "n_derived")


_PAIRED = """
WITH old AS (SELECT p_partkey AS k, p_partkey // 2 AS j, p_brand AS b, p_size AS s, p_type AS t FROM part),
new AS (SELECT k, j, CASE WHEN k % 5 = 0 THEN 'X' ELSE b END AS b, CASE WHEN k % 7 = 0 THEN NULL ELSE s END AS s, t FROM old),
pair AS (
  SELECT old.j, old.k AS o, new.k AS n, 0.6 + 0.4 * (CASE WHEN old.b = new.b THEN 1 ELSE 0 END + CASE WHEN old.s = new.s THEN 1 ELSE 0 END + CASE WHEN old.t = new.t THEN 1 ELSE 0 END) / 3 AS score FROM old JOIN new ON old.j = new.j),
ok AS (SELECT *, 'p' || o AS old_id, 'q' || n AS new_id FROM pair WHERE score >= 0.8 - 1e-9),
one AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY j ORDER BY score DESC, old_id, new_id) = 1),
two AS (SELECT ok.* FROM ok JOIN one ON ok.j = one.j AND ok.o <> one.o AND ok.n <> one.n QUALIFY row_number() OVER (PARTITION BY ok.j ORDER BY ok.score DESC, ok.old_id, ok.new_id) = 1)
SELECT old_id, new_id, 'similar' AS how FROM one UNION ALL SELECT old_id, new_id, 'similar' FROM two"""


@query(_PAIRED)
def renamed_one_to_one(spark, sf):
    """Two old and two new parts share each title; brand, size and type tell which is which, and no id is used twice."""
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Part "), F.floor(F.col("p_partkey") / 2)).alias("value"), F.col("p_brand").alias("b"), F.col("p_size").alias("s"), F.col("p_type").alias("t"))
    old = part.withColumn("id", F.concat(F.lit("p"), "p_partkey"))
    new = part.withColumn("id", F.concat(F.lit("q"), "p_partkey")).withColumn("b", F.when(F.col("p_partkey") % 5 == 0, "X").otherwise(F.col("b"))).withColumn("s", F.when(F.col("p_partkey") % 7 != 0, F.col("s")))
    aliases = spark.createDataFrame([], "old_id string, new_id string")
    return V.renamed(old, new, aliases, 0.8, ["b", "s", "t"])


@query("""
WITH b AS (SELECT p_partkey AS k, p_partkey // 6 AS b FROM part),
p AS (SELECT DISTINCT b, CASE b % 4 WHEN 0 THEN k // 3 WHEN 1 THEN k WHEN 2 THEN b * 10 ELSE k END + CASE b % 4 WHEN 2 THEN 50000000 ELSE 0 END + CASE b % 4 WHEN 0 THEN 70000000 ELSE 0 END AS o,
  CASE b % 4 WHEN 0 THEN k // 2 WHEN 1 THEN b WHEN 2 THEN k ELSE k END + CASE b % 4 WHEN 0 THEN 70000000 WHEN 1 THEN 50000000 ELSE 0 END AS n FROM b),
g AS (SELECT CASE WHEN b % 4 = 3 THEN o ELSE -b END AS part, b, min(o) AS component, count(DISTINCT o) AS n_old, count(DISTINCT n) AS n_new, count(*) AS n_links, count(DISTINCT CASE WHEN o % 11 = 0 THEN o END) AS n_moved FROM p GROUP BY 1, b)
SELECT component, CASE WHEN n_old > 1 AND n_new > 1 THEN 'restructure' WHEN n_old = 1 AND n_new = 1 THEN 'rename' WHEN n_moved > 0 AND n_moved < n_old THEN 'restructure' WHEN n_old > 1 THEN 'merge' ELSE 'split' END AS kind, n_old, n_new, n_links, n_moved FROM g""")
def restructured(spark, sf):
    """Blocks of six parts: some regrouped, some merged, some split, some renamed; every eleventh old id has another parent."""
    k, b = F.col("p_partkey"), F.floor(F.col("p_partkey") / 6)
    old = F.when(b % 4 == 0, F.floor(k / 3) + 70_000_000).when(b % 4 == 2, b * 10 + 50_000_000).otherwise(k)
    new = F.when(b % 4 == 0, F.floor(k / 2) + 70_000_000).when(b % 4 == 1, b + 50_000_000).otherwise(k)
    pairs = table(spark, sf, "part").select(old.cast("long").alias("old_id"), new.cast("long").alias("new_id"))
    return V.restructured(spark, pairs, pairs.where("old_id % 11 = 0").select("old_id"))


@query("""
WITH p AS (SELECT DISTINCT split_part(c_name, '#', 1) || '#0*' || c_custkey || '$' AS id, c_custkey FROM customer)
SELECT p.id AS left_id, c.c_custkey AS right_id FROM p JOIN customer c ON p.c_custkey = c.c_custkey
UNION ALL SELECT '^c.*0[12]$', c_custkey FROM customer WHERE regexp_matches(c_name, '^[Cc].*0[12]$')""")
def match_regex_many(spark, sf):
    """One pattern for every customer, one that has no trigram, and one that is no pattern, against all customers' names."""
    c = table(spark, sf, "customer")
    own = F.concat(F.split("c_name", "#")[0], F.lit("#0*"), "c_custkey", F.lit("$"))
    other = spark.createDataFrame([("^c.*0[12]$", "(?i)^c.*0[12]$"), ("a(", "a(")], "id string, value string")
    return M.match(c.select(own.alias("id"), own.alias("value")).unionByName(other), c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value")), "regex")


@query("SELECT 'P' || (p_partkey % 3) AS id, '(' || (p_partkey % 3) AS value FROM part WHERE p_partkey % 2 = 0")
def quarantined_patterns(spark, sf):
    """Values that are no patterns, of those that are used as patterns."""
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey") % 3).alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), F.col("p_partkey") % 3)).otherwise(F.concat(F.lit("("), "p_partkey", F.lit(")"))).alias("value"))
    return M.invalid_patterns(p)


@query("""
SELECT c_name, last_value(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_name) AS segment FROM customer""")
def ffill_text_order(spark, sf):
    """Filled in the order of names, within nations."""
    c = table(spark, sf, "customer").select("c_name", "c_nationkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("segment"))
    return O.forward_fill(c, "segment", "c_name", ["c_nationkey"]).select("c_name", "segment")


@query("""
SELECT event_id, lag(user_id) OVER (ORDER BY ts, event_id) AS before, lead(user_id) OVER (ORDER BY ts, event_id) AS after FROM events""")
def neighbours_by_time(spark, sf):
    """The users of the events just before and after each one, in the order of time."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return O.neighbours(e, ["user_id"], ["ts", "event_id"]).select("event_id", F.col("prev.user_id").alias("before"), F.col("next.user_id").alias("after"))


_TREE = """
WITH leaf AS (SELECT year(o_orderdate) || '' AS a, year(o_orderdate) || '-' || month(o_orderdate) AS b, o_custkey || '@' || year(o_orderdate) || '-' || month(o_orderdate) AS c, o_orderkey AS d, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
"""


def _tree(spark, sf):
    """Years, months, customers within a month and their orders, with what was ordered."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))  # noqa: E741
    year = F.year("o_orderdate").cast("string")
    month = F.concat(year, F.lit("-"), F.month("o_orderdate"))
    path = F.array(year, month, F.concat(F.col("o_custkey").cast("string"), F.lit("@"), month), F.concat(F.lit("O"), "o_orderkey"))
    each = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(path.alias("path"), "n")
    inner = each.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.slice("path", F.lit(1), i))).alias("path"), F.lit(None).cast("long").alias("n")).distinct()
    return each.unionByName(inner).withColumn("node_id", F.element_at("path", -1))


@query(_TREE + """
SELECT a AS node_id, 1 AS depth, sum(CAST(l_quantity AS BIGINT)) AS total FROM leaf GROUP BY a UNION ALL SELECT b, 2, sum(CAST(l_quantity AS BIGINT)) FROM leaf GROUP BY b
UNION ALL SELECT c, 3, sum(CAST(l_quantity AS BIGINT)) FROM leaf GROUP BY c UNION ALL SELECT 'O' || d, 4, sum(CAST(l_quantity AS BIGINT)) FROM leaf GROUP BY d""")
def interval_roll_up(spark, sf):
    """What was ordered below each node, by running sums over a pre-order."""
    return I.intervals(_tree(spark, sf), amount="n").select("node_id", "depth", "total")


@query(_TREE + ", n AS (SELECT DISTINCT a, b, c, d FROM leaf)" + """
SELECT a AS node_id, count(DISTINCT b) + count(DISTINCT c) + count(DISTINCT d) AS n_below FROM n GROUP BY a UNION ALL SELECT b, count(DISTINCT c) + count(DISTINCT d) FROM n GROUP BY b
UNION ALL SELECT c, count(DISTINCT d) FROM n GROUP BY c UNION ALL SELECT 'O' || d, 0 FROM n GROUP BY d""")
def subtree_sizes(spark, sf):
    """The number of nodes below each node: the width of its interval."""
    return I.intervals(_tree(spark, sf)).select("node_id", (F.col("last") - F.col("pre")).alias("n_below"))


def _stored(spark, sf, mode):
    """Every second customer written first, then all of them over it; the table and what became of each row."""
    c, root = table(spark, sf, "customer"), f"{G.shared_root(spark)}/taxolink-{uuid.uuid4().hex}/store"
    props = lambda segment, **more: F.create_map(F.lit("segment"), segment, *(F.lit(x) for kv in more.items() for x in kv))
    old = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("path"), props(F.lit("old"), mine="kept").alias("props"))
    new = c.select(F.col("c_name").alias("path"), props(F.col("c_mktsegment")).alias("props"))
    S.merge(spark, old, root, mode, parts=8)
    results = S.merge(spark, new, root, mode)
    return S.read_table(spark, root).join(results, "path").select("path", F.col("props")["segment"].alias("segment"), F.col("props")["mine"].alias("mine"), "status")


def _stored_sql(segment, mine, status):
    return f"SELECT c_name AS path, CASE WHEN c_custkey % 2 = 0 THEN {segment} ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN {mine} END AS mine, CASE WHEN c_custkey % 2 = 0 THEN '{status}' ELSE 'created' END AS status FROM customer"


@query(_stored_sql("'old'", "'kept'", "skipped"))
def store_skip(spark, sf):
    return _stored(spark, sf, "skip")


@query(_stored_sql("c_mktsegment", "NULL", "replaced"))
def store_replace(spark, sf):
    return _stored(spark, sf, "replace")


@query(_stored_sql("'old'", "'kept'", "error"))
def store_error(spark, sf):
    return _stored(spark, sf, "error")


@query(_stored_sql("c_mktsegment", "'kept'", "merged"))
def store_merge(spark, sf):
    return _stored(spark, sf, "merge")


@query("SELECT 'n' || c_nationkey || '/' || c_name || '.md' AS path, '# ' || c_mktsegment || chr(10) AS content FROM customer")
def committed_files(spark, sf):
    """Every customer as a note file, written in two phases and read back, both by tasks."""
    root = f"{G.shared_root(spark)}/taxolink-{uuid.uuid4().hex}/files"
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "c_mktsegment", F.lit("\n")).alias("content"))
    NF.write_files(c.repartition(NF.tasks(c.count())), root)
    return NF.read_files(spark, root).select("path", F.decode("content", "utf-8").alias("content"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('month', ts), event_id) AS k FROM events) WHERE k = 1")
def ingest_by_state(spark, sf):
    """Events arrive in files by month, one month a batch; the first of each user is kept, known users are state."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    base = f"{G.shared_root(spark)}/taxolink-{uuid.uuid4().hex}"
    months = [r["m"] for r in e.select(F.date_trunc("month", "ts").alias("m")).distinct().orderBy("m").collect()]  # a batch for each
    for m in months:
        e.where(F.date_trunc("month", "ts") == F.lit(m)).write.mode("append").parquet(f"{base}/in")
        K.ingest_by_state(J.file_stream(spark, f"{base}/in", e.schema), f"{base}/out", "user_id", ["event_id"], f"{base}/checkpoint").awaitTermination()
    return K.ingested_rows(spark, f"{base}/out", e.schema).select("event_id", "user_id", "event_type")


_VALUE = "CASE l_partkey % 6 WHEN 1 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'none' ELSE 'AC-' || l_suppkey END WHEN 2 THEN 'https://x/' || l_suppkey ELSE 'w' || l_suppkey END"
_FORMS = f"""
, v AS (SELECT l_orderkey AS tbl, 'Part ' || l_partkey % 6 AS col, {_VALUE} AS val FROM lineitem),
share AS (SELECT tbl, col, avg(CAST(regexp_matches(val, '^AC-[0-9]+$') AS INTEGER)) AS a, avg(CAST(regexp_matches(val, '^https://') AS INTEGER)) AS b FROM v GROUP BY ALL),
form AS (SELECT tbl, col, CASE WHEN a >= 0.7 THEN 'control_id' ELSE 'url' END AS pattern FROM share WHERE a >= 0.7 OR b >= 0.7)
"""


def _forms(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.concat(F.lit("Part "), F.col("l_partkey") % 6).alias("col"), F.col("l_linenumber").alias("row"), F.expr(_VALUE).alias("val"))
    return P.fingerprints(TQ._catalog(spark, sf), P.table_patterns(li))


@query(TQ._PRINTS + _FORMS + """
SELECT f.tbl, coalesce(string_agg(col || '=' || pattern, '|' ORDER BY col), '') AS patterns FROM f LEFT JOIN form ON form.tbl = f.tbl GROUP BY f.tbl""")
def fingerprint_patterns(spark, sf):
    """What forms of values the fingerprint of each order's table holds."""
    return _forms(spark, sf).select("tbl", F.array_join(F.transform("patterns", lambda p: F.concat(p["col"], F.lit("="), p["pattern"])), "|").alias("patterns"))


@query(TQ._PRINTS + _FORMS + """
, saved AS (SELECT * FROM (VALUES ('ids', ['Part 1', 'Part 9'], 'Part 1', 'control_id'), ('web', ['Part 2', 'Part 8'], 'Link', 'url')) AS t(config, names, col, pattern)),
s AS (SELECT f.tbl, config, len(list_intersect(f.names, saved.names)) / greatest(len(f.names), 2) AS e, abs(len(f.names) - 2) AS gap, coalesce(bool_or(form.col = saved.col OR form.pattern = saved.pattern), false) AS shared
  FROM f CROSS JOIN saved LEFT JOIN form ON form.tbl = f.tbl GROUP BY f.tbl, config, f.names, saved.names),
r AS (SELECT tbl, config, CASE WHEN e > 0.8 THEN 40 WHEN e > 0.5 THEN 25 ELSE 0 END + CASE WHEN gap = 0 THEN 10 WHEN gap <= 2 THEN 5 ELSE 0 END + CASE WHEN shared THEN 15 ELSE 0 END + 10 AS score FROM s)
SELECT * FROM r WHERE score > 30""")
def config_match_patterns(spark, sf):
    """Configs that have hardly a name in common with a table, but forms of values: without those no pair has more than 30 points."""
    saved = spark.createDataFrame([("ids", ["Part 1", "Part 9"], [("Part 1", "control_id")]), ("web", ["Part 2", "Part 8"], [("Link", "url")])], "config string, names array<string>, patterns array<struct<col:string,pattern:string>>")
    normal = F.transform("names", lambda n: F.regexp_replace(F.trim(F.lower(n)), "[^a-z0-9]", "_"))
    # The types are equal and both configs were used a day ago, which is 10 points for every pair.
    configs = saved.select("config", F.to_date(F.lit("2024-01-31")).alias("last_used"), "names", normal.alias("normal"), F.size("names").alias("n_columns"), F.lit("-").alias("source_type"), F.lit(None).cast("string").alias("file_pattern"), "patterns")
    tables = _forms(spark, sf).withColumn("source_type", F.lit("-"))
    return P.match_configs(tables, configs, F.to_date(F.lit("2024-02-01")))


def _mixed(spark, sf):
    """Orders as JSON lines whose total is a number, a text, an object or missing, and some lines that are no JSON."""
    out = f"{G.shared_root(spark)}/taxolink-{uuid.uuid4().hex}/mixed"
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    total = F.when(key % 4 == 0, F.concat(F.lit(', "total": '), cents)).when(key % 4 == 1, F.concat(F.lit(', "total": "'), cents, F.lit(' cents"'))).when(key % 4 == 2, F.concat(F.lit(', "total": {"cents": '), cents, F.lit("}"))).otherwise("")
    line = F.when(key % 50 == 7, F.concat(F.lit("{broken "), key)).otherwise(F.concat(F.lit('{"id": '), key, total, F.lit("}")))
    table(spark, sf, "orders").select(line.alias("value")).write.text(out)
    return VR.read_records(spark, out)


_MIXED = "WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) "


@query(_MIXED + """SELECT k AS id, CASE k % 4 WHEN 0 THEN c || '' WHEN 1 THEN c || ' cents' WHEN 2 THEN '{"cents":' || c || '}' END AS total FROM o WHERE k % 50 <> 7""")
def mixed_records(spark, sf):
    """All values of a field whose type differs between records."""
    return VR.fields(_mixed(spark, sf)[0], {"id": "id", "total": "total"}).select(F.col("id").cast("long").alias("id"), "total")


@query(_MIXED + "SELECT CASE k % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'OBJECT<cents: BIGINT>' ELSE 'missing' END AS shape, count(*) AS n FROM o WHERE k % 50 <> 7 GROUP BY 1 UNION ALL SELECT 'no JSON', count(*) FROM o WHERE k % 50 = 7")
def record_shapes(spark, sf):
    good, bad = _mixed(spark, sf)
    return VR.shapes(good, "total").unionByName(bad.select(F.lit("no JSON").alias("shape"), F.lit(1).alias("one")).groupBy("shape").agg(F.count("*").alias("n")))


#: Bytes of padding in all files of ``csv_blocks`` together.
_FILL = 60_000_000


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, year(o_orderdate) AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS source_row FROM orders")
def csv_blocks(spark, sf):
    """Files of several blocks, one for each year: row numbers go on from block to block.

    Lines are filled up to about ``_FILL`` bytes in all, so that small tables have several blocks, too; larger ones have them by their rows.
    """
    out = f"{G.shared_root(spark)}/taxolink-{uuid.uuid4().hex}/blocks"
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), "year", F.lit(","), F.repeat(F.lit("x"), F.lit(_FILL // max(1, o.count()))))
    head = o.select(F.lit(-1).cast("long").alias("o_orderkey"), "year", F.lit("id,of,pad").alias("value")).distinct()
    rows = head.unionByName(o.select("o_orderkey", "year", line.alias("value"))).repartition("year").sortWithinPartitions("year", "o_orderkey")
    rows.select("year", "value").write.partitionBy("year").text(out)
    return R.read_csv(spark, out, provenance=True, multi_line=False).select("id", F.col("of").cast("int").alias("year"), "source_row")
