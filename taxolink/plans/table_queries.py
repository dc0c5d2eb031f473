"""Ordered operators, deduplication, tags, names, paths, transforms and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolink.functions import names as N
from taxolink.functions import text as T
from taxolink.functions import transforms as X
from taxolink.operators import aggregate as A
from taxolink.operators import graph as G
from taxolink.operators import ordered as O
from taxolink.operators import profile as P
from taxolink.plans.registry import query, table


def _rows(spark, sf):
    """Customers in order with their region and nation; a dense row number is made from the key."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("c_custkey", "n_name", "r_name", (F.col("n_regionkey").cast("long") * 10**12 + F.col("n_nationkey").cast("long") * 10**9 + F.col("c_custkey")).alias("source_row"))


@query("SELECT o_orderkey, o_orderpriority AS priority FROM orders")
def ffill_global(spark, sf):
    """Priorities blanked where the order key before it (in steps of one) has the same, then filled."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    before = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("priority").alias("was"))
    blanked = o.join(before, "o_orderkey", "left").withColumn("priority", F.when(~F.col("priority").eqNullSafe(F.col("was")), F.col("priority"))).drop("was")
    return O.forward_fill(blanked, "priority", "o_orderkey")


@query("SELECT c_custkey, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ffill_hier(spark, sf):
    rows = _rows(spark, sf)
    first = rows.groupBy("r_name").agg(F.min("source_row").alias("_r"))
    second = rows.groupBy("r_name", "n_name").agg(F.min("source_row").alias("_n"))
    blanked = rows.join(first, "r_name").join(second, ["r_name", "n_name"]).select(
        "c_custkey", F.when(F.col("source_row") == F.col("_r"), F.col("r_name")).otherwise("").alias("r_name"), F.when(F.col("source_row") == F.col("_n"), F.col("n_name")).otherwise("").alias("n_name"), "source_row"
    )
    return O.hierarchical_fill(blanked, ["r_name", "n_name"], "source_row").select("c_custkey", "r_name", "n_name")


@query("""
SELECT 'C' || c_custkey AS control, c_name AS title, 'N' || n_nationkey AS head_control, n_name AS head_title, 'about ' || n_name AS head_text
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def header_pairs(spark, sf):
    """Every nation as a header of two rows before its customers."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    at = lambda nation, place: (F.col(nation).cast("long") * 10**10 + place).alias("source_row")
    head = n.select(F.concat(F.lit("N"), "n_nationkey").alias("control"), F.col("n_name").alias("title"), at("n_nationkey", 0))
    text = n.select(F.lit(None).cast("string").alias("control"), F.concat(F.lit("about "), "n_name").alias("title"), at("n_nationkey", 1))
    rows = c.select(F.concat(F.lit("C"), "c_custkey").alias("control"), F.col("c_name").alias("title"), at("c_nationkey", F.lit(2) + F.col("c_custkey")))
    return O.header_pairs(head.unionByName(text).unionByName(rows), "control", "title", "source_row").drop("source_row")


@query("SELECT c_custkey, n_name AS control_title FROM customer JOIN nation ON c_nationkey = n_nationkey")
def cond_carry(spark, sf):
    """Nations as rows with a blank sub-id before their customers; the title is carried down."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    top = n.select(F.lit("").alias("sub"), F.col("n_name").alias("title"), F.lit(None).cast("long").alias("c_custkey"), (F.col("n_nationkey").cast("long") * 10**10).alias("source_row"))
    low = c.select(F.col("c_custkey").cast("string").alias("sub"), F.col("c_name").alias("title"), "c_custkey", (F.col("c_nationkey").cast("long") * 10**10 + 1 + F.col("c_custkey")).alias("source_row"))
    got = O.conditional_carry(top.unionByName(low), "title", "sub", "control_title", "source_row")
    return got.where("sub <> ''").select("c_custkey", "control_title")


_TOTAL = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"
_DEDUP = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {0}) AS k FROM lineitem) WHERE k = 1"""


def _lines(spark, sf, last):
    got = O.keep_first(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _TOTAL.split(", "), last=last)
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"))


@query(_DEDUP.format(_TOTAL))
def keep_first(spark, sf):
    return _lines(spark, sf, False)


@query(_DEDUP.format(", ".join(f"{c} DESC" for c in _TOTAL.split(", "))))
def keep_last(spark, sf):
    return _lines(spark, sf, True)


@query("""
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 3 GROUP BY user_id""")
def first_samples(spark, sf):
    got = O.samples(table(spark, sf, "events"), ["user_id"], "event_type", "event_id", 3)
    return got.select("user_id", F.array_join("samples", ",").alias("samples"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_rows(spark, sf):
    return O.head(table(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 20).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT user_id, string_agg(DISTINCT '#cri/' || event_type, ' ' ORDER BY '#cri/' || event_type) AS tags FROM events GROUP BY user_id")
def tag_agg(spark, sf):
    e = table(spark, sf, "events").select("user_id", T.prefix_tags(F.concat(F.lit("#"), "event_type", F.lit("  #"), "event_type")).alias("t"))
    return A.tags(e, "user_id", ["t"])


@query("""
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS links FROM events
WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY user_id""")
def list_merge_flat(spark, sf):
    e = table(spark, sf, "events")
    lists = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.collect_set("event_type").alias("links"))
    return A.merge_lists(lists(0), lists(1), ["user_id"]).select("user_id", F.array_join("links", ",").alias("links"))


@query("""
SELECT user_id, string_agg(event_type, ',' ORDER BY event_id % 2, event_type) AS links FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY user_id""")
def list_merge_nested(spark, sf):
    e = table(spark, sf, "events")
    lists = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.array_sort(F.collect_list("event_type")).alias("links"))
    return A.merge_lists(lists(0), lists(1), ["user_id"], nested=True).select("user_id", F.array_join(F.transform("links", lambda x: x["link"]), ",").alias("links"))


@query("""
WITH p AS (SELECT r_name AS a, n_name AS b, s_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT '' AS folder, NULL AS parent, a AS child FROM p UNION ALL SELECT a, '', b FROM p UNION ALL SELECT a || '/' || b, a, c FROM p)
SELECT folder, parent, string_agg(DISTINCT child, ',' ORDER BY child) AS children FROM e GROUP BY folder, parent""")
def folder_children(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    got = A.folder_children(s.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("path")))
    return got.select("folder", "parent", F.array_join("children", ",").alias("children"))


def _ids(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.format_string("R%d.N%02d-%d(3)", "n_regionkey", "n_nationkey", "c_custkey").alias("code"))


_ID = """
WITH i AS (SELECT c_custkey, 'R' || n_regionkey AS a, 'R' || n_regionkey || '.N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS b, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
j AS (SELECT *, b || '-' || c_custkey AS c, b || '-' || c_custkey || '(3)' AS d FROM i)
"""


@query(_ID + "SELECT c_custkey, concat_ws('|', a, b, c, d) AS path FROM j")
def path_cumulative(spark, sf):
    return _ids(spark, sf).select("c_custkey", F.array_join(T.cumulative_path(F.col("code")), "|").alias("path"))


@query(_ID + "SELECT c_custkey, concat_ws('|', a, d, b, d, c, d) AS path FROM j")
def path_legacy(spark, sf):
    return _ids(spark, sf).select("c_custkey", F.array_join(T.cumulative_path(F.col("code"), legacy=True), "|").alias("path"))


@query(_ID + "SELECT c_custkey, concat_ws('|', a, n, c_custkey || '(3)') AS path FROM j")
def path_split(spark, sf):
    return _ids(spark, sf).select("c_custkey", F.array_join(T.split_path(F.col("code")), "|").alias("path"))


@query(_ID + "SELECT d AS node_id, a AS ancestor, 3 AS distance FROM j UNION ALL SELECT d, b, 2 FROM j UNION ALL SELECT d, c, 1 FROM j UNION ALL SELECT d, d, 0 FROM j")
def closure(spark, sf):
    return G.closure(_ids(spark, sf).select(F.col("code").alias("node_id"), T.cumulative_path(F.col("code")).alias("path")))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'N' || c_nationkey || '.' || c_custkey WHEN c_custkey % 5 <> 0 THEN 'N' || c_nationkey END AS id FROM customer""")
def deepest_id(spark, sf):
    c = table(spark, sf, "customer")
    top = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("Nation (N"), "c_nationkey", F.lit("): text")))
    low = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("N"), "c_nationkey", F.lit("."), "c_custkey", F.lit(": more")))
    return c.select("c_custkey", T.deepest_id([top, low]).alias("id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS label FROM customer")
def lowest_label(spark, sf):
    c = table(spark, sf, "customer")
    low = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name")).otherwise(" ")
    return c.select("c_custkey", T.lowest_label([low, F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))]).alias("label"))


@query("SELECT c_custkey AS customer_key, c_name AS customer_name, c_nationkey AS nation_key, c_mktsegment AS market_segment FROM customer")
def candidate_columns(spark, sf):
    c = table(spark, sf, "customer")
    messy = c.select(F.col(N.pick(c.columns, "custkey", "c_custkey")).alias(" Customer  Key "), F.col("c_name").alias("Customer / Name"), F.col("c_nationkey").alias("Nation\nKey"), F.col("c_mktsegment").alias("Market Segment"))
    return N.rename(N.rename(messy, N.one_line), N.sanitize)


@query("""
SELECT p_partkey, upper(p_name) AS upper, 'P-' || p_name || '!' AS wrapped, replace(p_type, ' ', '_') AS replaced, regexp_extract(p_brand, '(\\d+)', 1) AS digits,
  array_to_string(list_distinct(string_split(p_type, ' ')), '+') AS parts, string_split(p_type, ' ')[1] AS first, string_split(p_type, ' ')[-1] AS last,
  CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, p_partkey || ':' || p_name AS made, CAST(p_size AS DOUBLE) AS num FROM part""")
def trf_text(spark, sf):
    p = table(spark, sf, "part").withColumn("parts", X.TRANSFORMS["split"](F.col("p_type"), " ")).withColumn("size_text", F.col("p_size").cast("string"))
    rules = [
        ("upper", "p_name", "uppercase", ()), ("pre", "p_name", "prefix", ("P-",)), ("replaced", "p_type", "replace", (" ", "_")), ("digits", "p_brand", "regex_extract", (r"(\d+)", 1)),
        ("uniq", "parts", "unique", ()), ("first", "parts", "first", ()), ("last", "parts", "last", ()), ("size", "size_text", "if_matches", (r"^(2[6-9]|[3-9]\d|\d{3,})$", "big", "small")),
        ("made", "p_name", "template", ("{{p_partkey}}:{{p_name}}",)), ("num", "size_text", "to_number", ()),
    ]
    got = X.apply(p, rules)
    return X.apply(got, [("wrapped", "pre", "suffix", ("!",)), ("parts", "uniq", "join", ("+",))]).select("p_partkey", "upper", "wrapped", "replaced", "digits", "parts", "first", "last", "size", "made", "num")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE event_type END AS filled, event_id % 2 = 0 AS flag, CAST(ts AS DATE) AS day,
  '#ev/' || lower(event_type) || ' #ev/x-y' AS tags, '[[' || event_type || ']] [[b c]]' AS links, CAST(user_id AS VARCHAR) AS either, event_type || '|b c' AS mapped FROM events""")
def trf_values(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")).alias("t"), F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("no").alias("b"), F.date_format("ts", "dd/MM/yyyy").alias("d"),
        F.concat("event_type", F.lit(", x y")).alias("tg"), F.concat("event_type", F.lit(", b c")).alias("l"), F.lit("").alias("e"), F.col("user_id").cast("string").alias("u"),
    )
    rules = [("filled", "t", "if_empty", ("none",)), ("flag", "b", "to_boolean", ()), ("day", "d", "to_date", ("dd/MM/yyyy",)), ("tags", "tg", "to_tags", ("ev",)), ("links", "l", "to_wikilinks", ()), ("either", "e", "coalesce", ("u",)), ("items", "l", "split", ())]
    got = X.apply(e, rules)
    return got.select("event_id", "filled", "flag", "day", F.array_join("tags", " ").alias("tags"), F.array_join("links", " ").alias("links"), "either", F.array_join(X.TRANSFORMS["filter"](X.TRANSFORMS["map"](F.col("items"), "trim"), "."), "|").alias("mapped"))


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def trf_lookup(spark, sf):
    return X.lookup(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation").where("n_nationkey < 20"), "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("""
WITH c AS (SELECT 0 AS pos, 'c_custkey' AS col, CAST(c_custkey AS VARCHAR) AS v, c_custkey AS r FROM customer UNION ALL SELECT 1, 'c_name', c_name, c_custkey FROM customer
  UNION ALL SELECT 2, 'c_acctbal', CAST(round(c_acctbal) AS BIGINT)::VARCHAR, c_custkey FROM customer UNION ALL SELECT 3, 'flag', CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END, c_custkey FROM customer
  UNION ALL SELECT 4, 'list', CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment || ',' || c_nationkey END, c_custkey FROM customer)
SELECT pos, col, CASE pos WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' ELSE 'array' END AS type, count(v) < count(*) AS has_empty, count(DISTINCT v) AS n_distinct,
  (SELECT string_agg(v, '|' ORDER BY r) FROM (SELECT v, r FROM c d WHERE d.pos = c.pos AND v IS NOT NULL ORDER BY r LIMIT 5)) AS samples FROM c GROUP BY pos, col""")
def profile_columns(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row"), F.col("c_custkey").cast("string"), "c_name", F.round("c_acctbal").cast("long").cast("string").alias("c_acctbal"),
        F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no").alias("flag"), F.when(F.col("c_custkey") % 10 != 0, F.concat_ws(",", "c_mktsegment", "c_nationkey")).otherwise("").alias("list"),
    )
    return P.profile(c, "row").select("pos", "col", "type", "has_empty", "n_distinct", F.array_join("samples", "|").alias("samples"))


_FIRST = """
WITH f AS (SELECT c_custkey AS r, 'AC-' || c_nationkey AS control, c_nationkey || '.' || c_custkey AS cis, 'https://x/' || c_custkey AS link, c_mktsegment || ', ' || c_name AS list, c_name FROM customer ORDER BY c_custkey LIMIT 20),
v AS (SELECT 0 AS pos, 'control' AS col, r, control AS x FROM f UNION ALL SELECT 1, 'cis', r, cis FROM f UNION ALL SELECT 2, 'link', r, link FROM f UNION ALL SELECT 3, 'list', r, list FROM f UNION ALL SELECT 4, 'c_name', r, c_name FROM f),
p AS (SELECT * FROM (VALUES (1, 'control_id', '(?i)^[A-Z]{2,3}-[0-9]+([(][0-9]+[)])?$'), (2, 'cis_control', '^[0-9]+([.][0-9]+)+$'), (3, 'uuid', '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-'), (4, 'url', '(?i)^https?://'), (5, 'comma_list', '^[^,]+,[^,]+')) AS t(k, pattern, form)),
hit AS (SELECT pos, col, k, pattern, string_agg(x, '|' ORDER BY r) FILTER (regexp_matches(x, form)) AS xs FROM v, p GROUP BY ALL HAVING avg(CAST(regexp_matches(x, form) AS INTEGER)) >= 0.7)
SELECT pos, col, arg_min(pattern, k) AS pattern, array_to_string(string_split(arg_min(xs, k), '|')[1:3], '|') AS examples FROM hit GROUP BY pos, col"""


@query(_FIRST)
def column_patterns(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row"), F.concat(F.lit("AC-"), "c_nationkey").alias("control"), F.concat_ws(".", "c_nationkey", "c_custkey").alias("cis"), F.concat(F.lit("https://x/"), "c_custkey").alias("link"),
        F.concat_ws(", ", "c_mktsegment", "c_name").alias("list"), "c_name",
    )
    return P.patterns(c, "row").select("pos", "col", "pattern", F.array_join("examples", "|").alias("examples"))


def _catalog(spark, sf):
    """A catalog of tables found in the data: one for each order, its columns named by its lines' parts, its file by the order's date and status."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    name = F.concat(F.lit("Part "), F.col("l_partkey") % 6)
    cols = li.select(F.col("l_orderkey").alias("o_orderkey"), name.alias("name")).distinct()
    return cols.join(o, "o_orderkey").select(
        F.col("o_orderkey").alias("tbl"), F.col("name").alias("pos"), "name", F.col("o_orderstatus").alias("source_type"), F.concat(F.col("o_orderpriority"), F.lit("_v2-"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv")).alias("file_name")
    )


_PRINTS = """
WITH cols AS (SELECT DISTINCT l_orderkey AS tbl, 'Part ' || l_partkey % 6 AS name FROM lineitem),
f AS (SELECT tbl, o_orderstatus AS source_type, list(name ORDER BY name) AS names, regexp_replace(regexp_replace(lower(any_value(o_orderpriority) || '_v2-' || strftime(any_value(o_orderdate), '%Y%m')), '[_\\-\\s]+', '*', 'g'), '[0-9]+', '*', 'g') AS file_pattern
  FROM cols JOIN orders ON tbl = o_orderkey GROUP BY tbl, o_orderstatus)
"""


@query(_PRINTS + "SELECT tbl, source_type, len(names) AS n_columns, array_to_string(names, '|') AS names, replace(lower(array_to_string(names, '|')), ' ', '_') AS normal, file_pattern FROM f")
def fingerprint(spark, sf):
    return P.fingerprints(_catalog(spark, sf)).select("tbl", "source_type", "n_columns", F.array_join("names", "|").alias("names"), F.array_join("normal", "|").alias("normal"), "file_pattern")


_CONFIGS = [("a", "2024-01-30", ["Part 1", "Part 2", "Part 3"], "O", "1*urgent*v***"), ("b", "2023-01-01", ["PART 4", "part 5", "Part 0", "Part 1"], "F", "x*y"), ("c", "2024-01-31", ["Part 2", "Part 3"], "P", None)]


@query(_PRINTS + f"""
, g AS (SELECT *, list_transform(names, lambda n: regexp_replace(trim(lower(n)), '[^a-z0-9]', '_', 'g')) AS normal, len(names) AS n FROM f),
c AS (SELECT *, list_transform(names, lambda n: regexp_replace(trim(lower(n)), '[^a-z0-9]', '_', 'g')) AS normal, len(names) AS n FROM (VALUES
  {", ".join(f"('{c}', DATE '{d}', {n}, '{t}', {'NULL' if p is None else repr(p)})" for c, d, n, t, p in _CONFIGS)}) AS v(config, last_used, names, source_type, file_pattern)),
s AS (SELECT g.tbl, c.config, len(list_intersect(g.names, c.names)) / greatest(g.n, c.n) AS e, len(list_intersect(g.normal, c.normal)) / greatest(g.n, c.n) AS m, abs(g.n - c.n) AS gap, g.source_type = c.source_type AS t,
  len(list_filter(list_intersect(string_split(g.file_pattern, '*'), string_split(c.file_pattern, '*')), lambda x: x <> '')) > 0 AS p, last_used > DATE '2024-02-01' - 7 AS u FROM g, c),
r AS (SELECT tbl, config, CASE WHEN e > 0.8 THEN 40 WHEN e > 0.5 THEN 25 ELSE 0 END + CASE WHEN m > e THEN 15 ELSE 0 END + CASE WHEN gap = 0 THEN 10 WHEN gap <= 2 THEN 5 ELSE 0 END
  + CASE WHEN t THEN 5 ELSE 0 END + CASE WHEN p THEN 10 ELSE 0 END + CASE WHEN u THEN 5 ELSE 0 END AS score FROM s)
SELECT * FROM r WHERE score > 30""")
def config_match(spark, sf):
    """The catalog of orders against saved configs."""
    saved = spark.createDataFrame([(c, d, n, t, p) for c, d, n, t, p in _CONFIGS], "config string, last_used string, names array<string>, source_type string, file_pattern string")
    normal = F.transform("names", lambda n: F.regexp_replace(F.trim(F.lower(n)), "[^a-z0-9]", "_"))
    configs = saved.select("config", F.to_date("last_used").alias("last_used"), "names", normal.alias("normal"), F.size("names").alias("n_columns"), "source_type", "file_pattern")
    return P.match_configs(P.fingerprints(_catalog(spark, sf)), configs, F.to_date(F.lit("2024-02-01")))


@query("""
WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT (SELECT count(*) FROM c) AS notes, (SELECT count(DISTINCT n_regionkey) + count(DISTINCT (n_regionkey, n_name)) + 1 FROM c) AS folders, (SELECT 2 * count(*) FROM c) AS links""")
def estimate_output(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_name", F.concat_ws(";", "c_name", "c_mktsegment").alias("related"))
    return P.estimate(c, ["n_regionkey", "n_name"], ["related"])
