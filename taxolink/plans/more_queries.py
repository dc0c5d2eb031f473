"""Cleaning, paths, readers, schemas, results of a run, histories and nested forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolink.functions import names as N
from taxolink.functions import text as T
from taxolink.operators import aggregate as A
from taxolink.operators import graph as G
from taxolink.operators import joins as J
from taxolink.operators import links as L
from taxolink.operators import match as M
from taxolink.operators import notes as NT
from taxolink.operators import profile as P
from taxolink.operators import versions as V
from taxolink.plans import frameworks as FW
from taxolink.plans.graph_queries import _shared
from taxolink.plans.registry import query, table
from taxolink.sources import note_files as NF
from taxolink.sources import readers as R
from taxolink.sources import sinks as S


@query("SELECT c_custkey AS id, c_name || '''s \"x\"' AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def clean_text(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit("’s “x”\t")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit("  "))).otherwise("  ").alias("segment"))
    return FW.clean_table(c).withColumn("segment", T.blank_to_null(F.col("segment")))


@query("""
SELECT c_custkey AS id, '|-' || chr(10) || '  ' || c_name || chr(10) || '  ' || c_mktsegment AS block, '> ' || c_name || chr(10) || '> ' || c_mktsegment AS quote, '- ' || c_name || chr(10) || '- ' || c_mktsegment AS items,
  '## Name' || chr(10) || c_name || chr(10) || chr(10) || '## Segment' || chr(10) || c_mktsegment AS body FROM customer""")
def body_text(spark, sf):
    two = F.concat_ws("\n", "c_name", "c_mktsegment")
    body = T.sections([("Name", F.col("c_name")), ("None", F.lit(" ")), ("Segment", F.col("c_mktsegment"))])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.yaml_text(two).alias("block"), T.body(two, "quote").alias("quote"), T.body(two, "list").alias("items"), body.alias("body"))


@query("""
SELECT c_custkey AS id, 'v/a-b/' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '/' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'row-' || c_custkey END || '.md' AS path,
  'v/a-b' || CASE WHEN c_custkey % 2 = 0 THEN '/' || c_mktsegment ELSE '' END AS parent, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'row-' || c_custkey END AS base FROM customer""")
def note_paths(spark, sf):
    c = table(spark, sf, "customer").withColumn("seg", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(".."), "c_mktsegment", F.lit(" "))))
    path = T.note_path("v", [F.lit("a/b"), F.col("seg")], [F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(".MD")))], F.col("c_custkey"))
    got = c.select(F.col("c_custkey").alias("id"), path.alias("path"))
    return got.select("id", "path", T.parent_path(F.col("path")).alias("parent"), T.base_name(F.col("path")).alias("base"))


@query("""
SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'BU' WHEN 'MACHINERY' THEN 'MA' END AS code, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS last FROM customer""")
def map_codes(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), T.code_map(F.col("c_mktsegment"), {"Building": "BU", "Machinery": "MA"}, lower=True).alias("code"), T.last_level(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x / "), "c_name")).otherwise(F.col("c_name"))).alias("last"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN CAST(16 AS DOUBLE) END AS num, p_size % 2 = 0 AS flag, p_brand || '|' || p_type AS items FROM part""")
def format_values(spark, sf):
    p = table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, "0x10").otherwise("1d")
    return p.select(F.col("p_partkey").alias("id"), T.to_number(raw).alias("num"), T.to_boolean(F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("maybe")).alias("flag"), F.array_join(T.to_list(F.concat_ws("; ", "p_brand", "p_type")), "|").alias("items"))


@query("""
SELECT p_partkey AS id, p_brand AS first, p_type AS last, p_brand || '+' || p_type AS joined, CASE WHEN p_size > 25 THEN p_name ELSE 'none' END AS filled FROM part""")
def handle_values(spark, sf):
    arr, maybe = F.array("p_brand", "p_type"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.handle_array(arr, "first").alias("first"), T.handle_array(arr, "last").alias("last"), T.handle_array(arr, "join", "+").alias("joined"), T.handle_empty(maybe, "default", "none").alias("filled"))


@query("SELECT s_suppkey AS \"supplierKey\", s_name AS \"supplierName\", round(s_acctbal, 2) AS \"accountBalance\" FROM supplier")
def naming_style(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier key"), F.col("s_name").alias("Supplier_Name"), F.round("s_acctbal", 2).alias("ACCOUNT-balance"))
    return N.rename(s, "camelCase")


@query("""
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def nested_frontmatter(spark, sf):
    keys = {"c_name": "meta.name", "c_mktsegment": "meta.segment", "c_nationkey": "nation"}
    got = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), NT.nested(keys, "dot_to_nest").alias("f"), NT.extras(["c_name", "c_nationkey"], ["c_name"], N.key).alias("x"))
    return got.select("id", F.col("f.meta.name").alias("name"), F.col("f.meta.segment").alias("segment"), F.col("x")["c_nationkey"].alias("nation"))


@query("""
SELECT user_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS tags FROM (SELECT user_id, event_type AS w FROM events UNION ALL SELECT user_id, 't' || event_id % 3 FROM events) GROUP BY user_id""")
def tag_lists(spark, sf):
    e = table(spark, sf, "events").select("user_id", T.tag_list([F.col("event_type"), F.concat(F.lit(" t"), F.col("event_id") % 3)]).alias("t"))
    return A.tags(e.select("user_id", F.array_join("t", " ").alias("t")), "user_id", ["t"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '\"a\", ' || c_mktsegment AS note, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS source_row FROM customer")
def csv_round_trip(spark, sf):
    """A file for each nation, as delimited text with quoted cells, padded headers and blank lines, read back with row numbers within each file."""
    out = _shared(spark, "csv")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit(',"""a"", '), "c_mktsegment", F.lit('"')).alias("line"))
    head = c.select(F.lit(-1).cast("long").alias("c_custkey"), "c_nationkey", F.lit(" id ,name , note").alias("line")).distinct()
    blank = c.where("c_custkey % 10 = 0").withColumn("line", F.lit(""))
    every = head.unionByName(c).unionByName(blank).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey", F.desc("line"))
    every.select("c_nationkey", F.col("line").alias("value")).write.partitionBy("c_nationkey").text(out)
    return R.read_csv(spark, out, provenance=True, multi_line=False).select("id", "name", "note", "source_row")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def header_row(spark, sf):
    """Two rows of preamble and header come before the data; the second becomes the header."""
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 10).alias("r"), F.col("s_suppkey").cast("string").alias("_c0"), F.col("s_name").alias("_c1"))
    top = spark.createDataFrame([(-2, "title", None), (-1, " id", "name ")], "r long, _c0 string, _c1 string")
    return R.promote_header(top.unionByName(s), "r", 1).drop("r")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_partkey AS VARCHAR) AS part FROM lineitem")
def json_records(spark, sf):
    """A record for each order with its lines below ``rows``."""
    out = _shared(spark, "x.jsonl")
    table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"))).alias("rows")).write.json(out)
    return R.read_any(spark, out, root="rows").select("id", "part")


@query("SELECT s_suppkey AS id, s_name AS name, 'about ' || s_nationkey AS body FROM supplier")
def note_corpus(spark, sf):
    """One text file per note in folders of about a thousand, read whole, split into header and body."""
    out, s = _shared(spark, "notes"), table(spark, sf, "supplier")
    n = s.count()
    path = F.concat(F.pmod(F.xxhash64("s_suppkey"), F.lit(n // 1000 + 1)), F.lit("/"), "s_suppkey", F.lit(".txt"))
    text = F.concat(F.lit("---\nid: "), "s_suppkey", F.lit("\nname: '"), "s_name", F.lit("'\n---\nabout "), "s_nationkey")
    NF.write_files(s.select(path.alias("path"), text.alias("content")).repartition(NF.tasks(n)), out)
    notes = NF.read_files(spark, out, ".txt").select("path", F.decode("content", "utf-8").alias("text"))
    got = L.split_note(notes).withColumn("h", L.header_pairs(F.col("header")))
    return got.select(F.col("h")["id"].cast("long").alias("id"), F.col("h")["name"].alias("name"), "body")


#: What the events of a type should carry: ``Click`` and ``view`` are known types in another case, ``gone`` is none.
_SAVED = "(VALUES ('click', 'K'), ('click', 'j'), ('gone', 'k'))"


@query(f"""
WITH s AS (SELECT event_type AS tbl, unnest(json_keys(props)) AS name FROM events), h AS (SELECT tbl, lower(name) AS k, min(name) AS b FROM s GROUP BY ALL), c AS (SELECT tbl, lower(name) AS k, name AS a FROM {_SAVED} AS v(tbl, name))
SELECT tbl, coalesce(a, b) AS name, CASE WHEN a IS NULL THEN 'extra' WHEN b IS NULL THEN 'missing' ELSE 'matched' END AS status FROM c FULL JOIN h USING (tbl, k)""")
def column_compare(spark, sf):
    """The keys that each type of event has, over all records, against a saved schema."""
    have = table(spark, sf, "events").select(F.col("event_type").alias("tbl"), F.explode(F.json_object_keys("props")).alias("name")).distinct()
    saved = spark.sql(f"SELECT * FROM {_SAVED} AS v(tbl, name)")
    return M.compare_columns(saved, have)


_ROLES = "(VALUES ('PART 1', 'frontmatter', 'id'), ('Part 2', 'title', 'n0'), ('Part 2', 'hierarchy', 'n1'), ('part 2', 'link', 'n2'), ('Part 3', 'title', 't'), ('nowhere', 'body', 'b'))"


@query(f"""
WITH c AS (SELECT DISTINCT 'Part ' || l_partkey % 50 AS name FROM lineitem), r AS (SELECT *, CASE role WHEN 'title' THEN 1 WHEN 'hierarchy' THEN 2 WHEN 'frontmatter' THEN 3 WHEN 'link' THEN 4 ELSE 5 END AS p FROM {_ROLES} AS v(col, role, output)),
b AS (SELECT lower(col) AS k, arg_max(role, p) AS role, arg_max(output, p) AS output FROM r GROUP BY 1)
SELECT name, coalesce(role, 'skip') AS role, coalesce(output, name) AS output FROM c LEFT JOIN b ON lower(name) = k""")
def config_roles(spark, sf):
    """Names that the lines use, with the roles that a saved mapping gives them."""
    have = table(spark, sf, "lineitem").select(F.concat(F.lit("Part "), F.col("l_partkey") % 50).alias("name")).distinct()
    return P.config_roles(spark.sql(f"SELECT * FROM {_ROLES} AS v(column, role, output)"), have)


@query("""
SELECT CASE WHEN c_custkey % 7 = 0 THEN 'error' WHEN c_custkey % 2 = 0 THEN 'skipped' ELSE 'created' END AS status, count(*) AS n FROM customer GROUP BY 1""")
def generation_summary(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("p"), "c_custkey")).alias("path"), F.col("c_custkey").alias("source_row"))
    good, bad = NT.split_errors(c, F.col("path").isNotNull(), "no path")
    _, results = NT.write_plan(good, good.where("source_row % 2 = 0"), "skip")
    return A.status_counts(results.select("status").unionByName(bad.select("status")))


@query("SELECT n_name AS fw, CAST(count(*) AS BIGINT) AS n, string_agg(c_custkey, ',' ORDER BY c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def relation_lists(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("fw"), "c_custkey", "c_name")
    got = L.relations(c, "fw", ["c_name"], "c_custkey")
    return got.select("fw", F.size("relations").cast("long").alias("n"), F.array_join(F.transform("relations", lambda x: x["c_custkey"].cast("string")), ",").alias("customers"))


@query("""
WITH m AS (SELECT CASE WHEN l_quantity < 40 THEN 1 ELSE 0 END + CASE WHEN l_discount <= 0.05 THEN 2 ELSE 0 END + CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 0 END AS x FROM lineitem)
SELECT x & 3 = 3 AND x & 4 = 0 AS valid, concat_ws(',', CASE WHEN x & 1 = 0 THEN 'no justification' END, CASE WHEN x & 2 = 0 THEN 'confidence' END, CASE WHEN x & 4 > 0 THEN 'modifier' END) AS problems, count(*) AS n FROM m GROUP BY ALL""")
def mapping_checks(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("subject"), F.lit("equal").alias("predicate"), F.col("l_partkey").cast("string").alias("object"), F.when(F.col("l_quantity") < 40, "manual").alias("justification"), F.when(F.col("l_discount") <= 0.05, F.col("l_discount")).otherwise(2.0).alias("confidence"),
        F.lit("a").alias("author"), F.to_date("l_shipdate").alias("dated"), F.lit(None).cast("string").alias("tool"), F.when(F.col("l_linenumber") % 3 == 0, "never").when(F.col("l_linenumber") % 3 == 1, "Not").alias("modifier"),
    )
    good, bad = G.valid_mappings(rows)
    return good.select(F.lit(True).alias("valid"), F.lit("").alias("problems")).unionByName(bad.select(F.lit(False).alias("valid"), F.array_join("problems", ",").alias("problems"))).groupBy("valid", "problems").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus END AS previous_s FROM orders")
def scd3(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return V.scd3(o, o.withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s"))), "k", "s")


@query("""
SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS current_s FROM orders
UNION ALL SELECT o_orderkey, 'X', 'X' FROM orders WHERE o_orderkey % 7 = 0""")
def scd6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    history = o.select("k", "s", F.lit(1).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"))
    n_parts = J.parts(o.count())
    after = V.scd2(history, o.withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s"))), "k", ["s"], F.lit(2), n_parts)
    return V.scd6(after, "k", ["s"], n_parts).select("k", "s", "current_s")


@query("""
SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-01' < o_orderdate + CAST(o_custkey % 400 AS INTEGER) * INTERVAL 1 DAY
  AND o_orderdate + INTERVAL 10 DAY <= TIMESTAMP '1997-01-05' AND (o_orderkey % 3 > 0 OR TIMESTAMP '1997-01-05' < o_orderdate + INTERVAL 100 DAY) GROUP BY ALL""")
def as_of(spark, sf):
    """What was valid on one day as it was known on another; every third row was withdrawn from the record after 100 days."""
    later = lambda days: F.col("o_orderdate") + F.make_dt_interval(days)
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderdate").alias("valid_from"), later(F.col("o_custkey") % 400).alias("valid_to"), later(F.lit(10)).alias("recorded_from"), F.when(F.col("o_orderkey") % 3 == 0, later(F.lit(100))).alias("recorded_to"))
    day = lambda x: F.lit(x).cast(o.schema["valid_from"].dataType)
    return V.as_of(o, day("1997-01-01"), day("1997-01-05")).groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""
SELECT 'p' || p_partkey AS old_id, 'q' || p_partkey AS new_id, 'alias' AS how FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT 'p' || p_partkey, 'q' || p_partkey, 'similar' FROM part WHERE p_partkey % 5 <> 0""")
def renamed_nodes(spark, sf):
    p = table(spark, sf, "part")
    side = lambda x, v: p.select(F.concat(F.lit(x), "p_partkey").alias("id"), v.alias("value"))
    alias = p.where("p_partkey % 5 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("old_id"), F.concat(F.lit("q"), "p_partkey").alias("new_id"))
    return V.renamed(side("p", F.concat(F.lit("Part "), "p_partkey")), side("q", F.concat(F.lit("part-"), "p_partkey")), alias, 0.9)


@query("""
WITH f AS (SELECT o_orderkey AS id, ['forbidden', 'rare', 'managed', 'unrestricted', 'often'][o_orderkey % 5 + 1] AS breaking, ['immutable', 'additive', 'evolving', 'unstable'][o_custkey % 4 + 1] AS ids,
  ['none', 'prose_only', 'structured_incomplete', 'structured_complete'][o_orderkey // 5 % 4 + 1] AS changelog, ['none', 'soft_delete', 'versioned_chain', 'forward_migration'][o_orderkey // 20 % 4 + 1] AS deprecation, o_orderstatus = 'P' AS archived FROM orders)
SELECT id, CASE WHEN breaking = 'forbidden' AND changelog = 'structured_complete' THEN 6 WHEN breaking IN ('rare', 'managed') AND deprecation = 'versioned_chain' THEN 4
  WHEN breaking = 'managed' AND ids = 'immutable' THEN 3 WHEN breaking = 'managed' AND ids = 'additive' THEN 2 WHEN archived THEN 0 ELSE 1 END AS scd_type, breaking <> 'often' AS valid FROM f""")
def recommend(spark, sf):
    """Fields dealt to the orders by their keys; ``often`` is no known policy."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    k, of = F.col("o_orderkey"), V.EVOLUTION
    o = table(spark, sf, "orders").select(
        k.alias("id"), pick((*of["breaking_change_policy"], "often"), k).alias("breaking_change_policy"), pick(of["id_stability"], F.col("o_custkey")).alias("id_stability"), pick(of["changelog_format"], F.floor(k / 5)).alias("changelog_format"),
        pick(of["deprecation_mechanism"], F.floor(k / 20)).alias("deprecation_mechanism"), *(F.lit(of[f][0]).alias(f) for f in ("release_cadence", "hierarchy_stability", "scope_expansion", "crosswalk_maintenance")), (F.col("o_orderstatus") == "P").alias("archived"),
    )
    return V.recommend(o, F.col("archived")).select("id", "scd_type", "valid")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'a_very_long_name_of_the_custome', count(*) FROM customer UNION ALL SELECT 'a_very_long_name_of_the_custo~2', count(*) FROM part")
def table_export(spark, sf):
    """Two of the names are the same when cut."""
    long = "a very long name of the customer table"
    tables = {"orders": table(spark, sf, "orders"), long: table(spark, sf, "customer"), long + " 2": table(spark, sf, "part")}
    paths = S.export(tables, _shared(spark, "export"))
    counts = [spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(p.rsplit("/", 1)[1]).alias("name"), "n") for p in paths.values()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT DISTINCT l_orderkey AS src_id, l_partkey AS dst_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def missing_targets(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).distinct()
    return J.missing(e, table(spark, sf, "part").where("p_partkey % 3 = 0"), "p_partkey")


@query("""
SELECT 'C' || c_custkey AS id, r_name || '/' || n_name AS path_text, 'T' || c_custkey AS deepest FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def csf_core(spark, sf):
    """The framework job on regions, nations and customers as a sheet with blanked repeats."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = F.col("n_regionkey").cast("long") * 10**12 + F.col("n_nationkey").cast("long") * 10**9 + F.col("c_custkey")
    rows = c.select(at.alias("source_row"), F.col("r_name").alias("Function"), F.col("n_name").alias("Category"), F.concat(F.lit("T"), "c_custkey", F.lit(": text")).alias("Subcategory"), "c_custkey")
    f, g = rows.groupBy("Function").agg(F.min("source_row").alias("_f")), rows.groupBy("Function", "Category").agg(F.min("source_row").alias("_g"))
    blanked = rows.join(f, "Function").join(g, ["Function", "Category"]).select("source_row", F.when(F.col("source_row") == F.col("_f"), F.col("Function")).otherwise(" ").alias("Function"), F.when(F.col("source_row") == F.col("_g"), F.col("Category")).otherwise("").alias("Category"), "Subcategory", "c_custkey")
    return FW.csf_core(blanked).select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.concat_ws("/", "Function", "Category").alias("path_text"), F.col("csf_id").alias("deepest"))
