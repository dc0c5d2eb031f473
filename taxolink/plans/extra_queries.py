"""Further readers and sinks, scalar forms, note roles and the framework jobs, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolink.functions import names as N
from taxolink.functions import text as T
from taxolink.functions import transforms as X
from taxolink.operators import evidence as E
from taxolink.operators import links as L
from taxolink.operators import match as M
from taxolink.operators import notes as NT
from taxolink.plans import frameworks as FW
from taxolink.plans.graph_queries import _shared
from taxolink.plans.registry import query, table
from taxolink.sources import readers as R
from taxolink.sources import sinks as S


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', ' || p_type AS what, CASE WHEN p_size % 3 > 0 THEN p_brand END AS brand FROM part")
def sniffed_csv(spark, sf):
    """Cells separated by semicolons, with commas inside, blank lines between and some cells empty; the delimiter is found."""
    out = _shared(spark, "csv")
    p = table(spark, sf, "part")
    line = F.concat_ws(";", "p_partkey", F.concat("p_name", F.lit(", "), "p_type"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(""))
    body = p.select("p_brand", F.explode(F.array(line, F.lit(""))).alias("value"))
    head = p.select("p_brand").distinct().withColumn("value", F.lit("id; what ;brand"))
    rows = head.withColumn("k", F.lit(0)).unionByName(body.withColumn("k", F.lit(1))).repartition("p_brand").sortWithinPartitions("p_brand", "k")
    rows.select("p_brand", "value").write.partitionBy("p_brand").text(out)
    return R.read_csv(spark, out, sep=None, multi_line=False).select("id", "what", "brand")


@query("SELECT 'parts' AS sheet, count(*) AS n, count(DISTINCT p_brand) AS kinds FROM part UNION ALL SELECT 'customers', count(*), count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderstatus) FROM orders")
def sheets(spark, sf):
    """Three exported tables of three formats, read as named sheets and asked by name."""
    p, c, o = table(spark, sf, "part").select(F.col("p_brand").alias("kind")), table(spark, sf, "customer").select(F.col("c_mktsegment").alias("kind")), table(spark, sf, "orders").select(F.col("o_orderstatus").alias("kind"))
    root = _shared(spark, "sheets")
    p.write.option("header", True).csv(f"{root}/parts.csv")
    c.write.json(f"{root}/customers.jsonl")
    o.write.parquet(f"{root}/orders.parquet")
    got = R.read_sheets(spark, {"sheet_parts": f"{root}/parts.csv", "sheet_customers": f"{root}/customers.jsonl", "sheet_orders": f"{root}/orders.parquet"})
    one = lambda name: spark.sql(f"SELECT '{name}' AS sheet, count(*) AS n, count(DISTINCT kind) AS kinds FROM sheet_{name}")
    assert set(got) == {"sheet_parts", "sheet_customers", "sheet_orders"}
    return one("parts").unionByName(one("customers")).unionByName(one("orders"))


@query("""
SELECT 'N' || s_nationkey || '/' || s_name || '.md' AS path, '{"name":"' || s_name || '"}' AS frontmatter, 'about ' || s_suppkey AS body FROM supplier""")
def note_files(spark, sf):
    """Notes as one file each, and read back."""
    out = _shared(spark, "files")
    s = table(spark, sf, "supplier")
    S.write_files(s.select(F.concat(F.lit("N"), "s_nationkey", F.lit("/"), "s_name", F.lit(".md")).alias("path"), F.to_json(F.struct(F.col("s_name").alias("name"))).alias("frontmatter"), F.concat(F.lit("about "), "s_suppkey").alias("body")), out)
    got = L.split_note(R.read_notes(spark, out))
    return got.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.trim(F.regexp_replace("header", r"\n$", "")).alias("frontmatter"), F.regexp_replace("body", r"^\n|\n$", "").alias("body"))


@query("""
WITH c AS (SELECT *, 'ID' || c_nationkey || '.AM-' || c_custkey AS code FROM customer)
SELECT 'vault/ID' || c_nationkey || '/ID' || c_nationkey || '.AM/' || code || '/' || code || '.md' AS path, code AS node_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS tier,
  CASE WHEN c_custkey % 3 = 0 THEN '#a #' || lower(c_mktsegment) ELSE '' END AS tags FROM c""")
def tag_folder_notes(spark, sf):
    """A folder for each cumulative segment of an id; one field only where the level says so."""
    c = table(spark, sf, "customer").withColumn("code", F.concat(F.lit("ID"), "c_nationkey", F.lit(".AM-"), "c_custkey")).withColumn("level", F.when(F.col("c_custkey") % 2 == 0, "DS").otherwise("C"))
    c = c.withColumn("tags", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("#a  #"), F.lower("c_mktsegment"))))
    got = NT.level_notes(c, "code", "vault", {"c_name": "title"}, "level", {"DS": {"c_mktsegment": "tier"}}, cumulative=True, tags="tags")
    f = F.from_json("frontmatter", "struct<properties: map<string,string>, tags: array<string>>")
    return got.select("path", "node_id", f["properties"]["title"].alias("title"), f["properties"]["tier"].alias("tier"), F.array_join(f["tags"], " ").alias("tags"))


@query("""
SELECT s_suppkey AS supplier_key, s_name AS "supplier-name", s_nationkey AS "nation key", round(s_acctbal, 2) AS account_balance FROM supplier""")
def name_forms(spark, sf):
    """Each column named in another style."""
    raw = {"s_suppkey": ("Supplier Key", N.snake), "s_name": ("SupplierName", "kebab-case"), "s_nationkey": ("Nation KEY", "lowercase"), "s_acctbal": ("accountBalance", "snake_case")}
    s = table(spark, sf, "supplier").withColumn("s_acctbal", F.round("s_acctbal", 2))
    style = lambda c, name, how: N.rename(s.select(F.col(c).alias(name)), how).columns[0]
    return s.select(*(F.col(c).alias(style(c, name, how)) for c, (name, how) in raw.items()))


@query("""
SELECT 'v/' || c_mktsegment || '/' || n_name || '/' || c_name || '.md' AS path, CAST(c_custkey AS VARCHAR) AS source_id, 'sales' AS framework, 'customer.parquet' AS source_file, c_custkey AS source_row, 'Customer Id,balance' AS imported, c_name AS title_text
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def role_notes(spark, sf):
    """Column roles make the mapping; hierarchy levels come in the order of the roles; provenance tells where a note is from."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("control_id", F.col("c_custkey").cast("string"))
    roles = [("c_mktsegment", "hierarchy", ""), ("n_name", "hierarchy", ""), ("c_name", "title", ""), ("control_id", "frontmatter", "Customer Id"), ("c_acctbal", "frontmatter", "balance"), ("c_name", "body", ""), ("n_regionkey", "skip", "")]
    mapping = NT.from_roles(roles, base="v", framework="sales")
    got = NT.render(c, mapping, "c_custkey", "customer.parquet", import_id="i1")
    at = F.from_json("provenance", "struct<schemaVersion: int, sourceId: string, framework: string, frameworkVersion: string, importId: string, importedProperties: array<string>, sourceFile: string, sourceRow: long>")
    return got.select("path", at["sourceId"].alias("source_id"), at["framework"].alias("framework"), at["sourceFile"].alias("source_file"), at["sourceRow"].alias("source_row"), F.array_join(at["importedProperties"], ",").alias("imported"), F.regexp_replace("body", "^## c_name\n", "").alias("title_text"))


@query("""
WITH v AS (SELECT DISTINCT p_name AS value FROM part),
s AS (SELECT value, list_distinct(string_split(lower(value), ' ')) AS t FROM v),
b AS (SELECT value || 'New' AS name, list_distinct(list_append(string_split(lower(value), ' '), 'new')) AS t FROM v),
j AS (SELECT b.name, s.value AS suggestion, len(list_intersect(b.t, s.t)) / (len(b.t) + len(s.t) - len(list_intersect(b.t, s.t))) AS score FROM b JOIN s ON true)
SELECT name, suggestion, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, suggestion DESC) AS k FROM j WHERE score >= 0.5) WHERE k = 1""")
def similar_columns(spark, sf):
    """Names in camel case against the known ones."""
    v = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return M.fuzzy_columns(v.select(F.concat("name", F.lit("New")).alias("name")), v).withColumn("score", F.round("score", 6))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE '' END AS cleaned, c_mktsegment AS bare, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || ' › ' || c_mktsegment END AS way, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' ›  › x' ELSE c_name || ' › ' || c_mktsegment || ' › x' END AS full_way,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS other, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS as_text,
  sha256('{"c_custkey":"' || c_custkey || '","c_name":"' || c_name || '"}') AS hash, CASE WHEN c_custkey % 5 = 0 THEN 'row-' || c_custkey WHEN c_custkey % 5 < 3 THEN 'k' || c_custkey ELSE c_name END AS source FROM customer""")
def text_forms(spark, sf):
    c = table(spark, sf, "customer")
    blank, segment = F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("  ")
    ids = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 < 3, F.concat(F.lit("k"), "c_custkey")).alias("Key"), F.when(F.col("c_custkey") % 5 > 2, F.col("c_name")).alias("ref")).select("c_custkey", T.source_id(["c_custkey", "Key", "ref"], F.col("c_custkey"), {"ref": "Identifier"}).alias("source"))
    got = c.select(
        F.col("c_custkey").alias("id"), "c_custkey", T.clean(F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("\t "), "c_name", F.lit("\u00a0")))).alias("cleaned"), T.strip_apostrophe(F.concat(F.lit("''"), "c_mktsegment", F.lit(" "))).alias("bare"),
        T.path_text([F.col("c_name"), segment]).alias("way"), T.path_text([F.col("c_name"), segment, F.lit("x")], keep_empty=True).alias("full_way"), T.or_else(segment, F.col("c_name")).alias("other"), T.as_text(blank).alias("as_text"), T.content_hash(["c_name", "c_custkey"]).alias("hash"),
    )
    return got.join(ids, "c_custkey").drop("c_custkey")


@query("""
SELECT CASE WHEN p_size % 4 = 0 THEN 'C' || p_size ELSE 'S' || p_partkey END AS cis_id, CASE WHEN p_size % 3 = 0 THEN CASE p_partkey % 2 WHEN 0 THEN 'ID' ELSE 'PR' END ELSE p_brand END AS csf_id FROM part WHERE p_size % 3 > 0 OR p_partkey % 5 > 0""")
def cis_mapping(spark, sf):
    """Mapping sheet: blank sub-controls stand for the control, blank subcategories for the function; rows without either go."""
    p = table(spark, sf, "part")
    function = F.when(F.col("p_partkey") % 5 == 0, "?").when(F.col("p_partkey") % 2 == 0, "IDENTIFY").otherwise("Protect")
    sheet = p.select(F.concat(F.lit("'C"), "p_size").alias("CIS Control"), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("'S"), "p_partkey", F.lit(" "))).otherwise(" ").alias("CIS\nSub-Control"), function.alias("Security  Function"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise("").alias("Subcategory"))
    return FW.cis_csf_mapping(sheet)


@query("SELECT s_suppkey AS id, s_name AS name, 'N' || s_nationkey || '|x: y' AS tags, s_acctbal > 0 AS solvent FROM supplier")
def nested_headers(spark, sf):
    """Headers with nested keys, lists and quoted text, and one that is no YAML."""
    s = table(spark, sf, "supplier")
    head = F.concat(F.lit("---\nid: "), "s_suppkey", F.lit("\nmeta:\n  name: \""), "s_name", F.lit('"\n  flags: {solvent: '), (F.col("s_acctbal") > 0).cast("string"), F.lit("}\ntags:\n- N"), "s_nationkey", F.lit('\n- "x: y"\n---\ntext'))
    notes = s.select(head.alias("text")).unionByName(s.limit(1).select(F.lit("---\na: [\n---\nbroken").alias("text")))
    got = L.nested_header(L.split_note(notes)).where("properties is not null")
    p = F.from_json("properties", "struct<id: long, meta: struct<name: string, flags: struct<solvent: boolean>>, tags: array<string>>")
    return got.select(p["id"].alias("id"), p["meta"]["name"].alias("name"), F.array_join(p["tags"], "|").alias("tags"), p["meta"]["flags"]["solvent"].alias("solvent"))


@query("SELECT p_name AS name, max(p_brand || '/' || p_partkey || '/' || p_name || '.md') AS path FROM part WHERE p_size <> 1 GROUP BY p_name")
def note_index(spark, sf):
    """Of notes with one base name the last path counts; hidden ones do not."""
    p = table(spark, sf, "part")
    return L.note_index(p.select(F.concat("p_brand", F.lit("/"), "p_partkey", F.lit("/"), F.when(F.col("p_size") == 1, ".").otherwise(""), "p_name", F.lit(".md")).alias("path")))


X.register("initials", lambda c, by=" ": F.array_join(F.transform(F.split(c, by), lambda w: F.upper(F.substring(w, 1, 1))), ""))


@query("""
SELECT p_partkey, lower(p_type) AS low, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') AS initials FROM part""")
def trf_custom(spark, sf):
    """Case transforms, and one of one's own."""
    p = table(spark, sf, "part").withColumn("p_name_up", F.upper("p_name"))
    return X.apply(p, [("low", "p_type", "lowercase", ()), ("title", "p_name_up", "titlecase", ()), ("initials", "p_name", "initials", ())]).select("p_partkey", "low", "title", "initials")


@query("SELECT 'U-' || user_id AS id, string_agg(DISTINCT '#' || event_type, ' ' ORDER BY '#' || event_type) AS tags FROM events GROUP BY user_id")
def table_transforms(spark, sf):
    """Table-level transforms by the names that a saved config gives them."""
    e = table(spark, sf, "events").select(F.format_string("U-%02d", "user_id").alias("id"), F.concat(F.lit("#"), "event_type").alias("t"))
    return FW.TABLE_TRANSFORMS["tag-aggregation"](FW.TABLE_TRANSFORMS["id-normalization"](e, "id"), "id", ["t"])


@query("""
WITH t AS (SELECT o_custkey AS k, string_agg(DISTINCT '#cri/' || lower(o_orderstatus), ' ' ORDER BY '#cri/' || lower(o_orderstatus)) AS tags FROM orders GROUP BY o_custkey)
SELECT 'C-' || c_custkey AS id, c_name AS name, tags FROM customer LEFT JOIN t ON k = c_custkey""")
def cri_core(spark, sf):
    """Profiles are customers, each twice in the sheet; tags come from their orders."""
    c = table(spark, sf, "customer").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "c_custkey", "c_name")
    sheet = c.select((F.col("i") * 10**9 + F.col("c_custkey")).alias("source_row"), F.concat(F.lit("C-"), "c_custkey", F.lit(" ")).alias("Profile  Id"), F.when(F.col("i") == 0, F.col("c_name")).otherwise("later").alias("Name"))
    tags = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_row"), F.concat(F.lit("C-"), "o_custkey").alias("Profile Id"), F.concat(F.lit(" #"), F.lower("o_orderstatus")).alias("CRI Profile Subject Tags"))
    return FW.cri_core(sheet, tags).select(F.col("Profile Id").alias("id"), F.col("Name").alias("name"), F.col("CRI Profile Subject Tags").alias("tags"))


@query("""
SELECT 'AC-' || c_custkey AS control, c_name AS name, min(o_orderkey) AS assessment FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def nist_core(spark, sf):
    """Controls are customers, assessments their orders under ids with leading zeros; the first assessment stays."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_row"), F.concat(F.lit("AC-"), "c_custkey").alias("Control Identifier"), F.col("c_name").alias("name"))
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_row"), F.concat(F.format_string("AC-%02d", "o_custkey"), F.lit("_ODP[01]")).alias("identifier"), "o_orderkey")
    return FW.nist_core(c, a).select(F.col("Control Identifier").alias("control"), "name", F.col("o_orderkey").alias("assessment"))


@query("""
SELECT DISTINCT 'R' || n_regionkey AS goal, n_name AS approach, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'seg ' || c_mktsegment END AS activity FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def engage_core(spark, sf):
    """Goals are regions, approaches nations, activities the segments of their customers; one segment has no activity row."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    goals = n.select(F.concat(F.lit("R"), "n_regionkey").alias("goal_id")).distinct()
    bridge = n.select(F.concat(F.lit("R"), "n_regionkey").alias("goal_id"), F.concat(F.lit("N"), "n_nationkey").alias("approach_id"))
    approaches = n.select(F.concat(F.lit("N"), "n_nationkey").alias("approach_id"), F.col("n_name").alias("approach"))
    does = c.select(F.concat(F.lit("N"), "c_nationkey").alias("approach_id"), F.col("c_mktsegment").alias("activity_id"))
    activities = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("activity_id"), F.concat(F.lit("seg "), "c_mktsegment").alias("activity")).distinct()
    return FW.engage_core(goals, bridge, approaches, does, activities).select(F.col("goal_id").alias("goal"), "approach", "activity")


@query("""
SELECT c_custkey AS id, n_name || ' › ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' › ' || c_name ELSE '' END AS way, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS label, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 7 END AS mapped
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def d3fend_core(spark, sf):
    """Tactics are nations, blanked where they repeat; every second customer has a level of its own, which a mapping knows by label."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    first = c.groupBy("n_nationkey").agg(F.min("c_custkey").alias("f"))
    rows = c.join(first, "n_nationkey").select(
        (F.col("n_nationkey").cast("long") * 10**10 + F.col("c_custkey")).alias("source_row"), F.col("c_custkey").alias("ID"), F.when(F.col("c_custkey") == F.col("f"), F.col("n_name")).otherwise(" ").alias("D3FEND Tactic"), F.col("c_mktsegment").alias("D3FEND Technique"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("D3FEND Technique Level 0"), F.lit("").alias("D3FEND Technique Level 1"),
    )
    mapping = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat("c_name", F.lit(" ")).alias("label_of"), (F.col("c_custkey") * 7).alias("mapped"))
    return FW.d3fend_core(rows, mapping, label="label_of").select(F.col("ID").alias("id"), F.col("path_text").alias("way"), "label", "mapped")


@query("""
SELECT 'N' || n_nationkey AS cis_id, n_name AS control_title FROM nation UNION ALL SELECT 'N' || c_nationkey || '.' || c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def cis_core(spark, sf):
    """Controls are nations, safeguards their customers; the control's id stands only on its own row, or with an apostrophe."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    at = lambda k, more: (F.col(k).cast("long") * 10**10 + more).alias("source_row")
    top = n.select(at("n_nationkey", 0), F.concat(F.lit("'N"), "n_nationkey").alias("CIS Control"), F.lit(" ").alias("CIS Safeguard"), F.col("n_name").alias("Title"))
    low = c.select(at("c_nationkey", 1 + F.col("c_custkey")), F.lit("").alias("CIS Control"), F.concat(F.lit("'N"), "c_nationkey", F.lit("."), "c_custkey").alias("CIS Safeguard"), F.col("c_name").alias("Title"))
    return FW.cis_core(top.unionByName(low)).select("cis_id", "control_title")


@query("""
WITH e AS (SELECT CASE WHEN l_quantity >= 48 THEN 'no evidence,' ELSE '' END || CASE WHEN l_linestatus = 'F' THEN 'unknown status,' ELSE '' END || CASE WHEN l_returnflag = 'N' THEN 'unknown method,' ELSE '' END
  || CASE WHEN l_discount > 0.08 THEN 'confidence,' ELSE '' END || CASE WHEN l_linenumber = 1 THEN 'expires before collected,' ELSE '' END AS problems FROM lineitem)
SELECT rtrim(problems, ',') AS problems, count(*) AS n FROM e GROUP BY 1""")
def evidence_links(spark, sf):
    """Lines as evidence links with all fields; broken ones say what is wrong."""
    day = F.to_date("l_shipdate")
    e = table(spark, sf, "lineitem").select(
        F.lit("evidence-control").alias("link_type"), F.when(F.col("l_quantity") < 48, F.concat(F.lit("E"), "l_orderkey")).alias("evidence"), F.concat(F.lit("C"), "l_partkey").alias("control"), F.lit("fw").alias("framework"), F.when(F.col("l_linestatus") == "F", "done").otherwise("partial").alias("status"),
        F.when(F.col("l_discount") > 0.08, 1.5).otherwise(F.col("l_discount")).alias("confidence"), F.lit("interview").alias("evidence_type"), F.when(F.col("l_returnflag") == "N", "GUESS").otherwise("TEST").alias("method"), F.lit("r").alias("reviewer"), day.alias("review_date"), F.lit(None).cast("string").alias("responsible"),
        day.alias("collected"), F.date_add(day, F.when(F.col("l_linenumber") == 1, -1).otherwise(30)).alias("expires"),
    )
    good, bad = E.valid_links(e)
    return good.select(F.lit("").alias("problems")).unionByName(bad.select(F.array_join("problems", ",").alias("problems"))).groupBy("problems").agg(F.count("*").alias("n"))
