"""The framework jobs on small sheets."""

from taxolink.plans import frameworks as FW


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("source_row").select(*cols).collect()]


def test_cri_core(spark):
    s = spark.createDataFrame([(1, "A-1 ", "x"), (2, "A-1", "later"), (3, None, "y"), (4, "B", "“q”")], "source_row long, `Profile  Id` string, `Text` string")
    t = spark.createDataFrame([(1, "A-1", "#b #a"), (2, "A-1", "#a  #c")], "source_row long, `Profile Id` string, `CRI Profile Subject Tags` string")
    got = FW.cri_core(s, t)
    assert rows(got, "Profile Id", "Text", "CRI Profile Subject Tags") == [("A-1", "x", "#cri/a #cri/b #cri/c"), ("B", '"q"', None)]


def test_nist_core(spark):
    c = spark.createDataFrame([(1, "AC-1", "one"), (2, "AC-2", "two")], "source_row long, `Control Identifier` string, name string")
    a = spark.createDataFrame([(1, "AC-01_ODP[01]"), (2, "AC-01")], "source_row long, identifier string")
    got = FW.nist_core(c, a).orderBy("Control Identifier").collect()
    assert [(r["Control Identifier"], r["identifier"]) for r in got] == [("AC-1", "AC-01_ODP[01]"), ("AC-2", None)]


def test_engage_core(spark):
    one = lambda data, cols: spark.createDataFrame(data, cols)
    got = FW.engage_core(
        one([("G1", "goal")], "goal_id string, name string"), one([("G1", "P1"), ("G1", "P2")], "goal_id string, approach_id string"), one([("P1", "approach", "x")], "approach_id string, name string, a_text string"),
        one([("P1", "V1"), ("P1", "V1")], "approach_id string, activity_id string"), one([("V1", "act")], "activity_id string, v_text string"),
    ).collect()
    assert sorted((r["goal_id"], r["approach_id"], r["activity_id"] or "", r["name"], r["a_text"] or "") for r in got) == [("G1", "P1", "V1", "goal", "x"), ("G1", "P2", "", "goal", "")]


def test_d3fend_core(spark):
    s = spark.createDataFrame([(1, "D1", "Model", "Inventory", "", ""), (2, "D2", "", "", "Asset", ""), (3, "D3", "", "", "", "Deep")], "source_row long, ID string, `D3FEND Tactic` string, `D3FEND Technique` string, `D3FEND Technique Level 0` string, `D3FEND Technique Level 1` string")
    m = spark.createDataFrame([("Asset", "T1"), ("Asset", "T2")], "label string, attack string")
    got = FW.d3fend_core(s, m)
    assert [r[:3] for r in rows(got, "ID", "label", "path_text")] == [("D1", "Inventory", "Model › Inventory"), ("D2", "Asset", "Model › Inventory › Asset"), ("D3", "Deep", "Model › Inventory › Deep")]


def test_csf_core(spark):
    s = spark.createDataFrame([(1, "GOVERN (GV): g", "", ""), (2, "", "Context (GV.OC): c", ""), (3, "", "", "GV.OC-01: s"), (4, "", "", "GV.OC-01: again")], "source_row long, Function string, Category string, Subcategory string")
    assert rows(FW.csf_core(s), "csf_id", "Function") == [("GV", "GOVERN (GV): g"), ("GV.OC", "GOVERN (GV): g"), ("GV.OC-01", "GOVERN (GV): g")]


def test_cis(spark):
    s = spark.createDataFrame([(1, "1", "", "Assets"), (2, "", "'1.1", "Inventory"), (3, None, "1.2", "Address"), (4, "2", " ", "Software")], "source_row long, `CIS Control` string, `CIS Safeguard` string, Title string")
    assert rows(FW.cis_core(s), "cis_id", "control_title") == [("1", "Assets"), ("1.1", "Assets"), ("1.2", "Assets"), ("2", "Software")]
    m = spark.createDataFrame([("1", "1.1", "Identify", "ID.AM-1"), ("1", "", "Protect", " "), ("2", "2.1", "?", None)], "`CIS Control` string, `CIS Sub-Control` string, `Security Function` string, Subcategory string")
    assert sorted(map(tuple, FW.cis_csf_mapping(m).collect())) == [("1", "PR"), ("1.1", "ID.AM-1")]


def test_paths(spark):
    got = FW.derive_paths(spark.createDataFrame([(1, "AC-2(1)"), (2, "AC")], "source_row long, id string"), "id")
    assert rows(got, "depth", "parent_id") == [(3, "AC-2"), (1, None)]
    assert set(FW.TABLE_TRANSFORMS) == {"tag-aggregation", "hierarchical-ffill", "preamble-extraction", "id-normalization"}
