"""Expressions against worked cases."""

import pytest
from pyspark.sql import functions as F

from taxolink.functions import names as N
from taxolink.functions import text as T
from taxolink.functions import transforms as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.cumulative_path, "ID.AM-1", ["ID", "ID.AM", "ID.AM-1"]),
        (T.cumulative_path, "AC-2(1)", ["AC", "AC-2", "AC-2(1)"]),
        (T.cumulative_path, "GV.OC-01", ["GV", "GV.OC", "GV.OC-01"]),
        (T.cumulative_path, "plain", ["plain"]),
        (T.cumulative_path, "", []),
        (T.cumulative_path, None, None),
        (lambda c: T.cumulative_path(c, legacy=True), "DE.AE-04", ["DE", "DE.AE-04", "DE.AE", "DE.AE-04"]),
        (lambda c: T.cumulative_path(c, legacy=True), "DE", []),
        (T.split_path, "ID.AM-1", ["ID", "AM", "1"]),
        (T.split_path, "T1059.003", ["T1059", "003"]),
        (T.normalize_id, "AC-01", "AC-1"),
        (T.normalize_id, "AC-10", "AC-10"),
        (T.normalize_id, "x", "x"),
        (T.strip_apostrophe, "''PR.AC ", "PR.AC"),
        (T.yaml_text, "a “b”\nc’s", "|-\n  a \"b\"\n  c's"),
        (T.yaml_text, "  one  ", "one"),
        (T.path_segment, '..a/b: c  d?..', "a-b- c d-"),
        (T.file_name, ".x.MD", "x"),
        (T.to_list, "a; b", ["a", "b"]),
        (T.to_list, "a, b; c", ["a", "b; c"]),
        (T.to_list, "a", ["a"]),
        (T.to_number, "1d", None),
        (T.to_number, "NaN", None),
        (T.to_number, "0x10", 16.0),
        (T.to_number, " 1e3 ", 1000.0),
        (T.to_number, "-.5", -0.5),
        (T.to_boolean, "YES", True),
        (T.to_boolean, "maybe", False),
        (T.last_level, "a / b", "b"),
        (T.last_level, "a", ""),
        (T.parent_path, "a/b/c.md", "a/b"),
        (T.base_name, "a/b/c.md", "c"),
        (T.link, "AC-1", "[[AC-1]]"),
        (lambda c: T.framework_link(c, "P ", alias=True), "AC-1", "[[AC-1-P AC-1|P AC-1]]"),
        (lambda c: T.framework_link(c, "P-", markdown=True), "1", "[P-1](P-1)"),
        (lambda c: T.body(c, "quote"), "a\nb", "> a\n> b"),
        (lambda c: T.body(c, "code"), "a", "```\na\n```"),
        (lambda c: T.prefix_tags(c), "#a #b", "#cri/a #cri/b"),
        (lambda c: T.deepest_id([c]), "Function (ID.AM): x", "ID.AM"),
        (lambda c: T.code_map(c, {"Identify": "ID"}, lower=True), "IDENTIFY", "ID"),
        (lambda c: T.code_map(c, {"Identify": "ID"}), "other", None),
        (X.TRANSFORMS["to_boolean"], "maybe", None),
        (X.TRANSFORMS["to_wikilinks"], "a,,b", ["[[a]]", "[[b]]"]),
        (lambda c: X.TRANSFORMS["to_tags"](c, "x"), "A b, c", ["#x/a-b", "#x/c"]),
    ],
)
def test_expression(spark, f, value, want):
    assert one(spark, value, f) == want


def test_path_text_and_lowest_label(spark):
    df = spark.createDataFrame([("A", " ", "C")], "a string, b string, c string")
    cols = [F.col(c) for c in "abc"]
    assert df.select(T.path_text(cols).alias("x")).first()["x"] == "A › C"
    assert df.select(T.path_text(cols, keep_empty=True).alias("x")).first()["x"] == "A ›  › C"
    assert df.select(T.lowest_label(cols[1:]).alias("x")).first()["x"] == "C"


def test_template_needs_known_columns(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(T.template("{{a}}-{{b}}!", df.columns).alias("x")).first()["x"] == "x-!"
    with pytest.raises(ValueError):
        T.template("{{nope}}", df.columns)


def test_names():
    assert [N.sanitize(x) for x in (" Profile Id ", "Category / Subcategory")] == ["profile_id", "category_subcategory"]
    assert N.key("--Control ID (x)") == "control_id_x"
    assert N.fingerprint_key(" A b-") == "a_b_"
    assert [f("Control Family") for f in N.STYLES.values()] == ["Control Family", "control family", "control_family", "control-family", "controlFamily"]
    with pytest.raises(KeyError):
        N.pick(["a"], "b")


def test_own_transform(spark):
    X.register("reverse", lambda c: F.reverse(c))
    df = spark.createDataFrame([("abc",)], "a string")
    assert X.apply(df, [("b", "a", "reverse", ())]).first()["b"] == "cba"


def test_source_id(spark):
    df = spark.createDataFrame([(None, "c1", 3), ("", None, 4)], "id string, code string, n long")
    assert [r[0] for r in df.select(T.source_id(df.columns, F.col("n"))).collect()] == ["c1", "row-4"]
    assert df.select(T.source_id(["title"], F.col("n"), {"code": "key"})).first()[0] == "c1"


def test_deterministic_uuid(spark):
    import uuid

    from taxolink.operators.evidence import name_id

    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    got = one(spark, "AC-1", lambda c: name_id(space, c))
    assert got == str(uuid.uuid5(uuid.UUID(space), "AC-1"))


def test_nested_styles(spark):
    from taxolink.operators import notes as NT

    df = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string")
    keys = {"x": "meta_name", "y": "meta_kind_of", "z": "plain"}
    got = df.select(NT.nested(keys, "group_by_prefix").alias("f"), NT.nested(keys).alias("g")).first()
    assert got["f"].asDict(True) == {"meta": {"name": "a", "kind_of": "b"}, "plain": "c"} and got["g"].asDict() == {"meta_name": "a", "meta_kind_of": "b", "plain": "c"}


def test_templates(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(T.template("{x}-{y}!", df.columns, double=False).alias("t")).first()["t"] == "a-!"
    assert df.select(T.template("{{ x }}/{x}", df.columns).alias("t")).first()["t"] == "a/{x}"
    for double in (True, False):
        with pytest.raises(ValueError):
            T.template("{{gone}} {gone}", df.columns, double)


@pytest.mark.parametrize("style, want", [("as-is", "Control Family-Name"), ("lowercase", "control family-name"), ("snake_case", "control_family_name"), ("kebab-case", "control-family-name"), ("camelCase", "controlFamilyName")])
def test_name_styles(style, want):
    assert N.STYLES[style]("Control Family-Name") == want
