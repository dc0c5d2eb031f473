"""The framework jobs (2.18): raw sheets in, one clean row per identifier out.  Each is a composition of the library's operators.

Every table has a numeric ``source_row``.  Fixed values in this module are the column names and words of the published sheets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from taxolink.functions import names as N
from taxolink.functions import text as T
from taxolink.operators import aggregate as A
from taxolink.operators import joins as J
from taxolink.operators import ordered as O

#: Functions of the CSF and their codes.
CSF_CODES = {"Govern": "GV", "Identify": "ID", "Protect": "PR", "Detect": "DE", "Respond": "RS", "Recover": "RC"}


def clean_table(df: DataFrame, quotes: bool = True) -> DataFrame:
    """Headers on one line, every text column stripped, smart quotes made plain; one projection."""
    df = N.rename(df, N.one_line)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    fix = lambda c: T.smart_quotes(T.strip(c)) if quotes else T.strip(c)
    return df.select(*((fix(F.col(f"`{c}`")) if c in text else F.col(f"`{c}`")).alias(c) for c in df.columns))


def derive_paths(df: DataFrame, code: str, legacy: bool = False) -> DataFrame:
    """``path``, ``depth`` and ``parent_id`` from an identifier's delimiters."""
    path = T.cumulative_path(F.col(code), legacy=legacy)
    return df.withColumn("path", path).withColumn("depth", F.size("path")).withColumn("parent_id", F.when(F.col("depth") > 1, F.element_at("path", F.col("depth") - 1)))


def cri_core(structure: DataFrame, tags: DataFrame, key: str = "Profile Id", tag_col: str = "CRI Profile Subject Tags") -> DataFrame:
    """Profile rows with their prefixed, distinct, ordered tags; one row per id."""
    rows = clean_table(structure).dropna(subset=[key])
    marked = clean_table(tags).select(key, T.prefix_tags(F.col(f"`{tag_col}`")).alias("_t"))
    got = J.join_keep_left(rows, A.tags(marked, key, ["_t"], tag_col), [key])
    return O.keep_first(got, [key], ["source_row"])


def nist_core(controls: DataFrame, assessments: DataFrame, control_key: str = "Control Identifier", assess_key: str = "identifier") -> DataFrame:
    """Controls with their assessment rows, met on ids without leading zeros; one row per control."""
    got = J.join_on_derived(clean_table(controls), clean_table(assessments), T.normalize_id(F.col(f"`{control_key}`")), T.normalize_id(F.col(f"`{assess_key}`")), ("_ctrl", "_assess"))
    order = [c for c in ("source_row_ctrl", "source_row_assess", "source_row") if c in got.columns]
    return O.keep_first(got, [control_key], [F.coalesce(F.col(c), F.lit(0)) for c in order])


def engage_core(goals: DataFrame, goal_approach: DataFrame, approaches: DataFrame, approach_activity: DataFrame, activities: DataFrame, order: Sequence[str] = ("goal_id", "approach_id", "activity_id")) -> DataFrame:
    """Goals, approaches and activities through two bridge tables; each side names its id ``goal_id``, ``approach_id`` or ``activity_id``."""
    got = J.bridge_chain(goals, (goal_approach, ["goal_id"]), (approaches, ["approach_id"]), (approach_activity, ["approach_id"]), (activities, ["activity_id"]))
    return O.keep_first(got, list(order), [F.coalesce(F.col(c), F.lit("")) for c in order])


def d3fend_core(core: DataFrame, mappings: DataFrame, key: str = "ID", tactic: str = "D3FEND Tactic", levels: Sequence[str] = ("D3FEND Technique", "D3FEND Technique Level 0", "D3FEND Technique Level 1"), label: str = "label") -> DataFrame:
    """Techniques with their lowest label, filled hierarchy and path text, joined with mappings by label."""
    named = clean_table(core).withColumn("label", T.lowest_label([F.col(f"`{c}`") for c in reversed(levels)]))
    filled = O.hierarchical_fill(named, [tactic, levels[0]], "source_row")
    pathed = filled.withColumn("path_text", T.path_text([F.col(f"`{c}`") for c in (tactic, *levels)]))
    return O.keep_first(J.label_join(pathed, mappings, "label", label), [key], ["source_row"])


def csf_core(core: DataFrame, levels: Sequence[str] = ("Function", "Category", "Subcategory")) -> DataFrame:
    """The filled hierarchy with the deepest id as ``csf_id``; one row per id."""
    filled = O.hierarchical_fill(clean_table(core), list(levels), "source_row")
    coded = filled.withColumn("csf_id", T.deepest_id([F.col(f"`{c}`") for c in levels])).dropna(subset=["csf_id"])
    return O.keep_first(coded, ["csf_id"], ["source_row"])


def cis_core(sheet: DataFrame, control: str = "CIS Control", safeguard: str = "CIS Safeguard", title: str = "Title") -> DataFrame:
    """Controls and safeguards under one ``cis_id``, with the control's title on its safeguards; one row per id."""
    rows = clean_table(sheet)
    rows = rows.withColumn(control, T.strip_apostrophe(F.col(f"`{control}`"))).withColumn(safeguard, T.strip_apostrophe(F.col(f"`{safeguard}`")))
    filled = O.forward_fill(rows.withColumn(control, T.blank_to_null(F.col(f"`{control}`"))), control, "source_row")
    titled = O.conditional_carry(filled, title, safeguard, "control_title", "source_row")
    return O.keep_first(titled.withColumn("cis_id", T.or_else(F.col(f"`{safeguard}`"), F.col(f"`{control}`"))).dropna(subset=["cis_id"]), ["cis_id"], ["source_row"])


def cis_csf_mapping(sheet: DataFrame, codes: dict[str, str] = CSF_CODES) -> DataFrame:
    """``cis_id, csf_id`` of the mapping sheet, whichever of its published header variants it has.

    A blank subcategory stands for the function; rows without either go.
    """
    rows = clean_table(sheet)
    pick = lambda *names: F.col(f"`{N.pick(rows.columns, *names)}`")
    control, sub = pick("CIS Control", "CIS control"), pick("CIS Sub-Control", "CIS Safeguard", "CIS Sub-control")
    function, category = pick("Security Function", "NIST CSF Function"), pick("Subcategory", "NIST CSF", "CSF Subcategory")
    ids = T.or_else(T.strip_apostrophe(sub), T.blank_to_null(T.strip_apostrophe(control)))
    csf = T.or_else(F.when(F.lower(category) != "nan", category), T.code_map(function, codes, lower=True))
    return rows.select(ids.alias("cis_id"), csf.alias("csf_id")).dropna(subset=["cis_id", "csf_id"])


#: Table-level transforms by name, as a saved config names them.
TABLE_TRANSFORMS = {
    "tag-aggregation": A.tags,
    "hierarchical-ffill": O.hierarchical_fill,
    "preamble-extraction": O.header_pairs,
    "id-normalization": lambda df, col: df.withColumn(col, T.normalize_id(F.col(f"`{col}`"))),
}
