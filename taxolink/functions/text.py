"""String, identifier, type and format expressions (inventory 2.10)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense (fixed values).
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(WS))


def blank_to_null(c: Column) -> Column:
    """Stripped text; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean(c: Column) -> Column:
    """Stripped text; empty where null."""
    return F.coalesce(strip(c), F.lit(""))


def smart_quotes(c: Column) -> Column:
    return F.translate(c, "’“”", "'\"\"")


def yaml_text(c: Column) -> Column:
    """Plain quotes; several lines become a literal block with two spaces of indent, one line is stripped."""
    q = smart_quotes(c)
    block = F.concat(F.lit("|-\n  "), F.regexp_replace(F.regexp_replace(q, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r", "\n  "))
    return F.when(F.contains(q, F.lit("\n")), block).otherwise(strip(q))


def cumulative_path(c: Column, delimiters: str = ".-(", legacy: bool = False) -> Column:
    """``ID.AM-1`` -> ``[ID, ID.AM, ID.AM-1]``; with ``legacy`` the whole code follows every prefix and ends nothing.

    Repeated delimiters give no repeated prefixes; a null code gives null.
    """
    inside = "[" + re.escape(delimiters) + "]"
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(1)).rlike(inside))
    prefixes = F.transform(at, lambda i: F.substring(c, F.lit(1), i - 1))
    if legacy:
        return F.flatten(F.transform(prefixes, lambda p: F.array(p, c)))
    return F.when(c.isNotNull(), F.array_distinct(F.filter(F.concat(prefixes, F.array(c)), lambda p: F.length(p) > 0)))


def split_path(c: Column) -> Column:
    return F.split(c, "[.-]")


def deepest_id(cols: Sequence[Column]) -> Column:
    """The identifier before a colon in the deepest level that has one; levels go from the top down."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, r"\(?([A-Z0-9\-.]+)\)?:", 1), F.lit("")) for c in reversed(cols)))


def lowest_label(cols: Sequence[Column]) -> Column:
    """The first label that is not blank; the deepest level comes first."""
    return F.coalesce(*map(blank_to_null, cols))


def normalize_id(c: Column) -> Column:
    """``AC-01`` -> ``AC-1``; text of another form is unchanged."""
    form = r"^([A-Za-z]+)-0?(\d+)"
    return F.when(c.rlike(form), F.concat(F.regexp_extract(c, form, 1), F.lit("-"), F.regexp_replace(F.regexp_extract(c, form, 2), r"^0+(?=\d)", ""))).otherwise(c)


def prefix_tags(c: Column, prefix: str = "cri") -> Column:
    return F.regexp_replace(c, r"#([\p{L}\p{N}_]+)", f"#{prefix}/$1")


def strip_apostrophe(c: Column) -> Column:
    return strip(F.regexp_replace(c, "^'+", ""))


def path_text(cols: Sequence[Column], keep_empty: bool = False) -> Column:
    """Levels joined by `` › ``; blank levels are skipped, or kept inside if ``keep_empty``."""
    if not keep_empty:
        return F.concat_ws(" › ", *map(blank_to_null, cols))
    return F.regexp_replace(F.concat_ws(" › ", *map(clean, cols)), r"^[ ›]+|[ ›]+$", "")


def or_else(a: Column, b: Column) -> Column:
    return F.coalesce(blank_to_null(a), b)


def code_map(c: Column, codes: Mapping[str, str], lower: bool = False) -> Column:
    """The code of a word, null if it has none."""
    entries = [F.lit(x) for k, v in codes.items() for x in (k.lower() if lower else k, v)]
    return F.try_element_at(F.create_map(*entries), F.lower(c) if lower else c)


def template(text: str, columns: Sequence[str], double: bool = True) -> Column:
    """``{{col}}`` (or ``{col}``) replaced by the column's text, null as empty; an unknown column is an error when the plan is built."""
    parts = re.split(r"\{\{\s*(.+?)\s*\}\}" if double else r"\{(\w+)\}", text)
    unknown = [p for p in parts[1::2] if p not in columns]
    if unknown:
        raise ValueError(f"unknown columns in template: {unknown}")
    return F.concat(*(F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def path_segment(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "-"), r"\s+", " ")
    return F.substring(F.trim(F.regexp_replace(x, r"^\.+|\.+$", "")), 1, 100)


def file_name(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "-"), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^\.+", ""), r"(?i)\.md$", ""))


def note_path(base: str, levels: Sequence[Column], name: Sequence[Column], row: Column) -> Column:
    """``base/level/.../name.md``; the first name that is not blank counts, else ``row-N``."""
    stem = F.coalesce(*(F.nullif(file_name(blank_to_null(n)), F.lit("")) for n in name), F.concat(F.lit("row-"), row.cast("string")))
    folders = [F.nullif(path_segment(blank_to_null(c)), F.lit("")) for c in levels]
    return F.concat_ws("/", *([F.lit(base)] if base else []), *folders, F.concat(stem, F.lit(".md")))


def parent_path(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*)/[^/]*$", 1)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+?)(\.md)?$", 1)


#: Names of columns that hold an identifier, in order of precedence.
ID_NAMES = ("id", "ID", "Id", "control_id", "Control ID", "ControlID", "identifier", "Identifier", "code", "Code", "key", "Key")


def source_id(columns: Sequence[str], row: Column, frontmatter: Mapping[str, str] | None = None) -> Column:
    """The row's identifier: a mapped column whose own or output name is an id name, then an id column, then ``row-N``."""
    names = {n.lower() for n in ID_NAMES}
    mapped = [c for c, k in (frontmatter or {}).items() if c.lower() in names or k.lower() in names]
    found = [*mapped, *(n for n in ID_NAMES if n in columns)]
    return F.coalesce(*(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in found), F.concat(F.lit("row-"), row.cast("string")))


def content_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in sorted(columns)))), 256)


def last_level(c: Column) -> Column:
    parts = F.split(c, " / ", -1)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


#: Text that converts to a number: decimal or exponent form, infinity, or hexadecimal.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_number(c: Column) -> Column:
    x = strip(c)
    return F.coalesce(x.rlike(NUMBER) | x.rlike(r"^[+-]?Infinity$") | x.rlike(r"^0[xX][0-9a-fA-F]+$"), F.lit(False))


def to_number(c: Column) -> Column:
    """A double, null where the text is not a number."""
    x = strip(c)
    return F.when(x.rlike(NUMBER) | x.rlike(r"^[+-]?Infinity$"), x.try_cast("double")).when(
        x.rlike(r"^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(x, 3, 64), 16, 10).cast("double")
    )


def to_boolean(c: Column) -> Column:
    """true, yes and 1 are true; every other text is false."""
    return F.lower(strip(c)).isin("true", "yes", "1")


def to_list(c: Column) -> Column:
    """Split at the first of comma, semicolon and line break that occurs; items are stripped."""
    pick = F.when(F.contains(c, F.lit(",")), F.split(c, ",", -1)).when(F.contains(c, F.lit(";")), F.split(c, ";", -1)).when(F.contains(c, F.lit("\n")), F.split(c, "\n", -1)).otherwise(F.array(c))
    return F.transform(pick, strip)


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def link(c: Column, markdown: bool = False) -> Column:
    return F.concat(F.lit("["), c, F.lit("]("), c, F.lit(")")) if markdown else F.concat(F.lit("[["), c, F.lit("]]"))


def framework_link(c: Column, prefix: str = "", alias: bool = False, markdown: bool = False) -> Column:
    target = strip(F.concat(F.lit(prefix), c))
    if markdown:
        return link(target, True)
    return F.concat(F.lit("[["), c, F.lit("-"), target, F.lit("|"), target, F.lit("]]")) if alias and prefix else link(target)


def body(c: Column, kind: str = "text") -> Column:
    """Body text as ``text``, ``code``, ``quote`` or ``list``."""
    lines = F.split(c, "\n", -1)
    made = {
        "text": c,
        "code": F.concat(F.lit("```\n"), c, F.lit("\n```")),
        "quote": F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), x)), "\n"),
        "list": F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"),
    }
    return made[kind]


def sections(heads: Sequence[tuple[str, Column]], level: int = 2) -> Column:
    """``## head`` and text of each section that is not blank."""
    return F.concat_ws("\n\n", *(F.when(blank_to_null(c).isNotNull(), F.concat(F.lit("#" * level + f" {h}\n"), c)) for h, c in heads))


def handle_array(c: Column, how: str = "as_array", by: str = ", ") -> Column:
    return {"as_array": c, "stringify": F.to_json(c), "first": F.try_element_at(c, F.lit(1)), "last": F.try_element_at(c, F.lit(-1)), "join": F.array_join(c, by)}[how]


def handle_empty(c: Column, how: str = "omit", default: str = "") -> Column:
    """What stands for a blank value: nothing (``omit``, ``null``), an empty string or a default."""
    x = blank_to_null(c)
    return x if how in ("omit", "null") else F.coalesce(x, F.lit("" if how == "empty_string" else default))


def tag_list(cols: Sequence[Column]) -> Column:
    """The distinct tags of all columns in order, null if there are none."""
    tags = F.array_sort(F.array_distinct(F.filter(F.split(F.concat_ws(" ", *cols), r"\s+"), lambda t: t != "")))
    return F.when(F.size(tags) > 0, tags)


def word_set(c: Column) -> Column:
    """Lower-cased tokens as a set; empty tokens at the ends count as one token."""
    return F.array_distinct(F.split(F.lower(strip(c)), r"[^\p{L}\p{N}]+", -1))
