"""Declared column transforms by name (2.13), and a registry for one's own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolink.functions import text as T

_items = lambda c, by=",": F.transform(F.split(c, "\\Q" + by + "\\E", -1), T.strip)
_slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")

#: Each takes the column and the transform's own arguments.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "trim": lambda c: T.strip(c),
    "lowercase": lambda c: F.lower(c),
    "uppercase": lambda c: F.upper(c),
    "titlecase": lambda c: F.initcap(c),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)),
    "regex_extract": lambda c, pattern, group=1: F.nullif(F.regexp_extract(c, pattern, group), F.lit("")),
    "prefix": lambda c, s: F.concat(F.lit(s), c),
    "suffix": lambda c, s: F.concat(c, F.lit(s)),
    "split": lambda c, by=",": _items(c, by),
    "join": lambda c, by=", ": F.array_join(c, by),
    "unique": lambda c: F.array_distinct(c),
    "filter": lambda c, pattern: F.filter(c, lambda x: x.rlike(pattern)),
    "first": lambda c: F.try_element_at(c, F.lit(1)),
    "last": lambda c: F.try_element_at(c, F.lit(-1)),
    "map": lambda c, name, *args: F.transform(c, lambda x: TRANSFORMS[name](x, *args)),
    "to_number": lambda c: T.to_number(c),
    "to_boolean": lambda c: F.when(F.lower(T.strip(c)).isin("true", "yes", "1"), True).when(F.lower(T.strip(c)).isin("false", "no", "0"), False),
    "to_date": lambda c, form: F.to_date(F.try_to_timestamp(c, F.lit(form))),
    "to_tags": lambda c, prefix, by=",": F.transform(F.filter(_items(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(f"#{prefix}/"), _slug(x))),
    "to_wikilinks": lambda c, by=",": F.transform(F.filter(_items(c, by), lambda x: x != ""), lambda x: T.link(x)),
    "if_empty": lambda c, value: F.coalesce(T.blank_to_null(c), F.lit(value)),
    "if_matches": lambda c, pattern, then, other: F.when(c.rlike(pattern), F.lit(then)).otherwise(F.lit(other)),
    "coalesce": lambda c, *others: F.coalesce(T.blank_to_null(c), *(T.blank_to_null(F.col(o)) for o in others)),
    "tag_prefix": lambda c, prefix: T.prefix_tags(c, prefix),
    "id_normalization": lambda c: T.normalize_id(c),
}


def register(name: str, make: Callable[..., Column]) -> None:
    """Add a transform of one's own; ``make`` takes a Column first and may wrap a pandas UDF."""
    TRANSFORMS[name] = make


def apply(df: DataFrame, rules: Sequence[tuple[str, str, str, Sequence]]) -> DataFrame:
    """One projection for all ``rules (output, column, transform, arguments)``; ``template`` takes its text as argument."""
    made = [
        (T.template(args[0], df.columns) if name == "template" else TRANSFORMS[name](F.col(f"`{col}`"), *args)).alias(out) for out, col, name, args in rules
    ]
    replaced = {out for out, *_ in rules}
    return df.select(*(f"`{c}`" for c in df.columns if c not in replaced), *made)


def lookup(df: DataFrame, col: str, table: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``out``: the value that ``table`` has for the column, null if none; the least value where a key repeats."""
    one = table.groupBy(F.col(key).alias("_tk")).agg(F.min(value).alias(out))
    return df.join(one, F.col(col) == F.col("_tk"), "left").drop("_tk")
