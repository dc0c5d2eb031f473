"""Column names: cleaning, styles and lookup (PRJ-4 to PRJ-10).  Only names are touched, never rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame


def sanitize(name: str) -> str:
    return re.sub(r"[^\w-]", "", re.sub(r"[\s/]+", "_", name.strip().lower()))


def key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def fingerprint_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "_", name.lower().strip())


def snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def one_line(name: str) -> str:
    return re.sub(r"\s+", " ", name).strip()


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)) if w]


#: Key naming styles.
STYLES: dict[str, Callable[[str], str]] = {
    "as-is": str,
    "lowercase": str.lower,
    "snake_case": lambda n: "_".join(map(str.lower, _words(n))),
    "kebab-case": lambda n: "-".join(map(str.lower, _words(n))),
    "camelCase": lambda n: "".join(w.lower() if not i else w[:1].upper() + w[1:].lower() for i, w in enumerate(_words(n))),
}


def rename(df: DataFrame, style: str | Callable[[str], str]) -> DataFrame:
    """``df`` with every name in the given style; one that another column has, in any case, gets the first number that makes it its own."""
    how, taken, out = STYLES[style] if isinstance(style, str) else style, set(), []
    wanted = [how(c) for c in df.columns]
    for name in wanted:
        n, new = 1, name
        while new.lower() in taken or (n > 1 and new in wanted):
            n += 1
            new = f"{name}_{n}"
        taken.add(new.lower())
        out.append(new)
    return df.toDF(*out)


def pick(columns: Sequence[str], *candidates: str) -> str:
    """The first candidate among the columns."""
    found = next((c for c in candidates if c in columns), None)
    if found is None:
        raise KeyError(f"none of {candidates} in {list(columns)}")
    return found
