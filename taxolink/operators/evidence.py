"""Evidence links: checks, freshness, work queues and interchange rows (2.17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days before expiry from which evidence is stale.
STALE_DAYS = 30


#: The fields of an evidence link, and what enumerated ones may hold.
FIELDS = "link_type string, evidence string, control string, framework string, status string, confidence double, evidence_type string, method string, reviewer string, review_date date, responsible string, collected date, expires date"
ALLOWED = {
    "link_type": ("evidence-control",),
    "status": ("implemented", "partial", "planned", "alternative", "not-applicable"),
    "evidence_type": ("policy-document", "automated-scan", "test-result", "configuration", "log-export", "interview", "architecture-review", "attestation"),
    "method": ("EXAMINE", "INTERVIEW", "TEST"),
}


def valid_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)`` of evidence links with the fields of ``FIELDS``; quarantined ones say in ``problems`` what is wrong.

    Link type, evidence and control are required; confidence is within 0 and 1; nothing expires before it was collected.
    """
    tests = {f"no {c}": F.col(c).isNull() for c in ("link_type", "evidence", "control")}
    tests |= {f"unknown {c}": ~F.col(c).isin(*values) for c, values in ALLOWED.items()}
    tests |= {"confidence": ~F.col("confidence").between(0, 1), "expires before collected": F.col("expires") < F.col("collected")}
    found = edges.withColumn("problems", F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items())), lambda x: x.isNotNull()))
    return found.where(F.size("problems") == 0).drop("problems"), found.where(F.size("problems") > 0)


def checked(edges: DataFrame, required: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)``: required fields are set and enumerated ones (null allowed) have a known value."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    for c, values in allowed.items():
        ok = ok & (F.col(c).isNull() | F.col(c).isin(*values))
    return edges.where(ok), edges.where(~ok)


def freshness(collected: Column, expires: Column, today: Column, window: int = STALE_DAYS) -> Column:
    return F.when(collected.isNull() | expires.isNull(), "not-set").when(expires < today, "expired").when(F.date_sub(expires, window) <= today, "stale").otherwise("fresh")


def work_queue(edges: DataFrame, by: Sequence[str], status: Sequence[str] = ("stale", "expired")) -> DataFrame:
    """Links to work on, counted per group and status."""
    return edges.where(F.col("freshness").isin(*status)).groupBy(*by, "freshness").agg(F.count("*").alias("n"))


def name_id(namespace: str, name: Column) -> Column:
    """A deterministic UUID text (version 5 layout) of a name within a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def interchange(edges: DataFrame, control: str, fields: Sequence[str], order: str, namespace: str) -> DataFrame:
    """``control, id, components``: nested rows as JSON, one per control."""
    got = edges.groupBy(control).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("c"))
    return got.select(control, name_id(namespace, F.col(control).cast("string")).alias("id"), F.to_json("c").alias("components"))
