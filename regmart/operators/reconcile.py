"""Reconciliation of actual totals against control totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regmart.functions.numbers import safe_ratio
from regmart.functions.text import normalize_text


def compared(rows: DataFrame, rule: str | Column, missing: str | None, tolerance: float = 0.001, periods_match: Column | bool = True) -> DataFrame:
    """Rows (actual, expected and others) with rule, severity, status and differences: without an expectation ``missing`` is the rule; beyond the tolerance a row warns, the more so where periods match."""
    diff = F.col("actual") - F.col("expected")
    rel = safe_ratio(diff, F.col("expected"))
    off = F.abs(rel) > tolerance
    same = F.lit(periods_match) if isinstance(periods_match, bool) else periods_match
    none = F.col("expected").isNull()
    return rows.withColumns({
        "rule": F.when(none, F.lit(missing)).otherwise(rule), "severity": F.when(none, "medium").when(off & same, "high").otherwise("low"), "status": F.when(none | off, "warning").otherwise("passed"),
        "absolute_difference": diff, "relative_difference": F.when(~none, rel),
    })


def reconcile(actual: DataFrame, control: DataFrame, key: str, rule: str, tolerance: float = 0.001, periods_match: bool = True, report_missing: bool = True, missing: str = "REFERENCE_PREMIUM_INSTITUTION_MISSING") -> DataFrame:
    """actual: key, actual; control: key, expected. A missing expectation is an issue of code ``missing``, or skipped; beyond the tolerance a row warns."""
    joined = actual.join(control, key, "left" if report_missing else "inner")
    return compared(joined, rule, missing, tolerance, periods_match).select(key, "rule", "severity", "status", "actual", "expected", "absolute_difference", "relative_difference")


def reconcile_names(actual: DataFrame, control: DataFrame, name: str, rule: str, tolerance: float = 0.001, periods_match: bool = True, report_missing: bool = True) -> DataFrame:
    """``reconcile`` on normalized names: case, blanks and damaged letters do not keep a total from its control; of controls alike in name the last (``position``) counts."""
    last = control.groupBy(normalize_text(F.col(name)).alias(name)).agg(F.max_by("expected", "position").alias("expected"))
    return reconcile(actual.withColumn(name, normalize_text(F.col(name))), last, name, rule, tolerance, periods_match, report_missing)


def not_provided(control: DataFrame) -> DataFrame:
    """One warning where there are no control totals; reconciliation stops there."""
    return control.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("REFERENCE_NOT_PROVIDED").alias("code"), F.lit("low").alias("severity"), F.lit("warning").alias("status"))


def with_tolerances(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """rows: key, actual, expected; rules: key, absolute, relative. A row warns where both differences pass its rule's tolerances."""
    diff = F.col("actual") - F.col("expected")
    off = (F.abs(diff) > F.col("absolute")) & (F.abs(safe_ratio(diff, F.col("expected"))) > F.col("relative"))
    return rows.join(F.broadcast(rules), key).withColumn("status", F.when(off, "warning").otherwise("passed"))


def consolidated(rows: DataFrame, group: str, key: str, rules: dict[object, str], tolerance: float = 0.001) -> DataFrame:
    """Reconciliation of groups (accounts) by key (entity) and over all keys: rows are exact sums ``actual`` and ``expected`` by group and key; ``rules`` names each group's rule. One grouping of the sums gives both levels; the row of a whole group has the key ``consolidated``."""
    sums = rows.rollup(group, key).agg(F.sum("actual").cast("double").alias("actual"), F.sum("expected").cast("double").alias("expected"), F.grouping_id().alias("level")).filter("level < 3")
    named = sums.withColumn(key, F.when(F.col("level") == 1, "consolidated").otherwise(F.col(key).cast("string")))
    rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col(group)]
    return compared(named, rule, None, tolerance).filter("rule IS NOT NULL").select(group, key, "rule", "severity", "status", "actual", "expected", "absolute_difference", "relative_difference")
