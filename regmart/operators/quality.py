"""Rules that emit issue rows, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")
LEVELS = ("publishable", "warningOnly", "blocked")


def issue_if(one_row: DataFrame, condition: Column, code: str, severity: str, status: str) -> DataFrame:
    return one_row.filter(condition).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(status).alias("status"))


def source_rules(flow: DataFrame, balance: DataFrame, result: DataFrame, control: DataFrame, period: str = "period") -> DataFrame:
    """Presence and period rules: each source is aggregated once, all rules look at one row."""
    def one(df: DataFrame, n: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{n}_n"), F.count_distinct(period).alias(f"{n}_p") if period in df.columns else F.lit(0).alias(f"{n}_p"))

    row = reduce(lambda a, b: a.crossJoin(b), [one(d, n) for d, n in ((flow, "f"), (balance, "b"), (result, "r"), (control, "c"))])  # one row each
    c = F.col
    rules = [
        ((c("f_n") == 0) & (c("b_n") == 0), "NO_PRIMARY_SOURCE_PROVIDED", "critical", "failed"), (c("f_n") == 0, "PREMIUM_SOURCE_NOT_PROVIDED", "medium", "warning"),
        (c("b_n") == 0, "FINANCIAL_SOURCE_NOT_PROVIDED", "medium", "warning"), (c("r_n") == 0, "INCOME_STATEMENT_SOURCE_NOT_PROVIDED", "low", "warning"),
        (c("r_n") > 0, "INCOME_STATEMENT_DETECTED_NON_OPERATIONAL", "low", "warning"), (c("f_p") > 1, "PREMIUM_MULTIPLE_PERIODS", "high", "failed"),
        (c("b_p") > 1, "FINANCIAL_MULTIPLE_PERIODS", "high", "failed"), (c("r_p") > 1, "INCOME_STATEMENT_MULTIPLE_PERIODS", "high", "failed"), (c("c_n") == 0, "REFERENCE_WORKBOOK_NOT_PROVIDED", "low", "warning"),
    ]
    listed = F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(st).alias("status"))) for cond, code, sev, st in rules])
    return row.select(F.explode(F.array_compact(listed)).alias("x")).select("x.*")


def duplicates(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Second and later rows of each natural key."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("occurrence > 1")


def duplicate_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Natural keys that repeat, with the number of rows beyond the first: partial counts, no row travels."""
    return rows.groupBy(*key).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def severity_counts(issues: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A column for each severity, present or not."""
    return issues.groupBy(*(by or [])).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def publishability(severity: Column, strict: bool = True) -> Column:
    """Aggregate level over issue rows: strict for validation (high blocks), lenient for reconciliation (high warns)."""
    rank = F.max(F.when(severity == "critical", 2).when(severity == "high", 2 if strict else 1).when(severity == "medium", 1).otherwise(0))
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(rank, F.lit(0)) + 1)


def worse(a: Column, b: Column) -> Column:
    levels = F.array(*map(F.lit, LEVELS))
    return F.element_at(levels, F.greatest(F.array_position(levels, a), F.array_position(levels, b)).cast("int"))


def _issue(code: str, severity: str, status: str) -> list[Column]:
    return [F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(status).alias("status")]


def alias_issues(rows: DataFrame, context: str) -> DataFrame:
    """An issue for every row (strategy, target) whose alias is ambiguous or unresolved in its context."""
    code = F.concat(F.lit(f"{context}_ALIAS_"), F.upper("strategy")).alias("code")
    return rows.filter("target IS NULL").select("*", code, F.lit("high").alias("severity"), F.lit("failed").alias("status"))


def markers_missing(rows: DataFrame, by: list[str], text: Column, markers: tuple[str, ...]) -> DataFrame:
    """An issue for every group of which no text holds any of the markers."""
    any_of = None
    for m in markers:
        any_of = text.contains(m) if any_of is None else any_of | text.contains(m)
    missing = rows.groupBy(*by).agg(F.bool_or(F.coalesce(any_of, F.lit(False))).alias("found")).filter(~F.col("found"))
    return missing.select(*by, *_issue("INCOME_STATEMENT_MARKERS_MISSING", "high", "failed"))


def sheet_missing(rows: DataFrame, by: list[str], is_ranking: Column) -> DataFrame:
    """An issue for every group without a ranking sheet."""
    missing = rows.groupBy(*by).agg(F.bool_or(F.coalesce(is_ranking, F.lit(False))).alias("found")).filter(~F.col("found"))
    return missing.select(*by, *_issue("REFERENCE_RANKING_MISSING", "medium", "warning"))
