"""What lists, status pages and publications show of versions, runs, audit events and domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regmart.operators.quality import _issue

# What an account text of a result statement says, by the first of these that it holds.
SEMANTICS = [("RESULTADO NETO", "netIncome"), ("UTILIDAD", "netIncome"), ("PRIMAS RETENIDAS", "retainedPremiums"), ("INGRESOS FINANCIEROS", "financialIncome"), ("GASTO", "expenses"), ("EGRESO", "expenses")]
# Domains, whether one that is provided can be published, and why it is not there, absent and provided.
DOMAINS = [
    ("premiums", True, "Premium workbook not provided in this publication.", None),
    ("financialPosition", True, "Financial position workbook not provided in this publication.", None),
    ("claims", False, "Claims raw source is not available in phase 1.", "Claims raw source is not available in phase 1."),
    ("incomeStatement", False, "Income statement is not part of the current operational publication policy.", "Income statement workbook was detected, but current publication policy only operationalizes premiums and financial position."),
    ("reference", False, "Reference workbook was not supplied; reconciliation is limited or skipped.", None),
]
# What is derived from a domain that can be published.
DERIVED = [("premiums", "KPIs de primas"), ("premiums", "participación de mercado"), ("premiums", "rankings de primas"), ("premiums", "primas por ramo"), ("financialPosition", "activos totales"), ("financialPosition", "patrimonio"), ("financialPosition", "reservas técnicas"), ("financialPosition", "rankings de activos, patrimonio y reservas")]
VERSION_FIELDS = ("version_id", "run_id", "status", "created_at", "published_at", "uploaded_by", "periods", "scope", "availability")


def semantic_category(account: Column) -> Column:
    upper = F.upper(account)
    return reduce(lambda rest, x: F.when(upper.contains(x[0]), x[1]).otherwise(rest), reversed(SEMANTICS), F.lit("other"))


def availability(counts: DataFrame, by: str = "scope") -> DataFrame:
    """by, domain, provided, records, publishable and reason: a row for each group of ``counts`` (by, domain, records) and domain; claims are never provided, a control file counts as one record."""
    known = counts.sparkSession.createDataFrame(DOMAINS, "domain string, may boolean, absent string, present string")
    grid = counts.select(by).distinct().select(by, F.explode(F.array(*[F.lit(d[0]) for d in DOMAINS])).alias("domain")).join(F.broadcast(known), "domain")  # five rows
    found = grid.join(counts, [by, "domain"], "left")
    has = (F.coalesce("records", F.lit(0)) > 0) & (F.col("domain") != "claims")
    records = F.when(has & (F.col("domain") == "reference"), 1).when(has, F.col("records")).otherwise(0).cast("long")
    return found.select(by, "domain", has.alias("provided"), records.alias("records"), (has & F.col("may")).alias("publishable"), F.when(has, F.col("present")).otherwise(F.col("absent")).alias("reason"))


def derived_artifacts(rows: DataFrame, by: str = "scope") -> DataFrame:
    """by and the list of what is derived, from rows of ``availability``."""
    def when(domain: str) -> Column:
        return F.bool_or((F.col("domain") == domain) & F.col("publishable"))

    return rows.groupBy(by).agg(when("premiums").alias("p"), when("financialPosition").alias("f")).select(by, F.array_compact(F.array(*[F.when(F.col("p" if d == "premiums" else "f"), text) for d, text in DERIVED])).alias("derived"))


def audit_details(detail: Column) -> list[Column]:
    """Of an audit event's JSON detail a publishability that is text, and a text quality and mapping summary that are objects; all else, broken JSON included, is left out."""
    v = F.try_parse_json(detail)

    def kept(key: str, kind: str) -> Column:
        part = F.try_variant_get(v, f"$.{key}", "variant")
        fits = F.schema_of_variant(part).startswith(kind)
        return F.when(fits, F.try_variant_get(v, f"$.{key}", "string")).alias(key)

    return [kept("publishability", "STRING"), kept("textQualitySummary", "OBJECT"), kept("mappingSummary", "OBJECT")]


def top_repairs(events: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent repairs among events (domain, strategy, raw, repaired, normalized, target, name, required): matches after normalization, by their six-part key."""
    key = ["domain", "strategy", "raw", "repaired", "normalized", "target"]
    found = events.filter(F.col("strategy").startswith("normalized") & F.col("required") & F.col("target").isNotNull() & F.col("name").isNotNull())
    return found.groupBy(*key).agg(F.min("name").alias("name"), F.count("*").alias("n")).orderBy(F.desc("n"), "domain", "name", *key[1:]).limit(top)


def examples(events: DataFrame, position: list[Column], top: int = 8) -> DataFrame:
    """The first examples of each outcome among the distinct (domain, strategy, raw, target, scope)."""
    key = ["domain", "strategy", "raw", "target", "scope"]
    firsts = events.groupBy(*key).agg(F.min(F.struct(*position)).alias("first"))
    order = Window.partitionBy("strategy").orderBy("first", *key)
    return firsts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top).select(*key, "position")


def operational_status(versions: DataFrame, latest: int = 3) -> DataFrame:
    """area, position, id, status: the newest runs (by creation) and the newest published versions (by publication, then creation)."""
    runs = versions.orderBy(F.desc("created"), F.desc("id")).limit(latest).select(F.lit("runs").alias("area"), F.col("created").alias("at"), "id", "status")
    shown = versions.filter("published is not null").orderBy(F.desc("published"), F.desc("id")).limit(latest).select(F.lit("versions").alias("area"), F.col("published").alias("at"), "id", "status")
    order = Window.partitionBy("area").orderBy(F.desc("at"), F.desc("id"))  # six rows
    return runs.unionByName(shown).select("area", F.row_number().over(order).alias("position"), "id", "status")


def account_missing(rows: DataFrame, by: list[str], account: Column, wanted: str) -> DataFrame:
    """An issue for every group of balance rows without the account."""
    missing = rows.groupBy(*by).agg(F.bool_or(F.coalesce(account == wanted, F.lit(False))).alias("found")).filter(~F.col("found"))
    return missing.select(*by, *_issue("FINANCIAL_TOTAL_ASSETS_MISSING", "critical", "failed"))


def duplicate_issues(rows: DataFrame, key: list[Column], order: list[str], scope: Column) -> DataFrame:
    """An issue for the second and every later row of a natural key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("occurrence", place).filter("occurrence > 1").select(scope.alias("scope"), *_issue("PREMIUM_DUPLICATE_NATURAL_KEY", "critical", "failed"))


def preview(facts: DataFrame, by: str, order: list[Column], shown: Column, top: int = 20) -> DataFrame:
    """by and the first facts of each group in their order, as a list."""
    window = Window.partitionBy(by).orderBy(*order)
    first = facts.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= top)
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("fact")))), lambda x: x["fact"]).alias("preview"))
