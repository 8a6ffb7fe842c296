"""Registered queries on ingest runs, their rules and reconciliation, evidence of resolutions, and stored records, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regmart.functions.numbers import money
from regmart.operators import aggregates, ingest, reconcile, resolve
from regmart.plans import bridge as b
from regmart.plans import reports
from regmart.plans.registry import ACCOUNTS, DEC
from regmart.sources import catalogs, records, roles
from regmart.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


_ENTITIES = [n for _, n in reports._canonical("entity")][:3]

# Rules by run: a customer is a run, its open, filled and pending orders are rows of its flow, balance and result, every third has a control file

_PRESENCE = [
    ("f_n = 0 AND b_n = 0", "NO_PRIMARY_SOURCE_PROVIDED", "critical", "failed", "ingestion"), ("f_n = 0", "PREMIUM_SOURCE_NOT_PROVIDED", "medium", "warning", "premiums"), ("b_n = 0", "FINANCIAL_SOURCE_NOT_PROVIDED", "medium", "warning", "financialPosition"),
    ("r_n = 0", "INCOME_STATEMENT_SOURCE_NOT_PROVIDED", "low", "warning", "incomeStatement"), ("r_n > 0", "INCOME_STATEMENT_DETECTED_NON_OPERATIONAL", "low", "warning", "incomeStatement"), ("f_p > 1", "PREMIUM_MULTIPLE_PERIODS", "high", "failed", "premiums"),
    ("b_p > 1", "FINANCIAL_MULTIPLE_PERIODS", "high", "failed", "financialPosition"), ("r_p > 1", "INCOME_STATEMENT_MULTIPLE_PERIODS", "high", "failed", "incomeStatement"), ("run % 3 <> 0", "REFERENCE_WORKBOOK_NOT_PROVIDED", "low", "warning", "reference"),
]
_COUNTS = ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {n}_n, count(DISTINCT CASE WHEN o_orderstatus = '{s}' THEN year(o_orderdate) END) AS {n}_p" for n, s in (("f", "O"), ("b", "F"), ("r", "P")))


@query("val_01_08_rules_by_run", f"WITH x AS (SELECT c_custkey AS run, {_COUNTS} FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) " + " UNION ALL ".join(f"SELECT run, '{code}' AS code, '{sev}' AS severity, '{status}' AS status, '{scope}' AS scope FROM x WHERE {cond}" for cond, code, sev, status, scope in _PRESENCE))
def _(spark, d):
    runs = b.read(spark, d, "customer").select(F.col("c_custkey").alias("run"))
    rows = b.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.year("o_orderdate").alias("period"), "o_orderstatus")
    return ingest.presence_rules(runs, *(rows.filter(F.col("o_orderstatus") == s) for s in ("O", "F", "P")), runs.filter("run % 3 = 0"))


# Evidence: names of customers as reported, every seventh with its letters damaged

_NAMES = [n for n in reports.POOLS["entity"] if "Ã" not in n]
_FORMAT = "trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '[/\\\\|]+', ' ', 'g'), '[().,]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_SPELLED = f"""r AS (SELECT id, orig, id % 7 = 0 AND orig <> strip_accents(orig) AS damaged FROM (SELECT c_custkey AS id, [n, lower(n), '  ' || n || ' ', n || '?', replace(n, ' ', '  /  ')][c_custkey // {len(_NAMES)} % 5 + 1] AS orig FROM (SELECT c_custkey, {reports._list(_NAMES)}[c_custkey % {len(_NAMES)} + 1] AS n FROM customer)))"""


@query("jn_07_evidence_columns", f"""WITH {_SPELLED}, known(alias, target) AS (VALUES {reports._SQL_KNOWN['entity']}), names AS ({reports._SQL_NAMES['entity']}), d AS (SELECT DISTINCT orig, damaged, {reports._ENTITY_KEY.format('orig')} AS key FROM r),
 hits AS (SELECT orig, damaged, 0 AS stage, target FROM d JOIN known ON orig = alias AND NOT damaged UNION ALL SELECT orig, damaged, 1, target FROM d JOIN names ON orig = alias AND NOT damaged
 UNION ALL SELECT orig, damaged, 2, target FROM d JOIN known ON key = {reports._ENTITY_KEY.format('alias')} UNION ALL SELECT orig, damaged, 3, target FROM d JOIN names ON key = {reports._ENTITY_KEY.format('alias')}),
 least AS (SELECT orig, damaged, min(stage) AS stage FROM hits GROUP BY ALL), c AS (SELECT hits.orig, hits.damaged, hits.stage, list_sort(list(DISTINCT target)) AS ids FROM hits JOIN least ON hits.orig = least.orig AND hits.damaged = least.damaged AND hits.stage = least.stage GROUP BY ALL),
 e AS (SELECT d.*, stage, coalesce(ids, []) AS ids, CASE WHEN stage IS NULL THEN 'unresolved' WHEN len(ids) > 1 THEN 'ambiguous' ELSE ['direct-alias', 'direct-canonical', 'normalized-alias', 'normalized-canonical'][stage + 1] END AS strategy FROM d LEFT JOIN c ON c.orig = d.orig AND c.damaged = d.damaged)
 SELECT id, strategy, CASE WHEN len(ids) = 1 THEN ids[1] END AS target, CASE WHEN len(ids) = 1 THEN names.alias END AS name, e.orig AS repaired, key AS normalized, array_to_string(ids, ',') AS candidate_ids, (SELECT count(*) FROM names n WHERE list_contains(ids, n.target)) AS candidate_names, e.damaged AS mojibake,
 CASE WHEN strategy LIKE 'direct%' THEN false WHEN strategy LIKE 'normalized%' THEN true ELSE e.damaged OR {_FORMAT.format('e.orig')} <> e.orig END AS required,
 CASE WHEN strategy = 'ambiguous' THEN ['direct-alias', 'direct-canonical', 'normalized-alias', 'normalized-canonical'][stage + 1] || '-matched-multiple-candidates' WHEN strategy = 'unresolved' THEN 'no-candidate' END AS reason
 FROM r JOIN e ON e.orig = r.orig AND e.damaged = r.damaged LEFT JOIN names ON names.target = ids[1]""")
def _(spark, d):
    i = F.col("c_custkey")
    n, spelling = F.element_at(F.array(*map(F.lit, _NAMES)), (i % len(_NAMES)).cast("int") + 1), (F.floor(i / len(_NAMES)) % 5).cast("int")
    spelled = F.when(spelling == 0, n).when(spelling == 1, F.lower(n)).when(spelling == 2, F.concat(F.lit("  "), n, F.lit(" "))).when(spelling == 3, F.concat(n, F.lit("?"))).otherwise(F.replace(n, F.lit(" "), F.lit("  /  ")))
    damaged = F.decode(F.encode(spelled, "UTF-8"), "ISO-8859-1")
    rows = b.read(spark, d, "customer").select(i.alias("id"), F.when(i % 7 == 0, damaged).otherwise(spelled).alias("raw"))
    found = resolve.evidence(catalogs.resolve_entities(rows), catalogs.entities(spark))
    shown = found.select("raw", "strategy", "target", "name", "repaired", "normalized", F.array_join("candidate_ids", ",").alias("candidate_ids"), F.size("candidate_names").cast("long").alias("candidate_names"), "mojibake", "required", "reason")
    return rows.join(shown, "raw").drop("raw")


# Issues in context: a third of the orders are rows of each kind


def _context_sql() -> str:
    parts = [(0, "premiums", 37, "institution", "INSTITUTION"), (0, "premiums", 41, "ramoParent", "INSURANCE_LINE"), (0, "premiums", 43, "ramo", "INSURANCE_LINE"), (1, "financialPosition", 37, "institution", "FINANCIAL_INSTITUTION"), (1, "financialPosition", 47, "account", "FINANCIAL_ACCOUNT"), (2, "incomeStatement", 37, "institution", "INCOME_STATEMENT_INSTITUTION")]
    return " UNION ALL ".join(f"SELECT o_custkey AS run, '{kind}:row:' || o_orderkey || ':{short}' AS scope, '{context}_ALIAS_UNRESOLVED' AS code, CASE WHEN '{short}' = 'account' THEN 'candidate-found-but-no-safe-resolution' ELSE 'no-candidate' END AS reason, CASE WHEN '{short}' = 'account' THEN 'PASIVOS' END AS candidates FROM orders WHERE o_orderkey % 3 = {k} AND o_orderkey % {n} = 0" for k, kind, n, short, context in parts)


@query("val_14_16_alias_contexts", _context_sql())
def _(spark, d):
    k = F.col("o_orderkey")
    bad = lambda n, wrong, right: F.when(k % n == 0, wrong).otherwise(right)
    rows = b.read(spark, d, "orders").select(
        F.col("o_custkey").alias("run"), k.alias("source_row"), (k % 3).alias("kind"), bad(37, "Nowhere", _ENTITIES[0]).alias("entity_name"), bad(41, "nothing", "Seguro de Vida").alias("parent"), bad(43, "naught", "Vida Individual").alias("category"),
        bad(47, "PASIVOS zzz", "PASIVOS").alias("account"), F.lit("999").alias("line"))
    kinds = {kind: rows.filter(F.col("kind") == i).drop("kind") for i, kind in enumerate(ingest.REFERENCES)}
    found = ingest.alias_issues(ingest.attempted(kinds))
    detail = F.from_json("detail", "reason string, candidate_names array<string>")
    return found.select("run", "scope", "code", detail["reason"].alias("reason"), F.nullif(F.array_join(detail["candidate_names"], ","), F.lit("")).alias("candidates"))


# Reconciliation by run: suppliers' lines are flow facts, customers' urgent orders total assets; three of four runs have a control file, some of them without a period

_REC_DIFF = "actual - expected AS absolute_difference, CASE WHEN expected = 0 THEN 0 ELSE (actual - expected) / expected END AS relative_difference"
_REC_OFF = "abs(CASE WHEN expected = 0 THEN 0 ELSE (actual - expected) / expected END) > 0.001"
_NO_VALUES = "CAST(NULL AS DOUBLE) AS expected, CAST(NULL AS DOUBLE) AS actual, CAST(NULL AS DOUBLE) AS absolute_difference, CAST(NULL AS DOUBLE) AS relative_difference"


@query("rec_01_06_by_run", f"""WITH runs AS (SELECT c_custkey AS run FROM customer), stated AS (SELECT run, CASE WHEN run % 10 > 0 THEN '1995-01' END AS stated FROM runs WHERE run % 4 > 0),
 f AS (SELECT l_suppkey AS run, 'E' || l_partkey % 5 AS entity, l_partkey % 5 AS n, '1995-0' || (l_suppkey % 3 + 1) AS own, {DEC.format('l_extendedprice')} AS actual FROM lineitem GROUP BY ALL),
 a AS (SELECT o_custkey AS run, 'E' || o_orderkey % 3 AS entity, o_orderkey % 3 AS n, CASE WHEN o_custkey % 5 > 0 THEN '1995-01' ELSE '1994-12' END AS own, arg_max(o_totalprice, o_orderkey) AS actual FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
 x AS (SELECT 'premiums' AS source, f.*, stated, CASE WHEN n < 4 THEN (f.run % 7 + 1) * 1e5 END AS expected, 'PREMIUM_TOTAL_BY_INSTITUTION' AS rule FROM f JOIN stated ON f.run = stated.run
  UNION ALL SELECT 'financialPosition', a.*, stated, (a.run % 7 + 1) * 2e5, 'ASSETS_TOTAL_BY_INSTITUTION' FROM a JOIN stated ON a.run = stated.run WHERE n < 2)
 SELECT run, 'REFERENCE_NOT_PROVIDED' AS rule, 'low' AS severity, 'warning' AS status, 'reference' AS scope, {_NO_VALUES} FROM runs WHERE run % 4 = 0
 UNION ALL SELECT DISTINCT f.run, 'PERIOD_MISMATCH_PREMIUM_REFERENCE', 'medium', 'warning', 'premiums', {_NO_VALUES} FROM f JOIN stated ON f.run = stated.run WHERE own <> stated
 UNION ALL SELECT run, CASE WHEN expected IS NULL THEN 'REFERENCE_PREMIUM_INSTITUTION_MISSING' ELSE rule END, CASE WHEN expected IS NULL THEN 'medium' WHEN {_REC_OFF} AND coalesce(own = stated, false) THEN 'high' ELSE 'low' END,
 CASE WHEN expected IS NULL OR {_REC_OFF} THEN 'warning' ELSE 'passed' END, source || ':' || entity, expected, actual, {_REC_DIFF} FROM x""")
def _(spark, d):
    runs = b.read(spark, d, "customer").select(F.col("c_custkey").alias("run"))
    stated = runs.filter("run % 4 > 0").select("run", F.when(F.col("run") % 10 > 0, "1995-01").alias("year_month"))
    entity = lambda n: F.concat(F.lit("E"), n.cast("string")).alias("entity")
    flow = b.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), entity(F.col("l_partkey") % 5), F.col("l_extendedprice").alias("amount"), F.concat(F.lit("1995-0"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("year_month"))
    own = F.when(F.col("o_custkey") % 5 > 0, "1995-01").otherwise("1994-12").alias("year_month")
    account = F.when(F.col("o_orderpriority") == ACCOUNTS["total_assets"], ingest.TOTAL_ASSETS_ID).otherwise("other").alias("account_id")
    balance = b.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), entity(F.col("o_orderkey") % 3), account, F.col("o_totalprice").alias("combined"), F.col("o_orderkey").alias("source_row"), own)
    told = lambda measure, n, unit: stated.select("run", F.lit(measure).alias("measure"), F.explode(F.array(*[F.lit(f"ENTITY {i}") for i in range(n)])).alias("key"), ((F.col("run") % 7 + 1) * F.lit(unit)).alias("expected"))
    names = spark.createDataFrame([(f"E{i}", f"Entity  {i}") for i in range(5)], "entity string, name string")
    return ingest.reconciled(runs, flow, balance, told("flow", 4, 1e5).unionByName(told("balance", 2, 2e5)), stated, names)


# Ingest: a customer with orders is a run; its number decides which files it has and what is wrong with them, its orders are their rows


def _exists(name: str) -> str:
    """Which runs have the file, in SQL that both engines read."""
    return {"f": "run % 7 <> 3", "g": "run % 19 = 0 AND run % 7 <> 3", "b": "run % 5 <> 2", "r": "run % 4 = 0", "x": "run % 29 = 0", "c": "run % 3 = 0"}[name]



def _uploads(spark, d) -> tuple[DataFrame, DataFrame]:
    """Files with their archive statistics, and the rows of their sheets."""
    rows = b.read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("k"))
    rows = rows.withColumn("row", F.row_number().over(reports.Window.partitionBy("run").orderBy("k")) + 1)
    rows = stored(rows)
    lit, txt = F.lit, lambda c: F.col(c).cast("string")
    entity = F.when(F.expr("run % 13 = 0"), _ENTITIES[0]).otherwise(F.element_at(F.array(*map(F.lit, _ENTITIES)), (F.col("k") % 3).cast("int") + 1))
    date = lambda n: F.when(F.expr(f"run % {n} = 0 AND k % 2 = 0"), "2025-11-30").otherwise("2025-12-31")
    values = {
        "f": [date(11), F.when(F.expr("run % 13 = 0"), "1").otherwise(txt("k")), F.when(F.expr("k % 37 = 0"), "Nowhere").otherwise(entity), lit("Seguro de Vida"), F.when(F.expr("k % 41 = 0"), "nothing").otherwise("Vida Individual"), lit("1"), lit("Nacional"), txt("k")],
        "b": [lit("A"), txt("k"), entity, date(1 << 40), lit("999"), F.when(F.expr("k % 43 = 0"), "PASIVOS zzz").when(F.expr("row = 2 AND run % 17 <> 0"), "TOTAL ACTIVOS").otherwise("PASIVOS"), txt("k"), lit("0.5")],
        "r": [lit("R"), txt("k"), F.when(F.expr("k % 47 = 0"), "Nobody").otherwise(entity), date(31), lit("1"), F.when(F.expr("run % 8 = 0"), "ROE").otherwise("UTILIDAD NETA"), txt("k"), lit("0")],
    }
    values["g"], values["x"] = values["f"], [txt("k")]
    where = {"f": ("Primas", roles.FLOW), "g": ("Primas", roles.FLOW), "b": ("Balance", roles.BALANCE), "r": ("ER", roles.RESULT), "x": ("Notes", None)}
    named = lambda name: F.concat_ws("-", F.col("run").cast("string"), F.lit(name)).alias("file")
    cells = lambda values, first: F.array(*[F.struct(F.lit(first + i).alias("col"), v.alias("value")) for i, v in enumerate(values)])
    line = lambda name, index, sheet, row, held: F.struct(named(name), F.lit(index).alias("sheet_index"), F.lit(sheet).alias("sheet"), row.alias("row"), held.alias("cells"))
    parts = []
    for name, (sheet, role) in where.items():
        own, heads = rows.filter(_exists(name)), list(role.headers) if role else ["anything"]
        parts.append(own.select(F.inline(F.array(line(name, 0, sheet, F.col("row"), cells(values[name], 1))))))
        parts.append(own.filter("row = 2").select(F.inline(F.array(line(name, 0, sheet, lit(1), cells(map(lit, heads), 1))))))
    runs = rows.filter("row = 2").select("run")
    sheets = ["1. Ramos Totales", "8. Primas y Siniestros Totales", "Descarga BG", "descarga app P&S", "Primas Diciembre 2025", "Balance Diciembre 2025", ingest.RANKING_SHEET]
    period = F.when(F.expr("run % 6 = 0"), "2025-11").otherwise("2025-12")
    at = lambda i, row, first, *held: line("c", i, sheets[i], lit(row), cells(held, first))
    listed = [at(i, 1, 1, lit("x")) for i in range(3)] + [at(3, 1, 2, period), F.when(F.expr("run % 9 <> 0"), at(6, 1, 1, lit("x")))]
    listed += [at(4, 11, 3, *map(lit, _ENTITIES[:2])), at(4, 61, 3, lit("1"), lit("1")), at(5, 9, 5, *map(lit, _ENTITIES[:2])), at(5, 10, 5, lit("2"), lit("2"))]
    table = ingest.union([*parts, runs.filter(_exists("c")).select(F.inline(F.array(*listed))).filter("file IS NOT NULL")])
    flags = {"size": F.lit(1000), "is_archive": F.lit(True), "entries": F.lit(9), "compressed": F.lit(500), "inflated": F.lit(5000), "macro": F.expr("run % 23 = 0 AND run % 5 <> 2"), "encrypted": F.lit(False), "protected": F.expr("run % 21 = 0")}
    files = runs.select("run", F.explode(F.array_compact(F.array(*[F.when(F.expr(_exists(n)), F.lit(n)) for n in "fgbrxc"]))).alias("n"))
    files = files.select("run", F.concat_ws("-", F.col("run").cast("string"), "n").alias("file"), F.concat("n", F.lit(".xlsx")).alias("name"), F.lit("application/octet-stream").alias("mime"), *[v.alias(k) for k, v in flags.items()])
    return files, table


_CRITICAL_B = "(b AND NOT assets)"
_SQL_INGEST = f"""o AS (SELECT o_custkey AS run, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS line FROM orders),
 w AS (SELECT run, {', '.join(f"{_exists(n)} AS {n}" for n in 'fgbrxc')}, count(*) AS n, count(*) FILTER (k % 37 = 0) AS lost_f, count(*) FILTER (k % 41 = 0) AS lost_c, count(*) FILTER (k % 43 = 0) AS lost_a, count(*) FILTER (k % 47 = 0) AS lost_r,
  count(*) FILTER (k % 37 = 0 OR k % 41 = 0) AS bad_f, bool_or(line = 2 AND run % 17 <> 0 AND k % 43 <> 0) AS assets, count(DISTINCT k % 2) AS halves,
  count(*) - count(DISTINCT (CASE WHEN run % 11 = 0 THEN k % 2 ELSE 0 END, k % 37 = 0, CASE WHEN run % 13 = 0 THEN 0 ELSE k % 3 END, k % 41 = 0)) AS again,
  bool_or(k % 37 <> 0 AND k % 41 <> 0) AS facts_f, bool_or(k % 43 <> 0) AS facts_b FROM o GROUP BY run),
 g AS (SELECT *, CASE WHEN run % 23 = 0 AND run % 5 <> 2 THEN 'security-gate' WHEN x THEN 'classification-gate' WHEN g THEN 'duplicate-role-gate' END AS gate, (CAST(f AS INT) + CAST(g AS INT) + CAST(b AS INT) + CAST(r AS INT) + CAST(x AS INT) + CAST(c AS INT)) AS n_files FROM w),
 e AS (SELECT run, CASE WHEN run % 13 = 0 THEN 0 ELSE k % 3 END AS e, count(*) FILTER (k % 37 <> 0 AND k % 41 <> 0) AS n_f, sum(k) FILTER (k % 37 <> 0 AND k % 41 <> 0) AS s, arg_max(k, line) FILTER (line = 2 AND run % 17 <> 0 AND k % 43 <> 0) AS a FROM o GROUP BY ALL)"""


@query("snk_05_ingest_runs", f"""WITH {_SQL_INGEST}, first AS (SELECT run, k FROM o WHERE line = 2),
 v AS (SELECT g.run, gate, CASE WHEN gate = 'security-gate' THEN n_files WHEN gate IS NOT NULL THEN 1 ELSE CAST(NOT f AND NOT b AS INT) + CASE WHEN f AND run_13 THEN again ELSE 0 END + CAST({_CRITICAL_B} AS INT) END AS critical,
  CASE WHEN run_21 THEN n_files ELSE 0 END + CASE WHEN gate IS NULL THEN CASE WHEN f THEN lost_f + lost_c + CAST(g.run % 11 = 0 AND halves > 1 AS INT) ELSE 0 END + CASE WHEN b THEN lost_a ELSE 0 END
   + CASE WHEN r THEN lost_r + CAST(g.run % 31 = 0 AND halves > 1 AS INT) + CAST(g.run % 8 = 0 AS INT) ELSE 0 END ELSE 0 END AS high,
  CASE WHEN gate IS NULL THEN CAST(NOT f AS INT) + CAST(NOT b AS INT) + CAST(c AND g.run % 9 = 0 AS INT) ELSE 0 END AS medium, CASE WHEN gate IS NULL THEN 1 + CAST(NOT c AS INT) ELSE 0 END AS low, f, b, c, n_files
  FROM (SELECT *, run % 13 = 0 AS run_13, run % 21 = 0 AS run_21 FROM g) g),
 q AS (SELECT v.*, CASE WHEN gate IS NOT NULL OR critical + high > 0 THEN 'blocked' WHEN medium > 0 THEN 'warningOnly' ELSE 'publishable' END AS validation FROM v),
 t AS (SELECT q.run, bool_or(CASE WHEN f AND n_f > 0 THEN e.e = 2 OR stated <> own OR abs(s - 1000) / 1000 > 0.001 ELSE false END OR CASE WHEN b AND a IS NOT NULL AND e.e < 2 THEN stated = '2025-12' AND abs(a + 0.5 - 2000) / 2000 > 0.001 ELSE false END) AS warns
  FROM q JOIN e ON e.run = q.run JOIN (SELECT run, CASE WHEN run % 6 = 0 THEN '2025-11' ELSE '2025-12' END AS stated, CASE WHEN run % 11 = 0 AND k % 2 = 0 THEN '2025-11' ELSE '2025-12' END AS own FROM first) p ON p.run = q.run WHERE c AND gate IS NULL GROUP BY 1)
 SELECT q.run, CASE WHEN gate IS NULL THEN 'staged' ELSE 'failed' END AS status, gate, validation, CASE WHEN warns THEN 'warningOnly' ELSE 'publishable' END AS reconciliation, CASE WHEN validation = 'publishable' AND warns THEN 'warningOnly' ELSE validation END AS publishability,
 CAST(critical AS BIGINT) AS critical, CAST(high AS BIGINT) AS high, CAST(medium AS BIGINT) AS medium, CAST(low AS BIGINT) AS low FROM q LEFT JOIN t ON t.run = q.run WHERE q.n_files > 0""")
def _(spark, d):
    return ingest.ingest(*_uploads(spark, d)).runs


# Stored records: orders as records of three shapes, a quarter of them broken

_CODES = ("RECORD_UNREADABLE", "VERSION_ID_MISSING", "STATUS_UNKNOWN", "CREATED_AT_INVALID", "PUBLISHED_AT_MISSING")


def _records(spark, d) -> DataFrame:
    k, n = F.col("o_orderkey"), F.lit(None).cast("string")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    shape, fault = k % 4, F.when(k % 4 == 3, k % 5)
    new = F.struct((k % 5).alias("fallbackByLineNumber"), F.lit(99).alias("lineNumberFallback"), (k % 3).alias("unresolvedAliases"), (k % 11).alias("totalAttempts"), F.struct((k % 2).alias("ambiguousAliases")).alias("textQuality"), F.array(*[F.struct(F.lit("institution").alias("domain"), F.lit(i).alias("count")) for i in range(7)]).alias("topAliasRepairs"))
    old = F.struct((k % 5).alias("lineNumberFallback"), (k % 3).alias("unresolved"), F.lit("12").alias("totalAttempts"))
    issues = F.array(F.struct(F.lit("OTHER").alias("code"), F.lit("medium").alias("severity")), F.struct(F.when(k % 8 == 0, records.CLASSIFICATION).otherwise("ANOTHER").alias("code"), F.lit("low").alias("severity")))
    fields = {
        "datasetVersionId": F.when(fault == 1, n).otherwise(F.concat(F.lit("v"), k.cast("string"))), "ingestionRunId": F.when(shape != 2, F.concat(F.lit("r"), k.cast("string"))), "createdAt": F.when(fault == 3, "soon").otherwise(at),
        "status": F.when(fault == 2, "odd").when((shape == 0) | (fault == 4), "published").when(shape == 2, "staged"), "publishedAt": F.when(shape == 0, at), "datasetScope": F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string")),
        "mappingSummary": F.when(shape == 0, F.to_json(new)).when(shape == 1, F.to_json(old)), "sourceFiles": F.when(shape == 0, F.to_json(F.array(F.struct(F.concat(F.lit("f"), k.cast("string")).alias("sourceFileId"), n.alias("kind")), F.struct(n.alias("sourceFileId"), F.lit("x").alias("kind"))))),
        "validationSummary": F.when(shape < 2, F.to_json(F.struct(F.when(k % 6 == 0, "blocked").otherwise("warningOnly").alias("publishability"), issues.alias("issues")))),
    }
    raw = ("mappingSummary", "sourceFiles", "validationSummary")
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f'"{name}":'), v if name in raw else F.concat(F.lit('"'), v, F.lit('"')))) for name, v in fields.items()]
    orders = b.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")  # a few bytes a row become a whole record: dealt by rows, not by the splits of the file
    return orders.select(k.alias("id"), F.when(fault == 0, "not json").otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}"))).alias("record"))


_GOOD = """g AS (SELECT o_orderkey AS k, o_orderkey % 4 AS shape, 'v' || o_orderkey AS version_id, CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE 'r' || o_orderkey END AS run_id, ['published', 'draft', 'staged'][o_orderkey % 4 + 1] AS status, o_orderdate AS made, 's' || o_custkey % 20 AS scope,
 CASE WHEN o_orderkey % 4 = 2 THEN 'publishable' WHEN o_orderkey % 6 = 0 THEN 'blocked' ELSE 'warningOnly' END AS level FROM orders WHERE o_orderkey % 4 < 3)"""


@query("src_16_typed_records", f"""WITH {_GOOD} SELECT version_id, run_id, status, strftime(made, '%Y-%m-%d') AS created, CASE WHEN shape = 0 THEN strftime(made, '%Y-%m-%d') END AS published, scope, CASE WHEN shape = 0 THEN 'f' || k || ',' ELSE '' END AS files, level AS validation, CASE WHEN shape < 2 THEN 2 ELSE 0 END AS issues FROM g""")
def _(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return records.versions(_records(spark, d))[0].select("version_id", "run_id", "status", day("created_at").alias("created"), day("published_at").alias("published"), "scope", F.array_join("files.sourceFileId", ",").alias("files"), F.col("validation.publishability").alias("validation"), F.size("validation.issues").alias("issues"))


@query("src_16_record_issues", f"SELECT o_orderkey AS id, {reports._list(_CODES)}[o_orderkey % 5 + 1] AS code FROM orders WHERE o_orderkey % 4 = 3")
def _(spark, d):
    return records.versions(_records(spark, d))[1].select("id", "code")


@query("prj_14_record_counters", f"""WITH {_GOOD} SELECT version_id, CASE WHEN shape = 0 THEN k % 11 ELSE 0 END AS total, k % 5 AS by_line, k % 3 AS unresolved, CASE WHEN shape = 0 THEN 99 ELSE k % 5 END AS quality_by_line, CASE WHEN shape = 0 THEN k % 2 ELSE 0 END AS quality_ambiguous, k % 3 AS quality_unresolved FROM g WHERE shape < 2""")
def _(spark, d):
    good = records.versions(_records(spark, d))[0].filter("mapping IS NOT NULL")
    of, q = (lambda n: F.col(f"mapping.counters.{n}")), (lambda n: F.col(f"mapping.text_quality.{n}").alias(f"quality_{n}"))
    return good.select("version_id", of("total").alias("total"), of("by_line").alias("by_line"), of("unresolved").alias("unresolved"), q("by_line"), q("ambiguous"), q("unresolved"))


@query("prj_02_run_items", f"""WITH {_GOOD} SELECT version_id, run_id, CASE WHEN shape = 0 THEN 'published' ELSE 'staged' END AS state, CASE WHEN shape = 0 THEN version_id END AS published_version_id, level AS publishability, CASE WHEN shape = 0 AND k % 8 = 0 THEN 'WORKBOOK_SCHEMA_UNRECOGNIZED' ELSE '' END AS codes, 0 AS draft_issues,
 CASE WHEN shape = 0 THEN 5 ELSE 0 END AS repairs, CASE WHEN shape = 0 THEN 7 WHEN shape = 1 THEN 0 END AS draft_repairs, CASE WHEN shape < 2 THEN k % 3 ELSE 0 END AS unresolved FROM g""")
def _(spark, d):
    items = records.run_items(records.versions(_records(spark, d))[0])
    kept = lambda c: F.size(c)
    return items.select(
        "draft.version_id", "run_id", "state", "published_version_id", F.col("validation.publishability").alias("publishability"), F.array_join("validation.issues.code", ",").alias("codes"), (kept("draft.validation.issues") + kept("draft.reconciliation.issues")).alias("draft_issues"),
        kept("mapping.repairs").alias("repairs"), F.when(F.col("draft.mapping").isNotNull(), kept("draft.mapping.repairs")).alias("draft_repairs"), F.col("mapping.counters.unresolved").alias("unresolved"))


@query("agg_23_text_quality", f"""WITH {_GOOD}, p AS (SELECT 's' || o_custkey % 20 AS scope, 'v' || max(o_orderkey) AS pointer FROM orders GROUP BY 1), last AS (SELECT scope, arg_max(struct_pack(run_id := run_id, level := level, shape := shape, k := k), struct_pack(made := made, run_id := run_id, version_id := version_id)) AS x FROM g GROUP BY 1)
 SELECT p.scope, a.version_id AS active, CASE WHEN a.version_id IS NOT NULL THEN a.k % 3 END AS active_unresolved, x.run_id AS latest, x.level AS latest_level, CASE WHEN x.shape < 2 THEN x.k % 3 ELSE 0 END AS latest_unresolved FROM p LEFT JOIN g a ON a.version_id = p.pointer AND a.shape < 2 LEFT JOIN last ON last.scope = p.scope""")
def _(spark, d):
    pointers = b.read(spark, d, "orders").groupBy(F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string")).alias("scope")).agg(F.concat(F.lit("v"), F.max("o_orderkey").cast("string")).alias("pointer"))
    found = records.text_quality(records.versions(_records(spark, d))[0], pointers)
    return found.select("scope", F.col("active.version_id").alias("active"), F.col("active.mapping.counters.unresolved").alias("active_unresolved"), F.col("latest.run_id").alias("latest"), F.col("latest.publishability").alias("latest_level"), F.col("latest.mapping.counters.unresolved").alias("latest_unresolved"))


# Three fact sets, names of categories, consolidated totals


@query("agg_03_three_fact_sets", f"WITH {b.SQL_FLOW}, {b.SQL_BALANCE} SELECT count(*) AS entities FROM (SELECT entity FROM flow WHERE amount > 90000 UNION SELECT entity FROM balance WHERE combined > 450000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal < -990)")
def _(spark, d):
    result = b.read(spark, d, "customer").filter("c_acctbal < -990").select(F.col("c_nationkey").alias("entity"))
    return aggregates.entities_covered(b.flow(spark, d).filter("amount > 90000"), b.balance(spark, d).filter("combined > 450000"), result)


_CATEGORY_AT = f"{reports._list([n for n in reports._CATEGORIES])}[l_partkey % {len(reports._CATEGORIES)} + 1]"


@query("agg_06_named_categories", f"WITH f AS (SELECT {_CATEGORY_AT} AS name, l_extendedprice AS amount FROM lineitem) SELECT {reports._slug('name')} AS category, name, {DEC.format('amount')} AS amount, {DEC.format('amount')} / (SELECT {DEC.format('amount')} FROM f) AS share FROM f GROUP BY ALL")
def _(spark, d):
    slugs = catalogs.categories(spark).select("target", "name")
    at = F.element_at(F.array(*map(F.lit, reports._CATEGORIES)), (F.col("l_partkey") % len(reports._CATEGORIES)).cast("int") + 1)
    sums = b.read(spark, d, "lineitem").groupBy(at.alias("name")).agg(money(F.col("l_extendedprice")).alias("exact"))
    facts = sums.join(F.broadcast(slugs), "name").select(F.col("target").alias("category"), "exact")  # a fixed catalog
    return aggregates.named_shares(facts, "category", "exact", slugs.withColumnRenamed("target", "category"))


@query("ext_06_consolidated", f"""WITH {b.SQL_BALANCE}, a AS (SELECT account, entity, {DEC.format('combined')} AS actual FROM balance WHERE account IN ('{ACCOUNTS['reserves']}', '{ACCOUNTS['equity']}') GROUP BY ALL), x AS (SELECT account, CAST(entity AS VARCHAR) AS entity, actual, round(actual * CASE WHEN entity % 3 = 0 THEN 1.02 ELSE 1.0 END, 2) AS expected FROM a),
 y AS (SELECT * FROM x UNION ALL SELECT account, 'consolidated', CAST(sum(CAST(actual AS DECIMAL(18,2))) AS DOUBLE), CAST(sum(CAST(expected AS DECIMAL(18,2))) AS DOUBLE) FROM x GROUP BY account)
 SELECT account, entity, CASE account WHEN '{ACCOUNTS['reserves']}' THEN 'RESERVES_TOTAL' ELSE 'EQUITY_TOTAL' END AS rule, CASE WHEN {_REC_OFF} THEN 'high' ELSE 'low' END AS severity, CASE WHEN {_REC_OFF} THEN 'warning' ELSE 'passed' END AS status, actual, expected, {_REC_DIFF} FROM y""")
def _(spark, d):
    wanted = {ACCOUNTS["reserves"]: "RESERVES_TOTAL", ACCOUNTS["equity"]: "EQUITY_TOTAL"}
    rows = b.balance(spark, d).filter(F.col("account").isin(*wanted)).groupBy("account", "entity").agg(money(F.col("combined")).alias("actual"))
    rows = rows.withColumn("expected", F.round(F.col("actual").cast("double") * F.when(F.col("entity") % 3 == 0, 1.02).otherwise(1.0), 2).cast("decimal(18,2)"))
    return reconcile.consolidated(rows, "account", "entity", wanted)
