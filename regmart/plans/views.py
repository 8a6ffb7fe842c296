"""Registered queries on screening, name-keyed reconciliation, rebuilt details, margins and repair counters, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regmart.functions import numbers, text
from regmart.operators import aggregates as agg
from regmart.operators import paging, reconcile, resolve
from regmart.plans import bridge as b
from regmart.plans.publication import _SQL_SCORES, _cells, _heads, _scores
from regmart.plans.registry import _FALLBACK, ACCOUNTS, DEC, _with_fallback
from regmart.sources import workbooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_RULES = [
    ("file % 13 = 0", "SECURITY_EXTENSION_REJECTED", "critical"), ("file % 6 = 0", "SECURITY_MIME_REJECTED", "high"), ("price * 100 > 15728640", "SECURITY_SIZE_LIMIT", "critical"), ("NOT is_archive", "SECURITY_MAGIC_BYTES", "critical"),
    ("is_archive AND entries > 2500", "SECURITY_ZIP_ENTRIES", "critical"), ("is_archive AND macro", "SECURITY_MACRO_DETECTED", "critical"), ("is_archive AND encrypted", "SECURITY_ENCRYPTED_PACKAGE", "critical"),
    ("is_archive AND protected", "SECURITY_WORKBOOK_PROTECTED", "high"), ("is_archive AND floor(price / 12) / compressed > 120", "SECURITY_ZIP_BOMB_RATIO", "critical"),
]


@query("sec_01_09_screening", f"WITH {b.SQL_ARCHIVES} " + " UNION ALL ".join(f"SELECT file, '{code}' AS code, '{severity}' AS severity FROM archives WHERE {rule}" for rule, code, severity in _RULES))
def _(spark, d):
    return workbooks.screen(b.archives(spark, d), F.col("name"), F.col("mime"))


@query("win_05_margin", f"WITH {_SQL_SCORES} SELECT file, score AS best, CAST(second AS DOUBLE) AS second, score - second AS margin FROM p WHERE n = 1")
def _(spark, d):
    return workbooks.classify(_scores(spark, d)).select("file", "best", "second", (F.col("best") - F.col("second")).alias("margin"))


_REPORTED = "regexp_replace(regexp_replace(upper({0}), '[().,/]+', ' ', 'g'), '\\s+', ' ', 'g')"


@query("agg_11_repair_counters", f"""WITH {_FALLBACK}, e AS (SELECT ['entity', 'parent', 'account'][1 + s_suppkey % 3] AS domain, strategy, s_suppkey % 9 = 0 AS damaged, trim({_REPORTED.format('raw')}) <> raw AS reshaped FROM final),
 g AS (SELECT domain, count(*) AS total, count(*) FILTER (damaged) AS mojibake, count(*) FILTER (strategy LIKE 'normalized%' OR (strategy NOT LIKE 'direct%' AND (damaged OR reshaped))) AS repaired FROM e GROUP BY 1)
 SELECT domain, coalesce(total, 0) AS total, coalesce(mojibake, 0) AS mojibake, coalesce(repaired, 0) AS repaired FROM (VALUES ('entity'), ('parent'), ('account'), ('child')) AS x(domain) LEFT JOIN g USING (domain)""")
def _(spark, d):
    i = F.col("s_suppkey")
    raw = F.when(i % 9 == 0, F.concat("raw", F.lit(" \u00c3\u00a9"))).otherwise(F.col("raw"))
    domain = F.element_at(F.array(F.lit("entity"), F.lit("parent"), F.lit("account")), (i % 3 + 1).cast("int"))
    return resolve.repair_counters(_with_fallback(spark, d).withColumns({"raw": raw, "domain": domain}), spark.createDataFrame([("entity",), ("parent",), ("account",), ("child",)], "domain string"))


@query("jn_11_reconcile_names", f"""WITH {b.SQL_FLOW}, actual AS (SELECT upper(entity_name) AS name, entity, {DEC.format('amount')} AS actual FROM flow GROUP BY 1, 2), control AS (SELECT name, actual * CASE WHEN entity % 7 = 0 THEN 1.01 ELSE 1.0 END AS expected FROM actual WHERE entity % 11 <> 0)
 SELECT a.name, CASE WHEN expected IS NULL THEN 'REFERENCE_PREMIUM_INSTITUTION_MISSING' ELSE 'PREMIUM_TOTAL_BY_INSTITUTION' END AS rule, CASE WHEN expected IS NULL THEN 'medium' WHEN abs((actual - expected) / expected) > 0.001 THEN 'high' ELSE 'low' END AS severity,
 CASE WHEN expected IS NULL OR abs((actual - expected) / expected) > 0.001 THEN 'warning' ELSE 'passed' END AS status, actual, expected, actual - expected AS absolute_difference, (actual - expected) / expected AS relative_difference FROM actual a LEFT JOIN control c ON a.name = c.name""")
def _(spark, d):
    actual = b.flow(spark, d).groupBy("entity", F.col("entity_name").alias("name")).agg(numbers.money(F.col("amount")).cast("double").alias("actual"))
    i, reported = F.col("entity"), F.lower("name")
    control = actual.filter(i % 11 != 0).select(F.when(i % 2 == 0, F.concat(F.lit("  "), reported, F.lit(" "))).otherwise(reported).alias("name"), (F.col("actual") * F.when(i % 7 == 0, 1.01).otherwise(1.0)).alias("expected"), i.alias("position"))
    return reconcile.reconcile_names(actual.drop("entity"), control, "name", "PREMIUM_TOTAL_BY_INSTITUTION")


_FACTS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("jn_13_rebuilt_details", f"""WITH {b.SQL_FLOW}, x AS (SELECT entity, l_orderkey || ':' || l_linenumber AS fact, row_number() OVER (PARTITION BY entity ORDER BY {_FACTS}) AS n FROM flow), f AS (SELECT entity, string_agg(fact, ',' ORDER BY n) AS facts FROM x WHERE n <= 20 GROUP BY 1),
 g AS (SELECT entity, entity_name AS name, {DEC.format('amount')} AS amount FROM flow GROUP BY 1, 2) SELECT g.entity, name, amount, CASE WHEN g.entity % 3 = 0 THEN facts ELSE '' END AS facts, CASE WHEN g.entity % 3 = 0 THEN 'rebuilt' ELSE 'stored' END AS origin FROM g JOIN f ON f.entity = g.entity""")
def _(spark, d):
    flow = b.flow(spark, d)
    sums = flow.groupBy("entity", F.col("entity_name").alias("name")).agg(numbers.money(F.col("amount")).cast("double").alias("amount"))
    first = agg.top_rows(flow, "entity", [F.col(c) for c in _FACTS.split(", ")], 20)
    listed = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("fact"))))
    facts = first.groupBy("entity").agg(F.concat_ws(",", F.transform(listed, lambda x: x["fact"])).alias("facts"))
    return agg.stored_or_rebuilt(sums.filter("entity % 3 > 0").withColumn("facts", F.lit("")), sums.join(facts, "entity"), "entity")


@query("scl_02_normalize_text", "SELECT doc_id, upper(trim(regexp_replace(replace(text, 'ß', 'SS'), '\\s+', ' ', 'g'))) AS normalized FROM documents")
def _(spark, d):
    return b.read(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query("win_01_four_metrics", f"""WITH {b.SQL_FLOW}, {b.SQL_BALANCE}, m AS (SELECT 'amount' AS metric, entity, {DEC.format('amount')} AS amount FROM flow GROUP BY 2 """ + "".join(f"UNION ALL SELECT '{n}', entity, {DEC.format('combined')} FROM balance WHERE account = '{a}' GROUP BY 2 " for n, a in ACCOUNTS.items()) + """)
 SELECT metric, entity, n_name AS name, amount, CAST(row_number() OVER (PARTITION BY metric ORDER BY amount DESC, n_name, entity) AS INT) AS rank FROM m JOIN nation ON entity = n_nationkey QUALIFY rank <= 12""")
def _(spark, d):
    f = b.flow(spark, d).groupBy("entity").agg(numbers.money(F.col("amount")).cast("double").alias("amount"))
    x = b.balance(spark, d).groupBy("entity").agg(*[numbers.money(F.when(F.col("account") == a, F.col("combined"))).cast("double").alias(n) for n, a in ACCOUNTS.items()])
    rows = agg.with_names(f.join(x, "entity", "full"), b.entities(spark, d), "entity", "entity_name")
    return agg.rankings(rows, ["amount", *ACCOUNTS], "name", "entity")


@query("agg_24_route_bytes", f"WITH {b.SQL_REQUESTS} SELECT route, round(avg(bytes), 2) AS avg_bytes, max(ts) AS last_seen FROM requests GROUP BY route ORDER BY route")
def _(spark, d):
    return b.requests(spark, d).groupBy("route").agg(F.round(F.avg("bytes"), 2).alias("avg_bytes"), F.max("ts").alias("last_seen")).orderBy("route")


@query("ext_03_yoy_change", f"""WITH {b.SQL_FLOW}, m AS (SELECT entity, CAST(left(period, 4) AS INT) AS year, right(period, 2) AS month, {DEC.format('amount')} AS amount FROM flow GROUP BY 1, 2, 3), c AS (SELECT *, lag(amount) OVER w AS before, lag(year) OVER w AS last FROM m WINDOW w AS (PARTITION BY entity, month ORDER BY year))
 SELECT entity, year, month, amount - before AS change, CASE WHEN before = 0 THEN 0 ELSE (amount - before) / before END AS relative FROM c WHERE last = year - 1""")
def _(spark, d):
    year = F.left("period", F.lit(4)).cast("int")
    m = b.flow(spark, d).groupBy("entity", year.alias("year"), F.right("period", F.lit(2)).alias("month")).agg(numbers.money(F.col("amount")).cast("double").alias("amount"))
    w = Window.partitionBy("entity", "month").orderBy("year")
    change = F.col("amount") - F.col("before")
    compared = m.withColumns({"before": F.lag("amount").over(w), "last": F.lag("year").over(w)}).filter("last = year - 1")
    return compared.select("entity", "year", "month", change.alias("change"), numbers.safe_ratio(change, F.col("before")).alias("relative"))


@query("ext_05_grand_total", f"""WITH {b.SQL_FLOW}, a AS (SELECT 'all' AS scope, {DEC.format('amount')} AS actual, {DEC.format('amount * 1.25')} AS expected FROM flow)
 SELECT scope, 'PREMIUM_GRAND_TOTAL' AS rule, 'high' AS severity, 'warning' AS status, actual, expected, actual - expected AS absolute_difference, (actual - expected) / expected AS relative_difference FROM a""")
def _(spark, d):
    sums = b.flow(spark, d).agg(*[numbers.money(x).cast("double").alias(n) for n, x in (("actual", F.col("amount")), ("expected", F.col("amount") * 1.25))]).withColumn("scope", F.lit("all"))
    return reconcile.reconcile(sums.select("scope", "actual"), sums.select("scope", "expected"), "scope", "PREMIUM_GRAND_TOTAL")


_SIGNALS = ("11", "07", "SUPPLIER")


@query("src_12_file_scores", f"""WITH s AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS row FROM supplier), x AS (SELECT CAST(s_nationkey AS VARCHAR) AS file, {' + '.join(f"coalesce(max(CASE WHEN row <= 60 AND contains(upper(s_name), '{x}') THEN 1 END), 0)" for x in _SIGNALS)} AS hits FROM s GROUP BY 1)
 SELECT file, 'flow' AS kind, CAST(12 * 2 + 6 + 15 * hits AS DOUBLE) AS score FROM x UNION ALL SELECT file, 'control', CAST(12 AS DOUBLE) FROM x""")
def _(spark, d):
    table = _cells(spark, d)
    tabular = workbooks.tabular_scores(table, _heads(spark, d), "flow", ["name", "code"], ["Data"], 12.0, "name", _SIGNALS)
    return tabular.unionByName(workbooks.control_scores(table, "control", ["NOTES"]))


@query("lim_01_page_with_total", f"WITH {b.SQL_FLOW}, g AS (SELECT category, {DEC.format('amount')} AS amount FROM flow GROUP BY 1) SELECT category, amount, (SELECT count(*) FROM g) AS total FROM g ORDER BY amount DESC, category LIMIT 10 OFFSET 10")
def _(spark, d):
    rows = b.flow(spark, d).groupBy("category").agg(numbers.money(F.col("amount")).cast("double").alias("amount"))
    return paging.with_total(paging.public_page(rows, [F.desc("amount"), F.col("category")], 2, 10), rows)
