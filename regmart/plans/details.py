"""Registered queries on list items, domain availability, repairs, status and natural keys, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regmart.functions import text
from regmart.functions.numbers import money
from regmart.operators import aggregates as agg
from regmart.operators import projections as p
from regmart.plans import bridge as b
from regmart.plans.registry import _FALLBACK, ACCOUNTS, DEC, _with_fallback
from regmart.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("prj_01_version_items", f"""WITH {b.SQL_VERSIONS} SELECT CAST(id AS VARCHAR) AS version_id, 'run-' || id AS run_id, status, created AS created_at, published AS published_at, CAST(uploaded_by AS VARCHAR) AS uploaded_by, strftime(created, '%Y-%m') AS periods,
 CASE status WHEN 'O' THEN 'premiums-only' WHEN 'F' THEN 'premiums-financial' ELSE 'financial-only' END AS scope, published IS NOT NULL AS availability FROM versions""")
def _(spark, d):
    s = F.col("status")
    item = {"version_id": F.col("id").cast("string"), "run_id": F.concat(F.lit("run-"), F.col("id").cast("string")), "created_at": F.col("created"), "published_at": F.col("published"), "uploaded_by": F.col("uploaded_by").cast("string"), "periods": F.date_format("created", "yyyy-MM"),
            "scope": F.when(s == "O", "premiums-only").when(s == "F", "premiums-financial").otherwise("financial-only"), "availability": F.col("published").isNotNull()}
    return b.versions(spark, d).withColumns(item).select(*p.VERSION_FIELDS)


_DETAILS = ('{"publishability": "blocked", "note": 1, "mappingSummary": {"total": 2}}', '{"publishability": 5, "textQualitySummary": {"score": 1}}', "not json", '{"mappingSummary": "none"}')


@query("prj_03_audit_details", f"""WITH x AS (SELECT event_id, event_type AS action, ['publishable', NULL, NULL, NULL, 'blocked'][CASE WHEN event_id % 4 = 0 THEN 5 ELSE 2 END] AS publishability, CASE WHEN event_id % 4 = 1 THEN '{{"score":1}}' END AS "textQualitySummary", CASE WHEN event_id % 4 = 0 THEN '{{"total":2}}' END AS "mappingSummary" FROM events) SELECT * FROM x""")
def _(spark, d):
    detail = F.element_at(F.array(*map(F.lit, _DETAILS)), (F.col("event_id") % 4).cast("int") + 1)
    return b.read(spark, d, "events").select("event_id", F.col("event_type").alias("action"), *p.audit_details(detail))


_TEXTS = ("Utilidad del periodo", "RESULTADO NETO", "primas retenidas", "Ingresos Financieros", "Gastos de Intermediación", "otros egresos", "Gastos y utilidad", "ACTIVOS")
_CATEGORY = ("netIncome", "netIncome", "retainedPremiums", "financialIncome", "expenses", "expenses", "netIncome", "other")


@query("prj_08_statement_categories", f"SELECT o_orderkey, [{', '.join(map(_quoted, _CATEGORY))}][o_orderkey % 8 + 1] AS category FROM orders")
def _(spark, d):
    account = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % 8).cast("int") + 1)
    return b.read(spark, d, "orders").select("o_orderkey", p.semantic_category(account).alias("category"))


# Events of a user are records of five domains
_DOMAIN_OF = {"click": "premiums", "view": "financialPosition", "purchase": "incomeStatement", "signup": "reference", "error": "claims"}
_CASES = " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in _DOMAIN_OF.items())
_SQL_AVAILABLE = f"""c AS (SELECT user_id AS scope, CASE event_type {_CASES} END AS domain, count(*) AS n FROM events GROUP BY 1, 2), v(domain, may, absent, present) AS (VALUES {', '.join(f"({_quoted(n)}, {may}, {_quoted(a)}, {_quoted(z)})" for n, may, a, z in p.DOMAINS)}),
 available AS (SELECT s.scope, v.domain, n IS NOT NULL AND v.domain <> 'claims' AS provided, CASE WHEN n IS NULL OR v.domain = 'claims' THEN 0 WHEN v.domain = 'reference' THEN 1 ELSE n END AS records, n IS NOT NULL AND may AS publishable, CASE WHEN n IS NOT NULL AND v.domain <> 'claims' THEN present ELSE absent END AS reason
 FROM (SELECT DISTINCT scope FROM c) s CROSS JOIN v LEFT JOIN c ON c.scope = s.scope AND c.domain = v.domain)"""


def _available(spark, d):
    domain = F.element_at(F.create_map(*[F.lit(x) for pair in _DOMAIN_OF.items() for x in pair]), F.col("event_type"))
    return p.availability(b.read(spark, d, "events").groupBy(F.col("user_id").alias("scope"), domain.alias("domain")).agg(F.count("*").alias("records")))


@query("prj_10_domain_availability", f"WITH {_SQL_AVAILABLE} SELECT * FROM available")
def _(spark, d):
    return _available(spark, d)


_SQL_DERIVED = {x: "[" + ", ".join(_quoted(t) for n, t in p.DERIVED if n == x) + "]" for x in ("premiums", "financialPosition")}


@query("prj_12_derived_artifacts", f"""WITH {_SQL_AVAILABLE}, g AS (SELECT scope, bool_or(publishable AND domain = 'premiums') AS p, bool_or(publishable AND domain = 'financialPosition') AS f FROM available GROUP BY 1)
 SELECT scope, array_to_string(list_concat(CASE WHEN p THEN {_SQL_DERIVED['premiums']} ELSE [] END, CASE WHEN f THEN {_SQL_DERIVED['financialPosition']} ELSE [] END), '; ') AS derived FROM g""")
def _(spark, d):
    return p.derived_artifacts(_available(spark, d)).select("scope", F.array_join("derived", "; ").alias("derived"))


_SQL_EVENTS = f"{_FALLBACK}, e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'premiums' ELSE 'financialPosition' END AS domain, strategy, final.raw, d.key AS normalized, target, n_name AS name, 'scope-' || s_suppkey % 3 AS scope FROM final JOIN d ON d.raw = final.raw LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = target)"


def _events(spark, d):
    i, raw = F.col("s_suppkey"), F.col("raw")
    names = b.entity_catalog(spark, d).select("target", F.col("canonical").alias("name"))
    rows = _with_fallback(spark, d).join(F.broadcast(names), "target", "left")  # a fixed catalog
    return rows.withColumns({"domain": F.when(i % 2 == 0, "premiums").otherwise("financialPosition"), "repaired": text.repair_mojibake(raw), "normalized": text.normalize_entity_alias(raw), "required": text.required_normalization(F.col("strategy"), raw), "scope": F.concat(F.lit("scope-"), (i % 3).cast("string"))})


@query("agg_12_repair_keys", f"WITH {_SQL_EVENTS} SELECT domain, strategy, raw, raw AS repaired, normalized, target, name, count(*) AS n FROM e WHERE strategy LIKE 'normalized%' GROUP BY ALL ORDER BY n DESC, domain, name, strategy, raw LIMIT 8")
def _(spark, d):
    return p.top_repairs(_events(spark, d))


@query("agg_13_distinct_examples", f"WITH {_SQL_EVENTS}, k AS (SELECT domain, strategy, raw, target, scope, min(s_suppkey) AS first FROM e GROUP BY ALL) SELECT domain, strategy, raw, target, scope, CAST(row_number() OVER (PARTITION BY strategy ORDER BY first) AS INT) AS position FROM k QUALIFY position <= 8")
def _(spark, d):
    return p.examples(_events(spark, d), [F.col("s_suppkey")])


@query("agg_23_latest", f"""WITH {b.SQL_VERSIONS}, u AS (SELECT 'runs' AS area, CAST(row_number() OVER (ORDER BY created DESC, id DESC) AS INT) AS position, id, status FROM versions UNION ALL SELECT 'versions', CAST(row_number() OVER (ORDER BY published DESC, id DESC) AS INT), id, status FROM versions WHERE published IS NOT NULL) SELECT * FROM u WHERE position <= 3""")
def _(spark, d):
    return p.operational_status(b.versions(spark, d))


@query("agg_26_four_areas", "SELECT 'quarantine' AS area, count(*) AS n FROM documents UNION ALL SELECT 'staging', count(*) FROM customer UNION ALL SELECT 'published', count(*) FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT 'audit', count(*) FROM events")
def _(spark, d):
    return store.area_counts({"quarantine": b.read(spark, d, "documents"), "staging": b.read(spark, d, "customer"), "published": b.versions(spark, d).filter("published IS NOT NULL"), "audit": b.read(spark, d, "events")})


_OVERVIEW = " UNION ALL ".join(f"(SELECT '{n}' AS list, CAST({key} AS VARCHAR) AS item, {DEC.format(amount)} AS amount FROM {view} {where} GROUP BY 2 ORDER BY amount DESC, item LIMIT 12)" for n, key, amount, view, where in (
    ("by-entity", "entity", "amount", "flow", ""), ("by-category", "category", "amount", "flow", ""), ("assets", "entity", "combined", "balance", f"WHERE account = '{ACCOUNTS['total_assets']}'")))


@query("lim_03_overview_lists", f"WITH {b.SQL_FLOW}, {b.SQL_BALANCE} {_OVERVIEW}")
def _(spark, d):
    assets = b.balance(spark, d).filter(F.col("account") == ACCOUNTS["total_assets"])
    return agg.top_lists(b.flow(spark, d), {"by-entity": "entity", "by-category": "category"}, "amount").unionByName(agg.top_lists(assets, {"assets": "entity"}, "combined"))


@query("val_09_natural_keys", f"""WITH {b.SQL_FLOW} SELECT 'premiums:row:' || l_orderkey || '-' || l_linenumber AS scope, 'PREMIUM_DUPLICATE_NATURAL_KEY' AS code, 'critical' AS severity, 'failed' AS status FROM flow
 QUALIFY row_number() OVER (PARTITION BY period, entity, entity_name, parent, category, currency, upper(currency) ORDER BY l_orderkey, l_linenumber) > 1""")
def _(spark, d):
    flow = b.flow(spark, d).withColumn("currency_name", F.lower("currency"))
    key = [F.col("period"), *[F.upper(text.collapse(F.col(c).cast("string"))) for c in ("entity", "entity_name", "parent", "category", "currency", "currency_name")]]
    scope = F.concat(F.lit("premiums:row:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return p.duplicate_issues(flow, key, ["l_orderkey", "l_linenumber"], scope)


@query("val_10_account_missing", f"WITH {b.SQL_BALANCE} SELECT entity, period, 'FINANCIAL_TOTAL_ASSETS_MISSING' AS code, 'critical' AS severity, 'failed' AS status FROM balance GROUP BY 1, 2 HAVING NOT bool_or(account = '1-URGENT')")
def _(spark, d):
    return p.account_missing(b.balance(spark, d), ["entity", "period"], F.col("account"), ACCOUNTS["total_assets"])


@query("jn_10_previews", f"""WITH {b.SQL_FLOW}, x AS (SELECT entity, l_orderkey || ':' || l_linenumber AS fact, row_number() OVER (PARTITION BY entity ORDER BY amount DESC, l_orderkey, l_linenumber) AS n FROM flow)
 SELECT n_nationkey AS entity, coalesce(string_agg(fact, ',' ORDER BY n), '') AS preview FROM nation LEFT JOIN x ON entity = n_nationkey AND n <= 20 GROUP BY 1""")
def _(spark, d):
    fact = F.concat_ws(":", "l_orderkey", "l_linenumber")
    shown = p.preview(b.flow(spark, d), "entity", [F.desc("amount"), F.col("l_orderkey"), F.col("l_linenumber")], fact)
    return b.entities(spark, d).join(shown, "entity", "left").select("entity", F.coalesce(F.array_join("preview", ","), F.lit("")).alias("preview"))


@query("scl_23_rounded", f"WITH {b.SQL_REQUESTS} SELECT route, round(avg(duration), 2) AS avg_duration, CAST(round(avg(bytes)) AS BIGINT) AS avg_bytes FROM requests GROUP BY 1")
def _(spark, d):
    return b.requests(spark, d).groupBy("route").agg(F.round(F.avg("duration"), 2).alias("avg_duration"), F.round(F.avg("bytes")).cast("long").alias("avg_bytes"))
