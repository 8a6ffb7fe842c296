"""Registered queries on route keys, alias issues, reconciliation guards, stored rankings and compact summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regmart.functions import text
from regmart.functions.numbers import money
from regmart.operators import quality, reconcile, resolve
from regmart.plans import bridge as b
from regmart.plans.registry import _FALLBACK, ACCOUNTS, DEC, _resolved, _with_fallback

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


_SLUG = "regexp_replace(trim(regexp_replace(lower(n_name), '[^a-z0-9\\s-]', '', 'g')), '[\\s-]+', '-', 'g')"


@query("jn_12_route_keys", f"""WITH {b.SQL_DIRTY}, inputs AS (SELECT unnest([CAST(n_nationkey AS VARCHAR), n_name, 'alias ' || n_name, {_SLUG}, n_name || '-nowhere']) AS value FROM nation),
 hits AS (SELECT value, 0 AS stage, value AS target FROM inputs JOIN nation ON value = CAST(n_nationkey AS VARCHAR) UNION SELECT value, 1, CAST(n_nationkey AS VARCHAR) FROM inputs JOIN nation ON value = n_name
 UNION SELECT value, 2, target FROM inputs JOIN aliases ON value = alias UNION SELECT value, 3, CAST(n_nationkey AS VARCHAR) FROM inputs JOIN nation ON value = {_SLUG}),
 firsts AS (SELECT value, stage, count(*) AS n, min(target) AS target FROM hits WHERE (value, stage) IN (SELECT value, min(stage) FROM hits GROUP BY value) GROUP BY ALL)
 SELECT inputs.value, CASE WHEN stage IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE ['id', 'name', 'alias', 'slug'][stage + 1] END AS strategy, CASE WHEN n = 1 THEN target END AS target FROM inputs LEFT JOIN firsts ON firsts.value = inputs.value""")
def _(spark, d):
    nation, key = b.read(spark, d, "nation"), F.col("n_nationkey").cast("string")
    slug = text.slug_key(F.col("n_name"))
    inputs = nation.select(F.explode(F.array(key, F.col("n_name"), F.concat(F.lit("alias "), "n_name"), slug, F.concat("n_name", F.lit("-nowhere")))).alias("raw"))
    side = lambda name: nation.select(name.alias("alias"), key.alias("target"))
    stages = [("id", side(key)), ("name", side(F.col("n_name"))), ("alias", b.entity_aliases(spark, d)), ("slug", side(slug))]
    return resolve.first_stage(inputs, stages).select(F.col("raw").alias("value"), "strategy", "target")


@query("set_05_merged_candidates", f"""WITH {_FALLBACK}, c AS (SELECT resolved.raw, list_sort(list(DISTINCT CAST(n_nationkey AS VARCHAR))) AS found FROM resolved JOIN d ON d.raw = resolved.raw JOIN nation ON contains(d.key, n_name) OR contains(n_name, d.key)
 WHERE strategy = 'unresolved' AND length(d.key) >= 4 GROUP BY 1) SELECT s_suppkey, array_to_string(CASE WHEN n_nationkey IS NULL THEN found ELSE list_concat([CAST(n_nationkey AS VARCHAR)], list_filter(found, lambda x: x <> CAST(n_nationkey AS VARCHAR))) END, ',') AS candidates,
 CASE WHEN len(CASE WHEN n_nationkey IS NULL THEN found ELSE list_concat([CAST(n_nationkey AS VARCHAR)], list_filter(found, lambda x: x <> CAST(n_nationkey AS VARCHAR))) END) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS strategy
 FROM dirty JOIN c ON c.raw = dirty.raw LEFT JOIN nation ON n_nationkey = dirty.line""")
def _(spark, d):
    found = resolve.containment_candidates(_resolved(spark, d).filter("strategy = 'unresolved'"), b.entity_catalog(spark, d), text.normalize_entity_alias)
    lines = b.entity_catalog(spark, d).groupBy("line").agg(F.min_by("target", "sort_order").alias("line_target"))
    rows = b.dirty(spark, d).join(found, "raw").join(lines, "line", "left").select("s_suppkey", resolve.merged_candidates(F.col("line_target"), F.col("candidates")).alias("all"))
    return rows.select("s_suppkey", F.array_join("all", ",").alias("candidates"), resolve.verdict(F.col("all")).alias("strategy"))


def _alias_issue_sql(context: str, strategy: str) -> str:
    return f"'{context}_ALIAS_' || upper({strategy}) AS code, 'high' AS severity, 'failed' AS status"


@query("val_14_entity_alias_issues", f"WITH {_FALLBACK} SELECT s_suppkey, raw, {_alias_issue_sql('INSTITUTION', 'strategy')} FROM final WHERE target IS NULL")
def _(spark, d):
    return quality.alias_issues(_with_fallback(spark, d), "INSTITUTION").select("s_suppkey", "raw", "code", "severity", "status")


@query("val_15_category_alias_issues", f"""WITH t AS (SELECT p_type AS alias, count(DISTINCT p_brand) AS n FROM part WHERE p_size < 5 GROUP BY 1), r AS (SELECT p_partkey, p_type AS raw, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' END AS strategy FROM part LEFT JOIN t ON p_type = alias)
 SELECT p_partkey, raw, {_alias_issue_sql('INSURANCE_LINE', 'strategy')} FROM r WHERE strategy IS NOT NULL""")
def _(spark, d):
    part = b.read(spark, d, "part").select("p_partkey", F.col("p_type").alias("raw"), "p_brand", "p_size")
    known = part.filter("p_size < 5").select(F.col("raw").alias("alias"), F.col("p_brand").alias("target"))
    return quality.alias_issues(part.select("p_partkey", "raw").join(resolve.first_stage(part.select("raw"), [("direct-alias", known)]), "raw"), "INSURANCE_LINE").select("p_partkey", "raw", "code", "severity", "status")


@query("val_16_account_alias_issues", f"SELECT o_orderkey, o_orderpriority AS raw, {_alias_issue_sql('FINANCIAL_ACCOUNT', chr(39) + 'unresolved' + chr(39))} FROM orders WHERE o_orderpriority NOT IN ({', '.join(repr(a) for a in ACCOUNTS.values())})")
def _(spark, d):
    rows = b.read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("raw"))
    known = spark.createDataFrame([(a, n) for n, a in ACCOUNTS.items()], "alias string, target string")
    return quality.alias_issues(rows.join(resolve.first_stage(rows.select("raw"), [("direct-canonical", F.broadcast(known))]), "raw"), "FINANCIAL_ACCOUNT").select("o_orderkey", "raw", "code", "severity", "status")


_MARKERS = ("password", "secret", "token", "AKIA", "@")


@query("val_11_markers_missing", "SELECT lang, 'INCOME_STATEMENT_MARKERS_MISSING' AS code, 'high' AS severity, 'failed' AS status FROM (SELECT doc_id % 200 || lang AS lang, text FROM documents) GROUP BY lang HAVING NOT bool_or(coalesce(" + " OR ".join(f"contains(text, '{m}')" for m in _MARKERS) + ", false))")
def _(spark, d):
    rows = b.read(spark, d, "documents").select(F.concat((F.col("doc_id") % 200).cast("string"), "lang").alias("lang"), "text")
    return quality.markers_missing(rows, ["lang"], F.col("text"), _MARKERS)


@query("val_13_ranking_missing", f"WITH {b.SQL_FILES} SELECT run, 'REFERENCE_RANKING_MISSING' AS code, 'medium' AS severity, 'warning' AS status FROM files GROUP BY run HAVING NOT bool_or(name LIKE '%0.txt')")
def _(spark, d):
    return quality.sheet_missing(b.files(spark, d), ["run"], F.col("name").like("%0.txt"))


_OFF = "abs((actual - expected) / expected)"


@query("rec_01_reference_not_provided", f"WITH {b.SQL_FLOW} SELECT 'REFERENCE_NOT_PROVIDED' AS code, 'low' AS severity, 'warning' AS status FROM flow HAVING count(*) > 0")
def _(spark, d):
    flow, balance = b.flow(spark, d), b.balance(spark, d)
    return reconcile.not_provided(balance.filter("combined < 0"))


@query("rec_02_no_facts", f"WITH {b.SQL_FLOW} SELECT entity, amount AS actual, amount AS expected FROM flow WHERE amount < 0")
def _(spark, d):
    flow = b.flow(spark, d).filter("amount < 0")
    control = b.flow(spark, d).groupBy("entity").agg(money(F.col("amount")).cast("double").alias("expected"))
    return reconcile.reconcile(flow.groupBy("entity").agg(money(F.col("amount")).cast("double").alias("actual")), control, "entity", "PREMIUM_TOTAL_BY_INSTITUTION").select("entity", "actual", "expected")


_REC = "SELECT entity, '{0}' AS rule, CASE WHEN {off} > {tol} THEN 'high' ELSE 'low' END AS severity, CASE WHEN {off} > {tol} THEN 'warning' ELSE 'passed' END AS status, actual, expected, actual - expected AS absolute_difference, (actual - expected) / expected AS relative_difference FROM {0}"


def _account_sql(name: str) -> str:
    return f"{name}_TOTAL AS (SELECT entity, a AS actual, a * CASE WHEN entity % 3 = 0 THEN 1.02 ELSE 1.0 END AS expected FROM (SELECT entity, {DEC.format('combined')} AS a FROM balance WHERE account = '{ACCOUNTS[name]}' GROUP BY 1))"


@query("ext_06_reserves_and_equity", f"WITH {b.SQL_BALANCE}, {_account_sql('reserves')}, {_account_sql('equity')} " + " UNION ALL ".join(_REC.format(f"{n}_TOTAL", off=_OFF, tol=0.001) for n in ("reserves", "equity")))
def _(spark, d):
    rules = {ACCOUNTS[name]: f"{name}_TOTAL" for name in ("reserves", "equity")}
    actual = b.balance(spark, d).filter(F.col("account").isin(*rules)).groupBy("account", "entity").agg(money(F.col("combined")).cast("double").alias("actual"))
    rows = actual.withColumn("expected", F.col("actual") * F.when(F.col("entity") % 3 == 0, 1.02).otherwise(1.0))
    rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("account")]
    return reconcile.compared(rows, rule, None).drop("account")


@query("ext_08_tolerances", f"""WITH {b.SQL_BALANCE}, a AS (SELECT entity, account, {DEC.format('combined')} AS actual FROM balance GROUP BY ALL), x AS (SELECT *, actual * (1 + (entity % 4) * 0.005) AS expected FROM a),
 rules(account, absolute, relative) AS (VALUES ('{ACCOUNTS['total_assets']}', 1000.0, 0.012), ('{ACCOUNTS['reserves']}', 1e12, 0.001), ('{ACCOUNTS['equity']}', 1000.0, 0.5))
 SELECT entity, x.account, CASE WHEN abs(actual - expected) > absolute AND abs((actual - expected) / expected) > relative THEN 'warning' ELSE 'passed' END AS status FROM x JOIN rules ON rules.account = x.account""")
def _(spark, d):
    rules = spark.createDataFrame([(ACCOUNTS["total_assets"], 1000.0, 0.012), (ACCOUNTS["reserves"], 1e12, 0.001), (ACCOUNTS["equity"], 1000.0, 0.5)], "account string, absolute double, relative double")
    rows = b.balance(spark, d).groupBy("entity", "account").agg(money(F.col("combined")).cast("double").alias("actual")).withColumn("expected", F.col("actual") * (1 + (F.col("entity") % 4) * F.lit(0.005)))
    return reconcile.with_tolerances(rows, rules, "account").select("entity", "account", "status")


@query("ext_11_business_metrics", f"""WITH {b.SQL_FLOW}, {b.SQL_BALANCE}, {b.SQL_ISSUES}, {b.SQL_VERSIONS} SELECT (SELECT count(DISTINCT entity) FROM flow) AS entities, (SELECT {DEC.format('amount')} FROM flow) AS flow_total, (SELECT {DEC.format('combined')} FROM balance) AS balance_total,
 (SELECT count(*) FROM issues WHERE severity = 'critical') AS critical, (SELECT count(*) FROM issues WHERE severity = 'high') AS high, (SELECT datediff('day', CAST(max(published) AS DATE), DATE '2026-01-01') FROM versions) AS version_age_days""")
def _(spark, d):
    flow = b.flow(spark, d).agg(F.count_distinct("entity").alias("entities"), money(F.col("amount")).cast("double").alias("flow_total"))
    balance = b.balance(spark, d).agg(money(F.col("combined")).cast("double").alias("balance_total"))
    issues = b.issues(spark, d).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    age = b.versions(spark, d).agg(F.date_diff(F.lit("2026-01-01").cast("date"), F.max("published").cast("date")).cast("long").alias("version_age_days"))
    return flow.crossJoin(balance).crossJoin(issues).crossJoin(age)  # one row each


@query("win_09_stored_or_derived", f"""WITH {b.SQL_FLOW}, {b.SQL_BALANCE}, derived AS (SELECT 'flow' AS metric, entity, {DEC.format('amount')} AS value FROM flow GROUP BY entity UNION ALL SELECT 'assets', entity, {DEC.format('combined')} FROM balance WHERE account = '{ACCOUNTS['total_assets']}' GROUP BY entity),
 stored AS (SELECT 'flow' AS metric, n_nationkey AS entity, CAST(n_nationkey % 7 AS DOUBLE) AS value FROM nation), picked AS (SELECT * FROM stored UNION ALL SELECT * FROM derived WHERE metric NOT IN (SELECT metric FROM stored))
 SELECT metric, entity, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, entity) AS INT) AS rank FROM picked QUALIFY rank <= 12""")
def _(spark, d):
    flow = b.flow(spark, d).groupBy("entity").agg(money(F.col("amount")).cast("double").alias("value")).select(F.lit("flow").alias("metric"), "entity", "value")
    assets = b.balance(spark, d).filter(F.col("account") == ACCOUNTS["total_assets"]).groupBy("entity").agg(money(F.col("combined")).cast("double").alias("value")).select(F.lit("assets").alias("metric"), "entity", "value")
    stored = b.entities(spark, d).select(F.lit("flow").alias("metric"), "entity", (F.col("entity") % 7).cast("double").alias("value"))
    derived = flow.unionByName(assets).join(stored.select("metric").distinct(), "metric", "left_anti")
    place = Window.partitionBy("metric").orderBy(F.desc("value"), "entity")
    return stored.unionByName(derived).withColumn("rank", F.row_number().over(place)).filter("rank <= 12")


@query("prj_04_compact_summary", f"WITH {b.SQL_DIRTY}, c AS (SELECT line % 4 AS part, raw, count(*) AS n FROM dirty GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, raw) AS r FROM c) SELECT part, string_agg(raw, '|' ORDER BY r) AS repairs FROM g WHERE r <= 5 GROUP BY part")
def _(spark, d):
    n = b.dirty(spark, d).groupBy((F.col("line") % 4).alias("part"), "raw").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "raw"))).filter("r <= 5")
    return top.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "raw"))), lambda x: x["raw"]), "|").alias("repairs"))


@query("prj_14_defaulted_summary", "SELECT event_id, coalesce(TRY_CAST(props->>'$.new' AS BIGINT), TRY_CAST(props->>'$.k' AS BIGINT), 0) AS matched FROM events")
def _(spark, d):
    of = lambda name: F.get_json_object("props", f"$.{name}").try_cast("long")
    return b.read(spark, d, "events").select("event_id", F.coalesce(of("new"), of("k"), F.lit(0)).alias("matched"))


@query("prj_15_operational_domains", f"WITH {b.SQL_FLOW}, {b.SQL_BALANCE}, s AS (SELECT 'premiums' AS domain, count(*) AS n FROM flow UNION ALL SELECT 'financialPosition', count(*) FROM balance UNION ALL SELECT 'incomeStatement', count(*) FROM nation) SELECT domain, n FROM s WHERE domain IN ('premiums', 'financialPosition')")
def _(spark, d):
    of = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("domain"), "n")
    return of("premiums", b.flow(spark, d)).unionByName(of("financialPosition", b.balance(spark, d))).unionByName(of("incomeStatement", b.entities(spark, d))).filter(F.col("domain").isin("premiums", "financialPosition"))
