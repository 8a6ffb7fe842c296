"""The registered queries of the statistics engine, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regmart.functions import numbers, text
from regmart.operators import aggregates as agg
from regmart.operators import metrics, paging, quality, reconcile, resolve
from regmart.plans import bridge as b
from regmart.sources import workbooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ACCOUNTS = {"total_assets": "1-URGENT", "reserves": "2-HIGH", "equity": "3-MEDIUM"}
DEC = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _by(key: str, view: str = "flow", amount: str = "amount") -> str:
    return f"SELECT {key}, {DEC.format(amount)} AS amount, {DEC.format(amount)} / (SELECT {DEC.format(amount)} FROM {view}) AS share FROM {view} GROUP BY {key}"


# Aggregates


@query("agg_01_flow_total", f"WITH {b.SQL_FLOW} SELECT {DEC.format('amount')} AS total FROM flow")
def _(spark, d):
    return b.flow(spark, d).agg(numbers.money(F.col("amount")).cast("double").alias("total"))


@query("agg_02_account_totals", f"WITH {b.SQL_BALANCE} SELECT " + ", ".join(f"coalesce({DEC.format(f'''CASE WHEN account = '{a}' THEN combined END''')}, 0) AS {n}" for n, a in ACCOUNTS.items()) + " FROM balance")
def _(spark, d):
    return agg.conditional_totals(b.balance(spark, d), [], ACCOUNTS)


@query("agg_03_entities_covered", f"WITH {b.SQL_FLOW}, {b.SQL_BALANCE} SELECT count(*) AS entities FROM (SELECT entity FROM flow UNION SELECT entity FROM balance)")
def _(spark, d):
    return b.flow(spark, d).select("entity").union(b.balance(spark, d).select("entity")).distinct().agg(F.count("*").alias("entities"))


@query("agg_04_kpis", f"""WITH {b.SQL_FLOW}, {b.SQL_BALANCE} SELECT 'total-flow' AS key, {DEC.format('amount')} AS value, 'currency' AS unit FROM flow
 UNION ALL SELECT 'total_assets', {DEC.format("CASE WHEN account = '1-URGENT' THEN combined END")}, 'currency' FROM balance UNION ALL SELECT 'reserves', {DEC.format("CASE WHEN account = '2-HIGH' THEN combined END")}, 'currency' FROM balance
 UNION ALL SELECT 'entities-covered', CAST(count(*) AS DOUBLE), 'count' FROM (SELECT entity FROM flow UNION SELECT entity FROM balance)""")
def _(spark, d):
    return agg.kpis(b.flow(spark, d), b.balance(spark, d), {k: ACCOUNTS[k] for k in ("total_assets", "reserves")})


@query("agg_05_flow_by_entity", f"WITH {b.SQL_FLOW}, g AS ({_by('entity')}) SELECT entity, n_name AS name, amount, share, CAST(row_number() OVER (ORDER BY amount DESC, n_name, entity) AS INT) AS rank FROM g JOIN nation ON entity = n_nationkey")
def _(spark, d):
    rows = agg.with_names(agg.amount_by(b.flow(spark, d), "entity"), b.entities(spark, d), "entity", "entity_name")
    return agg.ranked(rows, "amount", "name", "entity", top=1 << 30).select("entity", "name", "amount", "share", "rank")


@query("agg_06_flow_by_category", f"WITH {b.SQL_FLOW} {_by('category')}")
def _(spark, d):
    return agg.amount_by(b.flow(spark, d), "category")


@query("agg_07_balance_highlights", f"WITH {b.SQL_BALANCE} SELECT entity, " + ", ".join(f"coalesce({DEC.format(f'''CASE WHEN account = '{a}' THEN combined END''')}, 0) AS {n}" for n, a in ACCOUNTS.items()) + " FROM balance GROUP BY entity")
def _(spark, d):
    return agg.conditional_totals(b.balance(spark, d), ["entity"], ACCOUNTS)


@query("agg_08_balance_rows", f"WITH {b.SQL_BALANCE} SELECT n_nationkey AS entity, count(source_row) AS n FROM nation LEFT JOIN balance ON entity = n_nationkey GROUP BY 1")
def _(spark, d):
    counts = b.balance(spark, d).groupBy("entity").agg(F.count("*").alias("n"))
    return b.entities(spark, d).join(counts, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_10_last_assets_by_entity", f"WITH {b.SQL_BALANCE} SELECT entity, arg_max(combined, source_row) AS combined FROM balance WHERE account = '1-URGENT' GROUP BY entity")
def _(spark, d):
    return agg.last_by(b.balance(spark, d).filter(F.col("account") == ACCOUNTS["total_assets"]), "entity", "combined", "source_row")


@query("agg_09_flow_actuals", f"WITH {b.SQL_FLOW} SELECT entity, {DEC.format('amount')} AS actual FROM flow GROUP BY entity")
def _(spark, d):
    return _flow_actuals(spark, d)


def _flow_actuals(spark, d):
    return b.flow(spark, d).groupBy("entity").agg(numbers.money(F.col("amount")).cast("double").alias("actual"))


# Entity resolution


def _resolved(spark, d):
    return resolve.resolve(b.dirty(spark, d), b.entity_aliases(spark, d), b.entity_catalog(spark, d), text.normalize_entity_alias)


@query("jn_01_staged_resolution", f"WITH {b.SQL_RESOLVED} SELECT raw, strategy, target, n AS candidates FROM resolved")
def _(spark, d):
    return _resolved(spark, d).select("raw", "strategy", "target", F.size("candidates").cast("long").alias("candidates"))


@query("jn_02_resolve_entity_rows", f"WITH {b.SQL_RESOLVED} SELECT s_suppkey, strategy, target FROM dirty JOIN resolved ON dirty.raw = resolved.raw")
def _(spark, d):
    return b.dirty(spark, d).join(_resolved(spark, d), "raw").select("s_suppkey", "strategy", "target")


def _with_fallback(spark, d):
    return resolve.with_line_fallback(b.dirty(spark, d).join(_resolved(spark, d), "raw"), b.entity_catalog(spark, d))


_FALLBACK = b.SQL_RESOLVED + """, final AS (SELECT s_suppkey, dirty.raw, dirty.line, CASE WHEN strategy = 'unresolved' AND n_nationkey IS NOT NULL THEN 'line-number-fallback' ELSE strategy END AS strategy,
 CASE WHEN strategy = 'unresolved' AND n_nationkey IS NOT NULL THEN CAST(n_nationkey AS VARCHAR) ELSE target END AS target FROM dirty JOIN resolved ON dirty.raw = resolved.raw LEFT JOIN nation ON n_nationkey = dirty.line)"""


@query("jn_05_line_fallback", f"WITH {_FALLBACK} SELECT s_suppkey, strategy, target FROM final")
def _(spark, d):
    return _with_fallback(spark, d).select("s_suppkey", "strategy", "target")


@query("jn_06_containment_candidates", f"WITH {b.SQL_RESOLVED} SELECT resolved.raw, count(DISTINCT n_nationkey) AS candidates FROM resolved JOIN d ON d.raw = resolved.raw JOIN nation ON contains(d.key, n_name) OR contains(n_name, d.key) WHERE strategy = 'unresolved' AND length(d.key) >= 4 GROUP BY 1")
def _(spark, d):
    found = resolve.containment_candidates(_resolved(spark, d).filter("strategy = 'unresolved'"), b.entity_catalog(spark, d), text.normalize_entity_alias)
    return found.select("raw", F.size("candidates").cast("long").alias("candidates"))


@query("jn_07_evidence", f"WITH {b.SQL_RESOLVED} SELECT resolved.raw, d.key AS normalized, CASE WHEN strategy LIKE 'direct%' THEN false WHEN strategy LIKE 'normalized%' THEN true ELSE trim(regexp_replace(regexp_replace(upper(d.raw), '[().,/]+', ' ', 'g'), '\\s+', ' ', 'g')) <> d.raw END AS required FROM resolved JOIN d ON d.raw = resolved.raw")
def _(spark, d):
    raw = F.col("raw")
    return _resolved(spark, d).select("raw", text.normalize_entity_alias(raw).alias("normalized"), text.required_normalization(F.col("strategy"), raw).alias("required"))


@query("jn_08_facts", f"WITH {_FALLBACK} SELECT s_suppkey, target FROM final WHERE target IS NOT NULL")
def _(spark, d):
    return resolve.split_resolved(_with_fallback(spark, d), ["target"])[0].select("s_suppkey", "target")


@query("jn_08_rejects", f"WITH {_FALLBACK} SELECT s_suppkey, strategy, 'target' AS reference FROM final WHERE target IS NULL")
def _(spark, d):
    return resolve.split_resolved(_with_fallback(spark, d), ["target"])[1].select("s_suppkey", "strategy", "reference")


@query("jn_09_name_or_id", f"WITH {b.SQL_FLOW} SELECT entity, coalesce(CASE WHEN entity % 3 > 0 THEN n_name END, CAST(entity AS VARCHAR)) AS name, {DEC.format('amount')} AS amount FROM flow JOIN nation ON entity = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    sums = b.flow(spark, d).groupBy("entity").agg(numbers.money(F.col("amount")).cast("double").alias("amount"))
    return agg.with_names(sums, b.entities(spark, d).filter("entity % 3 > 0"), "entity", "entity_name").select("entity", "name", "amount")


@query("jn_10_entity_detail", f"""WITH {b.SQL_FLOW}, {b.SQL_BALANCE}, f AS (SELECT entity, {DEC.format('amount')} AS amount FROM flow GROUP BY 1), x AS (SELECT entity, count(*) AS n, {DEC.format('combined')} AS combined FROM balance GROUP BY 1)
 SELECT n_nationkey AS entity, n_name AS name, coalesce(amount, 0) AS flow_amount, coalesce(n, 0) AS balance_rows, coalesce(combined, 0) AS balance_amount FROM nation LEFT JOIN f ON f.entity = n_nationkey LEFT JOIN x ON x.entity = n_nationkey""")
def _(spark, d):
    f = b.flow(spark, d).groupBy("entity").agg(numbers.money(F.col("amount")).cast("double").alias("flow_amount"))
    x = b.balance(spark, d).groupBy("entity").agg(F.count("*").alias("balance_rows"), numbers.money(F.col("combined")).cast("double").alias("balance_amount"))
    return b.entities(spark, d).withColumnRenamed("entity_name", "name").join(f, "entity", "left").join(x, "entity", "left").na.fill(0, ["flow_amount", "balance_rows", "balance_amount"])


@query("agg_11_mapping_counters", f"""WITH {_FALLBACK}, e AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, strategy FROM final) SELECT domain, count(*) AS total, count(*) FILTER (strategy LIKE 'direct%' OR strategy LIKE 'normalized%') AS aliases_matched,
 count(*) FILTER (strategy LIKE 'direct%') AS resolved_directly, count(*) FILTER (strategy LIKE 'normalized%') AS resolved_after_normalization, count(*) FILTER (strategy = 'line-number-fallback') AS line_fallback,
 count(*) FILTER (strategy = 'ambiguous') AS ambiguous, count(*) FILTER (strategy = 'unresolved') AS unresolved FROM e GROUP BY ROLLUP (domain)""")
def _(spark, d):
    return resolve.counters(_with_fallback(spark, d).withColumn("domain", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd")))


@query("agg_12_top_repairs", f"WITH {_FALLBACK} SELECT strategy, raw, target, count(*) AS n FROM final WHERE strategy LIKE 'normalized%' GROUP BY ALL ORDER BY n DESC, raw LIMIT 8")
def _(spark, d):
    return _with_fallback(spark, d).filter(F.col("strategy").startswith("normalized")).groupBy("strategy", "raw", "target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "raw").limit(8)


@query("agg_13_examples", f"WITH {_FALLBACK} SELECT strategy, raw, s_suppkey FROM final QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY s_suppkey) <= 8")
def _(spark, d):
    return agg.top_rows(_with_fallback(spark, d), "strategy", [F.col("s_suppkey")], 8).select("strategy", "raw", "s_suppkey")


@query("jn_14_active_artifacts", f"WITH {b.SQL_VERSIONS} SELECT id, status FROM versions WHERE id = (SELECT max(id) FROM versions)")
def _(spark, d):
    v = b.versions(spark, d)
    return v.join(v.agg(F.max("id").alias("id")), "id", "left_semi").select("id", "status")


# Windows and limits


@query("win_01_rankings", f"WITH {b.SQL_FLOW}, g AS ({_by('entity')}) SELECT entity, n_name AS name, amount, CAST(row_number() OVER (ORDER BY amount DESC, n_name, entity) AS INT) AS rank FROM g JOIN nation ON entity = n_nationkey QUALIFY rank <= 12")
def _(spark, d):
    rows = agg.with_names(agg.amount_by(b.flow(spark, d), "entity"), b.entities(spark, d), "entity", "entity_name")
    return agg.ranked(rows, "amount", "name", "entity").select("entity", "name", "amount", "rank")


@query("win_02_top20_by_entity", f"WITH {b.SQL_FLOW} SELECT entity, amount, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY entity ORDER BY amount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS position FROM flow QUALIFY position <= 20")
def _(spark, d):
    order = [F.col("amount").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return agg.top_rows(b.flow(spark, d), "entity", order, 20).select("entity", "amount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "position")


@query("win_03_share_of_total", f"WITH {b.SQL_FLOW} {_by('parent')}")
def _(spark, d):
    sums = b.flow(spark, d).groupBy("parent").agg(numbers.money(F.col("amount")).alias("sum"))
    total = F.sum("sum").over(Window.partitionBy(F.lit(1))).cast("double")
    return sums.select("parent", F.col("sum").cast("double").alias("amount"), numbers.safe_ratio(F.col("sum").cast("double"), total).alias("share"))


@query("win_04_later_occurrences", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return quality.duplicates(b.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("extra"))


@query("win_07_latest_three", f"WITH {b.SQL_VERSIONS} SELECT id, status FROM versions ORDER BY coalesce(published, created) DESC, id DESC LIMIT 3")
def _(spark, d):
    return b.versions(spark, d).orderBy(F.coalesce("published", "created").desc(), F.desc("id")).limit(3).select("id", "status")


@query("lim_01_public_page", f"WITH {b.SQL_FLOW} {_by('category')} ORDER BY amount DESC, category LIMIT 10 OFFSET 10")
def _(spark, d):
    return paging.public_page(agg.amount_by(b.flow(spark, d), "category"), [F.desc("amount"), F.col("category")], 2, 10)


@query("lim_02_admin_page", f"WITH {b.SQL_FLOW} {_by('category')} ORDER BY amount DESC, category LIMIT 10 OFFSET 20")
def _(spark, d):
    return paging.admin_page(agg.amount_by(b.flow(spark, d), "category"), [F.desc("amount"), F.col("category")], 99, 10)[0]


@query("lim_03_overview", f"WITH {b.SQL_FLOW} {_by('category')} ORDER BY amount DESC, category LIMIT 12")
def _(spark, d):
    return agg.amount_by(b.flow(spark, d), "category").orderBy(F.desc("amount"), "category").limit(12)


@query("lim_05_newest_first", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    return b.read(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type")


@query("prj_07_search", "SELECT n_nationkey AS entity, n_name AS entity_name FROM nation WHERE contains(lower(n_name), 'ion_1')")
def _(spark, d):
    return paging.search(b.entities(spark, d), "entity_name", "  ION_1 ")


# Quality


@query("val_01_08_source_rules", f"""WITH {b.SQL_FLOW}, {b.SQL_BALANCE} SELECT 'INCOME_STATEMENT_SOURCE_NOT_PROVIDED' AS code, 'low' AS severity, 'warning' AS status UNION ALL SELECT 'PREMIUM_MULTIPLE_PERIODS', 'high', 'failed' FROM flow HAVING count(DISTINCT period) > 1
 UNION ALL SELECT 'FINANCIAL_MULTIPLE_PERIODS', 'high', 'failed' FROM balance HAVING count(DISTINCT period) > 1 UNION ALL SELECT 'REFERENCE_WORKBOOK_NOT_PROVIDED', 'low', 'warning'""")
def _(spark, d):
    nothing = b.balance(spark, d).filter(F.lit(False))
    return quality.source_rules(b.flow(spark, d), b.balance(spark, d), nothing, nothing)


@query("val_09_duplicate_keys", f"WITH {b.SQL_FLOW} SELECT entity, parent, category, currency, period, count(*) - 1 AS extra FROM flow GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    key = ["entity", "parent", "category", "currency", "period"]
    return quality.duplicate_counts(b.flow(spark, d), key)


@query("val_10_account_present", f"WITH {b.SQL_BALANCE} SELECT entity, bool_or(account = '1-URGENT') AS present FROM balance GROUP BY entity")
def _(spark, d):
    return b.balance(spark, d).groupBy("entity").agg(F.bool_or(F.col("account") == ACCOUNTS["total_assets"]).alias("present"))


@query("agg_14_publishability", f"WITH {b.SQL_ISSUES} SELECT scope, ['publishable', 'warningOnly', 'blocked'][1 + max(CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)] AS level FROM issues GROUP BY scope")
def _(spark, d):
    return b.issues(spark, d).groupBy("scope").agg(quality.publishability(F.col("severity")).alias("level"))


@query("agg_15_publishability_lenient", f"WITH {b.SQL_ISSUES} SELECT scope, ['publishable', 'warningOnly', 'blocked'][1 + max(CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1 WHEN 'medium' THEN 1 ELSE 0 END)] AS level FROM issues GROUP BY scope")
def _(spark, d):
    return b.issues(spark, d).groupBy("scope").agg(quality.publishability(F.col("severity"), strict=False).alias("level"))


@query("agg_16_merged_level", f"""WITH {b.SQL_ISSUES} SELECT scope, ['publishable', 'warningOnly', 'blocked'][1 + greatest(max(CASE WHEN code < 'm' THEN CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END ELSE 0 END),
 max(CASE WHEN code >= 'm' THEN CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1 WHEN 'medium' THEN 1 ELSE 0 END ELSE 0 END))] AS level FROM issues GROUP BY scope""")
def _(spark, d):
    s = F.col("severity")
    both = b.issues(spark, d).groupBy("scope").agg(quality.publishability(F.when(F.col("code") < "m", s)).alias("v"), quality.publishability(F.when(F.col("code") >= "m", s), strict=False).alias("r"))
    return both.select("scope", quality.worse(F.col("v"), F.col("r")).alias("level"))


@query("agg_17_severity_counts", f"WITH {b.SQL_ISSUES} SELECT scope, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in quality.SEVERITIES) + " FROM issues GROUP BY scope")
def _(spark, d):
    return quality.severity_counts(b.issues(spark, d), ["scope"])


@query("agg_18_action_counts", "SELECT coalesce(event_type, 'UNKNOWN') AS action, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return b.read(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("UNKNOWN")).alias("action")).agg(F.count("*").alias("n"))


@query("agg_19_input_fingerprint", f"WITH {b.SQL_FILES}, h AS (SELECT file_id // 5 AS run, sha256(content) AS h FROM files) SELECT run, sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM h GROUP BY run")
def _(spark, d):
    hashed = b.files(spark, d).select(F.floor(F.col("file_id") / 5).alias("run"), F.sha2("content", 256).alias("h"))  # an upload holds at most five files, so the list stays short
    return hashed.groupBy("run").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("fingerprint"))


@query("agg_20_periods", f"WITH {b.SQL_FLOW} SELECT entity, count(DISTINCT period) AS periods FROM flow GROUP BY entity")
def _(spark, d):
    return b.flow(spark, d).groupBy("entity").agg(F.count_distinct("period").alias("periods"))


@query("agg_21_duplicate_roles", f"WITH {b.SQL_FILES} SELECT run, kind, count(*) AS n FROM files GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return b.files(spark, d).groupBy("run", "kind").agg(F.count("*").alias("n")).filter("n > 1")


@query("agg_24_route_metrics", f"""WITH {b.SQL_REQUESTS}, r AS (SELECT *, struct_pack(ts := ts, duration := duration, status := status, bytes := bytes) AS last FROM requests) SELECT route, count(*) AS n, count(*) FILTER (status >= 400) AS errors, CAST(round(CAST(sum(CAST(duration AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS DOUBLE) AS avg_duration,
 max(duration) AS max_duration, arg_max(duration, last) AS last_duration, max(bytes) AS max_bytes, arg_max(bytes, last) AS last_bytes, CAST(arg_max(status, last) AS INT) AS last_status FROM r GROUP BY route""")
def _(spark, d):
    return b.requests(spark, d).groupBy("route").agg(*metrics.route_metrics()).drop("last_seen")


@query("agg_25_inflation_ratio", "SELECT l_orderkey AS file, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS compressed, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS inflated, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS ratio FROM lineitem GROUP BY 1")
def _(spark, d):
    sums = b.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(numbers.money(F.col("l_quantity")).cast("double").alias("compressed"), numbers.money(F.col("l_extendedprice")).cast("double").alias("inflated"))
    return sums.withColumn("ratio", workbooks.inflation_ratio(F.col("compressed"), F.col("inflated")))


@query("sec_06_07_entry_flags", "SELECT l_orderkey AS file, bool_or(contains(p_name, 'ring')) AS macro, bool_or(contains(p_name, 'bolt')) AS encrypted, count(*) AS entries FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark, d):
    entries = b.read(spark, d, "lineitem").join(b.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return entries.groupBy(F.col("l_orderkey").alias("file")).agg(F.bool_or(F.col("p_name").contains("ring")).alias("macro"), F.bool_or(F.col("p_name").contains("bolt")).alias("encrypted"), F.count("*").alias("entries"))


# Reconciliation


_CONTROL = "control AS (SELECT entity, actual * CASE WHEN entity % 7 = 0 THEN 1.01 ELSE 1.0 END AS expected FROM actual WHERE entity % 11 <> 0)"


def _control(actual: DataFrame) -> DataFrame:
    return actual.filter("entity % 11 <> 0").select("entity", (F.col("actual") * F.when(F.col("entity") % 7 == 0, 1.01).otherwise(1.0)).alias("expected"))


def _rec(rule: str, join: str) -> str:
    return f"""SELECT a.entity, CASE WHEN expected IS NULL THEN 'REFERENCE_PREMIUM_INSTITUTION_MISSING' ELSE '{rule}' END AS rule, CASE WHEN expected IS NULL THEN 'medium' WHEN abs((actual - expected) / expected) > 0.001 THEN 'high' ELSE 'low' END AS severity,
 CASE WHEN expected IS NULL OR abs((actual - expected) / expected) > 0.001 THEN 'warning' ELSE 'passed' END AS status, actual, expected, actual - expected AS absolute_difference, (actual - expected) / expected AS relative_difference FROM actual a {join} JOIN control c ON a.entity = c.entity"""


@query("rec_05_flow", f"WITH {b.SQL_FLOW}, actual AS (SELECT entity, {DEC.format('amount')} AS actual FROM flow GROUP BY entity), {_CONTROL} {_rec('PREMIUM_TOTAL_BY_INSTITUTION', 'LEFT')}")
def _(spark, d):
    actual = _flow_actuals(spark, d)
    return reconcile.reconcile(actual, _control(actual), "entity", "PREMIUM_TOTAL_BY_INSTITUTION")


@query("rec_06_balance", f"WITH {b.SQL_BALANCE}, actual AS (SELECT entity, arg_max(combined, source_row) AS actual FROM balance WHERE account = '1-URGENT' GROUP BY entity), {_CONTROL} {_rec('ASSETS_TOTAL_BY_INSTITUTION', '')}")
def _(spark, d):
    assets = b.balance(spark, d).filter(F.col("account") == ACCOUNTS["total_assets"])
    actual = agg.last_by(assets, "entity", "combined", "source_row").withColumnRenamed("combined", "actual")
    return reconcile.reconcile(actual, _control(actual), "entity", "ASSETS_TOTAL_BY_INSTITUTION", report_missing=False)


# Files, scalars, projections


@query("src_01_phantom_files", f"WITH {b.SQL_FILES} SELECT file_id, name, size FROM files WHERE lower(trim(name)) NOT IN ('', 'blob') AND size > 0")
def _(spark, d):
    clean = F.lower(F.trim("name"))
    return b.files(spark, d).filter(~clean.isin("", "blob") & (F.col("size") > 0)).select("file_id", "name", "size")


@query("src_02_registered_files", f"WITH {b.SQL_FILES} SELECT file_id, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS stored_name, sha256(content) AS sha256, size FROM files")
def _(spark, d):
    return b.files(spark, d).select("file_id", text.sanitize_filename(F.col("name")).alias("stored_name"), F.sha2("content", 256).alias("sha256"), "size")


@query("sec_01_04_screening", f"WITH {b.SQL_FILES} SELECT file_id, unnest(list_filter([CASE WHEN NOT ends_with(lower(name), '.xlsx') THEN 'SECURITY_EXTENSION_REJECTED' END, CASE WHEN size > 5000 THEN 'SECURITY_SIZE_LIMIT' END, CASE WHEN content[1:2] <> 'PK' THEN 'SECURITY_MAGIC_BYTES' END], lambda x: x IS NOT NULL)) AS code FROM files")
def _(spark, d):
    files = b.files(spark, d)
    no, none = F.lit(False), F.lit(0)
    stats = files.select(F.col("file_id").alias("file"), "name", "size", F.coalesce(F.substring("content", 1, 2) == "PK", no).alias("is_archive"), none.alias("entries"), none.alias("compressed"), none.alias("inflated"), no.alias("macro"), no.alias("encrypted"), no.alias("protected"))
    return workbooks.screen(stats, F.col("name"), F.lit(workbooks.ALLOWED_MIME[0]), max_bytes=5000).select(F.col("file").alias("file_id"), "code")


@query("scl_10_serial_period", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS report_date, CAST(year(o_orderdate) AS INT) AS report_year, CAST(month(o_orderdate) AS INT) AS report_month, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def _(spark, d):
    serial = F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")) + 25569
    return b.read(spark, d, "orders").select("o_orderkey", *numbers.period_columns(numbers.serial_to_date(serial)))


@query("scl_12_number_value", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount FROM orders")
def _(spark, d):
    raw = F.when(F.col("o_orderkey") % 7 == 0, " ").when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return b.read(spark, d, "orders").select("o_orderkey", numbers.number_value(raw).alias("amount"))


@query("scl_07_strip_diacritics", "SELECT doc_id, replace(strip_accents(replace(text, 'ß', chr(57344))), chr(57344), 'ß') AS plain FROM documents")
def _(spark, d):
    return b.read(spark, d, "documents").select("doc_id", text.strip_diacritics(F.col("text")).alias("plain"))


@query("scl_01_repair_mojibake")
def _(spark, d):
    repaired = text.repair_mojibake(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    return b.read(spark, d, "documents").select("doc_id", repaired.alias("repaired"), (repaired == F.col("text")).alias("same"))


@query("scl_08_slug", "SELECT n_nationkey, regexp_replace(trim(regexp_replace(lower(n_name), '[^a-z0-9\\s-]', '', 'g')), '[\\s-]+', '-', 'g') AS slug FROM nation")
def _(spark, d):
    return b.read(spark, d, "nation").select("n_nationkey", text.slug_key(F.col("n_name")).alias("slug"))


@query("prj_08_semantic_category", "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'netIncome' WHEN contains(o_orderpriority, 'HIGH') THEN 'retainedPremiums' WHEN contains(o_orderpriority, 'LOW') THEN 'expenses' ELSE 'other' END AS category FROM orders")
def _(spark, d):
    p = F.upper("o_orderpriority")
    return b.read(spark, d, "orders").select("o_orderkey", F.when(p.contains("URGENT"), "netIncome").when(p.contains("HIGH"), "retainedPremiums").when(p.contains("LOW"), "expenses").otherwise("other").alias("category"))


@query("prj_18_active_flag", f"WITH {b.SQL_VERSIONS} SELECT id, id = (SELECT max(id) FROM versions) AS active, CASE WHEN id = (SELECT max(id) FROM versions) THEN 'active' ELSE status END AS status FROM versions")
def _(spark, d):
    v = b.versions(spark, d)
    pointer = v.agg(F.max("id").alias("pointer"))
    flag = F.col("id") == F.col("pointer")
    return v.crossJoin(F.broadcast(pointer)).select("id", flag.alias("active"), F.when(flag, "active").otherwise(F.col("status")).alias("status"))  # the pointer is one row


@query("prj_17_chart_series", f"WITH {b.SQL_FLOW}, g AS ({_by('category')}) SELECT category AS label, share * 100 AS value FROM g ORDER BY value DESC, label LIMIT 8")
def _(spark, d):
    return agg.amount_by(b.flow(spark, d), "category").select(F.col("category").alias("label"), (F.col("share") * 100).alias("value")).orderBy(F.desc("value"), "label").limit(8)


# Set operations


@query("set_01_union_issues", f"WITH {b.SQL_ISSUES} SELECT code, severity, scope, 'a' AS origin FROM issues WHERE severity = 'high' UNION ALL SELECT code, severity, scope, 'b' FROM issues WHERE severity = 'critical'")
def _(spark, d):
    i = b.issues(spark, d)
    return i.filter("severity = 'high'").withColumn("origin", F.lit("a")).unionByName(i.filter("severity = 'critical'").withColumn("origin", F.lit("b")), allowMissingColumns=True)


@query("set_03_distinct_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return b.read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


# Extensions


@query("ext_01_flow_by_parent", f"WITH {b.SQL_FLOW} SELECT parent, {DEC.format('amount')} AS amount FROM flow GROUP BY parent")
def _(spark, d):
    return b.flow(spark, d).groupBy("parent").agg(numbers.money(F.col("amount")).cast("double").alias("amount"))


@query("ext_02_rollup", f"WITH {b.SQL_FLOW} SELECT parent, category, {DEC.format('amount')} AS amount, CAST(grouping_id(parent, category) AS BIGINT) AS level FROM flow GROUP BY ROLLUP (parent, category)")
def _(spark, d):
    return b.flow(spark, d).rollup("parent", "category").agg(numbers.money(F.col("amount")).cast("double").alias("amount"), F.grouping_id().cast("long").alias("level"))


@query("ext_03_yoy", f"WITH {b.SQL_FLOW}, m AS (SELECT entity, CAST(left(period, 4) AS INT) AS year, right(period, 2) AS month, {DEC.format('amount')} AS amount FROM flow GROUP BY 1, 2, 3) SELECT entity, year, month, amount, lag(amount) OVER (PARTITION BY entity, month ORDER BY year) AS before FROM m")
def _(spark, d):
    m = b.flow(spark, d).groupBy("entity", F.left("period", F.lit(4)).cast("int").alias("year"), F.right("period", F.lit(2)).alias("month")).agg(numbers.money(F.col("amount")).cast("double").alias("amount"))
    return m.withColumn("before", F.lag("amount").over(Window.partitionBy("entity", "month").orderBy("year")))


@query("ext_04_composition", f"WITH {b.SQL_BALANCE}, g AS (SELECT entity, account, sum(CAST(combined AS DECIMAL(18,2))) AS s FROM balance GROUP BY 1, 2) SELECT entity, account, CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY entity) AS DOUBLE) AS share FROM g")
def _(spark, d):
    g = b.balance(spark, d).groupBy("entity", "account").agg(numbers.money(F.col("combined")).alias("s"))
    return g.select("entity", "account", numbers.safe_ratio(F.col("s").cast("double"), F.sum("s").over(Window.partitionBy("entity")).cast("double")).alias("share"))


@query("ext_12_unsupported_currency", f"WITH {b.SQL_FLOW} SELECT currency, count(*) AS n FROM flow WHERE currency NOT IN ('A', 'N') GROUP BY 1")
def _(spark, d):
    known = spark.createDataFrame([("A",), ("N",)], "currency string")
    return b.flow(spark, d).join(F.broadcast(known), "currency", "left_anti").groupBy("currency").agg(F.count("*").alias("n"))
