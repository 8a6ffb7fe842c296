"""Registered queries over sheets, versions, pointers and published views, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from regmart.functions import numbers
from regmart.operators import aggregates as agg
from regmart.operators import reconcile
from regmart.plans import bridge as b
from regmart.plans.registry import ACCOUNTS, DEC
from regmart.sources import store, workbooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def total(amount: str):
    return numbers.money(F.col(amount)).cast("double")


# Sheets: a file of suppliers for each nation, headers by alias, every seventh code unreadable


def _cells(spark, d):
    s = b.read(spark, d, "supplier").withColumn("row", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) + 1)
    code = F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise(F.col("s_suppkey").cast("string"))
    body = s.select(F.col("s_nationkey").cast("string").alias("file"), F.lit(1).alias("sheet_index"), F.lit("Data").alias("sheet"), "row", F.posexplode(F.array(F.col("s_name"), code)).alias("col", "value"))
    files = s.select(F.col("s_nationkey").cast("string").alias("file")).distinct()
    fixed = ((0, "Notes", 0, "Entity"), (1, "Data", 0, "Entity"), (1, "Data", 1, "Code."))
    listed = [F.struct(F.lit(i).alias("sheet_index"), F.lit(n).alias("sheet"), F.lit(1).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for i, n, c, v in fixed]
    head = files.select("file", F.explode(F.array(*listed)).alias("x")).select("file", "x.*")
    return head.unionByName(body)


def _heads(spark, d):
    return workbooks.headers(_cells(spark, d), spark.createDataFrame([("ENTITY", "name", 1), ("CODE", "code", 2)], "header_key string, canonical string, position int"))


@query("src_06_canonical_headers", "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS file, sheet, CAST(col AS INT) AS col, header FROM supplier, (VALUES ('Notes', 0, 'name'), ('Data', 0, 'name'), ('Data', 1, 'code')) h(sheet, col, header)")
def _(spark, d):
    return _heads(spark, d).select("file", "sheet", "col", "header")


@query("src_05_chosen_sheet", "SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS file, 'Data' AS sheet FROM supplier")
def _(spark, d):
    return workbooks.choose_sheet(_heads(spark, d), ["name", "code"], ["Data"]).select("file", "sheet")


def _records(spark, d):
    heads = _heads(spark, d)
    return workbooks.records(_cells(spark, d), heads, workbooks.choose_sheet(heads, ["name", "code"], ["Data"]), ["name", "code"])


_SQL_RECORDS = "r AS (SELECT CAST(s_nationkey AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS INT) AS source_row, s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(s_suppkey AS VARCHAR) END AS code FROM supplier)"
_SCHEMA = StructType([StructField("name", StringType(), False), StructField("code", LongType())])


@query("src_07_records", f"WITH {_SQL_RECORDS} SELECT * FROM r")
def _(spark, d):
    return _records(spark, d)


@query("src_08_conforming_rows", f"WITH {_SQL_RECORDS} SELECT file, source_row, name, TRY_CAST(code AS BIGINT) AS code FROM r WHERE code <> 'n/a'")
def _(spark, d):
    return workbooks.conform(_records(spark, d), _SCHEMA)[0]


@query("src_08_row_issues", f"""WITH {_SQL_RECORDS} SELECT file, source_row, 'code' AS "column", code AS value FROM r WHERE code = 'n/a'""")
def _(spark, d):
    return workbooks.conform(_records(spark, d), _SCHEMA)[1]


@query("src_11_control_totals", "SELECT CAST(o_custkey AS VARCHAR) AS file, 'flow' AS measure, o_orderpriority AS key, arg_max(o_totalprice, o_orderkey) * 1000 AS expected FROM orders GROUP BY ALL")
def _(spark, d):
    o = b.read(spark, d, "orders").withColumn("col", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    two = F.array(F.struct(F.lit(5).alias("row"), F.col("o_orderpriority").alias("value")), F.struct(F.lit(9).alias("row"), F.col("o_totalprice").cast("string").alias("value")))
    table = o.select(F.col("o_custkey").cast("string").alias("file"), F.lit("Totals").alias("sheet"), "col", F.explode(two).alias("x")).select("file", "sheet", "col", "x.*")
    layout = spark.createDataFrame([("Totals", 5, 9, 1, 1 << 30, "flow")], "sheet string, header_row int, value_row int, col_from int, col_to int, measure string")
    return workbooks.control_totals(table, layout)


# Fixed test weights of the signals, by kind.
_WEIGHTS = [("click", "click", 3.0), ("view", "view", 4.0), ("purchase", "purchase", 8.0), ("signup", "signup", 5.0), ("error", "error", 6.0)]
_SQL_SCORES = "w(kind, weight) AS (VALUES " + ", ".join(f"('{k}', {w})" for k, _, w in _WEIGHTS) + "), scores AS (SELECT user_id AS file, kind, CAST(sum(weight) AS DOUBLE) AS score FROM events JOIN w ON event_type = kind GROUP BY 1, 2), p AS (SELECT *, row_number() OVER o AS n, coalesce(lead(score) OVER o, 0) AS second FROM scores WINDOW o AS (PARTITION BY file ORDER BY score DESC, kind))"


def _scores(spark, d):
    hits = b.read(spark, d, "events").groupBy(F.col("user_id").alias("file"), F.col("event_type").alias("kind")).agg(F.count("*").alias("hits")).withColumn("signal", F.col("kind"))
    return workbooks.kind_scores(hits, spark.createDataFrame(_WEIGHTS, "kind string, signal string, weight double"))


@query("src_12_kind_scores", f"WITH {_SQL_SCORES} SELECT file, kind, score FROM scores")
def _(spark, d):
    return _scores(spark, d)


@query("src_13_classification", f"WITH {_SQL_SCORES} SELECT file, CASE WHEN score >= 40 AND score - second >= 8 THEN kind END AS kind, score AS best, CAST(second AS DOUBLE) AS second, least(1.0, score / (score + second)) AS confidence FROM p WHERE n = 1")
def _(spark, d):
    return workbooks.classify(_scores(spark, d)).drop("candidates")


@query("val_17_unrecognized", f"WITH {_SQL_SCORES} SELECT file, 'WORKBOOK_SCHEMA_UNRECOGNIZED' AS code, 'critical' AS severity FROM p WHERE n = 1 AND NOT (score >= 40 AND score - second >= 8)")
def _(spark, d):
    return workbooks.classification_issues(workbooks.classify(_scores(spark, d)))


@query("val_18_duplicated_roles", f"WITH {_SQL_SCORES} SELECT file % 10 AS run, kind, 'WORKBOOK_ROLE_DUPLICATED' AS code, 'critical' AS severity FROM p WHERE n = 1 AND score >= 40 AND score - second >= 8 GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return workbooks.duplicate_roles(workbooks.classify(_scores(spark, d)).withColumn("run", F.col("file") % 10))


# Projections


@query("prj_01_version_list", f"WITH {b.SQL_VERSIONS} SELECT id, created, published, status FROM versions")
def _(spark, d):
    return b.versions(spark, d).select("id", "created", "published", "status")


@query("prj_02_run_list", f"WITH {b.SQL_ISSUES} SELECT scope, count(*) FILTER (code = 'error') AS kept FROM issues GROUP BY scope")
def _(spark, d):
    return b.issues(spark, d).groupBy("scope").agg(F.count_if(F.col("code") == "error").alias("kept"))


@query("prj_03_audit_list", "SELECT event_id, event_type AS action, ts, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def _(spark, d):
    return b.read(spark, d, "events").select("event_id", F.col("event_type").alias("action"), "ts", F.from_json("props", "k long").getField("k").alias("k"))


@query("prj_05_issue_counts", f"WITH {b.SQL_ISSUES} SELECT scope, count(*) AS issues FROM issues GROUP BY scope")
def _(spark, d):
    return b.issues(spark, d).groupBy("scope").agg(F.count("*").alias("issues"))


@query("prj_06_issues_by_code", f"WITH {b.SQL_ISSUES} SELECT code, severity, scope FROM issues WHERE code = 'error'")
def _(spark, d):
    return b.issues(spark, d).filter(F.col("code") == "error")


_SQL_SCOPE = f"{b.SQL_FLOW}, {b.SQL_BALANCE}, p AS (SELECT n_nationkey AS entity, n_nationkey IN (SELECT entity FROM flow) AS has_flow, n_nationkey IN (SELECT entity FROM balance WHERE account = '1-URGENT' AND entity % 4 > 0) AS has_balance FROM nation)"


def _provided(spark, d):
    f = b.flow(spark, d).select("entity").distinct().withColumn("f", F.lit(True))
    x = b.balance(spark, d).filter("account = '1-URGENT' AND entity % 4 > 0").select("entity").distinct().withColumn("x", F.lit(True))
    return b.entities(spark, d).join(f, "entity", "left").join(x, "entity", "left").select("entity", F.coalesce("f", F.lit(False)).alias("has_flow"), F.coalesce("x", F.lit(False)).alias("has_balance"))


@query("prj_09_scope", f"WITH {_SQL_SCOPE} SELECT entity, CASE WHEN has_flow AND has_balance THEN 'both' WHEN has_flow THEN 'flow-only' WHEN has_balance THEN 'balance-only' ELSE 'none' END AS scope FROM p")
def _(spark, d):
    f, x = F.col("has_flow"), F.col("has_balance")
    return _provided(spark, d).select("entity", F.when(f & x, "both").when(f, "flow-only").when(x, "balance-only").otherwise("none").alias("scope"))


@query("prj_12_coverage", f"WITH {_SQL_SCOPE} SELECT entity, concat_ws(' + ', CASE WHEN has_flow THEN 'flow' END, CASE WHEN has_balance THEN 'balance' END) AS coverage FROM p")
def _(spark, d):
    return _provided(spark, d).select("entity", F.concat_ws(" + ", F.when(F.col("has_flow"), "flow"), F.when(F.col("has_balance"), "balance")).alias("coverage"))


_DOMAINS = ("click", "view", "purchase", "signup", "claims")


@query("prj_10_availability", "SELECT domain, count(event_id) > 0 AS provided, count(event_id) AS records FROM (VALUES " + ", ".join(f"('{x}')" for x in _DOMAINS) + ") v(domain) LEFT JOIN events ON event_type = domain GROUP BY 1")
def _(spark, d):
    counts = b.read(spark, d, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count("*").alias("records"))
    rows = spark.createDataFrame([(x,) for x in _DOMAINS], "domain string").join(counts, "domain", "left").withColumn("records", F.coalesce("records", F.lit(0).cast("long")))
    return rows.select("domain", (F.col("records") > 0).alias("provided"), "records")


@query("prj_11_label", f"WITH {b.SQL_VERSIONS} SELECT id, concat_ws(' | ', 'scope', strftime(coalesce(published, created), '%Y-%m-%d'), status) AS label FROM versions")
def _(spark, d):
    return b.versions(spark, d).select("id", F.concat_ws(" | ", F.lit("scope"), F.date_format(F.coalesce("published", "created"), "yyyy-MM-dd"), "status").alias("label"))


@query("prj_13_headline", f"WITH {b.SQL_ISSUES}, c AS (SELECT scope, count(*) FILTER (severity = 'critical') AS bad, count(*) FILTER (severity = 'high') AS odd, count(*) FILTER (severity = 'medium') AS repaired FROM issues GROUP BY 1) SELECT scope, CASE WHEN bad > 0 THEN 'unresolved' WHEN odd > 0 THEN 'ambiguous' WHEN repaired > 0 THEN 'repaired' ELSE 'clean' END AS headline FROM c")
def _(spark, d):
    n = lambda s: F.count_if(F.col("severity") == s) > 0
    return b.issues(spark, d).groupBy("scope").agg(F.when(n("critical"), "unresolved").when(n("high"), "ambiguous").when(n("medium"), "repaired").otherwise("clean").alias("headline"))


@query("prj_19_preferred_source", f"WITH {b.SQL_FLOW}, {b.SQL_BALANCE}, u AS (SELECT 0 AS source, entity, {DEC.format('combined')} AS amount FROM balance GROUP BY 2 UNION ALL SELECT 1, entity, {DEC.format('amount')} FROM flow GROUP BY 2) SELECT entity, amount FROM u WHERE source = (SELECT min(source) FROM u) ORDER BY amount DESC, entity LIMIT 12")
def _(spark, d):
    first = b.balance(spark, d).groupBy("entity").agg(total("combined").alias("amount")).withColumn("source", F.lit(0))
    both = first.unionByName(b.flow(spark, d).groupBy("entity").agg(total("amount").alias("amount")).withColumn("source", F.lit(1)))
    top = both.orderBy("source", F.desc("amount"), "entity").limit(12)  # the preferred source comes first, so its best twelve are all there
    return top.withColumn("preferred", F.min("source").over(Window.partitionBy())).filter("source = preferred").orderBy(F.desc("amount"), "entity").select("entity", "amount")


# Pointers, status, rules


@query("snk_07_repaired_pointer", "WITH v AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders), c AS (SELECT c_custkey, CAST(c_custkey * 3 AS VARCHAR) AS pointer FROM customer) SELECT c_custkey, CASE WHEN pointer IN (SELECT id FROM v) THEN pointer ELSE (SELECT max(id) FROM v) END AS pointer FROM c")
def _(spark, d):
    v = b.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("version_id"))
    return store.repaired_pointers(b.read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 3).cast("string").alias("pointer")), v)


@query("agg_22_markers_present", f"WITH {b.SQL_BALANCE} SELECT entity, bool_or(account = '1-URGENT') AS has_assets, bool_or(contains(account, 'LOW') OR contains(account, 'HIGH')) AS has_marker FROM balance GROUP BY 1")
def _(spark, d):
    a = F.col("account")
    return b.balance(spark, d).groupBy("entity").agg(F.bool_or(a == ACCOUNTS["total_assets"]).alias("has_assets"), F.bool_or(a.contains("LOW") | a.contains("HIGH")).alias("has_marker"))


@query("agg_23_operational_status", f"WITH {b.SQL_VERSIONS} SELECT count(*) AS versions, count(published) AS published, max(created) AS latest_at, arg_max(status, (created, id)) AS latest_status FROM versions")
def _(spark, d):
    return b.versions(spark, d).agg(F.count("*").alias("versions"), F.count("published").alias("published"), F.max("created").alias("latest_at"), F.max_by("status", F.struct("created", "id")).alias("latest_status"))


@query("agg_26_area_counts", f"WITH {b.SQL_VERSIONS} SELECT CASE WHEN published IS NULL THEN 'staging' ELSE 'published' END AS area, count(*) AS n FROM versions GROUP BY 1")
def _(spark, d):
    return b.versions(spark, d).groupBy(F.when(F.col("published").isNull(), "staging").otherwise("published").alias("area")).agg(F.count("*").alias("n"))


@query("rec_03_period_mismatch", f"WITH {b.SQL_FLOW}, f AS (SELECT entity, max(period) AS period FROM flow GROUP BY 1), {b.SQL_BALANCE}, x AS (SELECT entity, max(period) AS period FROM balance GROUP BY 1) SELECT f.entity, 'PERIOD_MISMATCH_PREMIUM_REFERENCE' AS code, 'medium' AS severity FROM f JOIN x ON f.entity = x.entity WHERE f.period <> x.period")
def _(spark, d):
    f = b.flow(spark, d).groupBy("entity").agg(F.max("period").alias("p"))
    x = b.balance(spark, d).groupBy("entity").agg(F.max("period").alias("q"))
    return f.join(x, "entity").filter("p <> q").select("entity", F.lit("PERIOD_MISMATCH_PREMIUM_REFERENCE").alias("code"), F.lit("medium").alias("severity"))


# Extensions

_OFF = "CASE WHEN abs((actual - expected) / expected) > 0.001 THEN {} ELSE {} END"


@query("ext_05_parent_totals", f"""WITH {b.SQL_FLOW}, a AS (SELECT parent, {DEC.format('amount')} AS actual FROM flow GROUP BY 1), x AS (SELECT parent, actual, actual * CASE WHEN length(parent) % 2 = 0 THEN 1.01 ELSE 1.0 END AS expected FROM a)
 SELECT parent, 'PREMIUM_TOTAL_BY_PARENT' AS rule, {_OFF.format("'high'", "'low'")} AS severity, {_OFF.format("'warning'", "'passed'")} AS status, actual, expected, actual - expected AS absolute_difference, (actual - expected) / expected AS relative_difference FROM x""")
def _(spark, d):
    actual = b.flow(spark, d).groupBy("parent").agg(total("amount").alias("actual"))
    control = actual.select("parent", (F.col("actual") * F.when(F.length("parent") % 2 == 0, 1.01).otherwise(1.0)).alias("expected"))
    return reconcile.reconcile(actual, control, "parent", "PREMIUM_TOTAL_BY_PARENT")


@query("ext_07_rank_changes", f"WITH {b.SQL_FLOW}, {b.SQL_BALANCE}, f AS (SELECT entity, row_number() OVER (ORDER BY {DEC.format('amount')} DESC, entity) AS r FROM flow GROUP BY 1), x AS (SELECT entity, row_number() OVER (ORDER BY {DEC.format('combined')} DESC, entity) AS r FROM balance GROUP BY 1) SELECT coalesce(f.entity, x.entity) AS entity, CAST(f.r AS INT) AS rank_a, CAST(x.r AS INT) AS rank_b FROM f FULL JOIN x ON f.entity = x.entity WHERE f.r IS DISTINCT FROM x.r")
def _(spark, d):
    def places(rows, amount, name):  # a row for each entity is left
        return rows.groupBy("entity").agg(total(amount).alias("s")).select("entity", F.row_number().over(Window.orderBy(F.desc("s"), "entity")).alias(name))

    return places(b.flow(spark, d), "amount", "rank_a").join(places(b.balance(spark, d), "combined", "rank_b"), "entity", "full").filter(~F.col("rank_a").eqNullSafe(F.col("rank_b")))


@query("ext_09_indicators", f"WITH {b.SQL_FLOW} SELECT entity, period, unnest(['amount', 'rows']) AS metric, unnest([{DEC.format('amount')}, CAST(count(*) AS DOUBLE)]) AS value FROM flow GROUP BY entity, period")
def _(spark, d):
    g = b.flow(spark, d).groupBy("entity", "period").agg(total("amount").alias("amount"), F.count("*").cast("double").alias("rows"))
    return g.unpivot(["entity", "period"], ["amount", "rows"], "metric", "value")


@query("ext_10_detail_ranks", f"WITH {b.SQL_FLOW}, g AS (SELECT entity, {DEC.format('amount')} AS amount FROM flow GROUP BY 1) SELECT n_nationkey AS entity, CAST(CASE WHEN amount IS NOT NULL THEN rank() OVER (ORDER BY amount DESC NULLS LAST, n_nationkey) END AS INT) AS position FROM nation LEFT JOIN g ON entity = n_nationkey")
def _(spark, d):
    ranks = agg.ranked(b.flow(spark, d).groupBy("entity").agg(total("amount").alias("amount")), "amount", "entity", "entity", top=1 << 30, collation=None)
    return b.entities(spark, d).join(ranks, "entity", "left").select("entity", F.col("rank").alias("position"))


@query("ext_13_unreadable_amounts", "SELECT o_orderkey, 'n/a' AS raw FROM orders WHERE o_orderkey % 11 = 0")
def _(spark, d):
    raw = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return b.read(spark, d, "orders").select("o_orderkey", raw.alias("raw")).filter(F.col("raw").isNotNull() & numbers.number_value(F.col("raw")).isNull())
