"""Fact, control, event and file views over the star-schema tables, as DataFrames and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow(spark: SparkSession, d: str) -> DataFrame:
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    supplier, nation = read(spark, d, "supplier"), read(spark, d, "nation")
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).join(part, line.l_partkey == part.p_partkey)  # nations are a fixed catalog
        .select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("entity_name"), F.col("p_type").alias("parent"), F.col("p_brand").alias("category"), F.col("l_returnflag").alias("currency"),
                F.col("l_extendedprice").alias("amount"), F.date_format("l_shipdate", "yyyy-MM").alias("period"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )


def balance(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    national = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0)
    foreign = F.when(F.col("o_orderstatus") == "O", 0.0).otherwise(F.col("o_totalprice"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
        .select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("entity_name"), F.col("o_orderpriority").alias("account"), national.alias("national"), foreign.alias("foreign"),
                (national + foreign).alias("combined"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderkey").alias("source_row"))
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("entity_name"))


def issues(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return read(spark, d, "events").select(e.alias("code"), F.when(e == "error", "critical").when(e == "purchase", "high").when(e == "signup", "medium").otherwise("low").alias("severity"), F.col("user_id").alias("scope"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_type").alias("route"), F.col("value").alias("duration"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.get_json_object("props", "$.k").cast("long").alias("bytes"), "ts")


def versions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("published"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("uploaded_by"))


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 17 == 0, "blob").when(i % 23 == 0, " ").otherwise(F.concat("source", F.lit("/"), "lang", F.lit(" "), i.cast("string"), F.when(i % 5 == 0, ".txt").otherwise(".xlsx")))
    return read(spark, d, "documents").select(i.alias("file_id"), name.alias("name"), F.col("n_chars").alias("size"), F.col("text").alias("content"), F.col("lang").alias("kind"), (i % 50).alias("run"))


def archives(spark: SparkSession, d: str) -> DataFrame:
    """Orders as archives: their lines are entries, prices and quantities sizes, part names entry names."""
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    price, quantity = (F.floor(F.sum(F.col(c).cast("decimal(18,2)"))).cast("long") for c in ("l_extendedprice", "l_quantity"))
    i = F.col("file")
    stats = line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("file")).agg(
        (price * 100).alias("size"), (F.count("*") * 500).alias("entries"), quantity.alias("compressed"), F.floor(price / 12).cast("long").alias("inflated"),
        F.bool_or(F.col("p_name").contains("ring")).alias("macro"), F.bool_or(F.col("p_name").contains("bolt")).alias("encrypted"), F.bool_or(F.col("l_returnflag") == "R").alias("protected"))
    name = F.concat(i.cast("string"), F.when(i % 13 == 0, ".xls").otherwise(".XLSX"))
    return stats.withColumns({"is_archive": i % 10 != 0, "name": name, "mime": F.when(i % 6 == 0, "text/plain").otherwise("application/octet-stream")})


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Entity names as reported: case, blanks, separators and suffixes vary with the supplier."""
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    k, name = F.col("s_suppkey") % 6, F.col("n_name")
    raw = F.when(k == 0, name).when(k == 1, F.lower(name)).when(k == 2, F.concat(F.lit("  "), F.replace(name, F.lit("_"), F.lit("_")), F.lit("  "))).when(k == 3, F.concat(name, F.lit(", S.A."))).when(k == 4, F.concat(F.lit("alias "), name)).otherwise(F.concat(name, F.lit("?")))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", raw.alias("raw"), (F.col("s_suppkey") % 40).cast("int").alias("line"))


def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    one = n.select(F.concat(F.lit("alias "), "n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("target"))
    again = n.filter("n_nationkey % 5 = 0").select(F.concat(F.lit("alias "), "n_name").alias("alias"), (F.col("n_nationkey") + 1).cast("string").alias("target"))
    return one.unionByName(again)


def entity_catalog(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_name").alias("canonical"), F.col("n_nationkey").cast("string").alias("target"), F.col("n_nationkey").alias("line"), F.col("n_nationkey").alias("sort_order"))


SQL_FLOW = """flow AS (SELECT n_nationkey AS entity, n_name AS entity_name, p_type AS parent, p_brand AS category, l_returnflag AS currency, l_extendedprice AS amount, strftime(l_shipdate, '%Y-%m') AS period,
 l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
SQL_BALANCE = """balance AS (SELECT n_nationkey AS entity, n_name AS entity_name, o_orderpriority AS account, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS "national",
 CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END AS "foreign", o_totalprice AS combined, strftime(o_orderdate, '%Y-%m') AS period, o_orderkey AS source_row
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SQL_ISSUES = """issues AS (SELECT event_type AS code, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity, user_id AS scope FROM events)"""
SQL_REQUESTS = """requests AS (SELECT event_type AS route, value AS duration, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CAST(props->>'$.k' AS BIGINT) AS bytes, ts FROM events)"""
SQL_VERSIONS = """versions AS (SELECT o_orderkey AS id, o_orderdate AS created, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS published, o_orderstatus AS status, o_custkey AS uploaded_by FROM orders)"""
SQL_FILES = """files AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 17 = 0 THEN 'blob' WHEN doc_id % 23 = 0 THEN ' ' ELSE source || '/' || lang || ' ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.xlsx' END END AS name,
 n_chars AS size, text AS content, lang AS kind, doc_id % 50 AS run FROM documents)"""
SQL_ARCHIVES = """archives AS (SELECT l_orderkey AS file, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2)))) AS BIGINT) AS price, CAST(floor(sum(CAST(l_quantity AS DECIMAL(18,2)))) AS BIGINT) AS compressed, count(*) * 500 AS entries,
 bool_or(contains(p_name, 'ring')) AS macro, bool_or(contains(p_name, 'bolt')) AS encrypted, bool_or(l_returnflag = 'R') AS protected, l_orderkey % 10 <> 0 AS is_archive FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""
SQL_DIRTY = """dirty AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN '  ' || n_name || '  ' WHEN 3 THEN n_name || ', S.A.' WHEN 4 THEN 'alias ' || n_name ELSE n_name || '?' END AS raw,
 CAST(s_suppkey % 40 AS INT) AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 aliases AS (SELECT 'alias ' || n_name AS alias, CAST(n_nationkey AS VARCHAR) AS target FROM nation UNION ALL SELECT 'alias ' || n_name, CAST(n_nationkey + 1 AS VARCHAR) FROM nation WHERE n_nationkey % 5 = 0)"""
#: Staged resolution of dirty.raw in SQL; resolved(raw, strategy, target, n).
_KEY = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '[/\\\\|]+', ' ', 'g'), '[().,]+', ' ', 'g'), '\\s+', ' ', 'g')), '\\b(SOCIEDAD ANONIMA|S A|SA)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL_RESOLVED = SQL_DIRTY + f""", d AS (SELECT DISTINCT raw, {_KEY.format('raw')} AS key FROM dirty),
 hits AS (SELECT raw, 0 AS stage, target FROM d JOIN aliases ON raw = alias UNION ALL SELECT raw, 1, CAST(n_nationkey AS VARCHAR) FROM d JOIN nation ON raw = n_name
 UNION ALL SELECT raw, 2, target FROM d JOIN aliases ON key = {_KEY.format('alias')} UNION ALL SELECT raw, 3, CAST(n_nationkey AS VARCHAR) FROM d JOIN nation ON key = {_KEY.format('n_name')}),
 firsts AS (SELECT raw, stage, count(DISTINCT target) AS n, min(target) AS target FROM hits WHERE (raw, stage) IN (SELECT raw, min(stage) FROM hits GROUP BY raw) GROUP BY raw, stage),
 resolved AS (SELECT d.raw, CASE WHEN stage IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE ['direct-alias', 'direct-canonical', 'normalized-alias', 'normalized-canonical'][stage + 1] END AS strategy,
 CASE WHEN n = 1 THEN target END AS target, coalesce(n, 0) AS n FROM d LEFT JOIN firsts ON d.raw = firsts.raw)"""
