"""Registered queries on reports by role and on the catalogs, each with its SQL: orders stand in for report rows, customers for files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regmart.plans import bridge as b
from regmart.sources import catalogs, roles, workbooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


# Files: a customer's orders are the rows of a balance, a result or a sheet of neither kind; headers stand under their first or last alias

SHEETS = ("Balance", "ER", "Datos")
TEXTS = (("Total  Activos", "pasivos", "Patrimonio neto", "OTRAS"), ("Utilidad", "resultado neto", "roe", "OTRAS"), ("a", "b", "c", "OTRAS"))


def _lits(values) -> Column:
    return F.array(*map(F.lit, values))


def _at(values, place: Column) -> Column:
    return F.element_at(_lits(values), place.cast("int") + 1)


def _lines(spark, d):
    """Rows of the files under the columns of a statement."""
    o, i, kind = b.read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 3
    account = F.element_at(F.array(*[_lits(t) for t in TEXTS]), kind.cast("int") + 1)
    return o.select(
        F.col("o_custkey").cast("string").alias("file"), _at(SHEETS, kind).alias("sheet"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1).alias("row"), F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("type"), F.col("o_custkey").cast("string").alias("entity_code"), F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("entity_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), (i % 50).cast("string").alias("line"), F.element_at(account, (i % 4).cast("int") + 1).alias("account"), i.cast("string").alias("national"), F.lit("0").alias("foreign"))


def _table(spark, d):
    lines = _lines(spark, d)
    where = ("file", F.lit(0).alias("sheet_index"), "sheet")
    first, last = _lits(n for n in roles.STATEMENT_HEADERS), _lits(a[-1].lower() for a in roles.STATEMENT_HEADERS.values())
    head = lines.filter("row = 2").select(*where, F.lit(1).alias("row"), F.posexplode(F.when(F.col("customer") % 2 == 0, first).otherwise(last)).alias("col", "value"))
    body = lines.select(*where, "row", F.posexplode(F.array(*roles.STATEMENT_COLUMNS)).alias("col", "value"))
    return head.unionByName(body).withColumn("col", F.col("col") + 1)


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SQL_LINES = f"""lines AS (SELECT CAST(o_custkey AS VARCHAR) AS file, o_custkey % 3 AS k, o_custkey AS customer, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INT) AS source_row, o_orderstatus AS type, CAST(o_custkey AS VARCHAR) AS entity_code,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Customer ' || o_custkey END AS entity_name, strftime(o_orderdate, '%Y-%m-%d') AS report_date, CAST(o_orderkey % 50 AS VARCHAR) AS line,
 [{', '.join(_list(t) for t in TEXTS)}][o_custkey % 3 + 1][o_orderkey % 4 + 1] AS account, CAST(o_orderkey AS VARCHAR) AS "national", '0' AS "foreign" FROM orders)"""
# Points of the texts of a file: the first text of a balance holds two signals.
_SQL_KINDS = _SQL_LINES + """, hits AS (SELECT file, k, count(DISTINCT account) + count(DISTINCT CASE WHEN account = 'Total  Activos' THEN 1 END) AS n FROM lines WHERE source_row <= 60 AND account <> 'OTRAS' GROUP BY 1, 2),
 files AS (SELECT DISTINCT lines.file, lines.k, customer, coalesce(n, 0) AS n FROM lines LEFT JOIN hits ON hits.file = lines.file),
 s AS (SELECT file, k, customer, CAST(64 + CASE WHEN k = 0 THEN 6 + 15 * n ELSE 0 END AS DOUBLE) AS balance, CAST(64 + CASE WHEN k = 1 THEN 6 + 15 * n ELSE 0 END AS DOUBLE) AS result FROM files),
 found AS (SELECT file, customer, balance, result, greatest(balance, result) AS best, least(balance, result) AS second, best - second >= 8 AS sure, k FROM s)"""
_COLUMNS = ", ".join(f'"{c}"' for c in roles.STATEMENT_COLUMNS)


@query("src_09_balance_scan", f"WITH {_SQL_LINES} SELECT file, source_row, {_COLUMNS} FROM lines WHERE entity_name <> ''")
def _(spark, d):
    return roles.scan(_table(spark, d), roles.BALANCE)[0]


@query("src_09_balance_issues", f"""WITH {_SQL_LINES} SELECT file, source_row, 'entity_name' AS "column" FROM lines WHERE entity_name = ''""")
def _(spark, d):
    return roles.scan(_table(spark, d), roles.BALANCE)[1].select("file", "source_row", "column")


@query("src_10_result_scan", f"WITH {_SQL_KINDS} SELECT file, source_row, {_COLUMNS} FROM lines JOIN found USING (file) WHERE sure AND found.k = 1 AND entity_name <> ''")
def _(spark, d):
    table = _table(spark, d)
    results = roles.classify(table).filter(F.col("kind") == roles.RESULT.kind).select("file")
    return roles.scan(table, roles.RESULT)[0].join(results, "file", "left_semi")


@query("src_13_signatures", f"""WITH {_SQL_KINDS} SELECT file, CASE WHEN sure THEN ['financialPosition', 'incomeStatement'][k + 1] END AS kind, CASE WHEN sure THEN ['tabular-financial-position-v2', 'tabular-income-statement-v1'][k + 1] END AS signature,
 best, second, least(1.0, best / (best + second)) AS confidence FROM found""")
def _(spark, d):
    return roles.classify(_table(spark, d)).select("file", "kind", "signature", "best", "second", "confidence")


_FIRST, _LAST = ", ".join(roles.STATEMENT_HEADERS), ", ".join(a[-1].lower() for a in roles.STATEMENT_HEADERS.values())


@query("src_13_diagnostics", f"""WITH {_SQL_KINDS} SELECT file, concat_ws(', ', CASE WHEN balance >= result THEN 'financialPosition:' || CAST(balance AS BIGINT) ELSE 'incomeStatement:' || CAST(result AS BIGINT) END,
 CASE WHEN balance >= result THEN 'incomeStatement:' || CAST(result AS BIGINT) ELSE 'financialPosition:' || CAST(balance AS BIGINT) END) AS candidates, {_list(SHEETS)}[k + 1] || ': ' || CASE WHEN customer % 2 = 0 THEN '{_FIRST}' ELSE '{_LAST}' END AS headers FROM found""")
def _(spark, d):
    table = _table(spark, d)
    return workbooks.diagnostics(table, roles.scores(table))


@query("src_11_period_label", "WITH x AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'n/a' ELSE strftime(max(o_orderdate), '%Y-%m') END AS period FROM orders WHERE o_custkey % 9 > 0 GROUP BY 1) SELECT CAST(o_custkey AS VARCHAR) AS file, period, TRY_CAST(period || '-01' AS DATE) AS period_start FROM x")
def _(spark, d):
    i = F.col("o_custkey")
    sheet, row, col = roles.PERIOD_CELL
    stated = b.read(spark, d, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("month"))
    value = F.when(i % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), "month", F.lit(" ")))
    table = stated.select(i.cast("string").alias("file"), F.lit(3).alias("sheet_index"), F.lit(sheet).alias("sheet"), F.when(i % 9 == 0, row + 1).otherwise(row).alias("row"), F.lit(col).alias("col"), value.alias("value"))
    return roles.period_label(table)


# Catalogs: names and aliases as reported, in five spellings


def _canonical(name: str) -> list[tuple[str, str]]:
    if name == "entity":
        return [(i, catalogs.CANONICAL.get(i, n.upper())) for i, _, n, _ in catalogs._rows(catalogs.ENTITIES, ",")]
    return [(i, n) for _, i, n in catalogs._rows(catalogs.ACCOUNTS, ";")]


def _slug(x: str) -> str:
    return f"replace(lower(strip_accents({x})), ' ', '-')"


def _values(pairs) -> str:
    return ", ".join("('" + a.replace("'", "''") + "', '" + t + "')" for t, a in pairs)


def _pairs(known: dict[str, list[str]]):
    return [(t, a) for t, names in known.items() for a in names]


_CATEGORIES = [n for (parent, _), children in catalogs.CATEGORIES.items() for n in (parent, *children)]
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(upper({0})), '[/\\\\|]+', ' ', 'g'), '[().,]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_ENTITY_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(" + _KEY + ", '\\b(SOCIEDAD ANONIMA|S A|SA)\\b', ' ', 'g'), '\\bCIA\\b', 'COMPANIA', 'g'), '\\s+', ' ', 'g'))"
POOLS = {
    "entity": [a for _, a in _canonical("entity")] + [a for _, a in _pairs(catalogs.ENTITY_ALIASES)],
    "category": [n.upper() for n in _CATEGORIES] + [a for _, a in _pairs(catalogs.CATEGORY_ALIASES)],
    "account": [a for _, a in _canonical("account")] + [a for _, a in _pairs(catalogs.ACCOUNT_ALIASES) if "Ã" not in a] + ["TOTAL", "xx"],
}
_SQL_NAMES = {
    "entity": f"SELECT * FROM (VALUES {_values(_canonical('entity'))}) AS v(alias, target)", "account": f"SELECT * FROM (VALUES {_values(_canonical('account'))}) AS v(alias, target)",
    "category": f"SELECT upper(n) AS alias, {_slug('n')} AS target FROM (SELECT unnest({_list(_CATEGORIES)}) AS n)",
}
_SQL_KNOWN = {"entity": _values(_pairs(catalogs.ENTITY_ALIASES)), "category": _values(_pairs(catalogs.CATEGORY_ALIASES)), "account": _values(_pairs(catalogs.ACCOUNT_ALIASES))}


def _reported(pool: str, i: Column) -> Column:
    """A spelling of the pool's name number ``i``: as it is, in small letters, with blanks around, with a sign behind, or with wide separators."""
    names = POOLS[pool]
    name, spelling = _at(names, i % len(names)), (F.floor(i / len(names)) % 5).cast("int")
    return F.when(spelling == 0, name).when(spelling == 1, F.lower(name)).when(spelling == 2, F.concat(F.lit("  "), name, F.lit(" "))).when(spelling == 3, F.concat(name, F.lit("?"))).otherwise(F.replace(name, F.lit(" "), F.lit("  /  ")))


def _sql_resolved(pool: str, table: str, i: str, key: str = _KEY) -> str:
    n = len(POOLS[pool])
    name = f"{_list(POOLS[pool])}[{i} % {n} + 1]"
    return f"""r AS (SELECT {i} AS id, [{name}, lower({name}), '  ' || {name} || ' ', {name} || '?', replace({name}, ' ', '  /  ')][{i} // {n} % 5 + 1] AS raw FROM {table}), known(alias, target) AS (VALUES {_SQL_KNOWN[pool]}), names AS ({_SQL_NAMES[pool]}),
 d AS (SELECT DISTINCT raw, {key.format('raw')} AS key FROM r), hits AS (SELECT raw, 0 AS stage, target FROM d JOIN known ON raw = alias UNION ALL SELECT raw, 1, target FROM d JOIN names ON raw = alias
 UNION ALL SELECT raw, 2, target FROM d JOIN known ON key = {key.format('alias')} UNION ALL SELECT raw, 3, target FROM d JOIN names ON key = {key.format('alias')}),
 firsts AS (SELECT raw, stage, count(DISTINCT target) AS n, min(target) AS target FROM hits WHERE (raw, stage) IN (SELECT raw, min(stage) FROM hits GROUP BY raw) GROUP BY raw, stage),
 resolved AS (SELECT d.raw, d.key, CASE WHEN stage IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE ['direct-alias', 'direct-canonical', 'normalized-alias', 'normalized-canonical'][stage + 1] END AS strategy, CASE WHEN n = 1 THEN target END AS target FROM d LEFT JOIN firsts ON d.raw = firsts.raw)"""


def _by_row(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    return rows.join(resolved, "raw").select("id", "raw", "strategy", "target")


@query("jn_02_catalog_entities", f"WITH {_sql_resolved('entity', 'customer', 'c_custkey', _ENTITY_KEY)} SELECT id, r.raw, strategy, target FROM r JOIN resolved ON r.raw = resolved.raw")
def _(spark, d):
    rows = b.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), _reported("entity", F.col("c_custkey")).alias("raw"))
    return _by_row(rows, catalogs.resolve_entities(rows))


@query("jn_03_catalog_categories", f"WITH {_sql_resolved('category', 'part', 'p_partkey')} SELECT id, r.raw, strategy, target FROM r JOIN resolved ON r.raw = resolved.raw")
def _(spark, d):
    rows = b.read(spark, d, "part").select(F.col("p_partkey").alias("id"), _reported("category", F.col("p_partkey")).alias("raw"))
    return _by_row(rows, catalogs.resolve_categories(rows))


@query("jn_04_catalog_accounts", f"WITH {_sql_resolved('account', 'orders', 'o_orderkey')} SELECT id, r.raw, strategy, target FROM r JOIN resolved ON r.raw = resolved.raw")
def _(spark, d):
    rows = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _reported("account", F.col("o_orderkey")).alias("raw"))
    return _by_row(rows, catalogs.resolve_accounts(rows))


_SQL_ACCOUNT_LINES = ", ".join(f"({line}, '{i}')" for line, i, _ in catalogs._rows(catalogs.ACCOUNTS, ";"))


@query("jn_06_account_verdicts", f"""WITH {_sql_resolved('account', 'orders', 'o_orderkey')}, lines(line, line_target) AS (VALUES {_SQL_ACCOUNT_LINES}), x AS (SELECT id, r.raw, strategy, target, line_target, key FROM r JOIN resolved ON r.raw = resolved.raw LEFT JOIN lines ON lines.line = id % 61),
 near AS (SELECT d.raw, count(DISTINCT names.target) AS n FROM d JOIN names ON contains(d.key, {_KEY.format('alias')}) OR contains({_KEY.format('alias')}, d.key) WHERE length(d.key) >= 4 GROUP BY 1)
 SELECT id, CASE WHEN strategy <> 'unresolved' THEN strategy WHEN line_target IS NOT NULL THEN 'line-number-fallback' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS strategy, CASE WHEN strategy = 'unresolved' THEN line_target ELSE target END AS target FROM x LEFT JOIN near ON near.raw = x.raw""")
def _(spark, d):
    i = F.col("o_orderkey")
    rows = b.read(spark, d, "orders").select(i.alias("id"), _reported("account", i).alias("raw"), (i % 61).cast("int").alias("line"))
    return catalogs.resolve_account_rows(rows).select("id", "strategy", "target")


@query("src_14_catalog_use", f"""WITH names AS ({_SQL_NAMES['category']}), parents AS (SELECT c, p FROM (VALUES {", ".join(f"('{c.upper()}', '{p.upper()}')" for (p, _), cs in catalogs.CATEGORIES.items() for c in (p, *cs))}) AS v(c, p)),
 r AS (SELECT {_list(n.upper() for n in _CATEGORIES)}[p_partkey % {len(_CATEGORIES)} + 1] AS c, p_retailprice FROM part) SELECT {_slug('p')} AS parent, count(*) AS parts FROM r JOIN parents USING (c) GROUP BY 1""")
def _(spark, d):
    dimension = catalogs.categories(spark)
    rows = b.read(spark, d, "part").select(_at([n.upper() for n in _CATEGORIES], F.col("p_partkey") % len(_CATEGORIES)).alias("canonical"))
    return rows.join(F.broadcast(dimension), "canonical").groupBy(F.coalesce("parent", "target").alias("parent")).agg(F.count("*").alias("parts"))  # a fixed catalog
