"""Rows of sheets: whole rows come under the columns of their role, and what files share is worked out once."""

from pyspark.sql import functions as F

from regmart.functions import text
from regmart.operators import ingest
from regmart.sources import roles, workbooks

CELLS = "file string, sheet_index int, sheet string, row int, col int, value string"


def cells(spark, file, lines, sheet="Balance"):
    return spark.createDataFrame([(file, 0, sheet, r, c, v) for r, line in lines.items() for c, v in line], CELLS)


def test_rows_come_under_their_headers(spark):
    heads = list(enumerate(roles.STATEMENT_HEADERS, 1))
    twice = [*heads, (9, "RUBRO")]  # a second column for the account: the last filled one counts
    table = cells(spark, "a", {1: heads, 2: [(1, "A"), (3, "x"), (4, "2025-12-31"), (6, "TOTAL ACTIVOS")], 4: [(20, "aside")]}).unionByName(cells(spark, "b", {1: twice, 3: [(6, "one"), (9, "two")], 5: [(4, "2025-11-30"), (6, "three"), (6, "four")]}))
    rows = workbooks.gathered(table)
    found = roles.first_rows(rows)
    assert {(r.layout, r.hits) for r in found.collect()} == {("statement", 8), ("statement", 9)}
    names = rows.select("sheet").distinct().withColumn("name", F.upper("sheet"))
    chosen = roles.sheet_of_role(rows, found, names)
    assert {(r.file, r.kind, r.sheet_index, r.hits, r.named) for r in chosen.collect()} == {("a", "financialPosition", 0, 8, True), ("a", "incomeStatement", 0, 8, False), ("b", "financialPosition", 0, 9, True), ("b", "incomeStatement", 0, 9, False)}
    placed = roles.placed(rows, chosen.filter("kind = 'financialPosition'").select("file", "kind", "sheet_index", "head"), found)
    assert {(r.file, r.source_row, r.type, r.entity_name, r.account, r.report_date, r.first_date) for r in placed.collect()} == {("a", 2, "A", "x", "TOTAL ACTIVOS", "2025-12-31", "2025-12-31"), ("b", 3, None, None, "two", None, None), ("b", 5, None, None, "three", "2025-11-30", None)}


def test_kinds_are_those_of_the_long_cells(spark):
    heads = list(enumerate(roles.STATEMENT_HEADERS, 1))
    parts = [cells(spark, f"{i}-{sheet}", {1: heads, 2: [(6, t)], 70: [(6, "UTILIDAD")]}, sheet) for sheet in ("Balance", "ER", "Other") for i, t in enumerate(("total  activos", "utilidad neta", "gastos de intermediación", "pasivos"))]
    parts += [cells(spark, "flow", {1: list(enumerate(roles.FLOW_HEADERS, 1)), 2: [(1, "x")]}, "Datos"), cells(spark, "none", {3: [(1, "x")]}, "Notes"), cells(spark, "rank", {1: [(1, "x")]}, "Ranking del Sistema")]
    table = ingest.union(parts).coalesce(4)
    rows = workbooks.gathered(table)
    sheets = rows.select("file", "sheet_index", "sheet").distinct()
    names = sheets.select("sheet").distinct().withColumn("name", text.normalize_text(F.col("sheet")))
    found = roles.first_rows(rows)
    got = {r.file: (r.kind, r.signature, r.candidates) for r in roles.file_kinds(rows, sheets, names, found, roles.sheet_of_role(rows, found, names)).collect()}
    want = {r.file: (r.kind, r.signature, None if r.kind else r.candidates) for r in roles.classify(table).collect()}
    assert got == want and len({kind for kind, _, _ in got.values()}) == 4


def test_plain_texts_are_only_put_into_capitals(spark):
    texts = ["", "a", " a", "a ", "a b", "a  b", "a\tb", "a\nb", "a\rb", "a\x0bb", "a\fb", "ﬁ", "Ã©", "á", "a\u00a0b", "a\x01b", "a \x01b", "a\x01 b", "x-1/2.", "a\x1fb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    joined = F.regexp_replace(text.normalize_text(F.col("t")), "\\s*\x01\\s*", "\x01")
    shown = df.select("t", text.is_plain(F.col("t"), "\x01").alias("plain"), joined.alias("whole"), F.upper("t").alias("capitals")).collect()
    assert all(r.whole == r.capitals for r in shown if r.plain) and {r.t for r in shown if r.plain} == {"", "a", "a b", "a\x01b", "x-1/2.", "a\x1fb"}


def test_natural_keys_repeat_whatever_their_spelling(spark):
    rows = [("r", 2, "Seguros  Á"), ("r", 3, "seguros á "), ("r", 4, "ABC"), ("r", 5, "abc"), ("r", 6, " abc"), ("s", 2, "abc")]
    flow = spark.createDataFrame(rows, "run string, source_row int, entity_name string").withColumns({c: F.lit("1") for c in ("report_date", "entity_code", "parent", "category", "currency_code", "currency")})
    assert sorted((r.run, r.source_row) for r in ingest.repeated(flow).collect()) == [("r", 3), ("r", 5), ("r", 6)]


def test_placing_rows_deals_them_once(spark):
    rows = workbooks.gathered(cells(spark, "a", {1: list(enumerate(roles.STATEMENT_HEADERS, 1)), 2: [(6, "x")]})).localCheckpoint()
    heads = roles.first_rows(rows)
    chosen = roles.sheet_of_role(rows, heads, rows.select("sheet").distinct().withColumn("name", F.upper("sheet"))).select("file", "kind", "sheet_index", "head")
    plan = roles.placed(rows, chosen.hint("merge"), heads)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan  # the rows and their sheets
