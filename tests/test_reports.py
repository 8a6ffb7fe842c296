"""Reports by role from real files, catalogs with the literal cases of the rules, and the records of the store."""

import pytest
from pyspark.sql import functions as F

from regmart.sources import catalogs, roles, store, workbooks
from test_sources import book

BALANCE = [
    ("1", "ACTIVOS", 0, 0), ("14", "TOTAL ACTIVOS", 100, 0), ("15", "PASIVOS", 80, 0), ("xx", "TOTAL", 20, 0), ("27", "PATRIMONIO", 20, 0), ("34", "CUENTAS DE ORDEN Y REGISTRO", 0, 0),
]
RESULT = [("1", "Primas Retenidas", 100, 0), ("2", "Ingresos Financieros", 25, 0), ("3", "Resultado Neto del Ejercicio", 10, 0)]


def statement(lines, **sheets):
    rows = [["Clase", "Codigo", "Aseguradora", "Fecha Corte", "Item", "Concepto", "MN", "ME"]] + [["1", "601", "SEGUROS DAVIVIENDA", "2026-01-31", line, account, a, z] for line, account, a, z in lines]
    return book({**sheets, "Datos 2026": rows})


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("reports")
    flow = [list(roles.FLOW_HEADERS), ["46053", "601", "SEGUROS DAVIVIENDA", "Seguro de Vida", "Vida Individual", "1", "Nacional", 100], ["46053", "601", "", "Seguro de Vida", "Vida Individual", "1", "Nacional", 5]]
    control = {n: [["x"]] for n in roles.CONTROL_SHEETS} | {"1. Ramos totales": [["x"]], "descarga app P&amp;S": [["a", " 2025-12 "]], "Balance Diciembre 2025": [[None]] * 8 + [[None] * 4 + ["Equidad"], [None] * 4 + [7.5]]}
    control = {k.replace("P&S", "P&amp;S"): v for k, v in control.items() if k not in ("1. RAMOS TOTALES", "DESCARGA APP P&S")}
    files = {"flow": book({"Primas": flow}), "balance": statement(BALANCE), "result": statement(RESULT, Notas=[["x"]]), "control": book(control), "unknown": book({"Hoja": [["Columna A", "Columna B", "Columna C"], ["1", "2", "3"]]})}
    files["no currency"] = book({"Primas": [[h for h in flow[0] if "Moneda" not in h], ["46053", "601", "X", "Y", "Z", 1]]})
    for name, content in files.items():
        (at / f"{name}.xlsx").write_bytes(content)
    name = F.regexp_extract("file", r"([^/]*)\.xlsx$", 1)
    return workbooks.cells(workbooks.scan(spark, str(at))).withColumn("file", F.replace(name, F.lit("%20"), F.lit(" "))).cache()


def test_roles_of_files(spark, table):
    got = {r.file: (r.kind, r.signature) for r in roles.classify(table).collect()}
    assert got == {"flow": ("premiums", "tabular-premiums-v2"), "balance": ("financialPosition", "tabular-financial-position-v2"), "result": ("incomeStatement", "tabular-income-statement-v1"), "control": ("reference", "reference-workbook-v2"), "unknown": (None, None), "no currency": (None, None)}
    told = {r.file: (r.candidates, r.headers) for r in workbooks.diagnostics(table, roles.scores(table)).collect()}
    assert told["unknown"] == ("none", "Hoja: Columna A, Columna B, Columna C") and told["flow"][0] == "premiums:102"


def test_typed_scans(spark, table):
    good, bad = roles.scan(table, roles.FLOW)
    assert [(r.source_row, r.entity_name, r.category, r.amount) for r in good.collect()] == [(2, "SEGUROS DAVIVIENDA", "Vida Individual", "100")]
    assert [(r.file, r.source_row, r.column) for r in bad.collect()] == [("flow", 3, "entity_name")]
    rows = {(r.file, r.source_row, r.line, r.account, r.national) for r in roles.scan(table, roles.BALANCE)[0].collect()}
    assert rows == {("balance", i, line, a, str(n)) for i, (line, a, n, _) in enumerate(BALANCE, 2)} | {("result", i, line, a, str(n)) for i, (line, a, n, _) in enumerate(RESULT, 2)}
    assert [(r.measure, r.key, r.expected) for r in roles.control(table, spark).collect()] == [("balance", "EQUIDAD", 7500.0)]
    assert [(r.file, r.period, str(r.period_start)) for r in roles.period_label(table).collect()] == [("control", "2025-12", "2025-12-01")]


def test_literal_cases_of_the_catalogs(spark):
    def all_of(resolved):
        return {r.raw: (r.strategy, r.target) for r in resolved.collect()}

    texts = lambda *x: spark.createDataFrame([(t,) for t in x], "raw string")
    got = all_of(catalogs.resolve_entities(texts("SEGUROS EQUIDAD, S.A.", "Seguros Equidad", "SEGUROS EQUIDAD SA", "  seguros del pais  ", "SEGUROS DEL PAÃ\u008dS", "nobody", "Assa Compania de Seguros")))
    assert {got[t][1] for t in ("SEGUROS EQUIDAD, S.A.", "Seguros Equidad", "SEGUROS EQUIDAD SA")} == {"equidad"}
    assert got["  seguros del pais  "] == ("normalized-alias", "del-pais") and got["SEGUROS DEL PAÃ\u008dS"][1] == "del-pais" and got["nobody"] == ("unresolved", None) and got["Assa Compania de Seguros"][1] == "assa"
    got = all_of(catalogs.resolve_categories(texts("otros seguros generales  /  ganadero", "casco maritimo", "Equipo Electrónico")))
    assert got == {"otros seguros generales  /  ganadero": ("normalized-alias", "ganadero"), "casco maritimo": ("normalized-alias", "casco-maritimo"), "Equipo Electrónico": ("normalized-canonical", "equipo-electronico")}
    rows = spark.createDataFrame([("Cr?ditos raros", 24), ("  pRoPiedades   de   inversiOn  ", 9), ("TOTAL", None), ("xx", None), (None, 14), (None, None)], "raw string, line int")
    got = {(r.raw, r.line): (r.strategy, r.target, len(r.candidates)) for r in catalogs.resolve_account_rows(rows).collect()}
    assert got[("Cr?ditos raros", 24)][:2] == ("line-number-fallback", "creditos-diferidos") and got[("  pRoPiedades   de   inversiOn  ", 9)][:2] == ("normalized-alias", "propiedades-inversion")
    assert got[("TOTAL", None)][0] == "ambiguous" and got[("TOTAL", None)][2] >= 2 and got[("xx", None)][0] == "unresolved" and got[(None, 14)][:2] == ("line-number-fallback", "total-activos") and got[(None, None)][0] == "unresolved"


def test_catalogs(spark):
    assert [f(spark).count() for f in (catalogs.entities, catalogs.categories, catalogs.accounts, catalogs.currencies, catalogs.metrics)] == [12, 35, 32, 3, 3]
    rows = {r.target: (r.parent, r.sort_order) for r in catalogs.categories(spark).collect()}
    assert rows["seguro-de-vida"] == (None, 50) and rows["ganadero"] == ("otros-seguros-generales", 49) and rows["vehiculos-automotores"] == ("seguros-generales", 62)


def test_failed_runs_and_version_records(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.manifest("x").count() == 0 and s.issues("r").count() == 0
    s.publish("r1", "ann", {"facts": spark.range(2), "aggregates": spark.range(1)}, "publishable", "v1")
    assert [r.artifact for r in s.manifest("v1").collect()] == ["aggregates", "facts"]
    issues = spark.createDataFrame([("SECURITY_MAGIC_BYTES", "critical", None)], "code string, severity string, detail string")
    failed = s.fail_run("r2", "ann", issues, "screening")
    assert s.active() == "v1" and s.read_version(failed)["status"] == "failed" and s.manifest(failed).count() == 0 and [r.code for r in s.issues("r2").collect()] == ["SECURITY_MAGIC_BYTES"]
    assert {r.run_id: r.status for r in s.runs().collect()} == {"r1": "published", "r2": "failed"}
    spark.createDataFrame([("v3", "r", None, None, None, None), ("v4", "r", "odd", None, None, None)], store.VERSIONS).write.mode("append").parquet(f"{s.root}/versions")
    assert {(r.version_id, r.rule) for r in s.invalid_versions().collect()} == {("v3", "CREATED_AT_MISSING"), ("v4", "STATUS_UNKNOWN")}
    assert s.read_version("v1")["publishability"] == "publishable"
    with pytest.raises(store.BadVersion):
        s.read_version("v4")
    with pytest.raises(KeyError):
        s.read_version("v9")


def test_a_layout_brings_no_sheet_into_one_task(spark):
    table = spark.createDataFrame([("f", "Totals", r, c, v) for r, c, v in [(5, 1, "a"), (5, 2, "b"), (9, 1, "1"), (9, 2, "2.5")]], "file string, sheet string, row int, col int, value string")
    layout = spark.createDataFrame([("Totals", 5, 9, 1, 9, "flow")], "sheet string, header_row int, value_row int, col_from int, col_to int, measure string")
    found = workbooks.control_totals(table, layout)
    assert "hashpartitioning(sheet" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.expected) for r in found.collect()} == {("A", 1000.0), ("B", 2500.0)}


def test_cells_of_a_row_come_together_before_they_meet_headers(spark, table):
    sheets = roles.read_sheets(table)
    plan = roles.rows(table, sheets)._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan
