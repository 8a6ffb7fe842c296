"""Ingest runs from spreadsheet files: one run for each gate, one that is blocked by its rows, and one that can be published."""

import json

import pytest
from pyspark.sql import functions as F

from regmart.operators import ingest
from regmart.sources import roles, store
from test_sources import book

FLOW_HEAD, STATEMENT_HEAD = list(roles.FLOW_HEADERS), list(roles.STATEMENT_HEADERS)
FLOW = [["2025-12-31", "601", "Seguros Davivienda", "Seguro de Vida", "Vida Individual", "1", "Nacional", 100.5], ["2025-12-31", "603", "MAPFRE SEGUROS", "Seguro de Vida", "Vida Individual", "1", "Nacional", 50]]
BALANCE = [["A", "601", "Seguros Davivienda", "2025-12-31", 1, "TOTAL ACTIVOS", 900, 100], ["A", "601", "Seguros Davivienda", "2025-12-31", 2, "PASIVOS", 10, 0], ["A", "601", "Seguros Davivienda", "2025-12-31", 3, "PATRIMONIO", 10, 0]]
RESULT = [["R", "601", "Seguros Davivienda", "2025-12-31", 1, "UTILIDAD NETA", 5, 0], ["R", "601", "Seguros Davivienda", "2025-12-31", 2, "INGRESOS FINANCIEROS", 6, 0], ["R", "601", "Seguros Davivienda", "2025-12-31", 3, "ROE", 7, 0]]


def flow(rows=FLOW):
    return book({"Primas": [FLOW_HEAD, *rows]})


def balance(rows=BALANCE):
    return book({"Balance": [STATEMENT_HEAD, *rows]})


def result(rows=RESULT):
    return book({"ER": [STATEMENT_HEAD, *rows]})


def control(month="2025-12", premiums=(0.1005, 0.06), assets=(1.0,), ranking=True):
    def at(cells):
        width, height = max(c for _, c, _ in cells), max(r for r, _, _ in cells)
        grid = [[None] * width for _ in range(height)]
        for r, c, v in cells:
            grid[r - 1][c - 1] = v
        return grid

    names = ("Seguros Davivienda", "Mapfre Seguros")
    sheets = {"1. Ramos Totales": [["x"]], "8. Primas y Siniestros Totales": [["x"]], "descarga app P&S".replace("&", "&amp;"): at([(1, 2, month)]), "Descarga BG": [["x"]]}
    sheets["Primas Diciembre 2025"] = at([(11, 3 + i, n) for i, n in enumerate(names)] + [(61, 3 + i, v) for i, v in enumerate(premiums)])
    sheets["Balance Diciembre 2025"] = at([(9, 5 + i, n) for i, n in enumerate(names)] + [(10, 5 + i, v) for i, v in enumerate(assets)])
    if ranking:
        sheets["Ranking del Sistema"] = [["x"]]
    return book(sheets)


RUNS = {
    "good": {"f.xlsx": flow(), "b.xlsx": balance(), "r.xlsx": result(), "c.xlsx": control()},
    "alone": {"f.xlsx": flow()},
    "secure": {"f.xlsx": flow(), "b.xlsx": b"plain text", "c.xls": control()},
    "unknown": {"f.xlsx": flow(), "x.xlsx": book({"Notes": [["a", "b"], ["c", "d"]]})},
    "twice": {"f.xlsx": flow(), "g.xlsx": flow(), "b.xlsx": balance()},
    "damaged": {"f.xlsx": flow([FLOW[0], ["2025-12-31", "602", None, "Vida", "Vida Individual", "1", "Nacional", 5]])},
    "blocked": {"f.xlsx": flow([*FLOW, ["2025-11-30", "999", "Nowhere", "Seguro de Vida", "nothing", "1", "Nacional", 5], FLOW[0]]), "b.xlsx": balance([BALANCE[1], BALANCE[2], ["A", "9", "Elsewhere", "2025-12-31", 77, "zzzz", 1, 1], ["A", "601", "Seguros Davivienda", "2025-12-31", 2, "qqqq", 1, 1]]), "r.xlsx": result([[*RESULT[0][:2], "Nobody", *RESULT[0][3:]], *RESULT[1:]]), "c.xlsx": control("2025-11", ranking=False)},
    "bare": {"r.xlsx": result(), "c.xlsx": control()},
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(run, f"{run}/{name}", name, "application/octet-stream", len(content), bytearray(content)) for run, own in RUNS.items() for name, content in own.items()]
    return spark.createDataFrame(rows, "run string, file string, name string, mime string, size long, content binary").repartition(4)


@pytest.fixture(scope="module")
def done(files):
    return ingest.ingest_files(files)


def codes(done, run):
    return sorted(r.code for r in done.issues.filter(F.col("run") == run).collect())


def test_gates_stop_runs(done):
    runs = {r.run: (r.status, r.gate, r.publishability) for r in done.runs.collect()}
    assert runs == {
        "good": ("staged", None, "warningOnly"), "alone": ("staged", None, "warningOnly"), "secure": ("failed", "security-gate", "blocked"), "unknown": ("failed", "classification-gate", "blocked"),
        "twice": ("failed", "duplicate-role-gate", "blocked"), "damaged": ("failed", "row-gate", "blocked"), "blocked": ("staged", None, "blocked"), "bare": ("staged", None, "blocked"),
    }
    assert codes(done, "secure") == ["SECURITY_EXTENSION_REJECTED", "SECURITY_MAGIC_BYTES"]
    assert codes(done, "unknown") == ["WORKBOOK_SCHEMA_UNRECOGNIZED"] and codes(done, "damaged") == ["WORKBOOK_ROW_INVALID"]
    twice = done.issues.filter("run = 'twice'").collect()
    assert [(r.code, r.scope, r.detail) for r in twice] == [("WORKBOOK_ROLE_DUPLICATED", "ingestion", "premiums")]
    gone = [r for df in (done.flow, done.balance, done.result, done.attempts, done.reconciled) for r in df.filter(F.col("run").isin("secure", "unknown", "twice", "damaged")).collect()]
    assert gone == []


def test_rules_and_contexts(done):
    assert codes(done, "good") == ["INCOME_STATEMENT_DETECTED_NON_OPERATIONAL"]
    assert codes(done, "alone") == ["FINANCIAL_SOURCE_NOT_PROVIDED", "INCOME_STATEMENT_SOURCE_NOT_PROVIDED", "REFERENCE_WORKBOOK_NOT_PROVIDED"]
    assert codes(done, "bare") == ["FINANCIAL_SOURCE_NOT_PROVIDED", "INCOME_STATEMENT_DETECTED_NON_OPERATIONAL", "NO_PRIMARY_SOURCE_PROVIDED", "PREMIUM_SOURCE_NOT_PROVIDED"]
    assert codes(done, "blocked") == sorted([
        "PREMIUM_MULTIPLE_PERIODS", "PREMIUM_DUPLICATE_NATURAL_KEY", "FINANCIAL_TOTAL_ASSETS_MISSING", "INCOME_STATEMENT_DETECTED_NON_OPERATIONAL", "REFERENCE_RANKING_MISSING",
        "INSTITUTION_ALIAS_UNRESOLVED", "INSURANCE_LINE_ALIAS_UNRESOLVED", "FINANCIAL_INSTITUTION_ALIAS_UNRESOLVED", "FINANCIAL_ACCOUNT_ALIAS_UNRESOLVED", "INCOME_STATEMENT_INSTITUTION_ALIAS_UNRESOLVED"])
    told = {r.code: (r.scope, json.loads(r.detail)) for r in done.issues.filter("run = 'blocked' AND stage = 'resolution'").collect()}
    scope, detail = told["FINANCIAL_ACCOUNT_ALIAS_UNRESOLVED"]
    assert scope == "financialPosition:row:4:account" and (detail["raw"], detail["line"], detail["reason"], detail["normalized"]) == ("zzzz", 77.0, "no-candidate", "ZZZZ")
    assert told["INSURANCE_LINE_ALIAS_UNRESOLVED"][0] == "premiums:row:4:ramo"


def test_facts_and_reconciliation(done):
    flow_rows = {(r.entity, r.category_id, r.amount, r.year_month) for r in done.flow.filter("run = 'good'").collect()}
    assert flow_rows == {("davivienda", "vida-individual", 100.5, "2025-12"), ("mapfre", "vida-individual", 50.0, "2025-12")}
    assert done.flow.filter("run = 'blocked'").count() == 3 and done.balance.filter("run = 'blocked'").count() == 3
    good = {(r.rule, r.scope): (r.severity, r.status, r.expected, r.actual) for r in done.reconciled.filter("run = 'good'").collect()}
    assert good == {
        ("PREMIUM_TOTAL_BY_INSTITUTION", "premiums:davivienda"): ("low", "passed", 100.5, 100.5), ("PREMIUM_TOTAL_BY_INSTITUTION", "premiums:mapfre"): ("high", "warning", 60.0, 50.0),
        ("ASSETS_TOTAL_BY_INSTITUTION", "financialPosition:davivienda"): ("low", "passed", 1000.0, 1000.0),
    }
    rules = lambda run: sorted(r.rule for r in done.reconciled.filter(F.col("run") == run).collect())
    assert rules("alone") == ["REFERENCE_NOT_PROVIDED"] and rules("bare") == []
    assert rules("blocked") == ["PERIOD_MISMATCH_PREMIUM_REFERENCE", "PREMIUM_TOTAL_BY_INSTITUTION", "PREMIUM_TOTAL_BY_INSTITUTION"]
    assert {r.severity for r in done.reconciled.filter("run = 'blocked'").collect()} == {"low", "medium"}


def test_store_of_runs(spark, done, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.record(done, "ann")
    assert {r.run_id: r.status for r in s.runs().collect()} == {run: "failed" if run in ("secure", "unknown", "twice", "damaged") else "staged" for run in RUNS}
    assert {r.action for r in s.audit_events().collect()} == {"INGESTION_STAGED", "VALIDATION_FAILED"} and s.audit_events().count() == len(RUNS)
    assert {r.status for r in s.versions().collect()} == {"failed", "staged"} and s.active() is None
    with pytest.raises(store.PublishBlocked):
        s.publish_run("blocked", "ann")
    with pytest.raises(store.PublishBlocked):
        s.publish_run("secure", "ann")
    with pytest.raises(KeyError):
        s.publish_run("nobody", "ann")
    version = s.publish_run("good", "ann")
    assert s.active() == version and s.artifact("flow").count() == 2 and s.artifact("balance").count() == 3
    assert [r.artifact for r in s.manifest(version).collect()] == ["balance", "flow", "reconciliation"]
    assert {r.run_id: r.status for r in s.runs().collect()}["good"] == "published" and s.audit_events().first().action == "PUBLISH"
    assert s.issues("twice").count() == 1 and {r.area: r.n for r in s.counts().collect()}["staging"] == len(RUNS)


def test_common_texts_are_not_dealt_by_shuffle(spark):
    every = spark.range(3000).selectExpr("id", "IF(id % 3 > 0, 'often', concat('x', id)) AS raw")
    found = every.select("raw").distinct().selectExpr("raw", "upper(raw) AS target")
    got = ingest.with_common(every, found, ["raw"])
    assert sorted((r.id, r.target) for r in got.collect()) == [(i, "OFTEN" if i % 3 else f"X{i}") for i in range(3000)]
