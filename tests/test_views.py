"""Small cases of figures, scores, counters and rebuilt details."""

from regmart.operators import aggregates as agg
from regmart.operators import reconcile, resolve
from regmart.sources import workbooks


def test_kpis_of_a_domain_without_rows(spark):
    flow = spark.createDataFrame([(1, 2.5), (2, 1.0)], "entity int, amount double")
    nothing = spark.createDataFrame([], "entity int, account string, combined double")
    got = {r["key"]: (r.value, r.unit) for r in agg.kpis(flow, nothing, {"assets": "a"}).collect()}
    assert got == {"total-flow": (3.5, "currency"), "entities-covered": (2.0, "count")}
    both = spark.createDataFrame([(2, "a", 4.0), (3, "b", 1.0)], "entity int, account string, combined double")
    got = {r["key"]: r.value for r in agg.kpis(flow, both, {"assets": "a", "absent": "z"}).collect()}
    assert got == {"total-flow": 3.5, "assets": 4.0, "absent": 0.0, "entities-covered": 3.0}
    assert [(r["key"], r.value) for r in agg.kpis(flow.limit(0), nothing, {"assets": "a"}).collect()] == [("entities-covered", 0.0)]


def test_rebuilt_details_and_names(spark):
    stored, rebuilt = spark.createDataFrame([(1, "s")], "k int, v string"), spark.createDataFrame([(1, "r"), (2, "r")], "k int, v string")
    assert {tuple(r) for r in agg.stored_or_rebuilt(stored, rebuilt, "k").collect()} == {(1, "s", "stored"), (2, "r", "rebuilt")}
    actual = spark.createDataFrame([("Años", 5.0), ("Other", 1.0)], "name string, actual double")
    control = spark.createDataFrame([("  AÃ±os ", 4.0, 1), ("años", 5.0, 2)], "name string, expected double, position int")
    assert {(r.name, r.rule, r.status) for r in reconcile.reconcile_names(actual, control, "name", "R").collect()} == {("AÑOS", "R", "passed"), ("OTHER", "REFERENCE_PREMIUM_INSTITUTION_MISSING", "warning")}


def test_repair_counters_fill_absent_domains(spark):
    events = spark.createDataFrame([("d", "direct-alias", "CrÃ©dito"), ("d", "unresolved", "CrÃ©dito"), ("d", "normalized-alias", "X"), ("d", "unresolved", "X")], "domain string, strategy string, raw string")
    domains = spark.createDataFrame([("d",), ("e",)], "domain string")
    assert {tuple(r) for r in resolve.repair_counters(events, domains).collect()} == {("d", 4, 2, 2), ("e", 0, 0, 0)}


def test_file_scores(spark):
    rows = [("f", 0, "Balance 1", 1, 1, "Name"), ("f", 0, "Balance 1", 2, 1, "total activos"), ("f", 0, "Balance 1", 61, 1, "reserves"), ("g", 0, "x", 1, 1, "Other")]
    table = spark.createDataFrame(rows, workbooks.CELLS)
    heads = workbooks.headers(table, spark.createDataFrame([("NAME", "name", 1)], "header_key string, canonical string, position int"))
    got = workbooks.tabular_scores(table, heads, "balance", ["name"], ["Balance"], 8.0, "name", ("ACTIVOS", "TOTAL ACTIVOS", "RESERVES")).collect()
    assert [(r.file, r.score) for r in got] == [("f", 8.0 + 6 + 2 * 15)]
    many = spark.createDataFrame([("c", i, "Totals" if i < 2 else f"s{i}", 1, 1, "v") for i in range(11)], workbooks.CELLS)
    assert workbooks.control_scores(many, "control", ["TOTALS", "S3"]).first().score == 2 * 12 + 15 + 8


def test_rankings_take_the_best_of_each_metric(spark):
    rows = spark.createDataFrame([(1, "b", 5.0, None), (2, "a", 5.0, 1.0)], "k int, name string, m double, n double")
    assert {(r.metric, r.k, r["rank"]) for r in agg.rankings(rows, ["m", "n"], "name", "k").collect()} == {("m", 2, 1), ("m", 1, 2), ("n", 2, 1)}
