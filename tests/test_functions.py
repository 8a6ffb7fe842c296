from pyspark.sql import functions as F

from regmart.functions import numbers, text
from regmart.operators import quality, reconcile, resolve


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x"))).first()[0]


def test_mojibake(spark):
    for broken, fixed in [("CrÃ©ditos Diferidos", "Créditos Diferidos"), ("Hospitalizaci贸n", "Hospitalización"), ("Casco Marit铆mo", "Casco Marítimo"), ("COMPAÑIA", "COMPAÑIA"), ("", ""), (None, None)]:
        assert one(spark, text.repair_mojibake, broken) == fixed


def test_normalization(spark):
    keys = {one(spark, text.normalize_entity_alias, x) for x in ("SEGUROS EQUIDAD, S.A.", "Seguros Equidad", "SEGUROS EQUIDAD SA")}
    assert keys == {"SEGUROS EQUIDAD"}
    assert one(spark, text.normalize_alias, "otros seguros generales  /  ganadero") == "OTROS SEGUROS GENERALES GANADERO"
    assert one(spark, text.sanitize_filename, "a/b c.xlsx") == "b_c.xlsx"
    assert one(spark, text.slug_key, " Años  Ñandú ") == "anos-nandu"


def test_numbers(spark):
    assert [one(spark, numbers.number_value, x) for x in ("", "12.5", "x", None)] == [0.0, 12.5, None, None]
    assert str(spark.range(1).select(numbers.serial_to_date(F.lit(46053))).first()[0]) == "2026-01-31"
    assert spark.range(1).select(numbers.safe_ratio(F.lit(1.0), F.lit(0.0))).first()[0] == 0.0


def test_staged_resolution(spark):
    aliases = spark.createDataFrame([("Uno", "1"), ("uno ", "1"), ("Dos", "2"), ("dos", "3")], "alias string, target string")
    catalog = spark.createDataFrame([("UNO SA", "1", 1, 1), ("TRES", "3", 3, 2)], "canonical string, target string, line int, sort_order int")
    values = spark.createDataFrame([("Uno",), ("UNO",), ("DOS",), ("tres",), ("?",), (None,)], "raw string")
    found = {r.raw: (r.strategy, r.target) for r in resolve.resolve(values, aliases, catalog, text.normalize_entity_alias).collect()}
    assert found == {"Uno": ("direct-alias", "1"), "UNO": ("normalized-alias", "1"), "DOS": ("ambiguous", None), "tres": ("normalized-canonical", "3"), "?": ("unresolved", None), None: ("unresolved", None)}


def test_publishability(spark):
    def level(strict, *severities):
        return spark.createDataFrame([(s,) for s in severities], "s string").agg(quality.publishability(F.col("s"), strict)).first()[0]

    assert [level(True, "high"), level(False, "high"), level(True, "medium"), level(True), level(False, "critical")] == ["blocked", "warningOnly", "warningOnly", "publishable", "blocked"]


def test_reconcile(spark):
    actual = spark.createDataFrame([(1, 100.0), (2, 101.0), (3, 5.0)], "k int, actual double")
    control = spark.createDataFrame([(1, 100.0), (2, 100.0)], "k int, expected double")
    found = {r.k: (r.rule, r.severity, r.status) for r in reconcile.reconcile(actual, control, "k", "R").collect()}
    assert found == {1: ("R", "low", "passed"), 2: ("R", "high", "warning"), 3: ("REFERENCE_PREMIUM_INSTITUTION_MISSING", "medium", "warning")}


def test_repair_of_sound_texts(spark):
    """The test for damage passes over no text that a replacement would change."""
    damaged = [f"x {p} y" for p, _ in text.MOJIBAKE + text.WORD_FIXES]
    sound = ["", "plain", "año, más", "\U0001f600 日本", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in damaged + sound], "x string").coalesce(1).select(text.repair_mojibake(F.col("x"))).collect()]
    assert got[len(damaged):] == sound
    assert all(a != b for a, b in zip(got, damaged))
