import __spark_entry__

from conftest import SMALL


def test_entry_and_a_few_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    for name in ("agg_04_kpis", "rec_05_flow", "jn_01_staged_resolution"):
        assert queries[name](spark, SMALL).count() > 0


def test_repair_query_restores_every_text(spark):
    assert __spark_entry__.queries()["scl_01_repair_mojibake"](spark, SMALL).filter("not same").count() == 0
