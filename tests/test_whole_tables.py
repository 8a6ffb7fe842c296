"""Queries return a row for every row of their table."""

import __spark_entry__
from conftest import SMALL
from regmart.functions.text import MOJIBAKE, WORD_FIXES


def plain_repair(damaged):
    out = damaged
    if any(x in damaged for x in "ÂÃÐÑ"):
        try:
            out = damaged.encode("latin-1").decode()
        except UnicodeError:
            pass
    for pairs in (MOJIBAKE, WORD_FIXES):
        for wrong, right in pairs:
            out = out.replace(wrong, right)
    return out


def test_repair_covers_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.repaired for r in __spark_entry__.queries()["scl_01_repair_mojibake"](spark, SMALL).collect()}
    assert got == {i: None if t is None else plain_repair(t.encode().decode("latin-1")) for i, t in texts.items()}
