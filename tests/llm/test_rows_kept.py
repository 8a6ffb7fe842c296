"""Rows that differ only where an operator does not look: none is lost, and which of them stays is fixed."""

import pytest
from pyspark.sql import functions as F

from regmart.llm import jaccard, mixing, spotsigs, suffix

MOST = (1 << 63) - 1
PASSAGE = "the quick brown fox jumps over the lazy dog while seven old wizards boil toxic black liquid "


def test_greatest_id_is_an_id(spark):
    docs = spark.createDataFrame([(MOST, PASSAGE + "a"), (None, PASSAGE + "b"), (1, PASSAGE), (None, "x"), (MOST, "x")], "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix.remove_repeats(docs).collect())
    n = len(PASSAGE)
    assert got == sorted([("1", n, 0), (str(MOST), n + 1, n), ("None", n + 1, n), ("None", 1, 0), (str(MOST), 1, 0)])


def test_likeness_of_very_different_lengths(spark):
    long = " ".join(f"of word{i} thing{i}" for i in range(300))
    docs = spark.createDataFrame([(1, "of word0 thing0"), (2, long)], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in spotsigs.edited_likeness(docs).collect()}
    a, b = (set(r.signatures) for r in spotsigs.fingerprints(docs).orderBy("doc_id").collect())
    assert 0 < len(a & b) / len(a | b) < 0.02 and near[1] == pytest.approx(len(a & b) / len(a | b)) and near[2] == near[1]


def test_similar_at_one(spark):
    docs = spark.createDataFrame([(1, "of hill boat the river lake in lamp school"), (2, "of hill boat the river lake in lamp school"), (3, "of hill boat the river lake in lamp tree"), (4, "")], "doc_id long, text string")
    assert spotsigs.similar(docs, threshold=1.0).count() == 0  # equal fingerprints are one set
    assert spotsigs.similar(docs, threshold=0.3).count() == 1


def rows_alike(spark, order):
    rows = [(1, "a b c d", "x", note, {"k": note}) for note in ("first", "second", "third")] + [(2, "e f g h i j", "x", None, None), (2, "e f g h i j", "y", "own", None)]
    return spark.createDataFrame([rows[i] for i in order], "doc_id long, text string, source string, note string, more map<string,string>").repartition(2)


def test_mix_takes_every_row(spark):
    got = [[(r.doc_id, r.source, r.note, str(r.more)) for r in mixing.mixed_documents(rows_alike(spark, order), share=2.0).collect()] for order in ((0, 1, 2, 3, 4), (4, 2, 3, 1, 0))]
    assert got[0] == got[1] and {r[2] for r in got[0]} == {"first", "second", "third", None, "own"}
    copies = rows_alike(spark, (0, 0, 0, 1, 2, 3, 4))
    notes = [r.note for r in mixing.mixed_documents(copies, share=2.0).collect()]
    assert notes.count("first") == 3 * notes.count("second") and notes.count("second") == notes.count("third") > 0


def test_the_row_that_stays_is_fixed(spark):
    stay = {tuple(sorted((r.doc_id, r.note or "") for r in jaccard.one_of_each(rows_alike(spark, order).drop("more"), n=3).collect())) for order in ((0, 1, 2, 3, 4), (2, 4, 1, 0, 3), (1, 0, 2, 3, 4))}
    assert len(stay) == 1 and [i for i, _ in stay.pop()] == [1, 2]
    with_map = jaccard.one_of_each(rows_alike(spark, (0, 1, 2)), n=3)
    assert with_map.columns == ["doc_id", "text", "source", "note", "more"] and with_map.count() == 1
    assert with_map.select(F.col("more")["k"].alias("k"), "note").filter("k <> note").count() == 0
