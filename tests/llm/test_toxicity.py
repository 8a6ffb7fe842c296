"""Folding, lexicon matching and the learned scores of toxicity."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from regmart.llm import queries, toxicity
from regmart.llm.toxicity import Lexicon, fold, forms, matches


def test_fold():
    assert fold("An Ӏ!") == " an ӏ "
    assert fold("1d10t, MОRОN") == " idiot moron "  # Cyrillic О
    assert fold("$tup1d ｓｃｕｍ cl​own losеr") == " stupid scum clown loser "
    assert fold("trash$$$ $$$ 42 100 3!") == " trash "
    assert fold("réeux é") == " réeux é " and forms("réeux")[1] == " reeux "
    assert fold("") == "  " and forms("\n ") == ["  "]
    assert len(fold("$" * 200_000)) < 10


def plain_matches(lexicon, text):
    words, at, out = text.split(), 1, []
    spans = []
    for i, w in enumerate(words):
        for phrase in (f" {w} ", f" {w} {words[i + 1]} " if i + 1 < len(words) else None):
            if phrase in lexicon.exceptions:
                spans.append((i, i + len(phrase.split())))
    for i, w in enumerate(words):
        own = [x for e, x in lexicon.weights.items() if w.startswith(e)]
        if own and not any(a <= i < b for a, b in spans):
            out.append(max(own))
    return sorted(out)


def test_matches_against_plain_search():
    import random

    rnd = random.Random(3)
    lexicon = Lexicon({"tra": 1.0, "trash": 3.0, "scum": 2.5, "idiot": 4.0, "idi": 0.5}, {" trash can ", " scumble ", " idiot proof "})
    words = ["trash", "can", "tray", "scumble", "scum", "idiot", "proof", "idioms", "a", "river"]
    built = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(9)))
        assert sorted(w for _, w in matches(built, forms(text))) == plain_matches(lexicon, text), text
    assert "idi" in lexicon.without_shadowed().weights and Lexicon({"idi": 5.0, "idiot": 4.0}).without_shadowed().weights == {"idi": 5.0}


@pytest.fixture(scope="module")
def taught(spark):
    import random

    rnd = random.Random(1)
    some = lambda n: [rnd.choice("lamp hill boat river stone cloud leaf tree bird road".split()) + rnd.choice(["", "s", "er"]) for _ in range(n)]

    def text(i):
        words = some(rnd.randrange(4, 20))
        own = (["grumbol", "zork"][i % 2],) if i % 3 == 0 else ("zork", "gate") if i % 40 == 1 else ()
        at = rnd.randrange(len(words))
        return " ".join([*words[:at], *own, *words[at:]])

    rows = spark.createDataFrame([(i, text(i), 1, 0.5) for i in range(1500)], "doc_id long, text string, bad int, score double")
    labels = rows.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    return rows, labels, toxicity.train(rows, labels)


def test_learned_words_disguises_and_exceptions(spark, taught):
    rows, labels, model = taught
    assert any(e.startswith("grum") or "grumbol".startswith(e) for e in model.lexicon.weights)
    cases = {"a grumbol by the hill": 1, "A GRUMB0L!! BY": 1, "а grumb​оl by hill": 1, "grümbol by a hill": 1, "hill zork boat": 1, "hill zork gate boat": 0, "the hill": 0, "": 0, "river " * 50_000: 0}
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert " zork gate " in model.lexicon.exceptions and " zork " not in model.lexicon.exceptions
    found = toxicity.train_and_score(rows, labels).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in found) and {r.held_out for r in found} == {True, False}
    assert sorted(toxicity.score(rows, toxicity.train(rows, labels)).collect()) == sorted(toxicity.score(rows, model).collect())


def test_defined_cases(spark, taught):
    rows, labels, model = taught
    odd = spark.createDataFrame([(None, "grumbol hill"), (1, None), (1, ""), (1, ""), (2, "x")], "doc_id long, text string")
    found = toxicity.train_and_score(odd, labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, toxic int"))).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found) and [r.held_out for r in found if r.doc_id is None] == [False]
    assert {r.score for r in toxicity.train_and_score(rows, labels.filter("false")).collect()} == {0.5}
    assert min(r.score for r in toxicity.train_and_score(rows, labels.withColumn("toxic", F.lit(1))).collect()) > 0.99
    assert toxicity.train_and_score(rows.filter("false"), labels).count() == 0
    many = toxicity.sampled(rows.unionByName(rows.withColumn("text", F.concat("text", F.lit("!")))), labels.unionByName(labels), "toxic", 30, 60)
    assert 20 < many.count() < 200


def test_held_out_labels(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in queries.op11_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    caught = [r.predicted for r in found if labels[r.doc_id]]
    clean = [r.predicted for r in found if not labels[r.doc_id]]
    assert len(caught) > 100 and sum(caught) / len(caught) > 0.85 and sum(clean) / len(clean) < 0.005
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
