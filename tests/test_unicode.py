"""Compatibility composition and accents against Python's own normalization."""

import unicodedata

from pyspark.sql import functions as F

from regmart.functions import text

WORDS = ["ＡＢＣ　１２", "ﬁnal ½ ㎏", "café niño", "ẫ Việt", "ｶﾞｷﾞ", "x́̂", "①②", "Ǆ Ĳ", "́a", "Ω µ ſ", "plain", "", "𝐀𝐁", "ö̧", "한국", "Ａ̊"]


def test_nfkc(spark):
    got = [r[0] for r in spark.createDataFrame([(w,) for w in WORDS], "x string").coalesce(1).select(text.nfkc(F.col("x"))).collect()]
    assert got == [unicodedata.normalize("NFKC", w) for w in WORDS]
    assert spark.sql("select cast(null as string) as x").select(text.nfkc(F.col("x"))).first()[0] is None


def test_every_character(spark):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xF900 and unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in chars], "x string").select("x", text.nfkc(F.col("x"))).collect()}
    assert {c for c in chars if got[c] != unicodedata.normalize("NFKC", c)} == set()


def test_strip_diacritics_beyond_latin_extended(spark):
    words = ["Việt Nam", "Ḃẁ", "Ἀθῆναι", "niño", "がギ"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "x string").coalesce(1).select(text.strip_diacritics(F.col("x"))).collect()]
    assert got == ["Viet Nam", "Bw", "Αθηναι", "nino", "がギ"]


def test_marks_jamo_and_sequences(spark):
    import random

    rnd = random.Random(9)
    marks = [chr(c) for c in range(0x300, 0x3100) if unicodedata.combining(chr(c))]
    starters = list("aeioqsdAE ﬁ½") + ["ṡ", "ẛ", "ạ", "ḍ", "が", "क़", "ᄀ", "ᅡ", "ᆨ", "가", "각", "ᄒ", "ᅵ", "ᇂ", "ে", "া", "ೆ", "ೂ", "ೕ", "ෙ", "ා", "\U0001109b", "ｶ", "ﾞ", "한"]
    texts = ["q̣̇", "ẛ̣", "한", "ậ", "ȩ́", "̣a", "ḍ̇̇"]
    texts += ["".join(rnd.choice(starters if rnd.random() < 0.5 else marks[:120] if rnd.random() < 0.8 else marks) for _ in range(rnd.randrange(1, 9))) for _ in range(4000)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in texts], "x string").select("x", text.nfkc(F.col("x"))).collect()}
    wrong = [(w.encode("unicode_escape"), got[w], unicodedata.normalize("NFKC", w)) for w in texts if got[w] != unicodedata.normalize("NFKC", w)]
    assert wrong == []
