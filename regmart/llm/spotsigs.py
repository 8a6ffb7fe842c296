"""Document fingerprints: spot signatures, in DataFrame functions only.

Words are runs of letters and digits, lower-cased. A common word is an anchor (a fixed list in four languages, and any word of one or two characters); its
signature is the anchor with the next ``CHAIN`` content words, however many anchors stand between. The start of the text is an anchor as well, so every
text has a signature. A fingerprint is the sorted set of the signatures' 64-bit hashes; likeness is the Jaccard similarity of two sets.

Neighbours in the order of ids are found without a global sort: ``BUCKET`` ids make a bucket, a window gives each row its follower in the bucket, and
only the last row of a bucket looks up the first of the next bucket, over a tree of buckets of buckets.

Defined cases: a null text is empty; a text without words has the one signature of an empty chain, so two of them are alike; null ids come first in
the order; rows of one id are ordered by text; after the last row comes the first, which may be the row itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed

CHAIN, BUCKET_BITS = 2, 6
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its may more most no not of on one only or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer eines er es für hat ich ihr im ist kann mit nach nicht noch nur oder sein sich sie sind so um und uns vom von vor war wenn wie wir wird zu zum zur über "
    "au aux avec ce ces cette comme dans de du elle en est et il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous à été être "
    "al algo como con cuando del desde donde el ella ellos era eran esa ese eso esta este esto fue ha hasta hay las lo los me mi muy más nos o para pero por porque sin sobre su sus también te tu una uno unos y ya"
).split()


def with_signatures(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds the sorted signature set of a text. Each step is a column of its own, so that no array is computed anew for each of its elements."""
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.transform(words, lambda w: F.when(w.isin(sorted(set(ANCHORS))) | (F.length(w) <= 2), F.concat(F.lit("\x01"), w)).otherwise(w))
    is_anchor = lambda w: F.startswith(w, F.lit("\x01"))
    anchors = F.filter(F.transform("_words", lambda w, i: F.when(is_anchor(w), F.struct(w.alias("w"), i.alias("i")))), lambda a: a.isNotNull())

    def signature(anchor: Column, content_before: Column) -> Column:
        return F.xxhash64(anchor, *(F.coalesce(F.get("_content", content_before + k), F.lit("")) for k in range(CHAIN)))

    # Of the words before the j-th anchor all but j are content words.
    found = F.transform("_anchors", lambda a, j: signature(a["w"], a["i"] - j))
    steps = rows.withColumn("_words", marked).withColumn("_content", F.filter("_words", lambda w: ~is_anchor(w))).withColumn("_anchors", anchors)
    return steps.withColumn(name, F.array_sort(F.array_distinct(F.array_append(found, signature(F.lit("^"), F.lit(0)))))).drop("_words", "_content", "_anchors")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def printed(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.hex(x))), ",")


def successors(keys: DataFrame, key: str) -> DataFrame:
    """``key`` and the next larger key (``following``), of distinct longs; the largest is followed by the smallest.

    Level by level, 64 neighbouring groups at a time hand on the least key of the next group: no task sees more than 64 rows of a group.
    """
    low, high = keys.agg(F.min(key), F.max(key)).first()
    if low is None:
        return keys.select(key, F.col(key).alias("following"))
    groups = keys.select((F.col(key) - low).alias("g"), F.col(key).alias("least"), F.col(key).alias("most"))
    found, base = [], low
    span = high - low
    while span:
        w = Window.partitionBy(F.shiftright("g", BUCKET_BITS)).orderBy("g")
        found.append(groups.withColumn("following", F.lead("least").over(w)).filter("following is not null").select(F.col("most").alias(key), "following"))
        groups = groups.groupBy(F.shiftright("g", BUCKET_BITS).alias("g")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
        span >>= BUCKET_BITS
    out = groups.select(F.col("most").alias(key), F.lit(base).cast("long").alias("following"))
    for part in found:
        out = out.unionByName(part)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, signatures (array) and fingerprint (their hashes as text) of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_signatures(rows, "text", "signatures").select("doc_id", F.length("text").cast("long").alias("n_chars"), "signatures", printed(F.col("signatures")).alias("fingerprint"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its second half replaced by the start of the next document), with their likeness."""
    bucket_of = F.shiftright(F.col(id_col).cast("long"), BUCKET_BITS)
    least = docs.agg(F.min(bucket_of)).first()[0]
    bucket = F.coalesce(bucket_of, F.lit((least or 0) - 1)).alias("bucket")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), bucket).repartition("bucket")
    in_order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    signed = with_signatures(rows, "text", "signatures")
    lined = signed.withColumn("next_text", F.lead("text").over(in_order)).withColumn("next_signatures", F.lead("signatures").over(in_order))

    buckets = checkpointed(docs.select(bucket).distinct())
    firsts = rows.withColumn("n", F.row_number().over(in_order)).filter("n = 1").select(F.col("bucket").alias("following"), F.col("text").alias("first_text"))
    firsts = with_signatures(firsts.join(successors(buckets, "bucket"), "following").drop("following"), "first_text", "first_signatures")
    both = lined.join(firsts.hint("merge"), "bucket", "left")
    both = both.select("doc_id", "text", "signatures", F.coalesce("next_text", "first_text").alias("next_text"), F.coalesce("next_signatures", "first_signatures").alias("next_signatures"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = both.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    edited = with_signatures(edited, "edited", "edited_signatures")
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("signatures")).alias("fingerprint"),
        printed(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of different fingerprints with likeness of ``threshold`` or more: left_id < right_id (least ids of their fingerprints), likeness.

    Sets are partitioned by length so that partners lie in one partition or the next, and a set of n signatures is found by its n - ceil(threshold * n) + 1
    rarest ones. Where sets meet, lengths that rule out the threshold, and positions of the shared signature that leave too few others, prune a pair before it is compared.
    Equal fingerprints are one set, so copies make no pairs.
    """
    sets = checkpointed(fingerprints(docs, id_col, text_col).filter("doc_id is not null").groupBy("signatures").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("signatures")))
    each = sets.select("id", "n", F.explode("signatures").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    rank = Window.partitionBy("id").orderBy("often", "sig")
    placed = each.join(often, "sig").withColumn("at", F.row_number().over(rank)).filter("at <= n - ceil(n * CAST({t} AS double) - 1e-9) + 1".format(t=threshold))
    level = F.floor(F.log(F.col("n")) / math.log(1 / threshold)).cast("int") if threshold < 1 else F.col("n")
    left = placed.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("at").alias("aat"), level.alias("level"), "sig")
    right = left.toDF("b", "bn", "bat", "level", "sig").select("b", "bn", "bat", "sig", F.explode(F.array("level", F.col("level") - 1, F.col("level") + 1)).alias("level"))
    needed = threshold / (1 + threshold) * (F.col("an") + F.col("bn")) - 1e-9
    may = (F.least("an", "bn") >= threshold * F.greatest("an", "bn") - 1e-9) & (F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) + F.least("aat", "bat") >= needed)
    pairs = left.join(right, ["level", "sig"]).filter((F.col("a") < F.col("b")) & may).select("a", "b").distinct()
    x, y = (sets.select(F.col("id").alias(i), F.col("signatures").alias(s)) for i, s in (("a", "sa"), ("b", "sb")))
    scored = pairs.join(x, "a").join(y, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return scored.filter(F.col("likeness") >= threshold - 1e-12).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "likeness")
