"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over training time. Targets come from the weights: the budget is shared by weight, no source
beyond ``most_repeats`` times its size, the excess shared anew among the others. A source's documents, in the order of a hash, take up its token
demand one after the other, pass after pass, until its target is met; a document's position is where the source's integrated
schedule reaches the demand before it, and the mix is range-sorted by position.

Running sums never gather a source in one task: rows alike are counted first, the others are dealt to ``BUCKETS`` hash ranges of each source, sums of the
ranges are added up in a small table (sources times BUCKETS rows), and only a range is ever ordered by one task. Running sums over the sources themselves go by
ranges as well, so that a table may have a source for every row.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source, the last; equal ids with texts of their own are documents of their own; rows alike in id, source
and text are copies that follow each other (in ``mixed_documents`` rows alike in all columns); ties of position go by id, then by the row's hash; a source of size 0 has target 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed, row_key

BUCKETS = 1024
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2
#: A source's weight at training time t in [0, 1] is its weight times (1 + slope * (2 t - 1)); slopes repeat like the weights. Their integral over the whole is the weight.
SLOPES = (0.5, -0.5, 0.0)
WORD = r"[^\x20\x09-\x0D]+"


def order_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)


def sized(docs: DataFrame, text_col: str = "text", source_col: str = "source", key: Column | None = None) -> DataFrame:
    """doc_id, source, size and a key that orders a source's rows the same way in every run: by default of id and text, so that rows alike in both are copies."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(source_col).cast("string").alias("source"), *([] if key is None else [key.alias("order_key")]))
    return rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), (order_key(F.col("text")) if key is None else F.col("order_key")).alias("order_key"))


def ahead(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with running sums of what stands before each in ``order``, which tells all rows apart. Rows are range-partitioned; a task orders its range, and what
    stands before the ranges comes from a table of one row a partition."""
    dealt = checkpointed(rows.select("*", *(x.alias(f"_{name}") for name, x in sums.items())).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    offsets = ranges.select("_range", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(offsets), "_range").select("*", *((F.coalesce(F.sum(f"_{name}").over(own), F.lit(0)) + F.col(f"_before_{name}")).alias(name) for name in sums))
    return found.select(*rows.columns, *sums)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_repeats: float = MOST_REPEATS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """A row for each source: source, source_size, weight, slope and target.

    Shares that stop at a limit: with sources in ascending order of limit / weight, a source is held at its limit if giving every source from it
    on the same multiple of its weight would pass the limit. One ordered pass over the sources finds the common multiple.
    """
    one = ahead(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], i=F.lit(1))
    one = (
        one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
        .withColumn("slope", F.element_at(F.array(*map(F.lit, slopes)), (F.col("i") % len(slopes) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * most_repeats)
    )
    size, weight = one.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (
        ahead(one, [F.col("limit") / F.col("weight"), F.col("i")], used=F.col("limit"), weight_used=F.col("weight"))
        .withColumn("multiple", F.greatest(F.lit(0.0), (F.lit(float(size or 0) * share) - F.col("used")) / (F.lit(weight or 0.0) - F.col("weight_used"))))
        .withColumn("free", F.col("multiple") * F.col("weight") < F.col("limit"))
    )
    level = checkpointed(level)
    common, free = level.agg(F.min_by("multiple", F.struct((~F.col("free")).cast("int"), F.col("limit") / F.col("weight"), F.col("i"))), F.max("free")).first()
    limit = F.col("limit").cast("double")
    return level.select("source", "source_size", "weight", "slope", (F.least(limit, F.lit(common) * F.col("weight")) if free else limit).alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_repeats: int = MOST_REPEATS, slopes: tuple[float, ...] = SLOPES, buckets: int = BUCKETS, key: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, passes (times the mix takes it) and positions (one for each time, in [0, 1])."""
    source_key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    alike = sized(docs, key=key).groupBy("doc_id", "source", "size", "order_key").agg(F.count("*").alias("copies"))
    sizes = checkpointed(alike.withColumn("bucket", F.pmod(F.shiftright("order_key", 20), F.lit(buckets)).cast("int")).withColumn("words", F.col("size") * F.col("copies")))
    per = sizes.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").withColumn("source_key", source_key)
    goals = targets(sizes.select("source", F.col("words").alias("size")), weights, share, most_repeats, slopes).withColumn("source_key", source_key).drop("source")
    offsets = offsets.drop("source").join(goals, "source_key")
    own = Window.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        sizes.withColumn("source_key", source_key)
        .withColumn("inside", F.coalesce(F.sum("words").over(own), F.lit(0)))
        .join(offsets, ["source_key", "bucket"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("offset") + F.col("inside") + F.col("copy") * F.col("size"))
    )
    # A document is taken in a pass if its middle lies within what the target leaves for that pass.
    middle = F.col("start") + F.col("size") / 2
    left = [F.col("target") - F.lit(k) * F.col("source_size") for k in range(most_repeats)]
    passes = F.when(F.col("size") == 0, 0).otherwise(sum((middle <= x).cast("int") for x in left))
    # Integrated schedule of a source: D(t) = t + slope * (t * t - t), of demand 0 to 1; its inverse gives the position.
    def inverse(x):
        s = F.col("slope")
        return F.when(F.abs(s) < 1e-9, x).otherwise((s - 1 + F.sqrt((1 - s) * (1 - s) + 4 * s * x)) / (2 * s))

    demand = [F.least(F.lit(1.0), (F.col("start") + F.lit(k) * F.col("source_size")) / F.col("target")) for k in range(most_repeats)]
    positions = F.array(*[inverse(x) for x in demand])
    return at.withColumn("passes", passes.cast("int")).select(
        "doc_id", "source", "size", "source_size", "target", "passes", "order_key", F.when(F.col("target") > 0, F.slice(positions, 1, F.col("passes"))).otherwise(F.array().cast("array<double>")).alias("positions")
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mix: a row for each time that a document is taken (doc_id, source, size, position), range-sorted by position."""
    return plan(docs, **options).select("doc_id", "source", "size", F.explode("positions").alias("position")).orderBy("position", "doc_id", "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns, range-sorted by position. Only rows alike in all columns are copies of one another."""
    names, key = docs.columns, row_key(docs)
    id_key, source_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(*names, id_key.alias("_id"), source_key.alias("_source"), key.alias("_order")).dropDuplicates(["_id", "_source", "_order"])
    taken = plan(docs, key=key, **options).select(id_key.alias("_id"), source_key.alias("_source"), F.col("order_key").alias("_order"), F.explode("positions").alias("_position"))
    return rows.join(taken, ["_id", "_source", "_order"]).orderBy("_position", "doc_id", "_order").select(*names)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """A row for each document, range-sorted by its first position (those never taken last): doc_id, size, source_size, target, taken, first_position."""
    rows = plan(docs, **options)
    found = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), F.try_element_at("positions", F.lit(1)).alias("first_position"))
    return found.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
