"""KPIs, shares, rankings and entity details over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regmart.functions.numbers import money, safe_ratio


def amount_by(facts: DataFrame, key: str, amount: str = "amount") -> DataFrame:
    """Amount by key with its share of the whole: partial sums before the shuffle, the share over the few groups."""
    grouped = facts.groupBy(key).agg(money(F.col(amount)).alias("sum"))
    total = F.sum("sum").over(Window.partitionBy(F.lit(1)))  # over the few groups
    return grouped.select(key, F.col("sum").cast("double").alias("amount"), safe_ratio(F.col("sum").cast("double"), total.cast("double")).alias("share"))


def entities_covered(*facts: DataFrame, key: str = "entity") -> DataFrame:
    """One row, ``entities``: the distinct keys over all fact sets. Each is reduced to its own keys before they meet."""
    keys = [f.select(key).distinct() for f in facts]
    return reduce(lambda a, b: a.unionByName(b), keys).agg(F.count_distinct(key).alias("entities"))


def named_shares(facts: DataFrame, key: str, exact: str, names: DataFrame) -> DataFrame:
    """key, name, amount and share of the whole, of exact sums by key; names (key, name) are a catalog, an unknown key is its own name."""
    grouped = facts.groupBy(key).agg(F.sum(exact).alias("sum"))
    total = F.sum("sum").over(Window.partitionBy(F.lit(1)))  # over the few groups
    shares = grouped.select(key, F.col("sum").cast("double").alias("amount"), safe_ratio(F.col("sum").cast("double"), total.cast("double")).alias("share"))
    return with_names(shares, names, key, "name").select(key, "name", "amount", "share")


def with_names(rows: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Looks up names; an unknown key is its own name."""
    return rows.join(dim.select(key, F.col(name).alias("name")), key, "left").withColumn("name", F.coalesce("name", F.col(key).cast("string")))


def ranked(rows: DataFrame, metric: str, name: str, key: str, top: int = 12, collation: str | None = "es") -> DataFrame:
    """Rank by metric, then name and key in the collation's order."""
    by = [F.collate(F.col(c).cast("string"), collation) if collation else F.col(c) for c in (name, key)]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(metric).desc(), *by))).filter(F.col("rank") <= top)


def conditional_totals(facts: DataFrame, by: list[str], accounts: dict[str, str], account: str = "account", amount: str = "combined") -> DataFrame:
    """A column for each named account; an absent account gives 0."""
    sums = [F.coalesce(money(F.when(F.col(account) == a, F.col(amount))), F.lit(0)).cast("double").alias(n) for n, a in accounts.items()]
    return facts.groupBy(*by).agg(*sums) if by else facts.agg(*sums)


def kpis(flow: DataFrame, balance: DataFrame, accounts: dict[str, str]) -> DataFrame:
    """key, value and unit; domain rows only where the domain has rows, the count always. Each fact table is read once, its sums by entity make all figures."""
    f = flow.groupBy("entity").agg(money(F.col("amount")).alias("total-flow"), F.count("*").alias("flows"))
    x = balance.groupBy("entity").agg(*[money(F.when(F.col("account") == a, F.col("combined"))).alias(n) for n, a in accounts.items()], F.count("*").alias("balances"))
    entities = f.unionByName(x, allowMissingColumns=True).groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("total-flow", "flows", *accounts, "balances")])
    value = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    row = lambda key, v, unit, shown: F.struct(F.lit(key).alias("key"), v.alias("value"), F.lit(unit).alias("unit"), shown.alias("shown"))
    some = {n: F.coalesce(F.sum(n), F.lit(0)) > 0 for n in ("flows", "balances")}
    rows = [row("total-flow", value("total-flow"), "currency", some["flows"]), *[row(n, value(n), "currency", some["balances"]) for n in accounts], row("entities-covered", F.count("*").cast("double"), "count", F.lit(True))]
    return entities.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).filter("shown").drop("shown")


def top_rows(facts: DataFrame, by: str, order: list[Column], top: int) -> DataFrame:
    return facts.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("position") <= top)


def top_lists(facts: DataFrame, lists: dict[str, str], amount: str, top: int = 12) -> DataFrame:
    """list, item, amount: the best items of several lists (name -> key) over one fact table, ties by item. The facts are read once: sums by all keys together, then by each."""
    keys = list(dict.fromkeys(lists.values()))
    sums = facts.groupBy(*keys).agg(money(F.col(amount)).alias("sum"))
    entry = F.array(*[F.struct(F.lit(name).alias("list"), F.col(key).cast("string").alias("item")) for name, key in lists.items()])
    items = sums.select("sum", F.inline(entry)).groupBy("list", "item").agg(F.sum("sum").cast("double").alias("amount"))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("amount"), "item"))
    return items.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def last_by(facts: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """The value of the last row of each key by the order; of rows alike in it the greatest value."""
    return facts.groupBy(by).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def stored_or_rebuilt(stored: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """Stored details, and the rebuilt ones of keys that have none stored; ``origin`` tells which."""
    lacking = rebuilt.join(stored.select(key), key, "left_anti")
    return stored.withColumn("origin", F.lit("stored")).unionByName(lacking.withColumn("origin", F.lit("rebuilt")))


def rankings(rows: DataFrame, metrics: list[str], name: str, key: str, top: int = 12, collation: str | None = "es") -> DataFrame:
    """The best keys of each metric (metric, key, name, amount, rank), equal amounts by name and key in the collation's order; keys without the metric are not ranked."""
    by = [F.collate(F.col(c).cast("string"), collation) if collation else F.col(c) for c in (name, key)]
    long = rows.unpivot([key, name], metrics, "metric", "amount").filter("amount is not null")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("amount"), *by))).filter(F.col("rank") <= top)
