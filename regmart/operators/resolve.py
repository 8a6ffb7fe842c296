"""Staged alias resolution with evidence: distinct texts are resolved once and joined back."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regmart.functions import text

STAGES = ("direct-alias", "direct-canonical", "normalized-alias", "normalized-canonical")


def resolve(values: DataFrame, aliases: DataFrame, catalog: DataFrame, normalizer: Callable[[Column], Column]) -> DataFrame:
    """raw, normalized, strategy, target, candidates and reason of every distinct ``values.raw``.

    aliases: alias, target; catalog: target, canonical. The first stage with any hit decides; several targets there are ambiguous. A text is normalized once, and so is a name.
    """
    plain = aliases.select(F.lit(0).alias("stage"), "alias", "target").unionByName(catalog.select(F.lit(1).alias("stage"), F.col("canonical").alias("alias"), "target"))
    side = plain.unionByName(plain.select((F.col("stage") + 2).alias("stage"), normalizer(F.col("alias")).alias("alias"), "target"))
    texts = values.select("raw").distinct().withColumn("normalized", normalizer(F.col("raw")))
    return _first(texts, side, STAGES, [F.col("raw"), F.col("raw"), F.col("normalized"), F.col("normalized")])


def first_stage(values: DataFrame, stages: list[tuple[str, DataFrame]], probes: list[Column] | None = None) -> DataFrame:
    """raw, strategy, target, candidates and reason (why several were not taken) of every distinct ``values.raw``, by the first of ``stages`` (name; alias and target) that knows its probe. One join for all stages."""
    side = reduce(lambda a, b: a.unionByName(b), [known.select(F.lit(i).alias("stage"), "alias", "target") for i, (_, known) in enumerate(stages)])
    return _first(values.select("raw").distinct(), side, [name for name, _ in stages], probes or [F.col("raw")] * len(stages))


def _first(texts: DataFrame, side: DataFrame, names: Sequence[str], probes: list[Column]) -> DataFrame:
    """Distinct texts ask all stages at once; what they find comes back in one group a text."""
    own = texts.columns
    asked = F.array(*[F.struct(F.lit(i).alias("stage"), p.alias("alias")) for i, p in enumerate(probes)])
    hit = F.when(F.col("target").isNotNull(), F.struct("stage", "target"))
    found = texts.select(*own, F.inline(asked)).join(side, ["stage", "alias"], "left").groupBy(*own).agg(F.array_sort(F.collect_set(hit)).alias("hits"))  # as many as a name has targets
    first = found.withColumn("stage", F.try_element_at("hits", F.lit(1))["stage"]).withColumn("candidates", F.transform(F.filter("hits", lambda h: h["stage"] == F.col("stage")), lambda h: h["target"]))
    many, stage = F.size("candidates") > 1, F.element_at(F.array(*map(F.lit, names)), F.col("stage") + 1)
    strategy = F.when(F.col("stage").isNull(), "unresolved").when(many, "ambiguous").otherwise(stage)
    return first.select(*own, strategy.alias("strategy"), F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias("target"), "candidates", F.when(many, F.concat(stage, F.lit("-matched-multiple-candidates"))).alias("reason"))


EVIDENCE = ("strategy", "target", "name", "repaired", "normalized", "candidate_ids", "candidate_names", "mojibake", "required", "reason")


def evidence(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolutions (raw, normalized, strategy, target, candidates, reason, and others) with what shows how they came about: ``EVIDENCE``. Texts are made once for each distinct one.

    name: of the target; repaired, normalized: the text without damage, and as it was compared; mojibake, required: whether it was damaged, whether it needed normalization;
    reason: why several candidates or none were taken, null for a plain hit.
    """
    names = F.broadcast(catalog.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("target", "canonical"))).alias("_names")))  # a fixed catalog, in one row
    shared = [c for c in found.columns if c not in ("strategy", "target", "candidates", "reason", "normalized")]
    raw = F.col("raw")
    told = found.select("raw", "normalized").distinct().select("raw", "normalized", text.repair_mojibake(raw).alias("repaired"), text.normalize_format_only(raw).alias("_plain"))
    mojibake = F.col("repaired") != raw
    required = F.when(F.col("strategy").startswith("direct"), False).when(F.col("strategy").startswith("normalized"), True).otherwise(mojibake | (F.col("_plain") != raw))
    reason = F.when(F.col("target").isNull(), F.coalesce("reason", F.when(F.size("candidates") > 0, "candidate-found-but-no-safe-resolution").otherwise("no-candidate"))).otherwise(F.col("reason"))
    return found.drop("normalized").join(told, "raw").crossJoin(names).select(
        *shared, "strategy", "target", F.element_at("_names", F.col("target")).alias("name"), "repaired", "normalized", F.col("candidates").alias("candidate_ids"),
        F.transform("candidates", lambda x: F.col("_names")[x]).alias("candidate_names"), mojibake.alias("mojibake"), required.alias("required"), reason.alias("reason"))


def resolve_with_lines(pairs: DataFrame, by_text: DataFrame, catalog: DataFrame, normalizer: Callable[[Column], Column]) -> DataFrame:
    """Resolutions of ``pairs`` (raw, line, and others) from those of their texts: a text that stays unresolved takes the entry of its line number. Its candidates are that entry and those
    whose names hold the text or are held by it; several without a line make it ambiguous."""
    found = with_line_fallback(pairs.join(by_text, "raw"), catalog)
    near = containment_candidates(by_text.filter("strategy = 'unresolved'"), catalog, normalizer).withColumnRenamed("candidates", "near")
    none = F.array().cast("array<string>")
    by_line, open_ = F.col("strategy") == "line-number-fallback", F.col("strategy") == "unresolved"
    joined = found.join(near, "raw", "left").withColumn("near", F.coalesce("near", none))
    line_target = F.when(by_line, F.col("target"))
    return joined.withColumns({
        "reason": F.when(by_line & (F.size("near") > 1), "text-matched-multiple-candidates-but-line-number-was-authoritative").when(open_ & (F.size("near") > 1), "substring-candidate-match-multiple-candidates").otherwise(F.col("reason")),
        "candidates": F.when(by_line | open_, merged_candidates(line_target, F.col("near"))).otherwise(F.col("candidates")),
        "strategy": F.when(open_, verdict(F.col("near"))).otherwise(F.col("strategy")),
    }).drop("near")


def merged_candidates(line_target: Column, candidates: Column) -> Column:
    """The line's candidate before those of the text, unless it is among them."""
    return F.when(line_target.isNull(), candidates).otherwise(F.array_distinct(F.concat(F.array(line_target), candidates)))


def verdict(candidates: Column) -> Column:
    """Several candidates make an unresolved text ambiguous."""
    return F.when(F.size(candidates) > 1, "ambiguous").otherwise("unresolved")


def with_line_fallback(resolved: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows (raw, line, strategy, target) that stay unresolved take the target of their line number."""
    first = lines.groupBy("line").agg(F.min_by("target", "sort_order").alias("line_target"))
    joined = resolved.join(first, "line", "left")
    use = (F.col("strategy") == "unresolved") & F.col("line_target").isNotNull()
    return joined.withColumn("target", F.when(use, F.col("line_target")).otherwise(F.col("target"))).withColumn("strategy", F.when(use, "line-number-fallback").otherwise(F.col("strategy"))).drop("line_target")


def containment_candidates(unresolved: DataFrame, catalog: DataFrame, normalizer: Callable[[Column], Column], least_length: int = 4) -> DataFrame:
    """raw and the catalog targets whose normalized name contains it or is contained in it; the catalog is a small dimension, the texts are distinct ones."""
    key = F.col("normalized") if "normalized" in unresolved.columns else normalizer(F.col("raw"))
    texts = unresolved.select("raw", key.alias("key")).distinct().filter(F.length("key") >= least_length)
    names = catalog.select("target", normalizer(F.col("canonical")).alias("name"))
    return texts.join(names, F.col("key").contains(F.col("name")) | F.col("name").contains(F.col("key"))).groupBy("raw").agg(F.array_sort(F.collect_set("target")).alias("candidates"))


def counters(events: DataFrame) -> DataFrame:
    """Outcome counters by domain and over all (domain null)."""
    s = F.col("strategy")
    direct, normalized = s.startswith("direct"), s.startswith("normalized")
    return events.rollup("domain").agg(
        F.count("*").alias("total"), F.count_if(direct | normalized).alias("aliases_matched"), F.count_if(direct).alias("resolved_directly"), F.count_if(normalized).alias("resolved_after_normalization"),
        F.count_if(s == "line-number-fallback").alias("line_fallback"), F.count_if(s == "ambiguous").alias("ambiguous"), F.count_if(s == "unresolved").alias("unresolved"),
    )


def repair_counters(events: DataFrame, domains: DataFrame) -> DataFrame:
    """Attempts whose text (``raw``) was damaged, and those that needed normalization, by domain; a domain without attempts has zeros."""
    raw = F.col("raw")
    found = events.select("domain", (text.repair_mojibake(raw) != raw).alias("damaged"), text.required_normalization(F.col("strategy"), raw).alias("required"))
    sums = found.groupBy("domain").agg(F.count("*").alias("total"), F.count_if("damaged").alias("mojibake"), F.count_if("required").alias("repaired"))
    return domains.join(sums, "domain", "left").na.fill(0, ["total", "mojibake", "repaired"])


def split_resolved(rows: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts, whose targets are all known, and one issue for each failed reference of the others."""
    good = None
    for t in targets:
        good = F.col(t).isNotNull() if good is None else good & F.col(t).isNotNull()
    failed = F.filter(F.array(*[F.when(F.col(t).isNull(), F.lit(t)) for t in targets]), lambda x: x.isNotNull())
    return rows.filter(good), rows.filter(~good).withColumn("reference", F.explode(failed))
