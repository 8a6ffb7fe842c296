"""Stored records of any shape they ever had, as typed rows: a record is JSON text, fields may stand under older names, be absent, or be of another type.

A reader takes each field from the first of its names that has a value of its kind, fills nested defaults, and sends a record that breaks a rule to the issues, with the rule's
name. List items are cut from typed records in place: arrays of structs filtered or emptied, structs rebuilt; nothing is exploded and no row meets another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regmart.operators import quality

# Names of the counters of a mapping summary, newest first.
COUNTERS = {
    "repaired": ("repairedByNormalization",), "matched": ("aliasesMatched",), "by_line": ("fallbackByLineNumber", "lineNumberFallback"), "ambiguous": ("ambiguousAliases",),
    "unresolved": ("unresolvedAliases", "unresolved"), "total": ("totalAttempts",),
}
TEXT_QUALITY = {
    "mojibake": ("textQuality.textsRequiringMojibakeRepair",), "after_normalization": ("textQuality.aliasesResolvedAfterNormalization",), "by_alias": ("textQuality.aliasesResolvedByDirectAlias",),
    "by_line": ("textQuality.aliasesResolvedByLineNumberFallback", "lineNumberFallback"), "ambiguous": ("textQuality.ambiguousAliases", "ambiguousAliases"),
    "unresolved": ("textQuality.unresolvedAliases", "unresolvedAliases", "unresolved"),
}
DOMAINS = ("institution", "insuranceLine", "financialAccount")
DOMAIN_COUNTERS = {
    "total": ("totalAttempts",), "repaired": ("repairedByNormalization",), "matched": ("aliasesMatched",), "by_line": ("fallbackByLineNumber", "lineNumberFallback"), "ambiguous": ("ambiguousAliases",),
    "unresolved": ("unresolvedAliases", "unresolved"), "mojibake": ("textsRequiringMojibakeRepair",), "after_normalization": ("aliasesResolvedAfterNormalization",), "by_alias": ("aliasesResolvedByDirectAlias",),
}
# Kinds of a record's parts.
ISSUE = "struct<code:string,severity:string,status:string,scope:string,message:string>"
CHECK = "struct<ruleId:string,severity:string,status:string,scope:string,expectedValue:string,actualValue:string,message:string>"
FILE = "struct<sourceFileId:string,kind:string,originalFilename:string,storedFilename:string,sha256:string,sizeBytes:bigint,mimeType:string,detectedSignature:string,uploadedAt:string>"
PERIOD = "struct<reportDate:string,year:int,month:int,yearMonth:string,excelSerial:double>"
REPAIR = "struct<domain:string,originalValue:string,repairedValue:string,normalizedValue:string,canonicalId:string,canonicalName:string,strategy:string,count:bigint>"
PARTS = ("premiums", "financialPosition", "incomeStatement", "reference")
RECORD = (
    f"struct<datasetVersionId:string,ingestionRunId:string,status:string,createdAt:string,publishedAt:string,uploadedBy:string,datasetScope:string,fingerprint:string,sourceFiles:array<{FILE}>,"
    f"businessPeriods:struct<{','.join(f'{p}:{PERIOD}' for p in PARTS)}>,mappingSummary:struct<topAliasRepairs:array<{REPAIR}>>,"
    f"validationSummary:struct<publishability:string,issues:array<{ISSUE}>>,reconciliationSummary:struct<publishability:string,issues:array<{CHECK}>>>"
)
#: The parts of a record that its rules look at.
RULED = "struct<datasetVersionId:string,status:string,createdAt:string,publishedAt:string,validationSummary:struct<publishability:string>,reconciliationSummary:struct<publishability:string>>"
STATES = ("draft", "staged", "published", "failed", "rolledBack")
CLASSIFICATION = "WORKBOOK_SCHEMA_UNRECOGNIZED"
NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def number(v: Column, path: str) -> Column:
    """The number at a path of a variant; null for anything else, texts of digits included."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")).rlike(NUMBER), F.try_variant_get(v, f"$.{path}", "double"))


def counters(v: Column, names: dict[str, tuple[str, ...]], under: str = "") -> Column:
    """A struct of counters, each from the first of its names that has a number, else 0."""
    return F.struct(*[F.coalesce(*(number(v, under + path) for path in paths), F.lit(0.0)).cast("long").alias(name) for name, paths in names.items()])


def mapping_summary(v: Column) -> Column:
    """The mapping summary of a variant with all defaults: counters, text quality, counters of each domain."""
    none = F.struct(*[F.lit(0).cast("long").alias(name) for name in DOMAIN_COUNTERS])
    part = lambda d: once(F.try_variant_get(v, f"$.domains.{d}", "variant"), lambda x: F.when(x.isNotNull(), counters(x, DOMAIN_COUNTERS)).otherwise(none))
    domains = F.array(*[F.struct(F.lit(d).alias("domain"), part(d).alias("counters")) for d in DOMAINS])
    return F.struct(counters(v, COUNTERS).alias("counters"), counters(v, TEXT_QUALITY).alias("text_quality"), domains.alias("domains"))


def defaulted(c: Column, fields: dict[str, object]) -> Column:
    """An array of structs, never null, with defaults for the fields that have one."""
    filled = lambda x: reduce(lambda s, f: s.withField(f[0], F.coalesce(s[f[0]], F.lit(f[1]))), fields.items(), x)
    return F.transform(F.coalesce(c, F.array()), filled)


def versions(raw: DataFrame, text: str = "record") -> tuple[DataFrame, DataFrame]:
    """Typed version records of the JSON texts in ``text``, other columns kept, and an issue (other columns, code, detail) for each that breaks a rule.

    Defined cases: what is no JSON object is ``RECORD_UNREADABLE``; then, first broken rule first, an id, a known state, times that are times, a publication time if published, known
    publishabilities. A record without a state is a draft; absent parts are empty, absent numbers 0, an absent mapping summary stays null.
    """
    kept = [c for c in raw.columns if c != text]
    whole = F.col(text)
    is_object = F.ltrim(whole, F.lit(" \t\r\n")).startswith("{")
    # A record is parsed once: a generator makes its row, so no filter and no later column holds a copy of the parsing.
    parsed = lambda fields: F.transform(F.array(F.try_parse_json(whole)), lambda v: F.struct(v.alias("v"), F.from_json(F.when(v.isNotNull() & is_object, whole), fields).alias("r"), whole.alias("text")))
    good = raw.select(*kept, F.inline(F.transform(F.filter(parsed(RECORD), lambda x: _broken(x).isNull()), _typed)))
    return good, raw.select(*kept, F.inline(F.filter(F.transform(parsed(RULED), _broken), lambda x: x.isNotNull())))


def _field(x: Column, path: str) -> Column:
    return reduce(lambda c, name: c[name], path.split("."), x["r"])


def _status(x: Column) -> Column:
    return F.coalesce(_field(x, "status"), F.lit("draft"))


def _level(x: Column, part: str) -> Column:
    return F.coalesce(_field(x, f"{part}.publishability"), F.lit(quality.LEVELS[0]))


def _broken(x: Column) -> Column:
    """code and detail of the first rule that a parsed record breaks, null if none."""
    r, status = (lambda path: _field(x, path)), _status(x)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        (x["r"].isNull(), "RECORD_UNREADABLE", F.left(x["text"], F.lit(80))), (blank(r("datasetVersionId")), "VERSION_ID_MISSING", F.lit(None)), (~status.isin(*STATES), "STATUS_UNKNOWN", status),
        (r("createdAt").try_cast("timestamp").isNull(), "CREATED_AT_INVALID", r("createdAt")), (r("publishedAt").isNotNull() & r("publishedAt").try_cast("timestamp").isNull(), "PUBLISHED_AT_INVALID", r("publishedAt")),
        ((status == "published") & r("publishedAt").isNull(), "PUBLISHED_AT_MISSING", F.lit(None)), (~_level(x, "validationSummary").isin(*quality.LEVELS) | ~_level(x, "reconciliationSummary").isin(*quality.LEVELS), "PUBLISHABILITY_UNKNOWN", F.lit(None)),
    ]
    return reduce(lambda rest, rule: F.when(rule[0], F.struct(F.lit(rule[1]).alias("code"), rule[2].cast("string").alias("detail"))).otherwise(rest), reversed(rules), F.lit(None).cast("struct<code:string,detail:string>"))


def _typed(x: Column) -> Column:
    """The typed fields of a parsed record that breaks no rule."""
    r = lambda path: _field(x, path)
    texts = lambda *names: {n: "" for n in names}
    repairs = defaulted(r("mappingSummary.topAliasRepairs"), texts("originalValue", "repairedValue", "normalizedValue", "canonicalId", "canonicalName") | {"count": 0})
    mapping = once(F.try_variant_get(x["v"], "$.mappingSummary", "variant"), lambda m: F.when(F.schema_of_variant(m).startswith("OBJECT"), mapping_summary(m).withField("repairs", repairs)))
    return F.struct(
        r("datasetVersionId").alias("version_id"), F.coalesce(r("ingestionRunId"), F.lit("")).alias("run_id"), _status(x).alias("status"), r("createdAt").try_cast("timestamp").alias("created_at"),
        r("publishedAt").try_cast("timestamp").alias("published_at"), F.coalesce(r("uploadedBy"), F.lit("")).alias("uploaded_by"), F.coalesce(r("datasetScope"), F.lit("")).alias("scope"), F.coalesce(r("fingerprint"), F.lit("")).alias("fingerprint"),
        defaulted(r("sourceFiles"), texts("sourceFileId", "originalFilename", "storedFilename", "sha256") | {"sizeBytes": 0} | texts("mimeType", "detectedSignature", "uploadedAt")).alias("files"),
        F.struct(*[r(f"businessPeriods.{p}.yearMonth").alias(p) for p in PARTS]).alias("periods"), mapping.alias("mapping"),
        F.struct(_level(x, "validationSummary").alias("publishability"), F.coalesce(r("validationSummary.issues"), F.array()).alias("issues")).alias("validation"),
        F.struct(_level(x, "reconciliationSummary").alias("publishability"), F.coalesce(r("reconciliationSummary.issues"), F.array()).alias("issues")).alias("reconciliation"))


def compact(mapping: Column, repairs: int = 5) -> Column:
    """A mapping summary with its first repairs only."""
    return mapping.withField("repairs", F.slice(mapping["repairs"], 1, repairs))


def emptied(summary: Column) -> Column:
    """A summary without its issues."""
    return summary.withField("issues", F.filter(summary["issues"], lambda _: F.lit(False)))


def empty_mapping() -> Column:
    nothing = F.try_parse_json(F.lit("{}"))
    return mapping_summary(nothing).withField("repairs", F.array().cast(f"array<{REPAIR}>"))


def run_items(records: DataFrame) -> DataFrame:
    """What the list of runs shows of typed records: the summaries of the run with its classification issues only, a compact mapping summary (an empty one if there is none), and the draft version with emptied summaries."""
    own = F.col("validation").withField("issues", F.filter("validation.issues", lambda x: x["code"] == CLASSIFICATION))
    draft = F.struct("version_id", "run_id", "status", "created_at", "published_at", "uploaded_by", "files", "periods", "scope", "fingerprint", F.when(F.col("mapping").isNotNull(), F.col("mapping")).alias("mapping"), emptied(F.col("validation")).alias("validation"), emptied(F.col("reconciliation")).alias("reconciliation"))
    published = F.when(F.col("status") == "published", F.col("version_id"))
    return records.select(
        "run_id", "created_at", "uploaded_by", F.when(F.col("status") == "published", "published").when(F.col("status") == "failed", "failed").otherwise("staged").alias("state"), published.alias("published_version_id"), "published_at", "files",
        compact(F.coalesce("mapping", empty_mapping())).alias("mapping"), own.alias("validation"), emptied(F.col("reconciliation")).alias("reconciliation"), draft.alias("draft"))


def text_quality(records: DataFrame, pointers: DataFrame) -> DataFrame:
    """For every scope of ``pointers`` (scope, pointer) the text quality that its status page shows, one row each:

    active: the version that the pointer names and its compact mapping summary, null if there is no such version or it has none; latest: the newest record of the scope (by creation, then run), with its
    state, merged publishability and compact mapping summary. ``records``: typed records with their ``scope``.
    """
    shown = F.struct("version_id", "published_at", compact(F.col("mapping")).alias("mapping"))
    named = records.filter("mapping IS NOT NULL").select(F.col("scope").alias("_scope"), F.col("version_id").alias("_version"), shown.alias("active"))
    last = F.struct("run_id", "created_at", "status", quality.worse(F.col("validation.publishability"), F.col("reconciliation.publishability")).alias("publishability"), compact(F.coalesce("mapping", empty_mapping())).alias("mapping"))
    newest = records.groupBy("scope").agg(F.max_by(last, F.struct("created_at", "run_id")).alias("latest"))
    active = pointers.join(named, (F.col("scope") == F.col("_scope")) & (F.col("pointer") == F.col("_version")), "left").select("scope", "pointer", "active")
    return active.join(newest, "scope", "left")
