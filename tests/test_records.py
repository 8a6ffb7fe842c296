"""Records of several shapes, list items and the text quality of a status page."""

import json

import pytest

from regmart.sources import records

AT = "2026-01-02T03:04:05Z"
FULL = {
    "datasetVersionId": "v1", "ingestionRunId": "r1", "status": "published", "createdAt": AT, "publishedAt": AT, "uploadedBy": "ann", "datasetScope": "premiums-only", "fingerprint": "f",
    "sourceFiles": [{"sourceFileId": "s", "kind": "premiums", "sizeBytes": 5}, {}], "businessPeriods": {"premiums": {"yearMonth": "2025-12"}},
    "mappingSummary": {"fallbackByLineNumber": 3, "lineNumberFallback": 9, "unresolved": 4, "totalAttempts": "7", "aliasesMatched": 2.0, "textQuality": {"ambiguousAliases": 1}, "domains": {"institution": {"totalAttempts": 6, "unresolved": 2}},
                       "topAliasRepairs": [{"domain": "institution", "count": i} for i in range(7)] + [{"domain": "x"}]},
    "validationSummary": {"publishability": "warningOnly", "issues": [{"code": "WORKBOOK_SCHEMA_UNRECOGNIZED", "severity": "critical"}, {"code": "OTHER"}]},
    "reconciliationSummary": {"publishability": "publishable", "issues": [{"ruleId": "R", "expectedValue": 1.5}]},
}
OLD = {"datasetVersionId": "v2", "ingestionRunId": "r2", "createdAt": "2026-01-03T00:00:00Z", "mappingSummary": {"lineNumberFallback": 5, "unresolvedAliases": 1, "ambiguousAliases": 2}}
OLDEST = {"datasetVersionId": "v3", "createdAt": "2026-01-01", "unknown": [1]}


def rows(spark, *made):
    return spark.createDataFrame([(i, x if isinstance(x, str | None) else json.dumps(x)) for i, x in enumerate(made)], "id long, record string")


@pytest.fixture(scope="module")
def good(spark):
    return {r.version_id: r for r in records.versions(rows(spark, FULL, OLD, OLDEST))[0].collect()}


def test_shapes(good):
    one, old, oldest = (good[v] for v in ("v1", "v2", "v3"))
    assert one.mapping.counters.asDict() == {"repaired": 0, "matched": 2, "by_line": 3, "ambiguous": 0, "unresolved": 4, "total": 0}
    assert one.mapping.text_quality.asDict() == {"mojibake": 0, "after_normalization": 0, "by_alias": 0, "by_line": 9, "ambiguous": 1, "unresolved": 4}
    assert [(d.domain, d.counters.total, d.counters.unresolved) for d in one.mapping.domains] == [("institution", 6, 2), ("insuranceLine", 0, 0), ("financialAccount", 0, 0)]
    assert [(f.sourceFileId, f.kind, f.sizeBytes, f.sha256) for f in one["files"]] == [("s", "premiums", 5, ""), ("", None, 0, "")]
    assert one.periods.premiums == "2025-12" and one.periods.reference is None and len(one.mapping.repairs) == 8 and one.mapping.repairs[7]["count"] == 0
    assert old.status == "draft" and old.published_at is None and old.mapping.counters.by_line == 5 and old.mapping.text_quality.by_line == 5 and old.mapping.text_quality.unresolved == 1
    assert old.validation.publishability == "publishable" and old.validation.issues == [] and old["files"] == []
    assert oldest.mapping is None and oldest.run_id == "" and oldest.uploaded_by == ""


def test_broken_records(spark):
    broken = [None, "", "not json", "[1]", {**OLD, "datasetVersionId": " "}, {**OLD, "status": "odd"}, {**OLD, "createdAt": "soon"}, {**OLD, "publishedAt": "x"}, {**OLD, "status": "published"}, {**OLD, "validationSummary": {"publishability": "maybe"}}]
    good, bad = records.versions(rows(spark, *broken, OLD))
    codes = {r.id: r.code for r in bad.collect()}
    assert codes == dict(enumerate(["RECORD_UNREADABLE"] * 4 + ["VERSION_ID_MISSING", "STATUS_UNKNOWN", "CREATED_AT_INVALID", "PUBLISHED_AT_INVALID", "PUBLISHED_AT_MISSING", "PUBLISHABILITY_UNKNOWN"]))
    assert [r.id for r in good.collect()] == [len(broken)]


@pytest.mark.parametrize("part", [0, 1])
def test_each_record_is_parsed_once(spark, part):
    made = records.versions(rows(spark, FULL, OLD))[part]
    if part == 0:
        made = made.filter("mapping IS NOT NULL").select("version_id", "status", "mapping.counters.total", "mapping.text_quality.unresolved", "validation.publishability")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("parseJson") + plan.count("parse_json(") == 1


def test_run_items(spark):
    items = {r.run_id: r for r in records.run_items(records.versions(rows(spark, FULL, OLD, OLDEST))[0]).collect()}
    one = items["r1"]
    assert (one.state, one.published_version_id, len(one.mapping.repairs)) == ("published", "v1", 5)
    assert [i.code for i in one.validation.issues] == ["WORKBOOK_SCHEMA_UNRECOGNIZED"] and one.validation.publishability == "warningOnly"
    assert one.reconciliation.issues == [] and one.draft.validation.issues == [] and one.draft.reconciliation.issues == [] and len(one.draft.mapping.repairs) == 8
    assert items[""].mapping.counters.total == 0 and items[""].mapping.repairs == [] and items[""].draft.mapping is None and items["r2"].published_version_id is None


def test_text_quality(spark):
    good = records.versions(rows(spark, FULL, {**OLD, "datasetScope": "premiums-only", "validationSummary": {"publishability": "blocked"}}, OLDEST))[0]
    pointers = spark.createDataFrame([("premiums-only", "v1"), ("", "v3"), ("nowhere", "v1"), ("none", None)], "scope string, pointer string")
    got = {r.scope: r for r in records.text_quality(good, pointers).collect()}
    one = got["premiums-only"]
    assert one.active.version_id == "v1" and one.active.mapping.counters.matched == 2 and len(one.active.mapping.repairs) == 5
    assert (one.latest.run_id, one.latest.publishability, one.latest.mapping.counters.by_line) == ("r2", "blocked", 5)
    assert got[""].active is None and got[""].latest.run_id == "" and got["nowhere"].active is None and got["nowhere"].latest is None and got["none"].active is None
