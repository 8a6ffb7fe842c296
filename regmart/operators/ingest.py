"""Ingest runs: from uploaded files to staged facts, through the gates, for any number of runs at once.

A run is a set of files. Its files are screened, classified, scanned by role, checked by the source rules, resolved against the catalogs and reconciled with its control file. Three gates
stop a run at the first critical issue before its rows are read: the screening, the classification, and two files of one role. A stopped run has issues and nothing else; the runs
that pass go on together, so every stage is one job over all of them and each result names its run. The stages meet at stored tables.

Defined cases: a run without files has no row anywhere; a file without cells is of no role; a run whose sheet has a value that the schema does not take fails at the gate of
the rows, for its facts would not be whole; facts are stamped with the period of the first row of their file; null names are unresolved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regmart.functions import numbers, text
from regmart.functions.numbers import money
from regmart.operators import quality, reconcile, resolve
from regmart.sources import catalogs, roles, workbooks
from regmart.sources.shared import cut, once, stored

GATES = ("security-gate", "classification-gate", "duplicate-role-gate", "row-gate")
ISSUE = ("run", "stage", "code", "severity", "status", "scope", "detail")
# Texts of which a result statement shows one, the account that a balance must have, and the sheet that a control file should have.
MARKERS = ("UTILIDAD", "RESULTADO NETO", "INGRESOS FINANCIEROS", "GASTOS", "PRIMAS")
TOTAL_ASSETS, TOTAL_ASSETS_ID = "TOTAL ACTIVOS", "total-activos"
RANKING_SHEET = "Ranking del Sistema"


@dataclass
class Ingested:
    """runs: run, status (failed or staged), gate, validation, reconciliation and merged publishability, counts by severity. files: run, file, name, kind, signature. issues: ``ISSUE``.
    flow, balance, result: facts by run. reconciled: run, rule, severity, status, scope, expected, actual, differences. attempts: every resolution with its evidence."""

    runs: DataFrame
    files: DataFrame
    issues: DataFrame
    flow: DataFrame
    balance: DataFrame
    result: DataFrame
    reconciled: DataFrame
    attempts: DataFrame


def issue(rows: DataFrame, stage: str, code: Column | str, severity: str, status: str, scope: Column | str, detail: Column | None = None) -> DataFrame:
    """Rows of a run as issues."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("run", F.lit(stage).alias("stage"), lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(status).alias("status"), lit(scope).cast("string").alias("scope"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def stopped(issues: DataFrame, gate: str) -> DataFrame:
    """run and gate of the runs with a critical issue."""
    return issues.filter("severity = 'critical'").select("run").distinct().withColumn("gate", F.lit(gate))


def open_gates(files: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All runs, the files of those that pass all gates before the rows (run, file, name, kind, signature), issues, and the stopped runs. ``files`` has the archive statistics; ``classified``: file, kind, signature, candidates.

    The files of a run meet once: a run stops at the first gate at which one of its files fails.
    """
    screening = workbooks.screening(F.col("name"), F.col("mime"))
    critical = reduce(lambda x, y: x | y, [F.coalesce(cond, F.lit(False)) for cond, _, severity in screening if severity == "critical"])
    kinds = files.select("run", "file", "name", workbooks.faults(screening).alias("faults"), critical.alias("unsafe")).join(classified.select("file", "kind", "signature", "candidates"), "file", "left")
    of_run, of_kind = Window.partitionBy("run"), Window.partitionBy("run", "kind")
    kinds = kinds.withColumn("twice", F.col("kind").isNotNull() & (F.count("*").over(of_kind) > 1))
    fails = (F.col("unsafe"), F.col("kind").isNull(), F.col("twice"))
    gate = F.coalesce(*[F.when(F.max(fail).over(of_run), name) for name, fail in zip(GATES, fails)])
    kinds = stored(kinds.withColumn("gate", gate))
    found = kinds.select("run", "name", F.inline("faults"))
    screened = found.select("run", F.lit(GATES[0]).alias("stage"), "code", "severity", F.when(F.col("severity") == "critical", "failed").otherwise("warning").alias("status"), F.col("name").alias("scope"), F.lit(None).cast("string").alias("detail"))
    unknown = issue(kinds.filter((F.col("gate") == GATES[1]) & F.col("kind").isNull()), GATES[1], "WORKBOOK_SCHEMA_UNRECOGNIZED", "critical", "failed", F.col("name"), F.array_join("candidates", ", "))
    doubled = kinds.filter((F.col("gate") == GATES[2]) & F.col("twice")).groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))  # at most four kinds
    doubled = issue(doubled, GATES[2], "WORKBOOK_ROLE_DUPLICATED", "critical", "failed", "ingestion", F.col("kinds"))
    passed = kinds.filter("gate IS NULL").select("run", "file", "name", "kind", "signature")
    return kinds.select("run").distinct(), passed, union([screened, unknown, doubled]), kinds.filter("gate IS NOT NULL").select("run", "gate").distinct()


def unfit(found: DataFrame, role: roles.Role) -> DataFrame:
    """Issues of the values that the schema of the role does not take; ``found`` has the rows of all roles under their columns."""
    own = ("run", "source_row")
    wrong = workbooks.conform(found.filter(F.col("kind") == role.kind).select(*own, *role.columns), roles.schema(role), own)[1]
    return issue(wrong, GATES[3], "WORKBOOK_ROW_INVALID", "critical", "failed", F.concat(F.lit(f"{role.kind}:row:"), F.col("source_row").cast("string")), F.concat_ws(": ", "column", "value"))


def fit(found: DataFrame, role: roles.Role) -> DataFrame:
    """Rows of a role, all of which its schema takes, with the period of the first row of their file, as ``period`` (first day) and ``year_month``."""
    texts = {c: F.trim(c) for c in (*role.columns, "first_date")}
    first = F.col("first_date")
    day = F.coalesce(F.to_date(first.substr(1, 10)), F.when(first.try_cast("double").isNotNull(), numbers.serial_to_date(first.try_cast("double"))))
    rows = found.filter(F.col("kind") == role.kind).select("run", "file", "source_row", *[v.alias(c) for c, v in texts.items()])
    return rows.withColumns({"period": F.trunc(day, "month"), "year_month": F.date_format(day, "yyyy-MM")})


def presence_rules(runs: DataFrame, flow: DataFrame, balance: DataFrame, result: DataFrame, control: DataFrame, run: str = "run", period: str = "period") -> DataFrame:
    """run, code, severity, status, scope of the presence and period rules, for every run of ``runs``.

    The sources are aggregated together, by run; a run without rows of a source has none in the aggregate, so the grid of all runs is joined with it.
    """
    names = ("f", "b", "r", "c")
    parts = [df.select(run, F.lit(n).alias("source"), (F.coalesce(F.col(period).cast("string"), F.lit("")) if period in df.columns else F.lit(None).cast("string")).alias("p")) for n, df in zip(names, (flow, balance, result, control))]
    of = lambda n: F.col("source") == n
    sums = union(parts).groupBy(run, "source", "p").agg(F.count("*").alias("n")).groupBy(run).agg(*[F.sum(F.when(of(n), F.col("n"))).alias(f"{n}_n") for n in names], *[F.count_if(of(n) & F.col("p").isNotNull()).alias(f"{n}_p") for n in names])
    return presence_issues(runs, sums, run)


def presence_issues(runs: DataFrame, sums: DataFrame, run: str = "run") -> DataFrame:
    """``presence_rules`` from the rows (``f_n``, ``b_n``, ``r_n``, ``c_n``) and distinct periods (``f_p``, ``b_p``, ``r_p``) of each run that has any."""
    row = runs.select(run).distinct().join(sums, run, "left")
    row = row.na.fill(0, [c for c in sums.columns if c != run])
    c = F.col
    rules = [
        ((c("f_n") == 0) & (c("b_n") == 0), "NO_PRIMARY_SOURCE_PROVIDED", "critical", "failed", "ingestion"), (c("f_n") == 0, "PREMIUM_SOURCE_NOT_PROVIDED", "medium", "warning", "premiums"),
        (c("b_n") == 0, "FINANCIAL_SOURCE_NOT_PROVIDED", "medium", "warning", "financialPosition"), (c("r_n") == 0, "INCOME_STATEMENT_SOURCE_NOT_PROVIDED", "low", "warning", "incomeStatement"),
        (c("r_n") > 0, "INCOME_STATEMENT_DETECTED_NON_OPERATIONAL", "low", "warning", "incomeStatement"), (c("f_p") > 1, "PREMIUM_MULTIPLE_PERIODS", "high", "failed", "premiums"),
        (c("b_p") > 1, "FINANCIAL_MULTIPLE_PERIODS", "high", "failed", "financialPosition"), (c("r_p") > 1, "INCOME_STATEMENT_MULTIPLE_PERIODS", "high", "failed", "incomeStatement"),
        (c("c_n") == 0, "REFERENCE_WORKBOOK_NOT_PROVIDED", "low", "warning", "reference"),
    ]
    fields = ("code", "severity", "status", "scope")
    listed = F.array(*[F.when(cond, F.struct(*[F.lit(x).alias(n) for n, x in zip(fields, values)])) for cond, *values in rules])
    return row.select(run, F.inline(F.array_compact(listed)))


def content_rules(rows: DataFrame, flow: DataFrame, sheets: DataFrame, runs: DataFrame) -> DataFrame:
    """Issues of what the rows hold: sources that are missing or of several periods (``presence_rules``), natural keys that repeat, a balance without total assets, a result statement without its texts, a control file without its ranking.

    rows: run, kind, report_date, first_date (of the first row of the file) and account of all roles, a file a run and role; they are aggregated once, by run and role. sheets: those of the control files. Rows of one natural key meet once.
    """
    held = rows.select("run", "kind", (F.coalesce("report_date", F.lit("")) != F.coalesce("first_date", F.lit(""))).alias("other"), F.coalesce("account", F.lit("")).alias("account"))
    held = once(held, "account", name=text.normalize_text(F.col("account")))
    name = F.col("name")
    shows = reduce(lambda a, b: a | b, [name.contains(m) for m in MARKERS])
    ranking = sheets.groupBy("run").agg(F.max(F.col("sheet") == RANKING_SHEET).alias("found"))
    own = held.groupBy("run", "kind").agg(F.count("*").alias("n"), F.max("other").alias("other"), F.max(name == TOTAL_ASSETS).alias("assets"), F.max(shows).alias("shows"))
    own = own.unionByName(ranking.select("run", F.lit(roles.CONTROL_KIND).alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("other"), "found"), allowMissingColumns=True)
    of = {n: F.col("kind") == kind for n, kind in (("f", "premiums"), ("b", "financialPosition"), ("r", "incomeStatement"), ("c", roles.CONTROL_KIND))}
    counts = [F.sum(F.when(o, F.col("n"))).alias(f"{n}_n") for n, o in of.items()] + [F.max(F.when(o, F.when(F.col("other"), 2).otherwise(1))).alias(f"{n}_p") for n, o in of.items()]
    lacks = {"assets": of["b"] & ~F.col("assets"), "shows": of["r"] & ~F.col("shows"), "found": of["c"] & ~F.col("found")}
    sums = stored(own.groupBy("run").agg(*counts, *[F.max(F.coalesce(v, F.lit(False))).alias(k) for k, v in lacks.items()]))
    rules = presence_issues(runs, sums.drop(*lacks))
    return union([
        rules.select("run", F.lit("rules").alias("stage"), "code", "severity", "status", "scope", F.lit(None).cast("string").alias("detail")),
        issue(repeated(flow), "rules", "PREMIUM_DUPLICATE_NATURAL_KEY", "critical", "failed", F.concat(F.lit("premiums:row:"), F.col("source_row").cast("string"))),
        issue(sums.filter("assets"), "rules", "FINANCIAL_TOTAL_ASSETS_MISSING", "critical", "failed", "financialPosition"),
        issue(sums.filter("shows"), "rules", "INCOME_STATEMENT_MARKERS_MISSING", "high", "failed", "incomeStatement"),
        issue(sums.filter("found"), "rules", "REFERENCE_RANKING_MISSING", "medium", "warning", "reference"),
    ])


def repeated(flow: DataFrame) -> DataFrame:
    """run and source_row of the rows whose natural key an earlier row of the run has. Plain keys are not sent to Python."""
    key = F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("")) for c in ("report_date", "entity_code", "entity_name", "parent", "category", "currency_code", "currency")])
    keyed, plain = flow.select("run", "source_row", F.inline(F.array(F.struct(key.alias("key"))))), text.is_plain(F.col("key"), "\x01")  # inline: a filter does not make the key again
    joined = F.regexp_replace(text.normalize_text(F.col("key")), "\\s*\x01\\s*", "\x01")  # the parts are normalized in one go
    parts = [keyed.filter(plain).withColumn("key", F.upper("key")), keyed.filter(~plain).withColumn("key", joined)]
    named = union(parts).select("run", "source_row", F.md5(F.col("key").cast("binary")).alias("digest"))
    first = F.min("source_row").over(Window.partitionBy("run", "digest"))
    return named.withColumn("first", first).filter(F.col("source_row") > F.col("first"))


#: What is tried to be resolved in a row of a kind: column, domain, context of the issues, name of the target.
REFERENCES = {
    "premiums": (("entity_name", "institution", "INSTITUTION", "entity"), ("parent", "insuranceLine", "INSURANCE_LINE", "parent_id"), ("category", "insuranceLine", "INSURANCE_LINE", "category_id")),
    "financialPosition": (("entity_name", "institution", "FINANCIAL_INSTITUTION", "entity"), ("account", "financialAccount", "FINANCIAL_ACCOUNT", "account_id")),
    "incomeStatement": (("entity_name", "institution", "INCOME_STATEMENT_INSTITUTION", "entity"),),
}
#: Short names of the columns in scopes.
SCOPES = {"entity_name": "institution", "parent": "ramoParent", "category": "ramo", "account": "account"}


KEYS = ["domain", "raw", "line_key"]
#: Texts of a resolution that are broadcast, however often each stands in the rows.
FEW = 10_000


def _asked(column: str) -> list[Column]:
    """raw, line and line_key of a reference: what is resolved in the column."""
    line = (numbers.line_number_value(F.col("line")) if column == "account" else F.lit(None)).cast("double")
    return [F.coalesce(F.col(column), F.lit("")).alias("raw"), line.alias("line"), F.coalesce(line.cast("string"), F.lit("")).alias("line_key")]


def tried(rows: dict[str, DataFrame]) -> DataFrame:
    """Every attempt to resolve a name: kind, run, source_row, column, domain, context, raw, line, line_key."""
    return union([
        df.select(F.lit(kind).alias("kind"), "run", "source_row", F.lit(column).alias("column"), F.lit(domain).alias("domain"), F.lit(context).alias("context"), *_asked(column))
        for kind, df in rows.items() for column, domain, context, _ in REFERENCES[kind]])


def resolutions(every: DataFrame) -> DataFrame:
    """``KEYS`` and ``resolve.EVIDENCE`` of the distinct texts of all attempts, each resolved once in its domain. Stored."""
    spark = every.sparkSession
    asked = stored(every.select(*KEYS, "line").distinct())
    of = lambda domain: asked.filter(F.col("domain") == domain)
    found = [resolve.evidence(of(domain).join(stored(resolver(of(domain))), "raw"), catalog) for domain, resolver, catalog in (("institution", catalogs.resolve_entities, catalogs.entities(spark)), ("insuranceLine", catalogs.resolve_categories, catalogs.categories(spark)))]
    accounts, catalog = of("financialAccount"), catalogs.accounts(spark)
    found.append(resolve.evidence(resolve.resolve_with_lines(accounts, stored(catalogs.resolve_accounts(accounts)), catalog, text.normalize_alias), catalog))
    return stored(union(found).drop("line"))


def attempted(rows: dict[str, DataFrame], found: DataFrame | None = None) -> DataFrame:
    """Every attempt to resolve a name, with its evidence: kind, run, source_row, column, domain, context, raw, line and ``resolve.EVIDENCE``. Texts of all kinds are resolved once in each domain; ``found``: their resolutions, if they are known."""
    every = tried(rows)
    return with_resolutions(every, resolutions(every) if found is None else found, KEYS).drop("line_key")


def with_resolutions(every: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``every`` with the columns that ``found`` (stored) has for its keys: few texts are broadcast, of many the common ones."""
    return every.join(F.broadcast(found), keys) if found.count() <= FEW else with_common(every, found, keys)


def with_common(every: DataFrame, found: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """``every`` with the columns that ``found`` has for its keys. Keys of more than one row in ``most`` would each fill one task of a shuffle; there are fewer than ``most`` of them, so they are broadcast, the others shuffled."""
    common = stored(every.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") * most > every.count()).select(*keys))
    one = F.broadcast(common)
    often = every.join(F.broadcast(found.join(one, keys, "left_semi")), keys)
    return often.unionByName(every.join(one, keys, "left_anti").join(found, keys))


def alias_issues(attempts: DataFrame) -> DataFrame:
    """An issue for every attempt without a target, its evidence as JSON."""
    missing = attempts.filter("target IS NULL")
    short = reduce(lambda rest, x: F.when(F.col("column") == x[0], x[1]).otherwise(rest), SCOPES.items(), F.col("column"))
    names = ("raw", "repaired", "normalized", "candidate_ids", "candidate_names", "strategy", "reason", "mojibake", "required")
    return missing.select(
        "run", F.lit("resolution").alias("stage"), F.concat("context", F.lit("_ALIAS_"), F.upper("strategy")).alias("code"), F.lit("high").alias("severity"), F.lit("failed").alias("status"),
        F.concat_ws(":", "kind", F.lit("row"), F.col("source_row").cast("string"), short).alias("scope"), F.to_json(F.struct(*names, "line")).alias("detail"))


def facts(rows: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """Rows of which every reference is resolved, with the targets; a row meets the resolutions (``KEYS``, target) where it is."""
    for column, domain, _, name in REFERENCES[kind]:
        known = found.filter((F.col("domain") == domain) & F.col("target").isNotNull()).select("raw", "line_key", F.col("target").alias(name))
        rows = with_resolutions(rows.withColumns({c: v for c, v in zip(("raw", "_", "line_key"), _asked(column))}).drop("_"), known, ["raw", "line_key"]).drop("raw", "line_key")
    return rows


def reconciled(runs: DataFrame, flow: DataFrame, balance: DataFrame, control: DataFrame, stated: DataFrame, names: DataFrame, tolerance: float = 0.001, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Reconciliation of every run: run, rule, severity, status, scope, expected, actual, absolute and relative difference.

    flow: run, entity, amount, year_month; balance: run, entity, account_id, combined, source_row, year_month; control: run, measure, key, expected; stated: run and year_month (null if none is stated) of
    the runs with a control file; names: entity and the name that controls know it by. A run without a control file has one row and nothing else; one without facts has none.
    The facts of a source are aggregated once, by run, entity and period; ``keep`` may store these sums.
    """
    values = lambda expected, actual: [F.lit(expected).cast("double").alias("expected") if expected is None else expected, F.lit(actual).cast("double").alias("actual") if actual is None else actual]
    columns = lambda rule, severity, status, scope: [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(status).alias("status"), scope.alias("scope")]
    nothing = [*values(None, None), F.lit(None).cast("double").alias("absolute_difference"), F.lit(None).cast("double").alias("relative_difference")]
    without = runs.join(stated, "run", "left_anti").select("run", *columns("REFERENCE_NOT_PROVIDED", "low", "warning", F.lit("reference")), *nothing)
    by, asset = ("run", "entity", "year_month"), F.col("account_id") == TOTAL_ASSETS_ID
    flow = keep(flow.groupBy(*by).agg(money(F.col("amount")).alias("exact")))
    balance = keep(balance.groupBy(*by).agg(F.max_by(F.when(asset, F.col("combined")), F.when(asset, F.col("source_row"))).alias("combined"), F.max(F.when(asset, F.col("source_row"))).alias("source_row")))
    of = lambda df: df.select("run", "year_month").distinct().groupBy("run").agg(F.min("year_month").alias("own"))  # noqa: E731 - one period a run and source
    periods = stated.join(of(flow), "run").filter((F.col("own") != F.col("year_month")))
    differ = periods.select("run", *columns("PERIOD_MISMATCH_PREMIUM_REFERENCE", "medium", "warning", F.lit("premiums")), *nothing)
    parts = [without, differ]
    key = names.select("entity", text.normalize_text(F.col("name")).alias("key"))
    sums = flow.groupBy("run", "entity").agg(F.sum("exact").cast("double").alias("actual"))
    last = balance.filter("source_row IS NOT NULL").groupBy("run", "entity").agg(F.max_by("combined", "source_row").alias("actual"))
    for scope, measure, rule, missing, actual, source in (("premiums", "flow", "PREMIUM_TOTAL_BY_INSTITUTION", "REFERENCE_PREMIUM_INSTITUTION_MISSING", sums, flow), ("financialPosition", "balance", "ASSETS_TOTAL_BY_INSTITUTION", None, last, balance)):
        told = actual.join(F.broadcast(key), "entity").join(stated.join(of(source), "run").select("run", (F.col("own") == F.col("year_month")).alias("same")), "run")  # a fixed catalog of names
        told = told.join(control.filter(F.col("measure") == measure).select("run", "key", "expected"), ["run", "key"], "left" if missing else "inner")
        checked = reconcile.compared(told, rule, missing, tolerance, F.coalesce("same", F.lit(False)))
        parts.append(checked.select("run", "rule", "severity", "status", F.concat_ws(":", F.lit(scope), "entity").alias("scope"), "expected", "actual", "absolute_difference", "relative_difference"))
    return union(parts)


def ingest(files: DataFrame, table: DataFrame) -> Ingested:
    """Ingests all runs of ``files`` (run, file, name, mime, and the archive statistics of ``workbooks``) from the rows of their sheets ``table`` (``workbooks.gathered``), which is read more than once.

    Rows are stored under the columns of their role; what the stages tell of runs and files are small tables beside them. Facts and attempts are read from the stored rows when they are asked for.
    """
    spark = files.sparkSession
    sheets = stored(table.select("file", "sheet_index", "sheet").distinct())
    names = stored(sheets.select("sheet").distinct().withColumn("name", text.normalize_text(F.col("sheet"))))
    heads = roles.first_rows(table)
    chosen = roles.sheet_of_role(table, heads, names)
    all_runs, passed, gate_issues, gone = open_gates(files, roles.file_kinds(table, sheets, names, heads, chosen))
    own = passed.join(chosen.select("file", "kind", "sheet_index", "head"), ["file", "kind"]).select("run", "file", "kind", "sheet_index", "head")
    found = stored(roles.placed(table, own, heads))
    wrong = stored(union([unfit(found, role) for role in roles.ROLES]))
    late = stored(stopped(wrong, GATES[3]))
    gone = gone.unionByName(late)
    live = stored(passed.join(late, "run", "left_anti"))
    whole = found.join(late, "run", "left_anti")  # a run with a row that the schema does not take is out, so all rows are fit
    rows = {role.kind: fit(whole, role) for role in roles.ROLES}
    control_files = live.filter(F.col("kind") == roles.CONTROL_KIND).select("run", "file")
    control_cells = stored(table.filter(F.col("sheet").isin(*roles.CONTROL_READ)).select("file", "sheet", "row", F.inline("cells")).join(control_files, "file"))
    control = stored(roles.control(control_cells.drop("run"), spark).join(control_files, "file").select("run", "measure", "key", "expected"))
    stated = control_files.join(roles.period_label(control_cells.drop("run")), "file", "left").select("run", F.date_format("period_start", "yyyy-MM").alias("year_month"))
    flow, balance, result = rows["premiums"], rows["financialPosition"], rows["incomeStatement"]
    held = content_rules(whole.select("run", "kind", *[F.trim(c).alias(c) for c in ("report_date", "first_date", "account")]), flow, control_files.join(sheets, "file", "left").select("run", "sheet"), live)
    resolved = resolutions(tried(rows))
    attempts = attempted(rows, resolved)
    issues = stored(union([gate_issues, wrong, held, alias_issues(attempts)]))
    amount = lambda c: F.coalesce(numbers.number_value(F.coalesce(F.col(c), F.lit(""))), F.lit(0.0))
    keys = ("run", "file", "source_row", "period", "year_month", "entity")
    flow_facts = facts(flow, resolved, "premiums").select(*keys, "parent_id", "category_id", F.col("currency_code").alias("currency"), amount("amount").alias("amount"))
    statement = [amount("national").alias("national"), amount("foreign").alias("foreign"), (amount("national") + amount("foreign")).alias("combined")]
    balance_facts = facts(balance, resolved, "financialPosition").select(*keys, "account_id", *statement)
    result_facts = facts(result, resolved, "incomeStatement").select(*keys, "account", *statement)
    known = catalogs.entities(spark).select(F.col("target").alias("entity"), F.col("canonical").alias("name"))
    checked = stored(reconciled(live.select("run").distinct(), flow_facts, balance_facts, control, stated, known, keep=stored))
    return Ingested(summary(all_runs, gone, issues, checked), live, issues, flow_facts, balance_facts, result_facts, checked, attempts)


def summary(runs: DataFrame, gone: DataFrame, issues: DataFrame, checked: DataFrame) -> DataFrame:
    """run, status, gate, validation, reconciliation, publishability, critical, high, medium, low for every run; a stopped run is blocked."""
    first = F.min_by("gate", F.array_position(F.array(*map(F.lit, GATES)), F.col("gate"))).alias("gate")
    counts = issues.groupBy("run").agg(quality.publishability(F.col("severity")).alias("validation"), *[F.count_if(F.col("severity") == s).alias(s) for s in quality.SEVERITIES])
    control = checked.groupBy("run").agg(quality.publishability(F.col("severity"), strict=False).alias("reconciliation"))
    out = runs.join(gone.groupBy("run").agg(first), "run", "left").join(counts, "run", "left").join(control, "run", "left").na.fill(0, [*quality.SEVERITIES])
    level = lambda c: F.coalesce(c, F.lit(quality.LEVELS[0]))
    validation = F.when(F.col("gate").isNotNull(), quality.LEVELS[2]).otherwise(level("validation"))
    out = out.withColumns({"validation": validation, "reconciliation": level("reconciliation"), "status": F.when(F.col("gate").isNotNull(), "failed").otherwise("staged")})
    return out.select("run", "status", "gate", "validation", "reconciliation", quality.worse(F.col("validation"), F.col("reconciliation")).alias("publishability"), *quality.SEVERITIES)


def ingest_files(files: DataFrame) -> Ingested:
    """Ingests uploads: ``files`` has run, file, name, mime, size and content."""
    files = cut(files)
    stats = workbooks.archive_stats(files).join(files.select("run", "file", "name", "mime"), "file")
    return ingest(stats, stored(workbooks.gathered(workbooks.cells(files))))
