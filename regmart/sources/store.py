"""Versioned store as Parquet tables under one root: immutable artifacts by version, and append-only runs, versions, pointers and audit events.

A pointer is the newest row of its table, so that a change is one appended row and readers never see a half-written file.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "run_id string, status string, created_at timestamp, updated_at timestamp, detail string"
VERSIONS = "version_id string, run_id string, status string, created_at timestamp, published_at timestamp, publishability string"
POINTERS = "pointer string, at timestamp, stamp string"
MANIFESTS = "version_id string, artifact string, published_at timestamp"
ISSUES = "run_id string, code string, severity string, detail string"
# States of a version.
STATES = ("draft", "staged", "published", "failed", "rolledBack")
FILES = "run_id string, stored_name string, sha256 string, size long, uploaded_at timestamp, path string"
AUDIT = "audit_key string, action string, actor string, at timestamp, detail string"


class PublishBlocked(Exception):
    """The run's merged publishability forbids publishing."""


class BadVersion(Exception):
    """A stored version breaks the rules of its record."""


def repaired_pointers(pointers: DataFrame, versions: DataFrame) -> DataFrame:
    """The rows with their ``pointer`` if it is one of ``versions.version_id``, else the greatest version id (null without any)."""
    known = versions.select("version_id").distinct()
    last = F.broadcast(versions.agg(F.max("version_id").alias("_last")))  # one row
    found = pointers.join(known, F.col("pointer") == F.col("version_id"), "left").crossJoin(last)
    return found.withColumn("pointer", F.coalesce("version_id", "_last")).drop("version_id", "_last")


def area_counts(areas: dict[str, DataFrame]) -> DataFrame:
    """area and its number of rows, empty areas included."""
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("area"), "n") for name, rows in areas.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        """Rows of a table; one never written is empty."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*(f.split()[0] for f in schema.split(", ")))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, *row) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    # Runs and audit

    def write_run(self, run_id: str, status: str, detail: str | None = None, created_at: datetime | None = None) -> None:
        now = datetime.now(timezone.utc)
        self._append("runs", RUNS, run_id, status, created_at or now, now, detail)

    def register(self, batch: DataFrame, number: int) -> None:
        """Registers a numbered batch of received files (``FILES``) and their runs; the same number again takes the place of what it wrote before."""
        rows = batch.select(*(f.split()[0] for f in FILES.split(", "))).persist()
        try:
            if rows.isEmpty():
                return
            rows.coalesce(8).write.mode("overwrite").parquet(f"{self.root}/files/batch={number}")
            runs = rows.groupBy("run_id").agg(F.min("uploaded_at").alias("created_at"))
            received = runs.select("run_id", F.lit("received").alias("status"), "created_at", F.col("created_at").alias("updated_at"), F.lit(None).cast("string").alias("detail"))
            received.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/received/batch={number}")
        finally:
            rows.unpersist()

    def files(self, run_id: str | None = None) -> DataFrame:
        """Registered files, of one run or of all."""
        rows = self.table("files", FILES)
        return rows if run_id is None else rows.filter(F.col("run_id") == run_id)

    def runs(self) -> DataFrame:
        """The latest row of each run, newest first; a run that was only received has that status, whenever its files came."""
        newest = Window.partitionBy("run_id").orderBy(F.col("status") == "received", F.desc("updated_at"))
        return self.table("runs", RUNS).unionByName(self.table("received", RUNS)).withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n").orderBy(F.desc("created_at"), "run_id")

    def fail_run(self, run_id: str, actor: str, issues: DataFrame, reason: str) -> str:
        """Records a run that ended before its rows were read: its issues (code, severity, detail), a failed version without artifacts, and the run itself; the active version stays."""
        version, now = f"failed-{uuid.uuid4().hex[:8]}", datetime.now(timezone.utc)
        issues.select(F.lit(run_id).alias("run_id"), "code", "severity", F.col("detail").cast("string").alias("detail")).write.mode("append").parquet(f"{self.root}/issues")
        self._append("versions", VERSIONS, version, run_id, "failed", now, None, "blocked")
        self.write_run(run_id, "failed", reason)
        self.audit("VALIDATION_FAILED", actor, run_id)
        return version

    def record(self, done, actor: str) -> None:
        """Records all runs of an ``ingest.Ingested`` with one append a table: the facts of the staged ones first, then issues, a staged or failed version of each run, audit events, and last the runs themselves. The active version stays."""
        now = datetime.now(timezone.utc)
        for name, rows in (("flow", done.flow), ("balance", done.balance), ("reconciliation", done.reconciled)):
            rows.write.mode("append").parquet(f"{self.root}/staging/{name}")
        done.issues.select(F.col("run").alias("run_id"), "code", "severity", F.coalesce("detail", "scope").alias("detail")).write.mode("append").parquet(f"{self.root}/issues")
        failed, at = F.col("status") == "failed", F.lit(now).cast("timestamp")
        version = F.concat(F.when(failed, "failed-").otherwise(f"dataset-{now.strftime('%Y-%m-%dT%H-%M-%S')}-"), F.substring(F.sha2(F.concat_ws("/", F.lit(uuid.uuid4().hex), "run"), 256), 1, 8))
        runs = done.runs
        append = lambda name, rows: rows.write.mode("append").parquet(f"{self.root}/{name}")
        append("versions", runs.select(version.alias("version_id"), F.col("run").alias("run_id"), "status", at.alias("created_at"), F.lit(None).cast("timestamp").alias("published_at"), "publishability"))
        key = F.concat_ws("-", F.lit(now.isoformat().replace(":", "-")), F.substring(F.sha2(F.concat_ws("/", F.lit(uuid.uuid4().hex), "run"), 256), 1, 8))
        append("audit", runs.select(key.alias("audit_key"), F.when(failed, "VALIDATION_FAILED").otherwise("INGESTION_STAGED").alias("action"), F.lit(actor).alias("actor"), at.alias("at"), F.col("run").alias("detail")))
        append("runs", runs.select(F.col("run").alias("run_id"), "status", at.alias("created_at"), at.alias("updated_at"), F.coalesce("gate", "publishability").alias("detail")))

    def publish_run(self, run_id: str, actor: str) -> str:
        """Publishes a staged run from its staged facts; one that failed or is blocked raises PublishBlocked, an unknown one KeyError."""
        run = self.runs().filter(F.col("run_id") == run_id).first()
        if run is None:
            raise KeyError(run_id)
        draft = self.versions().filter((F.col("run_id") == run_id) & F.col("status").isin("staged", "failed")).first()
        if run.status == "failed" or draft is None:
            raise PublishBlocked(run_id)
        staged = {name: self.spark.read.parquet(f"{self.root}/staging/{name}").filter(F.col("run") == run_id) for name in ("flow", "balance", "reconciliation")}
        return self.publish(run_id, actor, staged, draft.publishability, draft.version_id)

    def issues(self, run_id: str) -> DataFrame:
        return self.table("issues", ISSUES).filter(F.col("run_id") == run_id)

    def audit(self, action: str, actor: str, detail: str | None = None) -> None:
        now = datetime.now(timezone.utc)
        self._append("audit", AUDIT, f"{now.isoformat().replace(':', '-')}-{uuid.uuid4().hex[:8]}", action, actor, now, detail)

    def audit_events(self) -> DataFrame:
        return self.table("audit", AUDIT).orderBy(F.desc("at"), "audit_key")

    # Versions

    def versions(self) -> DataFrame:
        """The latest row of each version, newest first; rows without an id are skipped, an absent status is a draft."""
        newest = Window.partitionBy("version_id").orderBy(F.desc_nulls_last("published_at"), F.desc("created_at"))
        rows = self.table("versions", VERSIONS).filter("version_id is not null").withColumn("n", F.row_number().over(newest)).filter("n = 1").drop("n")
        return rows.withColumn("status", F.coalesce("status", F.lit("draft"))).orderBy(F.desc(F.coalesce("published_at", "created_at")), "version_id")

    def invalid_versions(self) -> DataFrame:
        """version_id and the first rule that its record breaks: it has a known state, a creation time, and a publication time if published."""
        rule = F.when(~F.col("status").isin(*STATES), "STATUS_UNKNOWN").when(F.col("created_at").isNull(), "CREATED_AT_MISSING").when((F.col("status") == "published") & F.col("published_at").isNull(), "PUBLISHED_AT_MISSING")
        return self.versions().withColumn("rule", rule).filter("rule is not null").select("version_id", "rule")

    def read_version(self, version_id: str) -> dict:
        """The record of a version with its defaults; an unknown one is a KeyError, one that breaks a rule a BadVersion."""
        row = self.versions().filter(F.col("version_id") == version_id).first()
        if row is None:
            raise KeyError(version_id)
        broken = self.invalid_versions().filter(F.col("version_id") == version_id).first()
        if broken is not None:
            raise BadVersion(f"{version_id}: {broken.rule}")
        return row.asDict()

    def manifest(self, version_id: str) -> DataFrame:
        """artifact names of a version, in order."""
        return self.table("manifests", MANIFESTS).filter(F.col("version_id") == version_id).select("artifact", "published_at").orderBy("artifact")

    def new_version_id(self) -> str:
        stamp = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return f"dataset-{stamp.replace(':', '-').replace('.', '-')}-{uuid.uuid4().hex[:8]}"

    def publish(self, run_id: str, actor: str, artifacts: dict[str, DataFrame], publishability: str, version_id: str | None = None) -> str:
        """Writes each artifact of a new version once, then its manifest and version row, and last the pointer; a failure before leaves the active version as it was."""
        if publishability == "blocked":
            raise PublishBlocked(run_id)
        version = version_id or self.new_version_id()
        for name, rows in artifacts.items():
            rows.write.mode("errorifexists").parquet(f"{self.root}/artifacts/{name}/version_id={version}")
        now = datetime.now(timezone.utc)
        listed = self.spark.createDataFrame([(version, name, now) for name in sorted(artifacts)], MANIFESTS)
        listed.coalesce(1).write.mode("append").parquet(f"{self.root}/manifests")
        self._append("versions", VERSIONS, version, run_id, "published", now, now, publishability)
        self.activate(version)
        self.write_run(run_id, "published", version)
        self.audit("PUBLISH", actor, version)
        return version

    def artifact(self, name: str, version_id: str | None = None, schema: str | None = None, limit: int | None = None) -> DataFrame | None:
        """An artifact of a version, by default the active one. Without it: empty rows of the schema, or None if no schema is given."""
        version = version_id or self.active()
        try:
            rows = self.spark.read.parquet(f"{self.root}/artifacts/{name}/version_id={version}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema) if schema else None
        return rows.limit(limit) if limit is not None else rows

    def active_artifacts(self, names: list[str]) -> dict[str, DataFrame | None]:
        version = self.active()
        return {n: self.artifact(n, version) if version else None for n in names}

    # Pointer

    def activate(self, version_id: str | None) -> None:
        self._append("pointers", POINTERS, version_id, datetime.now(timezone.utc), uuid.uuid4().hex)

    def pointer(self, fallback: str | None = None) -> str | None:
        """The newest pointer; an explicit null stays null, without a pointer the fallback holds."""
        row = self.table("pointers", POINTERS).agg(F.max_by(F.struct("pointer"), "at").alias("x")).first().x
        return fallback if row is None or row.pointer == "" else row.pointer

    def active(self, fallback: str | None = None) -> str | None:
        """The pointed version if it exists."""
        pointer = self.pointer(fallback)
        return pointer if pointer and not self.versions().filter(F.col("version_id") == pointer).isEmpty() else None

    def repair_pointer(self, fallback: str | None = None) -> str | None:
        """A missing or dangling pointer moves to the greatest version id."""
        pointer = self.pointer(fallback)
        active = repaired_pointers(self.spark.createDataFrame([(pointer,)], "pointer string"), self.versions()).first().pointer
        if active is not None and active != pointer:
            self.activate(active)
        return active

    def rollback(self, version_id: str, actor: str) -> None:
        """Activates an earlier version; no data is written anew."""
        if self.versions().filter(F.col("version_id") == version_id).isEmpty():
            raise KeyError(version_id)
        self.activate(version_id)
        self.audit("ROLLBACK", actor, version_id)

    def counts(self) -> DataFrame:
        """Rows by area."""
        return area_counts({"quarantine": self.files(), "staging": self.runs(), "published": self.versions(), "audit": self.table("audit", AUDIT)})
