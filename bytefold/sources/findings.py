"""The findings store: append-only tables in a folder, with a latest-row view for runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.operators.hits import latest
from bytefold.session import path_exists

# Columns of the store's tables.
SCHEMAS = {
    "projects": "project_id string, name string, created_at string, description string",
    "dumps": "dump_id string, project_id string, file_path string, file_type string, file_size bigint, added_at string, metadata_json string",
    "analysis_runs": "run_id string, project_id string, dump_id string, started_at string, finished_at string, status string, config_json string",
    "findings": "finding_id string, run_id string, finding_type string, byte_offset bigint, length int, value_hex string, value_text string, confidence double, metadata_json string, created_at string",
}


class FindingsStore:
    """Tables under ``root``; every write appends, a finished run is a second row of its id."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    @staticmethod
    def _now() -> str:
        import datetime

        return datetime.datetime.now(datetime.timezone.utc).isoformat()

    def table(self, name: str) -> DataFrame:
        """A table as written; a table without rows yet is empty."""
        if not path_exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def create_project(self, name: str, description: str = "") -> str:
        key = uuid.uuid4().hex
        self._append("projects", self._rows("projects", [(key, name, self._now(), description)]))
        return key

    def add_dump(self, project_id: str, path: str, kind: str, size: int = 0, metadata: dict | None = None) -> str:
        key = uuid.uuid4().hex
        self._append("dumps", self._rows("dumps", [(key, project_id, path, kind, size, self._now(), json.dumps(metadata or {}))]))
        return key

    def start_run(self, project_id: str, dump_id: str = "", config: dict | None = None) -> str:
        key = uuid.uuid4().hex
        self._append("analysis_runs", self._rows("analysis_runs", [(key, project_id, dump_id, self._now(), None, "running", json.dumps(config or {}))]))
        return key

    def finish_run(self, run_id: str, status: str = "completed") -> None:
        """Append the final row of a run."""
        rows = self.runs().filter(F.col("run_id") == run_id)
        self._append("analysis_runs", self._rows("analysis_runs", [tuple({**r.asDict(), "status": status, "finished_at": self._now()}.values()) for r in rows.collect()]))

    def runs(self) -> DataFrame:
        """One row per run: the finished one if there is one."""
        return latest(self.table("analysis_runs"), "run_id", [F.col("finished_at").desc_nulls_last(), F.desc("status")])

    def add_findings(self, run_id: str, findings: DataFrame) -> None:
        """Append a frame of findings: ``secret_type`` or ``finding_type``, ``off``, ``length``, optional values."""
        has = lambda c, kind, default=None: (F.col(c) if c in findings.columns else F.lit(default)).cast(kind)
        kind = "finding_type" if "finding_type" in findings.columns else "secret_type"
        rows = findings.select(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")).alias("finding_id"), F.lit(run_id).alias("run_id"), F.col(kind).alias("finding_type"), has("off", "bigint").alias("byte_offset"), has("length", "int").alias("length"), has("value_hex", "string").alias("value_hex"), has("value_text", "string").alias("value_text"), has("confidence", "double", 1.0).alias("confidence"), has("metadata_json", "string", "{}").alias("metadata_json"), F.lit(self._now()).alias("created_at"))
        self._append("findings", rows)

    def persist_hits(self, hits: DataFrame, phase: str = "") -> dict[str, str]:
        """Hits of several libraries: a project and a finished run for each, three writes in all.

        The runs are written last: a step that fails before leaves rows that no run names, so
        nothing of it is seen.  A null library is one of its own, named ``None``.
        """
        name = F.coalesce(F.col("library").cast("string"), F.lit("None"))
        libraries = [r[0] for r in hits.select(name.alias("l")).distinct().orderBy("l").collect()]
        if not libraries:
            return {}
        now, projects, runs = self._now(), {n: uuid.uuid4().hex for n in libraries}, {n: uuid.uuid4().hex for n in libraries}
        self._append("projects", self._rows("projects", [(projects[n], n, now, "") for n in libraries]))
        names = F.create_map(*(F.lit(x) for kv in runs.items() for x in kv))
        staged = hits.withColumn("run_id", names[name])
        rows = staged.select(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")).alias("finding_id"), "run_id", F.col("secret_type").alias("finding_type"), F.col("off").alias("byte_offset"), F.col("length").cast("int"), F.lit(None).cast("string").alias("value_hex"), F.lit(None).cast("string").alias("value_text"), F.lit(1.0).alias("confidence"), F.lit("{}").alias("metadata_json"), F.lit(now).alias("created_at"))
        self._append("findings", rows)
        config = json.dumps({"phase": phase})
        self._append("analysis_runs", self._rows("analysis_runs", [(runs[n], projects[n], "", now, self._now(), "completed", config) for n in libraries]))
        return runs

    def query_findings(self, run_id: str, finding_type: str | None = None) -> DataFrame:
        rows = self.table("findings").filter(F.col("run_id") == run_id)
        if finding_type is not None:
            rows = rows.filter(F.col("finding_type") == finding_type)
        return rows.orderBy("created_at", "finding_id")

    def finding_counts(self, run_id: str) -> DataFrame:
        return self.table("findings").filter(F.col("run_id") == run_id).groupBy("finding_type").count()

    def timeline(self, project_id: str) -> DataFrame:
        return self.runs().filter(F.col("project_id") == project_id).orderBy("started_at", "run_id")

    def list_projects(self) -> DataFrame:
        return self.table("projects").orderBy("created_at", "project_id")
