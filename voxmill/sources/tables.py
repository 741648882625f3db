"""Result tables and drift baselines as Parquet."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.config import AUDIT, PARTIALS, RUNS, SCORED, THEMES
from voxmill.errors import ContractMismatch, NotFound
from voxmill.operators.pages import BUCKET, write_index
from voxmill.operators.partials import partials_of
from voxmill.operators.scale import PAGE_DIRECT

RESULT_TABLES = ("reviews_scored", "partials", "verbatim_ranks", "themes", "job_results", "runs")
# Ids name folders, so they hold nothing that Spark would escape or a path would read otherwise.
_JOB_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")
# Audit event names.
EVENTS = (
    "UPLOAD_RECEIVED",
    "JOB_STARTED",
    "PII_REDACTION_COMPLETED",
    "OUTPUT_GUARD_HIT",
    "JOB_COMPLETED",
    "JOB_FAILED",
    "RAW_FILE_DELETED",
    "JOB_DELETED",
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent nullable ones become null."""
    if "job_id" in schema.names and "job_id" not in df.columns:
        raise ContractMismatch("a result table must carry job_id", found=df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def require_job_id(job_id: str) -> str:
    if not _JOB_ID.fullmatch(job_id):
        raise ContractMismatch("a run id has letters, digits, dots, dashes and underscores", job_id=job_id)
    return job_id


class ResultStore:
    """Result tables under one folder, partitioned by run.

    A run counts as written once its row in ``runs`` says COMPLETED; that row is written last, and it is taken back before
    a run is written again, so readers never see half a run. Writing a run again replaces exactly its own
    partitions.
    """

    def __init__(self, spark: SparkSession, root: str, index_from: int = PAGE_DIRECT, index_bucket: int = BUCKET) -> None:
        """Themes with ``index_from`` reviews or more get an index of their pages, in buckets of ``index_bucket`` places."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.index_from, self.index_bucket = index_from, index_bucket

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _replace(self, df: DataFrame, table: str) -> None:
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("job_id")
            .parquet(self.path(table))
        )

    def _remove(self, job_id: str, tables: tuple[str, ...]) -> int:
        """Delete a run's partitions; returns how many there were."""
        jvm, conf, removed = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), 0
        for table in tables:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/job_id={require_job_id(job_id)}")
            removed += bool(where.getFileSystem(conf).delete(where, True))
        return removed

    def put_run(self, run: DataFrame) -> None:
        """Write run rows, replacing those of the same runs."""
        self._replace(conform(run, RUNS), "runs")

    def write_results(self, reviews: DataFrame, themes: DataFrame, result: DataFrame, run: DataFrame) -> None:
        """All tables of the runs in ``run``. If a table fails, what was written of these runs is removed again."""
        ids = [require_job_id(r[0]) for r in run.select("job_id").collect()]  # one row for each run
        for job_id in ids:
            self._remove(job_id, ("runs",))
        try:
            self._replace(conform(reviews, SCORED), "reviews_scored")
            # From what was just written, so that the reviews are not made again.
            written = self._table("reviews_scored", SCORED).where(F.col("job_id").isin(ids))
            self._replace(conform(partials_of(written), PARTIALS), "partials")
            for job_id in ids:
                self._remove(job_id, ("verbatim_ranks",))
            counts = self._table("partials", PARTIALS).where(F.col("job_id").isin(ids))
            write_index(written, counts, self.path("verbatim_ranks"), self.index_from, self.index_bucket)
            self._replace(conform(themes, THEMES), "themes")
            self._replace(result, "job_results")
        except Exception:
            for job_id in ids:
                self._remove(job_id, RESULT_TABLES)
            raise
        self.put_run(run)

    def fail_run(self, run: DataFrame) -> None:
        """Record failed runs and remove whatever they have written."""
        for row in run.select("job_id").collect():
            self._remove(row[0], RESULT_TABLES)
        self.put_run(run)

    def append_audit(self, events: DataFrame) -> None:
        conform(events, AUDIT).write.mode("append").parquet(self.path("audit_events"))

    def record(self, job_id: str, ts: datetime, event: str, details: dict[str, str] | None = None, seq: int = 0) -> None:
        row = (job_id, seq, ts, event, details or {})
        self.append_audit(self.spark.createDataFrame([row], AUDIT))

    def _table(self, name: str, schema: T.StructType | str) -> DataFrame:
        """A table in its declared types: partition values stay text, so a run ``0012`` keeps its zeros."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        try:
            return self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.names)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in (exc.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._table("runs", RUNS)

    def audit(self) -> DataFrame:
        return self._table("audit_events", AUDIT)

    def partials(self, *job_ids: str) -> DataFrame:
        """Kept aggregates of completed runs, of all or of those named."""
        done = self.runs().where(F.col("status") == "COMPLETED").select("job_id")
        kept = self._table("partials", PARTIALS)
        chosen = kept.where(F.col("job_id").isin(*[require_job_id(j) for j in job_ids])) if job_ids else kept
        return chosen.join(done, "job_id", "left_semi")

    def require_run(self, job_id: str) -> DataFrame:
        run = self.runs().where(F.col("job_id") == require_job_id(job_id))
        if run.isEmpty():
            raise NotFound("JOB_NOT_FOUND", f"there is no run {job_id}")
        return run

    def require_completed(self, job_id: str) -> DataFrame:
        """The row of a completed run; anything else raises what keeps it from being read."""
        run = self.require_run(job_id)
        row = run.select("status", "error_code", "error_message").first()
        if row["status"] == "FAILED":
            raise NotFound("JOB_FAILED", f"run {job_id} failed", error_code=row["error_code"], error_message=row["error_message"])
        if row["status"] != "COMPLETED":
            raise NotFound("JOB_NOT_READY", f"run {job_id} has not finished", status=row["status"])
        return run

    def read_results(self, job_id: str) -> dict[str, DataFrame]:
        """Result, themes, reviews and run row of one completed run; only its own partitions are read."""
        run = self.require_completed(job_id)
        result = self.spark.read.parquet(f"{self.path('job_results')}/job_id={job_id}").withColumn("job_id", F.lit(job_id))

        def of_run(name: str, schema: T.StructType) -> DataFrame:
            return self._table(name, schema).where(F.col("job_id") == job_id)

        return {"run": run, "result": result, "themes": of_run("themes", THEMES), "reviews": of_run("reviews_scored", SCORED)}

    def delete_run(self, job_id: str, ts: datetime | None = None, reason: str | None = None) -> None:
        """Remove a run's partitions, its run row first; the audit log stays and notes the deletion.

        A run that is being processed is left alone, and one that is not there raises.
        """
        if self.require_run(job_id).first()["status"] == "PROCESSING":
            raise NotFound("JOB_PROCESSING", f"run {job_id} is being processed")
        if not self._remove(job_id, tuple(reversed(RESULT_TABLES))):
            raise NotFound("JOB_NOT_FOUND", f"run {job_id} has left nothing to delete")
        if ts is not None:
            self.record(job_id, ts, "JOB_DELETED", {"reason": reason} if reason else {})

    def purge(self, expired: DataFrame, ts: datetime) -> int:
        """Delete expired runs with all they have written: folders go, no table is read or shuffled."""
        gone = [r["job_id"] for r in expired.select("job_id").distinct().orderBy("job_id").collect()]  # one row for each run
        for job_id in gone:
            self._remove(job_id, tuple(reversed(RESULT_TABLES)))
        rows = [(job_id, 0, ts, "JOB_DELETED", {"reason": "retention"}) for job_id in gone]
        if rows:
            self.append_audit(self.spark.createDataFrame(rows, AUDIT))
        return len(gone)

    def fail_timed_out(self, late: DataFrame, ts: datetime) -> int:
        """Runs that have been processed for too long become FAILED with the code TIMEOUT."""
        rows = late.select("job_id").distinct().orderBy("job_id").collect()  # one row for each run
        if rows:
            failed = late.withColumns(
                {"status": F.lit("FAILED"), "finished_at": F.lit(ts), "error_code": F.lit("TIMEOUT"), "error_message": F.lit("the run took too long")}
            )
            self.fail_run(self.spark.createDataFrame(conform(failed, RUNS).collect(), RUNS))
            events = [(r["job_id"], 9, ts, "JOB_FAILED", {"code": "TIMEOUT"}) for r in rows]
            self.append_audit(self.spark.createDataFrame(events, AUDIT))
        return len(rows)


def export_json(summary: DataFrame, themes: DataFrame, path: str, reviews: DataFrame | None = None, meta: DataFrame | None = None) -> None:
    """JSON lines: ``document`` holds the summary row with its (capped) themes and, if given, the one row of ``meta``; ``reviews`` the rows.

    Reviews can be any number, so they are files of their own next to the document, not one array.
    """
    listed = themes.agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*[c for c in themes.columns if c != "position"]).alias("theme")))).alias("_t"))
    document = (
        summary.withColumn("_one", F.lit(1))
        .join(listed.withColumn("_one", F.lit(1)), "_one")
        .select(*summary.columns, F.transform("_t", lambda t: t["theme"]).alias("themes"), "_one")
    )
    if meta is not None:
        block = meta.select(F.struct(*meta.columns).alias("meta")).withColumn("_one", F.lit(1))
        document = document.join(block, "_one")
    document = document.drop("_one")
    document.write.mode("overwrite").json(f"{path.rstrip('/')}/document")
    if reviews is not None:
        reviews.write.mode("overwrite").json(f"{path.rstrip('/')}/reviews")


# ---------------------------------------------------------------- baselines
def _baseline_path(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/baseline_name={name}"


def save_baseline(
    similarities: DataFrame, center: list[float], path: str, embedder: str, created: datetime, name: str = "default", creator: str = ""
) -> None:
    """What drift compares with: the unit centroid of the vectors and the similarity of each of them to it.

    Eight bytes a row instead of a vector. The embedder's name, the creation time and the run that made it are kept with the centroid,
    which is written last: without it there is no baseline.
    """
    spark, where = similarities.sparkSession, _baseline_path(path, name)
    similarities.select(F.col("similarity").cast("double")).write.mode("overwrite").parquet(f"{where}/similarities")
    head = spark.createDataFrame([(center, embedder, created, creator)], "centroid array<double>, embedder string, created timestamp, creator string")
    head.coalesce(1).write.mode("overwrite").parquet(f"{where}/centroid")


def read_baseline(
    spark: SparkSession, path: str, embedder: str, name: str = "default", creator: str | None = None
) -> tuple[list[float] | None, DataFrame | None, str]:
    """(centroid, similarities, ``file:<name>``), or (None, None, ``missing`` | ``unusable``).

    A baseline that ``creator`` has made itself counts as missing, so a run that is repeated makes it again.
    """
    where = _baseline_path(path, name)
    try:
        head = spark.read.parquet(f"{where}/centroid").first()
    except AnalysisException as exc:
        return None, None, "missing" if "PATH_NOT_FOUND" in (exc.getCondition() or "") else "unusable"
    try:
        stored = spark.read.parquet(f"{where}/similarities")
    except AnalysisException:
        return None, None, "unusable"
    if head is None or not {"centroid", "embedder", "creator"} <= set(head.asDict()) or stored.columns != ["similarity"]:
        return None, None, "unusable"
    if creator and head["creator"] == creator:
        return None, None, "missing"
    if head["embedder"] != embedder:
        return None, None, "unusable"
    return list(head["centroid"]), stored, f"file:{name}"
