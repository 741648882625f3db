"""Queries over the run table and the audit log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.config import Config
from voxmill.operators.scale import small_table

THROUGHPUT_SAMPLES = 5


def _now(now: datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now)


def runs_by_status(runs: DataFrame, status: str) -> DataFrame:
    return runs.where(F.col("status") == status).orderBy("created_at", "job_id")


def expired_runs(runs: DataFrame, now: datetime | None = None, cfg: Config = Config()) -> DataFrame:
    cutoff = _now(now) - F.make_dt_interval(F.lit(cfg.retention_days))
    return runs.where((F.col("created_at") < cutoff) & (F.col("status") != "PROCESSING"))


def purge(table: DataFrame, expired: DataFrame) -> DataFrame:
    """Rows of any table that survive the removal of expired runs. A result store drops folders instead (``ResultStore.purge``).

    Many expired runs are shuffled; a run with very many rows is then split by adaptive execution.
    """
    gone, small = small_table(expired.select("job_id"))
    return table.join(F.broadcast(gone) if small else gone, "job_id", "left_anti")


def deletion_events(expired: DataFrame, now: datetime | None = None) -> DataFrame:
    return expired.select(
        "job_id",
        _now(now).alias("ts"),
        F.lit("JOB_DELETED").alias("event"),
        F.create_map(F.lit("reason"), F.lit("retention")).alias("details"),
    )


def timed_out_runs(runs: DataFrame, now: datetime | None = None, cfg: Config = Config()) -> DataFrame:
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(cfg.timeout_seconds))
    started = F.coalesce(F.col("started_at"), F.col("created_at"))
    return runs.where((F.col("status") == "PROCESSING") & (started < _now(now) - limit))


def avg_throughput(runs: DataFrame) -> DataFrame:
    """Mean rows per second of the last five finished samples."""
    last = (
        runs.where(F.col("rows_per_second").isNotNull())
        .orderBy(F.desc("created_at"), F.desc("job_id"))
        .limit(THROUGHPUT_SAMPLES)
    )
    return last.agg(F.avg("rows_per_second").alias("avg_rows_per_second"))


def audit_trail(audit: DataFrame, job_id: str) -> DataFrame:
    return audit.where(F.col("job_id") == job_id).orderBy("ts", "seq")
