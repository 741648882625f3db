"""Run-table queries: orders stand in for runs, line items for their result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.operators import runs as ops
from voxmill.operators.scale import scratch_path
from voxmill.plans.catalog import query
from voxmill.plans.queries_reads import review_themes
from voxmill.plans.views import NOW, RUN, THEMES, R, reviews, runs, table
from voxmill.sources.tables import ResultStore

_CREATED = "strftime(created_at, '%Y-%m-%d')"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("job_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("runs_by_status", f"WITH {RUN} SELECT job_id, status, {_CREATED} AS created FROM runs WHERE status = 'COMPLETED'")
def runs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ops.runs_by_status(runs(spark, sf_dir), "COMPLETED"))


_EXPIRED = f"created_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND status <> 'PROCESSING'"


@query("expired_runs", f"WITH {RUN} SELECT job_id, status, {_CREATED} AS created FROM runs WHERE {_EXPIRED}")
def expired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ops.expired_runs(runs(spark, sf_dir), _now()))


@query("retention_purge", f"WITH {RUN} SELECT job_id, status, {_CREATED} AS created FROM runs WHERE NOT ({_EXPIRED})")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    return _shown(ops.purge(rows, ops.expired_runs(rows, _now())))


@query(
    "retention_purge_rows",
    f"""WITH {RUN} SELECT l_returnflag, count(*) AS "rows", count(DISTINCT l_orderkey) AS surviving_runs FROM lineitem
    WHERE l_orderkey NOT IN (SELECT run_key FROM runs WHERE {_EXPIRED}) GROUP BY l_returnflag""",
)
def retention_purge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), "l_returnflag")
    left = ops.purge(items, ops.expired_runs(runs(spark, sf_dir), _now()))
    return left.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("job_id").alias("surviving_runs")
    )


@query(
    "deletion_events",
    f"""WITH {RUN} SELECT job_id, 'JOB_DELETED' AS event, 'retention' AS reason FROM runs WHERE {_EXPIRED}""",
)
def deletion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ops.deletion_events(ops.expired_runs(runs(spark, sf_dir), _now()), _now())
    return events.select("job_id", "event", F.col("details")["reason"].alias("reason"))


@query(
    "timed_out_runs",
    f"""WITH {RUN} SELECT job_id, status, {_CREATED} AS created FROM runs
    WHERE status = 'PROCESSING' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND""",
)
def timed_out_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("started_at", F.lit(None).cast("timestamp"))
    return _shown(ops.timed_out_runs(rows, _now()))


@query(
    "avg_throughput",
    f"""WITH {RUN} SELECT round(avg(rows_per_second), 6) AS avg_rows_per_second
    FROM (SELECT * FROM runs ORDER BY created_at DESC, job_id DESC LIMIT 5)""",
)
def avg_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = ops.avg_throughput(runs(spark, sf_dir))
    return mean.select(F.round("avg_rows_per_second", 6).alias("avg_rows_per_second"))


@query(
    "audit_log",
    f"""WITH {RUN}, e AS (SELECT job_id, created_at AS ts, 1 AS seq, 'UPLOAD_RECEIVED' AS event FROM runs
      UNION ALL SELECT job_id, created_at, 2, 'JOB_STARTED' FROM runs WHERE status <> 'QUEUED'
      UNION ALL SELECT job_id, created_at + INTERVAL 90 SECOND, 3, 'JOB_COMPLETED' FROM runs WHERE status = 'COMPLETED')
    SELECT job_id, event, CAST(row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS INTEGER) AS position FROM e""",
)
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)


    def step(seq: int, event: str, has: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(event).alias("event"), has.alias("has"))

    steps = F.array(
        step(1, "UPLOAD_RECEIVED", F.lit(True)),
        step(2, "JOB_STARTED", F.col("status") != "QUEUED"),
        step(3, "JOB_COMPLETED", F.col("status") == "COMPLETED"),
    )
    events = rows.select("job_id", "created_at", F.inline(steps)).where("has")
    late = F.when(F.col("seq") == 3, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(90))).otherwise(
        F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    )
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    return (
        events.withColumn("ts", F.col("created_at") + late)
        .withColumn("position", F.row_number().over(w))
        .select("job_id", "event", "position")
    )


@query(
    "store_roundtrip",
    f"""WITH {R}, {THEMES} SELECT theme_id, count(*) AS reviews, any_value(themes.count) AS stored,
      any_value(themes.sentiment) AS sentiment FROM r JOIN themes USING (theme_id) GROUP BY theme_id""",
)
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).withColumn("job_id", F.lit("run-1"))
    themes = review_themes(rows).withColumns({"job_id": F.lit("run-1"), "name": F.col("theme_id")})
    summary = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_reviews"))
    run = summary.select("job_id", F.lit("COMPLETED").alias("status"), F.col("total_reviews").alias("rows_analyzed"))
    store = ResultStore(spark, scratch_path(spark, "store"))
    store.write_results(rows, themes, summary, run)
    back = store.read_results("run-1")
    stored = back["themes"].select("theme_id", F.col("count").alias("stored"), "sentiment")
    counts = back["reviews"].where(F.col("theme_id").isNotNull()).groupBy("theme_id").agg(F.count(F.lit(1)).alias("reviews"))
    return counts.join(stored, "theme_id")
