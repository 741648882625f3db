"""Streaming queries: the test tables read as file streams, drained with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators import redaction
from voxmill.operators.analytics import fill_trend
from voxmill.operators.features import as_vector
from voxmill.operators.scale import scratch_path
from voxmill.plans.catalog import query
from voxmill.plans.queries_pii import _DOCS, _report
from voxmill.plans.queries_quality import _DRIFT, _SIMILAR, _STATUS, _psi_ctes
from voxmill.plans.queries_reads import _trend
from voxmill.plans.views import R, REVIEWS, U, table, uploads
from voxmill.sources.tables import ResultStore
from voxmill.streaming import streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A glob, because a stream reads folders; it matches exactly the table's file.
    return streams.read_stream(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


def _drained(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    return _drained_at(spark, df, scratch_path(spark, name), mode)


def _drained_at(spark: SparkSession, df: DataFrame, base: str, mode: str = "append") -> DataFrame:
    streams.run_available(df, f"{base}/checkpoint", streams.batch_writer(f"{base}/out"), mode)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("redact_stream", _report(_DOCS))
def redact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = streams.redact_stream(_stream(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism))
    return redaction.pii_report(_drained(spark, masked, "redact"))


@query("trend_stream", f"WITH {R}, {_trend('r', 'weekly')} SELECT * FROM trend")
def trend_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events")
    # Complete mode emits every window on the last batch of the drain, whatever the watermark.
    base = scratch_path(spark, "trend")
    streams.run_available(
        streams.trend_stream(_timed_reviews(spark, events)),
        f"{base}/checkpoint",
        lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"),
        "complete",
    )
    return fill_trend(spark.read.parquet(f"{base}/out"), "weekly")


def _timed_reviews(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The review view plus its event time."""
    return spark.sql(REVIEWS.replace('"', "`").replace("FROM {events}", ", ts FROM {events}"), events=events)


# A batch of these queries is a folder of as many files.
BATCH_FILES = 8
_WEEKS = "CAST(date_trunc('week', ts) AS DATE)"


@query(
    "trend_stream_late",
    f"""SELECT {_WEEKS} AS period_start, count(*) AS review_count FROM events
    WHERE event_id % 2 = 0 OR CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 10 GROUP BY 1
    HAVING {_WEEKS} + 7 <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 7 DAY""",
)
def trend_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches in append mode: the rows of the last ten days, the older even ones, and the older odd ones.

    The watermark that the first batch sets closes the weeks after the second one and drops the third one's rows as late.
    """
    base = scratch_path(spark, "trend-late")
    rows = table(spark, sf_dir, "events")
    top = rows.agg(F.max(F.col("ts").cast("date"))).first()[0]
    day, even = F.col("ts").cast("date"), F.col("event_id") % 2 == 0
    last = day >= F.date_sub(F.lit(top), 10)
    # Files are taken in the order of their modification times.
    for i, part in enumerate((rows.where(last), rows.where(~last & even), rows.where(~last & ~even))):
        part.repartition(BATCH_FILES).write.parquet(f"{base}/in/batch={i}")
    stream = streams.read_stream(spark, f"{base}/in/*", rows.schema, max_files=BATCH_FILES)
    out = _drained_at(spark, streams.trend_stream(_timed_reviews(spark, stream)), base)
    return out.select("period_start", "review_count")


@query(
    "dedupe_stream",
    "SELECT role, count(*) AS turns, count(DISTINCT text) AS texts FROM conversations GROUP BY role",
)
def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _stream(spark, sf_dir, "conversations")
    # Turns carry no time of their own; the arrival time is one constant, so nothing is late.
    timed = turns.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn(
        "text", F.concat_ws("\n", "role", "text")
    )
    first = _drained(spark, streams.dedupe_stream(timed, "text", "ts").select("role", "text_hash"), "dedupe")
    all_turns = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"))
    return first.groupBy("role").agg(F.count(F.lit(1)).alias("texts")).join(all_turns, "role")


@query(
    "drift_stream",
    f"""WITH {_DRIFT}, {_psi_ctes(_SIMILAR)}
    SELECT 0 AS batch, 'Baseline initialized' AS status, CAST(NULL AS DOUBLE) AS psi, CAST(NULL AS DOUBLE) AS centroid_cosine_distance,
      CAST(NULL AS BIGINT) AS baseline_size
    UNION ALL SELECT 1, {_STATUS}, round(psi, 4),
      (SELECT round(1 - sum(a.c * b.c), 4) FROM cents a JOIN cents b USING (pos) WHERE a.base AND NOT b.base),
      (SELECT count(*) FROM embeddings WHERE label < 5) FROM idx""",
)
def drift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "drift")
    # Two folders, lower labels first: the first batch becomes the baseline, the second is compared with it.
    rows = table(spark, sf_dir, "embeddings")
    for i, part in enumerate((rows.where(F.col("label") < 5), rows.where(F.col("label") >= 5))):
        part.repartition(BATCH_FILES).write.parquet(f"{base}/in/batch={i}")
    stream = streams.read_stream(spark, f"{base}/in/*", rows.schema, max_files=BATCH_FILES)
    vectors = stream.withColumn("features", as_vector(F.col("embedding")))
    write = streams.drift_writer(f"{base}/baseline", f"{base}/out", "test")

    def twice(batch: DataFrame, batch_id: int) -> None:
        # A batch that is repeated after a failure gives the same row again.
        write(batch, batch_id)
        write(batch, batch_id)

    streams.run_available(vectors, f"{base}/checkpoint", twice)
    found = spark.read.parquet(f"{base}/out").withColumnRenamed("batch_id", "batch")
    return found.select("batch", "status", "psi", "centroid_cosine_distance", "baseline_size")


# More files than a batch of these queries has; batches are told apart by separate runs over one checkpoint.
MANY_FILES = 10_000
_CLEAN = "regexp_replace(review_text, '^\\s+|\\s+$', '', 'g')"


@query(
    "ingest_stream",
    f"""WITH {U} SELECT 'COMPLETED' AS status, CASE WHEN source_row % 2 = 0 THEN 'even' ELSE 'odd' END AS half, count(*) AS rows_received,
      count(*) FILTER (WHERE {_CLEAN} <> '') AS rows_analyzed FROM u GROUP BY ALL
    UNION ALL SELECT 'FAILED', 'none', 0, 0""",
)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of uploads in different dialects and column orders, and a file that is too short: three batches, three runs."""
    base = scratch_path(spark, "ingest")
    # A file is read by one task, so there are as many files as the rows need; the short file takes its row from the scan.
    rows, short = uploads(spark, sf_dir, True), uploads(spark, sf_dir).limit(1)
    even, odd = rows.where("source_row % 2 = 0"), rows.where("source_row % 2 = 1")
    halves = (
        (even.select("review_text", "date", "rating"), ","),
        (odd.select(F.col("rating").alias("Stars"), F.col("review_text").alias("Comment"), F.col("date").alias("created_at")), ";"),
        (short.select("review_text", "date", "rating"), ","),
    )
    for i, (part, sep) in enumerate(halves):
        write_csv(part, f"{base}/files/{i}", sep)
        # The stream goes on where it stopped: all new files are the next batch.
        streams.ingest_stream(spark, f"{base}/files/*", f"{base}/store", f"{base}/checkpoint", max_files=MANY_FILES)
    runs = ResultStore(spark, f"{base}/store").runs()
    half = F.element_at(F.array(F.lit("even"), F.lit("odd"), F.lit("none")), F.substring_index("job_id", "-", -1).cast("int") + 1)
    return runs.select(
        "status", half.alias("half"), F.coalesce("rows_received", F.lit(0)).alias("rows_received"), F.coalesce("rows_analyzed", F.lit(0)).alias("rows_analyzed")
    )


def write_csv(df: DataFrame, path: str, sep: str) -> None:
    """A file for each partition, quoted everywhere, so that white-space texts survive the trip through CSV."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", sep).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
