"""File-source streams: ingestion, redaction, duplicates, weekly trend, drift per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxmill.config import NEUTRAL, POSITIVE, Config
from voxmill.errors import FeedbackError
from voxmill.operators.drift import drift_report
from voxmill.operators.redaction import redact
from voxmill.plans.engine import AnalysisEngine, fail, run_and_store
from voxmill.sources.reviews import read_reviews


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 64, **options: object
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.options(**options).load(path)


def run_available(
    df: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Process everything that is there, batch by batch, and stop; a restart goes on after the last batch."""
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(on_batch)
        .start()
    )
    query.awaitTermination()
    return query


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder, so a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def ingest_stream(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    fmt: str = "csv",
    engine: AnalysisEngine | None = None,
    baseline_path: str | None = None,
    max_files: int = 1,
    cfg: Config = Config(),
) -> StreamingQuery:
    """Analyse review files as they arrive, oldest first; each batch becomes one run.

    The stream only names new files; a batch reads them as ``read_reviews`` does, so dialects, missing-value texts and positions
    are those of the batch reader. The run id comes from the batch number, so a batch that is repeated replaces
    its own result. A batch that breaks the contract (unreadable file, missing column, too few rows) becomes a
    FAILED run, and the stream goes on.
    """
    # The file source lists the folder and opens nothing as long as the content is not selected.
    listing = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(listing).option("maxFilesPerTrigger", max_files)
    files = stream.load(source).select("path")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session, job_id = batch.sparkSession, f"batch-{batch_id}"
        paths = sorted(r["path"] for r in batch.collect())  # at most ``max_files``
        if not paths:
            return
        try:
            raw = read_reviews(session, paths, fmt, cfg)
        except FeedbackError as exc:
            fail(session, root, job_id, exc)
            return
        try:
            run_and_store(session, raw, root, job_id, engine, baseline_path)
        except FeedbackError:
            pass  # recorded as a FAILED run

    return run_available(files, checkpoint, on_batch)


def redact_stream(df: DataFrame, text: str = "text", profile: str = "strict") -> DataFrame:
    """The batch redaction unchanged: it is stateless."""
    return redact(df, text, profile=profile)


def dedupe_stream(df: DataFrame, text: str, ts: str, delay: str = "1 day") -> DataFrame:
    """First row of every text within the watermark; state holds hashes, not texts."""
    hashed = df.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("text_hash", F.md5(F.col(text).cast("binary")))
    return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["text_hash"])


def trend_stream(df: DataFrame, ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """Weekly buckets with Monday starts; rows later than the watermark are dropped, gaps are filled on reading."""
    label = F.col("sentiment_label")
    return (
        df.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, "7 days", startTime="4 days").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            F.count_if(label == POSITIVE).alias("positive"),
            F.count_if(label == NEUTRAL).alias("neutral"),
            F.count_if(~label.isin(POSITIVE, NEUTRAL)).alias("negative"),
            F.sum(F.col("sentiment_score").cast("decimal(18,4)")).alias("score_sum"),
        )
        .select(
            F.col("w.start").cast("date").alias("period_start"),
            "review_count",
            "positive",
            "neutral",
            "negative",
            (F.col("score_sum").cast("double") / F.col("review_count")).alias("_mean"),
        )
    )


def drift_writer(
    baseline_path: str, out: str, embedder: str, vector: str = "features", bins: int = 10
) -> Callable[[DataFrame, int], None]:
    """Drift of every batch against the stored baseline; the first batch becomes the baseline, also when it is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        report = drift_report(batch.sparkSession, batch, baseline_path, embedder, vector, bins, creator=f"batch-{batch_id}")
        report.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write
