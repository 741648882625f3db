"""Queries over files that differ in dialect and over a result store: commits, failures, retention, stored reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.config import CATEGORIES, Config
from voxmill.functions.pii import TYPES
from voxmill.operators import cleaning, redaction, sentiment, validation
from voxmill.operators import runs as run_ops
from voxmill.operators.drift import drift_report, publish_baseline
from voxmill.operators.scale import materialised, scratch_path
from voxmill.plans.catalog import query
from voxmill.plans.engine import Analysis, AnalysisEngine, result_row
from voxmill.plans.queries_quality import _DRIFT, _PAIRS, _SIMILAR, _STATUS, _cohorts, _pairs, _psi_ctes
from voxmill.plans.queries_reads import _ORDERS, _PRIORITY, _trend, review_themes
from voxmill.plans.queries_sentiment import PERCENT
from voxmill.plans.queries_streams import write_csv
from voxmill.plans.serving import RunReader
from voxmill.plans.views import MEAN, NOW, THEMES, R, U, reviews, table, uploads
from voxmill.sources.reviews import read_reviews
from voxmill.sources.tables import ResultStore

# What validation and drift show: accuracy over the labelled documents, and the index of the second cohort of vectors.
_CHECKED = f"""{_PAIRS}, {_DRIFT}, {_psi_ctes(_SIMILAR)},
    checked AS (SELECT (SELECT concat(printf('%.1f', avg(CAST(predicted = gold AS INTEGER)) * 100), '%') FROM pairs) AS accuracy,
      (SELECT count(*) FROM pairs) AS pairs_n, (SELECT count(*) FROM embeddings WHERE label < 5) AS base_n, psi, {_STATUS} AS status,
      concat({_STATUS}, printf(' (%.2f)', psi)) AS moved FROM idx)"""
_STRIPPED = "regexp_replace(review_text, '^\\s+|\\s+$', '', 'g')"
_SAMPLES = 5


@query(
    "mixed_files",
    f"""WITH {U} SELECT {_STRIPPED} AS review_text, CASE WHEN date IN ('', 'nan') THEN NULL ELSE date END AS date,
      CASE WHEN rating = 'n/a' THEN NULL ELSE rating END AS rating, count(*) AS reviews
    FROM u WHERE {_STRIPPED} <> '' GROUP BY ALL""",
)
def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads as three sets of files with their own separators, headers and column orders, read as one folder."""
    base = scratch_path(spark, "mixed-files")
    rows = uploads(spark, sf_dir)
    layouts = [
        (",", {"review_text": "review_text", "date": "date", "rating": "rating"}),
        (";", {"rating": "Stars", "review_text": "Comment", "date": "created_at"}),
        ("\t", {"date": " Review_Date ", "rating": "score", "review_text": "Feedback"}),
    ]
    for i, (sep, names) in enumerate(layouts):
        part = rows.where(F.col("source_row") % 3 == i).select(*[F.col(c).alias(n) for c, n in names.items()])
        write_csv(part, f"{base}/part={i}", sep)
    back = cleaning.clean_text(read_reviews(spark, f"{base}/*/*.csv"))
    return back.groupBy("review_text", "date", "rating").agg(F.count(F.lit(1)).alias("reviews"))


def _analysis(spark: SparkSession, sf_dir: str, masked: DataFrame) -> Analysis:
    """The review view as an analysed batch, so that every figure of the stored run is known."""
    pii = redaction.pii_totals(masked)
    # The documents' labels check the scorer, and one cohort of vectors is the baseline of the other.
    checked = validation.validation_report(_pairs(spark, sf_dir), CATEGORIES)
    base, current = _cohorts(spark, sf_dir)
    baseline = scratch_path(spark, "baseline")
    publish_baseline(base, baseline, "embeddings")
    moved = drift_report(spark, current, baseline, "embeddings")
    summary = sentiment.with_percent(sentiment.summarize_sentiment(masked)).withColumns(
        {
            "pii_redacted_count": F.lit(pii.first()["total"]),
            "model_validation_accuracy": F.lit(checked.first()["display"]),
            "drift_status": F.lit(moved.first()["display"]),
        }
    )
    return Analysis(
        reviews=masked,
        themes=review_themes(masked).withColumn("name", F.col("theme_id")),
        summary=summary,
        breakdown=sentiment.sentiment_percent(masked),
        pii=pii,
        quality=cleaning.data_quality(uploads(spark, sf_dir)),
        profile=cleaning.batch_profile(masked),
        drift=moved,
        validation=checked,
        backends=AnalysisEngine().info(),
    )


def _store(spark: SparkSession, sf_dir: str, **options: int) -> ResultStore:
    masked = materialised(redaction.redact(reviews(spark, sf_dir, wide=True)), "masked")
    done = _analysis(spark, sf_dir, masked)
    store = ResultStore(spark, scratch_path(spark, "store"), **options)
    named = lambda df: df.withColumn("job_id", F.lit("run-1"))
    run = masked.agg(
        F.count(F.lit(1)).alias("rows_analyzed"), F.count_if(F.col("theme_id").isNull()).alias("unassigned_count")
    ).withColumns({"job_id": F.lit("run-1"), "status": F.lit("COMPLETED")})
    store.write_results(named(done.reviews), named(done.themes), result_row(spark, "run-1", done), run)
    for seq, event in enumerate(("JOB_STARTED", "JOB_COMPLETED"), 1):
        store.record("run-1", datetime(2024, 1, 1, 0, seq), event, seq=seq)
    return store


@query(
    "summary_job",
    f"""WITH {R}, {THEMES}, s AS (SELECT count(*) AS total_reviews, count(*) FILTER (WHERE "row" % 13 = 0) AS pii_redacted_count,
      round((count(*) FILTER (WHERE sentiment_label = 'Positive')
             - count(*) FILTER (WHERE sentiment_label NOT IN ('Positive', 'Neutral'))) * 100.0e0 / count(*), 1) AS net_sentiment_score FROM r),
    {_CHECKED}
    SELECT theme_id, count, row_number() OVER (ORDER BY count * greatest(0e0, -sentiment_score) DESC, count DESC, theme_id) AS rank,
      least(count, {_SAMPLES}) AS samples, s.*, accuracy AS model_validation_accuracy, moved AS drift_status FROM themes, s, checked""",
)
def summary_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = RunReader(_store(spark, sf_dir)).summary("run-1")
    return shown.select(
        "theme_id", "count", "rank", F.size("sample_verbatims").alias("samples"),
        *[F.col(f"summary.{c}").alias(c) for c in ("total_reviews", "pii_redacted_count", "net_sentiment_score", "model_validation_accuracy", "drift_status")],
    )


@query(
    "theme_list_job",
    f"""WITH {R}, {THEMES}, facets AS (SELECT general_class, sum(count) AS in_class FROM themes GROUP BY general_class)
    SELECT row_number() OVER (ORDER BY {_ORDERS['severity']}) AS rank, theme_id, general_class, count,
      round(count * 100.0e0 / (SELECT count(*) FROM r), 1) AS percentage, {_PRIORITY} AS priority_score, CAST(in_class AS BIGINT) AS in_class,
      (SELECT count(*) FROM themes) AS total_themes, (SELECT count(*) FROM r WHERE theme_id IS NULL) AS unassigned_count,
      (SELECT min("row") FROM r x WHERE x.theme_id = themes.theme_id AND x.sentiment_score
         = (SELECT min(sentiment_score) FROM r y WHERE y.theme_id = themes.theme_id)) AS first_sample
    FROM themes JOIN facets USING (general_class)""",
)
def theme_list_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, facets, totals = RunReader(_store(spark, sf_dir)).themes("run-1", "severity")
    first = F.regexp_extract(F.col("sample_verbatims")[0]["id"], "^v(.*)$", 1).cast("long")
    return listed.join(facets.withColumnRenamed("count", "in_class"), "general_class").select(
        "rank", "theme_id", "general_class", "count", "percentage", "priority_score", "in_class",
        F.lit(totals["total_themes"]).cast("long").alias("total_themes"),
        F.lit(totals["unassigned_count"]).cast("long").alias("unassigned_count"), first.alias("first_sample"),
    )


_HIGHLIGHTS = "len(regexp_extract_all(text, '(?i)\\b(?:love|great|good|excellent|helpful|terrible|awful|hate|waste of time|confusing|annoys|crash)\\b'))"


@query(
    "verbatim_page_job",
    f"""WITH {R}, page AS (SELECT *, row_number() OVER (ORDER BY sentiment_score, "row") AS k FROM r WHERE theme_id = 'click')
    SELECT concat('v', CAST("row" AS VARCHAR)) AS id, "row", sentiment_label, sentiment_score, {_HIGHLIGHTS} AS highlights,
      (SELECT count(*) FROM page) AS total, CAST(ceil((SELECT count(*) FROM page) / 20.0e0) AS BIGINT) AS total_pages
    FROM page WHERE k BETWEEN 21 AND 40""",
)
def verbatim_page_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    header, page = RunReader(_store(spark, sf_dir)).verbatims("run-1", "click", page=2)
    return page.select(
        "id", "row", "sentiment_label", "sentiment_score", F.size("highlights").cast("long").alias("highlights"),
        F.lit(header["total"]).cast("long").alias("total"), F.lit(header["total_pages"]).cast("long").alias("total_pages"),
    )


@query(
    "governance_job",
    f"""WITH {R}, {_CHECKED} SELECT count(*) FILTER (WHERE "row" % 13 = 0) AS total_redacted,
      count(*) FILTER (WHERE "row" % 13 = 0 AND "row" % 4 = 0) AS email,
      count(*) FILTER (WHERE "row" % 13 = 0 AND "row" % 4 = 1) AS credit_card, (SELECT count(*) FROM events) AS rows_received,
      any_value(accuracy) AS accuracy, any_value(pairs_n) AS pairs_n, any_value(status) AS drift_status, any_value(round(psi, 4)) AS psi,
      any_value(base_n) AS baseline_size, 'file:default' AS baseline_source, 'JOB_STARTED,JOB_COMPLETED' AS trail FROM r, checked""",
)
def governance_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, trail = RunReader(_store(spark, sf_dir)).governance("run-1")
    events = ",".join(r["event"] for r in trail.collect())
    return row.select(
        F.col("pii.total_redacted").alias("total_redacted"),
        *[F.col("pii.by_type")[k].alias(k) for k in TYPES if k in ("email", "credit_card")],
        F.col("data_quality.rows_received").alias("rows_received"),
        F.col("validation.validation.display").alias("accuracy"),
        F.col("validation.validation.n").alias("pairs_n"),
        F.col("drift.status").alias("drift_status"),
        F.col("drift.psi").alias("psi"),
        F.col("drift.baseline_size").alias("baseline_size"),
        F.col("drift.baseline_source").alias("baseline_source"),
        F.lit(events).alias("trail"),
    )


# ---------------------------------------------------------------- commits
@query(
    "store_failed_run",
    f"""WITH {R} SELECT '0012' AS job_id, 'COMPLETED' AS status, count(*) AS reviews, 'read' AS outcome FROM r WHERE "row" % 2 = 0
    UNION ALL SELECT 'late', 'FAILED', 0, 'JOB_FAILED' UNION ALL SELECT 'open', 'PROCESSING', 0, 'JOB_NOT_READY'""",
)
def store_failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completed, a failed and an open run: only the first can be read, and the failed one leaves no reviews."""
    rows = reviews(spark, sf_dir)
    store = ResultStore(spark, scratch_path(spark, "store"))
    for job_id, rest in (("0012", 0), ("late", 1)):
        part = rows.where(F.col("row") % 2 == rest).withColumn("job_id", F.lit(job_id))
        run = spark.createDataFrame([(job_id, "COMPLETED")], "job_id string, status string")
        themes = review_themes(part).withColumns({"job_id": F.lit(job_id), "name": F.col("theme_id")})
        store.write_results(part, themes, run, run)
    store.fail_run(spark.createDataFrame([("late", "FAILED")], "job_id string, status string"))
    store.put_run(spark.createDataFrame([("open", "PROCESSING")], "job_id string, status string"))

    def outcome(job_id: str) -> str:
        try:
            store.read_results(job_id)
        except ValueError as exc:
            return exc.code
        return "read"

    kept = store._table("reviews_scored", _REVIEW_KEYS).groupBy("job_id").agg(F.count(F.lit(1)).alias("reviews"))
    outcomes = spark.createDataFrame([(j, outcome(j)) for j in ("0012", "late", "open")], "job_id string, outcome string")
    found = store.runs().select("job_id", "status").join(outcomes, "job_id").join(kept, "job_id", "left")
    return found.select("job_id", "status", F.coalesce("reviews", F.lit(0)).alias("reviews"), "outcome")


_REVIEW_KEYS = "job_id string, row long"

_MONTHS = """
SELECT strftime(o_orderdate, '%Y-%m') AS job_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS created_at,
  CASE WHEN month(o_orderdate) = 12 THEN 'PROCESSING' ELSE 'COMPLETED' END AS status FROM orders"""
_GONE = f"created_at < TIMESTAMP '{NOW}' - INTERVAL 2000 DAY AND status <> 'PROCESSING'"


@query(
    "store_retention",
    f"""WITH m AS ({_MONTHS}) SELECT job_id, CASE WHEN status = 'PROCESSING' THEN 'FAILED' ELSE status END AS status,
      CASE WHEN {_GONE} OR status = 'PROCESSING' THEN 0 ELSE count(*) END AS reviews,
      CASE WHEN {_GONE} THEN 'JOB_DELETED' WHEN status = 'PROCESSING' THEN 'JOB_FAILED' END AS event
    FROM m GROUP BY job_id, created_at, status""",
)
def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each month of orders: old ones go with all their rows, open ones time out; the audit log names both."""
    now = datetime.fromisoformat(NOW)
    orders = table(spark, sf_dir, "orders").withColumn("job_id", F.date_format("o_orderdate", "yyyy-MM"))
    rows = orders.select("job_id", F.col("o_orderkey").alias("row"))
    runs = orders.select(
        "job_id",
        F.date_trunc("month", "o_orderdate").alias("created_at"),
        F.when(F.month("o_orderdate") == 12, "PROCESSING").otherwise("COMPLETED").alias("status"),
    ).distinct()
    store = ResultStore(spark, scratch_path(spark, "store"))
    none = spark.createDataFrame([], "job_id string, theme_id string")
    store.write_results(rows.repartition("job_id"), none, runs.select("job_id", "status"), runs)
    everything = materialised(store.runs(), "runs")
    store.purge(run_ops.expired_runs(everything, F.lit(now), Config(retention_days=2000)), now)
    store.fail_timed_out(run_ops.timed_out_runs(everything, F.lit(now)), now)
    kept = store._table("reviews_scored", _REVIEW_KEYS).groupBy("job_id").agg(F.count(F.lit(1)).alias("reviews"))
    events = store.audit().select("job_id", "event")
    left = everything.select("job_id").join(store.runs().select("job_id", "status"), "job_id", "left")
    old = everything.select("job_id", F.col("status").alias("_status"))
    found = left.join(kept, "job_id", "left").join(events, "job_id", "left").join(old, "job_id")
    return found.select("job_id", F.coalesce("status", "_status").alias("status"), F.coalesce("reviews", F.lit(0)).alias("reviews"), "event")


# ---------------------------------------------------------------- deep pages
_DEEP = ((30, "most_negative", None), (17, "recent", None), (12, "most_positive", "Positive"), (100_000, "most_negative", None))


def _deep(page: int, sort: str, label: str | None) -> str:
    order = {"most_negative": "sentiment_score, \"row\"", "most_positive": "sentiment_score DESC, \"row\"", "recent": "date DESC NULLS LAST, \"row\" DESC"}[sort]
    chosen = "theme_id = 'view'" + (f" AND sentiment_label = '{label}'" if label else "")
    return f"""SELECT '{sort}' AS sort, "row", k - {5 * (page - 1)} AS position FROM (SELECT "row", row_number() OVER (ORDER BY {order}) AS k FROM r WHERE {chosen})
    WHERE k BETWEEN {5 * (page - 1) + 1} AND {5 * page}"""


@query("verbatims_deep", f"WITH {R} " + " UNION ALL ".join(_deep(*d) for d in _DEEP))
def verbatims_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages far behind, each from the files of its own places."""
    reader = RunReader(_store(spark, sf_dir, index_from=50, index_bucket=400))
    out = None
    for page, sort, label in _DEEP:
        rows = reader.verbatims("run-1", "view", page, 5, label, sort)[1].select("row")
        numbered = spark.createDataFrame([(sort, r["row"], i) for i, r in enumerate(rows.collect(), 1)], "sort string, row long, position long")  # a page
        out = numbered if out is None else out.unionByName(numbered)
    return out


# ---------------------------------------------------------------- export
@query(
    "export_document",
    f"""WITH {R}, {THEMES}, {_CHECKED} SELECT (SELECT count(*) FROM r) AS total_reviews, (SELECT count(*) FROM themes) AS themes_total,
      (SELECT arg_max(theme_id, count) FROM themes) AS largest, (SELECT round({MEAN}, 4) FROM r) AS mean_polarity,
      (SELECT count(*) FROM r WHERE "row" % 13 = 0) AS entities, accuracy, moved AS drift, (SELECT CAST(min(date) AS VARCHAR) FROM r) AS date_start,
      (SELECT CAST(max(date) AS VARCHAR) FROM r) AS date_end, (SELECT round(avg(rating), 2) FROM r) AS average_rating, 'kmeans' AS tier2,
      (SELECT count(*) FROM r) AS reviews_written FROM checked""",
)
def export_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run written as JSON and read back: summary, themes, the meta block and the reviews beside them."""
    path = scratch_path(spark, "export")
    RunReader(_store(spark, sf_dir)).export("run-1", path)
    document, written = spark.read.json(f"{path}/document"), spark.read.json(f"{path}/reviews").count()
    return document.select(
        "total_reviews", F.col("meta.themes_total").alias("themes_total"),
        F.element_at(F.array_sort("themes", lambda a, b: F.when(a["count"] < b["count"], 1).when(a["count"] > b["count"], -1).otherwise(0)), 1)["theme_id"].alias("largest"),
        F.col("meta.mean_polarity").alias("mean_polarity"), F.col("meta.pii_breakdown.total").alias("entities"),
        F.col("meta.validation.display").alias("accuracy"), F.col("meta.drift.display").alias("drift"),
        F.col("meta.date_range.start").alias("date_start"), F.col("meta.date_range.end").alias("date_end"),
        F.col("meta.average_rating").alias("average_rating"), F.col("meta.backends.tier2").alias("tier2"), F.lit(written).cast("long").alias("reviews_written"),
    )


# ---------------------------------------------------------------- kept aggregates
_LEFT = '"row" % 6 NOT IN (2, 3)'


def _many_runs(spark: SparkSession, sf_dir: str) -> ResultStore:
    """The reviews as six runs, one of which is deleted, one purged and one written twice."""
    rows = reviews(spark, sf_dir, wide=True).withColumn("job_id", F.concat(F.lit("run-"), F.col("row") % 6))
    rows = materialised(rows, "rows")
    store = ResultStore(spark, scratch_path(spark, "store"))
    now = datetime.fromisoformat(NOW)
    none = spark.createDataFrame([], "job_id string, theme_id string")
    ids = [f"run-{i}" for i in range(6)]
    runs = spark.createDataFrame([(j, "COMPLETED", now) for j in ids], "job_id string, status string, created_at timestamp")
    store.write_results(rows, none, runs.select("job_id", "status"), runs)
    again = F.col("job_id") == "run-5"
    store.write_results(rows.where(again), none, runs.where(again).select("job_id", "status"), runs.where(again))
    store.delete_run("run-2", now)
    store.purge(runs.where(F.col("job_id") == "run-3"), now)
    store.put_run(spark.createDataFrame([("run-9", "PROCESSING")], "job_id string, status string"))
    return store


@query(
    "kept_trends",
    f"""WITH {R}, kept AS (SELECT * FROM r WHERE {_LEFT}), {_trend('kept', 'weekly')}, themed AS (SELECT * FROM kept WHERE theme_id = 'view'),
    other AS (WITH {_trend('themed', 'weekly')} SELECT * FROM trend)
    SELECT 'all' AS theme, * FROM trend UNION ALL SELECT 'view', * FROM other""",
)
def kept_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends over many runs from their kept aggregates, after deletions."""
    reader = RunReader(_many_runs(spark, sf_dir))
    whole, view = reader.trends_of_runs("weekly"), reader.trends_of_runs("weekly", "view")
    return whole.withColumn("theme", F.lit("all")).unionByName(view.withColumn("theme", F.lit("view")))


@query(
    "kept_breakdown",
    f"""WITH {R.replace('FROM events', 'FROM events WHERE event_id % 6 NOT IN (2, 3)')}, {PERCENT},
    c AS (SELECT count(*) FILTER (WHERE sentiment_label = 'Positive') AS positive, count(*) FILTER (WHERE sentiment_label = 'Neutral') AS neutral,
      count(*) FILTER (WHERE sentiment_label = 'Negative') AS negative, count(*) FILTER (WHERE sentiment_label = 'Strongly Negative') AS strongly_negative,
      count(*) AS total_reviews FROM r) SELECT * FROM shares, c""",
)
def kept_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RunReader(_many_runs(spark, sf_dir)).breakdown_of_runs()
